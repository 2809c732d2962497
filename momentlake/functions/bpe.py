"""Byte-pair encoding of words, from a public vocabulary file given by its path.

A piece's UTF-8 bytes are written as printable characters, the last one marked as a word's end; then the neighbouring pair
of lowest rank is merged, again and again. A word's symbols are kept as a linked list and its candidate pairs in a heap,
so a long word costs n log n. Pieces repeat, so their ids are kept (up to ``KEEP`` pieces).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

KEEP = 1 << 18
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """For each byte the printable character it is written as: itself where Latin-1 prints it, else the next one from 256 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    moved = iter(range(256, 512))
    return [chr(b if p else next(moved)) for b, p in enumerate(prints)]


class WordBpe:
    """Encoder for vocabularies with word ends: ``vocab`` (symbol -> id) and ``merges`` (pairs, best first)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, self.rank = vocab, {pair: i for i, pair in enumerate(map(tuple, merges))}
        self.letters, self.known = byte_letters(), {}

    @classmethod
    def from_file(cls, path: str) -> WordBpe:
        """A file in the JSON form of the ``tokenizers`` library (model type BPE)."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def ids(self, piece: str) -> list[int]:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) >= KEEP:
                self.known.clear()
            got = self.known[piece] = [self.vocab[s] for s in self.symbols(piece)]
        return got

    def symbols(self, piece: str) -> list[str]:
        parts: list[str | None] = [self.letters[b] for b in piece.encode("utf-8")]
        if not parts:
            return []
        parts[-1] += WORD_END
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if j < len(parts) and (r := self.rank.get((parts[i], parts[j]))) is not None:
                heapq.heappush(waiting, (r, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if j >= len(parts) or parts[i] != left or parts[j] != right:
                continue  # merged with another neighbour meanwhile
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]


@lru_cache(maxsize=4)
def _loaded(path: str) -> WordBpe:
    return WordBpe.from_file(path)


def bpe_encoder(path: str, pieces: str) -> Callable[[Column], Column]:
    """Token ids of cleaned texts: split by the pattern ``pieces``, each piece encoded; the file is read once per worker. A null text gives null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(s: pd.Series) -> pd.Series:
        model, split = _loaded(path), regex.compile(pieces)
        return pd.Series([None if t is None else [i for p in split.findall(t) for i in model.ids(p)] for t in s.where(s.notna(), None)])

    return encode
