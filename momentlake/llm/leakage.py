"""Evaluation texts leaking into training text: an FM-index per training shard, searched backwards for test phrases.

A shard is a stretch of documents of one task. All its words form one text over the shard's own vocabulary, with a
separator between documents; the text's suffixes are sorted, its Burrows-Wheeler transform is kept in a wavelet matrix
(bit-packed planes with block counts), and every 16th text position is kept. The indexes depend on no test set: they are
built in one pass over the corpus and stored as a table in the shared folder; any number of phrases is then searched in
them. All phrases of a block, the word n-grams of the test items, are searched at once, last word first, by ranks in the
matrix; hits are located by walking back to a kept position. Overlapping hits of an item in a document merge to one
removal span.

Defined results: null ids and texts take no part; fields with fewer words than a phrase give no phrase; repeated
rows count once; a task holds the phrases of a block (about ``block_phrases``), however many there are; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.llm.text import words
from momentlake.session import shared_folder

SHARD_SCHEMA = "docs array<long>, starts array<int>, vocabulary binary, fm binary"
HIT_SCHEMA = "doc_id long, phrase string, word int"
SEPARATOR, END = 1, 0
KEPT = 16


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of ``t`` in order (its last symbol must be the least and unique), by prefix doubling of those not yet told apart."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    rank = np.empty(n, np.int64)  # of a suffix: the place in ``sa`` where those that begin alike begin
    slots, keys, step = np.arange(n), t[sa].astype(np.int64), 0
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        several = ~new
        several[:-1] |= ~new[1:]
        slots = slots[several]
        if not len(slots):
            return sa
        step = 2 * step or 1
        part = sa[slots]
        keys = rank[part] * n + rank[part + step]
        order = np.argsort(keys, kind="stable")
        sa[slots], keys = part[order], keys[order]


class Bits:
    """A bit sequence in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits.astype(bool), np.zeros(64 - len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[i >> 6].astype(np.int64) + np.bitwise_count(self.words[i >> 6] & below)


class WaveletMatrix:
    """Ranks and symbols of a sequence, one bit plane per bit of the alphabet."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.planes, self.zeros = [], []
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (s >> level) & 1 == 1
            self.planes.append(Bits(bit))
            s = np.concatenate([s[~bit], s[bit]])
            self.zeros.append(len(s) - int(np.count_nonzero(bit)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before position ``i`` (arrays)."""
        lo, hi = np.zeros_like(i), i
        for level, (ones, zeros) in enumerate(zip(self.planes, self.zeros)):
            up = (c >> (len(self.planes) - 1 - level)) & 1 == 1
            a, b = ones.rank(lo), ones.rank(hi)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return hi - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for ones, zeros in zip(self.planes, self.zeros):
            bit, before = ones.get(i), ones.rank(i)
            out = out * 2 + bit
            i = np.where(bit, zeros + before, i - before)
        return out


class FMIndex:
    """Full-text index of a sequence of symbols >= 1 (0 is added as its end)."""

    def __init__(self, symbols: np.ndarray):
        t = np.append(symbols, END).astype(np.int32)
        sa = suffix_array(t)
        self.n, self.sigma = len(t), int(t.max()) + 1
        self.matrix = WaveletMatrix(t[sa - 1], self.sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=self.sigma))])
        kept = sa % KEPT == 0
        self.is_kept, self.kept = Bits(kept), sa[kept].astype(np.uint32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that start with each phrase (rows of equal length), by backward search."""
        known = ((phrases > END) & (phrases < self.sigma)).all(1)
        lo, hi = np.zeros(len(phrases), np.int64), np.where(known, self.n, 0)
        live = np.nonzero(known)[0]
        for column in range(phrases.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = phrases[live, column]
            lo[live] = self.before[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.before[c] + self.matrix.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back until a kept one."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        rows, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            hit = self.is_kept.get(rows[todo])
            done = todo[hit]
            out[done] = self.kept[self.is_kept.rank(rows[done])].astype(np.int64) + steps[done]
            todo = todo[~hit]
            c = self.matrix.symbol(rows[todo])
            rows[todo] = self.before[c] + self.matrix.rank(c, rows[todo])
            steps[todo] += 1
        return out


class _Numbers(dict):
    """Word -> symbol, given in the order in which words are met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 2
        return number


def shard(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """The index of a shard as one row: its documents, where each begins, its vocabulary and the FM-index."""
    number = _Numbers()
    symbols, starts, at = [np.array([SEPARATOR], np.int32)], [], 1
    for text in texts:
        found = words(text)
        starts.append(at)
        symbols += [np.fromiter(map(number.__getitem__, found), np.int32, len(found)), symbols[0]]
        at += len(found) + 1
    index = pickle.dumps(FMIndex(np.concatenate(symbols)))
    lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([*lists, pa.array(["\n".join(number).encode()]), pa.array([index])], ["docs", "starts", "vocabulary", "fm"])


def build_index(docs: DataFrame, id_col: str, text_col: str, *, shard_chars: int = 8_000_000) -> DataFrame:
    """One row per shard of about ``shard_chars`` characters, stored in the shared folder: the corpus is read once for any number of searches."""
    shared_folder(docs.sparkSession)
    shown = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= shard_chars:
                    yield shard(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield shard(ids, texts)

    return shown.mapInArrow(run, SHARD_SCHEMA).checkpoint()


def find_phrases(index: DataFrame, block: list[str]) -> DataFrame:
    """``(doc_id, phrase, word)``: every occurrence of the phrases (words of equal number, parted by blanks) in the indexed documents, by first word."""
    number: dict[str, int] = {}
    table = np.array([[number.setdefault(w, len(number)) for w in p.split(" ")] for p in block], np.int32)
    shared = index.sparkSession.sparkContext.broadcast((block, list(number), table))

    def run(batches):
        phrases, known, table = shared.value
        for b in batches:
            for docs, starts, vocabulary, fm in zip(*(c.to_pylist() for c in b.columns)):
                symbol = {w: i + 2 for i, w in enumerate(vocabulary.decode().split("\n"))}
                index = pickle.loads(fm)
                lo, hi = index.search(np.fromiter((symbol.get(w, END) for w in known), np.int64, len(known))[table])
                found = np.nonzero(hi > lo)[0]
                rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(lo[f], hi[f]) for f in found)])
                at = index.locate(rows)
                doc = np.searchsorted(np.array(starts), at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(docs, np.int64)[doc]), pa.array([phrases[f] for f in np.repeat(found, (hi - lo)[found])], pa.string()), pa.array(at - np.array(starts, np.int64)[doc], pa.int32())], ["doc_id", "phrase", "word"]
                )

    return index.mapInArrow(run, HIT_SCHEMA)


def item_phrases(tests: DataFrame, test_id: str, fields: list[str], width: int) -> DataFrame:
    """``(phrase, item)``: the runs of ``width`` words of each field, once per item."""

    def run(batches):
        for b in batches:
            out_p, out_i = [], []
            for item, *texts in zip(*(c.to_pylist() for c in b.columns)):
                for w in (words(t) for t in texts if t is not None):
                    grams = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)]
                    out_p += grams
                    out_i += [item] * len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.string()), pa.array(out_i, pa.string())], ["phrase", "item"])

    named = tests.where(F.col(test_id).isNotNull()).select(F.col(test_id).cast("string").alias("item"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    return named.mapInArrow(run, "phrase string, item string").distinct()


def leaked_spans(docs: DataFrame, id_col: str, text_col: str, tests: DataFrame, test_id: str, fields: list[str], *, width: int = 10, shard_chars: int = 8_000_000, block_phrases: int = 500_000) -> DataFrame:
    """``(doc_id, item, word_start, word_end)``: where ``docs`` hold ``width`` or more consecutive words of a field of ``tests``."""
    shared_folder(docs.sparkSession)
    owners = item_phrases(tests, test_id, fields, width).checkpoint()
    phrases = owners.select("phrase").distinct()
    blocks = -(-phrases.count() // block_phrases)
    index = build_index(docs, id_col, text_col, shard_chars=shard_chars)
    hits = docs.sparkSession.createDataFrame([], HIT_SCHEMA)
    for k in range(blocks):
        own = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k)
        block = [r.phrase for r in own.toLocalIterator()]  # about block_phrases
        if block:
            hits = hits.unionByName(find_phrases(index, sorted(block)))
    spans = hits.join(owners, "phrase").select("doc_id", "item", F.col("word").alias("a"), (F.col("word") + width - 1).alias("b")).distinct()
    order = Window.partitionBy("doc_id", "item").orderBy("a")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
    return parted.groupBy("doc_id", "item", "span").agg(F.min("a").alias("word_start"), F.max("b").alias("word_end")).drop("span")


def leaked_documents(spans: DataFrame) -> DataFrame:
    """``(doc_id, item)`` pairs, once each."""
    return spans.select("doc_id", "item").distinct()
