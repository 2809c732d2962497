"""Text functions."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from momentlake.functions import bpe
from momentlake.functions.numbers import exact_round

#: Fixed value: what the tokenizer splits a cleaned text into.
PIECES = r"(?i)<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def _resolved(s: pd.Series) -> pd.Series:
    referring = s.str.contains("&", regex=False, na=False)
    if referring.any():
        s = s.copy()
        s[referring] = [html.unescape(html.unescape(x)) for x in s[referring]]
    return s


def mended(text: str) -> str:
    """A text that was written in UTF-8 and read in a Western single-byte encoding, as it was meant; other texts as they are.

    It is read back as long as that gives valid UTF-8 and shortens it (at most twice).
    """
    for _ in range(2):
        try:
            again = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            break
        if len(again) >= len(text):
            break
        text = again
    return text


@F.pandas_udf(StringType())
def _mended(s: pd.Series) -> pd.Series:
    suspect = s.str.contains("[\u00c2-\u00f4]", na=False)  # what the first byte of a longer character looks like
    if suspect.any():
        s = s.copy()
        s[suspect] = [mended(x) for x in s[suspect]]
    return s


def clean(c: Column, mend: bool = False) -> Column:
    """Character references resolved twice, white space collapsed and trimmed, lower case; with ``mend``, broken encodings repaired first.

    References need the table of entities, so texts pass through Python in Arrow batches; only those with an ampersand are touched
    there. For texts known to have none, ``clean_plain`` stays on the JVM.
    """
    return F.lower(F.trim(F.regexp_replace(_resolved(_mended(c) if mend else c), r"(?U)\s+", " ")))


def clean_plain(c: Column) -> Column:
    """``clean`` for text without character references, JVM side only."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def pieces(c: Column) -> Column:
    """The word pieces of a cleaned text."""
    return F.regexp_extract_all(c, F.lit(PIECES), F.lit(0))


def fit_tokens(ids: Column, start: int, end: int, length: int = 77) -> Column:
    """``start``, the ids and ``end``, cut to ``length`` with ``end`` last, filled up with zeros."""
    body = F.concat(F.array(F.lit(start)), F.slice(ids, 1, length - 2), F.array(F.lit(end)))
    return F.slice(F.concat(body, F.array_repeat(F.lit(0), length)), 1, length)


def bpe_encoder(path: str) -> Callable[[Column], Column]:
    """Token ids of cleaned texts by the public vocabulary file at ``path`` (see ``functions.bpe``)."""
    return bpe.bpe_encoder(path, PIECES)


def yes_no(c: Column) -> Column:
    """"yes" or "no" if the first word of an answer is that, else null."""
    start = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"""^[*"' ]+""", "")
    word = F.regexp_replace(F.regexp_extract(start, r"^\s*(\S+)", 1), r"""^[.,!:;"'*]+|[.,!:;"'*]+$""", "")
    return F.when(word.isin("yes", "no"), word)


TOP_LOGPROBS = "struct<logprobs:struct<content:array<struct<top_logprobs:array<struct<token:string,logprob:double>>>>>>"


def p_yes(choice_json: Column) -> Column:
    """Share of "yes" among the first token's probabilities of yes and no; null if neither occurs or the JSON lacks them."""
    top = F.from_json(choice_json, TOP_LOGPROBS)["logprobs"]["content"]
    first = F.get(top, F.lit(0))["top_logprobs"]
    mass = lambda word: F.aggregate(F.filter(first, lambda x: F.lower(F.trim(x["token"])) == word), F.lit(0.0), lambda s, x: s + F.exp(x["logprob"]))
    yes, no = mass("yes"), mass("no")
    return F.when(yes + no > 0, yes / (yes + no))


def p_yes_or_answer(p: Column, answer: Column) -> Column:
    """``p``, or without it 1 for "yes" and 0 for "no"."""
    return F.coalesce(p, F.when(answer == "yes", 1.0).when(answer == "no", 0.0))


def timecode(seconds: Column, clamp: bool = False) -> Column:
    """Minutes and seconds as ``mm:ss.s`` (rounded after splitting, so 59.96 gives 00:60.0)."""
    s = F.greatest(seconds, F.lit(0.0)) if clamp else seconds
    minutes = F.floor(s / 60)
    return F.concat(F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), F.format_string("%04.1f", exact_round(s - minutes * 60, 1)))


def slug(c: Column) -> Column:
    """Lower case with every other run than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def report_number(c: Column) -> Column:
    """``-`` for null, two decimals from 1 up and for 0, else three."""
    return F.when(c.isNull(), "-").when((F.abs(c) >= 1) | (c == 0), F.format_string("%.2f", exact_round(c, 2))).otherwise(F.format_string("%.3f", exact_round(c, 3)))


def precision_label(file_name: Column) -> Column:
    """The compute precision a model file's name tells."""
    return F.when(file_name.contains("w8a16"), "w8a16").when(file_name.contains("w8a8") | file_name.contains("int8"), "int8").otherwise("FP32")


def hit_caption(label: Column, kind: Column, score: Column, t: Column, name: Column) -> Column:
    """One line on a hit: video, time code, score and what was seen."""
    return F.concat(name, F.lit(" @ "), timecode(t, clamp=True), F.lit(" · "), F.format_string("%.3f", score), F.lit(" · "), F.coalesce(label, kind))


def playback_start(t: Column) -> Column:
    """A second before the hit, but not before the start."""
    return F.greatest(F.lit(0.0), t - 1.0)


def token_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, piece)``: one row per word piece of the cleaned text."""
    return df.select(id_col, F.posexplode(pieces(clean(F.col(text_col)))).alias("pos", "piece"))
