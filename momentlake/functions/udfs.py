"""Extension points for SQL: a table function that tokenises, an aggregate that averages vectors."""

from __future__ import annotations

import html

import numpy as np
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from momentlake.functions.text import PIECES

_PIECES = regex.compile(PIECES)


@F.udtf(returnType="pos int, piece string")
class WordPieces:
    """The word pieces of a text, one row each."""

    def eval(self, text: str):
        cleaned = " ".join(html.unescape(html.unescape(text or "")).split()).lower()
        for i, piece in enumerate(_PIECES.findall(cleaned)):
            yield i, piece


@F.pandas_udf(ArrayType(DoubleType()), F.PandasUDFType.GROUPED_AGG)
def centroid(vectors):
    """The mean of a group's vectors; null without any."""
    known = [v for v in vectors if v is not None]
    return np.mean(np.stack(known), axis=0).tolist() if known else None


def register(spark: SparkSession) -> None:
    """Make both available as ``word_pieces(text)`` and ``centroid(vector)``."""
    spark.udtf.register("word_pieces", WordPieces)
    spark.udf.register("centroid", centroid)
