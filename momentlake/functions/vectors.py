"""Vector expressions (JVM side) and the matrix path for scoring many rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column, floor: float = 1e-12) -> Column:
    """The vector divided by its length, which counts as at least ``floor``."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Cosine similarity; ``eps`` is added to the product of the lengths. Null for a zero vector when ``eps`` is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b) + F.lit(float(eps)))


def score(df: DataFrame, vec_col: str, queries: np.ndarray, *, metric: str = "dot", out: str = "score", digits: int | None = 6) -> DataFrame:
    """``df`` without its vector but with ``out``: the score of each row for each of the query vectors (``array<double>``).

    ``metric="dot"`` normalises the queries only (stored rows are taken as unit vectors), ``"cosine"`` both sides. Rows whose
    vector is null, has another length than the queries or an element that is null or not finite get null; a vector of zeros
    scores 0. One matrix product per Arrow batch.
    """
    q = np.atleast_2d(np.asarray(queries, np.float64))
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    dim = q.shape[1]
    names = [c for c in df.columns if c != vec_col]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{out}` array<double>"

    def run(batches):
        for b in batches:
            v = b.column(b.schema.get_field_index(vec_col))
            lengths = np.diff(v.offsets.to_numpy())
            fits = np.nonzero((lengths == dim) & v.is_valid().to_numpy(zero_copy_only=False))[0]
            m = v.values.to_numpy(zero_copy_only=False)[v.offsets.to_numpy()[fits][:, None] + np.arange(dim)].astype(np.float64) if len(fits) else np.zeros((0, dim))
            finite = np.isfinite(m).all(1)
            if not finite.all():
                fits, m = fits[finite], m[finite]
            if metric == "cosine":
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            s = m @ q.T
            s = np.round(s, digits) + 0.0 if digits is not None else s
            slot = np.zeros(b.num_rows, np.int64)
            slot[fits] = len(q)
            offsets = np.concatenate([[0], np.cumsum(slot)]).astype(np.int32)
            scores = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.ravel()), mask=pa.array(slot == 0) if len(slot) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), scores], [*names, out])

    return df.mapInArrow(run, schema)


def batch_top_k(items: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_col: str, query_vec: str, k: int, *, dim: int, digits: int = 6, item_rows: int = 16384, query_rows: int = 2048) -> DataFrame:
    """``(query, <id_col>, score, place)``: for every row of ``queries`` its ``k`` best rows of ``items``, ties to the smaller id.

    Scores as in ``score`` with ``metric="dot"``. Both sides are dealt into blocks of about ``item_rows`` and ``query_rows`` rows;
    a task compares one block with one block and passes on ``k`` rows a query. No vector reaches the driver. Rows without an id
    or with a vector that is null, of another length than ``dim`` or with null elements take no part.
    """
    ni, nq = -(-max(items.count(), 1) // item_rows), -(-max(queries.count(), 1) // query_rows)
    i = items.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("i").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    q = queries.select(F.col(query_col).cast("long").alias("q"), F.col(query_vec).cast("array<double>").alias("w")).where(F.col("q").isNotNull() & (F.size("w") == dim) & ~F.exists("w", lambda x: x.isNull()))
    i = i.select(F.pmod(F.xxhash64("i"), F.lit(ni)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("b"), "i", "v")
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(ni - 1)).cast("array<long>")).alias("a"), F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int").alias("b"), "q", "w")

    def matrix(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            ids, m = left.column("i").to_numpy(), matrix(left.column("v"))
            qs, w = right.column("q").to_numpy(), matrix(right.column("w"))
            w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
            last = min(k, len(ids)) - 1
            for at in range(0, len(qs), 256):
                s = np.round(w[at : at + 256] @ m.T, digits) + 0.0
                x, y = np.nonzero(s >= -np.partition(-s, last, axis=1)[:, last : last + 1])  # with all ties of the k-th
                order = np.lexsort((ids[y], -s[x, y], x))
                x, y = x[order], y[order]
                keep = np.arange(len(x)) - np.searchsorted(x, x) < k
                x, y = x[keep], y[keep]
                out_q.append(qs[at + x]), out_i.append(ids[y]), out_s.append(s[x, y])
        return pa.table({"query": np.concatenate(out_q), "i": np.concatenate(out_i), "score": np.concatenate(out_s)})

    found = i.groupBy("a", "b").cogroup(q.groupBy("a", "b")).applyInArrow(best, "query long, i long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("i")))
    return found.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("i", id_col)
