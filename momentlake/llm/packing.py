"""Filling fixed-capacity containers: large-item matching on the size histogram.

Sizes are whole numbers up to the capacity, so the number of items per size is a table of at most ``capacity`` rows
whatever the data's volume; only it reaches the driver. The plan: items above a third of the capacity are matched
greedily, at most two to a container, the largest with the largest that still fits; smaller items, in falling order
of size, go to the container with the least gap that takes them, and open new containers only when none does.
The plan speaks of ranges ("items 100-199 of size 812 go to containers 5000-5099"); every task looks its items up.
An item above the capacity is cut into full pieces, a container each, and a rest that is packed like the others.

Defined results: null texts and rows without an id take no part; an empty text has size 1 (the end token); ids must
be unique; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.session import shared_folder

PIECE_SCHEMA = "doc_id long, piece int, token_start long, tokens int, container_id long"


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges ``(size, first_rank, first_container, per_container)`` for ``counts`` items by size, and the number of containers."""
    left = {s: c for s, c in counts.items() if c > 0}
    given = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    used = 0

    def place(size: int, first: int, n: int, per: int = 1) -> None:
        out.append((size, given[size], first, per))
        given[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]

    def opened(gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        fit = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside it
        if fit < 0:
            n, b = left[a], 0
        else:
            b = large[fit]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:  # one left of a size that would pair with itself
                n, b = left[a], large[fit - 1] if fit > 0 else 0
                n = min(n, left[b]) if b else n
        first, used = used, used + n
        place(a, first, n)
        if b:
            place(b, first, n)
        opened(capacity - a - b, first, n)
        large = [s for s in large if s in left]
    for s in sorted(left, reverse=True):
        while s in left:
            at = bisect_left(order, s)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                take = min(n, left[s])
                if take < n:
                    gaps[gap].append((first + take, n - take))
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                place(s, first, take)
                opened(gap - s, first, take)
                continue
            per = capacity // s
            full = left[s] // per
            if full:
                place(s, used, full * per, per)
                opened(capacity - s * per, used, full)
                used += full
            elif s in left:
                n = left[s]
                place(s, used, n, n)
                opened(capacity - s * n, used, 1)
                used += 1
    return out, used


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 4096, *, salt_rows: int = 100_000) -> DataFrame:
    """``(doc_id, piece, token_start, tokens, container_id)`` of every text or piece; sizes are UTF-8 bytes plus one end token."""
    spark = df.sparkSession
    shared_folder(spark)
    sizes = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text_col) + 1).cast("long").alias("n")).checkpoint()  # texts are read once, for their length
    rest = F.pmod(F.col("n"), F.lit(capacity)).cast("int")
    whole = F.floor(F.col("n") / capacity).cast("int")
    salts = int(max(1, -(-sizes.count() // salt_rows)))
    small = sizes.where(rest > 0).select("doc_id", whole.alias("piece"), (whole.cast("long") * capacity).alias("token_start"), rest.alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    full = sizes.where(whole > 0).select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("token_start"), F.lit(capacity).alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    # items of one size are numbered inside (size, salt), and each (size, salt) starts where the one before ends
    pieces = small.unionByName(full)
    groups = pieces.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    histogram = {r.tokens: r.n for r in groups.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranges, _ = plan(histogram, capacity)
    ranges.sort()
    shared = spark.sparkContext.broadcast(tuple(np.array([r[i] for r in ranges], np.int64) for i in range(4)))
    numbered = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = numbered.join(starts, ["tokens", "salt"]).select("doc_id", "piece", "token_start", "tokens", (F.col("rank") + F.col("start")).alias("rank"))

    def look_up(batches):
        size, first, container, per = shared.value
        keys = (size << 44) + first
        for b in batches:
            tokens, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            at = np.searchsorted(keys, (tokens << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(container[at] + (rank - first[at]) // per[at])], ["doc_id", "piece", "token_start", "tokens", "container_id"])

    return ranked.mapInArrow(look_up, PIECE_SCHEMA)
