"""Retrieval metrics, latency and cost roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def in_truth(stamps: DataFrame, truth: DataFrame, tolerance: float, how: str = "left_semi", keys: tuple[str, ...] = (), bucket: float = 60.0) -> DataFrame:
    """Stamps ``(keys..., video_name, t)`` that fall into a range ``(keys..., video_name, start, end)`` widened by ``tolerance`` (or with ``left_anti`` those that don't).

    Ranges are spread over time buckets, so the join is an equi-join on name and bucket with a residual range test.
    """
    on = [*keys, "video_name"]
    low, high = F.col("start") - tolerance, F.col("end") + tolerance
    spread = truth.where(low <= high).select(*on, low.alias("lo"), high.alias("hi"), F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))).alias("bucket"))
    s = stamps.withColumn("bucket", F.floor(F.col("t") / bucket)).alias("s")
    g = spread.alias("g")
    match = [F.col(f"s.{c}") == F.col(f"g.{c}") for c in [*on, "bucket"]] + [F.col("s.t") >= F.col("g.lo"), F.col("s.t") <= F.col("g.hi")]
    condition = match[0]
    for m in match[1:]:
        condition &= m
    return s.join(g, condition, how).select("s.*").drop("bucket")


def first_correct_rank(queries: DataFrame, hits: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """``queries`` (``query_id``) with ``first_rank``: the rank of the first hit inside the query's truth, null if none."""
    right = in_truth(hits, truth, tolerance, keys=("query_id",)).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.join(right, "query_id", "left")


def rank_summary(rank: str = "first_rank", ks: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    """Aggregates: recall at each k, median rank ("inf" if it is infinite), mean reciprocal rank, misses and number; null over no rows."""
    value = F.coalesce(F.col(rank).cast("double"), F.lit(INF))
    median = F.median(value)
    return [
        *(F.round(F.avg((value <= k).cast("double")), 4).alias(f"recall_at_{k}") for k in ks),
        F.when(median == INF, F.lit("inf")).otherwise(median.cast("string")).alias("median_rank"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0))), 4).alias("mrr"),
        F.count_if(F.col(rank).isNull()).alias("not_found"),
        F.count("*").alias("n"),
    ]


def summary_by(ranks: DataFrame, category: str) -> DataFrame:
    """``rank_summary`` over all and per category."""
    rolled = ranks.rollup(category).agg(*rank_summary(), F.grouping(category).alias("g"))
    return rolled.withColumn(category, F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(category))).drop("g")


def coverage(queries: DataFrame, stamps: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """``(query_id, coverage)``: share of the different stamps (name, millisecond) inside the query's truth; 0 without stamps.

    Only the inside stamps are joined to queries, so the work follows the truth's length, not queries times stamps.
    """
    distinct = stamps.select("video_name", F.round("t", 3).alias("t")).distinct()
    total = distinct.agg(F.count("*").alias("total"))
    low, high = F.col("start") - tolerance, F.col("end") + tolerance
    spread = truth.where(low <= high).select("query_id", "video_name", low.alias("lo"), high.alias("hi"), F.explode(F.sequence(F.floor(low / 60.0), F.floor(high / 60.0))).alias("bucket"))
    inside = distinct.withColumn("bucket", F.floor(F.col("t") / 60.0)).join(spread, ["video_name", "bucket"]).where("t between lo and hi").select("query_id", "video_name", "t").distinct().groupBy("query_id").agg(F.count("*").alias("k"))
    return queries.select("query_id").join(inside, "query_id", "left").join(F.broadcast(total)).select("query_id", F.coalesce(F.try_divide(F.coalesce("k", F.lit(0)), "total"), F.lit(0.0)).alias("coverage"))


def latency(ms: str) -> list[Column]:
    """Aggregates: runs, mean and exact 95th percentile (linear between neighbours)."""
    return [F.count(ms).alias("runs"), F.round(F.avg(ms), 2).alias("mean_ms"), F.round(F.percentile(ms, 0.95), 2).alias("p95_ms")]


def index_cost(runs: DataFrame, by: str, name: str) -> DataFrame:
    """Per configuration: summed wall time, frames, crops and duration, frames per second, times real time, and the joined names."""
    total = lambda c: F.sum(c)
    return runs.groupBy(by).agg(
        F.round(total("wall_s"), 2).alias("wall_s"), total("seen").alias("seen"), total("kept").alias("kept"), total("crops").alias("crops"), F.round(total("duration_s"), 2).alias("duration_s"),
        F.round(F.try_divide(total("seen"), total("wall_s")), 4).alias("frames_per_s"), F.round(F.try_divide(total("duration_s"), total("wall_s")), 4).alias("realtime_factor"),
        F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"),
    )


def counts_by(events: DataFrame, column: Column, name: str, missing: str) -> DataFrame:
    """Number of rows by a value, nulls under ``missing``."""
    return events.groupBy(F.coalesce(column, F.lit(missing)).alias(name)).agg(F.count("*").alias("n"))


def kernel_events(events: DataFrame) -> DataFrame:
    """Profile events that are the run of a node's kernel."""
    return events.where((F.col("cat") == "Node") & F.col("name").endswith("_kernel_time"))


def compare_configs(ranks: DataFrame, config: str, a: str, b: str) -> DataFrame:
    """Per query its rank under configuration ``a`` beside that under ``b`` (null if missing there)."""
    left = ranks.where(F.col(config) == a).select("query_id", F.col("first_rank").alias("rank_a"))
    right = ranks.where(F.col(config) == b).select("query_id", F.col("first_rank").alias("rank_b"))
    return left.join(right, "query_id", "left")


def remap_truth(truth: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ranges with their video renamed and shifted by ``mapping (video_name, new_name, offset)``; others pass."""
    joined = truth.join(mapping, "video_name", "left")
    shift = F.coalesce("offset", F.lit(0.0))
    return joined.select(*[c for c in truth.columns if c not in ("video_name", "start", "end")], F.coalesce("new_name", "video_name").alias("video_name"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
