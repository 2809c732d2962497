"""The audit log: JSON lines."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake import schema


APPENDED = "appended"


def write_audit(records: DataFrame, path: str) -> None:
    """Append records; the entries of ``extra`` become keys of their own and win over the standard ones.

    Every append goes to a folder of its own, named by the time of the append, so that the order of appends is kept
    whatever the sizes of their files.
    """
    stamped = lambda df: df.withColumn(APPENDED, F.lit(time.time_ns())).write.mode("append").partitionBy(APPENDED)
    if "extra" not in records.columns:
        stamped(records).json(path)
        return
    extra = F.coalesce("extra", F.expr("map()").cast("map<string,string>"))
    inner = lambda c: F.regexp_replace(F.to_json(c), r"^\{|\}$", "")
    own = [F.when(~F.array_contains(F.map_keys(extra), F.lit(c)), inner(F.struct(c))) for c in records.columns if c != "extra"]
    filled = F.filter(F.array(*own, inner(extra)), lambda x: x.isNotNull() & (x != ""))
    stamped(records.select(F.concat(F.lit("{"), F.array_join(filled, ","), F.lit("}")).alias("value"))).text(path)


def read_audit(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Records with ``line`` rising in the order of writing; of the ``last`` physical lines only (None or 0: all), blank ones dropped. A missing file gives no rows.

    Lines are in order of append (files not written by ``write_audit``: of their modification), file name and place in the
    file. The last lines are found without sorting the log.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "line long, time string, os_user string, query string, videos array<string>, n_results int, verify boolean")
    raw = spark.read.text(path)
    appended = F.col(APPENDED).cast("long") if APPENDED in raw.columns else F.unix_micros("_metadata.file_modification_time")
    place = F.struct(appended, "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
    raw = raw.select("value", place.alias("place"))
    raw = raw.orderBy(F.desc("place")).limit(last).orderBy("place") if last else raw.orderBy("place")
    shape = "time string, os_user string, query string, videos array<string>, n_results int, verify boolean"
    return raw.select("value", F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "").select("line", F.from_json("value", shape).alias("r")).select("line", "r.*")


def audit_tail(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` records by ``seq`` for a table: lists joined, yes or no for the flag."""
    newest = log.orderBy(F.desc("seq")).limit(n)
    return newest.select("seq", "time", "os_user", "query", F.array_join(F.coalesce("videos", F.expr("array()").cast("array<string>")), ", ").alias("videos"), "n_results", F.when(F.col("verify"), "yes").otherwise("no").alias("verify"))


def audit_record(spark: SparkSession, *, time: str, os_user: str, query: str, videos: list[str], n_results: int, verify: bool, extra: dict | None = None) -> DataFrame:
    row = [(time, os_user, query, videos, n_results, verify, {k: str(v) for k, v in (extra or {}).items()})]
    return spark.createDataFrame(row, schema.AUDIT)
