"""The registered queries of the core's operators on activity sessions and orphan references, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions.keys import compared, epoch_of, epoch_seconds
from momentlake.operators import orphans, sessions


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/audit_log.parquet").distinct()
    events = log.select(compared("os_user").alias("os_user"), epoch_seconds("time").alias("second"))
    return sessions.sessions(events, "os_user", "second", 1800)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    arrived = epoch_of("ingested_at").alias("ingested_at")
    plain = lambda t, i: read(t).select(F.col(i).alias("row_id"), compared("video_id").alias("key"), arrived)
    log = read("audit_log").select(F.col("seq").alias("row_id"), F.explode("videos").alias("video_id"), arrived).select("row_id", compared("video_id").alias("key"), "ingested_at")
    videos = read("videos").select(compared("id").alias("key"), F.col("indexed_at").alias("valid_from"), F.col("removed_at").alias("valid_to"))
    return orphans.orphan_references({"items": plain("items", "id"), "hits": plain("hits", "hit_id"), "audit_log": log}, videos)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("table_name", "row_id", F.col("key").alias("video_id"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_found(spark, sf_dir))


_ORPHANS = """
    WITH refs AS (
        SELECT 'items' AS table_name, id AS row_id, video_id, ingested_at FROM items
        UNION ALL SELECT 'hits', hit_id, video_id, ingested_at FROM hits
        UNION ALL SELECT 'audit_log', seq, unnest(videos), ingested_at FROM audit_log
    ), r AS (
        SELECT DISTINCT table_name, row_id, lower(trim(video_id)) AS video_id, ingested_at FROM refs WHERE trim(video_id) <> ''
    ), v AS (SELECT lower(trim(id)) AS id, indexed_at, removed_at FROM videos
    ), missing AS (
        SELECT * FROM r WHERE NOT EXISTS (
            SELECT 1 FROM v WHERE v.id = r.video_id AND v.indexed_at <= epoch_us(r.ingested_at) / 1e6 AND (v.removed_at IS NULL OR v.removed_at > epoch_us(r.ingested_at) / 1e6)
        )
    )
"""

QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_report": p5_report}

SQL = {
    "p3_found": r"""
        WITH log AS (SELECT DISTINCT * FROM audit_log
        ), parsed AS (
            SELECT lower(trim(os_user)) AS os_user, CASE
                WHEN regexp_full_match(trim(time), '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}([.,]\d+)? ?([Zz]|[+-]\d{2}(:?\d{2})?)') THEN
                    epoch(try_strptime(substr(trim(time), 1, 10) || ' ' || substr(trim(time), 12, 8), '%Y-%m-%d %H:%M:%S'))::BIGINT
                    - CASE WHEN regexp_matches(trim(time), '[Zz]$') THEN 0 ELSE
                        (CASE WHEN regexp_extract(trim(time), '([+-])\d{2}:?(\d{2})?$', 1) = '-' THEN -1 ELSE 1 END)
                        * (regexp_extract(trim(time), '[+-](\d{2}):?(\d{2})?$', 1)::INT * 3600 + coalesce(nullif(regexp_extract(trim(time), '[+-]\d{2}:?(\d{2})?$', 1), '')::INT, 0) * 60) END
                WHEN regexp_full_match(trim(time), '\d{9,11}(\.\d+)?') THEN regexp_extract(trim(time), '^(\d+)', 1)::BIGINT END AS s
            FROM log
        ), e AS (SELECT os_user, s FROM parsed WHERE os_user <> '' AND s IS NOT NULL
        ), marked AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY os_user ORDER BY s) <= 1800 THEN 0 ELSE 1 END AS new FROM e
        ), numbered AS (SELECT *, sum(new) OVER (PARTITION BY os_user ORDER BY s ROWS UNBOUNDED PRECEDING) AS n FROM marked)
        SELECT os_user, min(s) AS start_s, max(s) AS end_s, count(*) AS n_records FROM numbered GROUP BY os_user, n
    """,
    "p5_found": _ORPHANS + "SELECT DISTINCT table_name, row_id, video_id FROM missing",
    "p5_report": _ORPHANS + "SELECT table_name, strftime(ingested_at, '%Y-%m-%d') AS day, count(DISTINCT row_id) AS n_rows, count(DISTINCT video_id) AS n_keys FROM missing GROUP BY 1, 2",
}
