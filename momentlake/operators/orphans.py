"""References to records that do not exist (at the time), by a distributed anti join of distinct keys.

The distinct non-null keys of all referring tables (counted map-side first) are anti-joined with the parents' keys;
those left are missing altogether. The other keys carry the parents' merged periods of existence. Both verdicts are
joined back to the rows. Keys with very many rows are salted; the list of such keys is bounded (``HOT_KEYS``), the only
thing broadcast by hint.

Defined results: null and blank keys refer to nothing and are no case; a parent counts from its ``valid_from``
(a null never does) until before its ``valid_to`` (null: for good); a row without a time is a case, as no parent
exists at a time that is not known; repeated rows count once; without parents every reference is a case; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.session import shared_folder

HOT_KEYS = 1000
HOT_ROWS = 200_000


def periods(parents: DataFrame) -> DataFrame:
    """``(key, spans)``: the disjoint periods in which at least one parent row with the key exists, from ``(key, valid_from, valid_to)``."""
    forever = F.lit(float("inf"))
    p = parents.where("key is not null and valid_from is not null and not isnan(valid_from)").select("key", "valid_from", F.coalesce("valid_to", forever).alias("valid_to")).where("valid_to > valid_from").distinct()
    order = Window.partitionBy("key").orderBy("valid_from", "valid_to")
    before = F.max("valid_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("valid_from") <= F.col("before"), 0).otherwise(1)).over(order)
    merged = p.withColumn("before", before).withColumn("island", island).groupBy("key", "island").agg(F.min("valid_from").alias("s"), F.max("valid_to").alias("e"))
    return merged.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def orphan_references(children: dict[str, DataFrame], parents: DataFrame) -> DataFrame:
    """``(table_name, row_id, key, ingested_at)`` of the references without a parent at their time.

    ``children``: by table name ``(row_id, key, ingested_at)``; ``parents``: ``(key, valid_from, valid_to)``; times are epoch seconds.
    """
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), F.col("row_id").cast("long").alias("row_id"), "key", "ingested_at") for name, df in children.items()]).where("key is not null")
    shared_folder(rows.sparkSession)
    keys = rows.groupBy("key").agg(F.count("*").alias("n")).checkpoint()  # used four times
    total = keys.agg(F.sum("n")).first()[0] or 0
    known = parents.where("key is not null").select("key").distinct()
    missing = keys.join(known, "key", "left_anti").select("key", "n", F.lit(None).cast("array<struct<s:double,e:double>>").alias("spans"))
    existing = keys.join(known, "key", "left_semi").join(periods(parents), "key", "left").select("key", "n", "spans")
    verdict = missing.unionByName(existing)
    hot_rows = max(HOT_ROWS, total // HOT_KEYS)  # at most HOT_KEYS keys can have as many rows
    salts = F.when(F.col("n") > hot_rows, F.ceil(F.col("n") / hot_rows).cast("int")).otherwise(1)
    hot = keys.where(F.col("n") > hot_rows).select("key", salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    alive = F.exists("spans", lambda s: (s["s"] <= F.col("ingested_at")) & (s["e"] > F.col("ingested_at")))
    found = salted.join(spread, ["key", "salt"]).where(~F.coalesce(alive, F.lit(False)))
    return found.select("table_name", "row_id", "key", "ingested_at").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """``(table_name, day, n_rows, n_keys)``: orphan references per table and day of arrival (written yyyy-MM-dd)."""
    day = F.date_format(F.timestamp_seconds("ingested_at"), "yyyy-MM-dd")
    return found.groupBy("table_name", day.alias("day")).agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("key").alias("n_keys"))
