"""Maintenance of the video and item tables, as DataFrame transformations and an atomic write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.session import shared_folder


def upsert_videos(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` inserted or overwritten by id; a null ``proxy_path`` or ``stats_json`` keeps the old value.

    Of several new rows of an id the one of latest ``indexed_at`` counts.
    """
    latest = Window.partitionBy("id").orderBy(F.desc("indexed_at"))
    n = new.withColumn("place", F.row_number().over(latest)).where("place = 1").drop("place").alias("n")
    o, kept = old.alias("o"), ("proxy_path", "stats_json")
    has = F.col("n.id").isNotNull()
    columns = [F.coalesce("n.id", "o.id").alias("id")]
    for c in old.columns:
        if c == "id":
            continue
        merged = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in kept else F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        columns.append(merged.alias(c))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(*columns).select(*old.columns)


def set_column(videos: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``videos`` with ``column`` set from ``values (id, value)``; ids not in ``videos`` change nothing."""
    v = values.select("id", F.struct("value").alias("new")).dropDuplicates(["id"])
    return videos.join(v, "id", "left").withColumn(column, F.when(F.col("new").isNotNull(), F.col("new.value")).otherwise(F.col(column))).select(*videos.columns)


def clear_video(items: DataFrame, video_ids: list[str] | DataFrame) -> DataFrame:
    """``items`` without those of the videos."""
    if isinstance(video_ids, DataFrame):
        return items.join(video_ids.select(F.col(video_ids.columns[0]).alias("video_id")).distinct(), "video_id", "left_anti").select(*items.columns)
    return items.where(~F.coalesce(F.col("video_id").isin(*video_ids), F.lit(False)) if video_ids else F.lit(True))


def append_items(items: DataFrame, new: DataFrame, last_id: int) -> DataFrame:
    """``items`` and ``new`` with ids from ``last_id + 1`` on in order of video, frame and ``pos`` (frame first, crops by falling confidence).

    ``last_id`` is the highest id ever given (kept by the caller, so ids are not used again). The numbers come from counts
    per partition of a range-sorted table, not from one task that sees every row. The sorted rows are checkpointed: their
    positions are read twice and must be the same both times.
    """
    shared_folder(new.sparkSession)
    order = new.withColumn("kind_order", (F.col("kind") != "frame").cast("int")).repartitionByRange("video_id", "frame_idx").sortWithinPartitions("video_id", "frame_idx", "kind_order", F.desc("conf"))
    rows = order.withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)).withColumn("nth", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = rows.checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).select("part", "start")
    named = rows.join(starts, "part").withColumn("id", F.col("start") + F.col("nth") + 1 + last_id)
    return items.unionByName(named.select(*items.columns))


def zip_frames(frames: DataFrame) -> DataFrame:
    """Frames ``(video_id, t, frame_idx, thumb, kinds, labels, confs, boxes, vectors)`` to item rows, as many as the shortest list has."""
    lists = ("kinds", "labels", "confs", "boxes", "vectors")
    n = F.least(*(F.size(c) for c in lists))
    z = frames.select("video_id", "t", "frame_idx", "thumb", F.explode(F.slice(F.arrays_zip(*lists), F.lit(1), n)).alias("z"))
    box = F.col("z.boxes")
    return z.select("video_id", "t", "frame_idx", F.col("z.kinds").alias("kind"), F.col("z.labels").alias("label"), F.col("z.confs").alias("conf"), *(F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "thumb", F.col("z.vectors").alias("emb"))


def checked_items(items: DataFrame, dim: int) -> DataFrame:
    """Items as they are; the job fails at a row with another vector length or kind."""
    right = (F.size("emb") == dim) & F.col("kind").isin("frame", "crop")
    return items.where(F.when(F.coalesce(right, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad item "), F.coalesce(F.col("id").cast("string"), F.lit("without id"))))))


def replace_videos(items: DataFrame, path: str) -> None:
    """Write ``items`` (whole videos) into the item table partitioned by video, replacing just those videos' partitions at once."""
    items.sortWithinPartitions("video_id", "t").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)
