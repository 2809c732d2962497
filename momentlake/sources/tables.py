"""Reading the engine's tables and files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake import schema
from momentlake.functions import text

# File endings taken for video.
VIDEO_SUFFIXES = (".3gp", ".avi", ".flv", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".webm", ".wmv")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def video_listing(videos: DataFrame) -> DataFrame:
    """Videos, newest first, with their statistics parsed (null where they cannot be)."""
    return videos.withColumn("stats", F.from_json("stats_json", schema.STATS)).drop("stats_json").orderBy(F.desc("indexed_at"), "id")


def video(videos: DataFrame, video_id: str | DataFrame) -> DataFrame:
    """The video with the id, or those with the ids of a one-column table; no row where there is none."""
    if isinstance(video_id, DataFrame):
        return video_listing(videos.join(video_id.select(F.col(video_id.columns[0]).alias("id")), "id", "left_semi"))
    return video_listing(videos.where(F.col("id") == video_id)).limit(1)


def video_choices(videos: DataFrame) -> DataFrame:
    """``(choice, id)`` for a picker: name and duration."""
    listed = video_listing(videos)
    return listed.select(F.concat("name", F.lit(" ("), text.timecode(F.coalesce("duration", F.lit(0.0)), clamp=True), F.lit(")")).alias("choice"), "id")


def library_summary(videos: DataFrame) -> DataFrame:
    """One row per video for an overview, ``?`` where a figure is missing."""
    listed = video_listing(videos)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return listed.select(
        "name", "id", text.timecode(F.coalesce("duration", F.lit(0.0)), clamp=True).alias("duration"),
        shown(F.col("stats.motion.frames_seen")).alias("frames_seen"), shown(F.col("stats.motion.frames_kept")).alias("frames_kept"),
        shown(F.col("stats.crops_embedded")).alias("crops"), shown(F.col("stats.items")).alias("items"), shown(F.col("stats.index_wall_s")).alias("index_wall_s"),
    )


def metadata(items: DataFrame) -> DataFrame:
    """Items without their vectors; the scan reads no vector column."""
    return items.select("id", "video_id", "t", "kind")


def embeddings(items: DataFrame, video_id: str | None = None, kind: str | None = None) -> DataFrame:
    """``(id, emb)`` in order of id, optionally of one video and kind; both filters reach the scan."""
    if video_id is not None:
        items = items.where(F.col("video_id") == video_id)
    if kind is not None:
        items = items.where(F.col("kind") == kind)
    return items.select("id", "emb").orderBy("id")


def item_count(items: DataFrame, video_id: str | None = None) -> DataFrame:
    """``n``: number of items, of one video or (None or empty) of all."""
    return (items.where(F.col("video_id") == video_id) if video_id else items).agg(F.count("*").alias("n"))


def frame_at(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames at the wanted ``(video_id, frame_idx)``."""
    return frames.join(wanted.select("video_id", "frame_idx").distinct(), ["video_id", "frame_idx"])


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, size)`` of the video files under a folder, at any depth, by path; contents are not read."""
    pattern = r"(?i)\.(" + "|".join(s[1:] for s in VIDEO_SUFFIXES) + r")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")).where(F.col("path").rlike(pattern)).orderBy("path")


def file_ids(files: DataFrame) -> DataFrame:
    """``(path, video_id)`` of binary files: the first 12 hex digits of SHA-1 over name, size and first mebibyte."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", video_id(name, F.col("length"), F.col("content")).alias("video_id"))


def video_id(name: Column, size: Column, content: Column) -> Column:
    whole = F.concat(name.cast("binary"), size.cast("string").cast("binary"), F.substring(content, 1, 1 << 20))
    return F.substring(F.sha1(whole), 1, 12)


def probe(raw: DataFrame) -> DataFrame:
    """Video facts ``(fps, frame_count)`` made safe: 25 frames per second if unknown, ``duration`` 0 if it cannot be told."""
    fps = F.when(F.coalesce(F.col("fps"), F.lit(0.0)) > 0, F.col("fps")).otherwise(25.0)
    return raw.withColumn("fps", fps).withColumn("duration", F.coalesce(F.try_divide(F.col("frame_count"), F.col("fps")), F.lit(0.0)))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, category, query, video_name, start, end)`` from a query file (one JSON document with ``queries``)."""
    shape = "queries array<struct<id:string,category:string,query:string,gt:array<struct<video:string,start:double,end:double>>,evidence:array<double>,evidence_note:string>>"
    doc = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("queries").alias("q"))
    return explode_truth(doc.select("q.*"))


def explode_truth(queries: DataFrame) -> DataFrame:
    g = queries.select(F.col("id").alias("query_id"), "category", "query", F.explode("gt").alias("g"))
    return g.select("query_id", "category", "query", F.col("g.video").alias("video_name"), F.col("g.start").alias("start"), F.col("g.end").alias("end"))


def profile_events(spark: SparkSession, path: str) -> DataFrame:
    """Profile events ``(cat, name, provider)`` from a JSON array."""
    return spark.read.schema("cat string, name string, args struct<provider:string>").json(path, multiLine=True).select("cat", "name", "args.provider")


def verified(files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``(name, ok)``: whether a binary file's SHA-256 is the expected one."""
    want = F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), F.lit(v))))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), (F.sha2("content", 256) == F.element_at(want, name)).alias("ok"))


def exists(path: str) -> bool:
    return os.path.exists(path)
