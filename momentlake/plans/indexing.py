"""Indexing frames: gate, detect, cut, encode, append; and the statistics of a run."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from momentlake.operators import boxes, gate, ranking
from momentlake.plans.engine import Encoder, encoded
from momentlake.sources import store

ITEM_COLUMNS = ("id", "video_id", "t", "frame_idx", "kind", "label", "conf", "x1", "y1", "x2", "y2", "thumb", "emb")


def thumb_name(frame_idx) -> F.Column:
    return F.format_string("%07d.jpg", frame_idx)


def index_frames(
    frames: DataFrame, encoder: Encoder, *, detect: Callable[[DataFrame], DataFrame] | None = None, motion: dict | None = None, max_crops: int = 12, last_id: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Items and gated frames of ``frames (video_id, t, frame_idx, signal, content)``.

    ``content`` is what the encoder takes. ``detect`` maps kept frames to boxes ``(video_id, frame_idx, pos, cls, conf, x1, y1, x2, y2, content)``;
    of these the ``max_crops`` of highest confidence per frame become crops. Skipped frames are counted but never reach detector or encoder.
    """
    gated = gate.motion_gate(frames, "video_id", "t", "signal", "frame_idx", **(motion or {}))
    kept = frames.join(gated.where("kept").select("video_id", "frame_idx"), ["video_id", "frame_idx"])
    none = lambda kind: F.lit(None).cast(kind)
    corners = ("x1", "y1", "x2", "y2")
    whole = kept.select("video_id", "t", "frame_idx", F.lit("frame").alias("kind"), none("string").alias("label"), none("double").alias("conf"), *(none("int").alias(c) for c in corners), "content")
    rows = whole
    if detect is not None:
        found = ranking.top_n_per_frame(detect(kept), max_crops, ["video_id", "frame_idx"]).join(kept.select("video_id", "frame_idx", "t"), ["video_id", "frame_idx"])
        crops = found.select("video_id", "t", "frame_idx", F.lit("crop").alias("kind"), boxes.label_of(F.col("cls")).alias("label"), "conf", *(F.col(c).cast("int").alias(c) for c in corners), "content")
        rows = whole.unionByName(crops)
    vectors = encoded(rows, "content", encoder).drop("content").withColumn("thumb", thumb_name(F.col("frame_idx"))).withColumn("id", none("long"))
    empty = vectors.where("false").select(*ITEM_COLUMNS)
    return store.append_items(empty, vectors.select(*ITEM_COLUMNS), last_id), gated


class Timings:
    """Seconds spent by stage of an indexing run; a stage's parts add up. What Spark does lazily counts where it is asked for."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start

    def rounded(self) -> dict[str, float]:
        return {k: round(v, 2) for k, v in self.seconds.items()}


class Progress(StreamingQueryListener):
    """Reports a live pipeline's progress as (fraction, message) after each micro-batch and keeps the time of its phases.

    ``expected`` frames stand for the whole; the fraction stays under 1 until the query ends.
    """

    def __init__(self, report: Callable[[float, str], None], expected: int):
        self.report, self.expected, self.seen, self.timings = report, max(expected, 1), 0, Timings()

    def onQueryStarted(self, event) -> None:
        self.report(0.0, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen += p.numInputRows
        for phase, ms in p.durationMs.items():
            self.timings.seconds[phase] = self.timings.seconds.get(phase, 0.0) + ms / 1000
        self.report(min(0.99, self.seen / self.expected), f"batch {p.batchId}: {self.seen} of about {self.expected} frames")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(1.0, "failed" if event.exception else "done")


def run_stats(items: DataFrame, gated: DataFrame, *, sample_fps: float, method: str, seconds: DataFrame | None = None, timings: Timings | None = None) -> DataFrame:
    """``(id, stats_json)`` per video; ``seconds (video_id, duration_s, index_wall_s)`` adds the rates, ``timings`` the run's seconds by stage."""
    spent = F.create_map(*(F.lit(x) for pair in timings.rounded().items() for x in pair)) if timings and timings.seconds else F.lit(None).cast("map<string,double>")
    made = items.groupBy("video_id").agg(F.count_if(F.col("kind") == "frame").alias("frames_embedded"), F.count_if(F.col("kind") == "crop").alias("crops_embedded"), F.count("*").alias("items"))
    counted = gate.gate_stats(gated, ["video_id"]).join(made, "video_id", "left")
    counted = counted.join(seconds, "video_id", "left") if seconds is not None else counted.withColumn("duration_s", F.lit(None).cast("double")).withColumn("index_wall_s", F.lit(None).cast("double"))
    rate = lambda c: F.round(F.try_divide(F.col(c), F.when(F.col("index_wall_s") != 0, F.col("index_wall_s"))), 3)
    stats = F.struct(
        "video_id", F.round("duration_s", 2).alias("duration_s"), F.lit(sample_fps).alias("sample_fps"),
        F.struct("frames_seen", "frames_kept", "frames_skipped", "kept_by_heartbeat", "skip_ratio").alias("motion"), F.lit(method).alias("motion_method"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("frames_embedded", "crops_embedded", "items")), F.round("index_wall_s", 2).alias("index_wall_s"),
        rate("frames_seen").alias("sampled_frames_per_s"), rate("duration_s").alias("realtime_factor"), spent.alias("timings_s"),
    )
    return counted.select(F.col("video_id").alias("id"), F.to_json(stats).alias("stats_json"))
