"""Table layouts of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

VIDEOS = T.StructType(
    [T.StructField(n, k, not req) for n, k, req in [
        ("id", T.StringType(), True), ("path", T.StringType(), True), ("name", T.StringType(), True),
        ("fps", T.DoubleType(), False), ("duration", T.DoubleType(), False), ("width", T.IntegerType(), False), ("height", T.IntegerType(), False),
        ("proxy_path", T.StringType(), False), ("indexed_at", T.DoubleType(), False), ("stats_json", T.StringType(), False),
    ]]
)

ITEMS = T.StructType(
    [T.StructField(n, k, not req) for n, k, req in [
        ("id", T.LongType(), True), ("video_id", T.StringType(), True), ("t", T.DoubleType(), True), ("frame_idx", T.IntegerType(), True),
        ("kind", T.StringType(), True), ("label", T.StringType(), False), ("conf", T.DoubleType(), False),
        ("x1", T.IntegerType(), False), ("y1", T.IntegerType(), False), ("x2", T.IntegerType(), False), ("y2", T.IntegerType(), False),
        ("thumb", T.StringType(), False), ("emb", T.ArrayType(T.FloatType()), True),
    ]]
)

AUDIT = "time string, os_user string, query string, videos array<string>, n_results int, verify boolean, extra map<string,string>"

#: The statistics record kept as JSON with a video.
STATS = (
    "video_id string, video string, duration_s double, sample_fps double, use_crops boolean, "
    "motion struct<frames_seen:long,frames_kept:long,frames_skipped:long,kept_by_heartbeat:long,skip_ratio:double>, motion_method string, "
    "frames_embedded long, crops_embedded long, items long, index_wall_s double, sampled_frames_per_s double, realtime_factor double, "
    "timings_s struct<decode_gate_s:double,detect_s:double,embed_s:double,write_s:double>, providers map<string,string>"
)

KINDS = ("frame", "crop")

# The classes the detector reports by name.
CLASS_NAMES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck", 24: "backpack", 25: "umbrella", 26: "handbag", 28: "suitcase"}
