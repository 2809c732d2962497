import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.__main__ import main
from momentlake.functions import pixels, udfs
from momentlake.plans import indexing, report
from momentlake.plans.engine import Engine, HashEncoder
from momentlake.sources import store

FRAMES = "video_id string, t double, frame_idx long, signal double, content string"
VIDEOS = "id string, path string, name string, fps double, duration double, width int, height int, proxy_path string, indexed_at double, stats_json string"


def frames(spark):
    rows = [("v1", i / 2, i * 5, 0.9 if i in (3, 7) else 0.0, f"empty gate {i}" if i != 7 else "red bag by the gate") for i in range(20)]
    return spark.createDataFrame(rows, FRAMES)


def detector(kept):
    return kept.select("video_id", "frame_idx", F.posexplode(F.array(F.lit(0.4), F.lit(0.8), F.lit(0.6))).alias("pos", "conf"), "content").withColumns({"cls": F.col("pos"), "x1": F.lit(1), "y1": F.lit(2), "x2": F.lit(30), "y2": F.lit(40)})


def test_index_then_search(spark):
    items, gated = indexing.index_frames(frames(spark), HashEncoder(64), detect=detector, motion={"min_fraction": 0.5, "heartbeat": 100.0}, max_crops=2, last_id=10)
    rows = items.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(11, 20)) and [r.frame_idx for r in rows if r.kind == "frame"] == [0, 15, 35]
    assert [r.conf for r in rows[1:3]] == [0.8, 0.6] and rows[1].label == "bicycle" and rows[0].label is None and rows[0].thumb == "0000000.jpg"
    stats = indexing.run_stats(items, gated, sample_fps=2.0, method="score", seconds=spark.createDataFrame([("v1", 10.0, 4.0)], "video_id string, duration_s double, index_wall_s double"))
    s = json.loads(stats.first().stats_json)
    assert s["motion"]["frames_seen"] == 20 and s["motion"]["frames_kept"] == 3 and s["items"] == 9 and s["sampled_frames_per_s"] == 5.0 and s["realtime_factor"] == 2.5
    best = Engine(items, encoder=HashEncoder(64)).search("red bag by the gate").first()
    assert best.frame_idx == 35 and round(best.score, 3) == 1.0
    videos = spark.createDataFrame([("v1", "/a", "A", 25.0, 10.0, 1, 1, None, 1.0, None)], VIDEOS)
    assert store.set_column(videos, stats.select("id", F.col("stats_json").alias("value")), "stats_json").first().stats_json


def test_timings_and_progress(spark, tmp_path):
    timings = indexing.Timings()
    for _ in range(2):
        with timings.stage("detect_s"):
            pass
    timings.seconds["embed_s"] = 1.239
    assert set(timings.seconds) == {"detect_s", "embed_s"} and timings.rounded()["embed_s"] == 1.24
    items, gated = indexing.index_frames(frames(spark), HashEncoder(16), motion={"min_fraction": 0.5})
    assert json.loads(indexing.run_stats(items, gated, sample_fps=2.0, method="score", timings=timings).first().stats_json)["timings_s"]["embed_s"] == 1.24
    seen = []
    listener = indexing.Progress(lambda share, what: seen.append((share, what)), 10)
    spark.streams.addListener(listener)
    spark.range(8).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(100):
        if seen and seen[-1][1] == "done":
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert seen[0] == (0.0, "started") and seen[-1] == (1.0, "done") and any(share == 0.8 for share, _ in seen) and "triggerExecution" in listener.timings.seconds


def test_command_line(spark, tmp_path):
    items, _ = indexing.index_frames(frames(spark), HashEncoder(512))
    items.write.parquet(str(tmp_path / "items.parquet"))
    spark.createDataFrame([("v1", "/a", "A.avi", 25.0, 75.0, 1, 1, None, 1.0, None)], VIDEOS).write.parquet(str(tmp_path / "videos.parquet"))
    data = ["--data", str(tmp_path)]
    assert main([*data, "videos"], spark) == ["A.avi (01:15.0)"]
    lines = main([*data, "search", "red bag by the gate", "--top-k", "1"], spark)
    assert len(lines) == 1 and "A.avi" in lines[0] and "00:03.5" in lines[0]
    assert json.loads(main([*data, "search", "red", "--json", "--frames-only"], spark)[0])["kind"] == "frame"
    assert [json.loads(x)["query"] for x in sorted(main([*data, "audit"], spark))] in (["red bag by the gate", "red"], ["red", "red bag by the gate"])


def test_report(spark):
    df = spark.createDataFrame([("a", 0.12345, 3), (None, 1.5, None)], "name string, x double, n int")
    assert report.markdown(df) == "| name | x | n |\n|-|-|-|\n| a | 0.123 | 3 |\n| - | 1.50 | - |"
    with pytest.raises(ValueError):
        report.markdown(spark.range(5), 3)
    facts = report.machine(spark)
    assert facts["slots"] == "4" and facts["spark"] == spark.version and all(facts.values()) and facts["processor"] in report.machine_label(facts)
    units = spark.createDataFrame([("cpu", 1500, 1 << 20), (None, 500, 1 << 19)], "compute_unit string, us long, bytes long")
    assert {tuple(r) for r in report.unit_summary(units).collect()} == {("cpu", 1, 1.5, 1.0), ("?", 1, 0.5, 0.5)}


def test_pixels():
    image = np.zeros((120, 160, 3), np.uint8)
    image[:, 80:] = 200
    assert np.allclose(pixels.resized(image, 160, 120), image) and pixels.resized(image, 80, 60).mean() == pytest.approx(100)
    assert pixels.motion_cells(image, 80).shape == (60 * 80,) and pixels.motion_cells(np.full((60, 80, 3), 90.0), 80).std() < 1e-9
    levels = pixels.motion_cells(np.random.default_rng(0).integers(0, 256, (60, 90, 3)), 40)
    assert np.array_equal(levels, np.rint(levels)) and 0 <= levels.min() and levels.max() <= 255
    out = pixels.encoder_input(image)
    assert out.shape == (3, 224, 224) and out.dtype == np.float32
    plain = (np.full(3, 0.0) - pixels.MEAN) / pixels.STD, (np.full(3, 200 / 255) - pixels.MEAN) / pixels.STD
    assert np.allclose(out[:, 0, 0], plain[0], atol=1e-5) and np.allclose(out[:, 100, 223], plain[1], atol=1e-5)  # dark to the left, light to the right
    ramp = np.repeat(np.arange(50.0)[:, None, None], 3, 2) * np.ones((1, 40, 1))  # cubic enlarging: as many rows on, one level more
    wide = pixels.resized(ramp, 80, 100)[4:-4, 0, 0]
    assert np.allclose(wide[2:] - wide[:-2], 1) and (np.diff(wide) > 0).all() and np.allclose(pixels._weights(7, 31).sum(1), 1)
    cut = pixels.square_pixels(image, 50, -10, 100)
    assert cut.shape == (50, 50, 3) and tuple(cut[0, 0]) == (124, 116, 104) and tuple(cut[0, 10]) == (0, 0, 0)


def test_sql_extensions(spark):
    udfs.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_pieces('Don&#39;t stop')").collect()] == [(0, "don"), (1, "'t"), (2, "stop")]
    assert spark.sql("SELECT centroid(v) AS c FROM VALUES (array(1D, 2D)), (array(3D, 4D)) AS t(v)").first().c == [2.0, 3.0]
