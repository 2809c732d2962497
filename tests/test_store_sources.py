import os
import json

import pytest

from momentlake.sources import audit, config, store, tables

VIDEOS = "id string, path string, name string, fps double, duration double, width int, height int, proxy_path string, indexed_at double, stats_json string"
ITEMS = "id long, video_id string, t double, frame_idx int, kind string, label string, conf double"


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([("a", "/a", "A", 25.0, 1.0, 1, 1, "p", 1.0, "{}"), ("b", "/b", "B", 25.0, 1.0, 1, 1, None, 1.0, None)], VIDEOS)
    new = spark.createDataFrame([("a", "/a2", "A2", 30.0, None, 2, 2, None, 2.0, None), ("a", "/a1", "A1", 30.0, 3.0, 2, 2, "x", 1.5, "x"), ("c", "/c", "C", 30.0, 3.0, 2, 2, "q", 2.0, "s")], VIDEOS)
    out = {r.id: r for r in store.upsert_videos(old, new).collect()}
    assert sorted(out) == ["a", "b", "c"] and out["a"].path == "/a2" and out["a"].proxy_path == "p" and out["a"].stats_json == "{}" and out["a"].duration is None
    assert out["b"].path == "/b" and out["c"].proxy_path == "q"


def test_set_clear_append(spark):
    v = spark.createDataFrame([("a", None), ("b", "x")], "id string, proxy_path string")
    out = {r.id: r.proxy_path for r in store.set_column(v, spark.createDataFrame([("a", "new"), ("zz", "no")], "id string, value string"), "proxy_path").collect()}
    assert out == {"a": "new", "b": "x"}
    items = spark.createDataFrame([(1, "a", 0.0, 0, "frame", None, None), (2, "b", 0.0, 0, "frame", None, None), (3, None, 0.0, 0, "frame", None, None)], ITEMS)
    assert [r.id for r in store.clear_video(items, ["a"]).orderBy("id").collect()] == [2, 3] and store.clear_video(items, []).count() == 3
    new = spark.createDataFrame([(None, "n", 0.0, 0, "crop", "car", 0.5), (None, "n", 0.0, 0, "crop", "bus", 0.9), (None, "n", 0.0, 0, "frame", None, None), (None, "n", 0.5, 1, "frame", None, None)], ITEMS)
    got = [(r.id, r.kind, r.label) for r in store.append_items(items, new, 3).where("video_id = 'n'").orderBy("id").collect()]
    assert got == [(4, "frame", None), (5, "crop", "bus"), (6, "crop", "car"), (7, "frame", None)]


def test_zip_truncates_to_the_shortest(spark):
    row = [("v", 0.0, 0, "x.jpg", ["frame", "crop", "crop"], [None, "car"], [None, 0.5, 0.4], [None, [1, 2, 3, 4], [5, 6, 7, 8]], [[0.0], [1.0], [2.0]])]
    df = spark.createDataFrame(row, "video_id string, t double, frame_idx int, thumb string, kinds array<string>, labels array<string>, confs array<double>, boxes array<array<int>>, vectors array<array<float>>")
    out = store.zip_frames(df).collect()
    assert len(out) == 2 and out[1].x2 == 3 and out[0].x1 is None


def test_wrong_dimension_fails(spark):
    ok = spark.createDataFrame([(1, "frame", [1.0, 2.0])], "id long, kind string, emb array<float>")
    assert store.checked_items(ok, 2).count() == 1
    with pytest.raises(Exception, match="bad item 1"):
        store.checked_items(ok, 3).collect()


def test_replace_writes_only_its_videos(spark, tmp_path):
    path = str(tmp_path / "items")
    store.replace_videos(spark.createDataFrame([(1, "a", 0.0), (2, "b", 0.0)], "id long, video_id string, t double"), path)
    store.replace_videos(spark.createDataFrame([(3, "a", 0.0)], "id long, video_id string, t double"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3]


def test_audit_round_trip(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(3):
        audit.write_audit(audit.audit_record(spark, time=f"2017-01-0{i + 1}T00:00:00+00:00", os_user="me", query=f"q{i}", videos=["a"], n_results=i, verify=False, extra={"host": "h"} if i else None).coalesce(1), path)
    raw = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sum("host" in r for r in raw) == 2
    log = audit.read_audit(spark, path)
    assert [r.query for r in log.collect()] == ["q0", "q1", "q2"] and log.where("n_results = 2").first().videos == ["a"]
    assert audit.read_audit(spark, str(tmp_path / "none")).count() == 0
    assert {r["n_results"] for r in raw} == {0, 1, 2}
    audit.write_audit(audit.audit_record(spark, time="t", os_user="me", query="old", videos=[], n_results=0, verify=True, extra={"query": "new"}), str(tmp_path / "over"))
    assert json.loads(spark.read.text(str(tmp_path / "over")).first().value)["query"] == "new"
    uneven = str(tmp_path / "uneven")  # the largest append in the middle, in several files
    for first, n, files in ((0, 3, 1), (3, 400, 3), (403, 1, 1)):
        rows = spark.range(first, first + n, 1, files).selectExpr("'t' AS time", "'me' AS os_user", "concat('q', id) AS query", "array('v') AS videos", "CAST(id AS int) AS n_results", "false AS verify")
        audit.write_audit(rows, uneven)
    assert [r.n_results for r in audit.read_audit(spark, uneven).collect()] == list(range(404))
    assert [r.n_results for r in audit.read_audit(spark, uneven, 1).collect()] == [403] and [r.n_results for r in audit.read_audit(spark, uneven, 150).collect()] == list(range(254, 404))
    one = tmp_path / "one.jsonl"
    one.write_text('{"query": "x"}\n\n{"query": "y"}\n')
    assert [r.query for r in audit.read_audit(spark, str(one), 1).collect()] == ["y"] and [r.query for r in audit.read_audit(spark, str(one), 2).collect()] == ["y"]
    assert audit.read_audit(spark, str(one), 0).count() == 2


def test_config(tmp_path, monkeypatch):
    base = {"a": {"x": 1, "y": 2}, "b": 3}
    assert config.merged(base, {"a": {"y": 5}, "c": 1}) == {"a": {"x": 1, "y": 5}, "b": 3, "c": 1} and base["a"]["y"] == 2
    f = tmp_path / "c.toml"
    f.write_text("[search]\ntop_k = 7\n")
    assert config.load_config(str(f))["search"] == {"top_k": 7, "merge_seconds": 3.0, "use_crops": True}
    monkeypatch.setenv("MOMENTLAKE_CONFIG", str(f))
    assert config.load_config(overlays=({"search": {"top_k": 9}},))["search"]["top_k"] == 9
    assert config.choose_providers(["Q", config.CPU], [config.CPU]) == ([config.CPU], ["Q"])
    assert config.choose_providers(["Q"], [config.CPU])[0] == [config.CPU]
    assert config.choose_providers(["Q"], ["Q"], override=" CPUExecutionProvider ")[1] == [config.CPU]
    with pytest.raises(RuntimeError):
        config.choose_providers([config.CPU], [config.CPU], strict=True)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.MP4").write_bytes(b"abc")
    (tmp_path / "a.avi").write_bytes(b"x" * 10)
    (tmp_path / "note.txt").write_bytes(b"no")
    assert [r.name for r in tables.discover(spark, str(tmp_path)).collect()] == ["a.avi", "b.MP4"]
    import hashlib

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).where("path like '%.avi'")
    assert tables.file_ids(files).first().video_id == hashlib.sha1(b"a.avi" + b"10" + b"x" * 10).hexdigest()[:12]
    assert tables.verified(files, {"a.avi": hashlib.sha256(b"x" * 10).hexdigest()}).first().ok
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"tolerance": 0.25, "queries": [{"id": "q1", "category": "event", "query": "x", "gt": [{"video": "a", "start": 1, "end": 2}, {"video": "b", "start": 1, "end": 2}]}]}))
    assert tables.ground_truth(spark, str(q)).count() == 2
    e = tmp_path / "p.json"
    e.write_text(json.dumps([{"cat": "Node", "name": "x_kernel_time", "args": {"provider": "C"}}, {"cat": "Node", "name": "x_kernel_time", "args": {}}]))
    assert tables.profile_events(spark, str(e)).count() == 2


def test_probe_is_safe(spark):
    raw = spark.createDataFrame([("a", 0.0, 50), ("b", 10.0, None)], "id string, fps double, frame_count int")
    out = {r.id: (r.fps, r.duration) for r in tables.probe(raw).collect()}
    assert out == {"a": (25.0, 2.0), "b": (10.0, 0.0)}
    assert tables.item_count(spark.createDataFrame([("a",), ("b",)], "video_id string"), "").first().n == 2


def test_whole_export_has_every_row(spark):
    from momentlake.plans import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the driver's tables")
    assert queries.QUERIES["embedding_export_all"](spark, d).count() == spark.read.parquet(f"{d}/embeddings.parquet").count()
