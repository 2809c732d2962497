import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from momentlake.functions.keys import compared, epoch_seconds
from momentlake.operators import components, orphans, sessions


def by_hand(rows, gap):
    out, by = [], {}
    for k, s in rows:
        if k is not None and s is not None:
            by.setdefault(k, []).append(s)
    for k, v in by.items():
        v.sort()
        start, last, n = v[0], v[0], 0
        for s in v:
            if s - last > gap:
                out.append((k, start, last, n))
                start, n = s, 0
            last, n = s, n + 1
        out.append((k, start, last, n))
    return sorted(out)


@pytest.mark.parametrize("slice_seconds", [300, 5000, 86400])
def test_sessions_equal_the_rule(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    rows = [(rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, *range(-3000, 20000, 7)])) for _ in range(1500)] + [("edge", 0), ("edge", 100), ("edge", 201), ("edge", 201)]
    df = spark.createDataFrame(rows, "os_user string, second long").withColumn("start_s", F.lit("clash"))
    assert sorted(map(tuple, sessions.sessions(df, "os_user", "second", 100, slice_seconds=slice_seconds).collect())) == by_hand(rows, 100)


def test_sessions_of_nothing(spark):
    df = spark.createDataFrame([], "os_user string, second long")
    assert sessions.sessions(df, "os_user", "second").count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 400))), st.integers(0, 30))
def test_timers(events, gap):
    out, timers = [], sessions.SessionTimers(gap)
    for k, s in sorted(events, key=lambda e: e[1]):
        out += timers.expire(s)
        if (done := timers.event(k, s, s, 1)) is not None:
            out.append(done)
    assert sorted(out + timers.expire()) == by_hand(events, gap)


def test_stream_gives_the_same_sessions(spark, tmp_path):
    pytest.importorskip("pyspark.sql.streaming.stateful_processor")
    from momentlake.streaming.sessions import session_stream

    rng = random.Random(5)
    rows = [(rng.choice("ab"), 1_000_000 + i * 40 + rng.choice([0, 0, 0, 5000])) for i in range(120)]
    rows.sort(key=lambda r: r[1])
    for n, part in enumerate((rows[:60], rows[60:], [("z", 3_000_000)])):  # the last one moves the watermark past all
        pd.DataFrame({"k": [r[0] for r in part], "second": [r[1] for r in part], "time": pd.to_datetime([r[1] for r in part], unit="s").astype("datetime64[us]")}).to_parquet(tmp_path / f"{n}.parquet")
    stream = spark.readStream.schema("k string, second long, time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = session_stream(stream, "k", "second", "time", gap=600, late="3 hours").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, spark.table("closed").collect())) == by_hand(rows, 600)


def test_gate_stream_equals_batch(spark, tmp_path):
    from momentlake.operators import gate
    from momentlake.streaming.gate import gate_stream

    rng = random.Random(6)
    rows = [(rng.choice("ab"), float(i), i, rng.random()) for i in range(100)]
    schema = "video_id string, t double, frame_idx long, signal double"
    for n in range(2):
        pd.DataFrame(rows[n * 50 : n * 50 + 50][::-1], columns=["video_id", "t", "frame_idx", "signal"]).to_parquet(tmp_path / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = gate_stream(stream, method="score", min_fraction=0.9, heartbeat=15.0).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    batch = gate.motion_gate(spark.createDataFrame(rows, schema), "video_id", "t", "signal", "frame_idx", method="score", min_fraction=0.9, heartbeat=15.0)
    pick = lambda df: sorted((r.video_id, r.frame_idx, r.kept, r.by_heartbeat) for r in df.collect())
    assert pick(spark.table("gated")) == pick(batch)


def test_times(spark):
    rows = ["2017-01-02T14:17:56+02:00", " 2017-01-02 14:17:56+0200 ", "2017-01-02T12:17:56Z", "2017-01-02T12:17:56.900Z", "1483359476", "2017-01-02T07:17:56-05:00", "2017-01-02T17:47:56+05:30", None, "", "unknown", "1900", "T+00:00", "2017-13-41 25:61:00+00:00", "2017-01-02 12:17:56"]
    got = [r.s for r in spark.createDataFrame([(r,) for r in rows], "t string").select(epoch_seconds("t").alias("s")).collect()]
    assert got == [1483359476] * 7 + [None] * 7
    keys = [r.k for r in spark.createDataFrame([(" A\t",), ("",), (None,), ("  ",)], "t string").select(compared("t").alias("k")).collect()]
    assert keys == ["a", None, None, None]


def orphan_rule(children, parents):
    out = set()
    for name, rows in children.items():
        for i, k, t in rows:
            if k is not None and not any(p == k and a is not None and t is not None and a <= t and (b is None or b > t) for p, a, b in parents):
                out.add((name, i, k))
    return out


def test_orphans_equal_the_rule(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_ROWS", 20)  # so that the hot key is salted here as well
    monkeypatch.setattr(orphans, "HOT_KEYS", 1000)
    rng = random.Random(1)
    times = [None, 0.0, 1.0, 2.0, 3.0, 4.0]
    children = {n: [(i, rng.choice(["hot"] * 4 + ["a", "b", "c", None]), rng.choice(times)) for i in range(150)] for n in ("x", "y")}
    parents = [("hot", 1.0, 2.0), ("hot", 2.0, 3.0), ("hot", 1.5, 2.5), ("a", None, None), ("b", 0.0, None), ("b", 0.0, None), (None, 0.0, None)]
    dfs = {n: spark.createDataFrame([(*r, "clash") for r in rows], "row_id long, key string, ingested_at double, n string") for n, rows in children.items()}
    p = spark.createDataFrame(parents, "key string, valid_from double, valid_to double")
    got = {(r.table_name, r.row_id, r.key) for r in orphans.orphan_references(dfs, p).collect()}
    assert got == orphan_rule(children, parents)
    none = orphans.orphan_references(dfs, p.where("false"))
    assert {(r.table_name, r.row_id, r.key) for r in none.collect()} == orphan_rule(children, [])
    assert orphans.orphan_references({n: d.where("false") for n, d in dfs.items()}, p).count() == 0
    report = orphans.orphan_report(none).collect()
    assert sum(r.n_rows for r in report) == len(orphan_rule(children, []))


def test_periods_merge(spark):
    p = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 3.0, 4.0), ("a", 6.0, None), ("a", 9.0, 8.0)], "key string, valid_from double, valid_to double")
    spans = orphans.periods(p).first().spans
    assert sorted((s.s, s.e) for s in spans) == [(0.0, 4.0), (6.0, float("inf"))]


def test_components(spark):
    rng = random.Random(2)
    links = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [(f"m{rng.randrange(40):02}", f"m{rng.randrange(40):02}") for _ in range(25)] + [(None, "x")]
    got = {r.a: r.label for r in components.connected_components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {n: root(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_components_of_a_chain_in_any_order(spark):
    """Labels that do not fall along the chain: one component, however long it is."""
    names = [f"{i:04}" for i in range(300)]
    random.Random(3).shuffle(names)
    got = components.connected_components(spark.createDataFrame(list(zip(names[1:], names)), "a string, b string"), "a", "b").collect()
    assert {r.a: r.label for r in got} == dict.fromkeys(names, "0000")
