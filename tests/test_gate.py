import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.operators import gate

FRAMES = "video_id string, t double, signal array<double>, frame_idx long"


def run(spark, frames, **settings):
    rows = [("v", t, [float(x) for x in cells], i) for i, (t, cells) in enumerate(frames)]
    g = gate.motion_gate(spark.createDataFrame(rows, FRAMES), "video_id", "t", "signal", "frame_idx", **settings)
    out = g.orderBy("t").collect()
    return [r.t for r in out if r.kept], gate.gate_stats(g).first()


def test_static_then_moving(spark):
    still = np.full(240, 90.0)
    frames = [(i / 2, still) for i in range(10)]
    for i in range(5):
        f = still.copy()
        f[i * 40 : i * 40 + 40] = 200
        frames.append((5 + i / 2, f))
    kept, stats = run(spark, frames, method="diff", min_fraction=0.005)
    assert (stats.frames_seen, stats.frames_kept, stats.frames_skipped) == (15, 6, 9) and kept[0] == 0


def test_noise_is_no_motion(spark):
    rng = np.random.default_rng(0)
    kept, _ = run(spark, [(i / 2, 90 + rng.normal(0, 2, 240)) for i in range(20)], method="diff", min_fraction=0.005)
    assert kept == [0.0]


def test_heartbeat(spark):
    kept, stats = run(spark, [(i / 2, np.full(20, 90.0)) for i in range(61)], method="diff", heartbeat=10.0)
    assert kept == [0, 10, 20, 30] and stats.kept_by_heartbeat == 3


def test_disabled_keeps_all(spark):
    kept, stats = run(spark, [(float(i), np.zeros(4)) for i in range(5)], method="diff", enabled=False)
    assert len(kept) == 5 and stats.frames_skipped == 0 and stats.skip_ratio == 0


def test_slow_drift(spark):
    rng = np.random.default_rng(1)
    base = rng.uniform(0, 100, 400)
    kept, _ = run(spark, [(i / 2, base + 2.0 * i * (rng.random(400) < 0.9)) for i in range(40)], method="diff", min_fraction=0.02)
    assert 1 < len(kept) < 40


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        gate.Gate(method="optical-flow")


def test_empty(spark):
    _, stats = run(spark, [], method="diff")
    assert stats.frames_seen == 0 and stats.skip_ratio == 0


def rule(times, scores, least, heartbeat):
    """What the gate keeps, frame by frame."""
    out, last = [], None
    for t, s in zip(times, scores):
        why = "first" if last is None else "motion" if s >= least else "beat" if t - last >= heartbeat else ""
        last = t if why else last
        out.append(why)
    return out


@pytest.mark.parametrize("heartbeat", [0.3, 2.0, 1e9])
def test_gate_in_pieces_equals_the_rule(heartbeat):
    rng = np.random.default_rng(5)
    t = np.sort(np.round(rng.uniform(0, 60, 300), 1))
    s = rng.random(300)
    want = rule(t, s, 0.95, heartbeat)
    for cuts in ([], [1, 2, 150, 299], list(range(1, 300))):
        g = gate.Gate(method="score", min_fraction=0.95, heartbeat=heartbeat)
        got = [g.run(a, b) for a, b in zip(np.split(t, cuts), np.split(s, cuts))]
        kept, beat = np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
        assert [bool(w) for w in want] == kept.tolist() and [w == "beat" for w in want] == beat.tolist()


def test_difference_in_pieces_equals_one_pass():
    rng = np.random.default_rng(6)
    cells = list(np.cumsum(rng.normal(0, 9, (200, 30)), 0))
    t = np.arange(200) / 2
    whole = gate.Gate(method="diff", min_fraction=0.4, heartbeat=7.0).run(t, cells)
    reference, scores, last = None, [], None
    for at, c in zip(t, cells):
        s = 1.0 if reference is None else np.mean(np.abs(c - reference) > 25)
        scores.append(s)
        if last is None or s >= 0.4 or at - last >= 7:
            reference, last = c, at
    assert np.allclose(whole[0], scores) and 1 < whole[1].sum() < 200
    g = gate.Gate(method="diff", min_fraction=0.4, heartbeat=7.0)
    parts = [g.run(t[i : i + 13], cells[i : i + 13]) for i in range(0, 200, 13)]
    assert all(np.array_equal(np.concatenate([p[k] for p in parts]), whole[k]) for k in range(3))


def one_cell(values, history=50, spread=32.0):
    """The mixture for a single cell, mode by mode."""
    modes, out = [], []
    for n, x in enumerate(values, 1):
        rate = 1 / min(2 * n, history)
        ahead, seen, fit, after = 0.0, False, False, []
        for w, m, v in modes:
            w = (1 - rate) * w - rate * 0.05
            d = (x - m) ** 2
            if not fit:
                seen |= ahead < 0.9 and d < spread * v
                if d < 9 * v:
                    fit = True
                    w += rate
                    m, v = m + rate / w * (x - m), min(75.0, max(4.0, v + rate / w * (d - v)))
            if w >= rate * 0.05:
                ahead += w
                after.append((w, m, v))
        total = sum(w for w, *_ in after)
        after = sorted([(w / total, m, v) for w, m, v in after], key=lambda a: -a[0])
        if not fit:
            after = after[:4]
            after = [((1 - rate) * w, m, v) for w, m, v in after] + [(rate if after else 1.0, x, 15.0)]
            total = sum(w for w, *_ in after)
            after = sorted([(w / total, m, v) for w, m, v in after], key=lambda a: -a[0])
        modes = after
        out.append(not seen)
    return out


def test_mixture_equals_the_rule_per_cell():
    rng = np.random.default_rng(7)
    level = rng.choice([30.0, 90.0, 150.0, 220.0, 20.0, 60.0], (120, 40), p=[0.5, 0.3, 0.05, 0.05, 0.05, 0.05])
    frames = level + rng.normal(0, 2, level.shape)
    model = gate.Mixture(40)
    got = np.array([model.foreground(f) for f in frames])
    assert np.array_equal(got, np.array([one_cell(c) for c in frames.T]).T)
    assert got[0].all() and 0 < got[60:].mean() < 0.5
    again = gate.Mixture(0)
    again.restore(model.to_bytes())
    assert np.array_equal(again.foreground(frames[3]), model.foreground(frames[3]))


def test_background_learns(spark):
    rng = np.random.default_rng(2)
    frames = [(i / 2, 90 + rng.normal(0, 2, 300)) for i in range(30)]
    moved = frames[-1][1].copy()
    moved[:100] += 120
    kept, _ = run(spark, [*frames, (15.0, moved)], method="background", min_fraction=0.2, heartbeat=1e9)
    assert kept == [0.0, 15.0]


def test_sampling(spark):
    frames = spark.range(12).select(F.col("id").alias("frame_idx"))
    assert [r.frame_idx for r in gate.sample_frames(frames, F.lit(10.0), 2.0).orderBy("frame_idx").collect()] == [0, 5, 10]
    odd = [r.frame_idx for r in gate.sample_frames(spark.range(60).withColumnRenamed("id", "frame_idx"), F.lit(29.97), 2.0).orderBy("frame_idx").collect()]
    step, nxt, want = 29.97 / 2, 0.0, []
    for i in range(60):
        if i + 1e-6 >= nxt:
            want.append(i)
            nxt += step
    assert odd == want
    assert gate.sample_frames(frames, F.lit(0.0), 50.0).count() == 12


def test_samples(spark):
    df = spark.range(100)
    assert gate.step_sample(df, "id", 10, 100).count() == 10
    a, b = ([r.id for r in gate.seeded_sample(df, "id", 7, 1).collect()] for _ in range(2))
    assert a == b and len(a) == 7 and a == sorted(a)


def test_idle_padding(spark):
    rows = [("v", i, [10.0 * i] * 4) for i in range(3)]
    out = gate.idle_padded(spark.createDataFrame(rows, "video_id string, frame_idx int, cells array<double>"), 5, "cells", "frame_idx").orderBy("frame_idx").collect()
    assert [r.frame_idx for r in out] == list(range(13))
    assert out[5].cells == [0.0] * 4 and out[7].cells == [20.0] * 4


def test_gate_counters_add_up(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(i), rng.random(), i) for i in range(300)]
    df = spark.createDataFrame(rows, "video_id string, t double, signal double, frame_idx long")
    g = gate.motion_gate(df, "video_id", "t", "signal", "frame_idx", method="score", min_fraction=0.9, heartbeat=20.0)
    for s in gate.gate_stats(g, ["video_id"]).collect():
        assert s.frames_kept + s.frames_skipped == s.frames_seen and s.kept_by_heartbeat <= s.frames_kept
