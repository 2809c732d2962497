import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from momentlake.llm import packing, topn

HITS = "search_id long, video_id string, item_id long, t double, score double, place string"
ORDER = [("score", "desc"), ("t", "asc"), ("item_id", "asc")]


def best(rows, n):
    groups = {}
    for s, v, i, t, x in rows:
        if s is None or v is None or i is None or x is None or x != x:
            continue
        key = (-x, (t is None, t or 0), i)
        g = groups.setdefault((s, v), {})
        g[i] = min(g.get(i, key), key)
    return {(k, i, p + 1) for k, g in groups.items() for p, (i, _) in enumerate(sorted(g.items(), key=lambda e: e[1])[:n])}


@pytest.mark.parametrize("run_rows", [7, 100_000])
def test_top_n_equals_the_rule(spark, run_rows):
    rng = random.Random(run_rows)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([*range(30), None]), rng.choice([0.5, 1.0, None]), rng.choice([0.1, 0.2, 0.2, 0.3, float("nan"), None])) for _ in range(900)]
    rows += rows[:50]
    df = spark.createDataFrame([(*r, "clash") for r in rows], HITS).drop("place").repartition(5)
    out = topn.top_n_per_group(df, ["search_id", "video_id"], ORDER, "item_id", 5, run_rows=run_rows)
    assert {((r.search_id, r.video_id), r.item_id, r.place) for r in out.collect()} == best(rows, 5)


def test_top_n_of_nothing_and_clashing_names(spark):
    df = spark.createDataFrame([], HITS)
    assert topn.top_n_per_group(df.drop("place"), ["search_id", "video_id"], ORDER, "item_id", 5).count() == 0
    one = spark.createDataFrame([(1, "v", 2, 0.0, 0.5, "x")], HITS)
    assert topn.top_n_per_group(one, ["search_id", "video_id"], ORDER, "item_id", 5).collect()[0].place == 1


@settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 8))).map(sorted), min_size=0, max_size=7), st.integers(0, 6))
def test_loser_tree(runs, n):
    got = [runs[r][i] for r, i in topn.merge_group(runs, n)]
    want, seen = [], set()
    for row in sorted(x for r in runs for x in r):
        if row[-1] not in seen and len(want) < n:
            seen.add(row[-1])
            want.append(row)
    assert got == want
    tree = topn.LoserTree([r[0] if r else None for r in runs])
    at, out = [0] * len(runs), []
    while (w := tree.winner) >= 0:
        out.append(runs[w][at[w]])
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == sorted(x for r in runs for x in r)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 9), max_size=20))
def test_plan_is_a_packing(counts):
    ranges, used = packing.plan(counts, 30)
    bins, seen = {}, {}
    for size, first, container, per in sorted(ranges):
        seen.setdefault(size, []).append(first)
    ends = {s: sorted(f)[1:] + [counts[s]] for s, f in seen.items()}
    for size, first, container, per in ranges:
        end = ends[size][sorted(seen[size]).index(first)]
        for r in range(first, end):
            bins.setdefault(container + (r - first) // per, []).append(size)
    assert sorted(x for b in bins.values() for x in b) == sorted(s for s, c in counts.items() for _ in range(c))
    assert all(sum(b) <= 30 for b in bins.values()) and set(bins) == set(range(used))
    assert all(sum(3 * x > 30 for x in b) <= 2 for b in bins.values())


def test_pack(spark):
    rng = random.Random(4)
    texts = ["x" * rng.randrange(0, 120) for _ in range(300)] + ["é" * 200, "", None, "y" * 99, "y" * 100, "z" * 299, "same"] + ["same"] * 40
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "lost", 1)], "doc_id long, text string, tokens int")
    out = packing.pack(df, "doc_id", "text", 100, salt_rows=50).collect()
    size = {i: len(t.encode()) + 1 for i, t in enumerate(texts) if t is not None}
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.tokens))
        by_bin[r.container_id] = by_bin.get(r.container_id, 0) + r.tokens
    assert set(by_doc) == set(size) and max(by_bin.values()) <= 100
    for i, pieces in by_doc.items():
        at = 0
        for n, (piece, start, tokens) in enumerate(sorted(pieces)):
            assert piece == n and start == at
            at += tokens
        assert at == size[i] and (len(pieces) == 1 or size[i] > 100)
    assert len(by_bin) <= -(-sum(size.values()) // 100) + 3
    assert packing.pack(df.where("false"), "doc_id", "text", 100).count() == 0
