import numpy as np
import pytest

from momentlake.llm import clusters, neighbours
from momentlake.llm import vectors as V

DIM = 64
ITEMS = "id long, emb array<float>, other string, cosine double, label string"


def clouds(seed=0, groups=12, size=9, singles=200, spread=0.35):
    """Unit-grid vectors in clouds, tighter pairs inside, singles, copies and unusable rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.standard_normal(DIM)
        c /= np.linalg.norm(c)
        rows += [c + spread * rng.standard_normal(DIM) / np.sqrt(DIM) * (0.2 if i % 3 else 1) for i in range(size)]
    rows += list(rng.standard_normal((singles, DIM)))
    out = [np.round(v / np.linalg.norm(v) * 1024) / 1024 for v in rows]
    out += [out[0]] * 9 + [out[0] * 2, out[5]]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    data += data[:3]
    bad = [(900, None), (901, []), (902, [0.0] * DIM), (903, [1.0] * (DIM - 1)), (904, [float("nan")] + [1.0] * (DIM - 1)), (905, [float("inf")] + [1.0] * (DIM - 1)), (906, [None] + [1.0] * (DIM - 1)), (None, [1.0] * DIM)]
    return data, bad


def exact(data):
    items = dict(data)
    ids = sorted(items)
    m = np.array([items[i] for i in ids], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -2)
    return np.array(ids), s


def frame(spark, data):
    return spark.createDataFrame([(i, v, "clash", 0.5, "x") for i, v in data], ITEMS).repartition(3)


def test_neighbours_equal_brute_force(spark):
    data, bad = clouds()
    ids, s = exact(data)
    out = neighbours.neighbours(frame(spark, data + bad), "id", "emb", dim=DIM, k=5, min_cosine=0.9, probes=4, margin=0.2, rows_per_cell=60)
    want = {(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:5] if s[a, b] >= 0.9}
    got = {(r.id, r.other) for r in out.collect()}
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want) and len(want) > 300


def test_neighbours_without_a_limit(spark):
    data, _ = clouds(1, singles=100)
    ids, s = exact(data)
    out = neighbours.neighbours(frame(spark, data), "id", "emb", dim=DIM, k=3, min_cosine=-1.0, probes=1000, margin=2.0, rows_per_cell=60)
    got = {(r.id, r.other) for r in out.collect()}
    want = {(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:3]}
    assert len(want & got) >= 0.98 * len(want) and len(got) == len(want)


def test_empty_and_unusable(spark):
    _, bad = clouds(2)
    for rows in ([], bad):
        df = frame(spark, rows)
        assert neighbours.neighbours(df, "id", "emb", dim=DIM, k=5, min_cosine=-1.0).count() == 0
        assert clusters.similarity_clusters(df, "id", "emb", dim=DIM, min_cosine=0.5).count() == 0


def test_scan_is_exact_when_all_is_read():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 512)).astype(np.float32)
    x[100:200] = x[:100] + 0.3 * rng.standard_normal((100, 512)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, 9)
    a, b, _ = neighbours.scan(x, x, np.full(300, 0.5, np.float32), 4, 4.0, np.arange(300))
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d[i])[:4] if d[i, j] <= 0.5}
    assert want <= set(zip(a.tolist(), b.tolist()))


def test_packing_round_trip():
    rng = np.random.default_rng(4)
    m = np.concatenate([np.round(rng.standard_normal((5, 8)) * 1024) / 1024, rng.standard_normal((5, 8)), [[1, 2, 3, 4, 5, 6, 7, 8]], [[2, 4, 6, 8, 10, 12, 14, 16]]]).astype(np.float32)
    back = V.unpack(V.pack(m), 8)
    assert np.allclose(V.unit(back), V.unit(m), atol=1e-6)
    assert V.pack(m)[-1] == V.pack(m)[-2] and np.array_equal(back[5:10], m[5:10])


def cluster_rule(data, limit, least):
    ids, s = exact(data)
    label = clusters.components(len(ids), *np.nonzero(s >= limit))
    out = {}
    for i, l in zip(ids, label):
        out.setdefault(int(l), []).append(int(i))
    return {(min(v), i) for v in out.values() if len(v) >= least for i in v}


def test_clusters_equal_brute_force(spark):
    data, bad = clouds(5, groups=20, size=8)
    want = cluster_rule(data, 0.7, 4)
    out = clusters.similarity_clusters(frame(spark, data + bad), "id", "emb", dim=DIM, min_cosine=0.7, probes=4, margin=0.3, rows_per_cell=80)
    got = {(r.cluster_id, r.item_id) for r in out.collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want) and len(want) > 100
    described = clusters.describe_clusters(out, frame(spark, data), "id", "label").collect()
    sizes = {r.cluster_id: r.size for r in described}
    assert all(sizes[c] == sum(1 for x in got if x[0] == c) for c in sizes) and {r.label for r in described} == {"x"}
    whole = {c: {(r.community, r.members) for r in described if r.cluster_id == c} for c in sizes}
    assert all(sum(m for _, m in v) == sizes[c] and min(n for n, _ in v) == 1 for c, v in whole.items()) and all(r.place <= 3 for r in described)


def test_clusters_joined_by_a_link_in_no_list(spark):
    """a and b link two groups; each has ten nearer neighbours in its own group, and neither is typical of it."""
    rng = np.random.default_rng(8)
    e = np.eye(DIM)
    groups = [c + 0.05 * rng.standard_normal((30, DIM)) / np.sqrt(DIM) for c in (e[0], e[1], -e[0], -e[1])]  # the opposites keep the mean at 0
    a, b = 0.72 * e[0] + 0.18 * e[1] + 0.67 * e[2], 0.18 * e[0] + 0.72 * e[1] + 0.67 * e[2]
    rows = [np.round(v / np.linalg.norm(v) * 1024) / 1024 for v in [*np.concatenate(groups), a, b]]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    _, s = exact(data)
    assert s[120, 121] >= 0.66 and (np.sort(s[120])[-11:] > s[120, 121]).sum() >= 10 and (s[30:60, 120] < 0.3).all() and (s[:30, 121] < 0.3).all()
    want = cluster_rule(data, 0.66, 4)
    out = clusters.similarity_clusters(frame(spark, data), "id", "emb", dim=DIM, min_cosine=0.66, probes=8, margin=100.0)
    assert {(r.cluster_id, r.item_id) for r in out.collect()} == want and (0, 59) in want


def groups_of(placed):
    groups = {}
    for r in placed.collect():
        groups.setdefault(r.cell, set()).update(r.ids)
    return groups


def test_a_cell_that_cannot_be_divided_goes_in_pairs_of_blocks(spark, monkeypatch):
    """No group holds more than two blocks, and the results are those of the whole cell."""
    data, _ = clouds(9, groups=20, size=8)
    ids, s = exact(data)
    df = frame(spark, data)
    whole = V.Cells(np.zeros(DIM, np.float32), np.eye(1, DIM, dtype=np.float32), np.zeros(1, np.float32), np.array([300.0]))
    tree = V.Tree(1, 0.0, rows_per_cell=10, too_large=10, levels=1)
    groups = groups_of(V.to_cells(df, "id", "emb", DIM, whole, tree, last=True))
    assert len(groups) > 6 and max(map(len, groups.values())) <= 0.6 * len(ids)
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert len(met) == len(ids) ** 2
    monkeypatch.setattr(V, "fit_cells", lambda *a, **k: whole)
    got = {(r.id, r.other) for r in neighbours.neighbours(df, "id", "emb", dim=DIM, k=5, min_cosine=0.9, tree=tree).collect()}
    want = {(int(ids[a]), int(ids[b])) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:5] if s[a, b] >= 0.9}
    assert got == want
    out = clusters.similarity_clusters(df, "id", "emb", dim=DIM, min_cosine=0.7, tree=tree)
    assert {(r.cluster_id, r.item_id) for r in out.collect()} == cluster_rule(data, 0.7, 4)


def test_large_cells_are_divided_level_by_level(spark):
    """Four cells at a time over 3,000 rows, a third of them near-copies of one vector: no group gets much larger than the limit."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((200, DIM))
    crowd = rng.standard_normal(DIM)
    m = np.concatenate([centres[rng.integers(0, 200, 2000)] + 0.25 * rng.standard_normal((2000, DIM)), crowd + 0.1 * rng.standard_normal((1000, DIM))])
    m /= np.linalg.norm(m, axis=1)[:, None]
    data = [(i, [float(x) for x in np.round(v * 1024) / 1024]) for i, v in enumerate(m)]
    df = frame(spark, data)
    tree = V.Tree(3, 0.1, rows_per_cell=60, fanout=6, too_large=6, levels=5, salt_rows=200, sample_per_cell=40)
    groups = groups_of(V.in_cells(df, "id", "emb", DIM, len(data), tree))
    assert len(groups) > 20 and max(map(len, groups.values())) <= 1.5 * tree.limit and set().union(*groups.values()) == set(range(3000))
    ids, s = exact(data)
    found = neighbours.neighbours(df, "id", "emb", dim=DIM, k=5, min_cosine=0.8, tree=tree)
    got = {(r.id, r.other) for r in found.collect()}
    want = {(int(ids[a]), int(ids[b])) for a in range(2000) for b in np.argsort(-s[a], kind="stable")[:5] if s[a, b] >= 0.8}
    assert len(want & got) >= 0.9 * len(want) and len(want) > 5000
    want = cluster_rule(data, 0.8, 4)
    got = {(r.cluster_id, r.item_id) for r in clusters.similarity_clusters(df, "id", "emb", dim=DIM, min_cosine=0.8, tree=tree).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(want) > 2500


@pytest.mark.parametrize("n", [1, 30, 1500])
def test_neighbour_descent(n):
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((max(1, n // 15), 48))
    x = (centre[rng.integers(0, len(centre), n)] + 0.4 * rng.standard_normal((n, 48))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, _ = clusters.neighbour_descent(x, 5)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, 1)[:, : min(5, n - 1)]
    hit = sum(len(set(w) & set(i)) for w, i in zip(want.tolist(), ids.tolist()))
    assert hit >= 0.9 * want.size and all(i not in row for i, row in enumerate(ids.tolist()))


def test_communities_of_two_cliques():
    a, b = zip(*[(i, j) for base in (0, 6) for i in range(base, base + 6) for j in range(i + 1, base + 6)], (5, 6))
    com = clusters.communities(12, np.array(a), np.array(b), np.ones(len(a)))
    assert len(set(com[:6])) == 1 and len(set(com[6:])) == 1 and com[0] != com[11]
    assert len(clusters.communities(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0))) == 3
