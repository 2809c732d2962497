"""Similarity clusters: neighbour graph by neighbour descent, modularity communities, connected clusters.

1. Vectors go to their nearest coarse cell and visit the cells that are nearly as near, so cells overlap.
2. In each cell neighbour descent builds a k-nearest-neighbour graph: random-projection leaves give the first
   neighbours, then neighbours of neighbours (both directions) are tried until few lists change. The descent
   compares a rotated leading block of the vectors; edges count only after a check in double precision.
3. Local moving by modularity gain, of vectors and then of communities, finds communities in the cell's graph.
   A vector's internal degree is the weight of its edges into its own community.
4. An exact check follows: every vector of the cell is compared with every vector of other components; linked ones
   (cosine >= ``min_cosine``) join. So inside a cell the components are those of the whole threshold graph, whatever
   the descent missed.
5. Parts of different cells that share a vector are one cluster (connected components by alternating minimum
   label and pointer jumping, with checkpoints). Clusters under ``min_size`` vanish.

Defined results: rows with a null id or an unusable vector take no part; repeated rows count once; copies of a
vector are linked to each other; ``cluster_id`` is the smallest id of the cluster; equal degrees order by id; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.llm import vectors as V
from momentlake.operators.components import connected_components
from momentlake.session import shared_folder

MEMBER_SCHEMA = "id long, part string, community string, degree double, home boolean"
SKETCH = 96


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k different ids of highest similarity; negative ids are empty slots."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    sims = np.where(ids < 0, -2, sims)
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
    return np.where(sims <= -2, -1, ids), sims


def neighbour_descent(x: np.ndarray, k: int, *, trees: int = 6, leaf: int = 192, tries: int = 32, rounds: int = 4, stop: float = 0.01, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Approximate k nearest neighbours (by dot product) of every row of ``x``: ids (-1 where there are fewer) and similarities."""
    n, rng = len(x), np.random.default_rng(seed)
    ids, sims = np.full((n, k), -1, np.int64), np.full((n, k), -2, np.float32)
    for tree in range(trees if n > leaf else 1):
        tree_ids, tree_sims = np.full((n, k), -1, np.int64), np.full((n, k), -2, np.float32)
        todo = [np.arange(n)]
        while todo:
            part = todo.pop()
            if len(part) > leaf:
                cut = len(part) // 2
                order = np.argpartition(x[part] @ rng.standard_normal(x.shape[1]).astype(np.float32), cut)
                todo += [part[order[:cut]], part[order[cut:]]]
                continue
            s = x[part] @ x[part].T
            np.fill_diagonal(s, -2)
            m = min(k, len(part) - 1)
            if m > 0:
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                tree_ids[part, :m], tree_sims[part, :m] = part[best], np.take_along_axis(s, best, 1)
        ids, sims = _top(np.concatenate([ids, tree_ids], 1), np.concatenate([sims, tree_sims], 1), k) if tree else (tree_ids, tree_sims)
    if n <= leaf:
        return ids, sims
    for _ in range(rounds):
        rows, cols = np.nonzero(ids >= 0)
        to = ids[rows, cols]
        mix = rng.permutation(len(to))
        order = mix[np.argsort(to[mix], kind="stable")]
        start = np.searchsorted(to[order], np.arange(n))
        rank = np.arange(len(order)) - start[to[order]]
        back = np.full((n, k), -1, np.int64)
        ok = rank < k
        back[to[order][ok], rank[ok]] = rows[order][ok]
        both = np.concatenate([ids, back], 1)
        changed = 0
        for i in range(0, n, 2048):
            me = np.arange(i, min(i + 2048, n))
            via = both[me[:, None], rng.integers(0, 2 * k, (len(me), tries))]
            cand = both[np.where(via < 0, me[:, None], via), rng.integers(0, 2 * k, via.shape)]
            cand[cand == me[:, None]] = -1
            s = np.einsum("ud,ucd->uc", x[me], x[np.maximum(cand, 0)])
            new_ids, new_sims = _top(np.concatenate([ids[me], cand], 1), np.concatenate([sims[me], s], 1), k)
            changed += int((new_sims.min(1) > sims[me].min(1)).sum())
            ids[me], sims[me] = new_ids, new_sims
        if changed <= stop * n:
            break
    return ids, sims


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable node of each of ``n`` nodes under the undirected edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    return label


def communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 12, levels: int = 5) -> np.ndarray:
    """Communities of a weighted undirected graph (each edge once, a != b) by modularity: local moving, then again on the communities.

    It ends when nothing moves, at the latest after ``rounds`` moves on each of ``levels`` levels; clusters do not depend on it.
    """
    node = np.arange(n)
    loops = np.zeros(n)
    for _ in range(levels):
        if not len(a):
            break
        size = int(node.max()) + 1
        src, dst, wt = np.r_[a, b], np.r_[b, a], np.r_[w, w]
        degree = np.bincount(src, wt, size) + 2 * loops[:size]
        total = degree.sum()
        com = np.arange(size)
        for r in range(rounds):
            key = src * size + com[dst]
            pair, inv = np.unique(key, return_inverse=True)
            into = np.bincount(inv, wt)
            who, target = pair // size, pair % size
            weight = np.bincount(com, degree, size)
            gain = into - degree[who] * (weight[target] - np.where(target == com[who], degree[who], 0)) / total
            order = np.lexsort((target, -gain, who))
            who, target, gain = who[order], target[order], gain[order]
            first = np.r_[True, who[1:] != who[:-1]]
            best, to = who[first], target[first]
            own = np.zeros(size)
            stay = target == com[who]
            own[who[stay]] = gain[stay]
            own[~np.isin(np.arange(size), who[stay])] = 0.0
            alone = -degree * (weight[com] - degree) / total
            own = np.where(np.isin(np.arange(size), who[stay]), own, alone)
            move = (gain[first] > own[best] + 1e-12) & (to != com[best])
            move &= ((best + r) % 2 == 0) if r < rounds - 2 else (to < com[best])  # half of the nodes at a time, lest neighbours swap
            if not move.any() and r % 2:
                break
            com[best[move]] = to[move]
        _, com = np.unique(com, return_inverse=True)
        node = com[node]
        k = int(com.max()) + 1
        ca, cb = com[a], com[b]
        loops = np.bincount(com, loops[:size], k) + np.bincount(ca[ca == cb], w[ca == cb], k)
        lo, hi = np.minimum(ca, cb)[ca != cb], np.maximum(ca, cb)[ca != cb]
        pair, inv = np.unique(lo * k + hi, return_inverse=True)
        a, b, w = pair // k, pair % k, np.bincount(inv, w[ca != cb], len(pair))
        if k == size:
            break
    return node


def _join_all(u: np.ndarray, vecs: list[bytes], dim: int, part: np.ndarray, min_cosine: float, slack: float, rows: int = 1024, cols: int = 4096) -> np.ndarray:
    """``part`` (a component of each row of ``u``, by smallest member) after joining all components between which any two rows are linked.

    All pairs are compared, block by block. ``slack`` is above the error of single precision: similarities beyond it are
    decided at once, those within it in double precision if their components are still apart.
    """
    n = len(u)
    for i in range(0, n, rows):
        for j in range(i, n, cols):
            s = u[i : i + rows] @ u[j : j + cols].T
            x, y = np.nonzero((s >= min_cosine - slack) & (part[i : i + rows, None] != part[None, j : j + cols]))
            if not len(x):
                continue
            sure = s[x, y] >= min_cosine + slack
            x, y = x + i, y + j
            part = components(n, part[x[sure]], part[y[sure]])[part]
            x, y = x[~sure], y[~sure]
            apart = part[x] != part[y]
            x, y = x[apart], y[apart]
            good = V.exact_cosine(vecs, dim, x, y) >= min_cosine
            part = components(n, part[x[good]], part[y[good]])[part]
    return part


def _cell_members(table: pa.Table, dim: int, k: int, min_cosine: float, slack: float) -> pa.Table:
    vecs, home, ids = V.merge_copies(table)
    cell = table.column("cell")[0].as_py()
    u = V.unit(V.unpack(vecs, dim))
    n = len(u)
    sketch = (u - u.mean(0)) @ V.rotation(dim, SKETCH)  # what all vectors of the cell share tells none of them apart
    near, _ = neighbour_descent(sketch, k)
    a, s = np.nonzero(near >= 0)
    b = near[a, s]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    pair = np.unique(lo * n + hi)
    a, b = pair // n, pair % n
    quick = np.concatenate([np.einsum("ij,ij->i", u[a[i : i + 8192]], u[b[i : i + 8192]]) for i in range(0, len(a), 8192)]) if len(a) else np.zeros(0)
    a, b = a[quick >= min_cosine - slack], b[quick >= min_cosine - slack]
    w = V.exact_cosine(vecs, dim, a, b)
    a, b, w = a[w >= min_cosine], b[w >= min_cosine], w[w >= min_cosine]
    com = communities(n, a, b, w)
    inside = com[a] == com[b]
    copies = np.array([len(i) for i in ids])
    degree = np.bincount(a[inside], w[inside] * copies[b[inside]], n) + np.bincount(b[inside], w[inside] * copies[a[inside]], n) + copies - 1
    part = _join_all(u, vecs, dim, components(n, a, b), min_cosine, slack)
    size = np.bincount(part, copies, n)
    out = {"id": [], "part": [], "community": [], "degree": [], "home": []}
    for i in np.nonzero(size[part] > 1)[0]:
        m = len(ids[i])
        out["id"] += ids[i].tolist()
        out["part"] += [f"{cell}.{part[i]}"] * m
        out["community"] += [f"{cell}.{com[i]}"] * m
        out["degree"] += [float(degree[i])] * m
        out["home"] += [bool(home[i])] * m
    return pa.table({"id": pa.array(out["id"], pa.int64()), "part": pa.array(out["part"], pa.string()), "community": pa.array(out["community"], pa.string()), "degree": pa.array(out["degree"], pa.float64()), "home": pa.array(out["home"], pa.bool_())})


def similarity_clusters(df: DataFrame, id_col: str, vec_col: str, *, dim: int, min_cosine: float, min_size: int = 4, k: int = 10, probes: int = 4, margin: float = 0.15, rows_per_cell: int = 1000, tree: V.Tree | None = None) -> DataFrame:
    """``(cluster_id, item_id, community, degree)``: the members of every cluster of at least ``min_size`` rows.

    ``community`` is the modularity community inside the cluster, ``degree`` the summed cosine of the row's graph
    edges into it.
    """
    spark = df.sparkSession
    shared_folder(spark)
    placed = V.in_cells(df, id_col, vec_col, dim, df.count(), tree or V.Tree(probes, margin, rows_per_cell))
    if placed is None:
        return spark.createDataFrame([], "cluster_id long, item_id long, community string, degree double")
    members = placed.groupBy("cell").applyInArrow(lambda t: _cell_members(t, dim, k, min_cosine, 1e-4), MEMBER_SCHEMA).checkpoint()
    per_item = members.groupBy("id").agg(
        F.min("part").alias("part"),
        F.collect_set("part").alias("parts"),  # at most one per visited cell
        F.max_by("community", F.struct("degree", "home", "community")).alias("community"),
        F.max("degree").alias("degree"),
    )
    links = per_item.where(F.size("parts") > 1).select("part", F.explode("parts").alias("other")).where("part <> other").distinct()
    label = connected_components(links, "part", "other")
    joined = per_item.drop("parts").join(label, "part", "left").select("id", F.coalesce("label", "part").alias("label"), "community", "degree")
    sizes = joined.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("cluster_id")).where(F.col("size") >= min_size)
    return joined.join(sizes, "label").select("cluster_id", F.col("id").alias("item_id"), "community", "degree")


def describe_clusters(members: DataFrame, items: DataFrame, id_col: str, label_col: str, typical: int = 3) -> DataFrame:
    """``(cluster_id, size, community, members, place, item_id, degree, label)``: each cluster's size and, of each of its communities, the ``typical`` members of highest internal weighted degree.

    Communities are numbered from 1 by falling number of members (ties: the smallest id); degrees are compared inside a community only.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    parts = members.groupBy("cluster_id", "community").agg(F.count("*").alias("members"), F.min("item_id").alias("first"))
    by_size = Window.partitionBy("cluster_id").orderBy(F.desc("members"), F.asc("first"))
    parts = parts.withColumn("number", F.row_number().over(by_size)).drop("first")
    order = Window.partitionBy("cluster_id", "community").orderBy(F.desc("degree"), F.asc("item_id"))
    best = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    labels = items.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item_id")).agg(F.max(label_col).alias("label"))
    named = best.join(parts, ["cluster_id", "community"]).join(sizes, "cluster_id").join(labels, "item_id", "left")
    return named.select("cluster_id", "size", F.col("number").alias("community"), "members", "place", "item_id", F.round("degree", 3).alias("degree"), "label")
