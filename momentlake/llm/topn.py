"""Top N items within every group: sorted runs, loser-tree merge, seek to the next group after N outputs.

Map side: rows of a task are cut into runs; each run is sorted by bucket, group and order, repeated items of a
group are reduced to their best row, and rows beyond a group's N best of the run are left out (they can't be among
the N best of the group). A run travels as one row per bucket, so it arrives as it was sorted.
Reduce side: a bucket's runs are merged by a loser tree over the runs' next groups. A group that several runs hold
is merged row by row by a second loser tree until N different items are out; then every run seeks to its next
group. A group of any size sends at most N rows per run, so no task holds a large group.

Defined results: rows with a null group column, a null item or a null or NaN score take no part; an item occurring
more than once in a group counts once, with its best row; remaining ties are broken by the further order columns
(null last), so every run of the program gives the same rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LoserTree:
    """Tournament over k sources; ``keys[i]`` is source i's next key or None when it is used up. The winner has the least key."""

    def __init__(self, keys: list):
        self.keys, self.k = list(keys), len(keys)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, i: int) -> None:
        """Source i climbs from its leaf; at each node the loser stays and the winner goes on."""
        node = (i + self.k) // 2
        while node:
            seated = self.tree[node]
            if seated < 0:
                self.tree[node] = i
                return
            if self._beats(seated, i):
                self.tree[node], i = i, seated
            node //= 2
        self.tree[0] = i

    @property
    def winner(self) -> int:
        """The source with the least key, or -1 when all are used up."""
        w = self.tree[0]
        return w if self.k and self.keys[w] is not None else -1

    def replace(self, key) -> None:
        """The winner's next key."""
        w = self.tree[0]
        self.keys[w] = key
        self._play(w)


def merge_group(runs: list[list[tuple]], n: int) -> list[tuple[int, int]]:
    """The first ``n`` different items of sorted runs of (order..., item) rows, as (run, row)."""
    at = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    seen, out = set(), []
    while len(out) < n and (w := tree.winner) >= 0:
        row = runs[w][at[w]]
        if row[-1] not in seen:
            seen.add(row[-1])
            out.append((w, at[w]))
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    return out


def _boundaries(t: pa.Table, names: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    if t.num_rows:
        new[0] = True
    for c in names:
        col = t.column(c).combine_chunks()
        new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return new


def sorted_run(t: pa.Table, group: list[str], order: list[tuple[str, str]], item: str, n: int) -> pa.Table:
    """``t`` sorted by bucket, group and order with one row per item and at most ``n`` rows per group."""
    keys = [("__bucket", "ascending")] + [(g, "ascending") for g in group] + [(c, "descending" if d == "desc" else "ascending") for c, d in order]
    t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_end"))
    gid = np.cumsum(_boundaries(t, group))
    items = pc.rank(t.column(item), tiebreaker="dense").to_numpy()
    p = np.lexsort((np.arange(len(gid)), items, gid))
    first = np.ones(len(p), bool)
    first[1:] = (gid[p][1:] != gid[p][:-1]) | (items[p][1:] != items[p][:-1])
    kept = np.sort(p[first])
    g = gid[kept]
    start = np.nonzero(np.r_[True, g[1:] != g[:-1]])[0] if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return t.take(pa.array(kept[rank < n]))


class _Reverse:
    """A value that sorts in reverse."""

    __slots__ = ("v",)

    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return other.v < self.v

    def __eq__(self, other):
        return self.v == other.v


def _order_key(value, direction: str):
    if value is None or value != value:
        return (1,)
    if direction == "desc":
        return (0, -value if isinstance(value, (int, float)) else _Reverse(value))
    return (0, value)


def merge_runs(runs: list[pa.Table], group: list[str], order: list[tuple[str, str]], item: str, n: int) -> pa.Table:
    """One bucket's runs merged: per group the ``n`` best rows with their place."""
    starts, keys = [], []
    for r in runs:
        s = np.nonzero(_boundaries(r, group))[0]
        starts.append(np.r_[s, r.num_rows].tolist())
        heads = r.select(group).take(pa.array(s))
        keys.append(list(zip(*(heads.column(c).to_pylist() for c in group))))
    base = np.cumsum([0] + [r.num_rows for r in runs]).tolist()
    at = [0] * len(runs)
    tree = LoserTree([k[0] if k else None for k in keys])
    pick, place = [], []
    while (w := tree.winner) >= 0:
        key, holders = keys[w][at[w]], []
        while (w := tree.winner) >= 0 and tree.keys[w] == key:
            holders.append((w, starts[w][at[w]], starts[w][at[w] + 1]))
            at[w] += 1  # seek: whatever is left of the group in this run is passed over
            tree.replace(keys[w][at[w]] if at[w] < len(keys[w]) else None)
        if len(holders) == 1:
            r, lo, hi = holders[0]
            hi = min(hi, lo + n)
            pick.extend(range(base[r] + lo, base[r] + hi))
            place.extend(range(1, hi - lo + 1))
            continue
        rows = []
        for r, lo, hi in holders:
            part = runs[r].slice(lo, hi - lo)
            columns = [[_order_key(v, d) for v in part.column(c).to_pylist()] for c, d in order]
            rows.append(list(zip(*columns, part.column(item).to_pylist())))
        best = merge_group(rows, n)
        pick.extend(base[holders[i][0]] + holders[i][1] + j for i, j in best)
        place.extend(range(1, len(best) + 1))
    whole = pa.concat_tables(runs).take(pa.array(pick, pa.int64()))
    return whole.append_column("place", pa.array(place, pa.int32()))


def top_n_per_group(df: DataFrame, group: list[str], order: list[tuple[str, str]], item: str, n: int, *, run_rows: int = 100_000, rows_per_bucket: int = 200_000) -> DataFrame:
    """For each ``group`` the ``n`` best different ``item`` values by ``order`` (column, "asc" or "desc"; the first is the score), with ``place`` 1..n."""
    spark = df.sparkSession
    names = list(dict.fromkeys(group + [c for c, _ in order] + [item]))
    buckets = max(2 * spark.sparkContext.defaultParallelism, df.count() // rows_per_bucket)
    tasks = min(buckets, max(20_000, buckets // 16))  # beyond 4 billion rows a task merges several buckets, one after the other
    score = order[0][0]
    keep = F.col(item).isNotNull() & F.col(score).isNotNull()
    if dict(df.dtypes)[score] in ("double", "float"):
        keep &= ~F.isnan(score)
    for g in group:
        keep &= F.col(g).isNotNull()
    rows = df.select(*names).where(keep).select(F.pmod(F.xxhash64(*group), F.lit(buckets)).cast("int").alias("__bucket"), *names)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    run_schema = "__bucket int, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in names)
    out_schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", place int"

    def make(parts: list[pa.RecordBatch]):
        run = sorted_run(pa.Table.from_batches(parts), group, order, item, n)
        if not run.num_rows:
            return None
        cut = np.nonzero(_boundaries(run, ["__bucket"]))[0]
        offsets = pa.array(np.r_[cut, run.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, run.column(c).combine_chunks()) for c in names]
        return pa.RecordBatch.from_arrays([run.column("__bucket").combine_chunks().take(pa.array(cut)), *lists], ["__bucket", *names])

    def runs(batches):
        parts, held = [], 0
        for b in batches:
            parts.append(b)
            held += b.num_rows
            if held >= run_rows:
                if (r := make(parts)) is not None:
                    yield r
                parts, held = [], 0
        if parts and (r := make(parts)) is not None:
            yield r

    def merge(t: pa.Table) -> pa.Table:
        parts = []
        for i in range(t.num_rows):
            parts.append(pa.table({c: t.column(c)[i].values for c in names}))
        return merge_runs(parts, group, order, item, n).select([*names, "place"])

    return rows.mapInArrow(runs, run_schema).repartition(tasks, "__bucket").groupBy("__bucket").applyInArrow(merge, out_schema)
