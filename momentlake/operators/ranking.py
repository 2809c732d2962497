"""From scored items to ranked moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlake.functions.numbers import rounded
from momentlake.operators.ordered import whole_groups


def wanted(count: int | None) -> int | None:
    """A limit as callers mean it: None and 0 stand for all."""
    return count or None


def top_k(df: DataFrame, k: int | None, id_col: str = "item_id") -> DataFrame:
    """By falling score, ties by rising id; the first ``k`` (None or 0: all)."""
    ranked = df.orderBy(F.desc("score"), F.asc(id_col))
    return ranked.limit(k) if wanted(k) else ranked


def of_kinds(df: DataFrame, kinds: tuple[str, ...] | None = None, video_ids: list[str] | None = None) -> DataFrame:
    """Items of the given kinds and videos; None or an empty list doesn't restrict."""
    if kinds:
        df = df.where(F.col("kind").isin(*kinds))
    if video_ids:
        df = df.where(F.col("video_id").isin(*video_ids))
    return df


def best_per_timestamp(scored: DataFrame, keys: tuple[str, ...] = ("video_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """``(keys..., t, item_id, score, carry...)``: per video and time (to the millisecond) the item of highest score, ties to the lowest id.

    Null scores take no part. A partial aggregate; a hot video is reduced before the shuffle.
    """
    best = F.expr(f"max_by(struct({', '.join(f'`{c}`' for c in ('item_id', 'score', *carry))}), struct(score, -item_id)) AS b")
    known = scored.where("score is not null and video_id is not null")
    return known.groupBy(*keys, F.expr(f"{rounded('t', 3)} AS t")).agg(best).selectExpr(*keys, "t", "b.item_id", "b.score", *(f"b.`{c}`" for c in carry))


REACH = 64  # a stretch of a video without a cut (see ``fold``) is resolved in its slice up to so many windows
ROW, SPAN = ("t", "item_id", "score"), ("t_start", "t_end", "merged")


def _extent(window: float) -> tuple[float, float, float]:
    """Longest stretch resolved in a slice, what a slice sees beyond its edges, and its width; in seconds."""
    reach = max(REACH * window, 1.0)
    return reach, reach + 2 * window + 1.0, 16 * reach


def sliced(rows: DataFrame, window: float, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``rows (keys..., t, ...)`` with ``slice``, spread by video and slice of time; a row near an edge goes to the neighbouring slice as well."""
    _, halo, width = _extent(window)
    seen = f"explode(sequence(floor((t - {halo}D) / {width}D), floor((t + {halo}D) / {width}D))) AS slice"
    return rows.where(" and ".join(f"{c} is not null" for c in (*keys, *ROW))).selectExpr("*", seen).repartition(*keys, "slice")


def greedy(t: np.ndarray, rank: np.ndarray, window: float, group: np.ndarray | None = None, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of (group, time; ``inside``: time less what a group has in common): the hit each one belongs to, and whether it is the best of its group within the window of it.

    From best to worst, a row that no accepted hit has claimed becomes a hit and claims all unclaimed rows within the window.
    """
    n = len(t)
    group = np.zeros(n, np.int64) if group is None else group
    line = t if inside is None else inside
    line = line - line.min(initial=0.0)
    line = line + group * (line.max(initial=0.0) + 2 * window + 1)  # all groups on one line, too far apart to touch
    lo, hi = np.searchsorted(line, line - window), np.searchsorted(line, line + window, side="right")
    near = lambda at: (group[at] == group) & (np.abs(t - t[at]) <= window)
    while (less := (lo > 0) & near(np.maximum(lo - 1, 0))).any():  # by the difference itself, not by a rounded sum
        lo -= less
    while (more := ~near(lo)).any():
        lo += more
    while (more := (hi < n) & near(np.minimum(hi, n - 1))).any():
        hi += more
    while (less := ~near(hi - 1)).any():
        hi -= less
    to, best = np.full(n, -1, np.int64), np.zeros(n, bool)
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    starts, ends, places = lo.tolist(), hi.tolist(), place.tolist()
    for i in rank.tolist():
        if to[i] < 0:
            a, b = starts[i], ends[i]
            if b - a == 1:
                to[i], best[i] = i, True
                continue
            part = to[a:b]
            part[part < 0] = i
            best[i] = place[a:b].min() == places[i]
    return to, best


def _hits(t: pa.Table, to: np.ndarray, use: np.ndarray, plain: list[str]) -> pa.Table:
    """The hits of the rows ``use`` of ``t`` with their members among these."""
    own, at = np.unique(to[use], return_inverse=True)
    times = t.column("t").to_numpy()
    start, end = np.full(len(own), np.inf), np.full(len(own), -np.inf)
    np.minimum.at(start, at, times[use])
    np.maximum.at(end, at, times[use])
    hit = t.take(pa.array(own))
    return pa.table([*(hit.column(c) for c in plain), pa.array(start), pa.array(end), pa.array(np.bincount(at, minlength=len(own)), pa.int32()), pa.array(np.zeros(len(own)), pa.int32())], names=[*plain, *SPAN, "state"])


def _rank(t: pa.Table) -> np.ndarray:
    return np.lexsort((t.column("item_id").to_numpy(), -t.column("score").to_numpy()))


def _slice_hits(t: pa.Table, first: np.ndarray, window: float, plain: list[str]) -> pa.Table:
    """Whole slices, beginning at the rows ``first``: the hits at home in each as far as resolved, and its rows in stretches that are too long (``state`` 1; 2: a cut beside one)."""
    reach, _, width = _extent(window)
    n, times, number = t.num_rows, t.column("t").to_numpy(), t.column("slice").to_numpy()
    group = np.zeros(n, np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    start, end = np.zeros(n, bool), np.zeros(n, bool)
    start[first], end[np.r_[first[1:], n] - 1] = True, True
    low = number * width
    inside = times - low
    to, best = greedy(times, _rank(t), window, group, inside)
    cut = best & (inside - window >= -reach - window) & (inside + window <= width + reach + window)
    gap = np.r_[np.diff(times) > window, False]  # after the row
    opens = np.where(start, inside + reach > 0, np.r_[False, gap[:-1]]) | cut
    closes = np.where(end, width + reach - inside > 0, gap) | cut
    before = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
    after = np.minimum.accumulate(np.where(closes, np.arange(n), n)[::-1])[::-1]
    bounded = (before >= first[group]) & (after < np.r_[first[1:], n][group])
    long = ~bounded | (times[np.minimum(after, n - 1)] - times[np.maximum(before, 0)] > reach)
    home = np.floor(times / width) == number
    beside = np.r_[False, (long & ~gap & ~end)[:-1]] | np.r_[(long & ~start)[1:], False] & ~gap
    state = np.where(long, 1, np.where(cut & beside, 2, 0))
    settled = _hits(t, to, ~long & home[to], plain)
    left = np.nonzero(home & (state > 0))[0]
    if not len(left):
        return settled
    part = t.take(pa.array(left))
    ones = pa.array(np.ones(len(left)), pa.int32())
    return pa.concat_tables([settled, pa.table([*(part.column(c) for c in plain), part.column("t"), part.column("t"), ones, pa.array(state[left], pa.int32())], names=[*plain, *SPAN, "state"])])


def fold(rows: DataFrame, window: float, keys: tuple[str, ...] = ("video_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Hits ``(keys..., t, item_id, score, t_start, t_end, merged, carry...)`` of rows ``sliced`` by video and time.

    A row that is the best within the window around it is a hit whatever happens elsewhere, and no row on one side of it
    can touch a hit on its other side; a gap longer than the window parts rows as well. Between two such cuts the greedy walk
    stands on its own, so each slice settles the stretches it sees whole. Stretches longer than ``REACH`` windows (scores that
    rise or fall all along) are walked per video afterwards; so a video may have any number of rows, but a task holds one slice.
    """
    plain, apart = [*keys, *ROW, *carry], [*keys, "slice"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in plain), "t_start double, t_end double, merged int, state int"])

    def walk(batches):
        for t, cuts in whole_groups(batches, apart):
            yield from _slice_hits(t, cuts[:-1], window, plain).combine_chunks().to_batches()

    def rest(t: pa.Table) -> pa.Table:
        t = t.sort_by("t")
        to, _ = greedy(t.column("t").to_numpy(), _rank(t), window)
        return _hits(t, to, t.column("state").to_numpy() == 1, plain)

    parts = rows.select(*apart, *ROW, *carry).sortWithinPartitions(*apart, "t").mapInArrow(walk, schema)
    settled = parts.where("state = 0").unionByName(parts.where("state > 0").groupBy(*keys).applyInArrow(rest, schema))
    # a hit beside a stretch that was too long has members on both sides
    joined = "max(score) AS score", "min(t_start) AS t_start", "max(t_end) AS t_end", "CAST(sum(merged) AS int) AS merged", *(f"first(`{c}`) AS `{c}`" for c in carry)
    return settled.groupBy(*keys, "item_id", "t").agg(*map(F.expr, joined)).select(*keys, *ROW, *SPAN, *carry)


def merge_hits(ranked: DataFrame, merge_seconds: float, k: int | None = None) -> DataFrame:
    """Greedy merging in time: ``(video_id, t, item_id, score, t_start, t_end, merged)``, best first, the first ``k`` (None or 0: all).

    From best to worst (ties: lower ``item_id``), a row within ``merge_seconds`` of an accepted hit's own time in the same
    video is folded into the best such hit, else it becomes a hit. Rows with a null take no part.
    """
    rows = sliced(ranked.select("video_id", "t", "item_id", "score"), merge_seconds)
    return top_k(fold(rows, merge_seconds), k)


def moments(scored: DataFrame, merge_seconds: float, k: int | None, carry: tuple[str, ...] = (), query: str | None = None) -> DataFrame:
    """``best_per_timestamp`` and ``merge_hits`` behind a single exchange: best item per stamp, stamps merged in time, best first.

    With ``query``, a column that tells the scores of several queries apart, the first ``k`` of each query with their ``rank``.
    """
    keys = ("video_id",) if query is None else (query, "video_id")
    best = best_per_timestamp(sliced(scored, merge_seconds, keys), (*keys, "slice"), carry)
    hits = fold(best, merge_seconds, keys, carry)
    if query is None:
        return top_k(hits, k)
    ranked = numbered(hits, [F.desc("score"), F.asc("item_id")], [query])
    return ranked.where(F.col("rank") <= k) if wanted(k) else ranked


def enrich(hits: DataFrame, items: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with their items' columns (inner join; the planner broadcasts whichever side is small)."""
    extra = [c for c in items.columns if c not in hits.columns and c not in (id_col, "emb")]
    return hits.join(items.select(F.col(id_col).alias("item_id"), *extra), "item_id")


def name_videos(hits: DataFrame, videos: DataFrame, missing: str | None = None) -> DataFrame:
    """Hits with ``video_name``; for unknown videos ``missing``, or the id itself."""
    fallback = F.col("video_id") if missing is None else F.lit(missing)
    return hits.join(videos.select(F.col("id").alias("video_id"), F.col("name").alias("video_name")).dropDuplicates(["video_id"]), "video_id", "left").withColumn("video_name", F.coalesce("video_name", fallback))


def rerank(hits: DataFrame, weight: float = 0.5) -> DataFrame:
    """Adds ``final_score``: (1 - weight) * score scaled to 0..1 over the hits + weight * ``p_yes`` (0.5 when null); best first, ties in former order (``rank``).

    The range of the scores is one aggregate row, joined by a one-row broadcast.
    """
    span = hits.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    final = F.lit(1 - weight) * scaled + F.lit(weight) * F.coalesce("p_yes", F.lit(0.5))
    return hits.join(F.broadcast(span)).withColumn("final_score", final).drop("lo", "hi").orderBy(F.desc("final_score"), F.asc("rank"))


def numbered(hits: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Hits numbered from 1 in order (within ``by``)."""
    return hits.withColumn(name, F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(*order)))


def top_n_per_frame(boxes: DataFrame, n: int, frame: list[str]) -> DataFrame:
    """The ``n`` boxes of highest confidence of each frame; ties by ``pos``."""
    return numbered(boxes, [F.desc("conf"), F.asc("pos")], frame, "place").where(F.col("place") <= n)
