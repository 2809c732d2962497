"""Detection boxes: geometry as JVM expressions, suppression and agreement as passes over Arrow batches of many frames.

A frame's boxes are bounded by what a detector gives for one frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.operators.ordered import whole_groups
from momentlake.schema import CLASS_NAMES


def label_of(cls: Column) -> Column:
    """The name of a class, or its number as text."""
    names = F.create_map(*(x for k, v in CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(names, cls.cast("int")), cls.cast("string"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 if the union is empty."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = (w * h).cast("double")
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - both
    return F.when(union != 0, both / union).otherwise(F.lit(0.0))


def square_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = 0.15) -> Column:
    """The padded square around a box and how far it runs over each edge of the frame: ``side, a, b, c, d, left, top, right, bottom``."""
    side = F.greatest(F.lit(1), F.rint(F.greatest(x2 - x1, y2 - y1) * F.lit(1 + 2 * pad)).cast("int"))
    a = F.rint((x1 + x2) / 2 - side / 2).cast("int")
    b = F.rint((y1 + y2) / 2 - side / 2).cast("int")
    over = lambda v: F.greatest(F.lit(0), v)
    return F.struct(
        side.alias("side"), a.alias("a"), b.alias("b"), (a + side).alias("c"), (b + side).alias("d"),
        over(-a).alias("left"), over(-b).alias("top"), over(a + side - width).alias("right"), over(b + side - height).alias("bottom"),
    )


def letterbox(width: Column, height: Column, size: int = 640) -> Column:
    """How a frame is fitted into a square input: ``ratio, nw, nh, left, top``."""
    ratio = F.least(F.lit(float(size)) / height, F.lit(float(size)) / width)
    nw, nh = F.rint(width * ratio).cast("int"), F.rint(height * ratio).cast("int")
    half = lambda v: F.floor((F.lit(size) - v) / 2).cast("int")
    return F.struct(ratio.alias("ratio"), nw.alias("nw"), nh.alias("nh"), half(nw).alias("left"), half(nh).alias("top"))


def thumb_size(width: Column, height: Column, thumb: int = 320) -> Column:
    """Size of a thumbnail: ``w, h``."""
    return F.struct(F.lit(thumb).alias("w"), F.floor(height * F.lit(thumb) / width).cast("int").alias("h"))


def proxy_size(width: Column, height: Column, most: int = 960) -> Column:
    """Size of a playback copy: not enlarged, even numbers: ``w, h``."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / width)
    even = lambda v: (F.floor(F.floor(v * scale) / 2) * 2).cast("int")
    return F.struct(even(width).alias("w"), even(height).alias("h"))


def scaled(c: Column, thumb_width: Column, video_width: Column) -> Column:
    """A coordinate drawn on a thumbnail."""
    return F.rint(c * thumb_width / video_width).cast("int")


def decode(preds: DataFrame, *, conf: float, classes: list[int] | None = None) -> DataFrame:
    """Raw predictions ``(frame..., pos, cx, cy, w, h, scores array, ratio, pad_x, pad_y)`` to float boxes in the frame.

    The class is the first of highest score; rows under ``conf`` or of other classes vanish.
    """
    best = F.array_max("scores")
    rows = preds.withColumn("conf", best).withColumn("cls", (F.array_position("scores", best) - 1).cast("int")).where(F.col("conf") >= conf)
    if classes is not None:
        rows = rows.where(F.col("cls").isin(*classes))
    left, top = (F.col("cx") - F.col("w") / 2 - F.col("pad_x")) / F.col("ratio"), (F.col("cy") - F.col("h") / 2 - F.col("pad_y")) / F.col("ratio")
    return rows.select(
        *[c for c in preds.columns if c not in ("cx", "cy", "w", "h", "scores", "ratio", "pad_x", "pad_y")], "cls", "conf",
        left.alias("x1"), top.alias("y1"), (left + F.col("w") / F.col("ratio")).alias("x2"), (top + F.col("h") / F.col("ratio")).alias("y2"),
    )


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``iou`` of rows (x1, y1, x2, y2) pair by pair; not a number where a coordinate is missing."""
    w = np.maximum(0, np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]))
    h = np.maximum(0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))
    both = w * h
    union = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - both
    return np.divide(both, union, out=np.where(np.isnan(union), np.nan, 0.0), where=~(np.isnan(union) | (union == 0)))


def _corners(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(np.float64) for c in ("x1", "y1", "x2", "y2")], axis=1)


def suppress(boxes: DataFrame, frame: list[str], threshold: float = 0.5) -> DataFrame:
    """Greedy suppression per frame and class: by falling confidence (ties: ``pos``), a box stays unless its overlap with one that stayed exceeds ``threshold``.

    The frames of an Arrow batch are worked on together: in each round the best box left of every frame and class stays and
    takes out what it overlaps. A box with a missing coordinate overlaps none; a missing confidence comes last.
    """
    names = [*frame, "cls", "pos", "conf", "x1", "y1", "x2", "y2"]
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    ordered = boxes.select(*names).repartition(*frame).sortWithinPartitions(*frame, "cls", F.desc("conf"), "pos")

    def run(batches):
        for t, cuts in whole_groups(batches, [*frame, "cls"]):
            corners, stays = _corners(t), np.zeros(t.num_rows, bool)
            left = np.arange(t.num_rows)
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            while len(left):
                first = np.nonzero(np.r_[True, group[left[1:]] != group[left[:-1]]])[0]
                stays[left[first]] = True
                best = np.repeat(left[first], np.diff(np.r_[first, len(left)]))
                left = left[(left != best) & ~(_overlap(corners[left], corners[best]) > threshold)]
            yield from t.filter(pa.array(stays)).combine_chunks().to_batches()

    return ordered.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def clip(boxes: DataFrame, width: Column, height: Column, min_px: int = 0) -> DataFrame:
    """Whole-pixel boxes inside the frame (towards zero); too small ones vanish."""
    cut = boxes.select(
        *[c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")],
        F.greatest(F.lit(0.0), "x1").cast("int").alias("x1"), F.greatest(F.lit(0.0), "y1").cast("int").alias("y1"),
        F.least(width.cast("double"), "x2").cast("int").alias("x2"), F.least(height.cast("double"), "y2").cast("int").alias("y2"),
    )
    return cut.where(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= min_px)


def agreement(a: DataFrame, b: DataFrame, frame: list[str], threshold: float = 0.5) -> DataFrame:
    """``(tp, na, nb, recall, precision)`` of boxes ``a`` against ``b``.

    Per frame, the boxes of ``a`` in order (falling confidence, ``pos``) each take the unused box of ``b`` of their class with
    the highest overlap (the first on ties), if that reaches ``threshold``.
    """
    columns = [*frame, "cls", "conf", "pos", "x1", "y1", "x2", "y2"]
    kinds = {f.name: f.dataType.simpleString() for f in a.schema}
    side = lambda df, number: df.selectExpr(*(f"CAST(`{c}` AS {kinds[c]}) AS `{c}`" for c in columns), f"{number} AS side")
    rows = side(a, 0).unionByName(side(b, 1)).repartition(*frame).sortWithinPartitions(*frame, "side", F.desc("conf"), "pos")

    def run(batches):
        for t, cuts in whole_groups(batches, frame):
            corners, right = _corners(t), t.column("side").to_numpy() == 1
            cls = t.column("cls").to_numpy(zero_copy_only=False)
            nb = np.add.reduceat(right.astype(np.int64), cuts[:-1])
            na = np.diff(cuts) - nb
            # every pair of a frame once, those that count in the order in which they are tried
            per = np.repeat(nb, na)
            x = np.repeat(np.nonzero(~right)[0], per)
            start = np.repeat(np.repeat(cuts[:-1] + na, na), per)
            y = start + np.arange(len(x)) - np.repeat(np.cumsum(per) - per, per)
            same = cls[x] == cls[y]
            x, y = x[same], y[same]
            rated = _overlap(corners[x], corners[y])
            enough = rated >= threshold
            x, y, rated = x[enough], y[enough], rated[enough]
            order = np.lexsort((y, -rated, x))
            x, y = x[order], y[order]
            used, matched = np.zeros(t.num_rows, bool), 0
            turn = x - np.repeat(cuts[:-1], np.diff(cuts))[x] if len(x) else x
            for k in np.unique(turn):  # the k-th box of every frame at once
                mine = (turn == k) & ~used[y]
                own, nearest = x[mine], y[mine]
                first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
                used[nearest[first]] = True
                matched += int(first.sum())
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (matched, int(na.sum()), int(nb.sum()))], ["tp", "na", "nb"])

    per_frame = rows.mapInArrow(run, "tp long, na long, nb long")
    total = per_frame.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "na", "nb")))
    return total.select("tp", "na", "nb", F.round(F.try_divide("tp", "na"), 4).alias("recall"), F.round(F.try_divide("tp", "nb"), 4).alias("precision"))
