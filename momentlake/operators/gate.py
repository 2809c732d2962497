"""Frame sampling and the motion gate, in batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.operators.ordered import ordered_pass

METHODS = ("score", "diff", "background")


def sample_frames(frames: DataFrame, fps: Column, sample_fps: float, idx: str = "frame_idx") -> DataFrame:
    """The frames that sampling at ``sample_fps`` picks, with their time ``t``.

    Picks stand ``step = max(fps / sample_fps, 1)`` apart; frame ``i`` is one if a multiple of ``step`` (less 1e-6) lies in (i - 1, i].
    """
    rate = F.when(F.coalesce(fps, F.lit(0.0)) > 0, fps).otherwise(25.0)
    step = F.greatest(rate / F.lit(max(sample_fps, 1e-6)), F.lit(1.0))
    i = F.col(idx)
    picked = (i == 0) | (F.floor((i + 1e-6) / step) > F.floor((i - 1 + 1e-6) / step))
    return frames.where(picked).withColumn("t", i / rate)


def step_sample(df: DataFrame, by: str, n: int, total: int) -> DataFrame:
    """Every ``max(1, total // n)``-th row by ``by``, which numbers the rows from 0."""
    return df.where(F.col(by) % max(1, total // max(n, 1)) == 0)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a hash of their key, in order of the key; the same ones on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n).orderBy(key)


class Mixture:
    """Adaptive mixture of Gaussians per cell (at most ``MODES`` each), as published for background subtraction.

    Each frame moves the mode it fits, weights decay, modes that lost their weight vanish, and a cell that fits no mode opens
    one. A cell is background if it lies within ``spread`` variances of one of the weightiest modes that make up ``SHARE``.
    """

    # The defaults of the published method.
    MODES, SHARE, FITS, START, LEAST, MOST, DECAY = 5, 0.9, 9.0, 15.0, 4.0, 75.0, 0.05

    def __init__(self, cells: int, spread: float = 32.0, history: int = 50):
        self.spread, self.history, self.frames = spread, history, 0
        self.weight, self.mean, self.var = (np.zeros((self.MODES, cells)) for _ in range(3))

    def foreground(self, x: np.ndarray) -> np.ndarray:
        """Which cells of the next frame are foreground; the model learns the frame."""
        self.frames += 1
        rate = 1 / min(2 * self.frames, self.history)
        had = self.weight > 0
        far = (x - self.mean) ** 2
        decayed = np.where(had, (1 - rate) * self.weight - rate * self.DECAY, 0)
        cell = np.arange(len(x))
        close = had & (far < self.FITS * self.var)
        fits, at = close.any(0), close.argmax(0)  # the weightiest mode that fits
        decayed[at[fits], cell[fits]] += rate
        ahead = np.vstack([np.zeros(len(x)), np.cumsum(np.where(decayed < rate * self.DECAY, 0, decayed), 0)[:-1]])
        tried = np.arange(self.MODES)[:, None] <= np.where(fits, at, self.MODES)
        background = (had & tried & (ahead < self.SHARE) & (far < self.spread * self.var)).any(0)
        m, c = at[fits], cell[fits]
        step = rate / decayed[m, c]
        self.mean[m, c] += step * (x[c] - self.mean[m, c])
        self.var[m, c] = np.clip(self.var[m, c] + step * (far[m, c] - self.var[m, c]), self.LEAST, self.MOST)
        self.weight = np.where(decayed < rate * self.DECAY, 0, decayed)
        self.weight /= np.maximum(self.weight.sum(0), 1e-300)
        new = cell[~fits]
        slot = np.minimum((self.weight[:, new] > 0).sum(0), self.MODES - 1) if len(new) else new
        # modes are kept in order of weight, so the first free slot is the last one, or the lightest mode's
        order = np.argsort(-self.weight, axis=0, kind="stable")
        self._reorder(order)
        self.weight[slot, new] = 0
        alone = self.weight[:, new].sum(0) == 0
        self.weight[:, new] *= 1 - rate
        self.weight[slot, new] = np.where(alone, 1, rate)
        self.mean[slot, new], self.var[slot, new] = x[new], self.START
        self.weight /= np.maximum(self.weight.sum(0), 1e-300)
        self._reorder(np.argsort(-self.weight, axis=0, kind="stable"))
        return ~background

    def _reorder(self, order: np.ndarray) -> None:
        self.weight, self.mean, self.var = (np.take_along_axis(m, order, 0) for m in (self.weight, self.mean, self.var))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.frames], self.weight.ravel(), self.mean.ravel(), self.var.ravel()]).tobytes()

    def restore(self, raw: bytes) -> None:
        held = np.frombuffer(raw, np.float64)
        self.frames = int(held[0])
        self.weight, self.mean, self.var = (m.copy() for m in held[1:].reshape(3, self.MODES, -1))


class Gate:
    """One video's gate. ``run`` takes frames in order of time, in as many pieces as they come.

    The time of the last kept frame, the kept frame that others are compared with (``diff``) and the background model
    (``background``) carry over from one piece to the next.
    """

    def __init__(self, *, enabled: bool = True, method: str = "score", min_fraction: float = 0.002, heartbeat: float = 30.0, diff_threshold: float = 25.0, history: int = 50):
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
        self.enabled, self.method, self.min_fraction, self.heartbeat = enabled, method, min_fraction, heartbeat
        self.diff_threshold, self.history = diff_threshold, history
        self.last: float | None = None
        self.reference: np.ndarray | None = None
        self.mixture: Mixture | None = None

    def _due(self, t: np.ndarray) -> int:
        """The first of the times whose heartbeat is due (their number, if none)."""
        if self.last is None:
            return 0
        i = int(np.searchsorted(t, self.last + self.heartbeat))
        while i and t[i - 1] - self.last >= self.heartbeat:
            i -= 1
        while i < len(t) and t[i] - self.last < self.heartbeat:
            i += 1
        return i

    def _changed(self, cells: list[np.ndarray]) -> np.ndarray:
        """Share of each frame's cells that differ from the reference by more than the threshold; 1 without one, or one of another size."""
        if self.reference is None or any(len(c) != len(self.reference) for c in cells):
            return np.array([1.0 if self.reference is None or len(c) != len(self.reference) else float(np.count_nonzero(np.abs(c - self.reference) > self.diff_threshold)) / max(len(c), 1) for c in cells])
        return np.count_nonzero(np.abs(np.stack(cells) - self.reference) > self.diff_threshold, axis=1) / max(len(self.reference), 1)

    def _learned(self, x: np.ndarray) -> float:
        if self.mixture is None or self.mixture.weight.shape[1] != len(x):
            self.mixture = Mixture(len(x), history=self.history)
        return float(np.count_nonzero(self.mixture.foreground(x))) / max(len(x), 1)

    def run(self, t: np.ndarray, signal: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per frame the motion score, whether it is kept, and whether only because of the heartbeat."""
        n = len(t)
        kept, beat = np.zeros(n, bool), np.zeros(n, bool)
        if self.method == "diff":
            cells = [np.asarray(s if s is not None else [], np.float64) for s in signal]
            score = np.empty(n)
            at, width = 0, 1
            while at < n:  # frames up to the next kept one have the same reference
                part = score[at : at + width] = self._changed(cells[at : at + width])
                found = self._walk(t[at : at + width], part, kept[at : at + width], beat[at : at + width], 1)
                if found is None:
                    at, width = at + len(part), min(2 * width, 256)
                else:
                    self.reference = cells[at + found]
                    at, width = at + found + 1, 1
            return score, kept, beat
        if self.method == "background":
            score = np.array([self._learned(np.asarray(s if s is not None else [], np.float64)) for s in signal])
        else:
            score = np.array([s if s is not None else 0.0 for s in signal], np.float64) if not isinstance(signal, np.ndarray) else np.nan_to_num(signal, nan=0.0)
        self._walk(t, score, kept, beat)
        return score, kept, beat

    def _walk(self, t: np.ndarray, score: np.ndarray, kept: np.ndarray, beat: np.ndarray, most: int | None = None) -> int | None:
        """Marks the kept frames, jumping from one to the next; with ``most`` it stops after as many. Gives the last one marked."""
        moved = np.nonzero(score >= self.min_fraction)[0] if self.enabled else np.arange(len(t))
        i, last, done = 0, None, 0
        while i < len(t) and (most is None or done < most):
            m = np.searchsorted(moved, i)
            motion = int(moved[m]) if m < len(moved) else len(t)
            first = self.last is None
            due = i + self._due(t[i:])
            i = min(motion, due)
            if i == len(t):
                break
            kept[i], beat[i] = True, self.enabled and not first and i != motion
            self.last, last, done, i = float(t[i]), i, done + 1, i + 1
        return last


def motion_gate(frames: DataFrame, key: str, t: str, signal: str, tie: str, **settings) -> DataFrame:
    """``(key, t, signal, tie, score, kept, by_heartbeat)`` for the frames of each video in order of ``t`` (ties: ``tie``).

    ``signal`` is the motion score itself (``method="score"``) or the frame's cells (``"diff"``: against the last kept frame,
    ``"background"``: against an adaptive mixture of Gaussians). One pass per video; a null time takes no part.
    """
    Gate(**settings)
    plain = settings.get("method", "score") == "score"
    rows = frames.where(F.col(t).isNotNull() & F.col(key).isNotNull())

    def walk(gate: Gate, at, value, _):
        at = at.to_numpy(zero_copy_only=False).astype(np.float64)
        if plain:
            return list(gate.run(at, value.to_numpy(zero_copy_only=False).astype(np.float64)))
        values = value.values.to_numpy(zero_copy_only=False)
        cuts = value.offsets.to_numpy()
        return list(gate.run(at, [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))

    return ordered_pass(rows, [key], [F.asc(t), F.asc(tie)], [t, signal, tie], lambda: Gate(**settings), walk, "score double, kept boolean, by_heartbeat boolean")


def gate_stats(gated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``frames_seen, frames_kept, frames_skipped, kept_by_heartbeat, skip_ratio`` (per ``by``)."""
    count = lambda c: F.count_if(c)
    seen, kept = F.count("*"), count(F.col("kept"))
    grouped = gated.groupBy(*by) if by else gated.groupBy()
    return grouped.agg(
        seen.alias("frames_seen"), kept.alias("frames_kept"), (seen - kept).alias("frames_skipped"), count(F.col("by_heartbeat")).alias("kept_by_heartbeat"),
        F.coalesce(F.round(F.try_divide(seen - kept, seen), 4), F.lit(0.0)).alias("skip_ratio"),
    )


def idle_padded(frames: DataFrame, copies: int, cells: str, idx: str, sigma: float = 2.0, seed: int = 0) -> DataFrame:
    """The frames of each video between ``copies`` noisy copies of the first and of the last one, numbered anew."""
    ends = frames.groupBy("video_id").agg(F.min_by(cells, idx).alias("first"), F.max_by(cells, idx).alias("last"), F.max(idx).alias("n"), F.min(idx).alias("low"))
    noisy = lambda c: F.transform(c, lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x + F.randn(seed) * sigma)))
    number = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k")
    lead = ends.select("video_id", number, "first").select("video_id", F.col("k").cast("int").alias(idx), noisy(F.col("first")).alias(cells))
    tail = ends.select("video_id", number, "last", "n", "low").select("video_id", (F.col("k") + copies + F.col("n") - F.col("low") + 1).cast("int").alias(idx), noisy(F.col("last")).alias(cells))
    body = frames.join(ends.select("video_id", "low"), "video_id").select("video_id", (F.col(idx) - F.col("low") + copies).cast("int").alias(idx), cells)
    return lead.unionByName(body).unionByName(tail)
