"""The engine: indexing frames and searching moments, lazily, over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.functions import vectors
from momentlake.operators import gate, ranking
from momentlake.sources import config as configs


class Encoder(Protocol):
    """Turns texts or frames into unit vectors; loaded lazily once per worker."""

    dim: int

    def encode(self, inputs: list) -> np.ndarray: ...


class HashEncoder:
    """Deterministic stand-in without a model: words hashed to random directions, summed and normalised."""

    def __init__(self, dim: int = 512):
        self.dim = dim

    def encode(self, inputs: list) -> np.ndarray:
        out = np.zeros((len(inputs), self.dim))
        for i, text in enumerate(inputs):
            for w in (text or "").lower().split():
                out[i] += np.random.default_rng(xxhash.xxh32_intdigest(w)).standard_normal(self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class OnnxEncoder:
    """A model file run by onnxruntime; needs the file, which is not part of this repository."""

    def __init__(self, path: str, dim: int = 512):
        self.path, self.dim, self._session = path, dim, None

    def encode(self, inputs: list) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path)
        feed = {self._session.get_inputs()[0].name: np.stack(inputs)}
        out = np.asarray(self._session.run(None, feed)[0], np.float64)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encoded(df: DataFrame, column: str, encoder: Encoder, out: str = "emb", batch: int = 64) -> DataFrame:
    """``df`` with the vector of ``column``; the model sees full batches only (the last is padded with its last row, the surplus is cut)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{out}` array<float>"
    names = df.columns

    def run(batches):
        for b in batches:
            values = b.column(names.index(column)).to_pylist()
            parts = []
            for i in range(0, len(values), batch):
                chunk = values[i : i + batch]
                parts.append(encoder.encode(chunk + [chunk[-1]] * (batch - len(chunk)))[: len(chunk)])
            m = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, encoder.dim), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, encoder.dim, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, out])

    return df.mapInArrow(run, schema)


def verified(hits: DataFrame, verify: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Hits with ``p_yes, answer, error`` of a second stage; a failing batch gives its error as data and no opinion."""
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", p_yes double, answer string, error string"

    def run(frames):
        for f in frames:
            try:
                r = verify(f)
                yield f.assign(p_yes=r["p_yes"].astype(float), answer=r["answer"], error=None)
            except Exception as e:  # an unreachable verifier must not fail the search
                yield f.assign(p_yes=float("nan"), answer=None, error=str(e))

    return hits.mapInPandas(run, schema).withColumn("p_yes", F.when(~F.isnan("p_yes"), F.col("p_yes")))


class Engine:
    """Search over an item and a video table."""

    def __init__(self, items: DataFrame, videos: DataFrame | None = None, *, encoder: Encoder | None = None, config: dict | None = None):
        self.items, self.videos = items, videos
        self.config = configs.merged(configs.DEFAULTS, config or {})
        self.encoder = encoder or HashEncoder(self.config["index"]["dim"])

    def search(self, query: str | list[float], *, top_k: int | None = None, video_ids: list[str] | None = None, use_crops: bool | None = None, merge_seconds: float | None = None, verifier: Callable | None = None) -> DataFrame:
        """Hits, best first: filter, score, best per timestamp, merge, limit, names, optional second stage.

        The filters come before scoring, so they reach the scan; the result is the same, as scoring is exact. An item's other
        columns travel with its score, which spares a second scan; the vector does not. There is one exchange of scored rows,
        one of hits, and the limit.
        """
        s = self.config["search"]
        vector = self.encoder.encode([query])[0] if isinstance(query, str) else np.asarray(query, np.float64)
        scored, extra = self._scored(vector, video_ids, use_crops)
        k = ranking.wanted(top_k or s["top_k"])
        hits = ranking.moments(scored.selectExpr("*", "scores[0] AS score"), s["merge_seconds"] if merge_seconds is None else merge_seconds, k, extra)
        order = [F.desc("score"), F.asc("item_id")]
        if self.videos is not None:
            hits = ranking.name_videos(hits, self.videos)
            hits = hits.repartition(1).sortWithinPartitions(*order) if k else hits.orderBy(*order)  # k rows in one place
        if verifier is not None:
            return ranking.rerank(verified(ranking.numbered(hits, order), verifier), self.config["verify"]["weight"])
        return hits

    def search_many(self, queries: list[str] | np.ndarray, *, top_k: int | None = None, video_ids: list[str] | None = None, use_crops: bool | None = None, merge_seconds: float | None = None) -> DataFrame:
        """``search`` for a batch of queries in one job: hits with ``query`` (place in the batch, from 0) and ``rank``.

        The items are scanned and scored once for all queries, a matrix product per Arrow batch; the scores of the queries are
        then told apart by a further key.
        """
        s = self.config["search"]
        vectors_in = self.encoder.encode(queries) if len(queries) and isinstance(queries[0], str) else np.asarray(queries, np.float64)
        scored, extra = self._scored(vectors_in, video_ids, use_crops)
        rows = scored.selectExpr("item_id", "video_id", "t", *(f"`{c}`" for c in extra), "posexplode(scores) AS (query, score)")
        return ranking.moments(rows, s["merge_seconds"] if merge_seconds is None else merge_seconds, ranking.wanted(top_k or s["top_k"]), extra, "query")

    def _scored(self, wanted: np.ndarray, video_ids: list[str] | None, use_crops: bool | None) -> tuple[DataFrame, tuple[str, ...]]:
        crops = self.config["search"]["use_crops"] if use_crops is None else use_crops
        rows = ranking.of_kinds(self.items, None if crops else ("frame",), video_ids)
        extra = tuple(c for c in ("kind", "label", "x1", "y1", "x2", "y2", "thumb", "frame_idx") if c in self.items.columns)
        columns = rows.selectExpr("id AS item_id", "video_id", "t", *(f"`{c}`" for c in extra), "emb")
        return vectors.score(columns, "emb", wanted, metric=self.config["index"]["metric"], out="scores"), extra

    def gated(self, frames: DataFrame, signal: str) -> DataFrame:
        """The frames ``(video_id, t, frame_idx, signal)`` the motion gate keeps."""
        m = self.config["motion"]
        g = gate.motion_gate(frames, "video_id", "t", signal, "frame_idx", enabled=m["enabled"], method=m["method"], min_fraction=m["min_fraction"], heartbeat=m["heartbeat"])
        return g.where("kept")
