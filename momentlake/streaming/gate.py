"""The motion gate of a live stream: the same state machine as in batch, kept per video (Structured Streaming).

State holds the time of the last kept frame, the frame others are compared with, and the background model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from momentlake.operators.gate import Gate, Mixture

OUTPUT = "video_id string, t double, frame_idx long, score double, kept boolean, by_heartbeat boolean"


class GateProcessor(StatefulProcessor):
    """Frames of a micro-batch are put in order before they pass; a frame older than the last one passed is dropped as late."""

    def __init__(self, settings: dict):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "last double, newest double, reference binary, model binary")

    def _restored(self) -> tuple[Gate, float]:
        gate = Gate(**self.settings)
        if not self.state.exists():
            return gate, -np.inf
        gate.last, newest, reference, model = self.state.get()
        if reference is not None:
            gate.reference = np.frombuffer(bytes(reference), np.float64)
        if model is not None:
            gate.mixture = Mixture(0, history=gate.history)
            gate.mixture.restore(bytes(model))
        return gate, newest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values(["t", "frame_idx"])  # a key's rows can come in several pieces
        gate, newest = self._restored()
        frames = frames[frames["t"] >= newest]
        t = frames["t"].to_numpy(np.float64)
        signal = frames["signal"].to_numpy()
        score, kept, beat = gate.run(t, signal.astype(np.float64) if gate.method == "score" else list(signal))
        newest = float(t[-1]) if len(t) else newest
        held = (gate.reference.tobytes() if gate.reference is not None else None, gate.mixture.to_bytes() if gate.mixture is not None else None)
        self.state.update((gate.last, newest, *held))
        yield pd.DataFrame({"video_id": key[0], "t": t, "frame_idx": frames["frame_idx"].to_numpy(np.int64), "score": score, "kept": kept, "by_heartbeat": beat})

    def close(self) -> None:
        pass


def gate_stream(frames: DataFrame, **settings) -> DataFrame:
    """A stream ``(video_id, t, frame_idx, signal)`` through the gate, by any of its methods. Needs the RocksDB state store."""
    return frames.groupBy("video_id").transformWithStateInPandas(GateProcessor(settings), OUTPUT, "Append", "None")


def ingest(frames: DataFrame, encode: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, **settings):
    """Start the live pipeline: gate, encode what is kept, append to the item table; back-pressure by the source's files per trigger."""
    return gate_stream(frames, **settings).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: encode(batch.where("kept")).write.mode("append").parquet(table)
    )
