"""The capture gate: frames that stay sharp and still for a while open a burst, which fires at intervals up to a cap.

One state machine serves the stream and its batch twin. State is one small row a device."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHARP, STILL, FRAMES, INTERVAL_MS, BURST = 40.0, 6.0, 8, 400, 4
NONE, CAPTURE, FINALIZE = "none", "capture", "finalize"


@dataclass
class Gate:
    needed: int = FRAMES
    interval_ms: int = INTERVAL_MS
    burst: int = BURST
    sharp: float = SHARP
    still: float = STILL
    streak: int = 0
    open: bool = False
    fired: int = 0
    last_ms: int = -1

    def reset(self) -> None:
        self.streak, self.open, self.fired, self.last_ms = 0, False, 0, -1

    def on_frame(self, sharpness: float, stability: float, at_ms: int) -> str:
        """What a frame does. The cap is looked at before the interval; a frame inside the interval still counts."""
        if not (sharpness >= self.sharp and stability <= self.still):
            was_open = self.open
            self.reset()
            return FINALIZE if was_open else NONE
        self.streak += 1
        if not self.open and self.streak < self.needed:
            return NONE
        self.open = True
        if self.fired >= self.burst:
            self.reset()
            return FINALIZE
        if self.last_ms >= 0 and at_ms - self.last_ms < self.interval_ms:
            return NONE
        self.fired, self.last_ms = self.fired + 1, at_ms
        return CAPTURE

    def state(self) -> tuple:
        return self.streak, self.open, self.fired, self.last_ms


OUT = "device string, timestamp_ms bigint, action string"
STATE = "streak int, open boolean, fired int, last_ms bigint"


def _run(gate: Gate, device, frames: pd.DataFrame) -> pd.DataFrame:
    frames = frames.sort_values(["timestamp_ms", "sharpness", "stability"], kind="stable")
    actions = [gate.on_frame(s, t, int(ms)) for s, t, ms in zip(frames.sharpness, frames.stability, frames.timestamp_ms)]
    return pd.DataFrame({"device": [device] * len(frames), "timestamp_ms": frames.timestamp_ms.to_numpy(), "action": actions})


def gate_batch(frames: DataFrame, **settings) -> DataFrame:
    """(device, timestamp_ms, action) of frames (device, sharpness, stability, timestamp_ms), each device by time."""

    def run(key, pdf):
        return _run(Gate(**settings), key[0], pdf)

    return frames.groupBy("device").applyInPandas(run, OUT)


def gate_stream(frames: DataFrame, **settings) -> DataFrame:
    """The same over a stream; frames of one device must come in order from batch to batch."""

    def run(key, pdfs, state: GroupState):
        gate = Gate(**settings)
        if state.exists:
            gate.streak, gate.open, gate.fired, gate.last_ms = state.get
        yield _run(gate, key[0], pd.concat(list(pdfs)))
        state.update(gate.state())

    return frames.groupBy("device").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def streaks(frames: DataFrame, frames_needed: int = FRAMES, sharp: float = SHARP, still: float = STILL) -> DataFrame:
    """(device, start_ms, end_ms, n, opens): runs of passing frames, as islands; opens for those long enough."""
    at = Window.partitionBy("device").orderBy("timestamp_ms", "frame")
    passing = F.coalesce((F.col("sharpness") >= sharp) & (F.col("stability") <= still), F.lit(False))
    rows = frames.withColumn("_pass", passing)
    run = F.row_number().over(at) - F.row_number().over(Window.partitionBy("device", "_pass").orderBy("timestamp_ms", "frame"))
    found = rows.withColumn("_run", run).filter("_pass").groupBy("device", "_run").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("n"))
    return found.select("device", "start_ms", "end_ms", "n", (F.col("n") >= frames_needed).alias("opens"))


def mean_difference(a, b):
    """Mean absolute difference of two arrays of equal size, 0 for empty ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == 0, 0.0).otherwise(total / F.size(a))


def score_frames(frames: DataFrame) -> DataFrame:
    """frames (device, luma, timestamp_ms, ...) with stability against the frame before; the largest double for none or another size."""
    last = F.lag("luma").over(Window.partitionBy("device").orderBy("timestamp_ms"))
    same = last.isNotNull() & (F.size(last) == F.size("luma"))
    return frames.withColumn("stability", F.when(same, mean_difference(F.col("luma"), last)).otherwise(F.lit(1.7976931348623157e308)))


def sharpest(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, frame): the sharpest frame of each group, the first of equal ones."""
    return frames.groupBy(*by).agg(F.max_by("frame", F.struct("sharpness", -F.col("frame"))).alias("frame"))


def settings(gate: Gate) -> dict:
    return {k: asdict(gate)[k] for k in ("needed", "interval_ms", "burst", "sharp", "still")}
