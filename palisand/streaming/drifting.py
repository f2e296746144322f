"""A drifting portfolio's value in a stream of returns: an extension, not part of the batch library.

For each strategy Spark keeps weights, value and peak.  Rows wait in the state until the watermark has passed their date, and are then
taken in order of dates, so what comes out does not depend on the order in which rows arrive within the delay, nor on where the stream was
stopped and started again from its checkpoint.  Rows that are later than the delay are dropped by the watermark.  The state store must be RocksDB
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "strategy string, date timestamp, value double, drawdown double, turnover double"


class Drifting(StatefulProcessor):
    """Returns to the target weights whenever one is off by more than drift, at cost_bps of the turnover."""

    def __init__(self, drift: float, cost_bps: float) -> None:
        self.drift, self.cost = drift, cost_bps / 1e4

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "w array<double>, value double, peak double")
        self.waiting = handle.getMapState("waiting", "at long", "r array<double>, w array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for frame in rows:
            for at, r, w in zip(frame["date"], frame["r"], frame["w"], strict=True):
                ms = int(pd.Timestamp(at).value // 1_000_000)
                self.waiting.updateValue((ms,), ([float(x) for x in r], [float(x) for x in w]))
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = int(expiredTimerInfo.getExpiryTimeInMs())
        if not self.waiting.containsKey((ms,)):
            return
        r, target = (np.array(x, dtype=float) for x in self.waiting.getValue((ms,)))
        self.waiting.removeKey((ms,))
        if self.held.exists():
            w, value, peak = self.held.get()
            w = np.array(w, dtype=float)
        else:
            w, value, peak = target.copy(), 1.0, 0.0
        value = value * (1 + float(w @ r))
        w = w * (1 + r)
        w = w / w.sum() if w.sum() > 0 else target.copy()
        turnover = None
        if np.abs(w - target).max() > self.drift:
            turnover = float(np.abs(w - target).sum())
            value, w = value * (1 - turnover * self.cost), target.copy()
        peak = max(peak, value)
        self.held.update(([float(x) for x in w], float(value), float(peak)))
        yield pd.DataFrame({"strategy": [key[0]], "date": [pd.Timestamp(ms, unit="ms")], "value": [value], "drawdown": [value / peak - 1 if peak else 0.0], "turnover": [turnover]})

    def close(self) -> None:
        pass


def drifting(rows: DataFrame, drift: float, cost_bps: float = 10.0, delay: str = "3 days") -> DataFrame:
    """strategy, date, value, drawdown and turnover (null without rebalancing) of a stream of strategy, date (timestamp), r and w (arrays in one order of assets)."""
    stream = rows.select("strategy", "date", "r", "w").withWatermark("date", delay).groupBy("strategy")
    return stream.transformWithStateInPandas(Drifting(drift, cost_bps), OUT, "append", "EventTime")
