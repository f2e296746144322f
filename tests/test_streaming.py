"""A stream that is stopped and started again gives the rows of the batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from palisand.streaming.drifting import drifting

N = 40


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def by_loop(r, target, drift, cost):
    w, value, peak, out = target.copy(), 1.0, 0.0, []
    for x in r:
        value *= 1 + w @ x
        w = w * (1 + x)
        w /= w.sum()
        t = np.nan
        if np.abs(w - target).max() > drift:
            t = np.abs(w - target).sum()
            value, w = value * (1 - t * cost), target.copy()
        peak = max(peak, value)
        out.append((value, value / peak - 1, t))
    return np.array(out)


def test_a_stopped_stream_goes_on_as_if_it_had_not_stopped(spark, rocks, tmp_path):
    rng = np.random.default_rng(4)
    days = pd.date_range("2024-01-01", periods=N)
    r = rng.normal(0, 0.03, (N, 2))
    weights = {"a": np.array([0.5, 0.5]), "b": np.array([0.9, 0.1])}
    schema = "strategy string, date timestamp, r array<double>, w array<double>"
    (tmp_path / "in").mkdir()

    def arrive(name, places):
        rows = [(s, days[i].to_pydatetime(), r[i].tolist(), w.tolist()) for i in places for s, w in weights.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        q = drifting(stream, 0.02).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    arrive("one", [2, 0, 1, 4, 3, *range(5, 18)])  # out of order within the delay
    run()
    arrive("two", [20, 18, 19, *range(21, N)])
    run()
    far = pd.Timestamp("2030-01-01").to_pydatetime()
    spark.createDataFrame([(s, far, [0.0, 0.0], w.tolist()) for s, w in weights.items()], schema).write.json(str(tmp_path / "in" / "end"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("date")
    for s, w in weights.items():
        own = got[got["strategy"] == s]
        assert own["date"].tolist() == days.tolist()
        assert np.allclose(own[["value", "drawdown", "turnover"]].to_numpy(dtype=float), by_loop(r, w, 0.02, 0.001), atol=1e-12, equal_nan=True)
