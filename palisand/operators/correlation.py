"""Dynamic conditional correlations, DCC(1, 1), by a scan over blocks of dates.

Q_(t + 1) = (1 - a - b) target + a z_t z_t' + b Q_t from Q_0 = target is d_t target + a S_t, where d_t is known in closed form and
S_(t + 1) = b S_t + z_t z_t' from S_0 = 0.  A block of dates takes S to b^length S + C, an affine map; such maps compose, so blocks are
reduced to C in tasks, the states that enter the blocks are found for each b and row of the matrix apart, and every block then knows all its Q.
Likelihoods of a whole grid of (a, b) are summed in one plan; the grid narrows around the best.  No task holds all dates; what reaches the driver are the
target (assets x assets) and a number for each point of the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.operators import panel
from palisand.operators.blocks import flat, numbered, summed
from palisand.operators.optimize import dense
from palisand.storage import staged

#: Points of a grid in each direction, times it narrows (to two of its steps), and what a + b stays below.
GRID, ROUNDS, MOST = 9, 6, 0.999


def ordered(residuals: DataFrame, lookback: int | None = None) -> DataFrame:
    """block, i, date, z (in the order of assets) of residuals (asset, date, z) on the last lookback dates."""
    return numbered(dense(panel.last_dates(residuals, lookback) if lookback else residuals, value="z").withColumnRenamed("r", "z"), "date")


def target(rows: DataFrame, half_life: float | None = None) -> np.ndarray:
    """Correlations of z around its mean, dates weighted equally or halved every half_life dates back."""
    n = rows.count()

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(frame["z"].to_numpy())
        p = np.ones(len(z)) if half_life is None else 0.5 ** ((n - 1 - frame["i"].to_numpy()) / half_life)
        return flat(np.concatenate([[p.sum()], p @ z, ((z * p[:, None]).T @ z).ravel()]))

    found = summed(rows.groupBy("block").applyInPandas(sums, "k long, v double"))
    x = np.array([found[k] for k in range(len(found))])
    k = round((-1 + np.sqrt(4 * len(x) - 3)) / 2)  # 1 + k + k * k numbers
    mean = x[1 : k + 1] / x[0]
    cov = x[k + 1 :].reshape(k, k) / x[0] - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


def states(rows: DataFrame, bs: Sequence[float]) -> DataFrame:
    """block, b (number in bs), row, s: the rows of S as it enters each block."""

    def reduced(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        z = np.stack(frame["z"].to_numpy())
        age = np.arange(len(z))[::-1]
        out = [(int(frame["block"].iloc[0]), j, r, len(z), c) for j, b in enumerate(bs) for r, c in enumerate((z * (b**age)[:, None]).T @ z)]
        return pd.DataFrame(out, columns=["block", "b", "row", "n", "s"])

    def entering(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        b, s, out = bs[frame["b"].iloc[0]], 0.0, []
        for n, c in zip(frame["n"], frame["s"], strict=True):
            out.append(np.broadcast_to(s, len(c)).copy())
            s = b**n * s + np.asarray(c)
        return frame.drop(columns="n").assign(s=out)

    parts = rows.groupBy("block").applyInPandas(reduced, "block int, b int, row int, n int, s array<double>")
    return parts.groupBy("b", "row").applyInPandas(entering, "block int, b int, row int, s array<double>")


def _walked(rows: DataFrame, rho: np.ndarray, points: Sequence[tuple[float, float]], out, schema: str) -> DataFrame:
    """out(frame of a block, z, correlations of its dates for points[k], k) for every block and point."""
    bs = sorted({b for _, b in points})

    def walk(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        z, t = np.stack(frame["z"].to_numpy()), frame["i"].to_numpy()
        got = []
        for j, b in enumerate(bs):
            s, path = np.stack(known[known["b"] == j].sort_values("row")["s"].to_numpy()), np.empty((len(z), *rho.shape))
            for m, row in enumerate(z):
                path[m] = s
                s = b * s + np.outer(row, row)
            for k, (a, own) in enumerate(points):
                if own == b:
                    d = (1 - a - b) * (1 - b**t) / (1 - b) + b**t
                    q = d[:, None, None] * rho + a * path
                    sd = np.sqrt(np.diagonal(q, axis1=1, axis2=2))
                    got.append(out(frame, z, q / (sd[:, :, None] * sd[:, None, :]), k))
        return pd.concat(got)

    return rows.groupBy("block").cogroup(states(rows, bs).groupBy("block")).applyInPandas(walk, schema)


def likelihoods(rows: DataFrame, rho: np.ndarray, points: Sequence[tuple[float, float]], half_life: float | None = None) -> DataFrame:
    """k, v: the correlation part of the normal log-likelihood for each (a, b) of points, dates weighted by one or by halves."""
    n = rows.count() if half_life else 0

    def one(frame: pd.DataFrame, z: np.ndarray, r: np.ndarray, k: int) -> pd.DataFrame:
        p = 1.0 if half_life is None else 0.5 ** ((n - 1 - frame["i"].to_numpy()) / half_life)
        sign, log = np.linalg.slogdet(r)
        like = -0.5 * (log + (z * np.linalg.solve(r, z[:, :, None])[:, :, 0]).sum(axis=1))
        return pd.DataFrame({"k": [k], "v": [float((p * np.where(sign > 0, like, -1e10)).sum())]})

    return _walked(rows, rho, points, one, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))


def path(rows: DataFrame, rho: np.ndarray, a: float, b: float) -> DataFrame:
    """date, i, j, rho, a, b for i < j by order of assets."""

    def one(frame: pd.DataFrame, z: np.ndarray, r: np.ndarray, k: int) -> pd.DataFrame:
        i, j = np.triu_indices(len(rho), 1)
        return pd.DataFrame({"date": np.repeat(frame["date"].to_numpy(), len(i)), "i": np.tile(i, len(z)), "j": np.tile(j, len(z)), "rho": r[:, i, j].ravel(), "a": a, "b": b})

    return _walked(rows, rho, [(a, b)], one, "date date, i int, j int, rho double, a double, b double")


def fit(rows: DataFrame, rho: np.ndarray, bounds=((1e-6, 0.5), (1e-6, 0.99)), most: float = MOST, half_life: float | None = None, rounds: int = ROUNDS) -> tuple[float, float]:
    """a and b of the largest likelihood within bounds and a + b <= most, by narrowing grids and a last quadratic step."""
    sides = [list(x) for x in bounds]
    for _ in range(rounds):
        a_, b_ = (np.linspace(*x, GRID) for x in sides)
        points = sorted({(float(a), float(min(b, most - a))) for a in a_ for b in b_ if min(b, most - a) >= bounds[1][0]})
        score = {points[r.k]: r.v for r in likelihoods(rows, rho, points, half_life).collect()}
        best = max(points, key=score.__getitem__)
        steps = [(hi - lo) / (GRID - 1) for lo, hi in sides]
        sides = [[max(lo, x - s), min(hi, x + s)] for x, s, (lo, hi) in zip(best, steps, bounds, strict=True)]
    near = [p for p in points if all(abs(x - y) <= 1.5 * s for x, y, s in zip(p, best, steps, strict=True))]
    if len(near) < 6 or best[0] + best[1] >= most - 1e-9:
        return best
    d = (np.array(near) - best) / steps
    c = np.linalg.lstsq(np.column_stack([np.ones(len(d)), d, d[:, 0] ** 2, d[:, 0] * d[:, 1], d[:, 1] ** 2]), np.array([score[p] for p in near]), rcond=None)[0]
    curve = np.array([[2 * c[3], c[4]], [c[4], 2 * c[5]]])
    if np.linalg.eigvalsh(curve).max() >= 0:
        return best
    a, b = (float(np.clip(x + s * y, lo, hi)) for x, s, y, (lo, hi) in zip(best, steps, np.clip(np.linalg.solve(curve, -c[1:3]), -1, 1), bounds, strict=True))
    return a, min(b, most - a)


def dcc(residuals: DataFrame, half_life: float | None = None, lookback: int | None = None, bounds=((1e-6, 0.5), (1e-6, 0.99)), most: float = MOST, weighted: bool = False) -> DataFrame:
    """date, i, j, rho, a, b of standardised residuals (asset, date, z) on the last lookback dates: the target is their correlation under
    probabilities halved every half_life dates back (None: equal ones), which weight the likelihood too if weighted."""
    rows = ordered(residuals, lookback)
    rho = target(rows, half_life)
    return staged(path(rows, rho, *fit(rows, rho, bounds, most, half_life if weighted else None)), "correlations")
