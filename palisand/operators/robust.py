"""Student t location, dispersion and factor models by iterated reweighting.

A round weights each date by its distance under the present parameters.  All that the next parameters need are weighted sums over dates of
products of (1, returns, factors), which blocks of dates add up in tasks; what reaches the driver is one square matrix of
them, whatever the number of dates, and the stopping rule looks at that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.operators.blocks import flat, numbered, summed
from palisand.operators.optimize import dense


@dataclass(frozen=True)
class Sums:
    """Weighted sums over dates: m of (1, v)(1, v)', squares of the weights u = w p, and of w u."""

    m: np.ndarray
    squares: float
    again: float

    @property
    def total(self) -> float:
        return self.m[0, 0]

    @property
    def mean(self) -> np.ndarray:
        return self.m[0, 1:] / self.total

    @property
    def cov(self) -> np.ndarray:
        """Around the weighted mean, divided by the weights' sum."""
        return self.m[1:, 1:] / self.total - np.outer(self.mean, self.mean)

    @property
    def unbiased(self) -> np.ndarray:
        """The covariance with the correction for weights (1 - sum of squared shares)."""
        return self.cov / (1 - self.squares / self.total**2)


def sums(rows: DataFrame, n: int, half_life: float, weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> Sums:
    """Of rows block, i, v (n in all), dates being halved every half_life back (summing to one) and weighted by weigh(values of a block's dates)."""
    whole = (1 - 0.5 ** (n / half_life)) / (1 - 0.5 ** (1 / half_life))

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame["v"].to_numpy())
        w = np.ones(len(v)) if weigh is None else weigh(v)
        u = w * 0.5 ** ((n - 1 - frame["i"].to_numpy()) / half_life) / whole
        y = np.column_stack([np.ones(len(v)), v])
        return flat(np.concatenate([[(u**2).sum(), (w * u).sum()], ((y * u[:, None]).T @ y).ravel()]))

    found = summed(rows.groupBy("block").applyInPandas(part, "k long, v double"))
    x = np.array([found[k] for k in range(len(found))])
    size = round(np.sqrt(len(x) - 2))
    return Sums(x[2:].reshape(size, size), x[0], x[1])


def far(e: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis lengths of the rows of e."""
    return (e * np.linalg.solve(sigma, e.T).T).sum(axis=1)


def location_dispersion(rows: DataFrame, n: int, half_life: float = 120.0, nu: float = 5.0, steps: int = 1000, tol: float = 1e-9, normalised: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood location and dispersion of a Student t distribution with weighted dates, by fixed point.
    A step's dispersion is a sum of weights, centred on the weighted sum, which only at the end is divided by the weights' sum;
    normalised divides both in each step."""
    first = sums(rows, n, half_life)
    k = len(first.mean)
    mu, sigma = first.mean, first.cov * ((nu - 2) / nu if nu > 2 else 1)
    for _ in range(steps):
        s = sums(rows, n, half_life, lambda v: (nu + k) / (nu + far(v - mu, sigma)))  # noqa: B023  called in this round
        one, two, w = s.m[0, 1:], s.m[1:, 1:], s.total
        at = one / w if normalised else one
        new = two - np.outer(at, one) - np.outer(one, at) + w * np.outer(at, at)
        new, at = (new / w, at) if normalised else (new, at / w)
        done = max(np.abs(at - mu).max(), np.abs(new - sigma).max() / np.abs(new).max()) < tol
        mu, sigma = at, new
        if done:
            break
    return mu, sigma


def mlfp(returns: DataFrame, half_life: float = 120.0, nu: float = 5.0, steps: int = 1000, tol: float = 1e-9, normalised: bool = False) -> DataFrame:
    """i, j, location (of i) and dispersion of i and j (by order of assets) under flexible probabilities."""
    rows = numbered(dense(returns).withColumnRenamed("r", "v"), "date")
    mu, sigma = location_dispersion(rows, rows.count(), half_life, nu, steps, tol, normalised)
    cells = [(i, j, float(mu[i]), float(sigma[i, j])) for i in range(len(mu)) for j in range(len(mu))]
    return returns.sparkSession.createDataFrame(cells, "i int, j int, location double, dispersion double")


def slopes(zz: np.ndarray, zx: np.ndarray, penalty: float, steps: int = 500) -> np.ndarray:
    """Coefficients (factors x assets) of least squares with an absolute penalty, from centred weighted moments, by coordinate descent; no
    penalty: the plain solution."""
    if penalty <= 0:
        return np.linalg.lstsq(zz, zx, rcond=None)[0]
    b = np.zeros(zx.shape)
    for _ in range(steps):
        before = b.copy()
        for k in range(len(zz)):
            rest = zx[k] - zz[k] @ b + zz[k, k] * b[k]
            b[k] = np.sign(rest) * np.maximum(np.abs(rest) - penalty, 0) / zz[k, k] if zz[k, k] > 0 else 0.0
        if np.abs(b - before).max() < 1e-12:
            break
    return b


def factor_model(returns: DataFrame, factors: DataFrame, half_life: float = 120.0, nu: float | None = None, penalty: float = 0.0, rescale: bool = False, intercept: bool = True, steps: int = 500, tol: float = 1e-3) -> DataFrame:
    """asset, factor, beta, alpha, r2 and sigma (the residual's dispersion) of returns on factors (date, f: array) under flexible probabilities.

    nu: degrees of freedom of Student residuals, whose weights are found anew in each round until coefficients and dispersion move by less than
    tol; None: one round without weights.  rescale: the penalty acts on returns and factors of unit deviation; the result is in their own units."""
    assets = [r.asset for r in returns.select("asset").distinct().orderBy("asset").collect()]  # their number is that of the result's rows
    n_x = len(assets)
    rows = numbered(dense(returns).join(factors, "date").select("date", F.concat("r", "f").alias("v")), "date")
    n = rows.count()
    first = sums(rows, n, half_life)
    scale = np.sqrt(np.diag(first.unbiased)) if rescale else np.ones(len(first.mean))
    scale = np.where(scale > 0, scale, 1.0)

    def solved(s: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        outer = np.outer(scale, scale)
        raw = s.m[1:, 1:] / s.total / outer
        mean, cov = s.mean / scale, s.cov / outer
        used = cov if intercept else raw
        b = slopes(used[n_x:, n_x:], used[n_x:, :n_x], penalty).T  # assets x factors
        a = mean[:n_x] - b @ mean[n_x:] if intercept else np.zeros(n_x)
        e = np.column_stack([np.eye(n_x), -b])  # residuals are e (x, z) - a
        return a, b, e @ (cov / (1 - s.squares / s.total**2)) @ e.T

    a, b, sigma = solved(first)
    if nu is not None:
        sigma = sigma * ((nu - 2) / nu if nu > 2 else 1)
        for _ in range(steps):
            s = sums(rows, n, half_life, lambda v: (nu + n_x) / (nu + far(v[:, :n_x] / scale[:n_x] - a - v[:, n_x:] / scale[n_x:] @ b.T, sigma)))  # noqa: B023
            before, spread = np.column_stack([a, b]), sigma
            a, b, sigma = solved(s)
            sigma = sigma * s.again / s.total
            norm = lambda x: np.abs(x).sum(axis=1).max()
            if max(norm(np.column_stack([a, b]) - before) / norm(before), norm(sigma - spread) / norm(spread)) < tol:
                break
        s_last = s
    else:
        s_last = first
    a, sigma = a * scale[:n_x], sigma * np.outer(scale[:n_x], scale[:n_x])
    b = b / scale[n_x:] * scale[:n_x, None]
    e = np.column_stack([np.eye(n_x), -b])
    left, var = np.diag(e @ s_last.cov @ e.T), np.diag(s_last.cov)[:n_x]
    r2 = [1 - float(x / y) if y > 0 else None for x, y in zip(left, var, strict=True)]
    cells = [(asset, k, float(b[i, k]), float(a[i]), r2[i], float(sigma[i, i])) for i, asset in enumerate(assets) for k in range(b.shape[1])]
    return returns.sparkSession.createDataFrame(cells, "asset string, factor int, beta double, alpha double, r2 double, sigma double")
