"""Time-series models of returns: independence, normality, volatility, correlation, vector models.

What windows and aggregates can say stays in Spark.  A GARCH likelihood is fitted in one task for each asset, over its dates.  Dynamic
correlations are in correlation.py, Student t models in robust.py.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisand.functions.distributions import kolmogorov, shapiro, simplex_search
from palisand.functions.scalars import normal_ppf
from palisand.storage import staged


def flexible_probabilities(dates: DataFrame, half_life: float) -> DataFrame:
    """date, p: halved every half_life dates back from the last, summing to one."""
    age = F.row_number().over(Window.orderBy(F.desc("date"))) - 1  # one row for each date
    p = dates.select("date").distinct().withColumn("p", F.exp(-F.lit(math.log(2) / half_life) * age))
    return p.crossJoin(F.broadcast(p.agg(F.sum("p").alias("total")))).select("date", (F.col("p") / F.col("total")).alias("p"))


def normality(returns: DataFrame) -> DataFrame:
    """asset, ks, ks_p, w, w_p: Kolmogorov-Smirnov distance of the standardised returns from the normal distribution, and Shapiro-Wilk's W."""

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(frame["r"].to_numpy())
        z, n = (x - x.mean()) / x.std(), len(x)
        cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
        ks = float(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()))
        w, w_p = shapiro(x)
        return pd.DataFrame({"asset": [frame["asset"].iloc[0]], "ks": [ks], "ks_p": [kolmogorov(ks, n)], "w": [w], "w_p": [w_p]})

    return returns.select("asset", "r").groupBy("asset").applyInPandas(test, "asset string, ks double, ks_p double, w double, w_p double")


def variance_path(e2: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    h = np.empty(len(e2))
    h[0] = e2.mean()
    for t in range(1, len(e2)):
        h[t] = omega + alpha * e2[t - 1] + beta * h[t - 1]
    return h


def fit_garch(r: np.ndarray) -> tuple[float, float, float, float]:
    """mu, omega, alpha, beta of GARCH(1, 1) with a constant mean, by maximum likelihood of normal innovations."""
    scale, mean = r.std(), r.mean()

    def unpacked(p: np.ndarray) -> tuple[float, float, float, float]:
        total, part = 0.999 / (1 + math.exp(-np.clip(p[2], -30, 30))), 1 / (1 + math.exp(-np.clip(p[3], -30, 30)))
        return mean + p[0] * scale, math.exp(np.clip(p[1], -30, 10)) * scale**2, total * part, total * (1 - part)

    def loss(p: np.ndarray) -> float:
        mu, omega, alpha, beta = unpacked(p)
        e2 = (r - mu) ** 2
        h = variance_path(e2, omega, alpha, beta)
        return float(0.5 * (np.log(h) + e2 / h).sum())

    starts = ([0.0, math.log(0.05), 3.0, -2.5], [0.0, math.log(0.5), 0.0, -1.0])
    return unpacked(min((simplex_search(loss, np.array(s), 0.5) for s in starts), key=loss))


def garch(returns: DataFrame) -> DataFrame:
    """asset, date, z (standardised residual), vol (conditional), and the parameters of each asset's GARCH(1, 1)."""

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        r = frame["r"].to_numpy()
        if len(r) < 2 or not np.isfinite(r).all() or r.std() == 0:  # nothing to fit: standardised returns, no shocks
            sd = r.std() if len(r) and np.isfinite(r.std()) and r.std() > 0 else 1.0
            return frame[["asset", "date"]].assign(z=(r - r.mean()) / sd, vol=sd, mu=r.mean(), omega=sd**2, alpha=0.0, beta=0.0)
        mu, omega, alpha, beta = fit_garch(r)
        vol = np.sqrt(variance_path((r - mu) ** 2, omega, alpha, beta))
        return frame[["asset", "date"]].assign(z=(r - mu) / vol, vol=vol, mu=mu, omega=omega, alpha=alpha, beta=beta)

    return returns.select("asset", "date", "r").groupBy("asset").applyInPandas(fitted, "asset string, date date, z double, vol double, mu double, omega double, alpha double, beta double")


def dcc_summary(path: DataFrame) -> DataFrame:
    """i, j, now, long_run, sd, high (share of dates above long_run + sd) and half_life of shocks."""
    mean = path.groupBy("i", "j").agg(F.avg("rho").alias("long_run"), F.stddev_samp("rho").alias("sd"), F.max_by("rho", "date").alias("now"), F.first(F.col("a") + F.col("b")).alias("ab"))
    above = path.join(F.broadcast(mean), ["i", "j"]).groupBy("i", "j").agg(F.avg((F.col("rho") > F.col("long_run") + F.col("sd")).cast("double")).alias("high"))
    return mean.join(above, ["i", "j"]).select("i", "j", "now", "long_run", "sd", "high", (F.lit(math.log(0.5)) / F.ln("ab")).alias("half_life"))


def weighted(dates: DataFrame, half_life: float) -> DataFrame:
    """date, p: flexible probabilities of the dates."""
    return flexible_probabilities(dates, half_life)


def var1(levels: DataFrame, half_life: float = 1e9, form: str = "levels") -> DataFrame:
    """i, j, b, c: y_t = c + b x_(t - 1) by weighted least squares over dates, y being x_t (form levels) or x_t - x_(t - 1) (differences: the
    error-correction form, b then is that of levels less one); radius, the largest modulus of the eigenvalues of the levels' matrix, and kind:
    stationary (radius below one), error correction (some direction reverts) or random walk.  i, j number the assets in their order.

    The weighted cross-moments are sums over dates; an n x n system is all that is solved in one place."""
    if form not in ("levels", "differences"):
        raise ValueError(f"no form {form}")
    past = F.lag("r").over(Window.partitionBy("asset").orderBy("date"))
    both = levels.select("date", "asset", F.col("r").alias("y"), past.alias("x")).filter("x is not null")
    both = both.join(weighted(both, half_life), "date")
    other = both.select("date", F.col("asset").alias("other"), F.col("x").alias("x2"))
    sums = both.join(other, "date").groupBy("asset", "other").agg(
        F.sum(F.col("p") * F.col("x") * F.col("x2")).alias("xx"), F.sum(F.col("p") * F.col("y") * F.col("x2")).alias("yx"), F.sum(F.col("p") * F.col("x")).alias("mx"), F.sum(F.col("p") * F.col("y")).alias("my"),
    )
    rows = sums.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("other", "xx", "yx"))).alias("m"), F.first("mx").alias("mx"), F.first("my").alias("my"))
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("asset", "m", "mx", "my"))).alias("a"))
    whole = whole.select(
        F.transform("a", lambda r: F.transform(r["m"], lambda e: e["xx"])).alias("xx"), F.transform("a", lambda r: F.transform(r["m"], lambda e: e["yx"])).alias("yx"),
        F.transform("a", lambda r: r["mx"]).alias("mx"), F.transform("a", lambda r: r["my"]).alias("my"),
    )

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.dropna().itertuples(index=False):
                mx, my = np.array(row.mx), np.array(row.my)
                xx, yx = np.stack(row.xx) - np.outer(mx, mx), np.stack(row.yx) - np.outer(my, mx)
                b = yx @ np.linalg.pinv(xx, hermitian=True)
                c, modulus = my - b @ mx, np.abs(np.linalg.eigvals(b))
                kind = "stationary" if modulus.max() < 1 else "error correction" if modulus.min() < 1 else "random walk"
                shown = b - np.eye(len(b)) if form == "differences" else b
                i, j = np.indices(b.shape)
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "b": shown.ravel(), "c": c[i.ravel()], "radius": modulus.max(), "kind": kind})

    return whole.mapInPandas(solved, "i int, j int, b double, c double, radius double, kind string")


def weighted_covariance(levels: DataFrame, half_life: float) -> DataFrame:
    """assets, cov: the covariances of levels under flexible probabilities, one row."""
    both = levels.join(weighted(levels, half_life), "date")
    other = both.select("date", F.col("asset").alias("j"), F.col("r").alias("s"))
    w = lambda c: F.sum(F.col("p") * c)
    pairs = both.join(other, "date").groupBy("asset", "j").agg((w(F.col("r") * F.col("s")) - w(F.col("r")) * w(F.col("s"))).alias("c"))
    rows = pairs.groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda e: e["c"]).alias("c"))
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("asset", "c"))).alias("x"))
    return whole.select(F.col("x.asset").alias("assets"), F.col("x.c").alias("cov"))


def cointegration(levels: DataFrame, most: float = 0.99, half_life: float = 1e9) -> DataFrame:
    """k, asset_index, loading, beta of each eigenvector of the weighted covariance of levels whose combination follows an AR(1) with
    |beta| <= most, in ascending order of beta; the loading of largest size is positive.  Covariances, combinations and their
    regressions are sums over dates; only the n x n eigenvectors are found in one place."""

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.cov is not None and len(row.cov):
                    v = np.linalg.eigh(np.stack(row.cov))[1]
                    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(v))])
                    n, a = (x.ravel() for x in np.indices(v.shape))
                    yield pd.DataFrame({"vector": n, "asset_index": a, "asset": [row.assets[i] for i in a], "loading": v.T.ravel()})

    found = staged(weighted_covariance(levels, half_life).mapInPandas(vectors, "vector int, asset_index int, asset string, loading double"), "vectors")
    mixed = levels.join(F.broadcast(found), "asset").groupBy("vector", "date").agg(F.sum(F.col("loading") * F.col("r")).alias("y"))  # assets x assets rows are sent
    past = mixed.withColumn("x", F.lag("y").over(Window.partitionBy("vector").orderBy("date"))).filter("x is not null")
    past = past.join(weighted(past, half_life), "date")
    w = lambda c: F.sum(F.col("p") * c)
    x, y = F.col("x"), F.col("y")
    beta = past.groupBy("vector").agg(((w(x * y) - w(x) * w(y)) / (w(x * x) - w(x) * w(x))).alias("beta")).filter(F.abs("beta") <= most)
    beta = beta.withColumn("k", F.row_number().over(Window.orderBy("beta", "vector")) - 1)  # one row for each vector
    return found.join(beta, "vector").select("k", "asset_index", "loading", "beta")


def pair_changes(returns: DataFrame, recent: int = 60) -> DataFrame:
    """i, j, now (correlation over the recent dates), long_run (over all) and rise, i < j."""
    last = returns.select("date").distinct().orderBy(F.desc("date")).limit(recent).withColumn("new", F.lit(True))
    r = returns.join(last, "date", "left")
    other = r.select("date", F.col("asset").alias("j"), F.col("r").alias("s"))
    g = r.join(other, "date").filter("asset < j").groupBy(F.col("asset").alias("i"), "j").agg(
        F.corr(F.when(F.col("new"), F.col("r")), F.when(F.col("new"), F.col("s"))).alias("now"), F.corr("r", "s").alias("long_run")
    )
    return g.withColumn("rise", F.col("now") - F.col("long_run"))


def top_pairs(pairs: DataFrame, k: int = 3, high: float = 0.8, big: float = 0.15) -> DataFrame:
    """kind (now or rise), place, i, j, now, rise and flag: the k pairs with the highest correlation and the k with the largest rise over the
    long run; flagged above high, or big."""
    def best(by: str, bound: float) -> DataFrame:
        top = pairs.orderBy(F.desc(by), "i", "j").limit(k)
        return top.select(F.lit(by).alias("kind"), F.row_number().over(Window.orderBy(F.desc(by), "i", "j")).alias("place"), "i", "j", "now", "rise", (F.col(by) > bound).alias("flag"))

    return best("now", high).unionByName(best("rise", big))


def normality_votes(returns: DataFrame, jarque_bera: DataFrame) -> DataFrame:
    """normality() with jb_p (of asset, p) and votes, how many of the three tests don't reject at 5 %."""
    out = normality(returns).join(jarque_bera.select("asset", F.col("p").alias("jb_p")), "asset")
    return out.withColumn("votes", sum((F.col(c) > 0.05).cast("int") for c in ("ks_p", "jb_p", "w_p")))


def normal_plot(series: DataFrame) -> DataFrame:
    """strategy, k, theory, r: each return beside the normal quantile of its rank, at (k - 1/2) / n, scaled to the series' mean and population deviation."""
    each = Window.partitionBy("strategy")  # a series' dates
    k, n = F.row_number().over(each.orderBy("r", "date")), F.count("*").over(each)
    ranked = series.select("strategy", "r", k.alias("k"), n.alias("n"), F.avg("r").over(each).alias("m"), F.stddev_pop("r").over(each).alias("s"))
    return ranked.select("strategy", "k", (F.col("m") + F.col("s") * normal_ppf((F.col("k") - 0.5) / F.col("n"))).alias("theory"), "r")
