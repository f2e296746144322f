"""Principal components of returns, mean reversion of their cumulated scores, and market regimes.

Standardisation, scores, sums, regressions and z-scores are DataFrame operations; eigenvectors
are found by products with blocks of the correlation matrix (gram.py).  The regime model of a window of dates is here; that of all dates is in regimes.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisand.operators import gram
from palisand.storage import staged

#: Last dates that a z-score looks at.
RECENT = 60


def standardised(returns: DataFrame) -> DataFrame:
    """asset, date, z (population deviation)."""
    s = returns.groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    return returns.join(s, "asset").select("asset", "date", F.when(F.col("s") > 0, (F.col("r") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))


def components(corr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvectors as columns, each with its largest entry positive, and their shares of variance."""
    values, vectors = np.linalg.eigh(corr)
    v = vectors[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v, values[::-1][:k] / values.sum()


def loadings(returns: DataFrame, k: int) -> DataFrame:
    """pc (from 1), asset, loading, share."""
    assets, v, share = gram.leading(staged(gram.products(returns), "products"), k)
    rows = [(p + 1, a, float(v[i, p]), float(share[p])) for p in range(v.shape[1]) for i, a in enumerate(assets)]
    return returns.sparkSession.createDataFrame(rows, "pc int, asset string, loading double, share double")


def scores(returns: DataFrame, load: DataFrame) -> DataFrame:
    """pc, date, score and cum, its running sum."""
    s = standardised(returns).join(load, "asset").groupBy("pc", "date").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))
    return s.withColumn("cum", F.sum("score").over(Window.partitionBy("pc").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def mean_reversion(series: DataFrame) -> DataFrame:
    """pc, alpha, beta, kappa, half_life, mu, sigma (population) of f_t = alpha + beta f_(t - 1) + e, from rows pc, date, cum;
    kappa is 0 and half_life infinite unless 0 < beta < 1."""
    past = series.withColumn("lag", F.lag("cum").over(Window.partitionBy("pc").orderBy("date"))).filter("lag is not null")
    g = past.groupBy("pc").agg(
        F.regr_slope("cum", "lag").alias("beta"), F.regr_intercept("cum", "lag").alias("alpha"), F.regr_syy("cum", "lag").alias("syy"), F.regr_sxy("cum", "lag").alias("sxy"), F.count("*").alias("n")
    )
    inside = (F.col("beta") > 0) & (F.col("beta") < 1)
    g = g.withColumns({
        "kappa": F.when(inside, -F.ln("beta")).otherwise(0.0),
        "mu": F.when(inside, F.col("alpha") / (1 - F.col("beta"))).otherwise(0.0),
        "sigma": F.sqrt(F.greatest((F.col("syy") - F.col("beta") * F.col("sxy")) / F.col("n"), F.lit(0.0))),
    })
    return g.select("pc", "alpha", "beta", "kappa", F.when(inside, F.lit(float(np.log(2))) / F.col("kappa")).otherwise(F.lit(float("inf"))).alias("half_life"), "mu", "sigma")


def z_scores(series: DataFrame, ou: DataFrame, recent: int = RECENT) -> DataFrame:
    """pc, z_rolling (against the last dates), z_theory (against the stationary distribution; null if it hardly reverts) and divergence."""
    k = F.row_number().over(Window.partitionBy("pc").orderBy(F.desc("date")))
    last = series.withColumn("k", k).filter(F.col("k") <= recent).groupBy("pc").agg(F.max_by("cum", "date").alias("x"), F.avg("cum").alias("m"), F.stddev_pop("cum").alias("s"))
    stationary = F.col("sigma") / F.sqrt(2 * F.col("kappa"))
    out = last.join(ou, "pc").select(
        "pc", F.when(F.col("s") > 1e-8, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z_rolling"),
        F.when((F.col("kappa") > 0.001) & (stationary > 0), (F.col("x") - F.col("mu")) / stationary).alias("z_theory"),
    )
    return out.withColumn("divergence", F.abs(F.col("z_rolling") - F.col("z_theory")))


def cross_correlation(series: DataFrame) -> DataFrame:
    """i, j, rho between score i and the next date's score j."""
    nxt = series.select(F.col("pc").alias("j"), "date", F.lead("score").over(Window.partitionBy("pc").orderBy("date")).alias("s")).filter("s is not null")
    return series.join(nxt, "date").groupBy(F.col("pc").alias("i"), "j").agg(F.corr("score", "s").alias("rho"))


def mimicking(load: DataFrame, z: DataFrame, entry: float = 1.5) -> DataFrame:
    """pc, asset, w: loadings scaled to absolute weights of one, turned round where the factor stands high."""
    total = load.groupBy("pc").agg(F.sum(F.abs("loading")).alias("t"))
    side = F.when(F.col("z_rolling") > entry, -1.0).otherwise(1.0)
    return load.join(total, "pc").join(z, "pc").select("pc", "asset", (side * F.col("loading") / F.col("t")).alias("w"))


def deviations(load: DataFrame, z: DataFrame) -> DataFrame:
    """asset, size = sum |loading| |z|, direction = -sum loading z and its label."""
    g = load.join(z, "pc").groupBy("asset").agg(F.sum(F.abs("loading") * F.abs("z_rolling")).alias("size"), (-F.sum(F.col("loading") * F.col("z_rolling"))).alias("direction"))
    return g.withColumn("label", F.when(F.col("direction") > 0.5, "cheap").when(F.col("direction") < -0.5, "dear").otherwise("fair"))


def signals(z: DataFrame, ou: DataFrame, entry: float = 1.5, strong: float = 2.0) -> DataFrame:
    """pc, side, strong and the expected days to hold, of reverting factors but the first with |z| > entry."""
    size = F.abs("z_rolling")
    found = z.join(ou, "pc").filter((F.col("pc") > 1) & (size > entry) & F.col("beta").between(1e-12, 0.99 - 1e-12))
    return found.select("pc", F.when(F.col("z_rolling") > 0, "short").otherwise("long").alias("side"), (size > strong).alias("strong"), (F.col("half_life") * size / 2).alias("hold"))


def top_loadings(load: DataFrame, k: int = 5, least: float = 0.1) -> DataFrame:
    """pc, side (with or against the factor), place, asset, loading: the k largest of either sign beyond least."""
    sided = load.filter(F.abs("loading") > least).withColumn("side", F.when(F.col("loading") > 0, "with").otherwise("against"))
    place = F.row_number().over(Window.partitionBy("pc", "side").orderBy(F.desc(F.abs("loading")), "asset"))
    return sided.withColumn("place", place).filter(F.col("place") <= k).select("pc", "side", "place", "asset", "loading")


def top_cross_effects(cross: DataFrame, k: int = 3, least: float = 0.05) -> DataFrame:
    """i, j, rho: the k strongest effects of one score on the next date's other scores."""
    return cross.filter((F.col("i") != F.col("j")) & (F.abs("rho") > least)).orderBy(F.desc(F.abs("rho")), "i", "j").limit(k)


def contributions_of(load: DataFrame, series: DataFrame) -> DataFrame:
    """pc, asset, loading and contribution = loading times the factor's last cumulated score."""
    now = series.groupBy("pc").agg(F.max_by("cum", "date").alias("now"))
    return load.join(now, "pc").select("pc", "asset", "loading", (F.col("loading") * F.col("now")).alias("contribution"))


def signal_counts(series: DataFrame, entry: float = 2.0) -> DataFrame:
    """pc, n_long (z below -entry), n_short (above), signals and their rate, of rows pc, date, z."""
    low, high = F.count_if(F.col("z") < -entry), F.count_if(F.col("z") > entry)
    return series.groupBy("pc").agg(low.alias("n_long"), high.alias("n_short"), (low + high).alias("signals"), ((low + high) / F.count("*")).alias("rate"))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def regimes(r: np.ndarray, k: int, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian hidden Markov model by expectation and maximisation, started from quantiles of |r - mean|:
    most likely path, posteriors, transitions, means, deviations; states in ascending order of deviation."""
    order = np.argsort(np.abs(r - r.mean()), kind="stable")
    groups = np.array_split(order, k)
    mean, sd = np.full(k, r.mean()), np.array([max(r[g].std(), 1e-6) for g in groups])
    move, start, before = np.full((k, k), 0.1 / max(k - 1, 1)), np.full(k, 1 / k), -np.inf
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    for step in range(steps + 1):
        like = -0.5 * ((r[:, None] - mean) / sd) ** 2 - np.log(sd) - 0.5 * np.log(2 * np.pi)
        logs = np.log(np.maximum(move, 1e-300))
        fwd, bwd = np.empty_like(like), np.zeros_like(like)
        fwd[0] = np.log(np.maximum(start, 1e-300)) + like[0]
        for t in range(1, len(r)):
            fwd[t] = like[t] + log_sum(fwd[t - 1][:, None] + logs, 0)
        for t in range(len(r) - 2, -1, -1):
            bwd[t] = log_sum(logs + (like[t + 1] + bwd[t + 1])[None, :], 1)
        total = float(log_sum(fwd[-1], 0))
        post = np.exp(fwd + bwd - total)
        if step == steps or abs(total - before) < 1e-8 * abs(total):
            break
        before = total
        pair = np.exp(fwd[:-1, :, None] + logs[None] + (like[1:] + bwd[1:])[:, None, :] - total).sum(axis=0)
        move, start = pair / pair.sum(axis=1, keepdims=True), post[0] / post[0].sum()
        size = post.sum(axis=0)
        mean = (post * r[:, None]).sum(axis=0) / size
        sd = np.sqrt(np.maximum((post * (r[:, None] - mean) ** 2).sum(axis=0) / size, 1e-12))
    best, back = np.log(np.maximum(start, 1e-300)) + like[0], []
    for t in range(1, len(r)):
        reach = best[:, None] + logs
        back.append(reach.argmax(axis=0))
        best = reach.max(axis=0) + like[t]
    path = [int(best.argmax())]
    for step_back in reversed(back):
        path.append(int(step_back[path[-1]]))
    by_sd = np.argsort(sd)
    rank = np.argsort(by_sd)
    return rank[np.array(path[::-1])], post[:, by_sd], move[np.ix_(by_sd, by_sd)], mean[by_sd], sd[by_sd]


NAMES = {1: ["Calm"], 2: ["Calm", "Panic"], 3: ["Calm", "Normal", "Panic"]}
