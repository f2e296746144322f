"""Portfolio construction: eight strategies, the efficient frontier and clusters.

Spark computes means and covariances (products of blocks of assets, gram.py) and brings
each problem (a split, a strategy, a target return) into one row: n means, n x n covariances and, for the
tail-risk strategy only, the dates' returns.  Their size depends on assets and trading dates,
never on the number of sales behind the prices.  Problems are dealt to tasks and solved with small
dense NumPy steps.  Weights sum to one and lie in [0, 1].

Cases: a covariance that isn't positive definite gets RIDGE on its diagonal; a problem that
can't be solved (too few dates, an impossible target) gets equal weights and its reason in status.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.operators import gram, tree
from palisand.storage import staged

YEAR, RIDGE, LEAST_SHARE = 252, 1e-8, 0.001
#: Fewest dates and assets of the tail-risk strategy.
LEAST_DATES, LEAST_ASSETS = 30, 2


def moments(returns: DataFrame, *by: str) -> DataFrame:
    """by, assets, mean and cov (both annual, in the order of assets, cov by rows), one row for each group of by."""
    pairs = gram.covariances(gram.products(returns, *by), *by)
    rows = pairs.groupBy(*by, "i").agg((F.max("m") * YEAR).alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("j", (F.col("c") * YEAR).alias("c")))), lambda x: x["c"]).alias("c"))
    whole = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "m", "c"))).alias("x"))
    return whole.select(*by, F.col("x.i").alias("assets"), F.col("x.m").alias("mean"), F.col("x.c").alias("cov"))


def dense(returns: DataFrame, *by: str, value: str = "r") -> DataFrame:
    """by, date and r, the values of one date in the order of assets."""
    return returns.groupBy(*by, "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", F.col(value).alias("v")))), lambda x: x["v"]).alias("r"))


def scenarios(returns: DataFrame, *by: str) -> DataFrame:
    """by and rows, the dates' returns in order of dates."""
    return dense(returns, *by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "r"))), lambda x: x["r"]).alias("rows"))


def sound(cov: np.ndarray) -> np.ndarray:
    return cov if np.linalg.eigvalsh(cov).min() > 0 else cov + RIDGE * np.eye(len(cov))


def quadratic(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min x'qx with ax = b and x >= 0, by primal-dual interior-point steps; ValueError if they don't end at a solution."""
    n, m = len(q), len(b)
    scale = np.abs(q).max()
    q = q / scale
    x, z, v = np.ones(n), np.ones(n), np.zeros(m)
    for _ in range(100):
        lagrange, gap, fit = q @ x - a.T @ v - z, x @ z / n, b - a @ x
        if max(np.abs(lagrange).max(), np.abs(fit).max(), gap) < 1e-11:
            return x
        kkt = np.block([[q + np.diag(z / x), -a.T], [a, np.zeros((m, m))]])
        step = np.linalg.lstsq(kkt, np.r_[-lagrange + (0.1 * gap - x * z) / x, fit], rcond=None)[0]
        dx, dv = step[:n], step[n:]
        dz = (0.1 * gap - x * z - z * dx) / x
        t = min([1.0, *(float((-0.99 * w[d < 0] / d[d < 0]).min()) for w, d in ((x, dx), (z, dz)) if (d < 0).any())])
        x, z, v = x + t * dx, z + t * dz, v + t * dv
    if np.abs(b - a @ x).max() > 1e-6:
        raise ValueError("no such portfolio")
    return x


def min_vol(mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    return quadratic(cov, np.ones((1, len(cov))), np.ones(1))


def at_target(mean: np.ndarray, cov: np.ndarray, target: float) -> np.ndarray:
    """Least volatility at a given annual return."""
    return quadratic(cov, np.stack([np.ones(len(cov)), mean]), np.array([1.0, target]))


def max_return(mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    return np.eye(len(mean))[int(mean.argmax())]


def max_sharpe(mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    """The least variance for one unit of excess return, scaled to one; where no asset beats rf the ratio is best at a single asset."""
    if mean.max() <= rf:
        return np.eye(len(mean))[int(((mean - rf) / np.sqrt(np.diag(cov))).argmax())]
    y = quadratic(cov, (mean - rf)[None, :], np.ones(1))
    return y / y.sum()


def risk_parity(mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    """Equal shares of risk: coordinate descent on x'cx / 2 - sum(log x) / n, then scaled to one."""
    n = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(500):
        before = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest**2 + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x - before).max() < 1e-13 * x.max():
            break
    w = np.maximum(x / x.sum(), LEAST_SHARE)
    return w / w.sum()


def markowitz(mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    try:
        return at_target(mean, cov, float(mean.mean()))
    except ValueError:
        return max_sharpe(mean, cov, rf)


def linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Single linkage: (cluster, cluster, distance) of each merge; new clusters are numbered from n.  Of equal distances the first pair merges."""
    held = {i: [i] for i in range(len(distance))}
    merges = []
    while len(held) > 1:
        pairs = ((distance[np.ix_(held[i], held[j])].min(), i, j) for i in held for j in held if i < j)
        d, i, j = min(pairs)
        merges.append((i, j, float(d)))
        held[len(distance) + len(merges) - 1] = held.pop(i) + held.pop(j)
    return merges


def leaves(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """Assets in the order of the tree."""
    order = {i: [i] for i in range(n)}
    for k, (i, j, _) in enumerate(merges):
        order[n + k] = order[i] + order[j]
    return order[n + len(merges) - 1] if merges else list(range(n))


def distances(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    both = np.outer(sd, sd)
    rho = np.divide(cov, both, out=np.zeros_like(cov), where=both > 0)
    np.fill_diagonal(rho, 1.0)
    return np.sqrt(np.clip((1 - rho) / 2, 0, None))


def cluster_variance(cov: np.ndarray, members: list[int]) -> float:
    """Variance of the members weighted by inverse variances."""
    part = cov[np.ix_(members, members)]
    w = 1 / np.maximum(np.diag(part), 1e-10)
    w /= w.sum()
    return float(w @ part @ w)


def hrp(mean: np.ndarray, cov: np.ndarray, rf: float) -> np.ndarray:
    """Hierarchical risk parity: the tree's order is halved again and again, each half weighted by the other's variance."""
    n = len(cov)
    w, parts = np.ones(n), [leaves(linkage(distances(cov)), n)]
    while parts:
        part = parts.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = cluster_variance(cov, left), cluster_variance(cov, right)
            share = b / (a + b) if a + b > 0 else 0.5  # halves without variance share alike
            w[left] *= share
            w[right] *= 1 - share
            parts += [left, right]
    return w / w.sum()


def least_cvar(rows: np.ndarray, alpha: float = 0.95, floor: float | None = None) -> np.ndarray:
    """Weights of least expected loss beyond the alpha quantile (Rockafellar and Uryasev), optionally with
    mean return >= floor a year: a barrier method whose T excess variables are eliminated, so each step solves n + 1 equations."""
    t_, n = rows.shape
    if t_ < LEAST_DATES or n < LEAST_ASSETS or not np.isfinite(rows).all():
        raise ValueError("too few dates or assets")
    mean = rows.mean(axis=0)
    x = np.full(n, 1 / n)
    if floor is not None:
        best = np.eye(n)[int(mean.argmax())]
        x = 0.02 * x + 0.98 * best if mean @ x <= floor / YEAR else x
        if mean @ x <= floor / YEAR:
            raise ValueError("no such portfolio")
    g = np.c_[rows, np.ones(t_)]
    z = np.r_[x, 0.0]
    u = np.maximum(-(g @ z), 0) + 1e-2
    c, k = 1 / ((1 - alpha) * t_), 2 * t_ + n + 1
    weight, eq = 10.0, np.r_[np.ones(n), 0.0]
    value = lambda z, u: np.inf if min(z[:n].min(), u.min(), (u + g @ z).min(), np.inf if floor is None else mean @ z[:n] - floor / YEAR) <= 0 else (
        weight * (z[n] + c * u.sum()) - np.log(u).sum() - np.log(u + g @ z).sum() - np.log(z[:n]).sum() - (0.0 if floor is None else np.log(mean @ z[:n] - floor / YEAR))
    )
    while k / weight > 1e-10:
        weight *= 8
        for _ in range(60):
            s = u + g @ z
            a, b = 1 / s**2, 1 / u**2
            du0 = weight * c - 1 / s - 1 / u
            grad = -g.T @ (1 / s) + weight * np.r_[np.zeros(n), 1.0]
            grad[:n] -= 1 / z[:n]
            hess = (g * (a * b / (a + b))[:, None]).T @ g
            hess[np.arange(n), np.arange(n)] += 1 / z[:n] ** 2
            if floor is not None:
                slack = mean @ z[:n] - floor / YEAR
                grad[:n] -= mean / slack
                hess[:n, :n] += np.outer(mean, mean) / slack**2
            reduced = grad - g.T @ (a / (a + b) * du0)
            dz = np.linalg.solve(np.block([[hess, eq[:, None]], [eq[None, :], np.zeros((1, 1))]]), np.r_[-reduced, 0.0])[:-1]
            du = -(du0 + a * (g @ dz)) / (a + b)
            slope, now, step = grad @ dz + du0 @ du, value(z, u), 1.0
            if -slope < 1e-9:
                break
            while value(z + step * dz, u + step * du) > now + 0.1 * step * slope and step > 1e-12:
                step /= 2
            if step <= 1e-12:
                break
            z, u = z + step * dz, u + step * du
    w = np.clip(z[:n], 0, None)
    return w / w.sum()


METHODS: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]] = {
    "equal": lambda mean, cov, rf: np.full(len(mean), 1 / len(mean)), "min_vol": min_vol, "max_return": max_return, "max_sharpe": max_sharpe,
    "risk_parity": risk_parity, "markowitz": markowitz, "hrp": hrp,
}
STRATEGIES = (*METHODS, "cvar")


def weights(returns: DataFrame, strategies: Sequence[str] = STRATEGIES, rf: float = 0.02, alpha: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """by, strategy, asset, w, status: one problem for each group of by and strategy, solved where it was dealt to."""
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    problems = moments(returns, *by)
    if "cvar" in strategies:
        tails = scenarios(returns, *by)
        problems = problems.join(tails, list(by)) if by else problems.crossJoin(F.broadcast(tails))  # one row each
    else:
        problems = problems.withColumn("rows", F.lit(None).cast("array<array<double>>"))
    problems = problems.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies)))).withColumn("rows", F.when(F.col("strategy") == "cvar", F.col("rows")))
    kinds = ", ".join(f"{c} {returns.schema[c].dataType.simpleString()}" for c in by)

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                mean, cov, status = np.array(row.mean), sound(np.stack(row.cov)), "ok"
                try:
                    w = least_cvar(np.stack(row.rows), alpha) if row.strategy == "cvar" else METHODS[row.strategy](mean, cov if row.strategy != "hrp" else np.stack(row.cov), rf)
                    if not np.isfinite(w).all():
                        raise ValueError("no finite weights")
                except (ValueError, np.linalg.LinAlgError) as e:
                    w, status = np.full(len(mean), 1 / len(mean)), str(e)
                out = {c: getattr(row, c) for c in by} | {"strategy": row.strategy, "asset": row.assets, "w": w, "status": status}
                yield pd.DataFrame(out)

    return problems.repartition("strategy", *by).mapInPandas(solved, (kinds + ", " if by else "") + "strategy string, asset string, w double, status string")


def frontier(returns: DataFrame, points: int = 50, rf: float = 0.02) -> DataFrame:
    """i, target, ret, vol, sharpe and status of the least volatile portfolio at evenly spaced returns; where there is none, status says why
    and the figures are null."""
    grid = moments(returns).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    low, high = F.array_min("mean"), F.array_max("mean")
    grid = grid.withColumn("target", low + F.col("i") * (high - low) / (points - 1)).repartition("i")

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                mean, cov = np.array(row.mean), sound(np.stack(row.cov))
                try:
                    w = at_target(mean, cov, row.target)
                except (ValueError, np.linalg.LinAlgError) as e:
                    out.append((row.i, row.target, None, None, None, str(e)))
                    continue
                ret, vol = float(w @ mean), float(np.sqrt(w @ cov @ w))
                out.append((row.i, row.target, ret, vol, (ret - rf) / vol if vol > 0 else 0.0, "ok"))
            yield pd.DataFrame(out, columns=["i", "target", "ret", "vol", "sharpe", "status"])

    return grid.mapInPandas(solved, "i int, target double, ret double, vol double, sharpe double, status string")


def asset_clusters(returns: DataFrame, most: int = 3) -> DataFrame:
    """asset, place (in the order of the tree) and cluster, by single linkage of the assets' spanning tree."""
    found = asset_tree(returns)
    place = {a: k for k, a in enumerate(found.order())}
    rows = [(a, place[i], c) for i, (a, c) in enumerate(zip(found.assets, found.clusters(min(most, len(found.assets))), strict=True))]
    return returns.sparkSession.createDataFrame(rows, "asset string, place long, cluster long")


def asset_tree(returns: DataFrame) -> tree.Linkage:
    assets = [r.asset for r in returns.select("asset").distinct().orderBy("asset").collect()]  # as many as the tree has leaves
    blocks = staged(gram.products(returns), "products")
    return tree.linkage(assets, tree.spanning(tree.distances(gram.correlations(blocks))))


def merge_heights(returns: DataFrame) -> DataFrame:
    """k (from 1) and height of each merge of asset_tree()."""
    return returns.sparkSession.createDataFrame([(k + 1, d) for k, (_, _, d) in enumerate(asset_tree(returns).merges)], "k int, height double")


def by_cluster(returns: DataFrame, clusters: DataFrame, weights: DataFrame) -> DataFrame:
    """cluster, n, rho (mean correlation of the pairs inside; null without any) and w (sum of weights), of clusters (asset, cluster)."""
    x = returns.join(clusters, "asset")
    y = x.select("date", "cluster", F.col("asset").alias("j"), F.col("r").alias("s"))
    rho = x.join(y, ["date", "cluster"]).filter("asset < j").groupBy("cluster", "asset", "j").agg(F.corr("r", "s").alias("rho")).groupBy("cluster").agg(F.avg("rho").alias("rho"))
    w = clusters.join(weights, "asset").groupBy("cluster").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return w.join(rho, "cluster", "left")


#: Modulus, multipliers and offset of the deterministic uniform numbers below.
PRIME, BY_ROW, BY_COLUMN, SHIFT = 2_147_483_647, 7_919, 104_729, 12_345


def uniform(row, column, seed: int):
    """A number in (0, 1) fixed by row, column and seed: two squarings modulo a prime (integer columns, so any engine gives the same)."""
    x = (row * BY_ROW + column * BY_COLUMN + F.lit(seed).cast("long")) % PRIME
    x = (x * x + SHIFT) % PRIME
    x = (x * x + column) % PRIME
    return (x + F.lit(0.5)) / F.lit(float(PRIME))


def random_cloud(spark, returns: DataFrame, n: int = 10_000, rf: float = 0.02, seed: int = 42) -> DataFrame:
    """id, ret, vol, sharpe of n portfolios with Dirichlet(2) weights: each a sum of two exponentials, scaled to one.
    A portfolio is one row with its arrays; the moments are a single row that is sent to all tasks."""
    ids = spark.range(n).crossJoin(F.broadcast(moments(returns)))
    k = lambda a: (a + 1).cast("long")
    raw = F.transform("assets", lambda a, i: -F.ln(uniform(F.col("id"), 2 * k(i), seed)) - F.ln(uniform(F.col("id"), 2 * k(i) + 1, seed)))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    df = ids.withColumn("raw", raw).withColumn("w", F.transform("raw", lambda x: x / total))
    df = df.select("id", dot(F.col("w"), F.col("mean")).alias("ret"), F.sqrt(dot(F.col("w"), F.transform("cov", lambda c: dot(c, F.col("w"))))).alias("vol"))
    return df.withColumn("sharpe", (F.col("ret") - rf) / F.col("vol"))


def risk_buckets(cloud: DataFrame, n: int = 50) -> DataFrame:
    """The best return in each of n equal ranges of volatility; the most volatile portfolio lies beyond the last, half-open one.
    The cloud is stored, so that the ends are those of the very rows that are placed: made again, they may differ in their last bits."""
    cloud = staged(cloud, "cloud")
    ends = cloud.agg(F.min("vol").alias("lo"), F.max("vol").alias("hi"), ((F.max("vol") - F.min("vol")) / n).alias("size"))
    bucket = F.when(F.col("vol") < F.col("hi"), F.floor((F.col("vol") - F.col("lo")) / F.col("size")).cast("int"))  # at the upper end the division may round down
    placed = cloud.crossJoin(F.broadcast(ends)).withColumn("bucket", bucket)
    return placed.filter(F.col("bucket") < n).groupBy("bucket").agg(F.max("ret").alias("ret"), F.max_by("vol", "ret").alias("vol"))
