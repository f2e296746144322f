"""Means, covariances and principal components of many assets, by products of blocks.

Assets are dealt to blocks and dates to slices.  A pair of blocks and a slice is one group, whose dates x assets matrices are multiplied; products are
summed over slices.  So a return is sent once for each block of assets, not once for each asset, and no task holds all assets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.storage import staged

#: Assets of a block, about; days of a slice.
ASSETS, DAYS = 256, 4096
#: Rounds of products at most, and columns that are sought besides those asked for.
ROUNDS, EXTRA = 60, 6

_SUMS = ("n", "x", "y", "xy")


def products(returns: DataFrame, *by: str) -> DataFrame:
    """by, a, b, left, right and, by rows of left, n, x, y, xy: for the assets of each pair of blocks a <= b how many dates both have, and on
    those the sums of the left ones' returns, of the right ones', and of their products."""
    n_blocks = max(1, -(-returns.select("asset").distinct().count() // ASSETS))
    rows = returns.filter("r is not null").select(*by, "asset", "r", F.unix_date("date").alias("d"), F.pmod(F.xxhash64("asset"), F.lit(n_blocks)).cast("int").alias("own"))
    pair = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda k: F.struct(F.least("own", k).alias("a"), F.greatest("own", k).alias("b")))
    rows = rows.withColumn("slice", F.floor(F.col("d") / DAYS)).withColumn("pair", F.explode(pair)).select("*", "pair.a", "pair.b").drop("pair")
    kinds = "".join(f"{c} {returns.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{kinds}a int, b int, left array<string>, right array<string>, n array<double>, x array<double>, y array<double>, xy array<double>"

    def cells(frame: pd.DataFrame, block: int, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = frame[frame["own"] == block]
        names, col = np.unique(own["asset"].to_numpy().astype(str), return_inverse=True)
        x, there = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        at = np.searchsorted(days, own["d"].to_numpy()), col
        x[at], there[at] = own["r"].to_numpy(), 1.0
        return names, x, there

    def out(frame: pd.DataFrame, left, right, values) -> pd.DataFrame:
        first = {c: [frame[c].iloc[0]] for c in (*by, "a", "b")}
        return pd.DataFrame(first | {"left": [list(left)], "right": [list(right)]} | {c: [v.ravel()] for c, v in zip(_SUMS, values, strict=True)})

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        days = np.unique(frame["d"].to_numpy())
        left, x, m = cells(frame, frame["a"].iloc[0], days)
        right, y, k = cells(frame, frame["b"].iloc[0], days)
        return out(frame, left, right, (m.T @ k, x.T @ k, m.T @ y, x.T @ y))

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = (np.unique(np.concatenate([np.array(list(v), dtype=str) for v in frame[c]])) for c in ("left", "right"))
        total = np.zeros((4, len(left), len(right)))
        for p in frame.itertuples(index=False):
            at = np.ix_(np.searchsorted(left, np.array(list(p.left), dtype=str)), np.searchsorted(right, np.array(list(p.right), dtype=str)))
            for t, c in zip(total, _SUMS, strict=True):
                t[at] += np.array(getattr(p, c)).reshape(len(p.left), len(p.right))
        return out(frame, left, right, total)

    return rows.groupBy(*by, "slice", "a", "b").applyInPandas(product, schema).groupBy(*by, "a", "b").applyInPandas(added, schema)


def _matrices(p) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array(getattr(p, c)).reshape(len(p.left), len(p.right)) for c in _SUMS)


def covariances(blocks: DataFrame, *by: str) -> DataFrame:
    """by, i, j, c (sample covariance, null below two common dates) and m (mean of i; null but for i = j), of products()."""
    kinds = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in by)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame.itertuples(index=False):
                n, x, y, xy = _matrices(p)
                with np.errstate(divide="ignore", invalid="ignore"):
                    c = np.where(n > 1, (xy - x * y / n) / (n - 1), np.nan)
                    m = np.where(np.array(p.left)[:, None] == np.array(p.right)[None, :], x / n, np.nan)
                i, j = (v.ravel() for v in np.indices(c.shape))
                left, right = np.array(p.left, dtype=object)[i], np.array(p.right, dtype=object)[j]
                first = {k: getattr(p, k) for k in by}
                yield pd.DataFrame(first | {"i": left, "j": right, "c": c.ravel(), "m": m.ravel()})
                if p.a != p.b:
                    yield pd.DataFrame(first | {"i": right, "j": left, "c": c.ravel(), "m": np.nan})

    long = blocks.mapInPandas(spread, f"{kinds}i string, j string, c double, m double")
    return long.withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in ("c", "m")})


def correlations(blocks: DataFrame) -> DataFrame:
    """i, j, rho (0 where one does not vary) for i < j, of products() without groups."""
    c = staged(covariances(blocks), "covariances")
    var = c.filter("i = j").select("i", F.sqrt("c").alias("s"))
    both = c.filter("i < j").join(var, "i").join(var.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    return both.select("i", "j", F.when((F.col("s") > 0) & (F.col("t") > 0), F.col("c") / (F.col("s") * F.col("t"))).otherwise(0.0).alias("rho"))


def leading(blocks: DataFrame, k: int, tol: float = 1e-11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Assets in order, the k leading eigenvectors of their correlation matrix as columns, each with its largest entry positive, and their shares of variance;
    of products() (staged) without groups.

    Block Krylov iteration: stored blocks are multiplied with a few columns in tasks, the columns (assets x columns numbers) are made orthogonal on
    the driver; it ends when the k best combinations of all columns so far are eigenvectors within tol.  No task or row holds the matrix."""
    diag = covariances(blocks.filter("a = b")).filter("i = j").select("i", F.coalesce("c", F.lit(0.0)).alias("c")).orderBy("i").collect()
    assets = [r.i for r in diag]
    sd = np.sqrt([r.c for r in diag])
    varying = sd > 0
    place = {a: i for i, a in enumerate(assets)}
    size = len(assets)

    def times(q: np.ndarray) -> np.ndarray:
        cols = q.shape[1]

        def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for p in frame.itertuples(index=False):
                    n, x, y, xy = _matrices(p)
                    left, right = np.array([place[v] for v in p.left]), np.array([place[v] for v in p.right])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        rho = (xy - x * y / n) / (n - 1) / np.outer(sd[left], sd[right])
                    rho = np.where((n > 1) & np.isfinite(rho), rho, 0.0)
                    yield pd.DataFrame({"i": left, "v": list(rho @ q[right])})
                    if p.a != p.b:
                        yield pd.DataFrame({"i": right, "v": list(rho.T @ q[left])})

        added = blocks.mapInPandas(product, "i int, v array<double>").groupBy("i").agg(*[F.sum(F.get("v", F.lit(c))).alias(f"v{c}") for c in range(cols)])
        out = np.zeros_like(q)
        for r in added.collect():
            out[r[0]] = r[1:]
        return out

    rng = np.random.default_rng(7)
    new = np.linalg.qr(rng.normal(size=(size, min(size, k + EXTRA))))[0]
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(ROUNDS):
        ahead = times(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, ahead])
        values, inner = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        v = basis @ inner
        if np.abs(image @ inner - v * values).max(initial=0) < tol * max(values.max(initial=0), 1) or basis.shape[1] == size:
            break
        for _ in range(2):
            ahead = ahead - basis @ (basis.T @ ahead)
        u, s, _ = np.linalg.svd(ahead, full_matrices=False)
        new = u[:, s > 1e-12][:, : size - basis.shape[1]]
        if not new.shape[1]:
            break
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return assets, v, values / max(varying.sum(), 1)
