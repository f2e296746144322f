"""Exact top-k search: tiled matrix products with a partial selection per tile and a tree of merges.

Candidates are cut into shards, queries into tiles.  Every (tile, shard) cell
of the grid is one matrix product; both sides are copied along the other axis
and meet by an equi-join on the cell.  A cell keeps k rows per query; the lists
of a query are then merged in two levels (groups of shards, then all).

Cases: vectors that are null, empty or hold a null or non-finite component take no part;
vectors only meet those of equal length; a query never meets rows of its own
vec_id; repeated candidate rows each count, a repeated query id is asked once (with its
smallest vector); null vec_id takes no part; ties go to the smaller vec_id;
an empty table gives an empty result.  Products are exact: in float64 while the
bound on any partial sum is below 2^53, else in Python integers, then clipped to 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and of a tile: a cell's product takes about 8 * SHARD * TILE bytes = 16 MB.
SHARD, TILE = 2048, 1024
#: Shards whose lists the first level of merging takes together.
FAN_IN = 32


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim and v = floor(scale * x) as doubles (within 64 bits), of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, bad), F.lit(True))
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(ok, F.transform(x, lambda e: F.floor(e * scale).cast("double"))).alias("v"),
    ).filter("v is not null").withColumn("dim", F.size("v"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in v])


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products as int64."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    return np.clip(whole(q) @ whole(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def select_topk(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each query in this cell; c_ids must be sorted."""
    out = []
    for qid, row in zip(q_ids, scores, strict=True):
        own = slice(*np.searchsorted(c_ids, [qid, qid + 1]))
        m = len(row) - (own.stop - own.start)
        if m <= 0:
            continue
        mask = np.ones(len(row), dtype=bool)
        mask[own] = False
        at = np.flatnonzero(mask)
        r = row[at]
        if m > k:
            least = np.partition(r, m - k)[m - k]
            over, tied = np.flatnonzero(r > least), np.flatnonzero(r == least)
            pick = np.concatenate([over, tied[: k - len(over)]])  # ties: c_ids ascend
        else:
            pick = np.arange(m)
        out.append((np.full(len(pick), qid), c_ids[at[pick]], r[pick]))
    if not out:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score.  Both inputs: vec_id, dim, v as from quantised()."""
    n_c, n_q = vectors.count(), queries.count()
    n_shards, n_tiles = max(1, -(-n_c // SHARD)), max(1, -(-n_q // TILE))
    spread = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.dim", "q.v")
    # rows are dealt to shards and tiles by position, so that repeated rows don't meet in one
    c = vectors.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(n_shards)).cast("int"))
    q = asked.withColumn("tile", spread(n_tiles, "query_id"))
    c = c.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).select("tile", "shard", "dim", "vec_id", "v")
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).select("tile", "shard", "dim", "query_id", "v")

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []}).astype("int64")
        right = right.sort_values("vec_id", kind="stable")
        best = select_topk(products(_matrix(left.v), _matrix(right.v)), left.query_id.to_numpy(), right.vec_id.to_numpy(), k)
        return best.assign(shard=key[1])

    cells = q.groupBy("tile", "shard", "dim").cogroup(c.groupBy("tile", "shard", "dim")).applyInPandas(cell, "query_id long, vec_id long, score long, shard long")
    best_first = (F.col("score").desc(), F.col("vec_id"))
    group = F.floor(F.col("shard") / FAN_IN)
    half = cells.withColumn("g", group).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "g").orderBy(*best_first))).filter(F.col("r") <= k)
    return (
        half.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first)))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

