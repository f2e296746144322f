"""Rows in order, cut into blocks of which a task holds one at a time.

A recursion through time whose steps compose associatively is done in three passes: each block is reduced to one step, the
blocks' steps are put together in order, and each block is walked again from the state that enters it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisand.storage import staged

#: Rows of a block; blocks at most (beyond that, blocks grow).
BLOCK, BLOCKS = 64, 1024


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df, staged, with block and i, a row's place from 0 in this order (of no equal rows).  Blocks are ranges of the order, so no task
    sees all rows; only the blocks' sizes, at most BLOCKS of them, are summed in one place."""
    df = staged(df, "unordered")
    n = min(BLOCKS, max(1, -(-df.count() // BLOCK)))
    ranged = staged(df.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()), "blocks")
    sizes = ranged.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1
    return staged(ranged.join(F.broadcast(before), "block").withColumn("i", place).drop("_before"), "blocks")


def summed(parts: DataFrame) -> dict[int, float]:
    """Sums of v by k of rows k, v: a few numbers that do not grow with the rows behind them."""
    return {r.k: r.v for r in parts.groupBy("k").agg(F.sum("v").alias("v")).collect()}


def flat(values) -> pd.DataFrame:
    """k, v of numbers in order."""
    return pd.DataFrame({"k": range(len(values)), "v": values})
