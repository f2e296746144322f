"""Exact quantiles of groups of any size.

A rank's value is found by counting: a group's values are counted in ranges between the least and the greatest, the range that holds the rank becomes the
next one, and so on until few values are left in it, which are then sorted.  Counts are aggregates; no task holds a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisand.storage import staged

#: Ranges of a round; values that are sorted at the end; rounds after which whatever is left is sorted.
RANGES, FEW, ROUNDS = 256, 4096, 12


def quantiles(df: DataFrame, by: Sequence[str], column: str, levels: Sequence[float]) -> DataFrame:
    """by, level, value: linearly interpolated quantiles of column (null and NaN don't count), as percentile() has them.  by: no nulls."""
    by = list(by)
    rows = staged(df.select(*by, F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)"), "values")
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ask = whole.withColumn("level", F.explode(F.array(*map(F.lit, map(float, levels)))))
    at = (F.col("n") - 1) * F.col("level")
    ask = ask.withColumns({"at": at, "k": F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))})
    # below: values less than lo; inside: from lo to hi
    ask = staged(ask.select(*by, "level", "at", "k", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "ranks")
    key, done = [*by, "level", "k"], []
    for round_ in range(ROUNDS):
        ready = (F.col("inside") <= FEW) | (F.col("lo") == F.col("hi"))
        done.append(ask.filter(ready))
        ask = ask.filter(~ready)
        if ask.isEmpty():
            break
        if round_ == ROUNDS - 1:
            done.append(ask)
            break
        near = rows.join(F.broadcast(ask), by).filter(F.col("x").between(F.col("lo"), F.col("hi")))  # a few rows for each group
        half = F.col("hi") / 2 - F.col("lo") / 2  # no overflow
        part = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / half * RANGES), F.lit(RANGES - 1))
        counts = near.groupBy(*key, "at", "below", part.alias("part")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*key).orderBy("part"))  # RANGES rows for each rank
        counts = counts.withColumn("upto", F.col("below") + upto).filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("c")))
        ask = staged(counts.select(*by, "level", "at", "k", "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside")), "ranks")
    ranks = done[0]
    for x in done[1:]:
        ranks = ranks.unionByName(x)
    ranks = staged(ranks, "ranks")
    same = ranks.filter("lo = hi").select(*key, "at", F.col("lo").alias("v"))
    few = rows.join(F.broadcast(ranks.filter("lo <> hi")), by).filter(F.col("x").between(F.col("lo"), F.col("hi")))
    few = few.groupBy(*key, "at", "below").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    found = few.select(*key, "at", F.get("xs", (F.col("k") - F.col("below")).cast("int")).alias("v")).unionByName(same)
    low, high = F.min_by("v", "k"), F.max_by("v", "k")
    value = F.when(F.count("*") == 1, low).when(low == high, low).otherwise((F.ceil("at") - F.col("at")) * low + (F.col("at") - F.floor("at")) * high)
    return found.groupBy(*by, "level", "at").agg(value.alias("value")).drop("at")


def tail(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """strategy, var (interpolated quantile) and cvar (mean at or below it), as metrics.tail(), of series of any length."""
    var = staged(quantiles(returns, ["strategy"], "r", [alpha]).select("strategy", F.col("value").alias("var")), "quantiles")
    met = returns.join(F.broadcast(var), "strategy")  # a row for each strategy
    return met.groupBy("strategy").agg(F.first("var").alias("var"), F.coalesce(F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))), F.first("var")).alias("cvar"))
