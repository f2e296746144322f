"""Drift, rebalancing and costs.

Without rebalancing, and with a calendar, a portfolio's path is closed: within a segment between
two rebalancings its value is sum(w * prod(1 + r)), so window functions give it.  A drift threshold makes the days themselves depend on the path,
but only through the last rebalancing: for every date on which one may happen the next is found by itself (first_passages), and the days
that do happen are those that these jumps reach from the purchase (chain).  A rebalancing's turnover is the sum of
absolute changes of weights; its cost, turnover * basis points, is taken from the value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisand.operators import panel
from palisand.operators.blocks import numbered
from palisand.operators.metrics import YEAR, ratio
from palisand.operators.optimize import dense
from palisand.storage import staged


def schedule(dates: DataFrame, freq: str, label_semantics: str = "last_trading_day") -> DataFrame:
    """date of each rebalancing: the period's last trading day, or (calendar_end) only trading days that are the period's end."""
    ended = dates.select("date").distinct().withColumn("end", panel.period_end(F.col("date"), freq))
    if label_semantics == "calendar_end":
        return ended.filter("date = end").select("date")
    return ended.groupBy("end").agg(F.max("date").alias("date")).select("date")


def hold(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """strategy, date, value of portfolios that are bought once."""
    path = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("growth", F.product(1 + F.col("r")).over(path))
    return grown.join(weights, "asset").groupBy("strategy", "date").agg(F.sum(F.col("w") * F.col("growth")).alias("value"))


def calendar(returns: DataFrame, weights: DataFrame, days: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """rebalanced() on the same days for all strategies."""
    return rebalanced(returns, weights, weights.select("strategy").distinct().join(F.broadcast(days), how="cross"), cost_bps)  # strategies x days rows


def rebalanced(returns: DataFrame, weights: DataFrame, days: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """strategy, date, net, gross, turnover (null but on rebalancing days) of portfolios that return to their weights on their days (strategy, date).
    One that has lost everything stays at nothing and turns nothing over."""
    flags = returns.select("date").distinct().join(F.broadcast(weights.select("strategy").distinct()), how="cross").join(days.withColumn("flag", F.lit(1)), ["strategy", "date"], "left")
    flags = flags.withColumn("segment", F.coalesce(F.sum("flag").over(Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = Window.partitionBy("strategy", "asset", "segment").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = returns.join(weights, "asset").join(flags, ["strategy", "date"])
    grown = held.withColumn("v", F.col("w") * F.product(1 + F.col("r")).over(part))
    total = grown.groupBy("strategy", "segment", "date", "flag").agg(F.sum("v").alias("inside"), F.collect_list(F.struct("w", "v")).alias("x"))  # one entry for each asset
    drift = F.aggregate("x", F.lit(0.0), lambda a, e: a + F.coalesce(F.abs(F.try_divide(e["v"], F.col("inside")) - e["w"]), F.lit(0.0)))
    total = total.withColumn("turnover", F.when(F.col("flag") == 1, drift))
    ends = total.withColumn("k", F.row_number().over(Window.partitionBy("strategy", "segment").orderBy(F.desc("date")))).filter("k = 1")
    before = Window.partitionBy("strategy").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select(
        "strategy", "segment", F.coalesce(F.product("inside").over(before), F.lit(1.0)).alias("g0"),
        F.coalesce(F.product(F.col("inside") * (1 - F.coalesce("turnover", F.lit(0.0)) * cost_bps / 1e4)).over(before), F.lit(1.0)).alias("n0"),
    )
    out = total.join(start, ["strategy", "segment"])
    return out.select("strategy", "date", (F.col("n0") * F.col("inside") * (1 - F.coalesce("turnover", F.lit(0.0)) * cost_bps / 1e4)).alias("net"), (F.col("g0") * F.col("inside")).alias("gross"), "turnover")


def first_passages(rows: DataFrame, targets: DataFrame, drift: float | None) -> DataFrame:
    """strategy, s, next: for every date s after which a portfolio (targets: strategy, w, in the order of assets) stands at its weights, -1 being
    the purchase, the first later date that is flagged or on which a weight is off by more than drift; null if there is none.

    rows: block, i, date, flag and r, cumulated log growth of the assets.  Each s is looked for by itself: first in its own block of dates,
    then, as long as it isn't found, in the blocks after it, one equi-join by block for each round."""
    last = rows.agg(F.max("block")).first()[0]
    begun = rows.filter("i = 0").select(F.lit(-1).cast("long").alias("s"), "block", F.transform("r", lambda x: F.lit(0.0)).alias("from"))
    places = rows.select(F.col("i").alias("s"), "block", F.col("r").alias("from")).unionByName(begun)
    pending = staged(places.join(F.broadcast(targets), how="cross").withColumnRenamed("block", "probe"), "starts")  # strategies x dates rows

    def probed(starts: pd.DataFrame, dates: pd.DataFrame) -> pd.DataFrame:
        found: list[int | None] = []
        if len(dates):
            dates = dates.sort_values("i")
            at, level, flag = dates["i"].to_numpy(), np.stack(dates["r"].to_numpy()), dates["flag"].to_numpy(dtype=bool)
        for s, base, w in zip(starts["s"], starts["from"], starts["w"], strict=True):
            hit = np.zeros(0, dtype=bool)
            if len(dates):
                hit = flag.copy()
                if drift is not None:
                    v = w * np.exp(level - base)
                    hit |= np.abs(v / v.sum(axis=1, keepdims=True) - w).max(axis=1) > drift
                hit &= at > s
            found.append(int(at[hit.argmax()]) if hit.any() else None)
        return starts[["strategy", "s", "probe", "from", "w"]].assign(next=pd.array(found, dtype="Int64"))

    done, dates = [], rows.withColumnRenamed("block", "probe").select("probe", "i", "r", "flag")
    while True:
        tried = pending.groupBy("probe").cogroup(dates.groupBy("probe")).applyInPandas(probed, "strategy string, s long, probe int, `from` array<double>, w array<double>, next long")
        tried = staged(tried, "passages")
        over = F.col("next").isNotNull() | (F.col("probe") >= last)
        done.append(tried.filter(over).select("strategy", "s", "next"))
        pending = tried.filter(~over).withColumn("probe", F.col("probe") + 1).drop("next")
        if pending.isEmpty():
            return staged(reduce(DataFrame.unionByName, done), "passages")


def chain(jumps: DataFrame, start: int = -1) -> DataFrame:
    """strategy, s: all places that jumps (strategy, s, next) lead to from start, one after the other, by doubling: each round
    follows jumps twice as long from the places known so far."""
    known = staged(jumps.filter(F.col("s") == start).select("strategy", "s"), "chain")
    jumps, n = jumps.filter("next is not null"), known.count()
    while True:
        reached = known.join(jumps, ["strategy", "s"]).select("strategy", F.col("next").alias("s"))
        known = staged(known.unionByName(reached).distinct(), "chain")
        before, n = n, known.count()
        if n == before:
            return known.filter(F.col("s") != start)
        further = jumps.select("strategy", F.col("s").alias("next"), F.col("next").alias("end"))
        jumps = staged(jumps.join(further, ["strategy", "next"]).select("strategy", "s", F.col("end").alias("next")), "jumps")


def rebalancing_days(returns: DataFrame, weights: DataFrame, drift: float | None = None, days: DataFrame | None = None) -> DataFrame:
    """strategy, date of each rebalancing: whenever a weight is off by more than drift, on the given days (date), or, with both, whichever comes first."""
    grown = returns.withColumn("r", F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-300)))).over(panel.by_asset().rowsBetween(Window.unboundedPreceding, 0)))
    rows = dense(grown)
    flagged = rows.join(days.select("date", F.lit(True).alias("flag")), "date", "left") if days is not None else rows.withColumn("flag", F.lit(False))
    rows = numbered(flagged.withColumn("flag", F.coalesce("flag", F.lit(False))), "date")
    targets = weights.groupBy("strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", "w"))), lambda x: x["w"]).alias("w"))
    found = chain(first_passages(rows, targets, drift))
    return found.join(rows.select(F.col("i").alias("s"), "date"), "s").select("strategy", "date")


def simulate(returns: DataFrame, weights: DataFrame, drift: float | None = None, days: DataFrame | None = None, cost_bps: float = 10.0) -> DataFrame:
    """strategy, date, net, gross, turnover under a drift threshold, a calendar, or both (whichever comes first).  Every portfolio needs a weight for every asset."""
    if drift is None:
        return calendar(returns, weights, days, cost_bps) if days is not None else rebalanced(returns, weights, weights.select("strategy", F.lit(None).cast("date").alias("date")).limit(0), cost_bps)
    return rebalanced(returns, weights, staged(rebalancing_days(returns, weights, drift, days), "rebalancing-days"), cost_bps)


def costs(path: DataFrame, rf: float = 0.02) -> DataFrame:
    """Net and gross annual return (geometric over all dates), volatility, Sharpe ratio, the net Sortino ratio, drawdown and Calmar ratio,
    and turnover, number of rebalancings, cost drag.  Returns between values begin at the second date."""
    o = Window.partitionBy("strategy").orderBy("date")
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    x = path.withColumns({"rn": F.col("net") / F.lag("net").over(o) - 1, "rg": F.col("gross") / F.lag("gross").over(o) - 1, "dd": F.col("net") / F.max("net").over(upto) - 1})
    year = F.sqrt(F.lit(float(YEAR)))
    g = x.groupBy("strategy").agg(
        F.count("*").alias("n"), F.max_by("net", "date").alias("net"), F.max_by("gross", "date").alias("gross"), (F.stddev_samp("rn") * year).alias("vol_net"), (F.stddev_samp("rg") * year).alias("vol_gross"),
        F.count_if(F.col("rn") < 0).alias("losses"), (F.stddev_samp(F.when(F.col("rn") < 0, F.col("rn"))) * year).alias("down"), F.min("dd").alias("max_drawdown"),
        F.coalesce(F.sum("turnover"), F.lit(0.0)).alias("turnover"), F.count("turnover").alias("n_rebalances"),
    )
    annual = lambda c: F.pow(F.col(c), YEAR / F.col("n")) - 1
    g = g.withColumns({"ret_net": annual("net"), "ret_gross": annual("gross")})
    return g.select(
        "strategy", "ret_net", "ret_gross", "vol_net", "vol_gross", ratio(F.col("ret_net") - rf, F.col("vol_net")).alias("sharpe_net"), ratio(F.col("ret_gross") - rf, F.col("vol_gross")).alias("sharpe_gross"),
        ratio(F.col("ret_net") - rf, F.when(F.col("losses") > 0, F.col("down")).otherwise(F.col("vol_net"))).alias("sortino_net"), "max_drawdown",
        F.when(F.col("max_drawdown") != 0, F.col("ret_net") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar_net"),
        "turnover", (F.col("turnover") * YEAR / F.col("n")).alias("turnover_a_year"), "n_rebalances", (F.col("ret_gross") - F.col("ret_net")).alias("cost_drag"),
    )


def rank_change(summary: DataFrame) -> DataFrame:
    """strategy, rank_gross, rank_net and what costs change in it."""
    by = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "strategy"))  # noqa: E731  one row for each strategy
    return summary.select("strategy", by("sharpe_gross").alias("rank_gross"), by("sharpe_net").alias("rank_net")).withColumn("change", F.col("rank_gross") - F.col("rank_net"))


def cost_drags(summary: DataFrame) -> DataFrame:
    """kind (average, most affected, least affected), strategy (null for the average), cost_drag, turnover_a_year, n_rebalances, of costs(); ties by name."""
    values = ("cost_drag", "turnover_a_year", "n_rebalances")
    own = F.struct("strategy", *[F.col(c).cast("double").alias(c) for c in values])
    mean = F.struct(F.lit(None).cast("string").alias("strategy"), *[F.avg(c).alias(c) for c in values])
    g = summary.agg(mean.alias("average"), F.min_by(own, F.struct(-F.col("cost_drag"), "strategy")).alias("most"), F.min_by(own, F.struct("cost_drag", "strategy")).alias("least"))
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(c).alias("x")) for name, c in (("average", "average"), ("most affected", "most"), ("least affected", "least"))])
    return g.select(F.explode(kinds).alias("k")).select("k.kind", "k.x.*")
