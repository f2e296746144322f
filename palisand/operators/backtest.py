"""Back-tests and their validation.

Windows, splits, parameter values and resamples are independent, so each is a group of its own that Spark deals to
tasks.  A run's days meet the estimates and targets that hold for them in joins; weights between rebalancing days are closed forms.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisand.functions.distributions import binomial_two_sided, t_two_sided
from palisand.operators import metrics, optimize
from palisand.operators.blocks import numbered
from palisand.operators.factors import NAMES, RECENT, components, regimes
from palisand.storage import staged

YEAR = 252
#: Fewest dates of a fold, of a split's training part and of its test part.
LEAST_FOLD, LEAST_TRAIN, LEAST_TEST = 20, 50, 10


@dataclass(frozen=True)
class Config:
    """One run of the mean-reversion back-test.  The counters of re-estimation and rebalancing are checked before they are
    raised, so both happen every freq + period_offset dates.  z_exit is accepted and has no effect."""

    run_id: str = "base"
    window: int = 252
    reestimation_freq: int = 21
    rebalance_freq: int = 5
    n_components: int = 5
    z_entry: float = 2.0
    z_exit: float = 0.5
    cost_bps: float = 10.0
    min_weight: float = 0.05
    max_weight: float = 0.40
    use_hmm: bool = True
    n_regimes: int = 2
    panic_factor: float = 0.3
    normal_factor: float = 0.7
    max_tilt: float = 0.15
    period_offset: int = 1


def _checked(configs: Sequence[Config]) -> dict[str, Config]:
    """configs by run_id; ValueError unless they are sound and differ in it."""
    for f in configs:
        if f.window < 2 or f.n_components < 1 or f.min_weight > f.max_weight:
            raise ValueError(f"bad configuration {f.run_id}")
    if len({c.run_id for c in configs}) < len(configs):
        raise ValueError("two runs have the same run_id")
    return {c.run_id: c for c in configs}


def ordered(logs: DataFrame) -> DataFrame:
    """block, i (from 0), date, and in the order of assets r and before, the sum of r on the dates before."""
    upto = F.sum("r").over(Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    long = logs.select("date", "asset", "r", (upto - F.col("r")).alias("before"))
    rows = long.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", "r", "before"))).alias("x"))  # one entry for each asset
    return numbered(rows.select("date", F.col("x.r").alias("r"), F.col("x.before").alias("before")), "date")


def _runs(spark: SparkSession, configs: Sequence[Config]) -> DataFrame:
    return spark.createDataFrame([(c.run_id, c.window, c.reestimation_freq + c.period_offset, c.rebalance_freq + c.period_offset) for c in configs], "run_id string, window int, step int, rebalance int")


def _dealt(rows: DataFrame, runs: DataFrame, back: Column, ahead: Column) -> DataFrame:
    """rows and runs, a copy for each estimation date t = window + k step of the run with t - back <= i < t + ahead."""
    last = rows.agg(F.max("i").alias("last"))
    k0 = F.greatest(F.floor((F.col("i") - F.col("window") - ahead) / F.col("step")) + 1, F.lit(0))
    k1 = F.least(F.floor((F.col("i") - F.col("window") + back) / F.col("step")), F.floor((F.col("last") - F.col("window")) / F.col("step")))
    dealt = rows.join(F.broadcast(runs), how="cross").join(F.broadcast(last), how="cross").filter(k0 <= k1)  # a row for each run; one row
    return dealt.withColumn("k", F.explode(F.sequence(k0, k1))).withColumn("t", (F.col("window") + F.col("k") * F.col("step")).cast("int"))


def estimates(spark: SparkSession, rows: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """run_id, t, mean, sd, loadings (by component), reverting, move, centre, spread: what each run learns on the window
    of dates before its estimation date t.  Each (run, t) is a group of window rows."""
    known = _checked(configs)
    dealt = _dealt(rows, _runs(spark, configs), F.col("window"), F.lit(0)).select("run_id", "t", "i", "r")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        c = known[frame["run_id"].iloc[0]]
        x = np.stack(frame.sort_values("i")["r"].to_numpy())
        mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
        z = (x - mean) / sd
        v, _ = components(z.T @ z / len(z), c.n_components)
        f = (z @ v).cumsum(axis=0)
        past, now = f[:-1] - f[:-1].mean(axis=0), f[1:] - f[1:].mean(axis=0)
        beta = (past * now).sum(axis=0) / np.maximum((past**2).sum(axis=0), 1e-300)
        reverting = [bool(0 < b < 0.99 and math.log(2) / -math.log(b) < 60) for b in beta]
        move, centre, spread = np.zeros((0, 0)), np.zeros(0), np.zeros(0)
        if c.use_hmm:
            _, _, move, centre, spread = regimes(x.mean(axis=1), c.n_regimes)
        return pd.DataFrame([(c.run_id, int(frame["t"].iloc[0]), mean, sd, v.T.ravel(), reverting, move.ravel(), centre, spread)],
                            columns=["run_id", "t", "mean", "sd", "loadings", "reverting", "move", "centre", "spread"])

    a = "array<double>"
    return dealt.groupBy("run_id", "t").applyInPandas(learn, f"run_id string, t int, mean {a}, sd {a}, loadings {a}, reverting array<boolean>, move {a}, centre {a}, spread {a}")


def regime_now(x: np.ndarray, move: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> int:
    """The last state of the most likely path."""
    like = -0.5 * ((x[:, None] - centre) / spread) ** 2 - np.log(spread)
    logs, best = np.log(np.maximum(move, 1e-300)), like[0]
    for row in like[1:]:
        best = (best[:, None] + logs).max(axis=0) + row
    return int(best.argmax())


def target(z: np.ndarray, load: np.ndarray, reverting: Sequence[bool], regime: str, c: Config) -> tuple[np.ndarray, dict[int, float]]:
    """Equal weights tilted against the reverting factors (but the first) that stand far out, and those factors' z by number from 1."""
    n = load.shape[1]
    active = {k: z[k] for k in range(1, len(z)) if reverting[k] and abs(z[k]) >= c.z_entry}
    tilt = np.zeros(n)
    for k, x in active.items():
        tilt -= np.sign(x) * min((abs(x) - c.z_entry) / c.z_entry, 1.0) * c.max_tilt * load[k]
    w = np.clip(1 / n + tilt * {"Panic": c.panic_factor, "Normal": c.normal_factor}.get(regime, 1.0), c.min_weight, c.max_weight)
    return w / w.sum(), {k + 1: float(x) for k, x in active.items()}


def signals(rows: DataFrame, learned: DataFrame, runs: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """run_id, i, t, z: on each date from the window's end on, how far every factor's running sum stands out against its last RECENT values
    (fewer, if the window is shorter), by the latest estimate t.  Since only differences count, the sum runs over the dates that the estimate's z need."""
    parts = []
    for back in sorted({min(RECENT, c.window) for c in configs}):
        own = runs.filter(F.least("window", F.lit(RECENT)) == back)
        scored = _dealt(rows, own, F.lit(back), F.col("step")).join(learned, ["run_id", "t"])
        score = lambda load: F.aggregate(F.zip_with("e", load, lambda e, v: e * v), F.lit(0.0), lambda a, v: a + v)
        n = F.size("r")
        x = scored.withColumn("e", F.zip_with(F.zip_with("r", "mean", lambda a, m: a - m), "sd", lambda a, s: a / s))
        x = x.select("run_id", "t", "i", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("loadings") / n).cast("int") - 1), lambda k: score(F.slice("loadings", k * n + 1, n)))).alias("factor", "score"))
        by = Window.partitionBy("run_id", "t", "factor").orderBy("i")
        x = x.withColumn("f", F.sum("score").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        near = by.rowsBetween(-back, -1)
        sd = F.stddev_pop("f").over(near)
        z = F.when(sd > 1e-8, (F.lag("f").over(by) - F.avg("f").over(near)) / sd).otherwise(0.0)
        on = x.withColumn("z", z).filter("i >= t").groupBy("run_id", "i", "t").agg(F.array_sort(F.collect_list(F.struct("factor", "z"))).alias("z"))  # one entry for each factor
        parts.append(on.select("run_id", "i", "t", F.col("z.z").alias("z")))
    return reduce(DataFrame.unionByName, parts)


def regimes_now(rows: DataFrame, learned: DataFrame, runs: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """run_id, i, regime: the last state of the most likely path over the window before each date, by the latest estimate.  A group has the dates that one
    estimate looks at."""
    known = _checked(configs)
    used = runs.filter(F.col("run_id").isin([c.run_id for c in configs if c.use_hmm]))
    mean = F.aggregate("r", F.lit(0.0), lambda a, v: a + v) / F.size("r")
    dealt = _dealt(rows, used, F.col("window"), F.col("step")).select("run_id", "t", "i", mean.alias("m")).join(learned.select("run_id", "t", "move", "centre", "spread"), ["run_id", "t"])

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        c, p, m, i = known[frame["run_id"].iloc[0]], frame.iloc[0], frame["m"].to_numpy(), frame["i"].to_numpy()
        move = np.array(p.move).reshape(c.n_regimes, -1)
        days = i[i >= p.t]
        states = [regime_now(m[(i >= d - c.window) & (i < d)], move, np.array(p.centre), np.array(p.spread)) for d in days]
        return pd.DataFrame({"run_id": c.run_id, "i": days, "regime": [NAMES[c.n_regimes][x] for x in states]})

    return dealt.groupBy("run_id", "t").applyInPandas(last, "run_id string, i long, regime string")


def _normal(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y))


def _drifted(w: Column, then: Column, now: Column) -> Column:
    """Weights w after log returns, whose sums before stood at then and now."""
    return _normal(F.zip_with(w, F.zip_with(now, then, lambda a, b: F.exp(a - b)), lambda x, g: x * g))


def path(spark: SparkSession, rows: DataFrame, learned: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """run_id, date, r (strategy), b (equal weights), regime, turnover, cost, traded, signals (z of active factors), z: a row for each date from
    the window's end on, from what each run has learned (staged; as estimates()).

    Targets on rebalancing days depend on signals, not on the path; between them weights drift in closed form; so a day meets its estimate, its rebalancing
    day and the one before that in equi-joins, and no run is walked."""
    known, runs = _checked(configs), _runs(spark, configs)
    z = signals(rows, learned, runs, configs)
    if any(c.use_hmm for c in configs):
        z = z.join(regimes_now(rows, learned, runs, configs), ["run_id", "i"], "left")
    else:
        z = z.withColumn("regime", F.lit("Calm"))
    z = staged(z.withColumn("regime", F.coalesce("regime", F.lit("Calm"))).join(F.broadcast(runs), "run_id"), "signals")
    n = F.floor((F.col("i") - F.col("window")) / F.col("rebalance"))
    days = z.withColumn("s", F.col("window") + n * F.col("rebalance"))
    chosen = days.filter("i = s").join(learned.select("run_id", "t", "loadings", "reverting"), ["run_id", "t"]).select("run_id", "s", "rebalance", "regime", "z", "loadings", "reverting")

    def targets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame.itertuples(index=False):
                c, z = known[p.run_id], np.array(p.z)
                w, active = target(z, np.array(p.loadings).reshape(len(z), -1), p.reverting, p.regime, c)
                out.append((p.run_id, p.s, p.rebalance, w, active))
            yield pd.DataFrame(out, columns=["run_id", "s", "rebalance", "w", "signals"])

    places = rows.select("i", "before")
    at = chosen.mapInPandas(targets, "run_id string, s long, rebalance int, w array<double>, signals map<int, double>").join(places.withColumnRenamed("i", "s"), "s")
    at = staged(at, "targets")
    earlier = at.select("run_id", (F.col("s") + F.col("rebalance")).alias("s"), F.col("w").alias("w0"), F.col("before").alias("before0"))
    held = F.coalesce(_drifted(F.col("w0"), F.col("before0"), F.col("before")), F.transform("w", lambda x: 1.0 / F.size("w")))
    moved = F.aggregate(F.zip_with("w", held, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
    cost = F.create_map(*[x for c in configs for x in (F.lit(c.run_id), F.lit(float(c.cost_bps)))])
    at = at.join(earlier, ["run_id", "s"], "left").select("run_id", "s", "w", "signals", F.col("before").alias("then"), moved.alias("turnover"))
    on = days.select("run_id", "i", "s", "z", "regime").join(rows.select("i", "date", "r", "before"), "i").join(at, ["run_id", "s"])
    traded = F.col("i") == F.col("s")
    on = on.withColumn("turnover", F.when(traded, F.col("turnover")).otherwise(0.0)).withColumn("cost", F.col("turnover") * cost[F.col("run_id")] / 1e4)
    earned = F.aggregate(F.zip_with(_drifted(F.col("w"), F.col("then"), F.col("before")), "r", lambda w, x: w * x), F.lit(0.0), lambda a, v: a + v)
    mean = F.aggregate("r", F.lit(0.0), lambda a, v: a + v) / F.size("r")
    none = F.create_map().cast("map<int, double>")
    return on.select("run_id", "date", (earned - F.col("cost")).alias("r"), mean.alias("b"), "regime", "turnover", "cost", (F.col("turnover") > 0.001).alias("traded"), F.when(traded, F.col("signals")).otherwise(none).alias("signals"), "z")


def run(spark: SparkSession, logs: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """path() of what each run learns from log returns."""
    _checked(configs)
    rows = ordered(logs)
    return path(spark, rows, staged(estimates(spark, rows, configs), "estimates"), configs)


def summary(path: DataFrame, rf: float = 0.02) -> DataFrame:
    """run_id, n, annual returns of strategy and equal weights (compounded), excess, volatility, Sharpe ratio, drawdown, information ratio,
    number of trades, turnover, costs, win rate on trade days (0.5 without any)."""
    series = path.withColumnRenamed("run_id", "strategy")
    dd = metrics.equity(series).groupBy("strategy").agg(F.min("drawdown").alias("max_drawdown"))
    x = F.col("r") - F.col("b")
    g = series.groupBy("strategy").agg(
        F.count("*").alias("n"), (F.product(1 + F.col("r"))).alias("pr"), (F.product(1 + F.col("b"))).alias("pb"), (F.stddev_samp("r") * math.sqrt(YEAR)).alias("vol"),
        F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * math.sqrt(YEAR)).otherwise(0.0).alias("information_ratio"),
        F.count_if("traded").alias("trades"), F.sum("turnover").alias("turnover"), F.sum("cost").alias("costs"),
        F.coalesce(F.avg(F.when(F.col("traded"), (x > 0).cast("double"))), F.lit(0.5)).alias("win_rate"),
    )
    annual = lambda c: F.pow(F.col(c), YEAR / F.col("n")) - 1
    out = g.withColumns({"ann_return": annual("pr"), "benchmark": annual("pb")}).join(dd, "strategy")
    return out.select(F.col("strategy").alias("run_id"), "n", "ann_return", "benchmark", (F.col("ann_return") - F.col("benchmark")).alias("excess"), "vol",
                      metrics.ratio(F.col("ann_return") - rf, F.col("vol")).alias("sharpe"), "max_drawdown", "information_ratio", "trades", "turnover", "costs", "win_rate")


def full_summary(path: DataFrame) -> DataFrame:
    """run_id and the engine's whole table of a path (run_id, date, r, b, regime, turnover, cost, traded), without a risk-free rate: total and
    annual (geometric) returns of strategy and benchmark, volatilities, Sharpe, Sortino and Calmar ratios, alpha and beta, information
    ratio (difference of annual returns over tracking error), drawdown, VaR and CVaR of both, trades, turnover (sum and mean), costs,
    win rate on trade days, dates and years, and return and volatility in each regime."""
    s = path.withColumnRenamed("run_id", "strategy")
    year, x = math.sqrt(YEAR), F.col("r") - F.col("b")
    sd = lambda c: F.stddev_samp(c) * year
    both = {"r": s.select("strategy", "date", "r"), "b": s.select("strategy", "date", F.col("b").alias("r"))}
    side = {k: metrics.equity(v).groupBy("strategy").agg(F.min("drawdown").alias(f"dd_{k}")).join(metrics.tail(v).select("strategy", F.col("var").alias(f"var_{k}"), F.col("cvar").alias(f"cvar_{k}")), "strategy") for k, v in both.items()}
    known = lambda name: F.col("regime") == name
    in_regime = [c for name in NAMES[3] for c in ((F.avg(F.when(known(name), F.col("r"))) * YEAR).alias(f"return_{name.lower()}"), sd(F.when(known(name), F.col("r"))).alias(f"vol_{name.lower()}"))]
    g = s.groupBy("strategy").agg(
        F.count("*").alias("n_days"), (F.product(1 + F.col("r")) - 1).alias("total_return"), (F.product(1 + F.col("b")) - 1).alias("total_benchmark"),
        sd("r").alias("vol"), sd("b").alias("vol_benchmark"), F.count_if(F.col("r") < 0).alias("losses"), sd(F.when(F.col("r") < 0, F.col("r"))).alias("loss_vol"),
        F.regr_slope("r", "b").alias("beta"), (F.regr_intercept("r", "b") * YEAR).alias("alpha"), sd(x).alias("tracking"),
        F.count_if("traded").alias("n_trades"), F.coalesce(F.sum(F.when(F.col("traded"), F.col("turnover"))), F.lit(0.0)).alias("turnover"), F.coalesce(F.sum(F.when(F.col("traded"), F.col("cost"))), F.lit(0.0)).alias("costs"),
        F.coalesce(F.avg(F.when(F.col("traded"), (x > 0).cast("double"))), F.lit(0.5)).alias("win_rate"), *in_regime,
    )
    g = g.withColumn("n_years", F.col("n_days") / YEAR)
    annual = lambda c: F.pow(1 + F.col(c), 1 / F.col("n_years")) - 1
    g = g.withColumns({"ann_return": annual("total_return"), "ann_benchmark": annual("total_benchmark")}).join(side["r"], "strategy").join(side["b"], "strategy")
    drawn = lambda a, d: F.when(F.col(d) != 0, F.col(a) / F.abs(d)).otherwise(0.0)
    return g.select(
        F.col("strategy").alias("run_id"), "total_return", "total_benchmark", (F.col("total_return") - F.col("total_benchmark")).alias("excess"), "ann_return", "ann_benchmark", "vol", "vol_benchmark",
        metrics.ratio(F.col("ann_return"), F.col("vol")).alias("sharpe"), metrics.ratio(F.col("ann_benchmark"), F.col("vol_benchmark")).alias("sharpe_benchmark"),
        metrics.ratio(F.col("ann_return"), F.when(F.col("losses") > 0, F.col("loss_vol")).otherwise(F.col("vol"))).alias("sortino"),
        drawn("ann_return", "dd_r").alias("calmar"), drawn("ann_benchmark", "dd_b").alias("calmar_benchmark"), "alpha", "beta",
        metrics.ratio(F.col("ann_return") - F.col("ann_benchmark"), F.col("tracking")).alias("information_ratio"), F.col("dd_r").alias("max_drawdown"), F.col("dd_b").alias("max_drawdown_benchmark"),
        F.col("var_r").alias("var_95"), F.col("cvar_r").alias("cvar_95"), F.col("var_b").alias("var_95_benchmark"), F.col("cvar_b").alias("cvar_95_benchmark"),
        "n_trades", "turnover", "costs", metrics.ratio(F.col("turnover"), F.col("n_trades")).alias("mean_turnover"), "win_rate", "n_days", "n_years",
        *[f"{k}_{name.lower()}" for name in NAMES[3] for k in ("return", "vol")],
    )


def by_regime(path: DataFrame) -> DataFrame:
    """run_id, regime, n, share of dates, annual return and volatility, Sharpe ratio, of strategy and equal weights."""
    total = path.groupBy("run_id").agg(F.count("*").alias("all"))
    sd = lambda c: F.stddev_samp(c) * math.sqrt(YEAR)
    g = path.groupBy("run_id", "regime").agg(F.count("*").alias("n"), (F.avg("r") * YEAR).alias("ret"), (F.avg("b") * YEAR).alias("ret_b"), sd("r").alias("vol"), sd("b").alias("vol_b"))
    return g.join(total, "run_id").select("run_id", "regime", "n", (F.col("n") / F.col("all")).alias("share"), "ret", "vol", "ret_b", "vol_b", metrics.ratio(F.col("ret"), F.col("vol")).alias("sharpe"))


def contributions(path: DataFrame) -> DataFrame:
    """run_id, factor, contribution: each trade day's return shared out by |z| of its active factors."""
    z = path.filter("traded and size(signals) > 0").select("run_id", "date", "r", F.explode("signals").alias("factor", "z"), F.aggregate(F.map_values("signals"), F.lit(0.0), lambda a, v: a + F.abs(v)).alias("total"))
    return z.groupBy("run_id", "factor").agg(F.sum(F.col("r") * F.abs("z") / F.col("total")).alias("contribution"), F.count("*").alias("days"))


def signal_decay(series: DataFrame, entry: float, most: int = 30) -> DataFrame:
    """side, horizon, mean compounded return over the horizon after a signal (strategy, date, r, z), and how many there are."""
    o = Window.partitionBy("strategy").orderBy("date")
    x = series.withColumns({"i": F.row_number().over(o), "grown": F.sum(F.ln(1 + F.col("r"))).over(o.rowsBetween(Window.unboundedPreceding, 0))})
    fired = x.filter(F.abs("z") > entry).select("strategy", F.when(F.col("z") > 0, "short").otherwise("long").alias("side"), "i", F.col("grown").alias("from"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("horizon"))
    later = x.select("strategy", F.col("i").alias("to_i"), F.col("grown").alias("to"))
    met = fired.withColumn("to_i", F.col("i") + F.col("horizon")).join(later, ["strategy", "to_i"])
    return met.groupBy("strategy", "side", "horizon").agg(F.avg(F.exp(F.col("to") - F.col("from")) - 1).alias("mean"), F.count("*").alias("n"))


# --- validation


def walk_forward(returns: DataFrame, share: float = 0.7, strategies: Sequence[str] = optimize.STRATEGIES, rf: float = 0.02) -> DataFrame:
    """strategy, sharpe_train, sharpe_test, stability (their ratio) with weights from the first share of dates."""
    days = returns.select("date").distinct()
    last = int(days.count() * share)
    cut = days.withColumn("k", F.row_number().over(Window.orderBy("date")))  # one row for each date
    sides = staged(returns.join(cut.select("date", (F.col("k") <= last).alias("train")), "date"), "sides")
    w = staged(optimize.weights(sides.filter("train").drop("train"), strategies, rf), "weights")  # strategies x assets rows
    # what is sent has strategies x assets rows
    port = staged(sides.join(F.broadcast(w), "asset").groupBy("strategy", "train", "date").agg(F.sum(F.col("w") * F.col("r")).alias("r")), "portfolios")
    labelled = port.withColumn("strategy", F.concat_ws("|", F.when(F.col("train"), "in").otherwise("out"), "strategy"))
    s = metrics.basic(labelled, rf).select(F.split("strategy", r"\|")[1].alias("strategy"), F.split("strategy", r"\|")[0].alias("side"), "sharpe")
    both = s.groupBy("strategy").agg(F.first(F.when(F.col("side") == "in", F.col("sharpe")), True).alias("sharpe_train"), F.first(F.when(F.col("side") == "out", F.col("sharpe")), True).alias("sharpe_test"))
    return both.withColumn("stability", F.when(F.col("sharpe_train") != 0, F.col("sharpe_test") / F.col("sharpe_train")))


def splits(returns: DataFrame, folds: int = 5, test: int = 2, embargo: float = 0.01, after: str = "last_fold") -> DataFrame:
    """split_id, date, role (train or test): every choice of test folds.  Dates that follow the last test fold (or, all_folds, each) by
    less than embargo of all dates are in neither.  ValueError where a fold has less than LEAST_FOLD dates; splits of less than
    LEAST_TRAIN training or LEAST_TEST test dates are left out."""
    days = returns.select("date").distinct()
    found = days.count()
    if found // folds < LEAST_FOLD:
        raise ValueError(f"{found} dates are too few for {folds} folds of {LEAST_FOLD} at least")
    k = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"), F.lit(found).cast("long").alias("n"))  # one row for each date
    size = F.floor(F.col("n") / folds)
    k = k.withColumn("fold", F.least(F.floor(F.col("i") / size), F.lit(folds - 1)).cast("int"))
    choices = list(itertools.combinations(range(folds), test))
    cases = F.explode(F.array(*[F.struct(F.lit(s).alias("split_id"), F.array(*map(F.lit, c)).alias("tests")) for s, c in enumerate(choices)]))
    k = k.withColumn("c", cases).select("date", "i", "n", "fold", size.alias("size"), "c.split_id", "c.tests")
    end = lambda f: F.when(f == folds - 1, F.col("n")).otherwise((f + 1) * F.col("size"))
    near = lambda f: (F.col("i") >= end(f)) & (F.col("i") < end(f) + F.floor(F.col("n") * embargo))
    out = near(F.array_max("tests")) if after == "last_fold" else F.exists("tests", near)
    role = F.when(F.array_contains("tests", F.col("fold")), "test").when(out, "embargo").otherwise("train")
    out = k.select("split_id", "date", role.alias("role")).filter("role <> 'embargo'")
    each = Window.partitionBy("split_id")
    held = lambda r: F.count_if(F.col("role") == r).over(each)
    return out.withColumns({"_train": held("train"), "_test": held("test")}).filter((F.col("_train") >= LEAST_TRAIN) & (F.col("_test") >= LEAST_TEST)).select("split_id", "date", "role")


def cross_validated(returns: DataFrame, parts: DataFrame, strategies: Sequence[str] = ("equal", "min_vol", "max_sharpe", "hrp"), rf: float = 0.02) -> DataFrame:
    """method, split_id, role and the robust metrics of each: weights are learned on each split's training dates, all splits in one plan."""
    dealt = staged(returns.join(parts, "date"), "splits")
    w = staged(optimize.weights(dealt.filter("role = 'train'").select("split_id", "date", "asset", "r"), strategies, rf, by=["split_id"]), "weights")
    port = dealt.join(w.withColumnRenamed("strategy", "method"), ["split_id", "asset"]).groupBy("method", "split_id", "role", "date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    port = staged(port, "portfolios")
    named = port.withColumn("strategy", F.concat_ws("|", "method", "split_id", "role"))
    out, part = metrics.robust(named, rf), lambda i: F.split("strategy", r"\|")[i]
    return out.select(part(0).alias("method"), part(1).cast("int").alias("split_id"), part(2).alias("role"), "sharpe", "sortino", "calmar", "max_drawdown_abs", "cvar_95", "win_rate")


def overfitting(scores: DataFrame) -> DataFrame:
    """n_splits, pbo: the share of splits in which the method that is best in training ranks below the middle in the test (ties: mean rank)."""
    w = Window.partitionBy("split_id", "role")
    rank = F.rank().over(w.orderBy(F.desc("sharpe"))) + (F.count("*").over(Window.partitionBy("split_id", "role", "sharpe")) - 1) / 2
    ranked = scores.filter(F.col("sharpe").isNotNull()).withColumns({"place": rank, "n": F.count("*").over(w)})
    best = ranked.filter("role = 'train'").groupBy("split_id").agg(F.min_by("method", F.struct("place", "method")).alias("method"))
    met = ranked.filter("role = 'test'").join(best, ["split_id", "method"])
    return met.agg(F.count("*").alias("n_splits"), F.avg((F.col("place") > (F.col("n") + 1) / 2).cast("double")).alias("pbo"))


def ranking(scores: DataFrame) -> DataFrame:
    """method, medians of the test metrics, worst drawdown, mean win rate and place by median Sharpe ratio."""
    g = scores.filter("role = 'test'").groupBy("method").agg(
        F.median("sharpe").alias("sharpe"), F.median("sortino").alias("sortino"), F.median("calmar").alias("calmar"), F.max("max_drawdown_abs").alias("worst"), F.avg("win_rate").alias("win_rate")
    )
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sharpe"), "method")))  # one row for each method


def significance(series: DataFrame, null_sharpe: float = 0.0) -> DataFrame:
    """strategy, t and p of the daily Sharpe ratio (standard error sqrt((1 + s^2 / 2) / n)), of the mean excess over b, and the
    exact binomial p of the days won; columns strategy, date, r, b.  One row for each strategy reaches Python."""
    x = F.col("r") - F.col("b")
    g = series.groupBy("strategy").agg(
        F.count("*").alias("n"), F.when(F.stddev_samp("r") > 0, F.avg("r") / F.stddev_samp("r")).otherwise(0.0).alias("s"),
        F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * F.sqrt(F.count("*"))).alias("t_excess"), F.count_if(x > 0).alias("wins"),
    )
    g = g.withColumn("t_sharpe", (F.col("s") - null_sharpe) / F.sqrt((1 + F.col("s") ** 2 / 2) / F.col("n"))).select("strategy", "n", "wins", "t_sharpe", "t_excess")

    def p_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = lambda c: [None if pd.isna(t) else t_two_sided(t, n - 1) for t, n in zip(f[c], f["n"], strict=True)]  # noqa: B023, E731
            yield f.assign(p_sharpe=p("t_sharpe"), p_excess=p("t_excess"), p_wins=[binomial_two_sided(k, n) for k, n in zip(f["wins"], f["n"], strict=True)])

    return g.mapInPandas(p_values, "strategy string, n long, wins long, t_sharpe double, t_excess double, p_sharpe double, p_excess double, p_wins double")


def bootstrap(spark: SparkSession, series: DataFrame, metric, resamples: int = 5000, block: int | None = None, seed: int = 42) -> DataFrame:
    """strategy, point, mean, sd (population), low, high (2.5 and 97.5 %) of metric(array) under resampling in blocks of dates
    (default sqrt(n); 1: single dates).  A row per strategy holds its dates' returns; resamples are dealt to tasks with a seed each."""
    rows = series.groupBy("strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "r"))), lambda e: e["r"]).alias("r"))
    tasks = spark.range(resamples).withColumnRenamed("id", "k").crossJoin(F.broadcast(rows))  # strategies x dates numbers, whatever the sales

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, r in zip(f["k"], f["r"], strict=True):
                rng, size = np.random.default_rng([seed, k]), block or max(1, int(math.sqrt(len(r))))
                starts = rng.integers(0, len(r) - size + 1, -(-len(r) // size))
                out.append(float(metric(r[(starts[:, None] + np.arange(size)).ravel()[: len(r)]])))
            yield pd.DataFrame({"strategy": f["strategy"], "m": out})

    def once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"strategy": f["strategy"], "point": [float(metric(r)) for r in f["r"]]})

    drawn = tasks.mapInPandas(draw, "strategy string, m double").groupBy("strategy").agg(
        F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")
    )
    return rows.mapInPandas(once, "strategy string, point double").join(drawn, "strategy")


def sensitivity(spark: SparkSession, logs: DataFrame, base: Config, name: str, values: Sequence) -> DataFrame:
    """The summary of a run for each value of one parameter, all in one plan."""
    if name not in {f.name for f in fields(Config)}:
        raise ValueError(f"no parameter {name}")
    return summary(run(spark, logs, [Config(**(asdict(base) | {name: v, "run_id": f"{name}={v}"})) for v in values]))
