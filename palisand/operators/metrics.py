"""Performance and risk metrics of return series, one row per strategy.

Input: strategy, date, r (and b, a benchmark's return, where named).  All strategies share one plan: a
window pass over (strategy, date), a quantile, one aggregate.  Three definitions of the Sharpe
ratio and two of the Sortino ratio live side by side, as they differ in use:
basic (arithmetic, annual rate subtracted after annualising), excess (rate per period subtracted
first) and geometric (in palisand.operators.rebalance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
INFINITY = float("inf")


def equity(returns: DataFrame) -> DataFrame:
    """returns with equity (product of 1 + r), peak and drawdown.  The curve starts at 1 + r of the
    first date, so a loss on that date is no drawdown."""
    path = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("equity", F.product(1 + F.col("r")).over(path))
    df = df.withColumn("peak", F.max("equity").over(path))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def tail(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """strategy, var (interpolated quantile) and cvar (mean at or below it)."""
    var = returns.groupBy("strategy").agg(F.percentile("r", F.lit(alpha)).alias("var"))
    return returns.join(var, "strategy").groupBy("strategy").agg(F.first("var").alias("var"), F.coalesce(F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))), F.first("var")).alias("cvar"))


def worst_dates(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """strategy, place, date, r and var of the dates whose return is at or below the interpolated quantile, the worst first."""
    var = returns.groupBy("strategy").agg(F.percentile("r", F.lit(alpha)).alias("var"))
    place = F.row_number().over(Window.partitionBy("strategy").orderBy("r", "date"))
    return returns.join(var, "strategy").filter(F.col("r") <= F.col("var")).select("strategy", place.alias("place"), "date", "r", "var")


def extremes(returns: DataFrame) -> DataFrame:
    """strategy, unit (date or month), best, best_date, worst, worst_date: months are compounded and named by their last date; of equal ones the first."""
    months = returns.groupBy("strategy", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date"), (F.product(1 + F.col("r")) - 1).alias("r"))
    both = returns.select("strategy", F.lit("date").alias("unit"), "date", "r").unionByName(months.select("strategy", F.lit("month").alias("unit"), "date", "r"))
    best, worst = F.min(F.struct((-F.col("r")).alias("r"), "date")).alias("best"), F.min(F.struct("r", "date")).alias("worst")
    return both.groupBy("strategy", "unit").agg(best, worst).select("strategy", "unit", (-F.col("best.r")).alias("best"), F.col("best.date").alias("best_date"), F.col("worst.r").alias("worst"), F.col("worst.date").alias("worst_date"))


def ratio(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0) if otherwise is None else otherwise)


def basic(returns: DataFrame, rf: float = 0.0) -> DataFrame:
    """ann_return, ann_vol, sharpe, sortino, max_drawdown (negative), calmar, var_5, cvar_5, n."""
    r, year = F.col("r"), F.sqrt(F.lit(float(YEAR)))
    g = equity(returns).groupBy("strategy").agg(
        F.count("r").alias("n"),
        (F.avg("r") * YEAR).alias("ann_return"),
        (F.stddev_samp("r") * year).alias("ann_vol"),
        F.count_if(r < 0).alias("losses"),
        (F.stddev_samp(F.when(r < 0, r)) * year).alias("loss_vol"),
        F.min("drawdown").alias("max_drawdown"),
    )
    down = F.when(F.col("losses") > 0, F.col("loss_vol")).otherwise(F.col("ann_vol"))
    return g.join(tail(returns), "strategy").select(
        "strategy", "n", "ann_return", "ann_vol",
        ratio(F.col("ann_return") - rf, F.col("ann_vol")).alias("sharpe"),
        ratio(F.col("ann_return") - rf, down).alias("sortino"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("ann_return") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar"),
        F.col("var").alias("var_5"), F.col("cvar").alias("cvar_5"),
    )


def robust(returns: DataFrame, rf: float = 0.0) -> DataFrame:
    """sharpe, sortino (infinite without losses, null with a single one), calmar, max_drawdown_abs, cvar_95, win_rate."""
    r, year = F.col("r"), F.sqrt(F.lit(float(YEAR)))
    g = equity(returns).groupBy("strategy").agg(
        (F.avg("r") * YEAR).alias("mean"), (F.stddev_samp("r") * year).alias("vol"),
        F.count_if(r < 0).alias("losses"), (F.stddev_samp(F.when(r < 0, r)) * year).alias("loss_vol"),
        F.abs(F.min("drawdown")).alias("max_drawdown_abs"), F.avg((r > 0).cast("double")).alias("win_rate"),
    )
    over = F.col("mean") - rf
    return g.join(tail(returns), "strategy").select(
        "strategy",
        F.when(F.col("vol") > 0, over / F.col("vol")).alias("sharpe"),
        F.when(F.col("losses") == 0, F.lit(INFINITY)).when(F.col("loss_vol") > 0, over / F.col("loss_vol")).alias("sortino"),
        F.when(F.col("max_drawdown_abs") > 0, F.col("mean") / F.col("max_drawdown_abs")).otherwise(F.lit(INFINITY)).alias("calmar"),
        "max_drawdown_abs", F.col("cvar").alias("cvar_95"), "win_rate",
    )


def ranked(returns: DataFrame, rf: float = 0.0) -> DataFrame:
    """basic() of each strategy with its place by Sharpe ratio (one row for each strategy)."""
    return basic(returns, rf).withColumn("place", F.row_number().over(Window.orderBy(F.desc("sharpe"), "strategy")))


def against_benchmark(returns: DataFrame, benchmark: DataFrame, rf: float = 0.0) -> DataFrame:
    """strategy, ret, vol, sharpe, excess: first the benchmark (date, r) with its geometric annual return and no excess, then each strategy with its
    arithmetic return (as in basic) less the benchmark's geometric one."""
    b = benchmark.select(F.lit("benchmark").alias("strategy"), "date", "r")
    g = geometric(b).join(b.groupBy("strategy").agg((F.stddev_samp("r") * F.sqrt(F.lit(float(YEAR)))).alias("vol")), "strategy")
    first = g.select("strategy", F.col("ann_return").alias("ret"), "vol", ratio(F.col("ann_return") - rf, F.col("vol")).alias("sharpe"), F.lit(None).cast("double").alias("excess"))
    each = basic(returns, rf).crossJoin(F.broadcast(first.select(F.col("ret").alias("_b"))))  # one row
    return first.unionByName(each.select("strategy", F.col("ann_return").alias("ret"), F.col("ann_vol").alias("vol"), "sharpe", (F.col("ann_return") - F.col("_b")).alias("excess")))


def custom(returns: DataFrame, rf: float = 0.0) -> DataFrame:
    """basic() with the total return, and the Calmar ratio from the geometric annual return."""
    g = geometric(returns).select("strategy", "total", F.col("ann_return").alias("_g"))
    calmar = F.when(F.col("max_drawdown") != 0, F.col("_g") / F.abs("max_drawdown")).otherwise(0.0)
    return basic(returns, rf).join(g, "strategy").withColumn("calmar", calmar).drop("_g")


def invariance(returns: DataFrame, max_lag: int) -> DataFrame:
    """strategy, kind (r, |r|, r^2), lags outside the band for independence, and whether none is."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in (("r", F.col("r")), ("|r|", F.abs("r")), ("r^2", F.col("r") ** 2))]))
    each = returns.select("strategy", "date", kinds.alias("x")).select(F.struct("strategy", "x.kind").alias("strategy"), "date", F.col("x.v").alias("r"))
    out = autocorrelation(each, max_lag).groupBy("strategy").agg(F.count_if(~F.col("inside")).alias("outside"))
    return out.select("strategy.strategy", "strategy.kind", "outside", (F.col("outside") == 0).alias("invariant"))


def excess_sharpe(returns: DataFrame, rf: float = 0.0, periods: int = YEAR) -> DataFrame:
    x = F.col("r") - rf / periods
    sd = F.stddev_samp(x)
    return returns.groupBy("strategy").agg(F.when(sd > 0, F.avg(x) / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe"))


def target_sortino(returns: DataFrame, rf: float = 0.0, target: float = 0.0, periods: int = YEAR) -> DataFrame:
    """Root mean square of the returns below target in the denominator; none: infinite."""
    miss = F.when(F.col("r") < target, F.pow(F.col("r") - target, 2))
    rms = F.sqrt(F.avg(miss))
    return returns.groupBy("strategy").agg(F.when(F.count(miss) == 0, F.lit(INFINITY)).when(rms > 0, F.avg(F.col("r") - rf / periods) / rms * F.sqrt(F.lit(float(periods)))).otherwise(F.lit(INFINITY)).alias("sortino"))


def max_drawdown(returns: DataFrame) -> DataFrame:
    """mdd (negative), its trough's date and the date of the peak before it (the first of equal ones)."""
    e = equity(returns)
    low = e.groupBy("strategy").agg(F.min(F.struct("drawdown", "date", "peak")).alias("t"))
    return e.join(low, "strategy").filter((F.col("equity") == F.col("t.peak")) & (F.col("date") <= F.col("t.date"))).groupBy("strategy").agg(
        F.first("t.drawdown").alias("mdd"), F.min("date").alias("peak_date"), F.first("t.date").alias("trough_date")
    )


def recovery(returns: DataFrame) -> DataFrame:
    """mdd, trough_date and the days until the equity is back at its peak (null: not yet)."""
    e = equity(returns)
    low = e.groupBy("strategy").agg(F.min(F.struct("drawdown", "date", "peak")).alias("t"))
    back = F.min(F.when((F.col("date") >= F.col("t.date")) & (F.col("equity") >= F.col("t.peak")), F.col("date")))
    out = e.join(low, "strategy").groupBy("strategy").agg(F.first("t.drawdown").alias("mdd"), F.first("t.date").alias("trough_date"), back.alias("back"))
    return out.select("strategy", "mdd", "trough_date", F.datediff("back", "trough_date").alias("days"))


def calmar(returns: DataFrame, periods: int = YEAR) -> DataFrame:
    g = equity(returns).groupBy("strategy").agg((F.avg("r") * periods).alias("m"), F.abs(F.min("drawdown")).alias("d"))
    return g.select("strategy", F.when(F.col("d") > 0, F.col("m") / F.col("d")).otherwise(F.lit(INFINITY)).alias("calmar"))


def information_ratio(excess: DataFrame, periods: int = YEAR) -> DataFrame:
    sd = F.stddev_samp("x")
    return excess.groupBy("strategy").agg(F.when(sd > 0, F.avg("x") / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("information_ratio"))


def alpha_beta(excess: DataFrame, periods: int = YEAR) -> DataFrame:
    """Least squares of r on b: alpha (annual), beta and their t statistics with n - 2 degrees of freedom."""
    g = excess.groupBy("strategy").agg(
        F.regr_slope("r", "b").alias("beta"), F.regr_intercept("r", "b").alias("a"), F.regr_sxx("r", "b").alias("sxx"),
        F.regr_syy("r", "b").alias("syy"), F.regr_sxy("r", "b").alias("sxy"), F.regr_avgx("r", "b").alias("mx"), F.count("*").alias("n"),
    )
    s2 = F.greatest((F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2), F.lit(0.0))
    return g.select(
        "strategy", (F.col("a") * periods).alias("alpha"), "beta", "n",
        (F.col("a") / F.sqrt(s2 * (1 / F.col("n") + F.col("mx") ** 2 / F.col("sxx")))).alias("t_alpha"),
        (F.col("beta") / F.sqrt(s2 / F.col("sxx"))).alias("t_beta"),
    )


def geometric(returns: DataFrame, periods: int = YEAR) -> DataFrame:
    """total return and its annual rate over n / periods years."""
    g = returns.groupBy("strategy").agg((F.product(1 + F.col("r")) - 1).alias("total"), F.count("*").alias("n"))
    return g.select("strategy", "total", (F.pow(1 + F.col("total"), F.lit(float(periods)) / F.col("n")) - 1).alias("ann_return"))


def autocorrelation(returns: DataFrame, max_lag: int) -> DataFrame:
    """strategy, lag, acf = sum x_t x_(t - lag) / ((n - lag) * population variance), with the mean over all dates;
    and whether it lies within the band for independence at 95 %."""
    whole = Window.partitionBy("strategy")
    x = returns.withColumns({"x": F.col("r") - F.avg("r").over(whole), "n": F.count("*").over(whole), "v": F.var_pop("r").over(whole), "i": F.row_number().over(Window.partitionBy("strategy").orderBy("date"))})
    past = x.select("strategy", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "i", F.col("x").alias("y")).select("strategy", "lag", (F.col("i") + F.col("lag")).alias("i"), "y")
    acf = x.join(past, ["strategy", "i"]).groupBy("strategy", "lag").agg((F.sum(F.col("x") * F.col("y")) / (F.first("n") - F.col("lag")) / F.first("v")).alias("acf"), F.first("n").alias("n"))
    return acf.select("strategy", "lag", "acf", (F.abs("acf") <= 1.959963984540054 / F.sqrt("n")).alias("inside"))


def moments(returns: DataFrame) -> DataFrame:
    """Population moments, extremes and the Jarque-Bera statistic with its p-value."""
    g = returns.groupBy("strategy").agg(
        F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("excess_kurtosis"),
        F.min("r").alias("worst"), F.max("r").alias("best"), F.min_by("date", "r").alias("worst_date"), F.max_by("date", "r").alias("best_date"), F.median("r").alias("median"),
    )
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("excess_kurtosis") ** 2 / 4)
    return g.withColumn("jarque_bera", jb).withColumn("p", F.exp(-F.col("jarque_bera") / 2))


def rolling(returns: DataFrame, w: int) -> DataFrame:
    """Rolling volatility, return, Sharpe ratio and band over w rows; full windows only."""
    win = Window.partitionBy("strategy").orderBy("date").rowsBetween(1 - w, 0)
    sd, mean = F.stddev_samp("r").over(win), F.avg("r").over(win)
    df = returns.select(
        "strategy", "date", F.count("*").over(win).alias("n"), (sd * F.sqrt(F.lit(float(YEAR)))).alias("vol"),
        (F.pow(F.product(1 + F.col("r")).over(win), F.lit(YEAR / w)) - 1).alias("ret"),
        F.when(sd > 0, mean / sd * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0).alias("sharpe"), (mean + 2 * sd).alias("upper"), (mean - 2 * sd).alias("lower"),
    )
    return df.filter(F.col("n") == w).drop("n")


def seasonality(returns: DataFrame) -> DataFrame:
    """strategy, month: mean over years of (1 + mean daily return of the month)^days - 1, share of positive months, deviation."""
    month = returns.groupBy("strategy", F.year("date").alias("year"), F.month("date").alias("month")).agg((F.pow(1 + F.avg("r"), F.count("*")) - 1).alias("m"))
    return month.groupBy("strategy", "month").agg(F.avg("m").alias("mean"), F.avg((F.col("m") > 0).cast("double")).alias("positive"), F.stddev_samp("m").alias("sd"), F.count("*").alias("years"))


def year_curves(returns: DataFrame, base: float = 100.0) -> DataFrame:
    """strategy, date, year, level: compounded within each calendar year from base."""
    w = Window.partitionBy("strategy", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.select("strategy", "date", F.year("date").alias("year"), (F.product(1 + F.col("r")).over(w) * base).alias("level"))


def percentile_of(returns: DataFrame) -> DataFrame:
    """strategy, score: the percentile of the last return in its history (ties count half)."""
    last = returns.groupBy("strategy").agg(F.max_by("r", "date").alias("x"))
    below, upto = F.count_if(F.col("r") < F.col("x")), F.count_if(F.col("r") <= F.col("x"))
    return returns.join(last, "strategy").groupBy("strategy").agg((F.lit(50.0) / F.count("*") * (below + upto + F.when(upto > below, 1).otherwise(0))).alias("score"))
