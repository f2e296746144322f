"""Registered queries of portfolio construction, rebalancing, models and back-tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisand.functions import scalars
from palisand.operators import backtest as bt
from palisand.operators import correlation, factors, metrics, optimize, rebalance, regimes, robust, series
from palisand.operators import panel as p
from palisand.plans.catalog import BASE, ORACLES, portfolios, query, returns, stored_returns, tilt_over_equal
from palisand.plans.panel import once, region_prices, table, weights
from palisand.sources import prices as src
from palisand.storage import staged
from palisand.streaming.bars import bars


def logs(spark: SparkSession, d: str) -> DataFrame:
    return once("logs", lambda: p.log_returns(region_prices(spark, d)))


# --- portfolio construction


@query("opt_equal", "select distinct 'equal' as strategy, asset, 0.2 as w from rets", "w", "strategy asset")
def _(spark, d):
    return optimize.weights(stored_returns(spark, d), ["equal"])


@query("opt_max_return", "select 'max_return' as strategy, asset, (row_number() over (order by avg(r) desc) = 1)::int::double as w from rets group by asset", "w", "strategy asset")
def _(spark, d):
    return optimize.weights(stored_returns(spark, d), ["max_return"])


for _name in ("min_vol", "max_sharpe", "risk_parity", "markowitz", "hrp", "cvar"):

    @query(f"opt_{_name}", None, "w", "strategy asset status")
    def _(spark, d, name=_name):
        return optimize.weights(stored_returns(spark, d), [name])


@query("opt_build_all", None, "ann_return ann_vol sharpe sortino max_drawdown calmar var_5 cvar_5", "strategy")
def _(spark, d):
    r = stored_returns(spark, d)
    w = staged(optimize.weights(r), "weights")
    return metrics.basic(staged(p.portfolio_returns(r, F.broadcast(w)), "portfolios"), 0.02)  # strategies x assets rows are sent


@query("opt_moments", "select a.asset as i, b.asset as j, covar_samp(a.r, b.r) * 252 as c, avg(a.r) * 252 as m from rets a join rets b on a.date = b.date group by 1, 2", "c m", "i j")
def _(spark, d):
    m = optimize.moments(stored_returns(spark, d)).select(F.posexplode(F.arrays_zip("assets", "mean", "cov")).alias("k", "x"), "assets")
    return m.select(F.col("x.assets").alias("i"), F.col("x.mean").alias("m"), F.explode(F.arrays_zip("assets", "x.cov")).alias("y")).select("i", "m", F.col("y.assets").alias("j"), F.col("y.cov").alias("c"))


@query("opt_frontier", None, "target ret vol sharpe", "i status")
def _(spark, d):
    return optimize.frontier(stored_returns(spark, d))


_CLOUD = f"""u as (select id, asset, k, ((x2 * x2 + k) % {optimize.PRIME} + 0.5) / {float(optimize.PRIME)} as u from (select *, (x1 * x1 + {optimize.SHIFT}) % {optimize.PRIME} as x2 from
  (select id, asset, k, (id * {optimize.BY_ROW} + k * {optimize.BY_COLUMN} + 42) % {optimize.PRIME} as x1 from range(10000) t(id), (select asset, 2 * n + h as k from (select asset, row_number() over (order by asset) as n from (select distinct asset from rets)), (values (0), (1)) v(h))))),
cw as (select id, asset, s / sum(s) over (partition by id) as w from (select id, asset, -sum(ln(u)) as s from u group by 1, 2)),
cov as (select a.asset as i, b.asset as j, covar_samp(a.r, b.r) * 252 as c from rets a join rets b on a.date = b.date group by 1, 2),
mean as (select asset, avg(r) * 252 as m from rets group by 1),
cloud as (select id, ret, vol, (ret - 0.02) / vol as sharpe from (select id, sum(w * m) as ret from cw join mean using (asset) group by 1)
  join (select x.id, sqrt(sum(x.w * y.w * c)) as vol from cw x join cw y on x.id = y.id join cov on i = x.asset and j = y.asset group by 1) using (id))
"""


@query("opt_random_cloud", None, "ret vol sharpe", "id")
def _(spark, d):
    return optimize.random_cloud(spark, stored_returns(spark, d))


ORACLES["opt_random_cloud"] = BASE + ", " + _CLOUD + "select id, round(ret, 6) as ret, round(vol, 6) as vol, round(sharpe, 6) as sharpe from cloud"


@query("frontier_buckets", None, "ret vol", "bucket")
def _(spark, d):
    return optimize.risk_buckets(optimize.random_cloud(spark, stored_returns(spark, d)))


ORACLES["frontier_buckets"] = BASE + ", " + _CLOUD + """select bucket, round(max(ret), 6) as ret, round(arg_max(vol, ret), 6) as vol from
  (select *, floor((vol - (select min(vol) from cloud)) / (select (max(vol) - min(vol)) / 50 from cloud))::int as bucket from cloud) where bucket < 50 group by 1"""


@query("opt_dendrogram", None, "", "asset place cluster")
def _(spark, d):
    return optimize.asset_clusters(stored_returns(spark, d))


@query("agg_group_cluster", None, "rho w", "cluster n")
def _(spark, d):
    r = stored_returns(spark, d)
    c = staged(optimize.asset_clusters(r).select("asset", "cluster"), "clusters")
    return optimize.by_cluster(r, c, staged(optimize.weights(r, ["hrp"]), "weights"))


@query("met_cvar_ranking", "select strategy, cvar, row_number() over (order by cvar desc, strategy)::int as place from tails", "cvar", "strategy place")
def _(spark, d):
    return metrics.tail(portfolios(spark, d)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("cvar"), "strategy")))


# --- rebalancing


@query("reb_schedule", "select 'last_trading_day' as k, date from (select max(date) as date from prices group by year(date), month(date)) union all select 'calendar_end', date from (select distinct date from prices) where date = last_day(date)", "", "k date")
def _(spark, d):
    dates = region_prices(spark, d)
    one = lambda k: rebalance.schedule(dates, "M", k).select(F.lit(k).alias("k"), "date")
    return one("last_trading_day").union(one("calendar_end"))


@query("reb_hold", "select strategy, date, sum(w * g) as value from (select *, product(1 + r) over (partition by asset order by date rows unbounded preceding) as g from rets) join w using (asset) group by 1, 2", "value", "strategy date")
def _(spark, d):
    return rebalance.hold(returns(spark, d), weights(spark, d))


def _walked(flag: str, shown: str) -> str:
    """SQL that goes day by day: an independent statement of what the windows say in closed form."""
    return BASE.replace("with px", "with recursive px") + f""", tw as (select strategy, list(w order by asset) as w0 from w group by 1),
dl as (select date, row_number() over (order by date) as i, list(r order by asset) as r, date = max(date) over (partition by year(date), month(date)) as month_end from rets group by date),
walk as (select strategy, 0::bigint as i, w0, w0 as w, 1.0::double as net, 1.0::double as gross, null::double as turnover, null::date as date from tw
  union all select strategy, i, w0, case when flag then w0 else v end, net * g * case when flag then 1 - t * 10 / 1e4 else 1 end, gross * g, case when flag then t end, date from
  (select *, {flag} as flag from (select *, list_sum(list_transform(list_zip(v, w0), lambda p: abs(p[1] - p[2]))) as t, list_max(list_transform(list_zip(v, w0), lambda p: abs(p[1] - p[2]))) as off from
   (select *, list_transform(raw, lambda y: y / g) as v from (select *, list_sum(raw) as g from
    (select x.strategy, d.i, x.w0, x.net, x.gross, d.month_end, d.date, list_transform(list_zip(x.w, d.r), lambda p: p[1] * (1 + p[2])) as raw from walk x join dl d on d.i = x.i + 1))))))
{shown}"""


_PATH = "select strategy, date, round(net, 6) as net, round(gross, 6) as gross, round(turnover, 6) as turnover from walk where i > 0"


def calendar_path(spark: SparkSession, d: str) -> DataFrame:
    r = stored_returns(spark, d)
    return once("calendar-path", lambda: rebalance.calendar(r, weights(spark, d), rebalance.schedule(r, "M")))


@query("reb_calendar", None, "net gross turnover", "strategy date")
def _(spark, d):
    return calendar_path(spark, d)


@query("reb_simulate_threshold", None, "net gross turnover", "strategy date")
def _(spark, d):
    return rebalance.simulate(stored_returns(spark, d), weights(spark, d), 0.05)


@query("reb_simulate_both", None, "net gross turnover", "strategy date")
def _(spark, d):
    r = stored_returns(spark, d)
    return rebalance.simulate(r, weights(spark, d), 0.05, rebalance.schedule(r, "M"))


@query("reb_metrics", None, "ret_net ret_gross vol_net vol_gross sharpe_net sharpe_gross sortino_net max_drawdown calmar_net turnover turnover_a_year cost_drag", "strategy n_rebalances")
def _(spark, d):
    return rebalance.costs(calendar_path(spark, d))


@query("reb_cost_tables", None, "", "strategy rank_gross rank_net change")
def _(spark, d):
    r = stored_returns(spark, d)
    w = staged(optimize.weights(r).select("strategy", "asset", "w"), "weights")
    path = staged(rebalance.calendar(r, w, rebalance.schedule(r, "M")), "paths")
    return rebalance.rank_change(staged(rebalance.costs(path), "costs"))


def drifting_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs of all strategies that rebalance at month ends, or earlier when a weight is off by a twentieth."""

    def make() -> DataFrame:
        r = stored_returns(spark, d)
        w = staged(optimize.weights(r).select("strategy", "asset", "w"), "weights")
        return rebalance.costs(rebalance.simulate(r, w, 0.05, rebalance.schedule(r, "M")))

    return once("drifting-costs", make)


@query("reb_all_threshold", None, "ret_net ret_gross sharpe_net sharpe_gross turnover cost_drag", "strategy n_rebalances")
def _(spark, d):
    return drifting_costs(spark, d)


@query("reb_cost_drags_all", None, "cost_drag turnover_a_year n_rebalances", "kind strategy")
def _(spark, d):
    return rebalance.cost_drags(drifting_costs(spark, d))


@query("reb_cost_drags", None, "cost_drag turnover_a_year n_rebalances", "kind strategy")
def _(spark, d):
    return rebalance.cost_drags(staged(rebalance.costs(calendar_path(spark, d)), "costs"))


@query("reb_cost_ranks", None, "", "strategy rank_gross rank_net change")
def _(spark, d):
    return rebalance.rank_change(staged(rebalance.costs(calendar_path(spark, d)), "costs"))


ORACLES["reb_calendar"] = _walked("month_end", _PATH)
ORACLES["reb_simulate_both"] = _walked("(off > 0.05 or month_end)", _PATH)
ORACLES["reb_simulate_threshold"] = _walked("off > 0.05", _PATH)
ORACLES["reb_metrics"] = _walked("month_end", """, x as (select *, net / lag(net) over o - 1 as rn, gross / lag(gross) over o - 1 as rg, net / max(net) over (partition by strategy order by date rows unbounded preceding) - 1 as dd
  from walk where i > 0 window o as (partition by strategy order by date)),
g as (select strategy, count(*) as n, pow(arg_max(net, date), 252.0 / count(*)) - 1 as a, pow(arg_max(gross, date), 252.0 / count(*)) - 1 as b, stddev_samp(rn) * sqrt(252) as vn, stddev_samp(rg) * sqrt(252) as vg,
  stddev_samp(case when rn < 0 then rn end) * sqrt(252) as down, min(dd) as mdd, sum(turnover) as t, count(turnover) as k from x group by 1)
select strategy, round(a, 6) as ret_net, round(b, 6) as ret_gross, round(vn, 6) as vol_net, round(vg, 6) as vol_gross, round((a - 0.02) / vn, 6) as sharpe_net, round((b - 0.02) / vg, 6) as sharpe_gross, round((a - 0.02) / down, 6) as sortino_net,
  round(mdd, 6) as max_drawdown, round(a / abs(mdd), 6) as calmar_net, round(t, 6) as turnover, round(t * 252 / n, 6) as turnover_a_year, round(b - a, 6) as cost_drag, k as n_rebalances from g""")
ORACLES["reb_cost_ranks"] = ORACLES["reb_metrics"].rpartition("select strategy, round(a, 6)")[0].rstrip() + """, k as (select strategy, (row_number() over (order by (b - 0.02) / vg desc))::int as rank_gross, (row_number() over (order by (a - 0.02) / vn desc))::int as rank_net from g)
select strategy, rank_gross, rank_net, rank_gross - rank_net as change from k"""
ORACLES["reb_cost_drags"] = ORACLES["reb_metrics"].rpartition("select strategy, round(a, 6)")[0].rstrip() + """, k as (select strategy, b - a as cost_drag, t * 252 / n as turnover_a_year, k::double as n_rebalances from g),
kinds as (select 'average' as kind, null::varchar as strategy, avg(cost_drag) as cost_drag, avg(turnover_a_year) as turnover_a_year, avg(n_rebalances) as n_rebalances from k
  union all (select 'most affected', * from k order by cost_drag desc, strategy limit 1) union all (select 'least affected', * from k order by cost_drag, strategy limit 1))
select kind, strategy, round(cost_drag, 6) as cost_drag, round(turnover_a_year, 6) as turnover_a_year, round(n_rebalances, 6) as n_rebalances from kinds"""


# --- time series


@query("ts_flex_prob", "select date, pow(0.5, (k - 1) / 60.0) / sum(pow(0.5, (k - 1) / 60.0)) over () as p from (select date, row_number() over (order by date desc) as k from (select distinct date from prices))", "p", "date")
def _(spark, d):
    return series.flexible_probabilities(region_prices(spark, d), 60)


@query("ts_normality", None, "ks ks_p w w_p", "asset")
def _(spark, d):
    return series.normality(returns(spark, d))


@query("ts_garch", None, "z vol mu omega alpha beta", "asset date")
def _(spark, d):
    return series.garch(logs(spark, d))


@query("ts_dcc_core", None, "rho a b", "date i j")
def _(spark, d):
    return correlation.dcc(series.garch(logs(spark, d)))


@query("ts_dcc_ui", None, "rho a b", "date i j")
def _(spark, d):
    return correlation.dcc(series.garch(logs(spark, d)), half_life=120.0, lookback=252, bounds=((0.001, 0.3), (0.5, 0.999)))


@query("ts_dcc_summary", None, "now long_run sd high half_life", "i j")
def _(spark, d):
    return series.dcc_summary(correlation.dcc(series.garch(logs(spark, d))))


@query("ts_mlfp", None, "location dispersion", "i j")
def _(spark, d):
    return robust.mlfp(logs(spark, d))


for _form in ("levels", "differences"):

    @query("ts_var1" if _form == "levels" else f"ts_var1_{_form}", None, "b c radius", "i j kind")
    def _(spark, d, form=_form):
        return series.var1(logs(spark, d), form=form)


@query("ts_cointegration", None, "loading beta", "k asset_index")
def _(spark, d):
    return series.cointegration(region_prices(spark, d).select("date", "asset", F.ln("price").alias("r")))


@query("ts_lfm", None, "beta alpha r2", "asset factor")
def _(spark, d):
    r = logs(spark, d)
    return robust.factor_model(r, r.groupBy("date").agg(F.array(F.avg("r"), F.min("r")).alias("f")))


@query("ts_lfm_robust", None, "beta alpha r2 sigma", "asset factor")
def _(spark, d):
    r = logs(spark, d)
    return robust.factor_model(r, r.groupBy("date").agg(F.array(F.avg("r"), F.min("r")).alias("f")), nu=4.0, penalty=0.01, rescale=True)


@query("ts_histogram_pdf", "select strategy, i, lo + i * (hi - lo) / 99.0 as x, exp(-pow((lo + i * (hi - lo) / 99.0 - m) / s, 2) / 2) / (sqrt(2 * pi()) * s) as y from (select strategy, min(r) as lo, max(r) as hi, avg(r) as m, stddev_pop(r) as s from port group by 1), range(100) t(i)", "x y", "strategy i")
def _(spark, d):
    g = portfolios(spark, d).groupBy("strategy").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    g = g.select("strategy", "m", "s", F.posexplode(scalars.linspace(F.col("lo"), F.col("hi"), 100)).alias("i", "x"))
    return g.withColumn("y", scalars.normal_pdf(F.col("x"), F.col("m"), F.col("s")))


# --- factors


_SERIES = """sr as (select asset, date, r as score, sum(r) over (partition by asset order by date rows unbounded preceding) as cum from logs),
ou as (select asset, regr_slope(cum, l) as beta, regr_intercept(cum, l) as alpha, sqrt(greatest((regr_syy(cum, l) - regr_slope(cum, l) * regr_sxy(cum, l)) / count(*), 0)) as sigma
  from (select *, lag(cum) over (partition by asset order by date) as l from sr) where l is not null group by 1),
oz as (select *, case when beta > 0 and beta < 1 then -ln(beta) else 0 end as kappa, case when beta > 0 and beta < 1 then ln(2) / -ln(beta) else 'infinity'::double end as half_life, case when beta > 0 and beta < 1 then alpha / (1 - beta) else 0 end as mu from ou)"""


def cumulated(spark: SparkSession, d: str) -> DataFrame:
    """pc (here: the asset), date, score, cum: log returns as if they were factor scores."""
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return logs(spark, d).select(F.col("asset").alias("pc"), "date", F.col("r").alias("score"), F.sum("r").over(w).alias("cum"))


@query("fac_standardize", "select asset, date, (r - avg(r) over (partition by asset)) / stddev_pop(r) over (partition by asset) as z from rets", "z", "asset date")
def _(spark, d):
    return factors.standardised(returns(spark, d))


@query("fac_ou", None, "alpha beta kappa half_life mu sigma", "pc")
def _(spark, d):
    return factors.mean_reversion(cumulated(spark, d))


ORACLES["fac_ou"] = BASE + ", " + _SERIES + " select asset as pc, " + ", ".join(f"round({c}, 6) as {c}" for c in "alpha beta kappa half_life mu sigma".split()) + " from oz"


@query("fac_zscores", None, "z_rolling z_theory divergence", "pc")
def _(spark, d):
    s = cumulated(spark, d)
    return factors.z_scores(s, factors.mean_reversion(s))


ORACLES["fac_zscores"] = BASE + ", " + _SERIES + """ select asset as pc, round(a, 6) as z_rolling, round(b, 6) as z_theory, round(abs(a - b), 6) as divergence from (select asset, (x - m) / s as a, case when kappa > 0.001 then (x - mu) / (sigma / sqrt(2 * kappa)) end as b from oz join
  (select asset, arg_max(cum, date) as x, avg(cum) as m, stddev_pop(cum) as s from (select *, row_number() over (partition by asset order by date desc) as k from sr) where k <= 60 group by 1) using (asset))"""


@query("fac_cross_corr", "select a.asset as i, b.asset as j, corr(a.r, b.s) as rho from rets a join (select asset, date, lead(r) over (partition by asset order by date) as s from rets) b on a.date = b.date where s is not null group by 1, 2", "rho", "i j")
def _(spark, d):
    return factors.cross_correlation(returns(spark, d).select(F.col("asset").alias("pc"), "date", F.col("r").alias("score")))


@query("fac_pca", None, "loading share", "pc asset")
def _(spark, d):
    return factors.loadings(logs(spark, d), 3)


def factor_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    load = once("loadings", lambda: factors.loadings(logs(spark, d), 3))
    return with_loadings(spark, d, load)


def with_loadings(spark: SparkSession, d: str, load: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """loadings, scores, their mean reversion and z-scores, each stored."""
    s = once("scores", lambda: factors.scores(logs(spark, d), load))
    ou = once("reversion", lambda: factors.mean_reversion(s))
    return load, s, ou, once("z-scores", lambda: factors.z_scores(s, ou))


def stability(load: DataFrame, ou: DataFrame, z: DataFrame) -> DataFrame:
    """score and its label, from loadings (the first factor's share), mean reversion and z-scores."""
    first = load.filter("pc = 1").agg(F.first("share").alias("share"))
    state = ou.join(z, "pc").agg(F.avg(F.col("beta").between(0, 0.99).cast("double")).alias("part"), F.median("half_life").alias("half_life"), F.coalesce(F.avg("divergence"), F.lit(0.0)).alias("divergence"))
    out = state.crossJoin(F.broadcast(first)).select(scalars.stability_score(F.col("part"), F.col("half_life"), F.col("share"), F.col("divergence")).alias("score"))  # one row each
    return out.withColumn("label", scalars.label(F.col("score"), scalars.SCORE))


@query("fac_scores_cum", None, "score cum", "pc date")
def _(spark, d):
    return factor_state(spark, d)[1]


@query("fac_mimic", None, "w", "pc asset")
def _(spark, d):
    load, _, _, z = factor_state(spark, d)
    return factors.mimicking(load, z)


@query("fac_deviation", None, "size direction", "asset label")
def _(spark, d):
    load, _, _, z = factor_state(spark, d)
    return factors.deviations(load, z)


@query("fac_signals", None, "hold", "pc side strong")
def _(spark, d):
    _, _, ou, z = factor_state(spark, d)
    return factors.signals(z, ou, entry=0.1)


@query("fac_stability", None, "score", "label")
def _(spark, d):
    load, _, ou, z = factor_state(spark, d)
    return stability(load, ou, z)


@query("fac_hmm", None, "p stay p_next", "date regime")
def _(spark, d):
    return regimes.market_regimes(logs(spark, d), 3)


# --- back-tests

CONFIG = bt.Config(window=104, n_components=3, z_entry=1.0)


def engine(spark: SparkSession, d: str) -> DataFrame:
    return once("engine", lambda: bt.run(spark, logs(spark, d), [CONFIG]))


@query("bt_pca_ou", None, "r b turnover cost", "run_id date regime traded")
def _(spark, d):
    return engine(spark, d)


@query("bt_metrics", None, "ann_return benchmark excess vol sharpe max_drawdown information_ratio turnover costs win_rate", "run_id n trades")
def _(spark, d):
    return bt.summary(engine(spark, d))


@query("bt_regime_perf", None, "share ret vol ret_b vol_b sharpe", "run_id regime n")
def _(spark, d):
    return bt.by_regime(engine(spark, d))


@query("bt_factor_contrib", None, "contribution", "run_id factor days")
def _(spark, d):
    return bt.contributions(engine(spark, d))


@query("lim_last20_trades", None, "turnover cost", "date regime")
def _(spark, d):
    return engine(spark, d).filter("traded").orderBy(F.desc("date")).limit(20)


@query("bt_sensitivity", None, "ann_return sharpe max_drawdown", "run_id trades")
def _(spark, d):
    return bt.sensitivity(spark, logs(spark, d), CONFIG, "z_entry", [0.5, 1.0, 1.5])


@query("bt_signal_decay", """select a.strategy, case when a.z > 0 then 'short' else 'long' end as side, (b.i - a.i)::int as horizon, avg(exp(b.g - a.g) - 1) as mean, count(*) as n from s a join s b on a.strategy = b.strategy and b.i - a.i between 1 and 30 where abs(a.z) > 1.5 group by 1, 2, 3""".replace(
  " s ", " (select *, row_number() over (partition by strategy order by date) as i, sum(ln(1 + r)) over (partition by strategy order by date rows unbounded preceding) as g, (r - avg(r) over (partition by strategy)) / stddev_pop(r) over (partition by strategy) as z from port) "), "mean", "strategy side horizon n")
def _(spark, d):
    w = Window.partitionBy("strategy")
    return bt.signal_decay(portfolios(spark, d).withColumn("z", (F.col("r") - F.avg("r").over(w)) / F.stddev_pop("r").over(w)), 1.5)


@query("bt_walk_forward", None, "sharpe_train sharpe_test stability", "strategy")
def _(spark, d):
    return bt.walk_forward(stored_returns(spark, d))


_SPLITS = """sp as (select c.s as split_id, d.date, case when fold in (a, b) then 'test' when i >= e and i < e + floor(n * 0.01) then 'embargo' else 'train' end as role
  from (select *, least(i // (n // 5), 4) as fold from (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from rets))) d,
  (select x.f as a, y.f as b, row_number() over (order by x.f, y.f) - 1 as s from range(5) x(f), range(5) y(f) where x.f < y.f) c, lateral (select case when c.b = 4 then d.n else (c.b + 1) * (d.n // 5) end as e))"""


@query("bt_cpcv_splits", None, "", "split_id date role")
def _(spark, d):
    return bt.splits(stored_returns(spark, d))


ORACLES["bt_cpcv_splits"] = BASE + ", " + _SPLITS + " select split_id::int as split_id, date, role from sp where role <> 'embargo'"


@query("bt_cpcv_equal", None, "sharpe win_rate", "method split_id role")
def _(spark, d):
    r = stored_returns(spark, d)
    return bt.cross_validated(r, bt.splits(r), ["equal"])


ORACLES["bt_cpcv_equal"] = BASE + ", " + _SPLITS + """ select 'equal' as method, split_id::int as split_id, role, round((avg(r) * 252 - 0.02) / (stddev_samp(r) * sqrt(252)), 6) as sharpe, round(avg((r > 0)::int), 6) as win_rate
  from sp join port using (date) where role <> 'embargo' and strategy = 'equal' group by 2, 3"""


def validated(spark: SparkSession, d: str) -> DataFrame:
    r = stored_returns(spark, d)
    return once("validated", lambda: bt.cross_validated(r, bt.splits(r)))


@query("bt_cpcv", None, "sharpe sortino calmar max_drawdown_abs cvar_95 win_rate", "method split_id role")
def _(spark, d):
    return validated(spark, d)


@query("bt_pbo", None, "pbo", "n_splits label")
def _(spark, d):
    return bt.overfitting(validated(spark, d)).withColumn("label", scalars.label(F.col("pbo"), scalars.PBO))


@query("bt_cpcv_ranking", None, "sharpe sortino calmar worst win_rate", "method place")
def _(spark, d):
    return bt.ranking(validated(spark, d))


@query("bt_t_tests", "select strategy, n, wins, s / sqrt((1 + s * s / 2) / n) as t_sharpe, t as t_excess from (select strategy, count(*) as n, avg(r) / stddev_samp(r) as s, avg(x) / stddev_samp(x) * sqrt(count(*)) as t, count(*) filter (where x > 0) as wins from ex group by 1)", "t_sharpe t_excess", "strategy n wins")
def _(spark, d):
    return bt.significance(tilt_over_equal(spark, d))


@query("bt_p_values", None, "p_sharpe p_excess p_wins", "strategy")
def _(spark, d):
    return bt.significance(tilt_over_equal(spark, d))


def _sharpe(r) -> float:
    s = np.std(r)
    return float(np.mean(r) / s * np.sqrt(252)) if s > 0 else 0.0


@query("bt_boot_sharpe", None, "point mean sd low high", "strategy")
def _(spark, d):
    return bt.bootstrap(spark, portfolios(spark, d), _sharpe)


@query("bt_boot_metric", None, "point mean sd low high", "strategy")
def _(spark, d):
    return bt.bootstrap(spark, portfolios(spark, d), np.mean, block=1)


# --- scalars, sources, streams


@query("sc_scalars", """select o_orderkey as k, least(greatest(o_totalprice / 1e4, 5), 15) as clipped, round_even(o_totalprice, 1) as rounded, degrees(atan2(sin(o_totalprice / 1e5), cos(o_totalprice / 1e5))) as angle, sign(o_totalprice - 1e5) as side,
  year(o_orderdate)::int as y, dayofyear(o_orderdate)::int as doy, strftime(o_orderdate, '%Y-%m-%d') as ymd, case when o_totalprice / 3e3 >= 75 then 'aggressive' when o_totalprice / 3e3 >= 50 then 'growth' when o_totalprice / 3e3 >= 25 then 'balanced' else 'careful' end as risk from orders""",
  "clipped rounded angle side", "k y doy ymd risk", base=False)
def _(spark, d):
    o, x = table(spark, d, "orders"), F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("k"), scalars.clip(x / 1e4, 5.0, 15.0).alias("clipped"), F.bround(x, 1).alias("rounded"), F.degrees(F.atan2(F.sin(x / 1e5), F.cos(x / 1e5))).alias("angle"), F.signum(x - 1e5).alias("side"),
        F.year("o_orderdate").alias("y"), F.dayofyear("o_orderdate").alias("doy"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ymd"), scalars.label(x / 3e3, scalars.RISK).alias("risk"),
    )


@query("str_price_bars", "select date_trunc('day', ts) as start, event_type as asset, avg(value) as price, count(*) as n from events group by 1, 2", "price", "start asset n", base=False)
def _(spark, d):
    return bars(table(spark, d, "events").withColumnRenamed("event_type", "asset"))


@query("snk_json_metrics", None, "", "strategy js")
def _(spark, d):
    return src.to_json(weights(spark, d), metrics.basic(portfolios(spark, d), 0.02))
