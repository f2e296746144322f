"""Registered queries of rankings, comparisons, votes and labels, and of models with given loadings, clusters or closed-form weights,
for which SQL can give the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisand.functions import scalars
from palisand.operators import backtest as bt
from palisand.operators import factors, metrics, optimize, series
from palisand.operators import panel as p
from palisand.plans.catalog import BASE, ORACLES, portfolios, query, returns, stored_returns, tilt_over_equal
from palisand.plans.models import _SERIES, _SPLITS, cumulated, logs, stability, with_loadings
from palisand.plans.panel import once, region_prices, table, weights
from palisand.sources import prices as src
from palisand.sources import quotes, workbook
from palisand.storage import new_folder, shared_files, staged

# --- comparisons of strategies


@query("met_strategy_compare", """select *, (row_number() over (order by sharpe desc))::int as place from (select strategy, ann_return, ann_vol, (ann_return - 0.02) / ann_vol as sharpe, (ann_return - 0.02) / loss_vol as sortino, mdd as max_drawdown, ann_return / abs(mdd) as calmar
  from (select strategy, avg(r) * 252 as ann_return, stddev_samp(r) * sqrt(252) as ann_vol, stddev_samp(case when r < 0 then r end) * sqrt(252) as loss_vol, min(drawdown) as mdd from dd group by 1))""",
  "ann_return ann_vol sharpe sortino max_drawdown calmar", "strategy place")
def _(spark, d):
    return metrics.ranked(portfolios(spark, d), 0.02)


@query("src_benchmark", "select date, r from rets where asset = 'ASIA'", "r", "date")
def _(spark, d):
    return src.benchmark(region_prices(spark, d), "ASIA")


_BENCHMARK = "(select pow(product(1 + r), 252.0 / count(*)) - 1 as g, stddev_samp(r) * sqrt(252) as v from rets where asset = 'ASIA')"


@query("met_benchmark", f"""select 'benchmark' as strategy, g as ret, v as vol, (g - 0.02) / v as sharpe, null::double as excess from {_BENCHMARK}
  union all select strategy, m, s, (m - 0.02) / s, m - g from (select strategy, avg(r) * 252 as m, stddev_samp(r) * sqrt(252) as s from port group by 1), {_BENCHMARK}""", "ret vol sharpe excess", "strategy")
def _(spark, d):
    return metrics.against_benchmark(portfolios(spark, d), src.benchmark(region_prices(spark, d), "ASIA"), 0.02)


@query("met_custom", """select strategy, total, ann_return, ann_vol, (ann_return - 0.02) / ann_vol as sharpe, mdd as max_drawdown, (pow(1 + total, 252.0 / n) - 1) / abs(mdd) as calmar from
  (select strategy, product(1 + r) - 1 as total, count(*) as n, avg(r) * 252 as ann_return, stddev_samp(r) * sqrt(252) as ann_vol, min(drawdown) as mdd from dd where strategy = 'tilt' group by 1)""", "total ann_return ann_vol sharpe max_drawdown calmar", "strategy")
def _(spark, d):
    percent = weights(spark, d).filter("strategy = 'tilt'").withColumn("w", F.col("w") * 100)  # as a user gives them
    return metrics.custom(p.portfolio_returns(returns(spark, d), percent.withColumn("w", F.col("w") / 100)), 0.02)


_PAIRS = """pc as (select a.asset as i, b.asset as j, corr(a.r, b.r) as long_run, corr(a.r, b.r) filter (where a.date in (select distinct date from rets order by date desc limit 60)) as now from rets a join rets b on a.date = b.date and a.asset < b.asset group by 1, 2)"""


@query("top_pairs", None, "now rise", "kind place i j flag")
def _(spark, d):
    return series.top_pairs(once("pairs", lambda: series.pair_changes(stored_returns(spark, d))))


ORACLES["top_pairs"] = BASE + ", " + _PAIRS + """ select kind, place::int as place, i, j, round(now, 6) as now, round(rise, 6) as rise, flag from
  (select 'now' as kind, row_number() over (order by now desc, i, j) as place, i, j, now, now - long_run as rise, now > 0.8 as flag from pc
   union all select 'rise', row_number() over (order by now - long_run desc, i, j), i, j, now, now - long_run, now - long_run > 0.15 from pc) where place <= 3"""


# --- votes and counts


@query("ts_normality_vote", None, "ks ks_p w w_p jb_p", "asset votes")
def _(spark, d):
    r = stored_returns(spark, d)
    jb = metrics.moments(r.withColumnRenamed("asset", "strategy")).select(F.col("strategy").alias("asset"), "p")
    return series.normality_votes(r, jb)


@query("ts_invariance", """select strategy, kind, count(*) filter (where abs(acf) > 1.959963984540054 / sqrt(n)) as outside, count(*) filter (where abs(acf) > 1.959963984540054 / sqrt(n)) = 0 as invariant from
  (select strategy, kind, lag, any_value(n) as n, sum(x * y) / (any_value(n) - lag) / any_value(v) as acf from
   (select a.strategy, a.kind, b.i - a.i as lag, a.n, a.v, a.x, b.x as y from z a join z b on a.strategy = b.strategy and a.kind = b.kind and b.i - a.i between 1 and 25) group by 1, 2, 3) group by 1, 2""".replace(
  " z ", """ (select strategy, kind, row_number() over (partition by strategy, kind order by date) as i, q - avg(q) over (partition by strategy, kind) as x, var_pop(q) over (partition by strategy, kind) as v, count(*) over (partition by strategy, kind) as n
   from (select strategy, date, 'r' as kind, r as q from port union all select strategy, date, '|r|', abs(r) from port union all select strategy, date, 'r^2', r * r from port)) """), "", "strategy kind outside invariant")
def _(spark, d):
    return metrics.invariance(portfolios(spark, d), 25)


@query("agg_conditional_count", "select asset as pc, count(*) filter (where z < -2) as n_long, count(*) filter (where z > 2) as n_short, count(*) filter (where abs(z) > 2) as signals, count(*) filter (where abs(z) > 2) / count(*) as rate from (select asset, (r - avg(r) over (partition by asset)) / stddev_pop(r) over (partition by asset) as z from rets) group by 1", "rate", "pc n_long n_short signals")
def _(spark, d):
    return factors.signal_counts(factors.standardised(returns(spark, d)).withColumnRenamed("asset", "pc"), 2.0)


# --- factors with given loadings

#: Three factors: the market, Africa against Asia, and Europe with the Middle East against America.
_GIVEN = [
    (1, "AFRICA", 0.45), (1, "AMERICA", 0.45), (1, "ASIA", 0.45), (1, "EUROPE", 0.45), (1, "MIDDLE EAST", 0.43), (2, "AFRICA", 0.7), (2, "ASIA", -0.7), (2, "EUROPE", 0.05),
    (3, "EUROPE", 0.5), (3, "MIDDLE EAST", 0.5), (3, "AMERICA", -0.7),
]
_LOADED = f"""ld as (select pc, asset, loading::double as loading from (values {", ".join(map(str, _GIVEN))}) t(pc, asset, loading)),
zz as (select asset, date, (r - avg(r) over (partition by asset)) / stddev_pop(r) over (partition by asset) as z from logs),
sr as (select *, sum(score) over (partition by pc order by date rows unbounded preceding) as cum from (select pc, date, sum(z * loading) as score from zz join ld using (asset) group by 1, 2)),
""" + _SERIES[_SERIES.index("ou as") :].replace("select asset,", "select pc,").replace("partition by asset", "partition by pc") + """,
zs as (select pc, a, b, abs(a - b) as div from (select pc, (x - m) / s as a, case when kappa > 0.001 then (x - mu) / (sigma / sqrt(2 * kappa)) end as b from oz join
  (select pc, arg_max(cum, date) as x, avg(cum) as m, stddev_pop(cum) as s from (select *, row_number() over (partition by pc order by date desc) as k from sr) where k <= 60 group by 1) using (pc)))
"""


def _given(name: str, sql: str, doubles: str = "", others: str = ""):
    """A query over (loadings, scores, mean reversion, z-scores) of the given loadings, and its SQL."""

    def add(f):
        @query(name, None, doubles, others)
        def _(spark: SparkSession, d: str) -> DataFrame:
            load = once("given", lambda: spark.createDataFrame(_GIVEN, "pc int, asset string, loading double").withColumn("share", F.when(F.col("pc") == 1, 0.6).otherwise(0.2)))
            return f(*with_loadings(spark, d, load))

        shown = ", ".join([f"round({c}, 6) as {c}" for c in doubles.split()] + others.split())
        ORACLES[name] = BASE + ", " + _LOADED + f"select {shown} from ({sql})"
        return f

    return add


@_given("fac_scores_given", "select * from sr", "score cum", "pc date")
def _(load, s, ou, z):
    return s


@_given("fac_contrib", "select pc, asset, loading, loading * now as contribution from ld join (select pc, arg_max(cum, date) as now from sr group by 1) using (pc)", "loading contribution", "pc asset")
def _(load, s, ou, z):
    return factors.contributions_of(load, s)


@_given("fac_mimic_given", "select pc, asset, case when a > 0.5 then -1 else 1 end * loading / sum(abs(loading)) over (partition by pc) as w from ld join zs using (pc)", "w", "pc asset")
def _(load, s, ou, z):
    return factors.mimicking(load, z, entry=0.5)


@_given("fac_deviation_given", "select *, case when direction > 0.5 then 'cheap' when direction < -0.5 then 'dear' else 'fair' end as label from (select asset, sum(abs(loading) * abs(a)) as size, -sum(loading * a) as direction from ld join zs using (pc) group by 1)", "size direction", "asset label")
def _(load, s, ou, z):
    return factors.deviations(load, z)


@_given("fac_signals_given", "select pc, case when a > 0 then 'short' else 'long' end as side, abs(a) > 2 as strong, half_life * abs(a) / 2 as hold from zs join oz using (pc) where pc > 1 and abs(a) > 0.1 and beta > 0 and beta < 0.99", "hold", "pc side strong")
def _(load, s, ou, z):
    return factors.signals(z, ou, entry=0.1)


@_given("fac_stability_given", """select *, case when score >= 70 then 'stable' when score >= 40 then 'mixed' else 'unstable' end as label from
  (select least(greatest(30 * avg((beta between 0 and 0.99)::int) + greatest(30 - median(half_life), 0) + 25 * (1 - 0.6) + greatest(15 - 10 * coalesce(avg(div), 0), 0), 0), 100) as score from oz join zs using (pc))""", "score", "label")
def _(load, s, ou, z):
    return stability(load, ou, z)


@_given("top_loadings", "select * from (select pc, case when loading > 0 then 'with' else 'against' end as side, (row_number() over (partition by pc, loading > 0 order by abs(loading) desc, asset))::int as place, asset, loading from ld where abs(loading) > 0.1) where place <= 5", "loading", "pc side place asset")
def _(load, s, ou, z):
    return factors.top_loadings(load)


@query("top_cross_effects", "select * from (select a.asset as i, b.asset as j, corr(a.r, b.s) as rho from rets a join (select asset, date, lead(r) over (partition by asset order by date) as s from rets) b on a.date = b.date where s is not null group by 1, 2) where i <> j and abs(rho) > 0.05 order by abs(rho) desc, i, j limit 3", "rho", "i j")
def _(spark, d):
    return factors.top_cross_effects(factors.cross_correlation(stored_returns(spark, d).select(F.col("asset").alias("pc"), "date", F.col("r").alias("score"))))


# --- clusters, validation and metrics with given or closed-form parts

_CLUSTERS = [("AFRICA", 0), ("AMERICA", 0), ("ASIA", 1), ("EUROPE", 1), ("MIDDLE EAST", 2)]


@query("agg_cluster_given", f"""select cluster, w, n, rho from (select cluster, sum(w) as w, count(*) as n from cl join w using (asset) where strategy = 'tilt' group by 1) left join
  (select cluster, avg(rho) as rho from (select x.cluster, corr(a.r, b.r) as rho from rets a join rets b on a.date = b.date and a.asset < b.asset join cl x on x.asset = a.asset join cl y on y.asset = b.asset and y.cluster = x.cluster group by x.cluster, a.asset, b.asset) group by 1) using (cluster)""".replace(
  " cl ", f" (select * from (values {', '.join(map(str, _CLUSTERS))}) t(asset, cluster)) "), "rho w", "cluster n")
def _(spark, d):
    return optimize.by_cluster(stored_returns(spark, d), spark.createDataFrame(_CLUSTERS, "asset string, cluster int"), weights(spark, d).filter("strategy = 'tilt'"))


_CLOSED = ["equal", "max_return"]
_VALIDATED = _SPLITS + """,
best as (select split_id, arg_max(asset, m) as asset from (select split_id, asset, avg(r) as m from sp join rets using (date) where role = 'train' group by 1, 2) group by 1),
cp as (select 'equal' as method, split_id, role, date, avg(r) as r from sp join rets using (date) where role <> 'embargo' group by 2, 3, 4
  union all select 'max_return', sp.split_id, role, date, r from sp join best on best.split_id = sp.split_id join rets using (date, asset) where role <> 'embargo'),
ce as (select *, product(1 + r) over (partition by method, split_id, role order by date rows unbounded preceding) as e from cp),
cd as (select *, e / max(e) over (partition by method, split_id, role order by date rows unbounded preceding) - 1 as x from ce),
cv as (select method, split_id::int as split_id, role, (avg(r) * 252 - 0.02) / (stddev_samp(r) * sqrt(252)) as sharpe, (avg(r) * 252 - 0.02) / (stddev_samp(case when r < 0 then r end) * sqrt(252)) as sortino, avg(r) * 252 / abs(min(x)) as calmar,
  abs(min(x)) as max_drawdown_abs, avg((r > 0)::int) as win_rate from cd group by 1, 2, 3)"""


def closed(spark: SparkSession, d: str) -> DataFrame:
    r = stored_returns(spark, d)
    return once("validated", lambda: bt.cross_validated(r, bt.splits(r), _CLOSED))


@query("bt_cpcv_closed", None, "sharpe sortino calmar max_drawdown_abs win_rate", "method split_id role")
def _(spark, d):
    return closed(spark, d)


ORACLES["bt_cpcv_closed"] = BASE + ", " + _VALIDATED + " select method, split_id, role, " + ", ".join(f"round({c}, 6) as {c}" for c in "sharpe sortino calmar max_drawdown_abs win_rate".split()) + " from cv"


@query("bt_pbo_closed", None, "pbo", "n_splits label")
def _(spark, d):
    return bt.overfitting(closed(spark, d)).withColumn("label", scalars.label(F.col("pbo"), scalars.PBO))


ORACLES["bt_pbo_closed"] = BASE + ", " + _VALIDATED + """, pl as (select *, rank() over (partition by split_id, role order by sharpe desc) + (count(*) over (partition by split_id, role, sharpe) - 1) / 2.0 as place, count(*) over (partition by split_id, role) as n from cv),
pb as (select count(*) as n_splits, avg((o.place > (o.n + 1) / 2.0)::int) as pbo from pl o join (select split_id, arg_min(method, place) as method from pl where role = 'train' group by 1) b using (split_id, method) where role = 'test')
select n_splits, round(pbo, 6) as pbo, case when pbo >= 0.5 then 'high' when pbo >= 0.3 then 'moderate' when pbo >= 0.1 then 'low' else 'very low' end as label from pb"""


@query("bt_cpcv_ranking_closed", None, "sharpe sortino calmar worst win_rate", "method place")
def _(spark, d):
    return bt.ranking(closed(spark, d))


ORACLES["bt_cpcv_ranking_closed"] = BASE + ", " + _VALIDATED + """, rk as (select method, median(sharpe) as sharpe, median(sortino) as sortino, median(calmar) as calmar, max(max_drawdown_abs) as worst, avg(win_rate) as win_rate from cv where role = 'test' group by 1)
select method, (row_number() over (order by sharpe desc, method))::int as place, """ + ", ".join(f"round({c}, 6) as {c}" for c in "sharpe sortino calmar worst win_rate".split()) + " from rk"

SHARES = (50, 60, 70, 80)


@query("bt_walk_forward_closed", f"""select *, sharpe_test / sharpe_train as stability from (select share, strategy, (avg(r) filter (where train) * 252 - 0.02) / (stddev_samp(r) filter (where train) * sqrt(252)) as sharpe_train, (avg(r) filter (where not train) * 252 - 0.02) / (stddev_samp(r) filter (where not train) * sqrt(252)) as sharpe_test from
  (select share, 'equal' as strategy, date, train, avg(r) as r from sd group by 1, 3, 4 union all select share, 'max_return', date, train, r from sd join (select share, arg_max(asset, m) as asset from (select share, asset, avg(r) as m from sd where train group by 1, 2) group by 1) using (share, asset)) group by 1, 2)""".replace(
  " sd ", f" (select s as share, date, asset, r, dense_rank() over (partition by s order by date) <= (select floor(count(distinct date) * s / 100.0) from rets) as train from rets, (values {', '.join(f'({s})' for s in SHARES)}) v(s)) "), "sharpe_train sharpe_test stability", "share strategy")
def _(spark, d):
    r = stored_returns(spark, d)
    parts = [bt.walk_forward(r, s / 100, _CLOSED).withColumn("share", F.lit(s)) for s in SHARES]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def given_path(spark: SparkSession, d: str) -> DataFrame:
    """A back-test's path that SQL can give too: tilted against equal weights, trades at month ends, regimes by the size of the return."""
    both = tilt_over_equal(spark, d).select(F.col("strategy").alias("run_id"), "date", "r", "b")
    traded = F.col("date") == F.max("date").over(Window.partitionBy(F.year("date"), F.month("date")))
    size = F.abs("b")
    regime = F.when(size < 0.05, "Calm").when(size < 0.1, "Normal").otherwise("Panic")
    return staged(both.withColumns({"traded": traded, "regime": regime}).withColumns({"turnover": F.when(F.col("traded"), F.abs("r")).otherwise(0.0), "cost": F.when(F.col("traded"), F.abs("r") / 1000).otherwise(0.0)}), "paths")


_FIGURES = (
    "total_return total_benchmark excess ann_return ann_benchmark vol vol_benchmark sharpe sharpe_benchmark sortino calmar calmar_benchmark alpha beta information_ratio max_drawdown max_drawdown_benchmark var_95 cvar_95 var_95_benchmark "
    "cvar_95_benchmark turnover costs mean_turnover win_rate n_years return_calm vol_calm return_normal vol_normal return_panic vol_panic"
)


@query("bt_full_metrics", None, _FIGURES, "run_id n_days n_trades")
def _(spark, d):
    return bt.full_summary(given_path(spark, d))


ORACLES["bt_full_metrics"] = BASE + """, gp as (select *, date = max(date) over (partition by year(date), month(date)) as traded, case when abs(b) < 0.05 then 'Calm' when abs(b) < 0.1 then 'Normal' else 'Panic' end as regime,
  product(1 + r) over (order by date rows unbounded preceding) as er, product(1 + b) over (order by date rows unbounded preceding) as eb from ex),
gd as (select *, er / max(er) over (order by date rows unbounded preceding) - 1 as dr, eb / max(eb) over (order by date rows unbounded preceding) - 1 as db, (select quantile_cont(r, 0.05) from ex) as qr, (select quantile_cont(b, 0.05) from ex) as qb from gp),
gs as (select strategy as run_id, count(*) as n_days, product(1 + r) - 1 as total_return, product(1 + b) - 1 as total_benchmark, stddev_samp(r) * sqrt(252) as vol, stddev_samp(b) * sqrt(252) as vol_benchmark, stddev_samp(case when r < 0 then r end) * sqrt(252) as down,
  regr_slope(r, b) as beta, regr_intercept(r, b) * 252 as alpha, stddev_samp(r - b) * sqrt(252) as te, min(dr) as max_drawdown, min(db) as max_drawdown_benchmark, any_value(qr) as var_95, any_value(qb) as var_95_benchmark, avg(case when r <= qr then r end) as cvar_95, avg(case when b <= qb then b end) as cvar_95_benchmark,
  count(*) filter (where traded) as n_trades, sum(abs(r)) filter (where traded) as turnover, sum(abs(r)) filter (where traded) / 1000 as costs, avg((r > b)::int) filter (where traded) as win_rate, """ + ", ".join(
    f"avg(r) filter (where regime = '{x}') * 252 as return_{x.lower()}, stddev_samp(r) filter (where regime = '{x}') * sqrt(252) as vol_{x.lower()}" for x in ("Calm", "Normal", "Panic")) + """ from gd group by 1),
ga as (select *, n_days / 252.0 as n_years, pow(1 + total_return, 252.0 / n_days) - 1 as ann_return, pow(1 + total_benchmark, 252.0 / n_days) - 1 as ann_benchmark from gs),
gf as (select *, total_return - total_benchmark as excess, ann_return / vol as sharpe, ann_benchmark / vol_benchmark as sharpe_benchmark, ann_return / down as sortino, ann_return / abs(max_drawdown) as calmar, ann_benchmark / abs(max_drawdown_benchmark) as calmar_benchmark,
  (ann_return - ann_benchmark) / te as information_ratio, turnover / n_trades as mean_turnover from ga)
select run_id, n_days, n_trades, """ + ", ".join(f"round({c}, 6) as {c}" for c in _FIGURES.split()) + " from gf"


@query("bt_regime_given", """select strategy as run_id, regime, count(*) as n, count(*) / (select count(*) from ex) as share, avg(r) * 252 as ret, stddev_samp(r) * sqrt(252) as vol, avg(b) * 252 as ret_b, stddev_samp(b) * sqrt(252) as vol_b, avg(r) * 252 / (stddev_samp(r) * sqrt(252)) as sharpe
  from (select *, case when abs(b) < 0.05 then 'Calm' when abs(b) < 0.1 then 'Normal' else 'Panic' end as regime from ex) group by 1, 2""", "share ret vol ret_b vol_b sharpe", "run_id regime n")
def _(spark, d):
    return bt.by_regime(given_path(spark, d))


@query("snk_json_metrics_shown", """select strategy, to_json({'strategy': strategy, 'weights': wm, 'metrics': {'return': round_even(m * 100, 2), 'volatility': round_even(s * 100, 2), 'sharpe': round_even((m - 0.02) / s, 3)}}) as js from
  (select strategy, map_from_entries(list(row(asset, round_even(w * 100, 2)) order by asset)) as wm from w where w > 0.001 group by 1) join (select strategy, avg(r) * 252 as m, stddev_samp(r) * sqrt(252) as s from port group by 1) using (strategy)""", "", "strategy js")
def _(spark, d):
    return src.to_json(weights(spark, d), metrics.basic(portfolios(spark, d), 0.02))


# --- scalars and labels


@query("sc_more", """select o_orderkey as k, ceil(o_totalprice / 1000)::bigint as up, concat_ws(' / ', o_orderpriority, o_orderstatus) as joined, replace(o_orderpriority, '-', ' ') as replaced, substring(o_clerk_ , 1, 12) as cut,
  coalesce(case when o_orderkey % 3 = 0 then null else o_totalprice end, case when o_orderkey % 2 = 0 then 1.0 else 0.0 end) as filled, isfinite(case when o_orderkey % 5 = 0 then 'inf'::double when o_orderkey % 5 = 1 then 'nan'::double else o_totalprice end) as finite from orders""".replace("o_clerk_", "o_orderpriority || o_orderstatus"), "filled", "k up joined replaced cut finite", base=False)
def _(spark, d):
    x = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("inf"))).when(F.col("o_orderkey") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.ceil(F.col("o_totalprice") / 1000).alias("up"), F.concat_ws(" / ", "o_orderpriority", "o_orderstatus").alias("joined"), F.replace("o_orderpriority", F.lit("-"), F.lit(" ")).alias("replaced"),
        F.substring(F.concat("o_orderpriority", "o_orderstatus"), 1, 12).alias("cut"), scalars.filled(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")), F.col("o_orderkey") % 2 == 0).alias("filled"), scalars.finite(x).alias("finite"),
    )


@query("sc_now_minus", "select date, date_diff('day', date, (now() at time zone 'UTC')::date - 1)::int as age from (select distinct date from prices)", "", "date age")
def _(spark, d):
    return region_prices(spark, d).select("date").distinct().withColumn("age", F.date_diff(src.default_end(), "date"))


@query("sc_labels", """select k, case when x / 100 >= 0.5 then 'high' when x / 100 >= 0.3 then 'moderate' when x / 100 >= 0.1 then 'low' else 'very low' end as pbo, case when x / 50 > 0.8 then 'stable' when x / 50 > 0.5 then 'fair' when x / 50 > 0 then 'weak' else 'failed' end as walk,
  case when x / 20 > 3 then 'high' when x / 20 > 1.5 then 'moderate' else 'low' end as season, case when x / 400 > 0.1 then 'raised' else 'normal' end as corr, case when x / 100 > 0.98 then 'very high' when x / 100 > 0.9 then 'high' else 'moderate' end as persistence,
  case when x / 400 > 0.15 then 'high' else 'moderate' end as alpha, case when x / 100 > 0.9 then 'very persistent' when x / 100 > 0.7 then 'persistent' else 'fleeting' end as beta, case when x < 20 then 'low' when x > 80 then 'high' else 'normal' end as vol,
  case when x / 50 - 1 < -0.5 then 'left' when x / 50 - 1 > 0.5 then 'right' else 'even' end as skew, case when x / 50 > 1 then 'fat' else 'normal' end as tails, case when x >= 75 then 'aggressive' when x >= 50 then 'growth' when x >= 25 then 'balanced' else 'careful' end as risk,
  case when x >= 70 then 'stable' when x >= 40 then 'mixed' else 'unstable' end as score from (select o_orderkey as k, o_orderkey % 101 as x from orders)""", "", "k pbo walk season corr persistence alpha beta vol skew tails risk score", base=False)
def _(spark, d):
    x, s = F.col("x"), scalars
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 101).alias("x")).select(
        "k", s.label(x / 100, s.PBO).alias("pbo"), s.label(x / 50, s.STABILITY, strict=True).alias("walk"), s.label(x / 20, s.SEASONALITY, strict=True).alias("season"), s.label(x / 400, s.CORRELATION, strict=True).alias("corr"),
        s.label(x / 100, s.PERSISTENCE, strict=True).alias("persistence"), s.label(x / 400, s.ALPHA, strict=True).alias("alpha"), s.label(x / 100, s.BETA, strict=True).alias("beta"), s.between(x, s.PERCENTILE).alias("vol"), s.between(x / 50 - 1, s.SKEW).alias("skew"),
        s.label(x / 50, s.KURTOSIS, strict=True).alias("tails"), s.label(x, s.RISK).alias("risk"), s.label(x, s.SCORE).alias("score"),
    )


# --- sources and sinks, there and back


def _wide_file(spark: SparkSession, d: str) -> str:
    """A folder with the prices as a wide CSV file of the name that a directory is searched for."""
    folder = new_folder(spark, "price-files")
    assets = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    p.wide(region_prices(spark, d), "price", assets).write.option("header", True).csv(f"{folder}/{src.PROBED[1]}")
    return folder


@query("src_csv", "select * from prices", "price", "date asset")
def _(spark, d):
    return src.wide_csv(spark, f"{_wide_file(spark, d)}/{src.PROBED[1]}")


@query("src_dir_probe", "select * from prices", "price", "date asset")
def _(spark, d):
    return src.validated(staged(src.load(spark, _wide_file(spark, d)), "prices"))


@query("snk_tables", "select 'prices' as name, count(*) as n from prices union all select 'returns', count(*) from rets union all select 'weights', count(*) from w union all select 'metrics', count(distinct strategy) from port", "", "name n")
def _(spark, d):
    folder = new_folder(spark, "export")
    src.export({"prices": region_prices(spark, d), "returns": returns(spark, d), "weights": weights(spark, d), "metrics": metrics.basic(portfolios(spark, d), 0.02)}, folder)
    read = [spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in ("prices", "returns", "weights", "metrics")]
    return read[0].union(read[1]).union(read[2]).union(read[3])


def exported(spark: SparkSession, d: str) -> str:
    """A workbook of prices (wide), returns, weights, metrics and the frontier."""
    folder = shared_files(spark, "workbooks")
    r = stored_returns(spark, d)
    assets = [x.asset for x in r.select("asset").distinct().orderBy("asset").collect()]
    path = f"{folder}/portfolios.xlsx"
    workbook.export({
        "prices": (p.wide(region_prices(spark, d), "price", assets), ["date"]), "returns": (r, ["date", "asset"]), "weights": (weights(spark, d), ["strategy", "asset"]),
        "metrics": (metrics.basic(portfolios(spark, d), 0.02), ["strategy"]), "frontier": (staged(optimize.frontier(r), "frontier"), ["i"]),
    }, path)
    return path


@query("src_xlsx", "select * from prices", "price", "date asset")
def _(spark, d):
    return src.validated(staged(workbook.wide_workbook(spark, f"file://{exported(spark, d)}", "prices"), "prices"))


@query("snk_xlsx", """select 'prices' as sheet, 1 + count(distinct date) as n_rows, 6::long as n_columns from prices union all select 'returns', 1 + count(*), 3 from rets union all select 'weights', 1 + count(*), 3 from w union all
  select 'metrics', 1 + count(distinct strategy), 10 from port union all select 'frontier', 51, 6""", "", "sheet n_rows n_columns")
def _(spark, d):
    return workbook.cells(spark, f"file://{exported(spark, d)}").groupBy("sheet").agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_columns"))


def _answers(spark: SparkSession, d: str) -> str:
    """A folder with a CSV answer for each asset, as a quote service gives them; written in tasks."""
    folder = shared_files(spark, "answers")

    def write(frame):
        name = f"{folder}/{frame['asset'].iloc[0]}.csv"
        frame = frame.sort_values("date")
        frame[["date", "price"]].rename(columns={"date": "Date", "price": "Close"}).to_csv(f"{name}.part", index=False)
        os.replace(f"{name}.part", name)
        return frame[["asset"]].head(1)

    region_prices(spark, d).select("date", "asset", "price").groupBy("asset").applyInPandas(write, "asset string").collect()  # a row for each asset
    return folder


@query("src_yahoo", "select * from prices", "price", "date asset")
def _(spark, d):
    spark.dataSource.register(quotes.QuoteSource)
    symbols = ",".join(r.asset for r in region_prices(spark, d).select("asset").distinct().orderBy("asset").collect())
    read = spark.read.format("quotes").option("url", f"file://{_answers(spark, d)}/{{symbol}}.csv").option("schemes", "file")
    return read.option("symbols", symbols).load()
