"""Registered queries of recursions through time with given parameters, which recursive SQL states day by day, and of their extremes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisand.operators import backtest as bt
from palisand.functions import scalars
from palisand.operators import correlation, factors, metrics, optimize, quantiles, regimes, robust, series
from palisand.operators.blocks import numbered
from palisand.operators.optimize import dense
from palisand.plans.catalog import BASE, ORACLES, portfolios, query, stored_returns
from palisand.plans.models import logs
from palisand.plans.panel import table
from palisand.storage import staged

RECURSIVE = BASE.replace("with px", "with recursive px")


def shown(doubles: str, others: str = "") -> str:
    return ", ".join([f"round({c}, 6) as {c}" for c in doubles.split()] + others.split())


# --- dynamic correlations

_Z = """zs as (select asset, date, (r - avg(r) over (partition by asset)) / stddev_pop(r) over (partition by asset) as z from logs)"""
A, B, HALF_LIFE, LOOKBACK = 0.05, 0.9, 120.0, 300


def standardised(spark: SparkSession, d: str) -> DataFrame:
    return factors.standardised(logs(spark, d))


@query("ts_dcc_given", None, "rho", "date i j")
def _(spark, d):
    rows = correlation.ordered(standardised(spark, d), LOOKBACK)
    return correlation.path(rows, correlation.target(rows, HALF_LIFE), A, B)


ORACLES["ts_dcc_given"] = RECURSIVE + f""", {_Z},
zi as (select *, dense_rank() over (order by date desc) - 1 as age, (dense_rank() over (order by asset) - 1)::int as k from zs),
zp as (select a.date, a.age, {LOOKBACK} - 1 - a.age as t, a.k as i, b.k as j, a.z as x, b.z as y, pow(0.5, a.age / {HALF_LIFE}) as p from zi a join zi b on a.date = b.date where a.age < {LOOKBACK}),
zt as (select date, t - min(t) over () as t, i, j, x * y as xy, p, x, y from zp),
mo as (select i, j, sum(p * xy) / sum(p) - sum(p * x) / sum(p) * sum(p * y) / sum(p) as c from zt group by 1, 2),
rb as (select list(m.c / sqrt(u.c * v.c) order by m.i, m.j) as rb from mo m join mo u on u.i = m.i and u.j = m.i join mo v on v.i = m.j and v.j = m.j),
zz as (select t, any_value(date) as date, list(xy order by i, j) as zz from zt group by 1),
walk as (select 0::bigint as t, rb as q from rb union all
  select w.t + 1, list_transform(list_zip(rb, zz, q), lambda x: (1 - {A} - {B}) * x[1] + {A} * x[2] + {B} * x[3]) from walk w join zz on zz.t = w.t, rb)
select date, i::int as i, j::int as j, round(q[5 * i + j + 1] / sqrt(q[6 * i + 1] * q[6 * j + 1]), 6) as rho from walk join zz using (t), range(5) a(i), range(5) b(j) where i < j"""

PAIR = ("ASIA", "EUROPE")
POINTS = [(a, b) for a in (0.02, 0.05, 0.1) for b in (0.5, 0.8, 0.9)]


@query("ts_dcc_likelihoods", None, "a b likelihood", "")
def _(spark, d):
    rows = correlation.ordered(standardised(spark, d).filter(F.col("asset").isin(*PAIR)))
    named = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(POINTS)], "k long, a double, b double")
    return correlation.likelihoods(rows, correlation.target(rows), POINTS).join(F.broadcast(named), "k").select("a", "b", F.col("v").alias("likelihood"))


ORACLES["ts_dcc_likelihoods"] = RECURSIVE + f""", {_Z},
zz as (select row_number() over (order by date) - 1 as t, x.z as x, y.z as y from zs x join zs y using (date) where x.asset = '{PAIR[0]}' and y.asset = '{PAIR[1]}'),
rb as (select corr(x, y) as c from zz),
pt as (select * from (values {', '.join(map(str, POINTS))}) v(a, b)),
walk as (select a::double as a, b::double as b, 0::bigint as t, 1.0::double as q1, c as q, 1.0::double as q2 from pt, rb union all
  select a, b, w.t + 1, 1 - a - b + a * x * x + b * q1, (1 - a - b) * c + a * x * y + b * q, 1 - a - b + a * y * y + b * q2 from walk w join zz on zz.t = w.t, rb)
select round(a, 6) as a, round(b, 6) as b, round(sum(-0.5 * (ln(1 - r * r) + (x * x + y * y - 2 * r * x * y) / (1 - r * r))), 6) as likelihood
from (select *, q / sqrt(q1 * q2) as r from walk join zz using (t)) group by 1, 2"""


# --- regimes

MODEL = regimes.Model(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.0, 0.0]), np.array([0.05, 0.15]))


@query("fac_hmm_given", None, "p stay p_next", "date regime")
def _(spark, d):
    return regimes.described(regimes.ordered(logs(spark, d)), MODEL)


ORACLES["fac_hmm_given"] = RECURSIVE + """, mr as (select date, row_number() over (order by date) as t, count(*) over () as n, avg(r) as r from logs group by date),
el as (select *, exp(-0.5 * pow(r / 0.05, 2)) / 0.05 as e1, exp(-0.5 * pow(r / 0.15, 2)) / 0.15 as e2 from mr),
fw as (select t, e1 / (e1 + e2) as f1, e2 / (e1 + e2) as f2 from el where t = 1 union all
  select t, u1 / (u1 + u2), u2 / (u1 + u2) from (select e.t, (f1 * 0.9 + f2 * 0.2) * e1 as u1, (f1 * 0.1 + f2 * 0.8) * e2 as u2 from fw join el e on e.t = fw.t + 1)),
bw as (select n as t, 1.0::double as b1, 1.0::double as b2 from el where t = n union all
  select t, u1 / (u1 + u2), u2 / (u1 + u2) from (select e.t - 1 as t, 0.9 * e1 * b1 + 0.1 * e2 * b2 as u1, 0.2 * e1 * b1 + 0.8 * e2 * b2 as u2 from bw join el e on e.t = bw.t where e.t > 1)),
po as (select t, f1 * b1 / (f1 * b1 + f2 * b2) as p1, f2 * b2 / (f1 * b1 + f2 * b2) as p2 from fw join bw using (t)),
vi as (select t, ln(0.5) + ln(e1) as v1, ln(0.5) + ln(e2) as v2, 0 as c1, 0 as c2 from el where t = 1 union all
  select e.t, greatest(v1 + ln(0.9), v2 + ln(0.2)) + ln(e1), greatest(v1 + ln(0.1), v2 + ln(0.8)) + ln(e2), case when v1 + ln(0.9) >= v2 + ln(0.2) then 0 else 1 end, case when v1 + ln(0.1) >= v2 + ln(0.8) then 0 else 1 end from vi join el e on e.t = vi.t + 1),
st as (select t, case when v1 >= v2 then 0 else 1 end as s from vi where t = (select max(t) from vi) union all select st.t - 1, case s when 0 then c1 else c2 end from st join vi on vi.t = st.t where st.t > 1)
select date, case s when 0 then 'Calm' else 'Panic' end as regime, round(case s when 0 then p1 else p2 end, 6) as p, round(case s when 0 then 10.0::double else 5.0::double end, 6) as stay,
  round(case s when 0 then p1 * 0.9 + p2 * 0.2 else p1 * 0.1 + p2 * 0.8 end, 6) as p_next from st join po using (t) join el using (t)"""


# --- robust location

ROUNDS, NU = 3, 5.0


@query("ts_mlfp_given", None, "location dispersion", "i j")
def _(spark, d):
    return robust.mlfp(logs(spark, d).filter(F.col("asset").isin(*PAIR)), 120.0, NU, steps=ROUNDS, tol=0.0)


def _reweighted(k: int) -> str:
    """Round k: weights from the parameters of round k - 1, then moments, as the fixed point has them."""
    return f"""w{k} as (select x.*, p * ({NU} + 2) / ({NU} + ((x - m1) * (x - m1) * s22 - 2 * (x - m1) * (y - m2) * s12 + (y - m2) * (y - m2) * s11) / (s11 * s22 - s12 * s12)) as w from xy x, r{k - 1}),
a{k} as (select sum(w) as w, sum(w * x) as m1, sum(w * y) as m2 from w{k}),
r{k} as (select any_value(m1) / any_value(a{k}.w) as m1, any_value(m2) / any_value(a{k}.w) as m2, sum(x.w * (x - m1) * (x - m1)) as s11, sum(x.w * (x - m1) * (y - m2)) as s12, sum(x.w * (y - m2) * (y - m2)) as s22 from w{k} x, a{k})"""


ORACLES["ts_mlfp_given"] = BASE + f""", xd as (select x.date, x.r as x, y.r as y, pow(0.5, (row_number() over (order by x.date desc) - 1) / 120.0) as h from logs x join logs y on x.date = y.date where x.asset = '{PAIR[0]}' and y.asset = '{PAIR[1]}'),
xy as (select x, y, h / sum(h) over () as p from xd), a0 as (select sum(p * x) as m1, sum(p * y) as m2 from xy),
r0 as (select any_value(m1) as m1, any_value(m2) as m2, sum(p * (x - m1) * (x - m1)) * 0.6 as s11, sum(p * (x - m1) * (y - m2)) * 0.6 as s12, sum(p * (y - m2) * (y - m2)) * 0.6 as s22 from xy, a0),
{", ".join(_reweighted(k + 1) for k in range(ROUNDS))}
select i::int as i, j::int as j, round(case i when 0 then m1 else m2 end, 6) as location, round(case i + j when 0 then s11 when 1 then s12 else s22 end, 6) as dispersion from r{ROUNDS}, range(2) a(i), range(2) b(j)"""


@query("ts_lfm_market", None, "beta alpha r2", "asset factor")
def _(spark, d):
    r = logs(spark, d)
    return robust.factor_model(r, r.groupBy("date").agg(F.array(F.avg("r")).alias("f")), half_life=120.0)


ORACLES["ts_lfm_market"] = BASE + """, pd as (select date, pow(0.5, (row_number() over (order by date desc) - 1) / 120.0) as h, avg(r) as f from logs group by date),
lx as (select asset, r, f, h / (select sum(h) from pd) as p from logs join pd using (date)),
lm as (select asset, sum(p * r) as mr, sum(p * f) as mf, sum(p * r * f) as rf, sum(p * f * f) as ff, sum(p * r * r) as rr from lx group by 1),
lb as (select *, (rf - mr * mf) / (ff - mf * mf) as beta from lm)
select asset, 0::int as factor, round(beta, 6) as beta, round(mr - beta * mf, 6) as alpha, round(beta * (rf - mr * mf) / (rr - mr * mr), 6) as r2 from lb"""


# --- a back-test with given estimates

CONFIG = bt.Config(run_id="given", window=104, n_components=3, z_entry=1.0, use_hmm=False)


def given_path(spark: SparkSession, d: str) -> DataFrame:
    """The back-test whose factors are the first assets by name, at every estimation date."""
    rows = bt.ordered(logs(spark, d))
    n = rows.select(F.size("r")).first()[0]
    load = np.eye(CONFIG.n_components, n).ravel().tolist()
    dates = rows.filter((F.col("i") >= CONFIG.window) & ((F.col("i") - CONFIG.window) % (CONFIG.reestimation_freq + CONFIG.period_offset) == 0))
    array = lambda x: F.array(*map(F.lit, x))
    learned = dates.select(F.lit(CONFIG.run_id).alias("run_id"), F.col("i").cast("int").alias("t"), array([0.0] * n).alias("mean"), array([1.0] * n).alias("sd"), array(load).alias("loadings"), array([True] * CONFIG.n_components).alias("reverting"))
    return bt.path(spark, rows, staged(learned, "estimates"), [CONFIG])


@query("bt_path_given", None, "r b turnover cost z1 z2 z3", "run_id date regime traded n_active")
def _(spark, d):
    z = [F.get("z", F.lit(k)).alias(f"z{k + 1}") for k in range(3)]
    return given_path(spark, d).select("run_id", "date", "regime", "traded", "r", "b", "turnover", "cost", *z, F.size("signals").alias("n_active"))


_BT = f"""nl as (select date, asset, r, dense_rank() over (order by date) - 1 as t, dense_rank() over (order by asset) as k, sum(r) over (partition by asset order by date rows unbounded preceding) as c from logs),
nz as (select *, c - r as before, (lag(c) over o - avg(c) over (o rows between 60 preceding and 1 preceding)) / stddev_pop(c) over (o rows between 60 preceding and 1 preceding) as z from nl window o as (partition by asset order by date)),
nt as (select *, t = s as trade, case when k in (2, 3) and abs(z) >= 1 then 1 else 0 end as active from (select *, 104 + (t - 104) // 6 * 6 as s from nz where t >= 104)),
nw as (select t as s, k, before as base, x / sum(x) over (partition by t) as w from (select *, least(greatest(0.2 - active * sign(z) * least(abs(z) - 1, 1) * 0.15, 0.05), 0.4) as x from nt where trade)),
np as (select n.*, w.w, w.base, case when trade then coalesce(p.w * exp(before - p.base), 0.2) end as old, w.w * exp(before - w.base) as now from nt n join nw w using (s, k) left join nw p on p.s = n.s - 6 and p.k = n.k),
nq as (select *, now / sum(now) over (partition by t) as held, old / sum(old) over (partition by t) as was from np),
nd as (select date, t, sum(held * r) as gross, avg(r) as b, coalesce(sum(abs(w - was)) filter (where trade), 0) as turnover, sum(active) filter (where trade) as n_active, max(z) filter (where k = 1) as z1, max(z) filter (where k = 2) as z2, max(z) filter (where k = 3) as z3 from nq group by 1, 2)"""
ORACLES["bt_path_given"] = BASE + f""", {_BT}
select 'given' as run_id, date, 'Calm' as regime, turnover > 0.001 as traded, round(gross - turnover * 10 / 1e4, 6) as r, round(b, 6) as b, round(turnover, 6) as turnover, round(turnover * 10 / 1e4, 6) as cost,
  {shown('z1 z2 z3')}, coalesce(n_active, 0)::int as n_active from nd"""


@query("bt_factor_contrib_given", None, "contribution", "run_id factor days")
def _(spark, d):
    return bt.contributions(given_path(spark, d))


ORACLES["bt_factor_contrib_given"] = BASE + f""", {_BT},
na as (select q.date, q.k as factor, abs(q.z) as z, sum(abs(q.z)) over (partition by q.date) as total, gross - turnover * 10 / 1e4 as r from nq q join nd using (date) where trade and active = 1 and turnover > 0.001)
select 'given' as run_id, factor::int as factor, round(sum(r * z / total), 6) as contribution, count(*) as days from na group by 2"""


@query("lim_last20_trades_given", None, "turnover cost", "date regime")
def _(spark, d):
    return given_path(spark, d).filter("traded").orderBy(F.desc("date")).limit(20)


ORACLES["lim_last20_trades_given"] = BASE + f", {_BT} select date, 'Calm' as regime, round(turnover, 6) as turnover, round(turnover * 10 / 1e4, 6) as cost from nd where turnover > 0.001 order by date desc limit 20"


# --- worst and best dates


@query("met_worst_dates", "select strategy, (row_number() over (partition by strategy order by r, date))::int as place, date, r, var from port join tails using (strategy) where r <= var", "r var", "strategy place date")
def _(spark, d):
    return metrics.worst_dates(portfolios(spark, d))


@query("agg_extremes", """select strategy, unit, max(r) as best, arg_max(date, r) as best_date, min(r) as worst, arg_min(date, r) as worst_date from
  (select strategy, 'date' as unit, date, r from port union all select strategy, 'month', max(date), product(1 + r) - 1 from port group by strategy, date_trunc('month', date)) group by 1, 2""", "best worst", "strategy unit best_date worst_date")
def _(spark, d):
    return metrics.extremes(portfolios(spark, d))


@query("agg_weighted_sum", "select date, sum(p * r) as value from logs join (select asset, row_number() over (order by asset) / 15.0 as p from (select distinct asset from logs)) using (asset) group by 1", "value", "date")
def _(spark, d):
    rows = numbered(dense(logs(spark, d)), "date")
    n = F.size("r")
    weight = F.transform(F.sequence(F.lit(1), n), lambda k: k / (n * (n + 1) / 2))
    return rows.select("date", F.aggregate(F.zip_with(weight, "r", lambda w, x: w * x), F.lit(0.0), lambda a, v: a + v).alias("value"))


# --- quantiles of sales, and the tree of assets


@query("agg_percentile", "select l_returnflag as flag, lv::double as level, case lv " + " ".join(f"when {x} then quantile_cont(l_extendedprice / l_quantity, {x})" for x in (0.01, 0.05, 0.5, 0.95, 1.0)) +
       " end as value from lineitem, (values (0.01), (0.05), (0.5), (0.95), (1.0)) v(lv) group by l_returnflag, lv", "level value", "flag", base=False)
def _(spark, d):
    sales = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return quantiles.quantiles(sales, ["flag"], "x", [0.01, 0.05, 0.5, 0.95, 1.0])


@query("opt_merge_heights", None, "height", "k")
def _(spark, d):
    return optimize.merge_heights(stored_returns(spark, d))


ORACLES["opt_merge_heights"] = RECURSIVE + """, ed as (select a.asset as i, b.asset as j, sqrt(greatest((1 - corr(a.r, b.r)) / 2, 0)) as d from rets a join rets b on a.date = b.date and a.asset < b.asset group by 1, 2),
reach as (select e.i, e.j, e.d, e.i as x from ed e union select r.i, r.j, r.d, case when s.i = r.x then s.j else s.i end from reach r join ed s on s.d < r.d and (s.i = r.x or s.j = r.x))
select (row_number() over (order by d))::int as k, round(d, 6) as height from ed where not exists (select 1 from reach r where r.i = ed.i and r.j = ed.j and r.x = ed.j)"""


# --- normal quantiles


def _rational(r: str, parts: tuple) -> str:
    both = []
    for coefficients in (parts[0], (1.0, *parts[1])):
        out = repr(float(coefficients[-1])) + "::double"
        for c in reversed(coefficients[:-1]):
            out = f"({out} * ({r}) + {float(c)!r}::double)"
        both.append(out)
    return f"({both[0]} / {both[1]})"


@query("ts_normal_plot", f"""select strategy, k, m + s * case when abs(q) <= 0.425 then q * {_rational("0.180625 - q * q", scalars.MIDDLE)} else sign(q) * case when t <= 5 then {_rational("t - 1.6", scalars.SIDES)} else {_rational("t - 5", scalars.TAILS)} end end as theory, r from
  (select *, p - 0.5 as q, sqrt(-ln(least(p, 1 - p))) as t from (select *, (k - 0.5::double) / n as p from (select strategy, r, (row_number() over (partition by strategy order by r, date))::int as k, count(*) over (partition by strategy) as n, avg(r) over (partition by strategy) as m, stddev_pop(r) over (partition by strategy) as s from port)))""", "theory r", "strategy k")
def _(spark, d):
    return series.normal_plot(portfolios(spark, d))
