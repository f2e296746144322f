"""Registered queries of the portfolio library and the SQL that gives the same rows.

Doubles are rounded to six digits in both, because sums are added in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisand.operators import metrics as m
from palisand.operators import panel as p
from palisand.operators import quantiles
from palisand.plans.panel import once, region_prices, stored_panels, table, weights
from palisand.storage import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Tables that the SQL of a query can name.
BASE = """
with px as (select date_trunc('week', l_shipdate)::date as date, r_name as asset, sum(l_extendedprice) / sum(l_quantity) as price
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2),
prices as (select date, asset, price from (select *, count(*) over (partition by date) as k from px) where k = (select count(distinct asset) from px)),
rets as (select * from (select date, asset, price / lag(price) over (partition by asset order by date) - 1 as r from prices) where r is not null),
logs as (select * from (select date, asset, ln(price) - lag(ln(price)) over (partition by asset order by date) as r from prices) where r is not null),
w as (select 'equal' as strategy, asset, 0.2::double as w from (select distinct asset from px) union all
  select 'tilt', asset, row_number() over (order by asset) / 15.0::double from (select distinct asset from px)),
port as (select strategy, date, sum(w * r) as r from rets join w using (asset) group by 1, 2),
path as (select *, product(1 + r) over (partition by strategy order by date rows unbounded preceding) as equity from port),
dd as (select *, max(equity) over (partition by strategy order by date rows unbounded preceding) as peak,
  equity / max(equity) over (partition by strategy order by date rows unbounded preceding) - 1 as drawdown from path),
tails as (select strategy, var, coalesce(avg(case when r <= var then r end), any_value(var)) as cvar from port join (select strategy, quantile_cont(r, 0.05) as var from port group by 1) using (strategy) group by 1, 2),
ex as (select t.strategy, t.date, t.r, e.r as b, t.r - e.r as x from port t join port e on e.date = t.date and e.strategy = 'equal' where t.strategy = 'tilt')
"""


def query(name: str, sql: str | None, doubles: str = "", others: str = "", base: bool = True) -> Callable:
    """Register a function, rounded to what the SQL gives: columns named in doubles and in others."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with stored_panels():
                out = f(spark, sf_dir)
            return out.select(*[F.round(c, 6).alias(c) for c in doubles.split()], *others.split()) if doubles or others else out

        QUERIES[name] = run
        if sql:
            shown = ", ".join([f"round({c}, 6) as {c}" for c in doubles.split()] + others.split()) or "*"
            ORACLES[name] = (BASE if base else "") + f"select {shown} from ({sql})"
        return f

    return add


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.simple_returns(region_prices(spark, sf_dir))


def stored_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """returns(), stored, for queries that use them in many places."""
    return once("returns", lambda: returns(spark, sf_dir))


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.portfolio_returns(returns(spark, sf_dir), weights(spark, sf_dir))


def tilt_over_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = portfolios(spark, sf_dir)
    return p.excess(both.filter("strategy = 'tilt'"), both.filter("strategy = 'equal'"))


# --- panels: projections, filters, joins, reshaping


@query("src_prices", "select * from prices", "price", "date asset")
def _(spark, d):
    return region_prices(spark, d)


@query("src_prices_daily", """select date_trunc('day', l_shipdate)::date as date, r_name as asset, sum(l_extendedprice) / sum(l_quantity) as price
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2
  qualify count(*) over (partition by date_trunc('day', l_shipdate)::date) = 5""", "price", "date asset", base=False)
def _(spark, d):
    return region_prices(spark, d, "day")


@query("src_symbol_list", """select o_orderkey % 7 as k, list_reduce(list_prepend([]::varchar[], list_transform(list_filter(list_transform(string_split_regex('  ' || o_orderpriority || ',x' || chr(10) || ' X ,' || lower(o_orderstatus) || ',', '[,\\n]'), lambda s: upper(trim(s, ' '))), lambda s: s <> ''), lambda s: [s])),
  lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as s from orders""", "", "k s", base=False)
def _(spark, d):
    text = F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(",x\n X ,"), F.lower("o_orderstatus"), F.lit(","))
    return table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("k"), p.symbols(text).alias("s"))


@query("src_catalog_filter", "select n_name as ticker, r_name as name from nation join region on n_regionkey = r_regionkey where contains(upper(n_name), 'AM') or contains(upper(r_name), 'AM')", "", "ticker name", base=False)
def _(spark, d):
    catalog = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("ticker"), F.col("r_name").alias("name"))
    return p.catalog_filter(catalog, "am")


@query("proj_select_assets", "select date, asset, price from prices where asset in ('ASIA', 'EUROPE', 'NOWHERE')", "price", "date asset")
def _(spark, d):
    return p.select_assets(region_prices(spark, d), ["ASIA", "EUROPE", "NOWHERE"])


@query("jn_anti_missing", "select a as asset from (values ('ASIA'), ('NOWHERE')) t(a) where a not in (select asset from prices)", "", "asset")
def _(spark, d):
    return p.missing_assets(region_prices(spark, d), spark.createDataFrame([("ASIA",), ("NOWHERE",)], "asset string"))


@query("flt_date_range", "select * from prices where date between date '1996-01-01' and date '1997-06-30'", "price", "date asset")
def _(spark, d):
    return p.date_range(region_prices(spark, d), "1996-01-01", "1997-06-30")


@query("flt_complete_rows", "select date, count(*) as n from prices group by 1", "", "date n")
def _(spark, d):
    return region_prices(spark, d).groupBy("date").agg(F.count("*").alias("n"))


@query("flt_last_n", "select * from prices where date in (select distinct date from prices order by date desc limit 60)", "price", "date asset")
def _(spark, d):
    return p.last_dates(region_prices(spark, d), 60)


@query("flt_year", "select * from prices where year(date) in (select distinct year(date) from prices order by 1 desc limit 3)", "price", "date asset")
def _(spark, d):
    return p.years(region_prices(spark, d), 3)


@query("proj_pct_change", "select * from rets", "r", "date asset")
def _(spark, d):
    return returns(spark, d)


@query("proj_log_return", "select * from logs", "r", "date asset")
def _(spark, d):
    return p.log_returns(region_prices(spark, d))


@query("proj_abs", "select date, asset, abs(r) as r from logs", "r", "date asset")
def _(spark, d):
    return p.log_returns(region_prices(spark, d)).withColumn("r", F.abs("r"))


@query("proj_rebase100", "select date, asset, price / first_value(price) over (partition by asset order by date) * 100 as level from prices", "level", "date asset")
def _(spark, d):
    return p.rebase(region_prices(spark, d))


@query("proj_dot", "select * from port", "r", "strategy date")
def _(spark, d):
    return portfolios(spark, d)


@query("proj_display_name", "select asset, coalesce(m.label, asset) as label from (select distinct asset from prices) left join (values ('ASIA', 'Asia Pacific'), ('EUROPE', 'Europe')) m(a, label) on m.a = asset", "", "asset label")
def _(spark, d):
    names = spark.createDataFrame([("ASIA", "Asia Pacific"), ("EUROPE", "Europe")], "asset string, label string")
    return region_prices(spark, d).select("asset").distinct().join(names, "asset", "left").withColumn("label", F.coalesce("label", "asset"))


@query("proj_short_name", """select name, case when contains(name, 'Maximum Sharpe') then 'Max Sharpe' when contains(name, 'Maximum Return') then 'Max Return' when contains(name, 'Minimum Volatility') then 'Min Vol'
  when contains(name, 'Hierarchical Risk Parity') or contains(name, 'HRP') then 'HRP' when contains(name, 'Risk Parity') then 'Risk Parity' when contains(name, 'Equally Weighted') then 'Equal' when contains(name, 'Markowitz') then 'Markowitz'
  else split_part(name, ' ', 1) end as short from (select r_name || ' ' || s as name from region, (values ('Maximum Sharpe Portfolio'), ('Maximum Return'), ('Minimum Volatility'), ('Hierarchical Risk Parity (HRP)'), ('HRP'), ('Risk Parity'), ('Equally Weighted'), ('Markowitz Mean-Variance'), ('Custom Mix')) v(s))""", "", "name short", base=False)
def _(spark, d):
    endings = ["Maximum Sharpe Portfolio", "Maximum Return", "Minimum Volatility", "Hierarchical Risk Parity (HRP)", "HRP", "Risk Parity", "Equally Weighted", "Markowitz Mean-Variance", "Custom Mix"]
    names = table(spark, d, "region").select(F.explode(F.array(*map(F.lit, endings))).alias("s"), "r_name").select(F.concat_ws(" ", "r_name", "s").alias("name"))
    return names.withColumn("short", p.short_name(F.col("name")))


@query("proj_pivot", "select date, max(case when asset = 'ASIA' then price end) as asia, max(case when asset = 'EUROPE' then price end) as europe from prices group by 1", "asia europe", "date")
def _(spark, d):
    return p.wide(region_prices(spark, d), "price", ["ASIA", "EUROPE"]).withColumnsRenamed({"ASIA": "asia", "EUROPE": "europe"})


@query("proj_unpivot", "select * from prices where asset in ('ASIA', 'EUROPE')", "price", "date asset")
def _(spark, d):
    return p.long(p.wide(region_prices(spark, d), "price", ["ASIA", "EUROPE"]))


@query("flt_weights_shown", "select strategy, asset, w from w where w > 0.15", "w", "strategy asset")
def _(spark, d):
    return weights(spark, d).filter("w > 0.15")


@query("jn_outer_align", "select coalesce(a.date, b.date) as date, a.price as a, b.price as b from (select * from px where asset = 'ASIA') a full join (select * from px where asset = 'EUROPE' and date > date '1998-01-01') b on a.date = b.date", "a b", "date")
def _(spark, d):
    sales = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sales = sales.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda name: sales.filter(F.col("r_name") == name).groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("value"))
    return p.outer_align(one("ASIA"), one("EUROPE").filter("date > date '1998-01-01'"))


@query("jn_inner_index", "select distinct date from prices where date in (select date from prices where price > 1500)", "", "date")
def _(spark, d):
    prices = region_prices(spark, d)
    return p.common_dates(prices, prices.filter("price > 1500"))


@query("jn_series_arith", "select * from ex", "r b x", "strategy date")
def _(spark, d):
    return tilt_over_equal(spark, d)


@query("jn_semi_schedule", "select * from port where date in (select max(date) from port group by year(date), month(date))", "r", "strategy date")
def _(spark, d):
    port = portfolios(spark, d)
    ends = port.groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.max("date").alias("date"))
    return port.join(ends, "date", "left_semi")


@query("jn_cross_pairs", "select a.asset as i, b.asset as j, corr(a.r, b.r) as rho, covar_samp(a.r, b.r) as cov from rets a join rets b on a.date = b.date and a.asset < b.asset group by 1, 2", "rho cov", "i j")
def _(spark, d):
    r = returns(spark, d)
    other = r.select("date", F.col("asset").alias("j"), F.col("r").alias("s"))
    return r.join(other, "date").filter("asset < j").groupBy(F.col("asset").alias("i"), "j").agg(F.corr("r", "s").alias("rho"), F.covar_samp("r", "s").alias("cov"))


@query("set_union_intersect_difference", "select 'union' as k, count(*) as n from (select distinct date from prices where price > 1500 union select distinct date from prices where price < 1400) union all select 'both', count(*) from (select date from prices where price > 1500 intersect select date from prices where price < 1400) union all select 'only', count(*) from (select date from prices where price > 1500 except select date from prices where price < 1400)", "", "k n")
def _(spark, d):
    prices = region_prices(spark, d)
    a, b = prices.filter("price > 1500").select("date"), prices.filter("price < 1400").select("date")
    count = lambda k, df: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
    return count("union", a.union(b).distinct()).union(count("both", a.intersect(b))).union(count("only", a.subtract(b)))


# --- aggregates and metrics


@query("met_basic", """select strategy, n, ann_return, ann_vol, (ann_return - 0.02) / ann_vol as sharpe, (ann_return - 0.02) / loss_vol as sortino, mdd as max_drawdown, ann_return / abs(mdd) as calmar, var as var_5, cvar as cvar_5
  from (select strategy, count(*) as n, avg(r) * 252 as ann_return, stddev_samp(r) * sqrt(252) as ann_vol, stddev_samp(case when r < 0 then r end) * sqrt(252) as loss_vol, min(drawdown) as mdd from dd group by 1) join tails using (strategy)""",
  "ann_return ann_vol sharpe sortino max_drawdown calmar var_5 cvar_5", "strategy n")
def _(spark, d):
    return m.basic(portfolios(spark, d), rf=0.02)


@query("met_robust", """select strategy, (mean - 0.02) / vol as sharpe, (mean - 0.02) / loss_vol as sortino, mean / mdd as calmar, mdd as max_drawdown_abs, cvar as cvar_95, win_rate
  from (select strategy, avg(r) * 252 as mean, stddev_samp(r) * sqrt(252) as vol, stddev_samp(case when r < 0 then r end) * sqrt(252) as loss_vol, abs(min(drawdown)) as mdd, avg((r > 0)::int) as win_rate from dd group by 1) join tails using (strategy)""",
  "sharpe sortino calmar max_drawdown_abs cvar_95 win_rate", "strategy")
def _(spark, d):
    return m.robust(portfolios(spark, d), rf=0.02)


@query("met_asset_table", """select asset, avg(r) * 252 as ann_return, stddev_samp(r) * sqrt(252) as ann_vol, min(x) as max_drawdown, avg(r) * 252 / (stddev_samp(r) * sqrt(252)) as sharpe, rank() over (order by avg(r) / stddev_samp(r) desc)::int as place
  from (select *, e / max(e) over (partition by asset order by date rows unbounded preceding) - 1 as x from (select *, product(1 + r) over (partition by asset order by date rows unbounded preceding) as e from rets)) group by 1""", "ann_return ann_vol max_drawdown sharpe", "asset place")
def _(spark, d):
    from pyspark.sql import Window

    out = m.basic(returns(spark, d).withColumnRenamed("asset", "strategy"))
    return out.withColumnRenamed("strategy", "asset").withColumn("place", F.rank().over(Window.orderBy(F.desc("sharpe"))))


@query("met_sharpe2", "select strategy, avg(r - 0.02 / 252) / stddev_samp(r - 0.02 / 252) * sqrt(252) as sharpe from port group by 1", "sharpe", "strategy")
def _(spark, d):
    return m.excess_sharpe(portfolios(spark, d), 0.02)


@query("met_sortino2", "select strategy, avg(r - 0.02 / 252) / sqrt(avg(case when r < 0 then r * r end)) * sqrt(252) as sortino from port group by 1", "sortino", "strategy")
def _(spark, d):
    return m.target_sortino(portfolios(spark, d), 0.02)


@query("met_maxdd2", "select strategy, mdd, min(date) as peak_date, trough_date from dd join (select strategy, min(drawdown) as mdd, arg_min(date, drawdown) as trough_date, arg_min(peak, drawdown) as p from dd group by 1) using (strategy) where equity = p and date <= trough_date group by 1, 2, 4", "mdd", "strategy peak_date trough_date")
def _(spark, d):
    return m.max_drawdown(portfolios(spark, d))


@query("met_dd_summary", "select strategy, mdd, trough_date, date_diff('day', trough_date, min(case when date >= trough_date and equity >= p then date end))::int as days from dd join (select strategy, min(drawdown) as mdd, arg_min(date, drawdown) as trough_date, arg_min(peak, drawdown) as p from dd group by 1) using (strategy) group by 1, 2, 3", "mdd", "strategy trough_date days")
def _(spark, d):
    return m.recovery(portfolios(spark, d))


@query("met_calmar2", "select strategy, avg(r) * 252 / abs(min(drawdown)) as calmar from dd group by 1", "calmar", "strategy")
def _(spark, d):
    return m.calmar(portfolios(spark, d))


@query("met_var_cvar", "select * from tails", "var cvar", "strategy")
def _(spark, d):
    return quantiles.tail(staged(portfolios(spark, d), "portfolios"))


@query("met_info_ratio", "select strategy, avg(x) / stddev_samp(x) * sqrt(252) as information_ratio from ex group by 1", "information_ratio", "strategy")
def _(spark, d):
    return m.information_ratio(tilt_over_equal(spark, d))


@query("met_alpha_beta", """select strategy, a * 252 as alpha, beta, n, a / sqrt(s2 * (1.0 / n + mx * mx / sxx)) as t_alpha, beta / sqrt(s2 / sxx) as t_beta from (select *, (syy - sxy * sxy / sxx) / (n - 2) as s2 from
  (select strategy, regr_slope(r, b) as beta, regr_intercept(r, b) as a, regr_sxx(r, b) as sxx, regr_syy(r, b) as syy, regr_sxy(r, b) as sxy, avg(b) as mx, count(*) as n from ex group by 1))""", "alpha beta t_alpha t_beta", "strategy n")
def _(spark, d):
    return m.alpha_beta(tilt_over_equal(spark, d))


@query("agg_geo_ann", "select strategy, product(1 + r) - 1 as total, pow(product(1 + r), 252.0 / count(*)) - 1 as ann_return from port group by 1", "total ann_return", "strategy")
def _(spark, d):
    return m.geometric(portfolios(spark, d))


@query("agg_skew_kurt", """select strategy, n, mean, sd, skew, k as excess_kurtosis, worst, best, worst_date, best_date, median, n / 6.0 * (skew * skew + k * k / 4) as jarque_bera, exp(-n / 12.0 * (skew * skew + k * k / 4)) as p from
  (select strategy, count(*) as n, avg(r) as mean, stddev_pop(r) as sd, avg(pow(z, 3)) as skew, avg(pow(z, 4)) - 3 as k, min(r) as worst, max(r) as best, arg_min(date, r) as worst_date, arg_max(date, r) as best_date, median(r) as median
   from (select *, (r - avg(r) over (partition by strategy)) / stddev_pop(r) over (partition by strategy) as z from port) group by 1)""", "mean sd skew excess_kurtosis worst best median jarque_bera p", "strategy n worst_date best_date")
def _(spark, d):
    return m.moments(portfolios(spark, d))


@query("agg_percentileofscore", "select strategy, 50.0 / count(*) * (count(*) filter (where r < x) + count(*) filter (where r <= x) + 1) as score from port join (select strategy, arg_max(r, date) as x from port group by 1) using (strategy) group by 1", "score", "strategy")
def _(spark, d):
    return m.percentile_of(portfolios(spark, d))


@query("agg_hhi", "select strategy, sum(w) filter (where k <= 3) as top3, sum(w * w) as hhi, count(*) filter (where c <= 0.9) + 1 as n90 from (select *, row_number() over (partition by strategy order by w desc, asset) as k, sum(w) over (partition by strategy order by w desc, asset rows unbounded preceding) as c from w) group by 1", "top3 hhi", "strategy n90")
def _(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("strategy").orderBy(F.desc("w"), "asset")
    x = weights(spark, d).withColumns({"k": F.row_number().over(o), "c": F.sum("w").over(o.rowsBetween(Window.unboundedPreceding, 0))})
    return x.groupBy("strategy").agg(F.sum(F.when(F.col("k") <= 3, F.col("w"))).alias("top3"), F.sum(F.col("w") ** 2).alias("hhi"), (F.count_if(F.col("c") <= 0.9) + 1).alias("n90"))


@query("agg_group_year_month", "select strategy, year(date)::int as y, month(date)::int as mo, avg(r) as mean, count(*) as n from port group by 1, 2, 3", "mean", "strategy y mo n")
def _(spark, d):
    return portfolios(spark, d).groupBy("strategy", F.year("date").alias("y"), F.month("date").alias("mo")).agg(F.avg("r").alias("mean"), F.count("*").alias("n"))


@query("met_seasonality", "select strategy, mo as month, avg(x) as mean, avg((x > 0)::int) as positive, stddev_samp(x) as sd, count(*) as years from (select strategy, year(date) as y, month(date)::int as mo, pow(1 + avg(r), count(*)) - 1 as x from port group by 1, 2, 3) group by 1, 2", "mean positive sd", "strategy month years")
def _(spark, d):
    return m.seasonality(portfolios(spark, d))


@query("met_year_curves", "select strategy, date, year(date)::int as year, product(1 + r) over (partition by strategy, year(date) order by date rows unbounded preceding) * 100 as level from port", "level", "strategy date year")
def _(spark, d):
    return m.year_curves(portfolios(spark, d))


# --- windows


@query("win_drawdown", "select strategy, date, equity, peak, drawdown from dd", "equity peak drawdown", "strategy date")
def _(spark, d):
    return m.equity(portfolios(spark, d))


@query("win_rolling", """select strategy, date, sd * sqrt(252) as vol, pow(p, 252 / 26.0) - 1 as ret, mean / sd * sqrt(252) as sharpe, mean + 2 * sd as upper, mean - 2 * sd as lower from
  (select strategy, date, count(*) over v as n, stddev_samp(r) over v as sd, avg(r) over v as mean, product(1 + r) over v as p from port window v as (partition by strategy order by date rows 25 preceding)) where n = 26""", "vol ret sharpe upper lower", "strategy date")
def _(spark, d):
    return m.rolling(portfolios(spark, d), 26)


@query("met_rolling_stats", "select strategy, avg(v) as mean, min(v) as low, max(v) as high from (select strategy, count(*) over x as n, stddev_samp(r) over x * sqrt(252) as v from port window x as (partition by strategy order by date rows 51 preceding)) where n = 52 group by 1", "mean low high", "strategy")
def _(spark, d):
    return m.rolling(portfolios(spark, d), 52).groupBy("strategy").agg(F.avg("vol").alias("mean"), F.min("vol").alias("low"), F.max("vol").alias("high"))


@query("win_rank_desc", "select date, asset, rank() over (partition by date order by v desc) + (count(*) over (partition by date, v) - 1) / 2.0 as place from (select date, asset, round(r, 1) as v from rets)", "place", "date asset")
def _(spark, d):
    from pyspark.sql import Window

    v = returns(spark, d).select("date", "asset", F.round("r", 1).alias("v"))
    return v.withColumn("place", (F.rank().over(Window.partitionBy("date").orderBy(F.desc("v"))) + (F.count("*").over(Window.partitionBy("date", "v")) - 1) / 2).cast("double"))


@query("win_regime_change", "select strategy, min(date) as first, max(date) as last, count(*) as n, any_value(high) as high from (select *, sum(flip) over (partition by strategy order by date) as g from (select *, coalesce((high <> lag(high) over (partition by strategy order by date))::int, 0) as flip from (select *, r > 0.05 as high from port))) group by strategy, g", "", "strategy first last n high")
def _(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("strategy").orderBy("date")
    x = portfolios(spark, d).withColumn("high", F.col("r") > 0.05)
    x = x.withColumn("flip", F.coalesce((F.col("high") != F.lag("high").over(o)).cast("int"), F.lit(0))).withColumn("g", F.sum("flip").over(o))
    return x.groupBy("strategy", "g").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.first("high").alias("high"))


@query("ts_acf", """select strategy, lag, acf, abs(acf) <= 1.959963984540054 / sqrt(n) as inside from (select strategy, lag, any_value(n) as n, sum(x * y) / (any_value(n) - lag) / any_value(v) as acf from
  (select a.strategy, (b.i - a.i)::int as lag, a.n, a.v, a.x, b.x as y from z a join z b on a.strategy = b.strategy and b.i - a.i between 1 and 10) group by 1, 2)""".replace(
  " z ", " (select strategy, row_number() over (partition by strategy order by date) as i, r - avg(r) over (partition by strategy) as x, var_pop(r) over (partition by strategy) as v, count(*) over (partition by strategy) as n from port) "), "acf", "strategy lag inside")
def _(spark, d):
    return m.autocorrelation(portfolios(spark, d), 10)


# --- top-k


@query("top_assets", "select asset, total, k from (select asset, product(1 + r) - 1 as total, row_number() over (order by product(1 + r) desc)::int as k from rets group by 1) where k <= 3", "total", "asset k")
def _(spark, d):
    from pyspark.sql import Window

    total = returns(spark, d).groupBy("asset").agg((F.product(1 + F.col("r")) - 1).alias("total")).orderBy(F.desc("total")).limit(3)
    return total.withColumn("k", F.row_number().over(Window.orderBy(F.desc("total"))))


@query("kpi_best", "select arg_max(strategy, m) as best_return, arg_max(strategy, m / s) as best_sharpe, arg_min(strategy, s) as least_vol from (select strategy, avg(r) as m, stddev_samp(r) as s from port group by 1)", "", "best_return best_sharpe least_vol")
def _(spark, d):
    g = portfolios(spark, d).groupBy("strategy").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return g.agg(F.max_by("strategy", "m").alias("best_return"), F.max_by("strategy", F.col("m") / F.col("s")).alias("best_sharpe"), F.min_by("strategy", "s").alias("least_vol"))


@query("met_alerts", "select strategy, abs(mdd) > 0.2 as deep, s < 3.69 as poor from (select strategy, min(drawdown) as mdd, avg(r) * 252 / (stddev_samp(r) * sqrt(252)) as s from dd group by 1)", "", "strategy deep poor")
def _(spark, d):
    return m.basic(portfolios(spark, d)).select("strategy", (F.abs("max_drawdown") > 0.2).alias("deep"), (F.col("sharpe") < 3.69).alias("poor"))


@query("sc_period_end", "select distinct date, last_day(date) as m, (date_trunc('quarter', date) + interval 3 month - interval 1 day)::date as q, (date_trunc('year', date) + interval 1 year - interval 1 day)::date as a, (date + ((7 - isodow(date))::int))::date as w from prices", "", "date m q a w")
def _(spark, d):
    dates = region_prices(spark, d).select("date").distinct()
    return dates.select("date", *[p.period_end(F.col("date"), f).alias(f.lower()) for f in "MQAW"])


@query("snk_json", "select strategy, to_json(map_from_entries(list(row(asset, round(w * 100, 2)) order by asset))) as js from w where w > 0.001 group by 1", "", "strategy js")
def _(spark, d):
    shown = weights(spark, d).filter("w > 0.001")
    return shown.groupBy("strategy").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", F.round(F.col("w") * 100, 2).alias("v")))))).alias("js"))
