"""Projections, filters, joins and reshaping of panels in long form (date, asset, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("date")


def complete_dates(panel: DataFrame, value: str = "price") -> DataFrame:
    """Rows of the dates on which every asset has a value (what an inner alignment of all series leaves).
    The number of assets is counted first, so panel is read twice: hand in a stored one.  Then a date's rows, at most one
    or a few for each asset, meet in one row."""
    held = panel.filter(F.col(value).isNotNull() & ~F.isnan(value))
    need = held.agg(F.count_distinct("asset")).first()[0]
    rest = [c for c in held.columns if c != "date"]
    dates = held.groupBy("date").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    whole = dates.filter(F.size(F.array_distinct(F.transform("rows", lambda x: x["asset"]))) == need)
    return whole.select("date", F.inline("rows")).select(*held.columns)


def select_assets(panel: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return panel.filter(F.col("asset").isin(list(wanted)))


def missing_assets(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assets of wanted (asset) that the panel lacks."""
    return wanted.join(panel.select("asset").distinct(), "asset", "left_anti")


def date_range(panel: DataFrame, start: str, end: str) -> DataFrame:
    return panel.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def last_dates(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the last n dates (a top-k over distinct dates, then a semi join)."""
    return panel.join(panel.select("date").distinct().orderBy(F.desc("date")).limit(n), "date", "left_semi")


def years(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the most recent n calendar years that occur."""
    recent = panel.select(F.year("date").alias("y")).distinct().orderBy(F.desc("y")).limit(n)
    return panel.withColumn("y", F.year("date")).join(recent, "y", "left_semi").drop("y")


def simple_returns(prices: DataFrame) -> DataFrame:
    out = prices.select("date", "asset", (F.col("price") / F.lag("price").over(by_asset()) - 1).alias("r"))
    return out.filter("r is not null")


def log_returns(prices: DataFrame) -> DataFrame:
    out = prices.select("date", "asset", (F.ln("price") - F.lag(F.ln("price")).over(by_asset())).alias("r"))
    return out.filter("r is not null")


def rebase(prices: DataFrame, base: float = 100.0) -> DataFrame:
    return prices.select("date", "asset", (F.col("price") / F.first("price").over(by_asset()) * base).alias("level"))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """strategy, date, r = sum of w * r over the assets."""
    return returns.join(weights, "asset").groupBy("strategy", "date").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def wide(panel: DataFrame, value: str, assets: Sequence[str]) -> DataFrame:
    return panel.groupBy("date").pivot("asset", list(assets)).agg(F.first(value))


def long(frame: DataFrame, name: str = "asset", value: str = "price") -> DataFrame:
    return frame.unpivot("date", [c for c in frame.columns if c != "date"], name, value)


def outer_align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two (date, value) series side by side on all dates of either."""
    return left.select("date", F.col("value").alias("a")).join(right.select("date", F.col("value").alias("b")), "date", "full_outer")


def common_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("date").intersect(right.select("date"))


def excess(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """strategy, date, r, b and x = r - b on the dates of both."""
    return returns.join(benchmark.select("date", F.col("r").alias("b")), "date").withColumn("x", F.col("r") - F.col("b"))


#: Part of a strategy's name, and its short name; the first that fits counts.
SHORT_NAMES = (
    ("Maximum Sharpe", "Max Sharpe"), ("Maximum Return", "Max Return"), ("Minimum Volatility", "Min Vol"), ("Hierarchical Risk Parity", "HRP"), ("HRP", "HRP"),
    ("Risk Parity", "Risk Parity"), ("Equally Weighted", "Equal"), ("Markowitz", "Markowitz"),
)


def short_name(name: Column, rules: Sequence[tuple[str, str]] = SHORT_NAMES) -> Column:
    """The short name of the first rule whose part the name holds, else its first word."""
    found = F.lit(None).cast("string")
    for part, short in reversed(rules):
        found = F.when(F.contains(name, F.lit(part)), F.lit(short)).otherwise(found)
    return F.coalesce(found, F.split(F.trim(name), " +")[0])


def symbols(text: Column) -> Column:
    """Symbols of a comma or newline separated list: trimmed, upper case, the first of each, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,\n]"), lambda s: F.upper(F.trim(s))), lambda s: s != ""))


def catalog_filter(catalog: DataFrame, query: str) -> DataFrame:
    """Entries (ticker, name) whose ticker or name holds the query, whatever the case."""
    q = F.lit(query.upper())
    return catalog.filter(F.contains(F.upper("ticker"), q) | F.contains(F.upper("name"), q))


def period_end(date: Column, freq: str) -> Column:
    """The calendar end of the period D, W, M, Q or A (weeks end on Sundays)."""
    ends = {
        "D": date,
        "W": F.date_sub(F.next_day(F.date_sub(date, 1), "SUN"), 0),
        "M": F.last_day(date),
        "Q": F.last_day(F.add_months(F.trunc(date, "quarter"), 2)),
        "A": F.last_day(F.add_months(F.trunc(date, "year"), 11)),
    }
    return ends[freq]
