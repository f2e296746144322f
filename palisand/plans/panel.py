"""Price panels, in long form: date, asset, price."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisand.operators import panel as ops
from palisand.storage import staged

_STORED: ContextVar[dict | None] = ContextVar("stored", default=None)


@contextmanager
def stored_panels() -> Iterator[None]:
    """While a query is put together, each panel it uses is made once, stored, and read from there."""
    token = _STORED.set({})
    try:
        yield
    finally:
        _STORED.reset(token)


def once(name: str, make: Callable[[], DataFrame], store: bool = True) -> DataFrame:
    """make()'s table, the same one whenever the query asks again."""
    known = _STORED.get()
    if known is None:
        known = {}
    if name not in known:
        known[name] = staged(make(), name) if store else make()
    return known[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def region_prices(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """Average unit price by region and week (or day, month) on the dates that all regions have.

    Sales are summed per supplier before the three small joins, so one shuffle carries
    (suppliers x dates) rows, not sales.  The panel is stored: sales are scanned once, whatever is asked of it."""
    prices = once(f"prices-{bucket}", lambda: _average_prices(spark, sf_dir, bucket))
    return once(f"complete-{bucket}", lambda: ops.complete_dates(prices), store=False)


def _average_prices(spark: SparkSession, sf_dir: str, bucket: str) -> DataFrame:
    sales = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.date_trunc(bucket, "l_shipdate").cast("date").alias("date"), "l_suppkey")
        .agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("quantity"))
    )
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("asset"))
    )
    return sales.join(place, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("date", "asset").agg((F.sum("value") / F.sum("quantity")).alias("price"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two portfolios over the regions: strategy, asset, w; equal weights, and weights in proportion to the place by name."""
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("asset"))
    whole = Window.partitionBy()  # a row for each region
    place = F.row_number().over(Window.orderBy("asset"))
    held = names.select("asset", F.count("*").over(whole).alias("n"), place.alias("k"))
    both = F.array(F.struct(F.lit("equal").alias("strategy"), (1 / F.col("n")).alias("w")), F.struct(F.lit("tilt").alias("strategy"), (F.col("k") / (F.col("n") * (F.col("n") + 1) / 2)).alias("w")))
    return held.select("asset", F.explode(both).alias("x")).select("x.strategy", "asset", "x.w")
