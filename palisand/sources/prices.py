"""Reading price files into panels (date, asset, price) and writing result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisand.operators import panel
from palisand.sources.workbook import wide_workbook

#: Files that a directory is searched for, in this order.
PROBED = ("prices_data.parquet", "prices_data.csv", "prices_data.xlsx")
LEAST_DATES = 30


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV file: its first column holds dates, each other one an asset's prices (empty: none)."""
    frame = spark.read.csv(path, header=True)
    first, *assets = frame.columns
    # each asset becomes a struct, so no column of the file can clash with another
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), F.col(f"`{a}`").cast("double").alias("price")) for a in assets]))
    return frame.select(F.to_date(F.substring(F.col(f"`{first}`"), 1, 10)).alias("date"), rows.alias("x")).select("date", "x.asset", "x.price").filter("price is not null")


def long_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("date").cast("date").alias("date"), "asset", "price")


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file systems, so any store that Spark reads will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Prices from a file, or from the first of PROBED in a directory.  Pickle files are refused: they can run code."""
    if path.endswith((".pkl", ".pickle")):
        raise ValueError("pickle files aren't read; write the panel as Parquet")
    if path.endswith(".xlsx"):
        return wide_workbook(spark, path)
    if path.endswith(".xls"):
        raise ValueError("workbooks of the old binary format aren't read; save it as .xlsx, CSV or Parquet")
    if path.endswith(".csv"):
        return wide_csv(spark, path)
    if path.endswith(".parquet"):
        return long_parquet(spark, path)
    for name in PROBED:
        if exists(spark, f"{path}/{name}"):
            return load(spark, f"{path}/{name}")
    raise FileNotFoundError(f"none of {', '.join(PROBED)} in {path}")


def validated(prices: DataFrame, assets: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The complete dates of the wanted assets and range; ValueError for fewer than two assets or LEAST_DATES dates."""
    df = panel.select_assets(prices, assets) if assets else prices
    df = panel.date_range(df, start or "0001-01-01", end or "9999-12-31")
    df = panel.complete_dates(df)
    found = df.agg(F.count_distinct("asset").alias("a"), F.count_distinct("date").alias("d")).first()
    if found["a"] < 2 or found["d"] < LEAST_DATES:
        raise ValueError(f"{found['a']} assets on {found['d']} dates; at least 2 on {LEAST_DATES} are needed")
    return df


def preferred_close(quotes: DataFrame) -> DataFrame:
    """date, asset, price from downloaded quotes: close where there is one, else the adjusted close; assets of fewer than LEAST_DATES quotes are left out."""
    df = quotes.select("date", "asset", F.coalesce("close", "adj_close").alias("price")).filter("price is not null")
    return df.join(df.groupBy("asset").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DATES), "asset", "left_semi")


def benchmark(prices: DataFrame, asset: str) -> DataFrame:
    """date, r: the simple returns of one asset."""
    return panel.simple_returns(prices.filter(F.col("asset") == asset)).select("date", "r")


def default_end() -> Column:
    """The last date that is asked for where none is given: yesterday."""
    return F.date_sub(F.current_date(), 1)


def export(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """One folder for each table (prices, returns, weights, metrics, frontier)."""
    for name, df in tables.items():
        df.write.format(form).option("header", True).mode("errorifexists").save(f"{folder}/{name}")


def to_json(weights: DataFrame, metrics: DataFrame) -> DataFrame:
    """strategy, js: metadata, weights over 0.1 % in percent to two digits, and three metrics."""
    percent = lambda c: F.bround(F.col(c) * 100, 2)
    shown = weights.filter("w > 0.001").groupBy("strategy").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", percent("w").alias("v"))))).alias("weights"))
    figures: Column = F.struct(percent("ann_return").alias("return"), percent("ann_vol").alias("volatility"), F.bround("sharpe", 3).alias("sharpe"))
    return shown.join(metrics, "strategy").select("strategy", F.to_json(F.struct("strategy", "weights", figures.alias("metrics"))).alias("js"))
