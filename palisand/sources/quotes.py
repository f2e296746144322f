"""A Spark data source of daily quotes behind a URL: one request, and one task, for each symbol.

    spark.dataSource.register(quotes.QuoteSource)
    spark.read.format("quotes").option("symbols", "AAA,BBB").option("url", "https://.../{symbol}.csv?from={start}&to={end}").load()

An answer is CSV text whose first column holds dates.  The price is the column Close, else Adj Close, else
the first whose name holds Close.  A symbol with fewer than LEAST_DATES prices has no rows; one whose request or
answer fails has none either, unless the option on_error is "fail".  The format quote_status, with the same options, tells for each symbol
how many prices were found and what failed.  Only URLs of the option schemes (default "https,http") are followed.
"""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Iterator
from datetime import date
from urllib.parse import quote, urlsplit
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palisand.sources.prices import LEAST_DATES


def price_column(names: list[str]) -> int:
    """Where the price stands; ValueError without such a column."""
    for name in ("Close", "Adj Close", *(n for n in names if "Close" in n)):
        if name in names:
            return names.index(name)
    raise ValueError("no column of closing prices")


def parsed(text: str) -> list[tuple[date, float]]:
    """(date, price) of an answer's rows that have a price."""
    head, *rows = csv.reader(io.StringIO(text))
    at, out = price_column(head), []
    for row in rows:
        price = float(row[at]) if len(row) > at and row[at].strip() not in ("", "null") else math.nan
        if math.isfinite(price):
            out.append((date.fromisoformat(row[0][:10]), price))
    return out


class _Symbol(InputPartition):
    def __init__(self, symbol: str) -> None:
        super().__init__(symbol)
        self.symbol = symbol


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        if not options.get("symbols") or "{symbol}" not in options.get("url", ""):
            raise ValueError("the options symbols, and url with {symbol}, are needed")
        if (scheme := urlsplit(options["url"]).scheme) not in options.get("schemes", "https,http").split(","):
            raise ValueError(f"URLs of {scheme} aren't followed")

    def partitions(self) -> list[_Symbol]:
        return [_Symbol(s) for s in dict.fromkeys(x.strip().upper() for x in self.options["symbols"].split(",")) if s]

    def found(self, symbol: str) -> tuple[list[tuple[date, float]], str | None]:
        """A symbol's prices, or what failed."""
        o = self.options
        url = o["url"].format(symbol=quote(symbol), start=o.get("start", ""), end=o.get("end", ""))
        try:
            with urlopen(url, timeout=float(o.get("timeout", 30))) as answer:
                return parsed(answer.read().decode()), None
        except (OSError, ValueError) as e:
            if o.get("on_error") == "fail":
                raise
            return [], str(e) or type(e).__name__

    def read(self, partition: _Symbol) -> Iterator[tuple]:
        found, _ = self.found(partition.symbol)
        if len(found) >= LEAST_DATES:
            yield from ((day, partition.symbol, price) for day, price in found)


class StatusReader(QuoteReader):
    def read(self, partition: _Symbol) -> Iterator[tuple]:
        found, error = self.found(partition.symbol)
        yield partition.symbol, len(found), error or (None if len(found) >= LEAST_DATES else f"fewer than {LEAST_DATES} prices")


class QuoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return "date date, asset string, price double"

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(dict(self.options))


class QuoteStatus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quote_status"

    def schema(self) -> str:
        return "asset string, n int, error string"

    def reader(self, schema) -> StatusReader:
        return StatusReader(dict(self.options))
