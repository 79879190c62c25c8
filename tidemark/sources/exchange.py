"""Candles from an exchange's paged API, as a Spark data source with one partition per stretch of time.

A client has fetch(symbol, timeframe, since_ms, limit) -> rows [ms, open, high, low, close, volume] with times
from since_ms on, and raises NetworkError for what is worth another try.  The data source names it by
"module:factory", so that each task makes its own."""

from __future__ import annotations

import functools
import importlib
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.timeframes import timeframe_ms

SCHEMA = "symbol string, timestamp long, open double, high double, low double, close double, volume double, seq long"


class NetworkError(Exception):
    """A failure that may pass: connection, rate limit, overload."""


def with_retries(call: Callable[[], list], attempts: int = 6, base_s: float = 1.0, cap_s: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """The call's result; after a NetworkError, again after twice the last wait, give or take half.  The last error is raised."""
    wait = base_s
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except NetworkError:
            if not left:
                raise
            sleep(min(cap_s, wait) * random.uniform(0.5, 1.5))
            wait *= 2
    raise ValueError("no attempts")


def pages(client, symbol: str, timeframe: str, since_ms: int, until_ms: int, limit: int = 1000, **retry) -> Iterator[list]:
    """Rows with since_ms <= time < until_ms, in windows of one page each; a window whose page ends early is asked for again from behind
    its last row, until that brings nothing."""
    step = timeframe_ms(timeframe)
    for start in range(since_ms, until_ms, limit * step):
        end, rows = min(start + limit * step, until_ms), [[start - step]]
        while rows and rows[-1][0] + step < end:
            ask = int(rows[-1][0]) + step
            page = with_retries(functools.partial(client.fetch, symbol, timeframe, ask, limit), **retry)
            rows = [row for row in page if ask <= row[0] < end]
            yield from rows


class Stretch(InputPartition):
    def __init__(self, since_ms: int, until_ms: int):
        self.since_ms, self.until_ms = since_ms, until_ms


class ExchangeSource(DataSource):
    """spark.read.format("exchange") with client, symbol, timeframe, since, until (ms), page_limit, pages_per_task, base_url, attempts, base_s, cap_s."""

    @classmethod
    def name(cls) -> str:
        return "exchange"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ExchangeReader(dict(self.options))


class ExchangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        span = timeframe_ms(self.o["timeframe"]) * int(self.o.get("page_limit", 1000)) * int(self.o.get("pages_per_task", 50))
        since, until = int(self.o["since"]), int(self.o["until"])
        return [Stretch(a, min(a + span, until)) for a in range(since, until, span)] or [Stretch(since, since)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        module, factory = self.o["client"].split(":")
        client = getattr(importlib.import_module(module), factory)(*([self.o["base_url"]] if "base_url" in self.o else []))
        retry = {k: kind(self.o[k]) for k, kind in (("attempts", int), ("base_s", float), ("cap_s", float)) if k in self.o}
        rows = pages(client, self.o["symbol"], self.o["timeframe"], part.since_ms, part.until_ms, int(self.o.get("page_limit", 1000)), **retry)
        for n, r in enumerate(rows):
            yield (self.o["symbol"], int(r[0]), *(float(x) for x in r[1:6]), part.since_ms + n)


def from_rows(spark, rows: list[list[float]], symbol: str) -> DataFrame:
    """Positional API rows as a typed frame (also of none), numbered as they arrived."""
    typed = [(symbol, int(r[0]), *(float(x) for x in r[1:6]), n) for n, r in enumerate(rows)]
    return spark.createDataFrame(typed, SCHEMA)


def read_exchange(spark, client: str, symbol: str, timeframe: str, since_ms: int, until_ms: int, **options) -> DataFrame:
    """Candles of a half-open time range."""
    spark.dataSource.register(ExchangeSource)
    reader = spark.read.format("exchange").options(client=client, symbol=symbol, timeframe=timeframe, since=since_ms, until=until_ms, **options)
    return reader.load().where((F.col("timestamp") >= since_ms) & (F.col("timestamp") < until_ms))
