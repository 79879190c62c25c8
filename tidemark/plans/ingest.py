"""Ingestion: history into the lake month by month, and recent candles into a keyed table."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import pinned
from ..functions.timeframes import date_ms, month_bounds_ms, month_range, timeframe_ms
from ..operators import candles
from ..sources import lake
from ..sources.exchange import read_exchange

log = logging.getLogger(__name__)


def clean(raw: DataFrame, timeframe: str, now_ms: int) -> DataFrame:
    """Closed candles, the last to arrive of each open time."""
    return candles.closed(candles.keep_last(raw), timeframe, now_ms)


def _report_gaps(df: DataFrame, timeframe: str) -> None:
    for r in candles.gap_ranges(candles.gaps(df, timeframe), timeframe).orderBy("start").limit(20).collect():
        log.warning("%s: %d missing from %d to %d", r["symbol"], r["n"], r["start"], r["end"])


def backfill(spark: SparkSession, client: str, symbol: str, root: str, first: date, last: date, now_ms: int, timeframe: str = "1m", **options) -> int:
    """Fetch the months that the lake doesn't hold completely for the symbol, check them, and write them; rows written.

    Months next to each other are one read, split into tasks by time."""
    step = timeframe_ms(timeframe)
    done = lake.complete_months(spark, root, symbol, step)
    todo = [m for m in month_range(first, last) if m not in done]
    written = 0
    while todo:
        run = [todo.pop(0)]
        while todo and todo[0][0] * 12 + todo[0][1] == run[-1][0] * 12 + run[-1][1] + 1:
            run.append(todo.pop(0))
        since, until = max(month_bounds_ms(*run[0])[0], date_ms(first)), min(month_bounds_ms(*run[-1])[1], now_ms)
        if since >= until:
            continue
        # written once: what is checked is what goes into the lake, and the exchange isn't asked again
        df = pinned(clean(read_exchange(spark, client, symbol, timeframe, since, until, **options), timeframe, now_ms).select("symbol", *candles.CANDLE))
        n = df.count()
        if n:
            candles.validate(df)
            _report_gaps(df, timeframe)
            # the lake keeps the first to arrive
            lake.write_months(df.withColumn("seq", F.lit(0).cast("long")), root)
        else:
            log.warning("no closed candle from %d to %d", since, until)
        written += n
    return written


def incremental(spark: SparkSession, client: str, symbol: str, path: str, now_ms: int, look_back_ms: int = 48 * 3_600_000, timeframe: str = "15m", dry_run: bool = False, **options) -> int:
    """Insert the candles of the look-back that the table at path lacks; rows inserted.  No candle at all is an error.

    They are fetched once; the rows that are checked are those that are written."""
    step = timeframe_ms(timeframe)
    since = (now_ms - look_back_ms) // step * step
    df = pinned(clean(read_exchange(spark, client, symbol, timeframe, since, now_ms, **options), timeframe, now_ms))
    if df.isEmpty():
        raise RuntimeError("the exchange returned no closed candle")
    checked = candles.validate(df.select("symbol", *candles.CANDLE))
    _report_gaps(checked, timeframe)
    if dry_run:
        return 0
    try:
        present = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        present = df.limit(0)
    # only the look-back's part of the table can hold what is new
    near = present.where((F.col("symbol") == symbol) & (F.col("timestamp") >= since))
    new = pinned(candles.insert_if_absent(df, near).select("symbol", *candles.CANDLE).withColumn("ingested_at", F.current_timestamp()))
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n
