"""Candles: duplicates, closing, bars, gaps, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER, series
from ..functions.timeframes import bucket, timeframe_ms

PRICES = ("open", "high", "low", "close")
CANDLE = (ORDER, *PRICES, "volume")


def _one_per_time(df: DataFrame, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in (KEY, ORDER)]
    # picked by a scalar key, so that the aggregate stays a hash aggregate
    return df.groupBy(KEY, ORDER).agg(*(pick(c, "seq").alias(c) for c in rest)).select(*df.columns)


def keep_last(df: DataFrame) -> DataFrame:
    """Of candles with one open time, the one that arrived last (largest seq)."""
    return _one_per_time(df, F.max_by)


def keep_first(df: DataFrame) -> DataFrame:
    """Of candles with one open time, the one that came first (least seq)."""
    return _one_per_time(df, F.min_by)


def closed(df: DataFrame, timeframe: str, now_ms: int) -> DataFrame:
    """Candles that have closed; one that closes right now has."""
    return df.where(F.col(ORDER) + timeframe_ms(timeframe) <= now_ms)


def within(df: DataFrame, since_ms: int, until_ms: int) -> DataFrame:
    """Half-open time range."""
    return df.where((F.col(ORDER) >= since_ms) & (F.col(ORDER) < until_ms))


def to_bars(df: DataFrame, timeframe: str, min_candles: int = 1) -> DataFrame:
    """Bars of a coarser timeframe from distinct candles; those of fewer than min_candles are left out."""
    bars = df.groupBy(KEY, bucket(F.col(ORDER), timeframe).alias("_open")).agg(
        F.min_by("open", ORDER).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ORDER).alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("n_candles"),
    )
    return bars.where(F.col("n_candles") >= min_candles).withColumnRenamed("_open", ORDER)


def gaps(df: DataFrame, timeframe: str) -> DataFrame:
    """Open times that are missing between each series' first and last (off-grid times fill nothing)."""
    tf = timeframe_ms(timeframe)
    times = df.select(KEY, ORDER).distinct()
    first = Window.partitionBy(KEY)
    # on the grid that the first time sets, gaps lie between neighbours
    on_grid = times.withColumn("_first", F.min(ORDER).over(first)).withColumn("_last", F.max(ORDER).over(first)).where((F.col(ORDER) - F.col("_first")) % tf == 0)
    ahead = F.coalesce(F.lead(ORDER).over(series()), F.col("_last") + 1)
    missing = on_grid.withColumn("_next", ahead).where(F.col("_next") - F.col(ORDER) > tf)
    return missing.select(KEY, F.explode(F.sequence(F.col(ORDER) + tf, F.col("_next") - 1, F.lit(tf))).alias(ORDER))


def gap_ranges(missing: DataFrame, timeframe: str) -> DataFrame:
    """Runs of neighbouring missing times: symbol, start, end, n."""
    tf = timeframe_ms(timeframe)
    new = F.coalesce((F.col(ORDER) - F.lag(ORDER).over(series()) > tf).cast("int"), F.lit(1))
    runs = missing.withColumn("_new", new).withColumn("_run", F.sum("_new").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(KEY, "_run").agg(F.min(ORDER).alias("start"), F.max(ORDER).alias("end"), F.count("*").alias("n")).drop("_run")


#: Name of each check and what a good row satisfies.
CHECKS = {
    "timestamp_positive": "timestamp is not null and timestamp > 0",
    "open_positive": "open is not null and open > 0",
    "high_positive": "high is not null and high > 0",
    "low_positive": "low is not null and low > 0",
    "close_positive": "close is not null and close > 0",
    "volume_not_negative": "volume is not null and volume >= 0",
    "low_below_body": "low <= least(open, close)",
    "high_above_body": "high >= greatest(open, close)",
}


def check_counts(df: DataFrame) -> DataFrame:
    """One row per check with how many rows fail it; timestamp_unique counts surplus rows."""
    wrong = [F.count_if(~F.coalesce(F.expr(good), F.lit(False))).alias(name) for name, good in CHECKS.items()]
    per_time = df.groupBy(KEY, ORDER).agg(F.count("*").alias("_n"), *wrong)
    names = [*CHECKS, "timestamp_unique"]
    one = per_time.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in CHECKS), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("timestamp_unique"))
    return one.select(F.expr(f"stack({len(names)}, {', '.join(f'''\"{n}\", cast({n} as bigint)''' for n in names)}) as (check, failures)"))


def violations(df: DataFrame) -> DataFrame:
    """Every failed row check: symbol, timestamp, check."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(F.expr(good), F.lit(False)), F.lit(name)) for name, good in CHECKS.items())), lambda x: x.isNotNull())
    return df.select(KEY, ORDER, F.explode(failed).alias("check"))


def validate(df: DataFrame) -> DataFrame:
    """The frame itself, or ValueError that names every failed check; extra or missing columns fail as well."""
    wrong = set(df.columns) ^ {KEY, *CANDLE}
    if wrong:
        raise ValueError(f"columns: {sorted(wrong)}")
    failed = {r["check"]: r["failures"] for r in check_counts(df).where("failures > 0").collect()}
    if failed:
        raise ValueError(f"invalid candles: {failed}")
    return df


def insert_if_absent(new: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of new whose key isn't present yet, one for each key (the last to arrive)."""
    return keep_last(new).join(present.select(KEY, ORDER), [KEY, ORDER], "left_anti")


def month_completeness(df: DataFrame, timeframe: str) -> DataFrame:
    """Per month: its last open time and whether that is the month's last one."""
    day = F.timestamp_millis(F.col(ORDER))
    months = df.groupBy(KEY, F.year(day).alias("year"), F.month(day).alias("month")).agg(F.max(ORDER).alias("last_timestamp"), F.count("*").alias("n_candles"))
    end = F.unix_millis(F.add_months(F.make_date("year", "month", F.lit(1)), 1).cast("timestamp"))
    return months.withColumn("complete", F.col("last_timestamp") >= end - timeframe_ms(timeframe))
