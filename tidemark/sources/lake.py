"""The lake of candles: Parquet by symbol, year and month; a symbol's months are overwritten as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeframes import month_bounds_ms
from ..operators.candles import keep_first
from .exchange import SCHEMA

PARTS = ["symbol", "year", "month"]


def _parts(df: DataFrame) -> DataFrame:
    at = F.timestamp_millis("timestamp")
    return df.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM")})


def write_months(df: DataFrame, root: str, compression: str = "zstd") -> None:
    """Write candles into symbol=S/year=YYYY/month=MM; the months of the symbols they cover are replaced when all is written,
    others, and other symbols' months, stay.  A task holds one symbol's month."""
    out = _parts(df).repartition(*PARTS).sortWithinPartitions(*PARTS, "timestamp")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*PARTS).parquet(root)


def _scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, year int, month int").parquet(root)


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """All candles, one per symbol and open time: the first to arrive."""
    return keep_first(_scan(spark, root).drop("year", "month"))


def read_month(spark: SparkSession, root: str, year: int, month: int, symbol: str | None = None) -> DataFrame:
    """One month, of one symbol or of all; other folders are never listed into the scan."""
    rows = _scan(spark, root).where((F.col("year") == year) & (F.col("month") == month))
    return (rows if symbol is None else rows.where(F.col("symbol") == symbol)).drop("year", "month")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def months(spark: SparkSession, root: str, symbol: str | None = None) -> set[tuple[int, int]]:
    """(year, month) of the folders, of one symbol or of any, that hold a file; names that aren't numbers are skipped; no lake, none."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return set()
    name = "*" if symbol is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(symbol)
    out = set()
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, f"symbol={name}/year=*/month=*/*.parquet")) or []:
        month_dir = status.getPath().getParent()
        year, month = month_dir.getParent().getName()[5:], month_dir.getName()[6:]
        if year.isdigit() and month.isdigit():
            out.add((int(year), int(month)))
    return out


def last_timestamp(df: DataFrame) -> int | None:
    """Largest open time (reads that column only)."""
    return df.agg(F.max("timestamp").alias("t")).first().t


def complete_months(spark: SparkSession, root: str, symbol: str, step_ms: int) -> set[tuple[int, int]]:
    """The months that hold their last candle for the symbol: one listing and one aggregate of open times, however many months."""
    if not months(spark, root, symbol):
        return set()
    last = _scan(spark, root).where(F.col("symbol") == symbol).groupBy("year", "month").agg(F.max("timestamp").alias("t"))
    return {(r.year, r.month) for r in last.collect() if r.t is not None and r.t >= month_bounds_ms(r.year, r.month)[1] - step_ms}


def is_complete(spark: SparkSession, root: str, symbol: str, year: int, month: int, step_ms: int) -> bool:
    """Whether the symbol's folder of the month holds the month's last candle."""
    return (year, month) in complete_months(spark, root, symbol, step_ms)
