"""Purged walk-forward folds over the rows of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEY
from .blocks import numbered


def number_rows(df: DataFrame) -> DataFrame:
    """Adds pos (0-based place in the series) and n_rows."""
    return numbered(df).join(df.groupBy(KEY).agg(F.count("*").alias("n_rows")), KEY)


def check_folds(df: DataFrame, n_splits: int, test_size: int, min_train: int, purge: int) -> None:
    """ValueError if a series is too short for the folds."""
    least = n_splits * test_size + purge + min_train
    short = df.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") < least).limit(1).collect()
    if short:
        raise ValueError(f"{short[0][KEY]}: {short[0]['n']} rows are too few for {n_splits} folds of {test_size}: {least} needed")


def test_rows(df: DataFrame, n_splits: int, test_size: int) -> DataFrame:
    """Test rows with their fold; folds are contiguous and end with the series."""
    first = F.col("n_rows") - n_splits * test_size
    return number_rows(df).where(F.col("pos") >= first).withColumn("fold", F.floor((F.col("pos") - first) / test_size).cast("long"))


def fold_bounds(df: DataFrame, n_splits: int, test_size: int, purge: int) -> DataFrame:
    """(symbol, fold, train_end, test_start, test_end): train is [0, train_end), test [test_start, test_end)."""
    sizes = df.groupBy(KEY).agg(F.count("*").alias("n"))
    start = F.col("n") - (n_splits - F.col("fold")) * test_size
    return sizes.select(KEY, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))).alias("fold")).select(KEY, "fold", (start - purge).alias("train_end"), start.alias("test_start"), (start + test_size).alias("test_end"))


def assign(df: DataFrame, n_splits: int, test_size: int, purge: int) -> DataFrame:
    """Every (row, fold) with role train or test.  Rows are numbered once; folds are a few per series."""
    numbered = number_rows(df).drop("n_rows")
    bounds = fold_bounds(df, n_splits, test_size, purge)
    joined = numbered.join(bounds, KEY)
    role = F.when(F.col("pos") < F.col("train_end"), "train").when((F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_end")), "test")
    return joined.withColumn("role", role).where("role is not null").drop("train_end", "test_start", "test_end")
