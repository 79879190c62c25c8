"""Scores of probability forecasts: per fold, over folds, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import carried

EPS = 2.220446049250313e-16
METRICS = ("auc", "log_loss", "brier", "accuracy", "acc_lift_vs_prior", "mean_p_up", "realized_up_rate")


#: Ranges of p that are counted first, so that no series of forecasts is ranked in one task.
RANGES = 4096


def auc(pred: DataFrame, keys: tuple[str, ...] = ("symbol", "model", "fold")) -> DataFrame:
    """(keys, auc): chance that a positive has the higher p than a negative, ties counting half; null if there is one class.

    Equal forecasts are counted together; then ranges of p hand on how many negatives lie below them, and only those inside a range are ordered."""
    y = F.col("y")
    ties = pred.groupBy(*keys, F.col("p_up").alias("_v")).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    ties = ties.withColumn("_b", F.floor(F.col("_v") * RANGES))
    ties = carried(ties, {"_below": F.sum("_neg")}, lambda t, w: F.coalesce(F.sum(t).over(w), F.lit(0)), keys)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.col("_below") + F.coalesce(F.sum("_neg").over(inside), F.lit(0)) + F.col("_neg") / 2
    won = ties.withColumn("_won", F.col("_pos") * beaten).groupBy(*keys).agg(F.sum("_won").alias("_won"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    return won.select(*keys, F.try_divide(F.col("_won"), (F.col("_pos") * F.col("_neg")).cast("double")).alias("auc"))


def fold_metrics(pred: DataFrame, keys: tuple[str, ...] = ("symbol", "model", "fold")) -> DataFrame:
    """auc (null if a fold has one class), log_loss, brier, accuracy, its lift over the best constant, mean p, rate."""
    y, p = F.col("y"), F.col("p_up")
    clipped = F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))
    accuracy, rate = F.avg(((p >= 0.5).cast("int") == y).cast("double")), F.avg(y.cast("double"))
    sums = pred.groupBy(*keys).agg(
        (-F.avg(F.when(y == 1, F.log(clipped)).otherwise(F.log(1 - clipped)))).alias("log_loss"),
        F.avg(F.pow(p - y, 2)).alias("brier"),
        accuracy.alias("accuracy"),
        (accuracy - F.greatest(rate, 1 - rate)).alias("acc_lift_vs_prior"),
        F.avg(p).alias("mean_p_up"),
        rate.alias("realized_up_rate"),
    )
    return auc(pred, keys).join(sums, list(keys))


def over_folds(metrics: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), names: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and population deviation of every metric over folds, nulls left out: one row per metric."""
    long = metrics.select(*keys, F.expr(f"stack({len(names)}, {', '.join(f'''\"{n}\", cast({n} as double)''' for n in names)}) as (metric, value)"))
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def bin_edges(n: int) -> list[float]:
    """Edges i * (1 / n) as floating point gives them, the last one 1."""
    step = 1.0 / n
    return [i * step for i in range(n)] + [1.0]


def calibration(pred: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), bins: int = 10) -> DataFrame:
    """Realised rate per bin of p; an edge belongs to the bin it opens, 1 to the last; empty bins are left out."""
    edges = bin_edges(bins)
    at: Column = F.lit(0)
    for e in edges[1:-1]:
        at = at + (F.col("p_up") >= e).cast("int")
    lows = F.array(*map(F.lit, edges))
    binned = pred.withColumn("bin", at)
    out = binned.groupBy(*keys, "bin").agg(F.avg("p_up").alias("mean_p_up"), F.avg(F.col("y").cast("double")).alias("realized_up_rate"), F.count("*").alias("count"))
    return out.select(*keys, F.get(lows, F.col("bin")).alias("bin_low"), F.get(lows, F.col("bin") + 1).alias("bin_high"), "mean_p_up", "realized_up_rate", "count")
