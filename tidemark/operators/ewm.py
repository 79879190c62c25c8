"""Exponentially weighted means and deviations without a sequential pass over a series.

A decayed sum D(t) = sum of q**(t - j) * x(j) is split into blocks short enough that q**-length is
harmless: inside a block it is a scaled running sum.  What a block is handed is a decayed sum over the blocks before it, of their last
values: the same problem with far fewer rows, until a block forgets all but its nearest neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER
from .blocks import numbered

#: Decay from one block to the next below which only the nearest blocks count.
NEAR = 1e-4


def decayed_sums(df: DataFrame, columns: dict[str, Column], q: float, keys: tuple[str, ...] = (KEY,), order: str = ORDER) -> DataFrame:
    """Adds, for each name, the decayed sum of its column (never null) in time order, and n, the row's number (from pos, if the rows have it)."""
    block = max(1, min(256, int(27 / -math.log(q)))) if 0 < q < 1 else 1
    rows = (df if "pos" in df.columns else numbered(df, keys, order)).withColumn("n", F.col("pos") + 1).withColumns({"_b": F.expr(f"pos div {block}"), "_p": F.col("pos") % block}).drop("pos")
    run = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s_{k}": F.sum(c * F.pow(F.lit(q), -F.col("_p"))).over(run) * F.pow(F.lit(q), F.col("_p")) for k, c in columns.items()})
    ends = rows.groupBy(*keys, F.col("_b").alias("_o")).agg(*(F.max_by(f"_s_{k}", "_p").alias(f"_e_{k}") for k in columns))
    # only the last block can be short, and it hands on nothing
    carried = _carried(ends, list(columns), q**block, keys).withColumnRenamed("_o", "_b")
    out = rows.join(carried, [*keys, "_b"])
    return out.withColumns({k: F.col(f"_s_{k}") + F.col(f"_c_{k}") * F.pow(F.lit(q), F.col("_p") + 1) for k in columns}).drop("_b", "_p", *(f"_s_{k}" for k in columns), *(f"_c_{k}" for k in columns))


def _carried(ends: DataFrame, names: list[str], q: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, _o, _c_<name>): decayed sums of _e_<name> over the blocks before each block."""
    by = Window.partitionBy(*keys).orderBy("_o")
    if q < NEAR:
        # q ** 4 is beyond the precision of a double
        back = lambda k: sum((F.coalesce(F.lag(f"_e_{k}", i + 1).over(by), F.lit(0.0)) * q**i for i in range(1, 4)), F.coalesce(F.lag(f"_e_{k}", 1).over(by), F.lit(0.0)))
        return ends.select(*keys, "_o", *(back(k).alias(f"_c_{k}") for k in names))
    sums = decayed_sums(ends, {f"_d_{k}": F.col(f"_e_{k}") for k in names}, q, keys, "_o")
    return sums.select(*keys, "_o", *(F.coalesce(F.lag(f"_d_{k}", 1).over(by), F.lit(0.0)).alias(f"_c_{k}") for k in names))


def ewm_means(df: DataFrame, columns: dict[str, str], alpha: float, min_periods: int) -> DataFrame:
    """y(1) = x(1), y(t) = (1 - alpha) y(t - 1) + alpha x(t) over the rows where the columns aren't
    null (all or none are); null until there are min_periods."""
    first = next(iter(columns.values()))
    rows = df.where(F.col(first).isNotNull())
    # the first value counts whole
    weight = F.when(F.col("_p") + F.col("_b") == 0, 1.0).otherwise(alpha)
    sums = decayed_sums(rows, {k: weight * F.col(c) for k, c in columns.items()}, 1 - alpha)
    return sums.select(KEY, ORDER, *(F.when(F.col("n") >= min_periods, F.col(k)).alias(k) for k in columns))


def ewm_std(df: DataFrame, column: str, name: str, span: int) -> DataFrame:
    """Bias-corrected deviation under weights q**age, q = 1 - 2 / (span + 1); null before `span` values."""
    q = 1 - 2 / (span + 1)
    x = F.col(column)
    sums = decayed_sums(df.where(x.isNotNull()), {"_m1": x, "_m2": x * x}, q)
    n = F.col("n")
    s, s2 = (1 - F.pow(F.lit(q), n)) / (1 - q), (1 - F.pow(F.lit(q * q), n)) / (1 - q * q)
    spread = F.greatest(F.col("_m2") / s - F.pow(F.col("_m1") / s, 2), F.lit(0.0))
    return sums.select(KEY, ORDER, F.when(n >= span, F.sqrt(F.try_divide(spread * s * s, s * s - s2))).alias(name))
