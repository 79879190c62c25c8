"""Series cut into blocks, so that one symbol is many tasks.

Rows are numbered by counting within blocks of time and adding up the blocks before; a row frame of bounded length is then a
window inside a block of rows that has copies of its neighbours' nearest rows (a halo)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER

#: Time that is counted in one task, and rows of a block.
SPAN_MS = 7 * 86_400_000
ROWS = 4096


def block_of(time: str, span: int) -> str:
    """SQL for the block of time that a time lies in (whole blocks before zero too)."""
    return f"({time} - pmod({time}, {span}L)) div {span}L"


def before_block(keys: tuple[str, ...], block: str = "_b") -> WindowSpec:
    """The blocks of a series before each: a window over a table with one row for each block."""
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: tuple[str, ...] = (KEY,), order: str = ORDER, span: int = SPAN_MS) -> DataFrame:
    """Adds pos, the 0-based place in the series."""
    rows = df.withColumn("_b", F.expr(block_of(order, span)))
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    shift = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before_block(keys)), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order))
    return rows.withColumn("_i", place).join(shift, [*keys, "_b"]).withColumn("pos", F.col("_shift") + F.col("_i") - 1).drop("_b", "_i", "_shift")


def with_halo(df: DataFrame, before: int, after: int, rows: int = ROWS) -> DataFrame:
    """Numbered rows in blocks (_block) of `rows` rows, with copies (not _own) of `before` rows ahead of each block and `after` behind it."""
    if max(before, after) > rows:
        raise ValueError(f"a block of {rows} rows is shorter than a frame of {max(before, after)}")
    at, place = F.expr(f"pos div {rows}"), F.col("pos") % rows
    spot = lambda d: F.struct((at + d).alias("_block"), F.lit(d == 0).alias("_own"))
    there = [F.array(spot(0))]
    if before:
        there.append(F.when(place >= rows - before, F.array(spot(1))).otherwise(F.slice(F.array(spot(1)), 1, 0)))
    if after:
        there.append(F.when(place < after, F.array(spot(-1))).otherwise(F.slice(F.array(spot(-1)), 1, 0)))
    return df.withColumn("_at", F.explode(F.concat(*there) if len(there) > 1 else there[0])).select(*df.columns, "_at.*")


def in_blocks(df: DataFrame, compute: Callable[[DataFrame, WindowSpec], DataFrame], before: int, after: int = 0, rows: int | None = None, keys: tuple[str, ...] = (KEY,), order: str = ORDER) -> DataFrame:
    """compute(rows, window) of a whole series, where no frame reaches further than `before` and `after` rows; the window is one block's.

    Rows that have a pos keep it and aren't numbered again."""
    known = "pos" in df.columns
    spread = with_halo(df if known else numbered(df, keys, order), before, after, rows or max(ROWS, before, after))
    out = compute(spread, Window.partitionBy(*keys, "_block").orderBy(order)).where("_own").drop("_block", "_own")
    return out if known else out.drop("pos")


def carried(df: DataFrame, values: dict[str, Column], carry: Callable[[str, WindowSpec], Column], keys: tuple[str, ...], block: str = "_b") -> DataFrame:
    """Adds, for each name, what a series' blocks before hand to each block: an aggregate of each block, and `carry` of it over those before."""
    totals = df.groupBy(*keys, block).agg(*(v.alias(f"_t_{k}") for k, v in values.items()))
    w = before_block(keys, block)
    return df.join(totals.select(*keys, block, *(carry(f"_t_{k}", w).alias(k) for k in values)), [*keys, block])
