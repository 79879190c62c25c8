"""One position at a time: of trades that each know their end, those that are taken.

A trade is taken if it begins at or after the end of the last one taken.  What a block of time does to the time from which a
position is free is a function of few values: the ends of earlier trades that reach into the block.  Blocks compute
that function for all of them at once; functions compose, over blocks of blocks and then over a series; and when each
block knows when its position is really free, it picks its trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_of

#: Blocks whose functions are composed in one row.
FAN = 512


def _through(at: str, free: str) -> str:
    """The time from which a position is free after block `at`, if it is free from `free` before: SQL over (start, states, outs)."""
    return f"if({free} <= {at}.start, {at}.outs[0], {at}.outs[cast(array_position({at}.states, {free}) as int) - 1])"


def _walk(blocks: str, first: str) -> str:
    """(k, free) of consecutive blocks, from the time at which the first is entered."""
    kind = "array<struct<k: bigint, free: bigint>>"
    return f"""aggregate({blocks}, named_struct('free', {first}, 'seen', cast(array() as {kind})),
        (a, b) -> named_struct('free', {_through('b', 'a.free')}, 'seen', concat(a.seen, array(named_struct('k', b.k, 'free', a.free)))), a -> a.seen)"""


def one_at_a_time(trades: DataFrame, keys: tuple[str, ...], span: int, entry: str = "entry_ts", leave: str = "exit_ts") -> DataFrame:
    """The trades of each series that a single position takes; of those with one beginning, the one that ends first is tried first.

    span: time of a block.  A row holds the trades of one block, or the functions of FAN blocks; a trade longer than a block
    is a state of each block that it reaches into."""
    rest = [c for c in trades.columns if c not in keys]
    rows = trades.withColumn("_b", F.expr(block_of(entry, span)))
    line = F.array_sort(F.collect_list(F.struct(F.col(entry).alias("e"), F.col(leave).alias("l"), F.struct(*rest).alias("row"))))
    base = rows.groupBy(*keys, "_b").agg(line.alias("line"))
    reach = rows.select(*keys, leave, F.explode(F.sequence(F.col("_b"), F.expr(f"greatest(_b, {block_of(f'({leave} - 1)', span)})"))).alias("_in"), "_b").where("_in > _b")
    states = reach.groupBy(*keys, F.col("_in").alias("_b")).agg(F.collect_set(leave).alias("_late"))
    start = F.expr(f"_b * {span}L")
    blocks = base.select(*keys, "_b", F.transform("line", lambda t: F.struct(t["e"].alias("e"), t["l"].alias("l"))).alias("line")).join(states, [*keys, "_b"], "left")
    blocks = blocks.select(*keys, "_b", start.alias("start"), F.concat(F.array(start), F.coalesce("_late", F.array().cast("array<bigint>"))).alias("states"), "line")
    blocks = blocks.withColumn("outs", F.expr("aggregate(line, states, (a, t) -> transform(a, f -> if(t.e >= f, t.l, f)))"))
    above = blocks.groupBy(*keys, F.expr(block_of("_b", FAN)).alias("_s")).agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("k"), "start", "states", "outs"))).alias("blocks"))
    function = above.select(*keys, F.col("_s").alias("k"), F.expr("blocks[0].start").alias("start"), F.expr("blocks[0].states").alias("states"), F.expr(f"aggregate(blocks, blocks[0].states, (a, b) -> transform(a, f -> {_through('b', 'f')}))").alias("outs"))
    series = function.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "start", "states", "outs"))).alias("blocks"))
    entered = series.select(*keys, F.explode(F.expr(_walk("blocks", "blocks[0].start"))).alias("at")).select(*keys, F.col("at.k").alias("_s"), F.col("at.free").alias("_free"))
    entered = above.join(entered, [*keys, "_s"]).select(*keys, F.explode(F.expr(_walk("blocks", "_free"))).alias("at")).select(*keys, F.col("at.k").alias("_b"), F.col("at.free").alias("_free"))
    taken = F.expr("aggregate(line, named_struct('free', _free, 'rows', slice(line, 1, 0)), (a, t) -> if(t.e >= a.free, named_struct('free', t.l, 'rows', concat(a.rows, array(t))), a), a -> a.rows)")
    return base.join(entered, [*keys, "_b"]).select(*keys, F.explode(taken).alias("t")).select(*keys, "t.row.*").select(*trades.columns)
