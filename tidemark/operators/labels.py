"""Targets that look ahead: next bar, momentum side, triple barrier."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER
from .blocks import ROWS, in_blocks, numbered, with_halo
from .ewm import ewm_std


def next_bar(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """y: whether the next close is higher (equal: 0); ret_next: its simple return; null on the last bar."""

    def ahead(df: DataFrame, w: WindowSpec) -> DataFrame:
        then = F.lead("close").over(w)
        return df.withColumns({"y": F.when(then.isNotNull(), (then > F.col("close")).cast("long")), "ret_next": then / F.col("close") - 1})

    return in_blocks(bars, ahead, 0, 1, rows)


def ewma_volatility(bars: DataFrame, span: int, rows: int | None = None) -> DataFrame:
    """Adds sigma, the exponentially weighted deviation of log returns."""
    known = bars.select(KEY, ORDER, "close", "pos") if "pos" in bars.columns else numbered(bars.select(KEY, ORDER, "close"))
    r = in_blocks(known, lambda df, w: df.withColumn("_r", F.log(F.col("close") / F.lag("close").over(w))), 1, rows=rows)
    return bars.join(ewm_std(r.select(KEY, ORDER, "_r", (F.col("pos") - 1).alias("pos")), "_r", "sigma", span), [KEY, ORDER], "left")


def momentum_side(bars: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """Adds side: the sign of the return over k bars, null in the warm-up."""
    return in_blocks(bars, lambda df, w: df.withColumn("side", F.signum(F.log(F.col("close") / F.lag("close", k).over(w))).cast("long")), k, rows=rows)


def _levels(values: str, agg: str, top: int) -> str:
    """SQL for a sparse table: level j holds the extreme of the 2**j values from each place on (of what is left at the end)."""
    return f"""aggregate(sequence(1, {top}), array({values}), (a, j) -> concat(a, array(transform(a[j - 1], (v, i) -> {agg}(v, coalesce(get(a[j - 1], i + shiftleft(1, j - 1)), v))))))""" if top else f"array({values})"


def triple_barrier(bars: DataFrame, up: float, down: float, max_holding: int, sided: bool = False, rows: int = ROWS) -> DataFrame:
    """Adds label, ret_trade and holding_bars from bars with sigma (and side).

    The first of the next max_holding bars to touch a barrier decides; if one bar touches both, the
    stop-loss does; if none does, the sign of the return to the last. No label without a positive sigma, a side, or
    max_holding bars to come.

    A row holds a block of bars and max_holding more, with tables of the highest high and lowest low of 1, 2, 4, ... bars; each
    bar finds its first touch by descending them, so a long holding costs its logarithm."""
    close, sigma = F.col("close"), F.col("sigma")
    side = F.col("side") if sided else F.lit(1)
    df = bars.withColumns({"_top": close * (1 + sigma * F.when(side < 0, down).otherwise(up)), "_bottom": close * (1 - sigma * F.when(side < 0, up).otherwise(down))})
    spread = with_halo(df if "pos" in df.columns else numbered(df), 0, max_holding, max(rows, max_holding))
    kept = F.when(F.col("_own"), F.struct(*bars.columns))
    line = spread.groupBy(KEY, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(ORDER).alias("ts"), "high", "low", "close", F.col("_top").alias("top"), F.col("_bottom").alias("bottom"), kept.alias("row")))).alias("line"))
    top = max_holding.bit_length() - 1
    # bound to a variable, so that a block's tables are made once and not for each bar
    tables = f"array(named_struct('hi', {_levels('transform(line, x -> x.high)', 'greatest', top)}, 'lo', {_levels('transform(line, x -> x.low)', 'least', top)}))"
    # bars from the next one that no barrier stops
    place = f"aggregate(reverse(sequence(0, {top})), i + 1, (p, j) -> if(get(m.hi[j], p) < x.top and get(m.lo[j], p) > x.bottom, p + shiftleft(1, j), p))"
    touch = f"transform(array({place}), p -> if(p - i <= {max_holding} and p < size(line), named_struct('h', p - i, 't', line[p].high >= x.top, 'b', line[p].low <= x.bottom), null))[0]"
    found = f"transform({tables}, m -> filter(transform(line, (x, i) -> named_struct('row', x.row, 'top', x.top, 'bottom', x.bottom, 'hit', {touch}, 'last', get(line, i + {max_holding}).close)), x -> x.row is not null))[0]"
    df = line.select(F.explode(F.expr(found)).alias("_x")).select("_x.row.*", F.col("_x.top").alias("_top"), F.col("_x.bottom").alias("_bottom"), F.col("_x.hit").alias("_hit"), F.col("_x.last").alias("_last"))
    ok = sigma.isNotNull() & (sigma > 0) & F.col("_last").isNotNull() & side.isNotNull() & (side != 0)
    # the stop-loss is the bottom for a long, the top for a short
    at_bottom = F.when(side < 0, ~F.col("_hit.t")).otherwise(F.col("_hit.b"))
    exit_price = F.when(F.col("_hit").isNull(), F.col("_last")).when(at_bottom, F.col("_bottom")).otherwise(F.col("_top"))
    ret = side * (exit_price / close - 1)
    won = F.when(F.col("_hit").isNull(), ret > 0).otherwise(F.when(side < 0, at_bottom).otherwise(~at_bottom))
    holding = F.coalesce(F.col("_hit.h"), F.lit(max_holding))
    df = df.withColumns({"label": F.when(ok, won.cast("long")), "ret_trade": F.when(ok, ret), "holding_bars": F.when(ok, holding.cast("long"))})
    return df.drop("_top", "_bottom", "_hit", "_last")
