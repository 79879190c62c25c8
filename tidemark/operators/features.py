"""Causal features of bars: each row uses its own and earlier rows of its series only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER, full, safe_div
from ..functions.frames import trailing as _trailing
from .blocks import SPAN_MS, block_of, carried, in_blocks, numbered
from .ewm import ewm_means


def returns(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """ret_1: log return on the bar before."""
    return in_blocks(bars, _returns, 1, rows=rows)


def _returns(bars: DataFrame, w: WindowSpec) -> DataFrame:
    return bars.withColumn("ret_1", F.log(F.col("close") / F.lag("close").over(w)))


def price_features(bars: DataFrame, momentum: tuple[int, ...], vol: tuple[int, ...], range_vol: tuple[int, ...], channel: tuple[int, ...], rows: int | None = None) -> DataFrame:
    """Momentum, volatility, range and channel features; windows are rows, and null until full.  A series is cut into blocks of `rows` rows."""
    return in_blocks(bars, lambda df, w: _price_features(df, w, momentum, vol, range_vol, channel), 1 + max(*momentum, *vol, *range_vol, *channel, 1, 1), rows=rows)


def _price_features(bars: DataFrame, w: WindowSpec, momentum: tuple[int, ...], vol: tuple[int, ...], range_vol: tuple[int, ...], channel: tuple[int, ...]) -> DataFrame:
    df = bars if "ret_1" in bars.columns else _returns(bars, w)
    trailing = functools.partial(_trailing, spec=w)
    r, high, low, close = (F.col(c) for c in ("ret_1", "high", "low", "close"))
    hl, co = F.log(high / low), F.log(close / F.col("open"))
    new = {f"ret_{k}": full(F.sum, r, k, trailing(k)) for k in momentum}
    new |= {f"vol_{k}": full(F.stddev_samp, r, k, trailing(k)) for k in vol}
    for k in range_vol:
        new[f"parkinson_{k}"] = F.sqrt(full(F.avg, hl * hl, k, trailing(k)) / (4 * math.log(2)))
        mean = full(F.avg, 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, k, trailing(k))
        new[f"garman_klass_{k}"] = F.when(mean.isNotNull(), F.sqrt(F.greatest(mean, F.lit(0.0))))
    new["range_pct"] = (high - low) / close
    new["close_pos_bar"] = F.when(high > low, (close - low) / (high - low)).otherwise(0.5)
    for k in channel:
        new[f"_h{k}"], new[f"_l{k}"] = full(F.max, high, k, trailing(k)), full(F.min, low, k, trailing(k))
    new["gap"] = F.col("open") / F.lag("close").over(w) - 1
    df = df.withColumns(new)
    more = {f"vol_ratio_{min(vol)}_{max(vol)}": safe_div(F.col(f"vol_{min(vol)}"), F.col(f"vol_{max(vol)}"))} if vol else {}
    for k in channel:
        h, lo = F.col(f"_h{k}"), F.col(f"_l{k}")
        # 0.5 while the channel has no width, which includes its warm-up
        more[f"close_pos_{k}"] = F.when(h > lo, (close - lo) / (h - lo)).otherwise(0.5)
        more[f"dist_high_{k}"] = close / h - 1
    return df.withColumns(more).drop(*(f"_{s}{k}" for k in channel for s in "hl"))


def rsi(bars: DataFrame, period: int, rows: int | None = None) -> DataFrame:
    """(symbol, timestamp, rsi): Wilder's relative strength from smoothed gains and losses."""
    known = bars.select(KEY, ORDER, "close", "pos") if "pos" in bars.columns else numbered(bars.select(KEY, ORDER, "close"))
    steps = in_blocks(known, lambda df, w: df.withColumn("_step", F.col("close") - F.lag("close").over(w)), 1, rows=rows)
    step = F.col("_step")
    moves = steps.select(KEY, ORDER, F.greatest(step, F.lit(0.0)).alias("gain"), F.greatest(-step, F.lit(0.0)).alias("loss"), (F.col("pos") - 1).alias("pos"), "_step").where("_step is not null")
    smooth = ewm_means(moves, {"g": "gain", "l": "loss"}, 1 / period, period)
    return smooth.select(KEY, ORDER, safe_div(100 * F.col("g"), F.col("g") + F.col("l")).alias(f"rsi_{period}"))


def pivots(bars: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """Distance to the last pivot high and low: strict extremes of k bars on either side, known k bars later.

    What is known at a bar for the first time lies in the 2 k bars before; the last one known is filled forward in blocks of time, which hand it on."""

    def marked(df: DataFrame, w: WindowSpec) -> DataFrame:
        before, after = w.rowsBetween(-2 * k, -k - 1), w.rowsBetween(-k + 1, 0)

        def extreme(column: str, agg, beats):
            x, there = F.col(column), F.lag(column, k).over(w)
            return F.when(beats(there, full(agg, x, k, before)) & beats(there, full(agg, x, k, after)), there)

        return df.withColumns({"_ph": extreme("high", F.max, lambda a, b: a > b), "_pl": extreme("low", F.min, lambda a, b: a < b)})

    df = in_blocks(bars, marked, 2 * k, rows=rows).withColumn("_b", F.expr(block_of(ORDER, SPAN_MS)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ORDER)))
    df = carried(df, {"_bh": last("_ph"), "_bl": last("_pl")}, lambda t, w: F.last(t, ignorenulls=True).over(w), (KEY,))
    run = Window.partitionBy(KEY, "_b").orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    known = lambda now, before: F.coalesce(F.last(now, ignorenulls=True).over(run), F.col(before)) / F.col("close") - 1
    return df.withColumns({f"pivot_high_dist_{k}": known("_ph", "_bh"), f"pivot_low_dist_{k}": known("_pl", "_bl")}).drop("_ph", "_pl", "_bh", "_bl", "_b")


def calendar(bars: DataFrame) -> DataFrame:
    """Hour of day and day of week (0: Sunday) on the circle, from the open time in UTC."""
    hour = F.expr(f"({ORDER} div 3600000) % 24")
    dow = F.expr(f"({ORDER} div 86400000 + 4) % 7")
    return bars.withColumns({f"{n}_{f.__name__}": f(2 * math.pi * x / p) for n, x, p in (("hour", hour, 24.0), ("dow", dow, 7.0)) for f in (F.sin, F.cos)})


def volume_z(bars: DataFrame, windows: tuple[int, ...], rows: int | None = None) -> DataFrame:
    """Log volume against the mean and deviation of the k - 1 bars before."""
    if min(windows) < 3:
        raise ValueError("a volume window needs at least 3 bars")
    x = F.log1p("volume")

    def scores(df: DataFrame, w: WindowSpec) -> DataFrame:
        out = {}
        for k in windows:
            past = _trailing(k - 1, w, skip=1)
            out[f"volume_z_{k}"] = safe_div(x - full(F.avg, x, k - 1, past), full(F.stddev_samp, x, k - 1, past))
        return df.withColumns(out)

    return in_blocks(bars, scores, max(windows), rows=rows)


def all_features(bars: DataFrame, momentum, vol, range_vol, channel, rsi_period: int, pivot_window: int = 0, volume_windows: tuple[int, ...] = ()) -> DataFrame:
    """Bars with every feature; rows are numbered once for all windows, and the smoothed ones joined by key."""
    placed = bars if "pos" in bars.columns else numbered(bars)
    df = calendar(price_features(placed, momentum, vol, range_vol, channel))
    if pivot_window:
        df = pivots(df, pivot_window)
    if volume_windows:
        df = volume_z(df, volume_windows)
    out = df.join(rsi(placed, rsi_period), [KEY, ORDER], "left")
    return out if "pos" in bars.columns else out.drop("pos")


def feature_names(momentum, vol, range_vol, channel, rsi_period: int, pivot_window: int = 0, volume_windows: tuple[int, ...] = ()) -> list[str]:
    """Names of the features in their fixed order."""
    names = ["ret_1", *(f"ret_{k}" for k in momentum), *(f"vol_{k}" for k in vol), f"vol_ratio_{min(vol)}_{max(vol)}"]
    names += [f"{n}_{k}" for k in range_vol for n in ("parkinson", "garman_klass")] + ["range_pct", "close_pos_bar"]
    names += [f"{n}_{k}" for k in channel for n in ("close_pos", "dist_high")] + ["gap", f"rsi_{rsi_period}"]
    names += [f"pivot_{s}_dist_{pivot_window}" for s in ("high", "low")] if pivot_window else []
    return names + ["hour_sin", "hour_cos", "dow_sin", "dow_cos", *(f"volume_z_{k}" for k in volume_windows)]
