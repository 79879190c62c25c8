"""Trade by trade simulation: one position at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER
from .backtest import KEYS, equity_curve
from .blocks import ROWS, numbered, with_halo
from .chains import one_at_a_time

YEAR_MS = 365 * 86_400_000
#: Bars of time of a block of trades.
BLOCK_BARS = 256


def fixed_trades(pred: DataFrame, bar_ms: int, fee: float, band: float = 0.0, sided: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Trades that are held as long as their label says; signals while one is open are ignored.

    Only rows that signal take part, in blocks of time; see `one_at_a_time`."""
    p = F.col("p_up")
    direction = F.when((p > 0.5 + band) & (F.col("side") != 0), F.col("side")) if sided else F.when(p > 0.5 + band, 1).when(p < 0.5 - band, -1)
    gross = F.col("ret_trade") if sided else F.col("_d") * F.col("ret_trade")
    signals = pred.withColumn("_d", direction.cast("bigint")).where("_d is not null")
    rows = signals.select(
        *keys, F.col(ORDER).cast("bigint").alias("entry_ts"), (F.col(ORDER) + F.col("holding_bars") * bar_ms).cast("bigint").alias("exit_ts"), F.col("_d").alias("direction"), F.col("holding_bars").cast("bigint").alias("holding_bars"), p.cast("double").alias("p_up"), gross.cast("double").alias("ret_gross"), (gross - 2 * fee).cast("double").alias("ret_net")
    )
    return one_at_a_time(rows, keys, BLOCK_BARS * bar_ms)


def trailing_trades(pred: DataFrame, bar_ms: int, fee: float, up: float, down: float, max_holding: int, band: float = 0.0, keys: tuple[str, ...] = KEYS, rows: int = ROWS) -> DataFrame:
    """Trades with trailing barriers: a new signal in a position's direction moves target and stop where they are better for it, the stop
    is looked at first, then the target, then the time.  Positions still open at the end are dropped.

    What would become of a position depends on where it begins only, and is settled within max_holding bars: blocks of rows, with so many more
    behind them, follow all positions that could begin in them.  Then one at a time is taken, block by block too."""
    d = F.when((F.col("p_up") > 0.5 + band) & F.col("side").isin(1, -1) & (F.col("sigma") > 0) & (F.col("sigma") < float("inf")), F.col("side").cast("bigint"))
    # barriers and prices in units of side * price: higher is better for either side
    level = lambda way: d * F.col("close") * (1 + d * way * F.col("sigma"))
    bars = pred.select(*keys, F.col(ORDER).cast("bigint").alias("ts"), d.alias("d"), "p_up", "high", "low", "close", level(up).alias("target"), level(-down).alias("stop"))
    spread = with_halo(numbered(bars, keys, "ts"), 0, max_holding, max(rows, max_holding))
    line = spread.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("ts", F.col("_own").alias("own"), "d", "p_up", "high", "low", "close", "target", "stop"))).alias("bars"))
    reason = "case when if(a.d > 0, b.low, -b.high) <= a.stop then 'sl' when if(a.d > 0, b.high, -b.low) >= a.target then 'tp' when b.ts >= a.deadline then 'vertical' end"
    price = "case reason when 'sl' then a.d * a.stop when 'tp' then a.d * a.target else b.close end"
    left = f"transform(array({reason}), reason -> named_struct('exit_ts', if(reason is null, null, b.ts), 'exit_price', if(reason is null, null, {price}), 'exit_reason', reason))[0]"
    held = "named_struct('d', a.d, 'deadline', a.deadline, 'target', {}, 'stop', {}, 'n_updates', {}, 'exit', {})"
    better = "if(x.exit_reason is null and b.d = a.d, greatest(a.{0}, b.{0}), a.{0})"
    step = f"if(a.exit.exit_reason is not null, a, transform(array({left}), x -> {held.format(better.format('target'), better.format('stop'), 'a.n_updates + if(x.exit_reason is null and b.d = a.d, 1L, 0L)', 'x')})[0])"
    begun = f"named_struct('d', s.d, 'deadline', s.ts + {max_holding * bar_ms}L, 'target', s.target, 'stop', s.stop, 'n_updates', 0L, 'exit', named_struct('exit_ts', cast(null as bigint), 'exit_price', cast(null as double), 'exit_reason', cast(null as string)))"
    fate = f"transform(filter(transform(bars, (s, i) -> named_struct('s', s, 'i', i)), x -> x.s.own and x.s.d is not null), x -> transform(array(x.s), s -> named_struct('s', s, 'p', aggregate(slice(bars, x.i + 2, {max_holding}), {begun}, (a, b) -> {step})))[0])"
    found = line.select(*keys, F.explode(F.expr(fate)).alias("t"))
    could = found.select(
        *keys,
        F.col("t.s.ts").alias("entry_ts"),
        # one that is still open at the end holds until its deadline, which lies behind it
        F.coalesce("t.p.exit.exit_ts", "t.p.deadline").alias("exit_ts"),
        F.col("t.s.d").alias("direction"),
        F.col("t.s.p_up").cast("double").alias("p_up"),
        F.col("t.s.close").cast("double").alias("entry_price"),
        F.col("t.p.exit.exit_price").alias("exit_price"),
        F.col("t.p.exit.exit_reason").alias("exit_reason"),
        F.col("t.p.n_updates").alias("n_updates"),
    )
    taken = one_at_a_time(could, keys, BLOCK_BARS * bar_ms).where("exit_reason is not null")
    gross = F.col("direction") * (F.col("exit_price") / F.col("entry_price") - 1)
    holding = F.greatest(F.lit(1), F.expr(f"(exit_ts - entry_ts) div {bar_ms}L"))
    return taken.select(*keys, "entry_ts", "exit_ts", "direction", holding.cast("bigint").alias("holding_bars"), "p_up", "entry_price", "exit_price", "exit_reason", "n_updates", gross.alias("ret_gross"), (gross - 2 * fee).alias("ret_net"))


def with_bars(pred: DataFrame, bars: DataFrame) -> DataFrame:
    """Stored forecasts with high and low of their bars; null where a bar is missing."""
    return pred.join(bars.select(KEY, ORDER, "high", "low"), [KEY, ORDER], "left")


def trade_equity(trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds trade_no (1-based), equity and drawdown trade by trade."""
    return equity_curve(numbered(trades, keys, "entry_ts").withColumn("pos", F.col("pos") + 1).withColumnRenamed("pos", "trade_no"), "ret_net", keys, "entry_ts")


def trade_metrics(trades: DataFrame, pred: DataFrame, bar_ms: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Nine metrics per key of pred; keys without trades have zero counts and null rates.

    Annual return is geometric, and null when the final equity isn't positive; exposure can exceed 1."""
    span = pred.groupBy(*keys).agg((F.max(ORDER) - F.min(ORDER) + bar_ms).alias("_elapsed"))
    sums = trade_equity(trades, keys).groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.avg((F.col("ret_net") > 0).cast("double")).alias("win_rate"),
        F.avg("ret_net").alias("avg_ret_net"),
        F.stddev_samp("ret_net").alias("_std"),
        F.max_by("equity", "trade_no").alias("_equity"),
        F.min("drawdown").alias("max_drawdown_net"),
        F.sum("holding_bars").alias("_bars"),
        F.avg("holding_bars").alias("avg_holding_bars"),
    )
    years = F.col("_elapsed") / YEAR_MS
    n = F.coalesce("_n", F.lit(0))
    return span.join(sums, list(keys), "left").select(
        *keys,
        n.cast("double").alias("n_trades"),
        "win_rate",
        "avg_ret_net",
        F.when(n == 0, 0.0).otherwise(F.when(F.col("_equity") > 0, F.pow("_equity", 1 / years) - 1)).alias("ann_return_net"),
        (F.try_divide(F.col("avg_ret_net"), F.col("_std")) * F.sqrt(n / years)).alias("sharpe_net"),
        F.coalesce("max_drawdown_net", F.lit(0.0)).alias("max_drawdown_net"),
        F.coalesce(F.col("_bars") * bar_ms / F.col("_elapsed"), F.lit(0.0)).alias("exposure"),
        "avg_holding_bars",
        F.when(n == 0, 0.0).otherwise(n / years).alias("trades_per_year"),
    )


def with_prices(trades: DataFrame, pred: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds the entry price, looked up by time, and the exit price that the gross return implies."""
    entry = pred.select(*keys, F.col(ORDER).alias("entry_ts"), F.col("close").alias("entry_price"))
    out = trades.join(entry, [*keys, "entry_ts"], "left")
    return out.withColumn("exit_price", F.col("entry_price") * (1 + F.col("direction") * F.col("ret_gross")))


def winners(trades: DataFrame) -> DataFrame:
    return trades.where("ret_net > 0")


def losers(trades: DataFrame) -> DataFrame:
    return trades.where("ret_net <= 0")


def nth_trade(trades: DataFrame, n: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The n-th trade of each key, counted from 1."""
    return numbered(trades, keys, "entry_ts").where(F.col("pos") == n - 1).drop("pos")


def around_trades(trades: DataFrame, bars: DataFrame, bar_ms: int, before: int = 25, after: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Bars from `before` bars ahead of each trade's entry to `after` past its exit: an equi-join on the bars' own times."""
    spread = trades.select(*keys, "entry_ts", F.explode(F.sequence(F.col("entry_ts") - before * bar_ms, F.col("exit_ts") + after * bar_ms, F.lit(bar_ms))).alias(ORDER))
    return spread.join(bars, ["symbol", ORDER])


def top_contributions(contributions: DataFrame, features: list[str], k: int = 8, keys: tuple[str, ...] = ("symbol", ORDER)) -> DataFrame:
    """The k largest contributions by size of each row (the bias left out), from one column per feature."""
    long = contributions.select(*keys, F.expr(f"stack({len(features)}, {', '.join(f'''\"{f}\", `{f}`''' for f in features)}) as (feature, value)"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("value")), "feature"))
    return long.withColumn("place", place.cast("long")).where(F.col("place") <= k)
