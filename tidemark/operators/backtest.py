"""Bar-by-bar backtest of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ORDER
from .blocks import SPAN_MS, before_block, block_of, carried
from .scoring import fold_metrics

KEYS = ("symbol", "model")
METRICS = ("sharpe_gross", "sharpe_net", "ann_return_net", "ann_volatility_net", "hit_rate", "max_drawdown_net", "n_trades", "turnover", "exposure")


def position(p: Column, band: float = 0.0) -> Column:
    """1 above 0.5 + band, -1 below 0.5 - band, else 0."""
    return F.when(p > 0.5 + band, 1.0).when(p < 0.5 - band, -1.0).otherwise(0.0)


def sided_probability(p_win: Column, side: Column) -> Column:
    """A win probability as a direction: never against the side, and 0.5 at most at even odds."""
    return 0.5 + side * F.greatest(p_win - 0.5, F.lit(0.0))


def strategy_returns(pred: DataFrame, fee: float, band: float = 0.0, keys: tuple[str, ...] = KEYS, span: int = SPAN_MS) -> DataFrame:
    """Adds position, gross, change (in position; from 0 before the first row) and net.  Leaving after the last row costs nothing.

    Blocks of time hand their last position on."""
    df = pred.withColumn("position", position(F.col("p_up"), band)).withColumn("_b", F.expr(block_of(ORDER, span)))
    df = carried(df, {"_before": F.max_by("position", ORDER)}, lambda t, w: F.last(t).over(w), keys)
    last = F.coalesce(F.lag("position").over(Window.partitionBy(*keys, "_b").orderBy(ORDER)), F.col("_before"), F.lit(0.0))
    df = df.withColumns({"gross": F.col("position") * F.col("ret_next"), "change": F.abs(F.col("position") - last)})
    return df.withColumn("net", F.col("gross") - fee * F.col("change")).drop("_b", "_before")


def equity_curve(returns: DataFrame, column: str = "net", keys: tuple[str, ...] = KEYS, order: str = ORDER, span: int = SPAN_MS) -> DataFrame:
    """Adds equity (product of 1 + return) and drawdown from its running peak, which starts at the first equity.

    A scan over blocks of time: each has its product, and the highest and lowest product on its way (equity can turn negative, and then
    the lowest is the peak); what is handed on are the products of those before and the highest of their peaks."""
    run = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("_b", F.expr(block_of(order, span))).withColumn("_e", F.product(1 + F.col(column)).over(run))
    df = df.withColumns({"_hi": F.max("_e").over(run), "_lo": F.min("_e").over(run)})
    before = before_block(keys)
    blocks = df.groupBy(*keys, "_b").agg(F.max_by("_e", order).alias("_t"), F.max("_e").alias("_h"), F.min("_e").alias("_l"))
    blocks = blocks.withColumn("_p", F.coalesce(F.product("_t").over(before), F.lit(1.0)))
    peak = F.max(F.greatest(F.col("_p") * F.col("_h"), F.col("_p") * F.col("_l"))).over(before)
    df = df.join(blocks.select(*keys, "_b", "_p", peak.alias("_peak")), [*keys, "_b"])
    top = F.greatest(F.col("_peak"), F.when(F.col("_p") < 0, F.col("_p") * F.col("_lo")).otherwise(F.col("_p") * F.col("_hi")))
    df = df.withColumn("equity", F.col("_p") * F.col("_e"))
    return df.withColumn("drawdown", F.try_divide(F.col("equity"), top) - 1).drop("_b", "_e", "_hi", "_lo", "_p", "_peak")


def sharpe(x: str, scale: Column | float) -> Column:
    """Mean over sample deviation, annualised; null for fewer than two returns or none that differ."""
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(scale) if isinstance(scale, float | int) else scale)


def backtest_metrics(pred: DataFrame, fee: float, bars_per_year: float, band: float = 0.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The nine metrics of each key; annual return is arithmetic, hit rate null if never in the market."""
    df = equity_curve(strategy_returns(pred, fee, band, keys), keys=keys)
    inside = F.col("position") != 0
    return df.groupBy(*keys).agg(
        sharpe("gross", bars_per_year).alias("sharpe_gross"),
        sharpe("net", bars_per_year).alias("sharpe_net"),
        (F.avg("net") * bars_per_year).alias("ann_return_net"),
        (F.stddev_samp("net") * F.sqrt(F.lit(bars_per_year))).alias("ann_volatility_net"),
        F.avg(F.when(inside, (F.col("gross") > 0).cast("double"))).alias("hit_rate"),
        F.min("drawdown").alias("max_drawdown_net"),
        F.sum("change").alias("n_trades"),
        F.avg("change").alias("turnover"),
        F.avg(F.abs("position")).alias("exposure"),
    )


def buy_and_hold(pred: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Forecasts of certainty on the grid of each symbol's first model."""
    first = pred.groupBy("symbol").agg(F.min("model").alias("model"))
    return pred.join(first, ["symbol", "model"]).withColumns({"model": F.lit("buy_and_hold"), "p_up": F.lit(1.0)})


#: Ranges of values that are counted before any is ordered.
RANGES = 64


def quantile(df: DataFrame, column: str, q: float, name: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, name): exact quantile with linear interpolation, nulls left out.

    Equal values are counted together; counts of ranges say which range holds the two ranks that matter, and only its values are ordered."""
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)]).alias("_cuts"))
    placed = values.join(cuts, list(keys)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    counts = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_m").over(before_block(keys)), F.lit(0)), "_t": (F.sum("_m").over(whole) - 1) * q})
    kept = counts.where((F.col("_before") <= F.ceil("_t")) & (F.col("_before") + F.col("_m") > F.floor("_t"))).drop("_m")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(kept, [*keys, "_b"]).withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (F.col("_from") + F.col("_n") > rank), F.col("_v")))
    ends = ranked.groupBy(*keys, "_t").agg(at(F.floor("_t")).alias("_lo"), at(F.ceil("_t")).alias("_hi"))
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_t") - F.floor("_t"))).alias(name))


def return_stats(df: DataFrame, column: str = "net", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Population skewness and excess kurtosis, 5 % quantile (linear), extremes."""
    sums = df.groupBy(*keys).agg(F.skewness(column).alias("skewness"), F.kurtosis(column).alias("excess_kurtosis"), F.min(column).alias("least"), F.max(column).alias("largest"))
    return sums.join(quantile(df, column, 0.05, "q05", keys), list(keys), "left")


def comparison(pred: DataFrame, fee: float, bars_per_year: float, band: float = 0.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The nine metrics of each model with auc (null for one class or a constant forecast) and accuracy over all its rows."""
    distinct = pred.groupBy(*keys).agg((F.min("p_up") < F.max("p_up")).alias("_varies"))
    scores = fold_metrics(pred, keys).select(*keys, "auc", "accuracy").join(distinct, list(keys))
    out = backtest_metrics(pred, fee, bars_per_year, band, keys).join(scores, list(keys))
    return out.withColumn("auc", F.when(F.col("_varies"), F.col("auc"))).drop("_varies")


def histogram(df: DataFrame, column: str = "net", bins: int = 120, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Counts in equal bins between each key's extremes; the last bin is closed."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.least(F.floor(F.try_divide((F.col(column) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    return df.join(ends, list(keys)).withColumn("bin", F.coalesce(at, F.lit(0)).cast("long")).groupBy(*keys, "bin").agg(F.count("*").alias("count"))
