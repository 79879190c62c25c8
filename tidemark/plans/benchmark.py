"""The benchmark: candles to forecasts of every model, their scores and backtests, and a run folder."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeframes import timeframe_ms
from ..operators import backtest, features, models, scoring, splits, trades
from ..sources import runs
from .dataset import Settings, samples

KNOWN = ("prior", "momentum_sign", "logreg", "gbt")


def forecasts(df: DataFrame, s: Settings, names: tuple[str, ...] = KNOWN) -> tuple[DataFrame, dict]:
    """Test rows of all folds under the named models, and the fitted ones as cached tables by name."""
    unknown = sorted(set(names) - set(KNOWN))
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    splits.check_folds(df, s.n_splits, s.test_size, s.min_train, s.purge)
    x = features.feature_names(**s.features.args()) + (["side"] if s.target.kind == "meta_triple_barrier" else [])
    keep = ["symbol", "model", "fold", "timestamp", "y", "p_up", "ret_next", "holding_bars", "side", "close", "sigma"]
    parts = [models.naive_predictions(df, s.n_splits, s.test_size, s.purge).where(F.col("model").isin(*names)).select(keep)]
    fitted = {}
    for name in models.FITS:
        if name in names:
            # the fits are read for forecasts, importances, contributions and the run folder
            fitted[name] = models.fit(df, x, name, s.n_splits, s.test_size, s.purge, s.seed).cache()
            parts.append(models.predict(df, fitted[name], x, name, s.n_splits, s.test_size).select(keep))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fitted


def report(pred: DataFrame, s: Settings, samples_: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores by fold and over folds, calibration, bar backtests (with holding), trades and their metrics.

    samples_: where highs and lows come from, for the trailing policy."""
    bar = timeframe_ms(s.timeframe)
    sided = s.target.kind == "meta_triple_barrier"
    bars = pred.withColumns({"p_up": backtest.sided_probability(F.col("p_up"), F.col("side")), "ret_next": F.col("side") * F.col("ret_next")}) if sided else pred
    folds = scoring.fold_metrics(pred)
    if s.policy == "trailing":
        if samples_ is None:
            raise ValueError("trailing trades need samples_, which hold highs and lows")
        taken = trades.trailing_trades(trades.with_bars(pred, samples_), bar, s.fee, s.target.pt_mult, s.target.sl_mult, s.target.max_holding, s.band)
    else:
        taken = trades.fixed_trades(pred.withColumn("ret_trade", F.col("ret_next")), bar, s.fee, s.band, sided)
    return {
        "folds": folds,
        "aggregate": scoring.over_folds(folds),
        "calibration": scoring.calibration(pred),
        "fold_backtest": backtest.backtest_metrics(bars, s.fee, s.bars_per_year, s.band, ("symbol", "model", "fold")),
        "pooled_backtest": backtest.comparison(bars.unionByName(backtest.buy_and_hold(bars)), s.fee, s.bars_per_year, s.band),
        "trades": taken,
        "trade_backtest": trades.trade_metrics(taken, pred, bar),
    }


def contributions(df: DataFrame, fitted: dict[str, DataFrame], x: list[str], s: Settings) -> DataFrame:
    """(model, fold, symbol, timestamp, features, bias) of each test row, by the model of its fold; they add up to the log-odds of p_up."""
    parts = [models.contributions(df, f, x, name, s.n_splits, s.test_size).select(F.lit(name).alias("model"), "fold", "symbol", "timestamp", *x, "bias") for name, f in fitted.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, candle_rows: DataFrame, s: Settings, root: str, names: tuple[str, ...] = KNOWN) -> str:
    """All of it, into a run folder; returns its path."""
    df = samples(candle_rows, s).cache()
    pred, fitted = forecasts(df, s, names)
    pred = pred.cache()
    out = report(pred, s, df)
    x = features.feature_names(**s.features.args()) + (["side"] if s.target.kind == "meta_triple_barrier" else [])
    rows = lambda d: [json.loads(r) for r in d.select(F.to_json(F.struct("*")).alias("j")).toPandas().j]
    # tables of a few rows per symbol and model
    metrics = {"config": json.loads(json.dumps(s, default=lambda o: o.__dict__)), "results": {k: rows(out[k]) for k in ("aggregate", "pooled_backtest", "trade_backtest")}}
    # over several series, their mean
    imp = {n: {r.feature: r.v for r in models.importances(f, x, n, s.n_splits - 1).groupBy("feature").agg(F.avg("importance").alias("v")).orderBy(F.desc("v"), "feature").collect()} for n, f in fitted.items()}
    more = {"bars": df.select("symbol", "timestamp", "open", "high", "low", "close", "volume"), "features": df.select("symbol", "timestamp", *x), "folds": out["folds"], "importances": imp, "calibration": {"rows": rows(out["calibration"])}}
    more |= {"trades": out["trades"], "fold_backtest": out["fold_backtest"]}
    if fitted:
        more["contributions"] = contributions(df, fitted, x, s)
    path = runs.write_run(spark, root, pred, metrics, **more)
    for n, f in fitted.items():
        f.write.partitionBy("fold").parquet(f"{path}/models/{n}.parquet")
        f.unpersist()
    df.unpersist()
    pred.unpersist()
    return path
