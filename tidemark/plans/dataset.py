"""From candles to labelled samples, and from samples to forecasts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import pinned
from ..functions.timeframes import timeframe_ms
from ..operators import blocks, candles, features, labels, models


@dataclass(frozen=True)
class FeatureSpec:
    """Windows of the features, in bars."""

    momentum: tuple[int, ...] = (3, 6)
    vol: tuple[int, ...] = (6, 12)
    range_vol: tuple[int, ...] = (6,)
    channel: tuple[int, ...] = (6, 12)
    rsi_period: int = 14
    pivot_window: int = 0
    volume_windows: tuple[int, ...] = ()

    def __post_init__(self):
        if self.rsi_period <= 1 or not self.vol or min((*self.momentum, *self.vol, *self.range_vol, *self.channel)) < 1:
            raise ValueError("windows must be positive and the RSI period over 1")
        if self.volume_windows and min(self.volume_windows) < 3:
            raise ValueError("a volume window needs at least 3 bars")

    def args(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}


@dataclass(frozen=True)
class TargetSpec:
    """next_bar, triple_barrier or meta_triple_barrier."""

    kind: str = "next_bar"
    vol_span: int = 12
    pt_mult: float = 1.0
    sl_mult: float = 1.0
    max_holding: int = 6
    side_window: int = 6

    def __post_init__(self):
        if self.kind not in ("next_bar", "triple_barrier", "meta_triple_barrier"):
            raise ValueError(f"unknown target: {self.kind}")

    @property
    def horizon(self) -> int:
        return 1 if self.kind == "next_bar" else self.max_holding


@dataclass(frozen=True)
class Settings:
    """What a benchmark run needs; a purge shorter than the label horizon is refused."""

    timeframe: str = "1h"
    min_candles: int = 1
    features: FeatureSpec = field(default_factory=FeatureSpec)
    target: TargetSpec = field(default_factory=TargetSpec)
    n_splits: int = 3
    test_size: int = 24
    min_train: int = 24
    purge: int = 6
    fee: float = 0.001
    band: float = 0.0
    seed: int = 42
    policy: str = "fixed"

    def __post_init__(self):
        timeframe_ms(self.timeframe)
        if self.policy not in ("fixed", "trailing"):
            raise ValueError(f"unknown policy: {self.policy}")
        if self.policy == "trailing" and self.target.kind != "meta_triple_barrier":
            raise ValueError("trailing trades need the sides of meta_triple_barrier")
        if self.purge < max(1, self.target.horizon):
            raise ValueError("labels look further ahead than the purge")
        if not 0 <= self.band < 0.5:
            raise ValueError("the band must be in [0, 0.5)")

    @property
    def bars_per_year(self) -> float:
        return 365 * 86_400_000 / timeframe_ms(self.timeframe)


def load(path: str | None = None) -> Settings:
    """Settings from a YAML file: path, or the file named by TIDEMARK_CONFIG, or all defaults."""
    import os

    import yaml

    path = path or os.environ.get("TIDEMARK_CONFIG")
    raw = {}
    if path:
        with open(path) as f:
            raw = yaml.safe_load(f) or {}
    tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in (raw.pop("features", None) or {}).items()}
    return Settings(features=FeatureSpec(**tuples), target=TargetSpec(**(raw.pop("target", None) or {})), **raw)


def samples(candle_rows: DataFrame, s: Settings) -> DataFrame:
    """Distinct candles -> bars with features, y, ret_next, holding_bars, side and sigma; rows without a value in any
    feature or the target are left out.  Computed now."""
    # features, smoothed values and labels all start from the bars
    bars = pinned(blocks.numbered(candles.to_bars(candle_rows, s.timeframe, s.min_candles)))
    df = features.all_features(bars, **s.features.args())
    names = features.feature_names(**s.features.args())
    if s.target.kind == "next_bar":
        df = labels.next_bar(df).withColumns({"holding_bars": F.lit(1).cast("long"), "side": F.lit(1).cast("long"), "sigma": F.lit(None).cast("double")})
    else:
        df = labels.ewma_volatility(df, s.target.vol_span)
        sided = s.target.kind == "meta_triple_barrier"
        if sided:
            df = labels.momentum_side(df, s.target.side_window).withColumn("side", F.nullif("side", F.lit(0)))
            names = [*names, "side"]
        else:
            df = df.withColumn("side", F.lit(1).cast("long"))
        df = labels.triple_barrier(df, s.target.pt_mult, s.target.sl_mult, s.target.max_holding, sided)
        df = df.withColumnsRenamed({"label": "y", "ret_trade": "ret_next"})
    # written before it is filtered: what the engine infers from so many conditions on columns made from each other grows too fast to plan
    return pinned(df.drop("pos")).dropna(subset=[*names, "y"])


def naive_forecasts(candle_rows: DataFrame, s: Settings) -> DataFrame:
    """Test rows of all folds under the two naive models."""
    return models.naive_predictions(samples(candle_rows, s), s.n_splits, s.test_size, s.purge)


def dataset_summary(df: DataFrame, n_features: int, max_holding: int) -> DataFrame:
    """Per symbol: samples, features, first and last time, rate of 1, mean holding, share held to the limit."""
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_samples"),
        F.lit(n_features).cast("long").alias("n_features"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.avg(F.col("y").cast("double")).alias("up_rate"),
        F.avg(F.col("holding_bars").cast("double")).alias("mean_holding"),
        F.avg((F.col("holding_bars") == max_holding).cast("double")).alias("vertical_share"),
    )
