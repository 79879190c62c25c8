"""Run folders: what a benchmark leaves behind, found and read again."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .lake import _fs

TABLES = ("predictions", "bars", "contributions", "features", "folds", "trades", "fold_backtest")
DOCUMENTS = ("metrics", "importances", "calibration")


@dataclass
class Run:
    """One run; what it lacks is None or empty."""

    name: str
    metrics: dict
    predictions: DataFrame
    importances: dict
    calibration: dict
    bars: DataFrame | None = None
    contributions: DataFrame | None = None
    features: DataFrame | None = None
    trades: DataFrame | None = None
    fold_backtest: DataFrame | None = None


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if fs.exists(p) else {}


def write_run(spark: SparkSession, root: str, predictions: DataFrame, metrics: dict, **more) -> str:
    """Write run_<time> with its tables (zstd Parquet; folds as CSV) and JSON documents; metrics come last, so a broken-off run isn't found."""
    path = f"{root}/run_{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')}"
    for name, df in {"predictions": predictions, **{k: v for k, v in more.items() if k in TABLES}}.items():
        if name == "folds":
            df.coalesce(1).write.option("header", True).csv(f"{path}/folds.csv")
        else:
            df.write.option("compression", "zstd").parquet(f"{path}/{name}.parquet")
    for name in DOCUMENTS[1:]:
        if name in more:
            _put(spark, f"{path}/{name}.json", json.dumps(more[name]))
    _put(spark, f"{path}/metrics.json", json.dumps({"generated_at": datetime.now(UTC).isoformat(), **metrics}))
    return path


def list_runs(spark: SparkSession, root: str) -> list[str]:
    """Names of complete runs (metrics and predictions are there), newest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for s in fs.listStatus(path):
        p = s.getPath()
        if p.getName().startswith("run_") and fs.exists(child(p, "metrics.json")) and fs.exists(child(p, "predictions.parquet")):
            found.append(p.getName())
    return sorted(found, reverse=True)


def load_run(spark: SparkSession, root: str, name: str) -> Run:
    path = f"{root}/{name}"

    def optional(table: str) -> DataFrame | None:
        fs, p = _fs(spark, f"{path}/{table}.parquet")
        return spark.read.parquet(f"{path}/{table}.parquet") if fs.exists(p) else None

    return Run(name, _get(spark, f"{path}/metrics.json"), spark.read.parquet(f"{path}/predictions.parquet"), _get(spark, f"{path}/importances.json"), _get(spark, f"{path}/calibration.json"), *(optional(t) for t in ("bars", "contributions", "features", "trades", "fold_backtest")))
