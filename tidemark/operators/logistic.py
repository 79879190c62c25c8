"""Regularised logistic regression of every series and fold at once, by Newton steps.

Training rows stay spread over tasks, many for each series: a step is one aggregate of their losses, slopes and curvatures
(summed in the tasks first, then one vector for each model), and one small linear system for each model.  Only
whether all models are done comes to the driver."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEY
from ..functions.steps import pinned

# executors need not have this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = [KEY, "fold"]
#: Models that are sent to all tasks beside the rows, at most; more are joined with them.
SENT = 20_000
_STATE = f"{KEY} string, fold long, n long, at array<double>, origin array<double>, step array<double>, size double, loss double, done boolean"


def _sums(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Each open model with the sums over its rows: loss, slopes, curvatures (row by row)."""
    at = state.select(*MODEL, "at")
    u = F.aggregate(F.zip_with("z", "at", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    beside = rows.join(F.broadcast(at) if few else at, MODEL).withColumn("u", u).withColumn("p", 1 / (1 + F.exp(-F.col("u"))))
    loss = F.log1p(F.exp(-F.abs("u"))) + F.greatest("u", F.lit(0.0)) - F.col("y") * F.col("u")
    slopes = F.transform("z", lambda a: a * (F.col("p") - F.col("y")))
    curves = F.flatten(F.transform("z", lambda a: F.transform("z", lambda b: a * b * F.col("p") * (1 - F.col("p")))))
    each = beside.select(*MODEL, array_to_vector(F.concat(F.array(loss), slopes, curves)).alias("v"))
    sums = each.groupBy(*MODEL).agg(Summarizer.sum(F.col("v")).alias("v")).select(*MODEL, vector_to_array("v").alias("sums"))
    return state.join(F.broadcast(sums) if few else sums, MODEL)


def _advance(c: float, tolerance: float):
    """One Newton step of each model; a step after which the loss is larger is halved instead."""

    def move(r, np):
        at, m = np.array(r.at), len(r.at)
        ridge = np.full(m, 1.0 / c)
        ridge[-1] = 0.0
        sums = np.asarray(r.sums)
        loss = sums[0] + 0.5 * np.sum(ridge * at * at)
        if loss > r.loss + 1e-10 * (1 + abs(r.loss)):
            size = r.size / 2
            back = np.array(r.origin)
            done = size < 1e-6
            return (back if done else back - size * np.array(r.step)), back, r.step, size, r.loss, done
        slope = sums[1 : m + 1] + ridge * at
        if np.abs(slope).max() <= tolerance * r.n:
            return at, at, slope, 1.0, loss, True
        step = np.linalg.solve(sums[m + 1 :].reshape(m, m) + np.diag(ridge) + 1e-12 * np.eye(m), slope)
        return at - step, at, step, 1.0, loss, False

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            moved = [move(r, np) for r in f.itertuples(index=False)]
            out = f[[*MODEL, "n"]].copy()
            for i, name in enumerate(("at", "origin", "step", "size", "loss", "done")):
                out[name] = pd.Series([x[i] for x in moved], index=f.index, dtype=object if i < 3 else bool if i == 5 else float)
            yield out

    return run


def fit(train: DataFrame, features: list[str], c: float = 1.0, steps: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """(symbol, fold, means, scales, weights, bias) that minimise |weights|^2 / 2 + c * log loss over standardised features.

    train: (symbol, fold, y, features), without nulls.  A constant feature is left unscaled, so its weight is 0.  With one class
    only, the weights are 0 and the bias is the log-odds at 1e-15 from that class.  An empty table gives no models."""
    scale = lambda f: F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0))
    models = pinned(train.groupBy(*MODEL).agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.array(*(F.avg(f) for f in features)).alias("means"), F.array(*map(scale, features)).alias("scales")))
    few = models.count() <= SENT
    z = F.array(*((F.col(f) - F.col("means")[i]) / F.col("scales")[i] for i, f in enumerate(features)), F.lit(1.0))
    standard = models.select(*MODEL, "means", "scales")
    rows = pinned(train.join(F.broadcast(standard) if few else standard, MODEL).select(*MODEL, F.col("y").cast("double").alias("y"), z.alias("z")))
    share = F.least(F.greatest("rate", F.lit(1e-15)), F.lit(1 - 1e-15))
    at = F.concat(F.array_repeat(F.lit(0.0), len(features)), F.array(F.log(share / (1 - share))))
    one_class = (F.col("rate") <= 0) | (F.col("rate") >= 1)
    state = models.select(*MODEL, "n", at.alias("at"), at.alias("origin"), at.alias("step"), F.lit(1.0).alias("size"), F.lit(float("inf")).alias("loss"), one_class.alias("done"))
    ready = state.where("done")
    state = pinned(state.where("not done"))
    for _ in range(steps):
        if state.isEmpty():
            break
        moved = pinned(_sums(rows, state, few).mapInPandas(_advance(c, tolerance), _STATE))
        ready = ready.unionByName(moved.where("done"))
        state = moved.where("not done")
    found = ready.unionByName(state).select(*MODEL, F.slice("at", 1, len(features)).alias("weights"), F.element_at("at", -1).alias("bias"))
    return pinned(standard.join(found, MODEL).select(*MODEL, "means", "scales", "weights", "bias"))


def residuals(train: DataFrame, fitted: DataFrame, features: list[str], c: float = 1.0) -> DataFrame:
    """(symbol, fold, feature, n_train, mean, scale, residual): the derivative of what `fit` minimises by each weight, and by the bias (feature
    "bias", whose mean is that of y).  All are 0 at the optimum, and only there, as the objective is convex."""
    z = [(F.col(f) - F.col("means")[i]) / F.col("scales")[i] for i, f in enumerate(features)]
    p = 1 / (1 + F.exp(-sum((t * F.col("weights")[i] for i, t in enumerate(z)), F.col("bias"))))
    sums = train.join(fitted, MODEL).withColumn("e", p - F.col("y")).groupBy(*MODEL, "means", "scales", "weights")
    found = sums.agg(F.count("*").alias("n_train"), F.avg("y").alias("rate"), F.sum("e").alias("bias"), *(F.sum(t * F.col("e")).alias(f"_{i}") for i, t in enumerate(z)))
    pair = lambda name, mean, scale, value: F.struct(F.lit(name).alias("feature"), mean.alias("mean"), scale.alias("scale"), value.alias("residual"))
    pairs = [pair(f, F.col("means")[i], F.col("scales")[i], F.col(f"_{i}") + F.col("weights")[i] / c) for i, f in enumerate(features)]
    all_ = F.array(*pairs, pair("bias", F.col("rate"), F.lit(1.0), F.col("bias")))
    return found.select(*MODEL, "n_train", F.explode(all_).alias("r")).select(*MODEL, "n_train", "r.*")
