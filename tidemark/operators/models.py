"""Forecast models: two naive ones as aggregates; logistic regression and boosted trees, one for each fold of each series.

Logistic regression is fitted by aggregates over all rows.  A series' training rows of a fold are given to its trees in one
task for each: bars of one symbol, whose number its time range bounds (70,000 for eight years of hours), in doubles and one byte
a value.  All series and folds are fitted at once, and the fitted models are a table."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import KEY, ORDER
from . import boosting, logistic
from .splits import assign, fold_bounds, number_rows, test_rows

# executors need not have this library
cloudpickle.register_pickle_by_value(boosting)

FITS = ("logreg", "gbt")
_NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double"


def _train_sums(df: DataFrame, n_splits: int, test_size: int, purge: int, aggs: dict) -> DataFrame:
    """Aggregates over each fold's training rows, without a copy of a row for each fold that trains on it: sums
    between fold ends are taken once and accumulated."""
    bounds = fold_bounds(df, n_splits, test_size, purge)
    ends = bounds.groupBy(KEY).agg(F.sort_array(F.collect_list("train_end")).alias("ends"))
    # the first fold that trains on the row
    piece = F.size(F.filter("ends", lambda e: e <= F.col("pos"))).cast("long").alias("fold")
    sums = number_rows(df).join(ends, KEY).withColumn("fold", piece).where(F.col("fold") < n_splits).groupBy(KEY, "fold").agg(*(F.sum(c).alias(k) for k, c in aggs.items()))
    grid = bounds.select(KEY, "fold").join(sums, [KEY, "fold"], "left")
    from pyspark.sql import Window

    run = Window.partitionBy(KEY).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select(KEY, "fold", *(F.sum(F.coalesce(k, F.lit(0))).over(run).alias(k) for k in aggs))


def naive_predictions(df: DataFrame, n_splits: int, test_size: int, purge: int, feature: str = "ret_1") -> DataFrame:
    """p_up of the two naive models for each test row: `prior` (training rate) and `momentum_sign` (training rate given the
    feature's sign; 0.5 where no training row has it).  df: rows with y and the feature."""
    up = F.col(feature) > 0
    aggs = {
        "_n": F.lit(1),
        "_y": F.col("y"),
        "_n_up": F.coalesce(up, F.lit(False)).cast("int"),
        "_y_up": F.when(up, F.col("y")).otherwise(0),
    }
    rates = _train_sums(df, n_splits, test_size, purge, aggs)
    rates = rates.select(
        KEY,
        "fold",
        F.try_divide(F.col("_y"), F.col("_n")).alias("_prior"),
        F.coalesce(F.try_divide(F.col("_y_up"), F.col("_n_up")), F.lit(0.5)).alias("_up"),
        F.coalesce(F.try_divide(F.col("_y") - F.col("_y_up"), F.col("_n") - F.col("_n_up")), F.lit(0.5)).alias("_down"),
    )
    test = test_rows(df, n_splits, test_size).join(rates, [KEY, "fold"])
    by_model = F.array(F.struct(F.lit("prior").alias("model"), F.col("_prior").alias("p_up")), F.struct(F.lit("momentum_sign").alias("model"), F.when(up, F.col("_up")).otherwise(F.col("_down")).alias("p_up")))
    return test.withColumn("_m", F.explode(by_model)).select("*", "_m.*").drop("_m", "_prior", "_up", "_down", "pos", "n_rows")


def train_rows(df: DataFrame, features: list[str], n_splits: int, test_size: int, purge: int) -> DataFrame:
    """(symbol, fold, timestamp, y, features) of each fold's training rows."""
    return assign(df.select(KEY, ORDER, "y", *features), n_splits, test_size, purge).where("role = 'train'").drop("role", "pos")


def fit(df: DataFrame, features: list[str], name: str, n_splits: int, test_size: int, purge: int, seed: int = 42, rounds: int = 400) -> DataFrame:
    """A fresh model for each series and fold.  name: logreg (a row for each: means, scales, weights, bias) or gbt (a row for each node of
    each tree; tree -1 holds the log-odds that the trees start from).  df: rows with y and the features, without nulls."""
    if name not in FITS:
        raise ValueError(f"unknown model: {name}")

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(ORDER)
        x, y = pdf[features].to_numpy(float), pdf["y"].to_numpy(float)
        out = pd.DataFrame(boosting.boost(x, y, rounds=rounds, seed=seed))
        out.insert(0, KEY, key[0])
        out.insert(1, "fold", key[1])
        return out

    train = train_rows(df, features, n_splits, test_size, purge)
    if name == "logreg":
        return logistic.fit(train.drop(ORDER), features)
    return train.groupBy(KEY, "fold").applyInPandas(run, f"{KEY} string, fold long, {_NODES}")


def _beside_nodes(test: DataFrame, nodes: DataFrame, features: list[str], per_rows, names: list[str]) -> DataFrame:
    """Columns that per_rows(nodes, x) gives for each test row, from the trees of its series and fold."""

    def run(key, left, right):
        import pandas as pd

        out = left[[KEY, "fold", ORDER]].reset_index(drop=True)
        if not len(left) or not len(right):
            return out.iloc[:0].assign(**{n: pd.Series(dtype=float) for n in names})
        values = per_rows({k: right[k].to_numpy() for k in boosting.NODE}, left[features].to_numpy(float))
        return out.assign(**{n: values[:, i] for i, n in enumerate(names)})

    schema = f"{KEY} string, fold long, {ORDER} long, " + ", ".join(f"`{n}` double" for n in names)
    rows = test.select(KEY, "fold", ORDER, *features)
    return rows.groupBy(KEY, "fold").cogroup(nodes.groupBy(KEY, "fold")).applyInPandas(run, schema)


def _terms(features: list[str]) -> list[Column]:
    """A linear model's terms: weight times standardised value."""
    return [(F.col(f) - F.col("means")[i]) / F.col("scales")[i] * F.col("weights")[i] for i, f in enumerate(features)]


def predict(df: DataFrame, fitted: DataFrame, features: list[str], name: str, n_splits: int, test_size: int) -> DataFrame:
    """Every fold's test rows with model and p_up, by the model of their series and fold."""
    test = test_rows(df, n_splits, test_size).drop("pos", "n_rows")
    if name == "logreg":
        odds = sum(_terms(features), F.col("bias"))
        out = test.join(fitted, [KEY, "fold"]).withColumn("p_up", 1 / (1 + F.exp(-odds))).drop("means", "scales", "weights", "bias")
    else:
        p_up = _beside_nodes(test, fitted, features, lambda nodes, x: boosting.sigmoid(boosting.log_odds(nodes, x))[:, None], ["p_up"])
        out = test.join(p_up, [KEY, "fold", ORDER])
    return out.withColumn("model", F.lit(name))


def importances(fitted: DataFrame, features: list[str], name: str, fold: int) -> DataFrame:
    """(symbol, feature, importance) of one fold's models: a linear model's absolute weights, or the total gain of the trees' splits;
    0 for a feature without any."""
    of = fitted.where(F.col("fold") == fold)
    if name == "logreg":
        of = of.select(KEY, *(F.abs(F.col("weights")[i]).alias(f"_{i}") for i in range(len(features))))
    else:
        of = of.groupBy(KEY).agg(*(F.sum(F.when(F.col("feature") == i, F.col("gain")).otherwise(0.0)).alias(f"_{i}") for i in range(len(features))))
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_{i}").alias("importance")) for i, f in enumerate(features)))
    return of.select(KEY, F.explode(pairs).alias("p")).select(KEY, "p.*")


def contributions(df: DataFrame, fitted: DataFrame, features: list[str], name: str, n_splits: int, test_size: int) -> DataFrame:
    """(symbol, fold, timestamp, features, bias) of every test row, by the model of its series and fold: exact terms of a linear model, exact
    Shapley values of trees.  Features and bias add up to the log-odds of p_up."""
    test = test_rows(df, n_splits, test_size)
    if name == "logreg":
        terms = (t.alias(f) for t, f in zip(_terms(features), features, strict=True))
        return test.join(fitted, [KEY, "fold"]).select(KEY, "fold", ORDER, *terms, "bias")

    def shares(nodes, x):
        import numpy as np

        start, trees = boosting.trees(nodes)
        out = np.zeros((len(x), len(features) + 1))
        out[:, -1] = start
        for tree in trees:
            phi, mean = boosting.shapley(tree, x)
            out[:, :-1] += phi
            out[:, -1] += mean
        return out

    return _beside_nodes(test, fitted, features, shares, [*features, "bias"])
