"""The fitted models' queries take every symbol, fold and round."""

from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import models
from tidemark.plans import dataset


def wanted(spark, tiny):
    rows = dataset.samples(queries._candles(spark, tiny), queries.SETTINGS)
    return {r.symbol for r in rows.select("symbol").distinct().collect()}


def test_logistic_queries_cover_symbols_and_folds(spark, tiny):
    symbols = wanted(spark, tiny)
    assert len(symbols) > 1
    got = queries.logistic_forecasts(spark, tiny).groupBy("symbol", "fold").agg(F.count("*").alias("n")).collect()
    assert {(r.symbol, r.fold, r.n) for r in got} == {(s, k, 24) for s in symbols for k in range(3)}
    shares = queries.logistic_contributions(spark, tiny).groupBy("symbol").count().collect()
    assert {(r.symbol, r["count"]) for r in shares} == {(s, 72) for s in symbols}


def test_tree_queries_cover_symbols_folds_and_rounds(spark, tiny, monkeypatch):
    asked, whole = [], models.boosting.boost
    fit = models.fit

    def few(*args, rounds=400):
        asked.append(rounds)
        return fit(*args, rounds=5)

    monkeypatch.setattr(models, "fit", few)
    symbols = wanted(spark, tiny)
    n = len(queries.features.feature_names(**queries.SETTINGS.features.args()))
    got = queries.tree_forecast_importances(spark, tiny).collect()
    assert len({(r.symbol, r.feature) for r in got}) == len(got) == n * len(symbols)
    p = queries.tree_forecasts(spark, tiny).groupBy("symbol", "fold").count().collect()
    assert {(r.symbol, r.fold, r["count"]) for r in p} == {(s, k, 24) for s in symbols for k in range(3)}
    shares = queries.tree_contributions(spark, tiny).groupBy("symbol").count().collect()
    assert {(r.symbol, r["count"]) for r in shares} == {(s, 72) for s in symbols}
    assert asked == [400] * 3 and whole.__defaults__[0] == 400
