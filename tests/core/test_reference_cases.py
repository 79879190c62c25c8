"""Hand-computed cases for the candle engine."""

import itertools
import math
import random
from datetime import date

import numpy as np
import pytest

import brute
from tidemark.functions import timeframes as tf
from tidemark.operators import backtest, boosting, candles, chains, features, labels, logistic, models, scoring, splits, trades
from tidemark.operators.ewm import ewm_means, ewm_std
from tidemark.plans.dataset import FeatureSpec, Settings, TargetSpec, load

T0 = 1_600_002_000_000
HOUR = 3_600_000


def frame(spark, closes, spread=0.0, step=HOUR, sigma=None, side=None, volume=10.0):
    rows = [("s", T0 + i * step, float(c), c + spread, c - spread, float(c), float(volume), i, sigma, side[i] if side else None) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double, seq long, sigma double, side long")


def walk(n, seed=7):
    rng = random.Random(seed)
    x, out = 100.0, []
    for _ in range(n):
        x *= math.exp(rng.gauss(0, 0.01))
        out.append(x)
    return out


def test_timeframes():
    assert [tf.timeframe_ms(x) for x in ("1m", "15m", "4h", "1d", "2w")] == [60_000, 900_000, 4 * HOUR, 24 * HOUR, 14 * 24 * HOUR]
    assert tf.anchor_ms("1w") == tf.anchor_ms("7d") == tf.anchor_ms("168h") == 4 * 24 * HOUR
    assert tf.anchor_ms("1d") == 0
    for bad in ("1s", "h", "1M", ""):
        with pytest.raises(ValueError, match="timeframe"):
            tf.timeframe_ms(bad)
    assert tf.month_range(date(2019, 11, 5), date(2020, 2, 1)) == [(2019, 11), (2019, 12), (2020, 1), (2020, 2)]
    assert tf.month_range(date(2020, 2, 1), date(2020, 1, 1)) == []
    assert tf.month_bounds_ms(2020, 1) == (1577836800000, 1580515200000)
    assert tf.month_bounds_ms(2019, 12)[1] == 1577836800000


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([("s", 2000, 1.0, 0), ("s", 1000, 2.0, 1), ("s", 2000, 9.0, 2)], "symbol string, timestamp long, open double, seq long")
    assert {(r.timestamp, r.open) for r in candles.keep_last(df).collect()} == {(1000, 2.0), (2000, 9.0)}
    assert {(r.timestamp, r.open) for r in candles.keep_first(df).collect()} == {(1000, 2.0), (2000, 1.0)}


def test_closed_boundary(spark):
    df = frame(spark, [1, 1, 1, 1], step=900_000)
    assert candles.closed(df, "15m", T0 + 2 * 900_000 + 1).count() == 2
    assert candles.closed(df, "15m", T0 + 900_000).count() == 1


def test_bars(spark):
    minutes = [100 * h + m + 1 for h in range(3) for m in range(60)]
    df = frame(spark, minutes, spread=0.5, step=60_000)
    start = T0 - T0 % HOUR
    rows = {r.timestamp: r for r in candles.to_bars(df.withColumn("timestamp", df.timestamp - T0 + start), "1h", 60).collect()}
    assert len(rows) == 3
    r = rows[start + HOUR]
    assert (r.open, r.high, r.low, r.close, r.volume, r.n_candles) == (101, 160.5, 100.5, 160, 600, 60)
    assert candles.to_bars(df.where("close != 130").withColumn("timestamp", df.timestamp - T0 + start), "1h", 60).count() == 2


def test_gaps(spark):
    df = frame(spark, [1] * 10, step=900_000).where("seq not in (3, 4, 7)")
    missing = candles.gaps(df, "15m")
    assert sorted(r.timestamp for r in missing.collect()) == [T0 + k * 900_000 for k in (3, 4, 7)]
    runs = sorted((r.start, r.end, r.n) for r in candles.gap_ranges(missing, "15m").collect())
    assert runs == [(T0 + 3 * 900_000, T0 + 4 * 900_000, 2), (T0 + 7 * 900_000, T0 + 7 * 900_000, 1)]
    assert candles.gaps(df.limit(1), "15m").count() == 0
    assert candles.gaps(df.limit(0), "15m").count() == 0


def test_validation(spark):
    good = frame(spark, [100, 101], spread=1.0).select("symbol", *candles.CANDLE)
    assert candles.validate(good).count() == 2
    for column, value, check in (("low", 500.0, "low_below_body"), ("high", 1.0, "high_above_body"), ("volume", -1.0, "volume_not_negative"), ("open", 0.0, "open_positive"), ("close", None, "close_positive")):
        import pyspark.sql.functions as F

        with pytest.raises(ValueError, match=check):
            candles.validate(good.withColumn(column, F.lit(value).cast("double")))
    with pytest.raises(ValueError, match="timestamp_unique"):
        candles.validate(good.unionByName(good))
    with pytest.raises(ValueError, match="columns"):
        candles.validate(good.drop("volume"))
    assert {r["check"]: r["failures"] for r in candles.check_counts(good.limit(0)).collect()}["timestamp_unique"] == 0


def test_features_are_causal(spark):
    closes = walk(120)
    spec = FeatureSpec(pivot_window=3, volume_windows=(6,))
    names = features.feature_names(**spec.args())
    whole = {r.timestamp: r for r in features.all_features(frame(spark, closes, 0.5), **spec.args()).collect()}
    part = {r.timestamp: r for r in features.all_features(frame(spark, closes[:70], 0.5), **spec.args()).collect()}
    for t, r in part.items():
        for n in names:
            assert (r[n] is None) == (whole[t][n] is None)
            assert r[n] is None or abs(r[n] - whole[t][n]) < 1e-9
    assert whole[T0 + 11 * HOUR]["vol_12"] is None
    assert whole[T0 + 12 * HOUR]["vol_12"] is not None
    assert whole[T0]["close_pos_6"] == 0.5


def test_rsi_extremes(spark):
    up = {r.timestamp: r.rsi_5 for r in features.rsi(frame(spark, range(100, 120)), 5).collect()}
    down = {r.timestamp: r.rsi_5 for r in features.rsi(frame(spark, range(120, 100, -1)), 5).collect()}
    assert up[T0 + 5 * HOUR] == 100
    assert down[T0 + 5 * HOUR] == 0
    assert up[T0 + 4 * HOUR] is None


def test_pivots(spark):
    flat = [100.0] * 30
    rows = [("s", T0 + i * HOUR, 100.0, 110.0 if i == 10 else 100.0, 90.0 if i == 20 else 100.0, 100.0, 1.0) for i in range(len(flat))]
    df = spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double")
    out = {(r.timestamp - T0) // HOUR: r for r in features.pivots(df, 5).collect()}
    assert out[14].pivot_high_dist_5 is None
    assert abs(out[15].pivot_high_dist_5 - 0.1) < 1e-12
    assert out[24].pivot_low_dist_5 is None
    assert abs(out[25].pivot_low_dist_5 + 0.1) < 1e-12


def test_volume_window(spark):
    with pytest.raises(ValueError, match="3 bars"):
        features.volume_z(frame(spark, [1, 2]), (2,))
    assert all(r.volume_z_4 is None for r in features.volume_z(frame(spark, walk(12)), (4,)).collect())


@pytest.mark.parametrize("n", [1, 5, 700])
def test_ewm(spark, n):
    xs = walk(n)
    a, span = 1 / 14, 42
    got = {r.timestamp: r.m for r in ewm_means(frame(spark, xs), {"m": "close"}, a, 3).collect()}
    std = {r.timestamp: r.s for r in ewm_std(frame(spark, xs), "close", "s", span).collect()}
    y = None
    q = 1 - 2 / (span + 1)
    for i, x in enumerate(xs):
        y = x if y is None else (1 - a) * y + a * x
        assert got[T0 + i * HOUR] is None if i < 2 else abs(got[T0 + i * HOUR] - y) < 1e-9
        if i + 1 < span:
            assert std[T0 + i * HOUR] is None
        elif i % 50 == 0:
            w = [q ** (i - j) for j in range(i + 1)]
            s, m = sum(w), sum(k * v for k, v in zip(w, xs, strict=False)) / sum(w)
            var = sum(k * (v - m) ** 2 for k, v in zip(w, xs, strict=False)) / s
            want = math.sqrt(var * s * s / (s * s - sum(k * k for k in w)))
            assert abs(std[T0 + i * HOUR] - want) < 1e-6 * want


@pytest.mark.parametrize(
    ("closes", "want"),
    [([100, 100.5, 101.5, 101, 101, 101], (1, 0.01, 2)), ([100, 99.5, 98, 99, 99, 99], (0, -0.01, 2)), ([100, 100.2, 100.3, 100.2, 100.4, 100], (1, 0.004, 4))],
)
def test_triple_barrier(spark, closes, want):
    r = labels.triple_barrier(frame(spark, closes, sigma=0.01), 1.0, 1.0, 4).orderBy("timestamp").first()
    assert (r.label, round(r.ret_trade, 9), r.holding_bars) == want


def test_triple_barrier_tail_and_double_touch(spark):
    out = labels.triple_barrier(frame(spark, [100] * 10, sigma=0.01), 1.0, 1.0, 4).orderBy("timestamp").collect()
    assert [r.label for r in out] == [0] * 6 + [None] * 4
    wide = frame(spark, [100] * 6, spread=5.0, sigma=0.01, side=[1, -1, 0, None, 1, 1])
    got = labels.triple_barrier(wide, 3.0, 1.0, 2, sided=True).orderBy("timestamp").collect()
    assert [(r.label, None if r.ret_trade is None else round(r.ret_trade, 9)) for r in got[:4]] == [(0, -0.01), (0, -0.01), (None, None), (None, None)]


def test_next_bar(spark):
    out = labels.next_bar(frame(spark, [100, 101, 100.5, 100.5, 102])).orderBy("timestamp").collect()
    assert [r.y for r in out] == [1, 0, 0, 1, None]


def test_settings():
    with pytest.raises(ValueError, match="purge"):
        Settings(target=TargetSpec("triple_barrier", max_holding=10), purge=6)
    with pytest.raises(ValueError, match="band"):
        Settings(band=0.5)
    with pytest.raises(ValueError, match="target"):
        TargetSpec("other")


def test_settings_file(tmp_path, monkeypatch):
    f = tmp_path / "x.yaml"
    f.write_text("")
    assert load(str(f)) == Settings()
    f.write_text("timeframe: 4h\nfeatures: {momentum: [2]}\ntarget: {kind: triple_barrier, max_holding: 3}\n")
    monkeypatch.setenv("TIDEMARK_CONFIG", str(f))
    assert load().timeframe == "4h"
    assert load().features.momentum == (2,)


def test_folds(spark):
    df = spark.range(1000).selectExpr("'s' as symbol", "id as timestamp")
    splits.check_folds(df, 4, 100, 500, 10)
    with pytest.raises(ValueError, match="too few"):
        splits.check_folds(df, 4, 100, 700, 10)
    roles = splits.assign(df, 4, 100, 10).collect()
    for fold in range(4):
        train = [r.pos for r in roles if r.fold == fold and r.role == "train"]
        test = sorted(r.pos for r in roles if r.fold == fold and r.role == "test")
        assert test == list(range(600 + 100 * fold, 700 + 100 * fold))
        assert max(train) == test[0] - 11
        assert min(train) == 0


def test_drawdown_and_sharpe(spark):
    df = spark.createDataFrame([("s", "m", 0, 0.10), ("s", "m", 1, -0.20), ("s", "one", 0, 0.1), ("s", "flat", 0, 0.1), ("s", "flat", 1, 0.1)], "symbol string, model string, timestamp long, net double")
    eq = backtest.equity_curve(df)
    low = {r.model: r["min(drawdown)"] for r in eq.groupBy("model").agg({"drawdown": "min"}).collect()}
    assert abs(low["m"] + 0.2) < 1e-12
    sharpe = {r.model: r.s for r in df.groupBy("model").agg(backtest.sharpe("net", 10.0).alias("s")).collect()}
    assert sharpe["one"] is None
    assert sharpe["flat"] is None


def test_fee_once_and_flips(spark):
    rows = [("s", "m", i, p, 0.0) for i, p in enumerate([0.6, 0.7, 0.4, 0.5, 0.9])]
    out = backtest.strategy_returns(spark.createDataFrame(rows, "symbol string, model string, timestamp long, p_up double, ret_next double"), 0.001).orderBy("timestamp").collect()
    assert [r.change for r in out] == [1, 0, 2, 1, 1]
    assert sum(r.change for r in out) == 5


def test_auc_ties(spark):
    rng = random.Random(1)
    rows = [("s", "m", i % 2, rng.randint(0, 1), rng.randint(0, 4) / 4) for i in range(80)] + [("s", "m", 9, 1, 0.4)]
    got = {r.fold: r.auc for r in scoring.fold_metrics(spark.createDataFrame(rows, "symbol string, model string, fold long, y long, p_up double")).collect()}
    for fold in (0, 1):
        pos = [r[4] for r in rows if r[2] == fold and r[3]]
        neg = [r[4] for r in rows if r[2] == fold and not r[3]]
        assert abs(got[fold] - sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / len(pos) / len(neg)) < 1e-12
    assert got[9] is None


def test_calibration_edges(spark):
    rows = [("s", "m", 1, p) for p in (0.0, 0.3, 0.30000000000000004, 0.6, 1.0)]
    out = {round(r.bin_low, 3): r["count"] for r in scoring.calibration(spark.createDataFrame(rows, "symbol string, model string, y long, p_up double")).collect()}
    assert out == {0.0: 1, 0.2: 1, 0.3: 1, 0.5: 1, 0.9: 1}


def signals(spark, rows):
    return spark.createDataFrame([("s", "m", *r) for r in rows], "symbol string, model string, timestamp long, p_up double, ret_trade double, holding_bars long, side long")


def test_fixed_trades(spark):
    bar = 14_400_000
    df = signals(spark, [(0, 0.6, 0.05, 3, 1), (bar, 0.9, 0.5, 1, 1), (2 * bar, 0.2, 0.5, 1, 1), (3 * bar, 0.3, 0.02, 2, -1), (4 * bar, 0.5, 1.0, 1, 1), (5 * bar, 0.7, -0.01, 1, 0)])
    out = trades.fixed_trades(df, bar, 0.001).orderBy("entry_ts").collect()
    assert [(r.entry_ts // bar, r.direction, r.holding_bars) for r in out] == [(0, 1, 3), (3, -1, 2), (5, 1, 1)]
    assert [round(r.ret_net, 9) for r in out] == [0.048, -0.022, -0.012]
    sided = trades.fixed_trades(df, bar, 0.0, sided=True).orderBy("entry_ts").collect()
    assert [(r.entry_ts // bar, r.direction, r.ret_gross) for r in sided] == [(0, 1, 0.05)]
    m = trades.trade_metrics(trades.fixed_trades(df.where("p_up = 0.5"), bar, 0.0), df, bar).first()
    assert (m.n_trades, m.win_rate, m.exposure, m.trades_per_year) == (0.0, None, 0.0, 0.0)


def path(closes, ps, sides, spread=0.0, highs=None):
    return [(i, p, s, (highs or {}).get(i, c + spread), c - spread, c, 0.01) for i, (c, p, s) in enumerate(zip(closes, ps, sides, strict=True))]


def test_trailing_trades():
    run = lambda rows, **k: brute.trailing_path(rows, 1, 0.0, 2.0, 1.0, 10, **k)
    (t,) = run(path([100, 101.5, 100.4, 100.4], [0.9, 0.9, 0.1, 0.1], [1, 1, 1, 1]))
    assert (t[7], t[8], round(t[6], 9)) == ("sl", 1, round(101.5 * 0.99, 9))
    (t,) = run(path([100, 103], [0.9, 0.1], [1, 1]))
    assert (t[7], round(t[9], 9)) == ("tp", 0.02)
    (t,) = run(path([100, 97], [0.9, 0.1], [-1, -1]))
    assert (t[2], t[7], round(t[9], 9)) == (-1, "tp", 0.02)
    (t,) = run(path([100] * 12, [0.9] + [0.1] * 11, [1] * 12))
    assert (t[7], t[3], t[9]) == ("vertical", 10, 0.0)
    both = path([100, 100], [0.9, 0.1], [1, 1], spread=5.0)
    assert run(both)[0][7] == "sl"
    assert run(path([100, 100.1], [0.9, 0.9], [1, 1])) == []
    again = run(path([100, 103, 103, 106], [0.9, 0.9, 0.1, 0.1], [1, 1, 1, 1]))
    assert [(x[0], x[7]) for x in again] == [(0, "tp"), (1, "tp")]


@pytest.mark.parametrize("rows_", [4096, 11])
def test_trailing_query(spark, rows_):
    """In one block, and in many."""
    rows = path(walk(60), [0.9 if i % 3 else 0.4 for i in range(60)], [1 if i % 7 else -1 for i in range(60)], spread=0.4)
    df = spark.createDataFrame([("s", m, *r) for m in "ab" for r in rows], "symbol string, model string, timestamp long, p_up double, side long, high double, low double, close double, sigma double")
    got = trades.trailing_trades(df, 1, 0.001, 2.0, 1.0, 10, rows=rows_).collect()
    want = brute.trailing_path(rows, 1, 0.001, 2.0, 1.0, 10)
    assert sorted(tuple(r)[2:] for r in got if r.model == "a") == sorted(want)
    assert len(got) == 2 * len(want) > 0


@pytest.mark.parametrize("span, fan", [(7, 2), (40, 3), (1000, 512)])
def test_one_at_a_time(spark, span, fan, monkeypatch):
    """Blocks shorter than trades, several blocks of blocks, and one block."""
    monkeypatch.setattr(chains, "FAN", fan)
    rng = random.Random(span)
    rows = [(k, e, e + rng.choice([1, 2, 3, 9, 25]), f"{k}{e}") for k in "ab" for e in sorted(rng.sample(range(-50, 400), 170))]
    rows += [("c", 5, 6, "x"), ("d", 0, 900, "y"), ("d", 3, 4, "n"), ("d", 900, 901, "z")]
    df = spark.createDataFrame(rows, "symbol string, entry_ts long, exit_ts long, name string")
    got = sorted(tuple(r) for r in chains.one_at_a_time(df, ("symbol",), span).collect())
    assert got == sorted((k, *r) for k in "abcd" for r in brute.single_position([r[1:] for r in rows if r[0] == k]))


def test_trades_run_without_python_workers(spark):
    rows = path(walk(20), [0.9] * 20, [1] * 20)
    df = spark.createDataFrame([("s", "a", *r) for r in rows], "symbol string, model string, timestamp long, p_up double, side long, high double, low double, close double, sigma double")
    plans = [trades.trailing_trades(df, 1, 0.0, 2.0, 1.0, 10), trades.fixed_trades(signals(spark, [(0, 0.6, 0.05, 3, 1)]), 1, 0.0)]
    for d in plans:
        text = d._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_naive_models(spark):
    rows = [("s", i, [1.0, 1.0, 1.0, 1.0, -1.0, -1.0, -1.0, -1.0, -1.0, -1.0][i % 10], [1, 1, 1, 0, 1, 0, 0, 0, 1, 1][i % 10]) for i in range(20)] + [("s", 20, 1.0, 1), ("s", 21, -1.0, 0)]
    out = {(r.model, r.timestamp): r.p_up for r in models.naive_predictions(spark.createDataFrame(rows, "symbol string, timestamp long, ret_1 double, y long"), 1, 2, 0).collect()}
    assert out == {("prior", 20): 0.6, ("prior", 21): 0.6, ("momentum_sign", 20): 0.75, ("momentum_sign", 21): 0.5}


def test_tree_shap_adds_up():
    rng = random.Random(3)

    def grow(depth, cover, nodes):
        at = len(nodes)
        nodes.append(None)
        if depth == 0:
            nodes[at] = (-1, 0.0, -1, -1, rng.gauss(0, 1), cover)
        else:
            left = cover * rng.uniform(0.2, 0.8)
            f, t = rng.randrange(3), rng.gauss(0, 0.5)
            a = grow(depth - 1, left, nodes)
            b = grow(depth - 1, cover - left, nodes)
            nodes[at] = (f, t, a, b, 0.0, cover)
        return at

    def value(nodes, x, known, at=0):
        f, t, a, b, v, c = nodes[at]
        if f < 0:
            return v
        if f in known:
            return value(nodes, x, known, a if x[f] <= t else b)
        return (nodes[a][5] * value(nodes, x, known, a) + nodes[b][5] * value(nodes, x, known, b)) / c

    for _ in range(10):
        nodes = []
        grow(4, 100.0, nodes)
        x = [rng.gauss(0, 1) for _ in range(3)]
        tree = {k: np.array(v) for k, v in zip(("feature", "threshold", "left", "right", "value", "cover"), zip(*nodes, strict=True), strict=True)}
        (phi,), mean = boosting.shapley(tree, np.array([x]))
        assert abs(phi.sum() + mean - value(nodes, x, {0, 1, 2})) < 1e-9
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value(nodes, x, {*s, i}) - value(nodes, x, set(s))) for k in range(3) for s in itertools.combinations(rest, k))
            assert abs(phi[i] - want) < 1e-9


def test_boosted_trees_contributions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("s", i, a, b, int(a + 0.3 * rng.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, "symbol string, timestamp long, a double, b double, y long")
    names = ["a", "b"]
    fitted = models.fit(df, names, "gbt", 1, 50, 1, rounds=20).cache()
    imp = {r.feature: r.importance for r in models.importances(fitted, names, "gbt", 0).collect()}
    assert imp["a"] > 10 * imp["b"] >= 0
    found = models.predict(df, fitted, names, "gbt", 1, 50).collect()
    p = {r.timestamp: r.p_up for r in found}
    assert len(p) == 50 and sum((r.p_up > 0.5) == (r.y == 1) for r in found) >= 40
    for r in models.contributions(df, fitted, names, "gbt", 1, 50).collect():
        assert abs(r.a + r.b + r.bias - math.log(p[r.timestamp] / (1 - p[r.timestamp]))) < 1e-6


def test_logistic_is_at_its_optimum(spark, monkeypatch):
    """Models of several series and folds, one of a single class, whether their table is sent to the rows or joined with them."""
    rng = np.random.default_rng(2)
    names, data, rows = ["a", "b", "c"], {}, []
    for key in (("s", 0), ("s", 1), ("t", 0)):
        x = np.column_stack([rng.normal(3, 5, 300), rng.normal(0, 0.01, 300), np.ones(300)])
        y = (x[:, 0] - 3 + rng.normal(0, 3, 300) > 0).astype(int)
        data[key] = x, y
        rows += [(*key, int(v), *map(float, u)) for u, v in zip(x, y, strict=True)]
    rows += [("one", 0, 1, float(i), 0.0, 1.0) for i in range(30)]
    train = spark.createDataFrame(rows, "symbol string, fold long, y long, a double, b double, c double").repartition(5)
    for sent in (20_000, 0):
        monkeypatch.setattr(logistic, "SENT", sent)
        fitted = {(r.symbol, r.fold): r for r in logistic.fit(train, names).collect()}
        assert set(fitted) == {*data, ("one", 0)}
        for key, (x, y) in data.items():
            r = fitted[key]
            z = (x - np.array(r.means)) / np.array(r.scales)
            w = np.array(r.weights)
            p = 1 / (1 + np.exp(-(z @ w + r.bias)))
            assert np.allclose(r.means, x.mean(0)) and np.allclose(r.scales, [*x.std(0)[:2], 1.0])
            assert np.abs(z.T @ (p - y) + w).max() < 1e-5 and abs((p - y).sum()) < 1e-5
            assert w[0] > 1 and w[2] == 0
        assert fitted["one", 0].weights == [0, 0, 0] and fitted["one", 0].bias > 30
    assert logistic.fit(train.limit(0), names).count() == 0


def test_trees_are_grown_by_the_best_gain():
    """The first split of a tree is that of brute force, every leaf has its least number of rows, and limits hold."""
    rng = np.random.default_rng(4)
    x, n = rng.normal(0, 1, (240, 3)).round(1), 240
    y = ((x[:, 1] > 0.3) ^ (rng.random(n) < 0.1)).astype(float)
    nodes = boosting.boost(x, y, rounds=1, leaves=6, least=20, rows=1.0, columns=1.0)
    _, (tree,) = boosting.trees(nodes)
    slope, h = y.mean() - y, y.mean() * (1 - y.mean())

    def gain(f, t):
        low = x[:, f] <= t
        side = lambda k: slope[k].sum() ** 2 / (h * k.sum())
        return side(low) + side(~low) if min(low.sum(), n - low.sum()) >= 20 else -1

    best = max((gain(f, t), -f, -t) for f in range(3) for t in np.unique(x[:, f]))
    assert tree["feature"][0] == -best[1] and abs(tree["gain"][0] - best[0]) < 1e-9
    leaves = tree["feature"] < 0
    assert leaves.sum() <= 6 and tree["cover"][leaves].min() >= 20 and tree["cover"][leaves].sum() == n
    assert len(boosting.trees(boosting.boost(x, np.ones(n), rounds=5))[1]) == 0
