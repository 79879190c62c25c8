"""Paging, the lake, run folders, ingestion and streams."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fake_exchange as fx

from tidemark import queries
from tidemark.operators import candles
from tidemark.plans import benchmark, dataset, ingest
from tidemark.sources import exchange, lake, runs
from tidemark.sources.ticks import ticks
from tidemark.streaming.bars import insert_batches


def get(client, since, until, limit=100):
    return list(exchange.pages(client, "X", "1m", since, until, limit, attempts=3, sleep=lambda s: None))


def test_pages():
    rows = get(fx.Grid(), fx.T0, fx.T0 + 250 * fx.MINUTE)
    assert [r[0] for r in rows] == [fx.T0 + k * fx.MINUTE for k in range(250)]
    assert len(get(fx.Grid(), fx.T0, fx.T0 + 10 * fx.MINUTE)) == 10
    late = fx.T0 + 500 * fx.MINUTE
    assert get(fx.Grid(late, late + 50 * fx.MINUTE), fx.T0, late + 50 * fx.MINUTE)[0][0] == late


def test_retries():
    waits = []
    assert exchange.with_retries(lambda c=fx.Grid(fail=2): c.fetch("X", "1m", fx.T0, 10), 5, 0.01, 0.05, waits.append)
    assert len(waits) == 2
    assert 0.005 <= waits[0] < 0.015
    assert 0.01 <= waits[1] < 0.03
    with pytest.raises(exchange.NetworkError):
        exchange.with_retries(lambda c=fx.Grid(fail=9): c.fetch("X", "1m", fx.T0, 10), 3, sleep=waits.append)
    with pytest.raises(ZeroDivisionError):
        exchange.with_retries(lambda: 1 / 0, 3, sleep=waits.append)


def test_rows_to_frame(spark):
    df = exchange.from_rows(spark, [[2000.0, 1, 2, 0.5, 1.5, 10], [1000.0, 1, 2, 0.5, 1.5, 10]], "X")
    assert dict(df.dtypes)["timestamp"] == "bigint"
    assert exchange.from_rows(spark, [], "X").dtypes == df.dtypes


@pytest.fixture
def on_path():
    old = os.environ.get("PYTHONPATH")
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(__file__), old or ""])
    yield
    os.environ["PYTHONPATH"] = old or ""


def test_data_source_reader():
    reader = exchange.ExchangeReader({"client": "fake_exchange:grid", "symbol": "X", "timeframe": "1m", "since": str(fx.T0), "until": str(fx.T0 + 250 * fx.MINUTE), "page_limit": "50", "pages_per_task": "2"})
    parts = reader.partitions()
    assert len(parts) == 3
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[1] for r in rows] == [fx.T0 + k * fx.MINUTE for k in range(250)]


def test_lake(spark, tmp_path):
    root = str(tmp_path / "lake")
    jan, feb = 1577836800000, 1580515200000
    rows = [("X", t, 1.0, 2.0, 0.5, 1.5, 10.0, n) for n, t in enumerate([jan, jan + 60_000, jan, feb])]
    df = spark.createDataFrame(rows, exchange.SCHEMA)
    assert lake.months(spark, root) == set()
    lake.write_months(df, root)
    assert lake.months(spark, root) == {(2020, 1), (2020, 2)}
    assert os.path.isdir(f"{root}/symbol=X/year=2020/month=01")
    assert lake.read_lake(spark, root).count() == 3
    assert lake.last_timestamp(lake.read_month(spark, root, 2020, 1)) == jan + 60_000
    assert not lake.is_complete(spark, root, "X", 2020, 1, 60_000)
    lake.write_months(spark.createDataFrame([("X", feb - 60_000, 1.0, 2.0, 0.5, 1.5, 10.0, 0)], exchange.SCHEMA), root)
    assert lake.is_complete(spark, root, "X", 2020, 1, 60_000)
    assert lake.read_lake(spark, root).count() == 2
    assert not lake.is_complete(spark, root, "X", 2020, 3, 60_000)
    # another symbol's months are its own
    assert not lake.is_complete(spark, root, "A/B", 2020, 1, 60_000)
    lake.write_months(spark.createDataFrame([("A/B", feb - 60_000, 1.0, 2.0, 0.5, 1.5, 10.0, 0)], exchange.SCHEMA), root)
    assert lake.is_complete(spark, root, "A/B", 2020, 1, 60_000) and lake.is_complete(spark, root, "X", 2020, 1, 60_000)
    assert sorted((r.symbol, r.timestamp) for r in lake.read_lake(spark, root).collect()) == [("A/B", feb - 60_000), ("X", feb - 60_000), ("X", feb)]
    assert lake.months(spark, root, "A/B") == {(2020, 1)}
    os.makedirs(f"{root}/symbol=X/year=x/month=1")
    assert lake.last_timestamp(df.limit(0)) is None


def test_ingestion(spark, tmp_path, monkeypatch):
    calls = []

    def fetch(spark, client, symbol, timeframe, since, until, **options):
        calls.append((since, until))
        return exchange.from_rows(spark, list(exchange.pages(fx.Grid(step=900_000, stop=fx.T0 + 10**9), symbol, timeframe, since, until)), symbol)

    monkeypatch.setattr(ingest, "read_exchange", fetch)
    from datetime import date

    root, now = str(tmp_path / "lake"), fx.T0 + 2 * 86_400_000
    n = ingest.backfill(spark, "c:f", "X", root, date(2020, 9, 1), date(2020, 9, 30), now, "15m")
    assert n == lake.read_lake(spark, root).count() > 100
    assert ingest.backfill(spark, "c:f", "Y", root, date(2020, 9, 1), date(2020, 9, 30), now, "15m") == n
    assert {r.symbol: r["count"] for r in lake.read_lake(spark, root).groupBy("symbol").count().collect()} == {"X": n, "Y": n}
    table = str(tmp_path / "table")
    first = ingest.incremental(spark, "c:f", "X", table, now)
    assert first == 191  # the grid begins within the first 15 minutes
    assert ingest.incremental(spark, "c:f", "X", table, now) == 0
    assert ingest.incremental(spark, "c:f", "X", table, now + 4 * 900_000) == 4
    assert ingest.incremental(spark, "c:f", "X", table, now + 8 * 900_000, dry_run=True) == 0
    with pytest.raises(RuntimeError, match="no closed"):
        ingest.incremental(spark, "c:f", "X", table, fx.T0 - 10**9)


def test_insert_batches(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda ts: spark.createDataFrame([("X", t, 1.0, 2.0, 0.5, 1.5, 1.0, n) for n, t in enumerate(ts)], exchange.SCHEMA)
    for ts in ([1, 2, 2], [2, 3]):
        make(ts).coalesce(1).write.mode("append").parquet(src)
        insert_batches(spark.readStream.schema(exchange.SCHEMA).parquet(src), path, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.timestamp for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_run_folder(spark, tmp_path, tiny):
    s = dataset.Settings(n_splits=2, test_size=20, min_train=20)
    rows = candles.keep_first(ticks(spark, tiny)).where("symbol in ('click', 'view')")
    with pytest.raises(ValueError, match="unknown models"):
        benchmark.forecasts(rows, s, ("other",))
    path = benchmark.run(spark, rows, s, str(tmp_path), ("prior", "momentum_sign", "logreg"))
    assert runs.list_runs(spark, str(tmp_path)) == [os.path.basename(path)]
    os.makedirs(tmp_path / "run_broken")
    assert len(runs.list_runs(spark, str(tmp_path))) == 1
    assert runs.list_runs(spark, str(tmp_path / "nothing")) == []
    r = runs.load_run(spark, str(tmp_path), os.path.basename(path))
    assert {x.model for x in r.predictions.select("model").distinct().collect()} == {"prior", "momentum_sign", "logreg"}
    assert r.bars.count() > 0
    p = {(x.symbol, x.timestamp): x.p_up for x in r.predictions.where("model = 'logreg'").collect()}
    found = r.contributions.collect()
    assert len(found) == len(p) > 0
    for x in found:
        odds = sum(v for k, v in x.asDict().items() if k not in ("model", "fold", "symbol", "timestamp"))
        assert abs(1 / (1 + math.exp(-odds)) - p[x.symbol, x.timestamp]) < 1e-9
    assert r.trades.count() > 0 and r.fold_backtest.count() == 3 * 2 * 2
    assert set(r.importances) == {"logreg"}
    assert r.metrics["results"]["pooled_backtest"]


@pytest.mark.parametrize("name", ["bars_1h", "price_features", "triple_barrier", "fold_metrics", "fixed_trades", "trade_metrics", "streamed_closed_bars"])
def test_against_sql(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tiny}/events.parquet'")
    df = queries.QUERIES[name](spark, tiny)
    o = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in o.description]
    at = [names.index(c) for c in df.columns]
    text = lambda v: "null" if v is None or v != v else f"{float(v):.9g}" if not isinstance(v, str | bool) else str(v)
    assert sorted(tuple(text(v) for v in r) for r in df.collect()) == sorted(tuple(text(r[i]) for i in at) for r in o.fetchall())


def test_every_query_names_its_columns_like_its_sql():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_trailing_policy(spark, tiny):
    with pytest.raises(ValueError, match="sides"):
        dataset.Settings(policy="trailing")
    s = dataset.Settings(n_splits=2, test_size=20, min_train=20, policy="trailing", target=dataset.TargetSpec(kind="meta_triple_barrier"))
    df = dataset.samples(candles.keep_first(ticks(spark, tiny)).where("symbol = 'click'"), s).cache()
    pred, _ = benchmark.forecasts(df, s, ("prior", "momentum_sign"))
    out = benchmark.report(pred.withColumn("p_up", pred.p_up + 0.4), s, df)
    assert {"exit_reason", "n_updates"} <= set(out["trades"].columns)
    assert out["trades"].count() > 0
    assert out["trade_backtest"].count() == 2


def test_incremental_fetches_once(spark, tmp_path):
    """48 hours of quarters of an hour are one page, and one call."""
    spark.sparkContext.addPyFile(fx.__file__)
    log = tmp_path / "calls"
    ask = lambda: ingest.incremental(spark, "fake_exchange:Logged", "X", str(tmp_path / "table"), fx.T0, base_url=str(log))
    assert ask() == 192 and len(log.read_text()) == 1
    assert ask() == 0 and len(log.read_text()) == 2
