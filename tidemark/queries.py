"""The engine's queries over the test tables: name -> (spark, sf_dir) -> DataFrame, and the SQL that says the same."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions.steps import pinned
from .functions.timeframes import date_ms, month_rows
from .operators import backtest, candles, features, labels, logistic, models, scoring, splits, trades
from .plans import dataset
from .sources.ticks import ticks

HOUR = o.HOUR
SETTINGS = dataset.Settings()
BARRIER = dataset.Settings(target=dataset.TargetSpec("triple_barrier"))
META = dataset.Settings(target=dataset.TargetSpec("meta_triple_barrier"))
NOW_MS = date_ms(date(2024, 1, 20)) + 5 * 60_000

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pick(df: DataFrame, plain: str, real: str = "", digits: int = 8) -> DataFrame:
    """Columns as they are, and others rounded for comparison (and -0 as 0)."""
    names = lambda s: [c.strip() for c in s.split(",") if c.strip()]
    return df.select(*names(plain), *((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) for c in names(real)))


def _candles(spark: SparkSession, d: str) -> DataFrame:
    return candles.keep_first(ticks(spark, d))


def _bars(spark: SparkSession, d: str, tf: str = "1h") -> DataFrame:
    return candles.to_bars(_candles(spark, d), tf)


#: Rows of a block in the queries of features and labels: few, so that results cross many of them.
ROWS = 64


def _samples(spark: SparkSession, d: str, s: dataset.Settings = SETTINGS) -> DataFrame:
    return dataset.samples(_candles(spark, d), s)


def _pred(spark: SparkSession, d: str) -> DataFrame:
    s = SETTINGS
    return pinned(models.naive_predictions(_samples(spark, d), s.n_splits, s.test_size, s.purge))


def _trades(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pred = _pred(spark, d).withColumn("ret_trade", F.col("ret_next"))
    return pinned(trades.fixed_trades(pred, HOUR, SETTINGS.fee)), pred


#: The test tables' returns are huge, so equity is compared on a signed logarithmic scale.
_LOG_SQL = "round(sign(equity) * log10(1 + abs(equity)), 6) + 0.0 as log_equity"


def _log_equity() -> Column:
    return F.signum("equity") * F.log10(1 + F.abs("equity"))


# candles and bars

OHLCV = "symbol, timestamp, open, high, low, close, volume"


@query(f"with {o.TICKS} select {OHLCV} from (select *, row_number() over (partition by symbol, timestamp order by seq desc) as rn from ticks) where rn = 1")
def candles_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return pick(candles.keep_last(ticks(spark, d)), OHLCV)


@query(f"with {o.TICKS}, {o.FIRST} select {OHLCV} from candles")
def candles_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return pick(_candles(spark, d), OHLCV)


@query(f"with {o.TICKS}, {o.FIRST} select {OHLCV} from candles where timestamp + 900000 <= {NOW_MS}")
def candles_closed(spark: SparkSession, d: str) -> DataFrame:
    return pick(candles.closed(_candles(spark, d), "15m", NOW_MS), OHLCV)


@query(f"with {o.TICKS} select symbol, count(*) as n, min(timestamp) as first_timestamp, max(timestamp) as last_timestamp from ticks where timestamp >= {date_ms(date(2024, 1, 5))} and timestamp < {date_ms(date(2024, 1, 9))} group by symbol")
def candles_within(spark: SparkSession, d: str) -> DataFrame:
    df = candles.within(ticks(spark, d), date_ms(date(2024, 1, 5)), date_ms(date(2024, 1, 9)))
    return df.groupBy("symbol").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))


@query(f"{o.BASE} select symbol, timestamp, open, high, low, close, {o.rounded('volume')}, n_candles from bars")
def bars_1h(spark: SparkSession, d: str) -> DataFrame:
    return pick(_bars(spark, d), "symbol, timestamp, open, high, low, close, n_candles", "volume")


@query(f"with {o.TICKS}, {o.FIRST}, {o.bars('bars', 4 * HOUR, 0, 2)} select symbol, timestamp, open, high, low, close, {o.rounded('volume')}, n_candles from bars")
def bars_4h_complete(spark: SparkSession, d: str) -> DataFrame:
    return pick(candles.to_bars(_candles(spark, d), "4h", 2), "symbol, timestamp, open, high, low, close, n_candles", "volume")


@query(f"with {o.TICKS}, {o.FIRST}, {o.bars('bars', 7 * 24 * HOUR, 4 * 24 * HOUR)} select symbol, timestamp, open, high, low, close, {o.rounded('volume')}, n_candles from bars")
def bars_1w_monday(spark: SparkSession, d: str) -> DataFrame:
    return pick(_bars(spark, d, "1w"), "symbol, timestamp, open, high, low, close, n_candles", "volume")


@query(f"{o.BASE}, ends as (select symbol, min(timestamp) as a, max(timestamp) as b from bars group by symbol), grid as (select symbol, unnest(range(a, b + 1, {HOUR})) as timestamp from ends) select symbol, timestamp from grid anti join bars using (symbol, timestamp)")
def candle_gaps(spark: SparkSession, d: str) -> DataFrame:
    return candles.gaps(_bars(spark, d), "1h")


@query(
    f"""{o.BASE}, ends as (select symbol, min(timestamp) as a, max(timestamp) as b from bars group by symbol), grid as (select symbol, unnest(range(a, b + 1, {HOUR})) as timestamp from ends),
missing as (select symbol, timestamp, timestamp - row_number() over (partition by symbol order by timestamp) * {HOUR} as g from grid anti join bars using (symbol, timestamp))
select symbol, min(timestamp) as start, max(timestamp) as "end", count(*) as n from missing group by symbol, g"""
)
def candle_gap_ranges(spark: SparkSession, d: str) -> DataFrame:
    return candles.gap_ranges(candles.gaps(_bars(spark, d), "1h"), "1h")


_BROKEN = {"open": "seq % 7 = 0", "volume": "seq % 11 = 0", "high": "seq % 5 = 0", "low": "seq % 13 = 0"}
_BROKEN_SQL = f"""with {o.TICKS}, t as (select symbol, timestamp - timestamp % 60000 as timestamp, case when seq % 7 = 0 then -open else open end as open, case when seq % 5 = 0 then high / 2 else high end as high,
  case when seq % 13 = 0 then low * 2 else low end as low, close, case when seq % 11 = 0 then -1 else volume end as volume from ticks)"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    bad = F.expr
    return ticks(spark, d).withColumns(
        {
            "timestamp": bad("timestamp - timestamp % 60000"),
            "open": F.when(bad("seq % 7 = 0"), -F.col("open")).otherwise(F.col("open")),
            "high": F.when(bad("seq % 5 = 0"), F.col("high") / 2).otherwise(F.col("high")),
            "low": F.when(bad("seq % 13 = 0"), F.col("low") * 2).otherwise(F.col("low")),
            "volume": F.when(bad("seq % 11 = 0"), F.lit(-1.0)).otherwise(F.col("volume")),
        }
    )


@query(
    _BROKEN_SQL
    + """, c as (select count(*) filter (not timestamp > 0) as timestamp_positive, count(*) filter (not open > 0) as open_positive, count(*) filter (not high > 0) as high_positive, count(*) filter (not low > 0) as low_positive,
  count(*) filter (not close > 0) as close_positive, count(*) filter (not volume >= 0) as volume_not_negative, count(*) filter (not low <= least(open, close)) as low_below_body,
  count(*) filter (not high >= greatest(open, close)) as high_above_body, count(*) - count(distinct (symbol, timestamp)) as timestamp_unique from t)
select "check", failures from (unpivot c on columns(*) into name "check" value failures)"""
)
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    return candles.check_counts(_broken(spark, d))


@query(
    _BROKEN_SQL
    + """ select symbol, timestamp, unnest(list_filter([case when not open > 0 then 'open_positive' end, case when not volume >= 0 then 'volume_not_negative' end, case when not low <= least(open, close) then 'low_below_body' end,
  case when not high >= greatest(open, close) then 'high_above_body' end], lambda x: x is not null)) as "check" from t"""
)
def validation_violations(spark: SparkSession, d: str) -> DataFrame:
    return candles.violations(_broken(spark, d))


@query(f"with {o.TICKS}, old as (select distinct symbol, timestamp from ticks where seq % 3 = 0), new as (select * from (select *, row_number() over (partition by symbol, timestamp order by seq desc) as rn from ticks where seq % 2 = 0) where rn = 1) select {OHLCV} from new anti join old using (symbol, timestamp)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    df = ticks(spark, d)
    return pick(candles.insert_if_absent(df.where("seq % 2 = 0"), df.where("seq % 3 = 0")), OHLCV)


@query(
    f"""with {o.TICKS}, m as (select symbol, year(make_timestamp(timestamp * 1000)) as year, month(make_timestamp(timestamp * 1000)) as month, max(timestamp) as last_timestamp, count(*) as n_candles from ticks group by all)
select symbol, cast(year as int) as year, cast(month as int) as month, last_timestamp, n_candles, last_timestamp >= epoch_ms(make_date(year, month, 1) + interval 1 month) - 900000 as complete from m"""
)
def month_completeness(spark: SparkSession, d: str) -> DataFrame:
    return candles.month_completeness(ticks(spark, d), "15m")


@query("with e as (select o_orderpriority, o_orderstatus, min(o_orderdate) as a, max(o_orderdate) as b from orders group by all), m as (select o_orderpriority, o_orderstatus, unnest(range(date_trunc('month', a)::timestamp, date_trunc('month', b)::timestamp + interval 1 day, interval 1 month)) as m from e) select o_orderpriority, o_orderstatus, cast(year(m) as int) as year, cast(month(m) as int) as month from m")
def month_partitions(spark: SparkSession, d: str) -> DataFrame:
    return month_rows(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate", "o_orderpriority", "o_orderstatus")


@query(f"with {o.TICKS} select distinct symbol from ticks")
def distinct_symbols(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).select("symbol").distinct()


# features

@query(f"{o.BASE}, {o.RET}, {o.FEATURES} select symbol, timestamp, {o.rounded(o.FEATURE_COLUMNS)} from feat")
def price_features(spark: SparkSession, d: str) -> DataFrame:
    return pick(features.price_features(_bars(spark, d), (3, 6), (6, 12), (6,), (6, 12), ROWS), "symbol, timestamp", o.FEATURE_COLUMNS)


@query(f"{o.BASE}, {o.RSI} select symbol, timestamp, {o.rounded('rsi_14')} from rsi")
def rsi_wilder(spark: SparkSession, d: str) -> DataFrame:
    return pick(features.rsi(_bars(spark, d), 14, ROWS), "symbol, timestamp", "rsi_14")


@query(
    f"""{o.BASE}, n as (select *, row_number() over (partition by symbol order by timestamp) as k, count(*) over (partition by symbol) as total from bars),
ph as (select a.symbol, a.k + 2 as known, a.high as v from n a where a.k > 2 and a.k + 2 <= a.total and a.high > all (select b.high from n b where b.symbol = a.symbol and b.k <> a.k and abs(b.k - a.k) <= 2)),
pl as (select a.symbol, a.k + 2 as known, a.low as v from n a where a.k > 2 and a.k + 2 <= a.total and a.low < all (select b.low from n b where b.symbol = a.symbol and b.k <> a.k and abs(b.k - a.k) <= 2)),
hh as (select n.symbol, n.k, arg_max(p.v, p.known) as v from n join ph p on p.symbol = n.symbol and p.known <= n.k group by n.symbol, n.k),
ll as (select n.symbol, n.k, arg_max(p.v, p.known) as v from n join pl p on p.symbol = n.symbol and p.known <= n.k group by n.symbol, n.k)
select n.symbol, timestamp, round(hh.v / close - 1, 8) as pivot_high_dist_2, round(ll.v / close - 1, 8) as pivot_low_dist_2 from n left join hh using (symbol, k) left join ll using (symbol, k)"""
)
def pivot_distances(spark: SparkSession, d: str) -> DataFrame:
    return pick(features.pivots(_bars(spark, d), 2, ROWS), "symbol, timestamp", "pivot_high_dist_2, pivot_low_dist_2")


@query(f"{o.BASE}, c as (select symbol, timestamp, (timestamp // 3600000) % 24 as h, (timestamp // 86400000 + 4) % 7 as w from bars) select symbol, timestamp, round(sin(2 * pi() * h / 24), 8) + 0.0 as hour_sin, round(cos(2 * pi() * h / 24), 8) + 0.0 as hour_cos, round(sin(2 * pi() * w / 7), 8) + 0.0 as dow_sin, round(cos(2 * pi() * w / 7), 8) + 0.0 as dow_cos from c")
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return pick(features.calendar(_bars(spark, d)), "symbol, timestamp", "hour_sin, hour_cos, dow_sin, dow_cos")


@query(f"{o.BASE}, x as (select *, ln(1 + volume) as lv from bars), z as (select *, {o.rolling('m', 'avg', 'lv', 5, 1)}, {o.rolling('s', 'stddev_samp', 'lv', 5, 1)} from x) select symbol, timestamp, round((lv - m) / nullif(s, 0), 8) as volume_z_6 from z")
def volume_z_scores(spark: SparkSession, d: str) -> DataFrame:
    return pick(features.volume_z(_bars(spark, d), (6,), ROWS), "symbol, timestamp", "volume_z_6")


# labels

@query(f"{o.BASE}, n as (select *, lead(close) over (partition by symbol order by timestamp) as nx from bars) select symbol, timestamp, case when nx is not null then cast(nx > close as bigint) end as y, round(nx / close - 1, 8) as ret_next from n")
def next_bar_target(spark: SparkSession, d: str) -> DataFrame:
    return pick(labels.next_bar(_bars(spark, d), ROWS), "symbol, timestamp, y", "ret_next")


@query(f"{o.BASE}, {o.RET}, {o.SIGMA} select b.symbol, b.timestamp, {o.rounded('sigma')} from bars b left join sg using (symbol, timestamp)")
def ewma_volatility(spark: SparkSession, d: str) -> DataFrame:
    return pick(labels.ewma_volatility(_bars(spark, d), 12, ROWS), "symbol, timestamp", "sigma")


@query(f"{o.BASE} select symbol, timestamp, cast(sign(ln(close / lag(close, 6) over (partition by symbol order by timestamp))) as bigint) as side from bars")
def momentum_side(spark: SparkSession, d: str) -> DataFrame:
    return pick(labels.momentum_side(_bars(spark, d), 6, ROWS), "symbol, timestamp, side")


@query(f"{o.BASE}, {o.RET}, {o.SIGMA}, lb as (select b.*, sigma from bars b left join sg using (symbol, timestamp)), {o.barrier(False)} select symbol, timestamp, label, holding_bars, round(ret_trade, 8) as ret_trade from tb")
def triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    df = labels.triple_barrier(labels.ewma_volatility(_bars(spark, d), 12), 1.0, 1.0, 6, rows=ROWS)
    return pick(df, "symbol, timestamp, label, holding_bars", "ret_trade")


@query(f"{o.BASE}, {o.RET}, {o.SIGMA}, lb as (select b.*, sigma, sign(ln(close / lag(close, 6) over (partition by symbol order by timestamp))) as side from bars b left join sg using (symbol, timestamp)), {o.barrier(True, 'lb', 1.5, 0.5)} select symbol, timestamp, label, holding_bars, round(ret_trade, 8) as ret_trade from tb")
def triple_barrier_sided(spark: SparkSession, d: str) -> DataFrame:
    df = labels.momentum_side(labels.ewma_volatility(_bars(spark, d), 12), 6)
    return pick(labels.triple_barrier(df, 1.5, 0.5, 6, sided=True, rows=ROWS), "symbol, timestamp, label, holding_bars", "ret_trade")


@query(f"{o.BASE}, {o.RET}, {o.SIGMA}, {o.RSI}, {o.FEATURES}, lb as (select f.*, sigma, rsi_14 from feat f left join sg using (symbol, timestamp) left join rsi using (symbol, timestamp)), {o.barrier(False)}, ok as (select * from tb where label is not null and gap is not null and vol_ratio_6_12 is not null and garman_klass_6 is not null and dist_high_12 is not null and rsi_14 is not null) select symbol, count(*) as n_samples, cast(20 as bigint) as n_features, min(timestamp) as start, max(timestamp) as \"end\", round(avg(label), 8) as up_rate, round(avg(holding_bars), 8) as mean_holding, round(avg(case when holding_bars = 6 then 1 else 0 end), 8) as vertical_share from ok group by symbol")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    n = len(features.feature_names(**BARRIER.features.args()))
    return pick(dataset.dataset_summary(dataset.samples(_candles(spark, d), BARRIER), n, 6), "symbol, n_samples, n_features, start, end", "up_rate, mean_holding, vertical_share")


# folds, models, scores

@query(f"{o.PRED} select symbol, timestamp, fold from te")
def walk_forward_test_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.test_rows(_samples(spark, d), 3, 24).select("symbol", "timestamp", "fold")


@query(f"{o.PRED} select fd.symbol, fd.fold, count(*) filter (pos < fd.total - (3 - fd.fold) * 24 - 6) as n_train, count(*) filter (pos >= fd.total - (3 - fd.fold) * 24 and pos < fd.total - (2 - fd.fold) * 24) as n_test from fd join s2 using (symbol) group by all")
def walk_forward_roles(spark: SparkSession, d: str) -> DataFrame:
    roles = splits.assign(_samples(spark, d), 3, 24, 6)
    return roles.groupBy("symbol", "fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))


@query(f"{o.PRED} select model, symbol, timestamp, fold, y, round(p_up, 8) as p_up, round(ret_next, 8) as ret_next from pred")
def naive_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return pick(_pred(spark, d), "model, symbol, timestamp, fold, y", "p_up, ret_next")


_SCORES = """sc0 as (select *, (select count(*) from pred b where b.symbol = a.symbol and b.model = a.model and b.fold = a.fold and b.y = 0 and b.p_up < a.p_up) + 0.5 * (select count(*) from pred b where b.symbol = a.symbol and b.model = a.model and b.fold = a.fold and b.y = 0 and b.p_up = a.p_up) as beaten from pred a),
sc as (select symbol, model, fold, sum(case when y = 1 then beaten end) / nullif(sum(y) * sum(1 - y), 0) as auc, -avg(case when y = 1 then ln(greatest(least(p_up, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) else ln(1 - greatest(least(p_up, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) end) as log_loss,
  avg(pow(p_up - y, 2)) as brier, avg(case when (p_up >= 0.5) = (y = 1) then 1.0 else 0.0 end) as accuracy, avg(case when (p_up >= 0.5) = (y = 1) then 1.0 else 0.0 end) - greatest(avg(y), 1 - avg(y)) as acc_lift_vs_prior, avg(p_up) as mean_p_up, avg(y) as realized_up_rate
  from sc0 group by symbol, model, fold)"""


@query(f"{o.PRED}, {_SCORES} select symbol, model, fold, {o.rounded(', '.join(scoring.METRICS))} from sc")
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return pick(scoring.fold_metrics(_pred(spark, d)), "symbol, model, fold", ", ".join(scoring.METRICS))


@query(f"{o.PRED}, {_SCORES}, long as (unpivot sc on {', '.join(scoring.METRICS)} into name metric value v) select symbol, model, metric, round(avg(v), 8) as mean, round(stddev_pop(v), 8) as std from long group by symbol, model, metric")
def metrics_over_folds(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.over_folds(scoring.fold_metrics(_pred(spark, d)))
    return pick(out, "symbol, model, metric", "mean, std")


@query(
    f"""{o.PRED}, e as (select unnest(range(0, 10)) as b), c as (select p.*, least(coalesce((select max(b) from e where p_up >= b * 0.1::double), 0), 9) as bin from pred p)
select symbol, model, round(bin * 0.1::double, 8) as bin_low, round((bin + 1) * 0.1::double, 8) as bin_high, round(avg(p_up), 8) as mean_p_up, round(avg(y), 8) as realized_up_rate, count(*) as count from c group by symbol, model, bin"""
)
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return pick(scoring.calibration(_pred(spark, d)), "symbol, model, count", "bin_low, bin_high, mean_p_up, realized_up_rate")


# bar backtest

@query(f"{o.PRED}, {o.STRATEGY} select symbol, model, timestamp, position, {o.rounded('gross, net, change')} from st")
def strategy_returns(spark: SparkSession, d: str) -> DataFrame:
    return pick(backtest.strategy_returns(_pred(spark, d), 0.001), "symbol, model, timestamp, position", "gross, net, change")


@query(f"{o.PRED}, {o.STRATEGY} select symbol, model, timestamp, {_LOG_SQL}, round(drawdown, 6) + 0.0 as drawdown from dd")
def equity_and_drawdown(spark: SparkSession, d: str) -> DataFrame:
    df = backtest.equity_curve(backtest.strategy_returns(_pred(spark, d), 0.001))
    return pick(df.withColumn("log_equity", _log_equity()), "symbol, model, timestamp", "log_equity, drawdown", 6)


_BPY = 365 * 24
_METRICS_SQL = f"""bm as (select symbol, model, avg(gross) / nullif(stddev_samp(gross), 0) * sqrt({_BPY}) as sharpe_gross, avg(net) / nullif(stddev_samp(net), 0) * sqrt({_BPY}) as sharpe_net, avg(net) * {_BPY} as ann_return_net, stddev_samp(net) * sqrt({_BPY}) as ann_volatility_net,
  avg(case when position <> 0 then case when gross > 0 then 1.0 else 0.0 end end) as hit_rate, min(drawdown) as max_drawdown_net, sum(change) as n_trades, avg(change) as turnover, avg(abs(position)) as exposure from dd group by symbol, model)"""


@query(f"{o.PRED}, {o.STRATEGY}, {_METRICS_SQL} select symbol, model, {o.rounded(', '.join(backtest.METRICS), 6)} from bm")
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    return pick(backtest.backtest_metrics(_pred(spark, d), 0.001, _BPY), "symbol, model", ", ".join(backtest.METRICS), 6)


_AUC_SQL = """bo as materialized (select symbol, model, y, p_up from pred union all select symbol, model, y, p_up from hold),
won as (select symbol, model, avg(case when a.p_up > b.p_up then 1.0 when a.p_up = b.p_up then 0.5 else 0.0 end) as auc from bo a join bo b using (symbol, model) where a.y = 1 and b.y = 0 group by symbol, model),
ac as (select symbol, model, avg(case when (p_up >= 0.5) = (y = 1) then 1.0 else 0.0 end) as accuracy, case when count(distinct p_up) > 1 then any_value(auc) end as auc from bo left join won using (symbol, model) group by symbol, model)"""
_HOLD = "hold as (select p.* replace ('buy_and_hold' as model, 1.0::double as p_up) from pred p where model = 'momentum_sign')"


@query(f"{o.PRED}, {_HOLD}, {o.STRATEGY.replace('from pred)', 'from (select * from pred union all select * from hold))')}, {_METRICS_SQL}, {_AUC_SQL} select symbol, model, {o.rounded(', '.join(backtest.METRICS) + ', auc, accuracy', 6)} from bm join ac using (symbol, model)")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    pred = _pred(spark, d)
    return pick(backtest.comparison(pred.unionByName(backtest.buy_and_hold(pred)), 0.001, _BPY), "symbol, model", ", ".join((*backtest.METRICS, "auc", "accuracy")), 6)


@query(
    f"""{o.PRED}, {o.STRATEGY}, m as (select symbol, model, avg(net) as mu from st group by symbol, model), k as (select symbol, model, avg(pow(net - mu, 2)) as m2, avg(pow(net - mu, 3)) as m3, avg(pow(net - mu, 4)) as m4, quantile_cont(net, 0.05) as q05, min(net) as least, max(net) as largest from st join m using (symbol, model) group by symbol, model)
select symbol, model, round(m3 / pow(nullif(m2, 0), 1.5), 6) as skewness, round(m4 / pow(nullif(m2, 0), 2) - 3, 6) as excess_kurtosis, round(q05, 6) as q05, round(least, 6) as least, round(largest, 6) as largest from k"""
)
def return_distribution(spark: SparkSession, d: str) -> DataFrame:
    return pick(backtest.return_stats(backtest.strategy_returns(_pred(spark, d), 0.001)), "symbol, model", "skewness, excess_kurtosis, q05, least, largest", 6)


@query(f"{o.PRED}, {o.STRATEGY}, e as (select symbol, model, min(net) as lo, max(net) as hi from st group by symbol, model) select symbol, model, cast(coalesce(least(floor((net - lo) * 120 / nullif(hi - lo, 0)), 119), 0) as bigint) as bin, count(*) as count from st join e using (symbol, model) group by all")
def return_histogram(spark: SparkSession, d: str) -> DataFrame:
    return backtest.histogram(backtest.strategy_returns(_pred(spark, d), 0.001), bins=120)


@query(f"{o.BASE}, {o.RET} select symbol, timestamp, round(0.5 + sign(ret_1) * greatest(1 / (1 + abs(ret_1)) - 0.5, 0), 8) as p_up from r where ret_1 is not null")
def sided_probabilities(spark: SparkSession, d: str) -> DataFrame:
    r = features.returns(_bars(spark, d)).where("ret_1 is not null")
    p: Column = backtest.sided_probability(1 / (1 + F.abs("ret_1")), F.signum("ret_1"))
    return pick(r.withColumn("p_up", p), "symbol, timestamp", "p_up")


# trades

@query(f"{o.PRED}, {o.TRADES} select symbol, model, entry_ts, exit_ts, cast(direction as bigint) as direction, cast(holding_bars as bigint) as holding_bars, {o.rounded('p_up, ret_gross, ret_net')} from tr")
def fixed_trades(spark: SparkSession, d: str) -> DataFrame:
    return pick(_trades(spark, d)[0], "symbol, model, entry_ts, exit_ts, direction, holding_bars", "p_up, ret_gross, ret_net")


@query(f"{o.PRED}, {o.TRADES} select symbol, model, trade_no, entry_ts, {_LOG_SQL}, round(drawdown, 6) + 0.0 as drawdown from tq")
def trade_equity(spark: SparkSession, d: str) -> DataFrame:
    df = trades.trade_equity(_trades(spark, d)[0])
    return pick(df.withColumn("log_equity", _log_equity()), "symbol, model, trade_no, entry_ts", "log_equity, drawdown", 6)


@query(
    f"""{o.PRED}, {o.TRADES}, sp as (select symbol, model, (max(timestamp) - min(timestamp) + {HOUR}) as el from pred group by symbol, model),
m as (select symbol, model, count(*) as n, avg(case when ret_net > 0 then 1.0 else 0.0 end) as win_rate, avg(ret_net) as avg_ret_net, stddev_samp(ret_net) as sd, arg_max(equity, trade_no) as eq, min(drawdown) as mdd, sum(holding_bars) as hb, avg(holding_bars) as ah from tq group by symbol, model)
select symbol, model, cast(coalesce(n, 0) as double) as n_trades, round(win_rate, 6) as win_rate, round(avg_ret_net, 6) as avg_ret_net, round(avg_ret_net / nullif(sd, 0) * sqrt(n / (el / 31536000000.0)), 6) as sharpe_net, round(coalesce(mdd, 0), 6) as max_drawdown_net,
  round(coalesce(hb * {HOUR} / el, 0), 6) as exposure, round(ah, 6) as avg_holding_bars, round(coalesce(n, 0) / (el / 31536000000.0), 6) as trades_per_year, round(case when coalesce(n, 0) = 0 then log10(2) when eq > 0 then log10(1 + pow(eq, 1 / (el / 31536000000.0))) end, 6) + 0.0 as log_ann_growth from sp left join m using (symbol, model)"""
)
def trade_metrics(spark: SparkSession, d: str) -> DataFrame:
    t, pred = _trades(spark, d)
    # a few days' gain, taken to a year, can be a huge number: it is compared by its logarithm
    out = trades.trade_metrics(t, pred, HOUR).withColumn("log_ann_growth", F.log10(2 + F.col("ann_return_net")))
    return pick(out, "symbol, model, n_trades", "log_ann_growth, win_rate, avg_ret_net, sharpe_net, max_drawdown_net, exposure, avg_holding_bars, trades_per_year", 6)


@query(f"{o.PRED}, {o.TRADES} select symbol, model, entry_ts, round(close, 6) as entry_price, round(close * (1 + direction * ret_gross), 6) as exit_price from tr")
def trade_prices(spark: SparkSession, d: str) -> DataFrame:
    return pick(trades.with_prices(*_trades(spark, d)), "symbol, model, entry_ts", "entry_price, exit_price", 6)


@query(f"{o.PRED}, {o.TRADES} select symbol, model, direction > 0 as is_long, ret_net > 0 as won, count(*) as n from tr group by all")
def trade_breakdown(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d)[0]
    both = trades.winners(t).withColumn("won", F.lit(True)).unionByName(trades.losers(t).withColumn("won", F.lit(False)))
    return both.groupBy("symbol", "model", (F.col("direction") > 0).alias("is_long"), "won").agg(F.count("*").alias("n"))


@query(f"{o.PRED}, {o.TRADES} select symbol, model, entry_ts, exit_ts, round(ret_net, 8) as ret_net from tn where trade_no = 5")
def fifth_trade(spark: SparkSession, d: str) -> DataFrame:
    return pick(trades.nth_trade(_trades(spark, d)[0], 5), "symbol, model, entry_ts, exit_ts", "ret_net")


@query(f"{o.PRED}, {o.TRADES} select t.symbol, t.model, t.entry_ts, b.timestamp, b.open, b.high, b.low, b.close from tn t join bars b on b.symbol = t.symbol and b.timestamp between t.entry_ts - 25 * {HOUR} and t.exit_ts + 10 * {HOUR} where trade_no = 2")
def chart_around_trade(spark: SparkSession, d: str) -> DataFrame:
    t = trades.nth_trade(_trades(spark, d)[0], 2)
    return pick(trades.around_trades(t, _bars(spark, d), HOUR), "symbol, model, entry_ts, timestamp, open, high, low, close")


@query(f"{o.BASE}, {o.RET}, {o.FEATURES}, long as (unpivot (select symbol, timestamp, ret_1, ret_3, ret_6, vol_6, vol_12, range_pct, gap from feat where vol_12 is not null) on ret_1, ret_3, ret_6, vol_6, vol_12, range_pct, gap into name feature value value), n as (select *, row_number() over (partition by symbol, timestamp order by abs(value) desc, feature) as place from long) select symbol, timestamp, feature, place, round(value, 8) as value from n where place <= 3")
def top_contributions(spark: SparkSession, d: str) -> DataFrame:
    df = features.price_features(_bars(spark, d), (3, 6), (6, 12), (6,), (6, 12)).where("vol_12 is not null")
    names = ["ret_1", "ret_3", "ret_6", "vol_6", "vol_12", "range_pct", "gap"]
    return pick(trades.top_contributions(df, names, 3), "symbol, timestamp, feature, place", "value")


@query(f"{o.META_PRED}, {o.TRAILING} select symbol, model, entry_ts, exit_ts, direction, holding_bars, exit_reason, n_updates, {o.rounded('p_up, entry_price, exit_price, ret_gross, ret_net', 6)} from tt")
def trailing_trades(spark: SparkSession, d: str) -> DataFrame:
    pred = pinned(models.naive_predictions(_samples(spark, d, META), 3, 24, 6).withColumn("p_up", F.col("p_up") + 0.4))
    out = trades.trailing_trades(pred, HOUR, 0.001, 1.5, 1.0, 6, rows=16)
    return pick(out, "symbol, model, entry_ts, exit_ts, direction, holding_bars, exit_reason, n_updates", "p_up, entry_price, exit_price, ret_gross, ret_net", 6)


def _fitted(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Samples, and the models of all their series and folds; and the features' names."""
    names = features.feature_names(**SETTINGS.features.args())
    rows = _samples(spark, d).select("symbol", "timestamp", "close", "y", "ret_next", *names)
    return rows, models.fit(rows, names, name, SETTINGS.n_splits, SETTINGS.test_size, SETTINGS.purge, SETTINGS.seed), names


def _forecasts(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows, fitted, names = _fitted(spark, d, name)
    return models.predict(rows, fitted, names, name, SETTINGS.n_splits, SETTINGS.test_size).select("model", "symbol", "fold", "timestamp", "y", "p_up", "ret_next")


def _contributions(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows, fitted, names = _fitted(spark, d, name)
    return models.contributions(rows, fitted, names, name, SETTINGS.n_splits, SETTINGS.test_size)


def _importances(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Of the last fold's models."""
    _, fitted, names = _fitted(spark, d, name)
    return models.importances(fitted, names, name, SETTINGS.n_splits - 1)


@query()
def logistic_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(spark, d, "logreg")


@query()
def logistic_contributions(spark: SparkSession, d: str) -> DataFrame:
    return _contributions(spark, d, "logreg")


@query(f"{o.PRED}, {o.OPTIMALITY} select symbol, fold, feature, n_train, {o.rounded('mean, scale', 6)}, residual from opt")
def logistic_optimality(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the derivatives at the fitted models: SQL says 0 for each."""
    rows, fitted, names = _fitted(spark, d, "logreg")
    train = models.train_rows(rows, names, SETTINGS.n_splits, SETTINGS.test_size, SETTINGS.purge)
    out = logistic.residuals(train, fitted, names)
    return pick(out.withColumn("residual", F.round("residual", 4) + 0.0), "symbol, fold, feature, n_train, residual", "mean, scale", 6)


@query()
def tree_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(spark, d, "gbt")


@query()
def tree_contributions(spark: SparkSession, d: str) -> DataFrame:
    return _contributions(spark, d, "gbt")


@query()
def tree_forecast_importances(spark: SparkSession, d: str) -> DataFrame:
    return _importances(spark, d, "gbt")


@query(f"{o.BASE}, c as (select *, max(timestamp) over () as top from candles) select symbol, timestamp, open, high, low, close, {o.rounded('volume')}, n_candles from bars where timestamp + {HOUR} <= (select max(timestamp) from candles)")
def streamed_closed_bars(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.bars import replay_closed_bars

    return pick(replay_closed_bars(spark, d, "1h"), "symbol, timestamp, open, high, low, close, n_candles", "volume")
