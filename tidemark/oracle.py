"""DuckDB SQL that says what the queries should return.

Written from the definitions with other means than the operators (self-joins where those use row frames, direct sums where those
use blocks, a recursive walk where those fold), so that agreement means something."""

from __future__ import annotations

HOUR = 3_600_000

TICKS = """ticks as (select event_type as symbol, epoch_us(ts) // 1000 as timestamp, value as open, value as high, value as low, value as close,
  cast(json_extract_string(props, '$.k') as double) as volume, event_id as seq from events where value > 0)"""
FIRST = "candles as (select * exclude (rn) from (select *, row_number() over (partition by symbol, timestamp order by seq) as rn from ticks) where rn = 1)"


def bars(name: str = "bars", tf: int = HOUR, anchor: int = 0, least: int = 1) -> str:
    b = f"timestamp - ((timestamp - {anchor}) % {tf} + {tf}) % {tf}"
    return f"""{name} as (select symbol, {b} as timestamp, arg_min(open, timestamp) as open, max(high) as high, min(low) as low, arg_max(close, timestamp) as close,
  sum(volume) as volume, count(*) as n_candles from candles group by symbol, {b} having count(*) >= {least})"""


def rolling(name: str, agg: str, x: str, k: int, skip: int = 0) -> str:
    """An aggregate over k rows up to `skip` back, null unless all have a value."""
    frame = f"over (partition by symbol order by timestamp rows between {k - 1 + skip} preceding and {skip} preceding)"
    return f"case when count({x}) {frame} = {k} then {agg}({x}) {frame} end as {name}"


def rounded(columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) + 0.0 as {c.strip()}" for c in columns.split(","))


BASE = f"with recursive {TICKS}, {FIRST}, {bars()}"
RET = "r as (select *, ln(close / lag(close) over (partition by symbol order by timestamp)) as ret_1, row_number() over (partition by symbol order by timestamp) as rn from bars)"

#: Decayed sums by direct summation: y(t) over all earlier rows of the series.
RSI = """moves as (select symbol, timestamp, close - lag(close) over (partition by symbol order by timestamp) as step from bars),
mv as (select symbol, timestamp, greatest(step, 0) as gain, greatest(-step, 0) as loss, row_number() over (partition by symbol order by timestamp) as n from moves where step is not null),
sm as (select t.symbol, t.timestamp, any_value(t.n) as n, sum(j.gain * case when j.n = 1 then 1 else 1.0 / 14 end * pow(13.0 / 14, t.n - j.n)) as g,
  sum(j.loss * case when j.n = 1 then 1 else 1.0 / 14 end * pow(13.0 / 14, t.n - j.n)) as l from mv t join mv j on j.symbol = t.symbol and j.n <= t.n group by t.symbol, t.timestamp),
rsi as (select symbol, timestamp, case when n >= 14 then 100 * g / nullif(g + l, 0) end as rsi_14 from sm)"""

SIGMA = """lr as (select symbol, timestamp, ret_1 as x, row_number() over (partition by symbol order by timestamp) as n from r where ret_1 is not null),
w as (select t.symbol, t.timestamp, any_value(t.n) as n, sum(pow(11.0 / 13, t.n - j.n)) as s, sum(pow(11.0 / 13, 2 * (t.n - j.n))) as s2,
  sum(j.x * pow(11.0 / 13, t.n - j.n)) as m1, sum(j.x * j.x * pow(11.0 / 13, t.n - j.n)) as m2 from lr t join lr j on j.symbol = t.symbol and j.n <= t.n group by t.symbol, t.timestamp),
sg as (select symbol, timestamp, case when n >= 12 then sqrt(greatest(m2 / s - pow(m1 / s, 2), 0) * s * s / nullif(s * s - s2, 0)) end as sigma from w)"""

FEATURES = f"""f1 as (select *, {rolling('ret_3', 'sum', 'ret_1', 3)}, {rolling('ret_6', 'sum', 'ret_1', 6)}, {rolling('vol_6', 'stddev_samp', 'ret_1', 6)}, {rolling('vol_12', 'stddev_samp', 'ret_1', 12)},
  {rolling('pk', 'avg', 'pow(ln(high / low), 2)', 6)}, {rolling('gk', 'avg', '(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2))', 6)},
  {rolling('h6', 'max', 'high', 6)}, {rolling('l6', 'min', 'low', 6)}, {rolling('h12', 'max', 'high', 12)}, {rolling('l12', 'min', 'low', 12)},
  open / lag(close) over (partition by symbol order by timestamp) - 1 as gap from r),
feat as (select *, vol_6 / nullif(vol_12, 0) as vol_ratio_6_12, sqrt(pk / (4 * ln(2))) as parkinson_6, case when gk is not null then sqrt(greatest(gk, 0)) end as garman_klass_6,
  (high - low) / close as range_pct, case when high > low then (close - low) / (high - low) else 0.5 end as close_pos_bar,
  case when h6 > l6 then (close - l6) / (h6 - l6) else 0.5 end as close_pos_6, close / h6 - 1 as dist_high_6,
  case when h12 > l12 then (close - l12) / (h12 - l12) else 0.5 end as close_pos_12, close / h12 - 1 as dist_high_12 from f1)"""
FEATURE_COLUMNS = "ret_1, ret_3, ret_6, vol_6, vol_12, vol_ratio_6_12, parkinson_6, garman_klass_6, range_pct, close_pos_bar, close_pos_6, dist_high_6, close_pos_12, dist_high_12, gap"


def barrier(sided: bool, source: str = "lb", up: float = 1.0, down: float = 1.0, h: int = 6) -> str:
    """Labels by joining each bar with the h bars after it."""
    side = "side" if sided else "1"
    return f"""tb0 as (select *, row_number() over (partition by symbol order by timestamp) as k, count(*) over (partition by symbol) as total,
    close * (1 + sigma * case when {side} < 0 then {down} else {up} end) as top, close * (1 - sigma * case when {side} < 0 then {up} else {down} end) as bottom from {source}),
tb1 as (select a.symbol, a.timestamp, min(b.k - a.k) as hold from tb0 a join tb0 b on a.symbol = b.symbol and b.k between a.k + 1 and a.k + {h} and (b.high >= a.top or b.low <= a.bottom) group by a.symbol, a.timestamp),
tb2 as (select a.*, t.hold, x.high as xh, x.low as xl, v.close as vc from tb0 a left join tb1 t using (symbol, timestamp)
  left join tb0 x on x.symbol = a.symbol and x.k = a.k + t.hold left join tb0 v on v.symbol = a.symbol and v.k = a.k + {h}),
tb3 as (select *, sigma > 0 and k + {h} <= total and {side} <> 0 as ok, case when {side} < 0 then xh < top else xl <= bottom end as at_bottom from tb2),
tb as (select * exclude (ok, at_bottom), case when ok then {side} * (case when hold is null then vc when at_bottom then bottom else top end / close - 1) end as ret_trade,
  case when ok then cast(case when hold is null then {side} * (vc / close - 1) > 0 when {side} < 0 then at_bottom else not at_bottom end as bigint) end as label,
  case when ok then coalesce(hold, {h}) end as holding_bars from tb3)"""


#: Naive forecasts by joining each test row with its fold's training rows.
SAMPLES = """smp as (select f.*, lead(close) over (partition by symbol order by timestamp) as nx, rsi_14 from feat f left join rsi using (symbol, timestamp)),
s1 as (select *, case when nx is not null then cast(nx > close as bigint) end as y, nx / close - 1 as ret_next from smp),
s2 as (select *, row_number() over (partition by symbol order by timestamp) - 1 as pos, count(*) over (partition by symbol) as total from s1
  where y is not null and ret_1 is not null and ret_3 is not null and ret_6 is not null and vol_6 is not null and vol_12 is not null and vol_ratio_6_12 is not null and parkinson_6 is not null
  and garman_klass_6 is not null and dist_high_6 is not null and dist_high_12 is not null and gap is not null and rsi_14 is not null),"""

#: From samples in s2 to forecasts.
FOLDS = """fd as (select symbol, any_value(total) as total, unnest([0::bigint, 1, 2]) as fold from s2 group by symbol),
rt as (select fd.symbol, fd.fold, any_value(fd.total) - (3 - fd.fold) * 24 as t0, avg(y) as prior, coalesce(avg(case when ret_1 > 0 then y end), 0.5) as up, coalesce(avg(case when not ret_1 > 0 then y end), 0.5) as down
  from fd left join s2 on s2.symbol = fd.symbol and s2.pos < fd.total - (3 - fd.fold) * 24 - 6 group by fd.symbol, fd.fold),
te as (select s2.*, rt.fold, prior, up, down from s2 join rt on rt.symbol = s2.symbol and s2.pos >= rt.t0 and s2.pos < rt.t0 + 24),
pred as (select *, 'prior' as model, prior as p_up from te union all select *, 'momentum_sign' as model, case when ret_1 > 0 then up else down end as p_up from te)"""
FORECASTS = f"{SAMPLES}\n{FOLDS}"

PRED = f"{BASE}, {RET}, {RSI}, {FEATURES}, {FORECASTS}"

STRATEGY = """st0 as (select *, case when p_up > 0.5 then 1.0::double when p_up < 0.5 then -1.0::double else 0.0::double end as position from pred),
st1 as (select *, position * ret_next as gross, abs(position - coalesce(lag(position) over (partition by symbol, model order by timestamp), 0)) as change from st0),
st as (select *, gross - 0.001 * change as net, row_number() over (partition by symbol, model order by timestamp) as i from st1),
eq as (select *, product(1 + net) over (partition by symbol, model order by timestamp rows between unbounded preceding and current row) as equity from st),
dd as (select *, equity / nullif(max(equity) over (partition by symbol, model order by timestamp rows between unbounded preceding and current row), 0) - 1 as drawdown from eq)"""

#: Trades by walking from each exit to the first signal at or after it.
TRADES = f"""sig as (select symbol, model, timestamp as entry_ts, timestamp + {HOUR} as exit_ts, case when p_up > 0.5 then 1 else -1 end as direction, p_up,
  case when p_up > 0.5 then ret_next else -ret_next end as ret_gross, close from pred where p_up > 0.5 or p_up < 0.5),
walk as (select symbol, model, min(entry_ts) as entry_ts from sig group by symbol, model
  union all select w.symbol, w.model, (select min(s.entry_ts) from sig s where s.symbol = w.symbol and s.model = w.model and s.entry_ts >= w.entry_ts + {HOUR}) from walk w where w.entry_ts is not null),
tr as (select s.*, 1 as holding_bars, ret_gross - 0.002 as ret_net from sig s join walk w using (symbol, model, entry_ts)),
tn as (select *, row_number() over (partition by symbol, model order by entry_ts) as trade_no from tr),
te2 as (select *, product(1 + ret_net) over (partition by symbol, model order by entry_ts rows between unbounded preceding and current row) as equity from tn),
tq as (select *, equity / nullif(max(equity) over (partition by symbol, model order by entry_ts rows between unbounded preceding and current row), 0) - 1 as drawdown from te2)"""

#: Forecasts of whether the momentum side wins against its barriers.
META_PRED = f"""{BASE}, {RET}, {RSI}, {SIGMA}, {FEATURES},
lb as (select f.*, sigma, rsi_14, nullif(sign(ln(close / lag(close, 6) over (partition by f.symbol order by f.timestamp))), 0) as side from feat f left join sg using (symbol, timestamp) left join rsi using (symbol, timestamp)),
{barrier(True)},
s2 as (select * exclude (total) replace (side::bigint as side), label as y, ret_trade as ret_next, row_number() over (partition by symbol order by timestamp) - 1 as pos, count(*) over (partition by symbol) as total from tb
  where label is not null and side is not null and ret_1 is not null and ret_3 is not null and ret_6 is not null and vol_6 is not null and vol_12 is not null and vol_ratio_6_12 is not null and parkinson_6 is not null
  and garman_klass_6 is not null and dist_high_6 is not null and dist_high_12 is not null and gap is not null and rsi_14 is not null),
{FOLDS}"""

#: Trailing barriers by a walk over each series' bars, with the open position as its state.
TRAILING = f"""pb0 as (select symbol, model, timestamp as ts, high, low, close, p_up + 0.4 as p, row_number() over (partition by symbol, model order by timestamp) as i, sigma,
  case when p_up + 0.4 > 0.5 and side in (1, -1) and sigma > 0 then side end as d from pred),
pb as materialized (select *, d * close * (1 + d * 1.5 * sigma) as tg, d * close * (1 - d * 1.0 * sigma) as st from pb0),
wk as (select distinct symbol, model, 0::bigint as i, null::bigint as hd, null::bigint as hts, null::double as hp, null::double as hprice, null::double as htg, null::double as hst, 0::bigint as hn,
    null::varchar as rs, null::bigint as xd, null::bigint as xts, null::double as xp, null::double as xprice, 0::bigint as xn, null::bigint as out_ts, null::double as out_price from pb
  union all select symbol, model, bi, case when opens then d else hd end, case when opens then case when d is not null then ts end else hts end, case when opens then p else hp end, case when opens then close else hprice end,
    case when opens then tg when d = hd then greatest(htg, tg) else htg end, case when opens then st when d = hd then greatest(hst, st) else hst end, case when opens then 0 when d = hd then hn + 1 else hn end,
    why, hd, hts, hp, hprice, hn, ts, case why when 'sl' then hd * hst when 'tp' then hd * htg else close end
  from (select *, hd is null or why is not null as opens from (select w.symbol, w.model, b.i as bi, w.hd, w.hts, w.hp, w.hprice, w.htg, w.hst, w.hn, b.ts, b.close, b.p, b.d, b.tg, b.st,
    case when w.hd is null then null when (case when w.hd > 0 then b.low else -b.high end) <= w.hst then 'sl' when (case when w.hd > 0 then b.high else -b.low end) >= w.htg then 'tp' when b.ts >= w.hts + 6 * {HOUR} then 'vertical' end as why
    from wk w join pb b on b.symbol = w.symbol and b.model = w.model and b.i = w.i + 1))),
tt as (select symbol, model, xts as entry_ts, out_ts as exit_ts, xd as direction, greatest(1, (out_ts - xts) // {HOUR}) as holding_bars, xp as p_up, xprice as entry_price, out_price as exit_price, rs as exit_reason, xn as n_updates,
  xd * (out_price / xprice - 1) as ret_gross, xd * (out_price / xprice - 1) - 0.002 as ret_net from wk where rs is not null)"""

#: Training rows of each fold by feature, and what the derivatives of a fitted model must be.
OPTIMALITY = """tnr as (select s2.*, fd.fold, (s2.timestamp // 3600000) % 24 as h, (s2.timestamp // 86400000 + 4) % 7 as w from s2 join fd on fd.symbol = s2.symbol and s2.pos < fd.total - (3 - fd.fold) * 24 - 6),
wide as (select symbol, fold, y::double as bias, ret_1, ret_3, ret_6, vol_6, vol_12, vol_ratio_6_12, parkinson_6, garman_klass_6, range_pct, close_pos_bar, close_pos_6, dist_high_6, close_pos_12, dist_high_12, gap, rsi_14,
  sin(2 * pi() * h / 24) as hour_sin, cos(2 * pi() * h / 24) as hour_cos, sin(2 * pi() * w / 7) as dow_sin, cos(2 * pi() * w / 7) as dow_cos from tnr),
opt as (select symbol, fold, feature, count(*) as n_train, avg(value) as mean, case when feature = 'bias' then 1 else coalesce(nullif(stddev_pop(value), 0), 1) end as scale, 0.0::double as residual
  from (unpivot wide on columns(* exclude (symbol, fold)) into name feature value value) group by symbol, fold, feature)"""
