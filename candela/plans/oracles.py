"""SQL for the registered queries: the same rows from the same tables, written apart from the operators."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

BARS = """bars as (
    select event_type as symbol, date_trunc('hour', ts) as ts, arg_min(value, (ts, event_id)) as open, max(value) as high,
           min(value) as low, arg_max(value, (ts, event_id)) as close, cast(count(*) as double) as volume
    from events group by 1, 2
), r as (select *, row_number() over w as rn, count(*) over (partition by symbol) as n from bars window w as (partition by symbol order by ts))"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{BARS}{', ' + more if more else ''}\n{body}"


def _window(columns: str, more: str = "", where: str = "true", source: str = "r") -> str:
    """One select over rows with windows: w is the whole order, wN the last N rows."""
    return sql(f"select symbol, ts, {columns} from {source} where {where}", more)


W = "over (partition by symbol order by ts"


def last(n: int) -> str:
    return f"{W} rows between {n - 1} preceding and current row)"


RUN = f"{W} rows between unbounded preceding and current row)"

ORACLES["bars_1h"] = sql("select symbol, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume from bars")
for _name, _seconds in (("bars_4h", 14400), ("bars_1d", 86400)):
    ORACLES[_name] = sql(
        f"""select symbol, to_timestamp(floor(epoch(ts) / {_seconds}) * {_seconds})::timestamptz at time zone 'UTC' as ts, round(arg_min(open, ts), 6) as open, round(max(high), 6) as high,
        round(min(low), 6) as low, round(arg_max(close, ts), 6) as close, round(sum(volume), 6) as volume from bars group by 1, 2"""
    )
ORACLES["last_n_bars"] = sql("select symbol, ts, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume from r where rn > n - 100")
ORACLES["bar_columns"] = ORACLES["bars_from_records"] = ORACLES["bars_1h"]
ORACLES["bar_violations"] = sql(
    """select symbol, count(*) as bars, count(*) filter (where ts = before) as repeated, count(*) filter (where not (isfinite(open) and isfinite(high) and isfinite(low) and isfinite(close) and isfinite(volume))) as not_finite,
    count(*) filter (where high < low) as high_below_low, count(*) filter (where volume < 0) as negative_volume from (select *, lag(ts) over (partition by symbol order by ts) as before from bars) group by symbol"""
)
TR = f"greatest(high - low, abs(high - lag(close) {W})), abs(low - lag(close) {W})))"
ORACLES["true_range"] = _window(f"round({TR}, 6) as true_range")
ORACLES["stochastic"] = sql(
    f"""select symbol, ts, case when k is not null then round(least(greatest(k, 0), 100), 6) end as k, case when d is not null then round(least(greatest(d, 0), 100), 6) end as d from (
        select *, case when rn >= 18 then avg(k) {last(3)} end as d from (
            select symbol, ts, rn, case when rn >= 16 then avg(raw) {last(3)} end as k from (
                select symbol, ts, rn, case when rn < 14 then null when hh = ll then 50 else 100 * (close - ll) / (hh - ll) end as raw from (
                    select *, min(low) {last(14)} as ll, max(high) {last(14)} as hh from r where n >= 14))))"""
)
ORACLES["cci"] = sql(
    f"""select symbol, ts, round(case when rn >= 20 then (tp - m) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - m))), 0) end, 6) as cci from (
        select *, avg(tp) {last(20)} as m, list(tp) {last(20)} as l from (select symbol, ts, rn, (high + low + close) / 3 as tp from r))"""
)
ORACLES["williams_r"] = sql(
    f"select symbol, ts, round(case when rn < 14 then null when hh = ll then -50 else 100 * (close - hh) / (hh - ll) end, 6) as williams_r from (select *, min(low) {last(14)} as ll, max(high) {last(14)} as hh from r)"
)
ORACLES["roc"] = _window(f"round(100 * (close - lag(close, 12) {W})) / nullif(lag(close, 12) {W}), 0), 6) as roc")
ORACLES["bollinger_width"] = sql(
    f"select symbol, ts, round(4 * s / m, 6) as bollinger_width from (select *, avg(close) {last(20)} as m, stddev_pop(close) {last(20)} as s from r) where rn >= 20 and m <> 0"
)
LOGS = f"logs as (select *, case when close > 0 and lag(close) {W}) > 0 then ln(close / lag(close) {W})) end as lr from r)"
ORACLES["hist_vol"] = sql(
    f"select symbol, ts, round(v, 6) as volatility from (select *, stddev_pop(lr) {last(24)} * sqrt(252) as v, min(close) over (partition by symbol) as least from logs) where rn > 24 and least > 0", LOGS
)
ORACLES["latest_vol"] = sql(
    f"select symbol, round(hv, 6) as hv, round(hv * 100, 6) as hv_pct, cast(50 as double) as percentile from (select *, stddev_samp(lr) {last(20)} * sqrt(252) as hv from logs) where rn = n", LOGS
)
ORACLES["obv"] = sql(
    f"select symbol, ts, round(sum(s) {RUN}, 6) as obv from (select *, case when rn = 1 then volume else volume * sign(close - lag(close) {W})) end as s from r)"
)
ORACLES["mfi"] = sql(
    f"""select symbol, ts, round(case when u = 0 and d = 0 then 50 when d = 0 then 100 when u = 0 then 0 else 100 - 100 / (1 + u / d) end, 6) as mfi from (
        select *, sum(up) {last(13)} as u, sum(down) {last(13)} as d from (
            select *, case when tp > lag(tp) {W}) then tp * volume else 0 end as up, case when tp < lag(tp) {W}) then tp * volume else 0 end as down from (select *, (high + low + close) / 3 as tp from r))) where rn > 14"""
)


def _vwap(zone: str, minutes: int) -> str:
    local = "ts" if zone == "UTC" else f"timezone('{zone}', timezone('UTC', ts))"
    return f"""v as (select *, coalesce(sum(tp * volume) over s / nullif(sum(volume) over s, 0), tp) as vwap from (
        select *, (high + low + close) / 3 as tp, cast({local} - interval {minutes} minutes as date) as session from r)
        window s as (partition by symbol, session order by ts rows between unbounded preceding and current row))"""


for _name, _zone, _minutes in (("ny", "America/New_York", 570), ("asia", "UTC", 0), ("london", "UTC", 480), ("daily", "America/New_York", 0)):
    ORACLES[f"vwap_{_name}"] = sql("select symbol, ts, round(vwap, 6) as vwap from v", _vwap(_zone, _minutes))
NY = _vwap("America/New_York", 570)
ORACLES["vwap_bands"] = sql("select symbol, ts, round(vwap, 6) as vwap, round(vwap + 2 * s, 6) as upper, round(vwap - 2 * s, 6) as lower from (select *, stddev_pop(close - vwap) over (partition by symbol) as s from v)", NY)
ORACLES["vwap_cross"] = sql(
    f"select symbol, ts, round(close, 6) as close, round(vwap, 6) as vwap, case when above then 'bullish' else 'bearish' end as direction from (select *, lag(above) {W}) as before from (select *, close >= vwap as above from v)) where above <> before", NY
)
ORACLES["volume_ratio"] = sql(
    f"select symbol, round(case when rn >= 5 and m > 0 then volume / m else 1 end, 6) as volume_ratio from (select *, avg(volume) {W} rows between 19 preceding and 1 preceding) as m from r) where rn = n"
)
ORACLES["momentum_pct"] = sql(
    f"select symbol, round(coalesce((close - b) * 100 / nullif(b, 0), 0), 6) as momentum_pct from (select *, coalesce(lag(close, 14) {W}), first_value(close) {W})) as b from r) where rn = n"
)
ORACLES["gap_sessions"] = sql(f"select symbol, ts, cast(sum(f) {RUN} as bigint) as session from (select *, case when rn = 1 or ts - lag(ts) {W}) > interval 4 hours then 1 else 0 end as f from r)")
ORACLES["fair_value_gaps"] = sql(
    f"select symbol, ts, up as bullish, down as bearish from (select symbol, ts, coalesce(lead(low) {W}) > lag(high) {W}), false) as up, coalesce(lead(high) {W}) < lag(low) {W}), false) as down from r) where up or down"
)
ORACLES["pivot_points"] = sql(
    "select symbol, round(pp, 6) as pp, round(2 * pp - low, 6) as r1, round(2 * pp - high, 6) as s1, round(pp + (high - low), 6) as r2, round(pp - (high - low), 6) as s2 from (select *, (high + low + close) / 3 as pp from r where rn = n)"
)
AROUND = f"{W} rows between 2 preceding and 2 following)"
CANDIDATES = f"""cand as (select symbol, ts, rn - 1 as i, high, low, close, n, high = mh and high > lh as is_high, low = ml and low < hl as is_low from (
    select *, max(high) {AROUND} as mh, min(high) {AROUND} as lh, min(low) {AROUND} as ml, max(low) {AROUND} as hl from r) where rn - 1 >= 2 and rn - 1 < n - 2)"""
ORACLES["swing_candidates"] = sql("select symbol, ts, i, is_high, is_low, round(high, 6) as high, round(low, 6) as low from cand where is_high or is_low", CANDIDATES)
ORACLES["strict_swings"] = sql("select symbol, ts, i, case when is_high then 'high' else 'low' end as kind, round(case when is_high then high else low end, 6) as price from cand where is_high <> is_low", CANDIDATES)
ORACLES["local_extremes"] = sql(
    f"select symbol, ts, round(close, 6) as close, case when close < b then 'low' else 'high' end as kind from (select *, lag(close) {W}) as b, lead(close) {W}) as a from r) where (close < b and close < a) or (close > b and close > a)"
)


def _session(name: str, inside: str, day: str) -> str:
    return sql(
        f"""select l.symbol, '{name}' as session_type, session_start, session_end, round(high, 6) as high, round(low, 6) as low, round(high - low, 6) as range, round((high + low) / 2, 6) as midpoint, coalesce(k, 0) as bars from last l left join (
            select symbol, arg_max(h, d) as high, arg_max(x, d) as low, arg_max(k, d) as k, arg_max(a, d) as session_start, arg_max(z, d) as session_end from (
                select s.symbol, d, max(high) as h, min(low) as x, count(*) as k, min(ts) as a, max(ts) as z from s join last using (symbol) where inside and d in (today, today - 1) group by 1, 2) group by 1) using (symbol)""",
        f"s as (select *, {inside} as inside, cast({day} as date) as d from r), last as (select symbol, arg_max(d, ts) as today from s group by 1)",
    )


LOCAL = "timezone('America/New_York', timezone('UTC', ts))"
ORACLES["session_levels_ny"] = _session("ny", f"hour({LOCAL}) * 60 + minute({LOCAL}) between 570 and 959", LOCAL)
ORACLES["session_levels_asia"] = _session("asia", "hour(ts) < 9", "ts")
ORACLES["session_levels_london"] = _session("london", "hour(ts) between 8 and 16", "ts")
ORACLES["pdh_pdl"] = sql(
    """select w.symbol, round(h, 6) as pdh, round(x, 6) as pdl, round(c, 6) as pdc, round(h - x, 6) as pd_range, ht as pdh_ts, xt as pdl_ts, round(p, 6) as pivot, round(2 * p - x, 6) as r1, round(2 * p - h, 6) as s1,
        round(p + (h - x), 6) as r2, round(p - (h - x), 6) as s2, case when h is null then 'insufficient_data' when current > h then 'above_pdh' when current < x then 'below_pdl' else 'inside_range' end as position
    from whole w left join (select *, (h + x + c) / 3 as p from (
        select symbol, max(high) as h, min(low) as x, arg_max(close, ts) as c, arg_min(ts, (-high, ts)) as ht, arg_min(ts, (low, ts)) as xt from day group by symbol, first, day_start, day_end, step
        having first <= day_start and (step <= 0 or date_diff('second', max(ts), day_end) <= step))) using (symbol)""",
    """whole as (select *, day_end - interval 24 hours as day_start from (select symbol, min(ts) as first, arg_max(close, ts) as current, coalesce(median(date_diff('second', b, ts)), 0) as step,
        timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', max(ts)))))) as day_end from (select *, lag(ts) over (partition by symbol order by ts) as b from bars) group by symbol)),
    day as (select r.*, first, day_start, day_end, step from r join whole using (symbol) where ts >= day_start and ts < day_end)""",
)
RATIOS = "(values (0.0), (0.236), (0.382), (0.5), (0.618), (0.786), (1.0)) as t(q)"
SPAN = "span as (select symbol, max(high) as h, min(low) as x from bars group by 1)"
ORACLES["fib_levels"] = sql(
    f"select symbol, 'retracement' as level_type, round(cast(q as double), 6) as level_ratio, round(x + (h - x) * cast(q as double), 6) as price, round(h, 6) as swing_high, round(x, 6) as swing_low, cast(null as varchar) as trend_direction from span, {RATIOS}", SPAN
)
ORACLES["fib_extension"] = sql(
    """select symbol, 'extension' as level_type, round(cast(q as double), 6) as level_ratio, round(case when d = 'bullish' then x + (h - x) * cast(q as double) else h - (h - x) * cast(q as double) end, 6) as price, round(h, 6) as swing_high,
    round(x, 6) as swing_low, d as trend_direction from span, (values (1.272), (1.618), (2.0), (2.618)) as t(q), (values ('bullish'), ('bearish')) as u(d)""",
    SPAN,
)


def recurrence(state: str, first: str, step: str) -> str:
    """e: symbol, rn and the state's columns; first from r at rn = 1 (as r), step from e (before) and r (this row)."""
    return f"e as (select symbol, rn, {first} from r where rn = 1 union all select r.symbol, r.rn, {step} from e join r on r.symbol = e.symbol and r.rn = e.rn + 1)"


def ema_step(x: str, y: str, n: int) -> str:
    return f"(1 - 2.0::double / {n + 1}) * {y} + 2.0::double / {n + 1} * {x}"


STACK = recurrence("", ", ".join(f"close as y{n}" for n in (7, 25, 50, 200)), ", ".join(f"{ema_step('r.close', f'e.y{n}', n)}" for n in (7, 25, 50, 200)))
JOIN = "from e join r using (symbol, rn)"
ORACLES["ema"] = sql(f"select symbol, ts, round(y7, 6) as ema {JOIN} where n >= 7", STACK, True)
ORACLES["ema_stack"] = sql(f"select symbol, ts, round(y7, 6) as ema7, round(y25, 6) as ema25, round(y50, 6) as ema50, round(y200, 6) as ema200 {JOIN} where n >= 200", STACK, True)
ORACLES["ema_cross"] = sql(
    f"select symbol, ts, round(y7, 6) as ema7, round(y25, 6) as ema25, case when above then 'cross_up' else 'cross_down' end as \"cross\" from (select *, lag(above) {W}) as before from (select symbol, ts, y7, y25, y7 > y25 as above {JOIN} where n >= 25)) where above <> before", STACK, True
)
ORACLES["ema_order"] = sql(f"select symbol, ts, y7 > y25 and y25 > y50 and y50 > y200 as golden, y7 < y25 and y25 < y50 and y50 < y200 as death {JOIN} where rn = n and n >= 200", STACK, True)
MACD = recurrence("", "close as a, close as b, cast(0 as double) as s", f"{ema_step('r.close', 'e.a', 12)}, {ema_step('r.close', 'e.b', 26)}, {ema_step('((' + ema_step('r.close', 'e.a', 12) + ') - (' + ema_step('r.close', 'e.b', 26) + '))', 'e.s', 9)}")
ORACLES["macd"] = sql(f"select symbol, ts, round(a - b, 6) as macd, round(s, 6) as signal, round(a - b - s, 6) as histogram {JOIN} where n >= 26", MACD, True)

# seeds by a mean at row n: the sum grows up to row n, then the smoothing begins
CHANGES = f"d as (select *, greatest(coalesce(close - lag(close) {W}), 0), 0) as gain, greatest(coalesce(lag(close) {W}) - close, 0), 0) as loss, {TR} as tr from r)"


def seeded(columns: list[str], n: int) -> str:
    first = ", ".join(f"cast({c} as double) / {n} as {c}" for c in columns)
    step = ", ".join(f"case when d.rn <= {n} then e.{c} + d.{c} / {n} else e.{c} * (1 - 1.0::double / {n}) + d.{c} / {n} end" for c in columns)
    return f"{CHANGES}, e as (select symbol, rn, {first} from d where rn = 1 union all select d.symbol, d.rn, {step} from e join d on d.symbol = e.symbol and d.rn = e.rn + 1)"


RSI_VALUE = "case when rn < 14 then null when e.loss = 0 then (case when e.gain = 0 then 50 else 100 end) else 100 - 100 / (1 + e.gain / e.loss) end"
RSI = seeded(["gain", "loss"], 14) + f", q as (select symbol, ts, rn, n, close, {RSI_VALUE} as rsi from e join r using (symbol, rn) where n >= 15)"
ORACLES["rsi_smma"] = sql("select symbol, ts, round(close, 6) as close, round(rsi, 6) as rsi from q", RSI, True)
ORACLES["rsi_extremes"] = sql(
    f"""select symbol, ts, round(rsi, 6) as rsi, zone from (select *, lag(zone, 1, 'neutral') {W}) as before from (
        select *, case when rsi <= 30 then 'oversold' when rsi >= 70 then 'overbought' else 'neutral' end as zone from q where rsi is not null)) where zone <> before""",
    RSI, True,
)
ORACLES["rsi_cross"] = sql(f"select symbol, ts, round(rsi, 6) as rsi, case when above then 'bullish' else 'bearish' end as direction from (select *, lag(above) {W}) as before from (select *, rsi >= 50 as above from q where rsi is not null)) where above <> before", RSI, True)
PAST = f"{W} rows between 19 preceding and 2 preceding)"
ORACLES["rsi_divergence"] = sql(
    f"""select symbol, ts, round(close, 6) as close, round(rsi, 6) as rsi, case when is_low and close < lc and rsi > lr then 'bullish' else 'bearish' end as divergence from (
        select *, last_value(case when is_low then close end ignore nulls) {PAST} as lc, last_value(case when is_low then rsi end ignore nulls) {PAST} as lr,
            last_value(case when is_high then close end ignore nulls) {PAST} as hc, last_value(case when is_high then rsi end ignore nulls) {PAST} as hr from (
            select *, row_number() {W}) - 1 as i, count(*) over (partition by symbol) as m, close < lag(close) {W}) and close < lead(close) {W}) as is_low, close > lag(close) {W}) and close > lead(close) {W}) as is_high from q where rsi is not null))
    where i >= 10 and i < m - 10 and ((is_low and close < lc and rsi > lr) or (is_high and close > hc and rsi < hr))""",
    RSI, True,
)
ATR = seeded(["tr"], 14) + ", a as (select symbol, rn, ts, case when rn >= 14 then e.tr end as atr from e join r using (symbol, rn) where n >= 14)"
ORACLES["atr"] = sql("select symbol, ts, round(atr, 6) as atr from a", ATR, True)
ORACLES["smma"] = sql(
    "select symbol, ts, case when rn >= 14 then round(y, 6) end as smma from e join r using (symbol, rn) where n >= 14",
    recurrence("", "close / 14 as y", "case when r.rn <= 14 then e.y + r.close / 14 else e.y * (1 - 1.0::double / 14) + r.close / 14 end"), True,
)
ORACLES["rsi_ema"] = sql(
    "select symbol, ts, round(close, 6) as close, round(case when e.loss = 0 then (case when e.gain = 0 then 50 else 100 end) else 100 - 100 / (1 + e.gain / e.loss) end, 6) as rsi from e join r using (symbol, rn) where n >= 15",
    CHANGES + ", e as (select symbol, rn, gain, loss from d where rn = 1 union all select d.symbol, d.rn, " + ", ".join(ema_step(f"d.{c}", f"e.{c}", 14) for c in ("gain", "loss")) + " from e join d on d.symbol = e.symbol and d.rn = e.rn + 1)", True,
)
_alpha = lambda x, y: f"(1 - 1.0::double / 14) * {y} + {x} / 14"
MOVES = f"d as (select *, {TR} as tr, case when up > down and up > 0 then up else 0 end as p, case when down > up and down > 0 then down else 0 end as m from (select *, coalesce(high - lag(high) {W}), 0) as up, coalesce(lag(low) {W}) - low, 0) as down from r))"
ORACLES["adx"] = sql(
    "select symbol, ts, round(e.adx, 6) as adx, round(e.pd, 6) as plus_di, round(e.md, 6) as minus_di from e join r using (symbol, rn) where n >= 28",
    MOVES + """, s as (select symbol, rn, tr, cast(p as double) as p, cast(m as double) as m from d where rn = 1 union all select d.symbol, d.rn, """ + ", ".join(_alpha(f"d.{c}", f"s.{c}") for c in ("tr", "p", "m")) + """ from s join d on d.symbol = s.symbol and d.rn = s.rn + 1),
    di as (select symbol, rn, case when tr = 0 then 0 else 100 * p / tr end as pd, case when tr = 0 then 0 else 100 * m / tr end as md from s), dx as (select *, case when pd + md = 0 then 0 else 100 * abs(pd - md) / (pd + md) end as dx from di),
    e as (select symbol, rn, cast(dx as double) as adx, pd, md from dx where rn = 1 union all select dx.symbol, dx.rn, """ + _alpha("dx.dx", "e.adx") + ", dx.pd, dx.md from e join dx on dx.symbol = e.symbol and dx.rn = e.rn + 1)", True,
)

ORACLES["latest_ticker"] = """select symbol, top as ts, round(price, 6) as price, cast(null as double) as bid, cast(null as double) as ask, round((price - b) / nullif(b, 0) * 100, 6) as change_pct_24h, v as volume_24h from (select event_type as symbol, max(ts) as top, arg_max(value, (ts, event_id)) as price from events group by 1)
left join (select event_type as symbol, arg_max(value, (ts, event_id)) filter (where ts <= top - interval 24 hours) as b, cast(count(*) filter (where ts > top - interval 24 hours) as double) as v from events join (select event_type, max(ts) as top from events group by 1) using (event_type) group by 1) using (symbol)"""
ORACLES["bars_daily_orders"] = """select o_orderpriority as symbol, cast(date_trunc('day', cast(o_orderdate as timestamp)) as timestamp) as ts, round(arg_min(cast(o_totalprice as double), (o_orderdate, o_orderkey)), 6) as open, round(max(cast(o_totalprice as double)), 6) as high,
round(min(cast(o_totalprice as double)), 6) as low, round(arg_max(cast(o_totalprice as double), (o_orderdate, o_orderkey)), 6) as close, cast(count(*) as double) as volume from orders group by 1, 2"""
ORACLES["tpo_refused"] = sql("select symbol, 'more_periods_than_markers' as reason from bars group by 1 having count(*) > 62")
ORACLES["order_book"] = """select symbol, side, price, amount, level from (select *, row_number() over (partition by symbol, side order by case when side = 'bid' then -price else price end) as level from (
select l_linestatus as symbol, case when l_returnflag = 'A' then 'bid' else 'ask' end as side, round(cast(l_extendedprice as double) / cast(l_quantity as double), 2) as price, sum(cast(l_quantity as double)) as amount from lineitem group by 1, 2, 3)) where level <= 10"""
ORACLES["symbol_mentions"] = "select doc_id, regexp_matches(' ' || replace(lower(coalesce(text, '')), ' ', '  ') || ' ', '[^a-z0-9](the|of)[^a-z0-9]') as mentioned from documents"
ORACLES["walk_forward_splits"] = sql("select symbol, cast(s / 50 as bigint) as split, s as start, s + 100 as test_start, s + 150 as \"end\" from (select symbol, unnest(range(0, n - 149, 50)) as s from (select symbol, count(*) as n from bars group by 1) where n >= 150)")
ORACLES["initial_balance"] = sql("select symbol, round(arg_min(low, ts), 6) as ib_low, round(arg_min(high, ts), 6) as ib_high, max(high) > arg_min(high, ts) as expanded_up, min(low) < arg_min(low, ts) as expanded_down from bars group by 1")
ORACLES["return_metrics"] = sql(
    f"""select symbol, round(case when s > 0 then sqrt(252) * m / s else 0 end, 6) as sharpe, round(case when ds > 0 then sqrt(252) * m / ds else 0 end, 6) as sortino, round(x, 6) as max_drawdown, round(s * sqrt(252), 6) as volatility from (
        select symbol, avg(q) as m, stddev_pop(q) as s, stddev_pop(q) filter (where q < 0) as ds, min(g / p - 1) as x from (select *, max(g) {RUN} as p from (select *, exp(sum(ln(1 + q)) {RUN}) as g from (select *, close / lag(close) {W}) - 1 as q from r) where q is not null)) group by 1)"""
)


def swing_ctes(least: float) -> str:
    """sw: symbol, id, kind, i, price, from_i, from_price, with times. The state machine as a recursion over candidates."""
    rep = "(c.kind = s.kind and case when c.kind = 'high' then c.price >= s.price else c.price <= s.price end)"
    app = f"(c.kind <> s.kind and abs(c.price - s.price) / case when s.price = 0 then 1 else abs(s.price) end >= {least})"
    new = f"({rep} or {app})"
    return f"""{CANDIDATES}, c0 as (select symbol, i, 'low' as kind, low as price from cand where is_low union all select symbol, i, 'high', high from cand where is_high),
    c as (select *, row_number() over (partition by symbol order by i, kind desc) as k from c0),
    s as (select c.symbol, c.k, cast(1 as bigint) as id, c.kind, c.price, c.i, greatest(0, c.i - 2) as from_i, r.close as from_price from c join r on r.symbol = c.symbol and r.rn = greatest(0, c.i - 2) + 1 where c.k = 1
      union all select c.symbol, c.k, case when {app} then s.id + 1 else s.id end, case when {app} then c.kind else s.kind end, case when {new} then c.price else s.price end, case when {new} then c.i else s.i end,
        case when {app} then s.i else s.from_i end, case when {app} then s.price else s.from_price end from s join c on c.symbol = s.symbol and c.k = s.k + 1),
    sw as (select f.*, p.ts, q.ts as from_ts from (select symbol, id, arg_max(kind, k) as kind, arg_max(price, k) as price, arg_max(i, k) as i, arg_max(from_i, k) as from_i, arg_max(from_price, k) as from_price from s group by 1, 2) f
      join r p on p.symbol = f.symbol and p.rn = f.i + 1 join r q on q.symbol = f.symbol and q.rn = f.from_i + 1)"""


ORACLES["swings"] = sql(
    """select symbol, id as swing_id, i as pivot_index, kind as swing_type, ts as pivot_ts, round(price, 6) as pivot_price, from_ts as leg_start_ts, round(from_price, 6) as leg_start_price, ts as leg_end_ts, round(price, 6) as leg_end_price,
    round(price - from_price, 6) as price_delta, round(abs(price - from_price) / case when from_price = 0 then 1 else abs(from_price) end, 6) as pct_delta from sw""",
    swing_ctes(0.02), True,
)
ORACLES["market_structure"] = sql(
    """select symbol, row_number() over (partition by symbol order by id) as event_id, ts as event_ts, id as swing_id, kind as swing_type, class as classification, ref_id as reference_swing_id, round(ref, 6) as reference_price, round(price, 6) as current_price,
    round(price - ref, 6) as price_delta, round(case when ref = 0 then 0 else abs(price - ref) / abs(ref) end, 6) as pct_delta,
    case when h is null or l is null then 'transition' when h in ('HH', 'EH') and l = 'HL' then 'bullish' when h = 'LH' and l in ('LL', 'EL') then 'bearish' when h = 'LH' and l = 'HL' then 'transition' else 'range' end as trend_state from (
        select *, last_value(case when kind = 'high' then class end ignore nulls) over o as h, last_value(case when kind = 'low' then class end ignore nulls) over o as l from (
            select *, case when abs(price - ref) <= 1e-9 then 'E' || upper(kind[1]) when kind = 'high' then case when price > ref then 'HH' else 'LH' end else case when price < ref then 'LL' else 'HL' end end as class from (
                select *, lag(price) over w as ref, lag(id) over w as ref_id from sw window w as (partition by symbol, kind order by id)) where ref is not null)
        window o as (partition by symbol order by id rows between unbounded preceding and current row))""",
    swing_ctes(0.02), True,
)
RANGES = swing_ctes(0.02) + """, hi as (select *, row_number() over (partition by symbol order by i) as k from sw where kind = 'high'), lo as (select * from sw where kind = 'low'),
    pr as (select a.symbol, a.k as ka, b.k as kb, a.i as ia, b.i as ib, a.ts as start_ts, b.ts as end_ts from hi a join hi b on a.symbol = b.symbol and b.k > a.k and b.k < a.k + 20),
    pl as (select pr.*, min(lo.price) as bottom from pr join lo on lo.symbol = pr.symbol and lo.i between ia and ib group by all having count(*) >= 2),
    ph as (select pl.*, max(hi.price) as top from pl join hi on hi.symbol = pl.symbol and hi.k between ka and kb group by all),
    rg as (select *, (top + bottom) / 2 as mid, top - bottom as width, top - (top - bottom) * 0.001 as t, bottom + (top - bottom) * 0.001 as b from ph where (top + bottom) / 2 = 0 or (top - bottom) / ((top + bottom) / 2) <= 2.0),
    rc as (select rg.symbol, start_ts, end_ts, top, bottom, mid, width, t, b, count(*) as k, avg(case when close between b and t then 1.0::double else 0 end) as share, arg_max(close, r.ts) as final from rg join r on r.symbol = rg.symbol and r.ts between start_ts and end_ts group by 1, 2, 3, 4, 5, 6, 7, 8, 9),
    ranges as (select *, row_number() over (partition by symbol order by start_ts, end_ts, top, bottom) as id from rc where share + 1e-9 >= 0.8)"""
ORACLES["price_ranges"] = sql(
    """select symbol, id as range_id, start_ts, end_ts, round(top, 6) as range_high, round(bottom, 6) as range_low, round(mid, 6) as range_mid, round(width, 6) as range_width, round(case when mid = 0 then 0 else width / mid end, 6) as range_width_pct,
    k as bars_evaluated, round(round(share, 4), 6) as containment_ratio, case when final > t then 'broken_up' when final < b then 'broken_down' else 'active' end as status from ranges""",
    RANGES, True,
)
ORACLES["range_breakouts"] = sql(
    """select symbol, row_number() over (partition by symbol order by id) as breakout_id, id as range_id, at_ts as breakout_ts, case when up then 'up' else 'down' end as direction, round(c, 6) as breakout_price, round(case when up then top else bottom end, 6) as boundary_price,
    round(case when up then c - top else bottom - c end, 6) as distance, round(case when up then (c - top) / nullif(top, 0) else coalesce((bottom - c) / nullif(bottom, 0), 0) end, 6) as distance_pct, cast(1 as bigint) as confirm_bars from (
        select g.symbol, id, top, bottom, min(r.ts) as at_ts, arg_min(close, r.ts) as c, arg_min(close > top, r.ts) as up from ranges g join r on r.symbol = g.symbol and r.ts >= end_ts and (close > top + width * 0.001 or close < bottom - width * 0.001) group by 1, 2, 3, 4)""",
    RANGES, True,
)


def area_ctes(cells: str, share: float) -> str:
    """va: symbol, poc, lo, hi, from cells (symbol, bin, v)."""
    left = "(lo > 0 and (hi = n - 1 or v[lo] >= v[hi + 2]))"
    return f"""{cells}, vp as (select symbol, list(v order by bin) as v, sum(v) as total, count(*) as n, arg_min(bin, (-v, bin)) as poc from cells group by 1),
    g as (select symbol, v, total, n, poc, poc as lo, poc as hi, v[poc + 1] as held from vp where total > 0
      union all select symbol, v, total, n, poc, case when {left} then lo - 1 else lo end, case when {left} then hi else hi + 1 end, held + case when {left} then v[lo] else v[hi + 2] end from g where held < total * {share} and (lo > 0 or hi < n - 1)),
    va as (select symbol, any_value(poc) as poc, min(lo) as lo, max(hi) as hi from g group by 1)"""


PROFILE = area_ctes(
    """e as (select symbol, min(low) as a, max(high) as z from bars group by 1), edges as (select symbol, cast(k as bigint) as bin, a + k * ((z - a) / 50) as x, case when k = 49 then z else a + (k + 1) * ((z - a) / 50) end as y from e, range(0, 50) as t(k)),
    touched as (select d.symbol, bin, b.ts, b.low, b.high, b.volume, x, y, row_number() over (partition by d.symbol, b.ts order by bin) as first from edges d join bars b on b.symbol = d.symbol and case when b.low = b.high then x <= b.low and b.low <= y else x < b.high and y > b.low end),
    cells as (select edges.*, round(coalesce(v, 0), 9) as v, coalesce(k, 0) as k from edges left join (select symbol, bin, sum(case when volume <= 0 then 0 when low = high then volume else volume * ((least(high, y) - greatest(low, x)) / (high - low)) end) as v, count(*) as k from touched where low < high or first = 1 group by 1, 2) using (symbol, bin))""",
    0.7,
)
SHAPES = """(select *, case when k = 1 or top / total > 0.8 then 'single' when spread < 0.05 then 'flat' when k >= 4 and peaks >= 2 and far >= 0.3 * k then 'bimodal'
        when poc / (k - 1) < 0.3 and l > 2 * g then 'directional' when poc / (k - 1) > 0.7 and g > 2 * l then 'directional' else 'bell' end as shape from (
        select symbol, poc, max((x + y) / 2) filter (where bin = poc) as poc_price, max(y) filter (where bin between lo and hi) as vah, min(x) filter (where bin between lo and hi) as val, count(*) as k, sum(v) as total, max(v) as top, var_samp(v / top_v) as spread,
            count(*) filter (where v > b and v > a) as peaks, max(bin) filter (where v > b and v > a) - min(bin) filter (where v > b and v > a) as far, coalesce(sum(v) filter (where bin < poc), 0) as l, coalesce(sum(v) filter (where bin > poc), 0) as g from (
            select *, lag(v) over (partition by symbol order by bin) as b, lead(v) over (partition by symbol order by bin) as a, max(v) over (partition by symbol) as top_v from cells join va using (symbol)) group by 1, 2))"""
PROFILE_ROWS = f"""select cells.symbol, bin, round(x, 6) as bin_low, round(y, 6) as bin_high, round((x + y) / 2, 6) as bin_mid, round(v, 6) as volume, cells.k as candles, v >= quantile_cont(v, 0.8) over (partition by cells.symbol) as is_hvn,
    v <= quantile_cont(v, 0.2) over (partition by cells.symbol) as is_lvn, bin between lo and hi as in_value_area, va.poc, shape from cells join va on va.symbol = cells.symbol join {SHAPES} sh on sh.symbol = cells.symbol"""
ORACLES["volume_profile"] = sql(PROFILE_ROWS, PROFILE, True)
TPO = area_ctes(
    """b as (select * replace (symbol || '|' || cast(ts as date) as symbol), row_number() over (partition by symbol, cast(ts as date) order by ts) as i from r), e as (select symbol, cast(min(low) as decimal(18, 6)) as a, max(high) as z from b group by 1),
    steps as (select symbol, a, z, cast(floor((cast(z as decimal(18, 6)) - a) / 5) as bigint) as k from e), edges as (select symbol, j as bin, cast(a + 5 * j as double) as x, cast(a + 5 * (j + 1) as double) as y from (select *, unnest(range(0, case when cast(a + 5 * k as double) < z then k + 1 else k end)) as j from steps)),
    touched as (select d.symbol, bin, b.ts, b.i, b.low, b.high, row_number() over (partition by d.symbol, b.ts order by bin) as first from edges d join b on b.symbol = d.symbol and case when b.low = b.high then x <= b.low and b.low <= y else x < b.high and y > b.low end),
    cells as (select edges.*, coalesce(v, 0) as v, coalesce(m, '') as m from edges left join (select symbol, bin, count(*) as v, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', i, 1), '' order by i) as m from touched where low < high or first = 1 group by 1, 2) using (symbol, bin))""",
    0.7,
)
ORACLES["tpo"] = sql("select symbol, bin as row, round(x, 6) as row_low, round(y, 6) as row_high, round((x + y) / 2, 6) as row_mid, v as tpo_count, m as markers, bin between lo and hi as in_value_area, poc from cells join va using (symbol)", TPO, True)
BLOCKS = ATR + f""", z0 as (select r.symbol, r.ts, open, high, low, close, coalesce(atr, 0) as atr, r.rn - 1 as i, n - 1 as last_i from r left join a on a.symbol = r.symbol and a.rn = r.rn),
    z1 as (select *, lag(ts) {W}) as pts, lag(open) {W}) as po, lag(high) {W}) as ph, lag(low) {W}) as pl, lag(close) {W}) as pc, lead(low) {W}) > lag(high) {W}) as up_gap, lead(high) {W}) < lag(low) {W}) as down_gap from z0),
    z2 as (select *, close > open and pc < po and close > ph as up, close < open and pc > po and close < pl as down from z1 where i >= 2 and i < last_i and abs(close - open) >= atr),
    z3 as (select symbol, case when up then 'bullish' else 'bearish' end as direction, pts as block_ts, i - 1 as block_i, i as created_i, case when up then pl else po end as zone_low, case when up then po else ph end as zone_high, atr, case when up then up_gap else down_gap end as has_gap, last_i from z2 where up or down),
    zn as (select z3.*, coalesce(bool_or(case when direction = 'bullish' then r.close < zone_low else r.close > zone_high end), false) as invalidated from z3 left join r on r.symbol = z3.symbol and r.rn - 1 > block_i group by all)"""
ORACLES["order_block_candidates"] = sql("select symbol, direction, block_ts, block_i, created_i, round(zone_low, 6) as zone_low, round(zone_high, 6) as zone_high, round(atr, 6) as atr, has_gap, invalidated from zn", BLOCKS, True)
ORACLES["order_blocks"] = sql("select symbol, direction as type, block_ts as date, round(zone_low, 6) as zone_low, round(zone_high, 6) as zone_high, last_i - created_i as freshness, has_gap from zn where not invalidated and last_i - created_i <= 20", BLOCKS, True)

KEYWORDS = "k0 as (select doc_id, lower(phrase || ' ' || coalesce(text, '')) as t0 from (select *, ['to the moon moon', 'pump and dump', 'bears bear bull', 'rugpull rug crash', 'bullish'][cast(doc_id % 5 + 1 as bigint)] as phrase from documents))"
ORACLES["keyword_boost"] = f"""with {KEYWORDS}, k1 as (select *, regexp_replace(t0, '\\bto the moon\\b', '###') as t1 from k0) select doc_id, round(greatest(least(cast((
    regexp_matches(t0, '\\bto the moon\\b')::int + regexp_matches(t1, '\\balts are up\\b')::int + regexp_matches(t1, '\\bbullish\\b')::int + regexp_matches(t1, '\\bmoon\\b')::int + regexp_matches(t1, '\\bpump\\b')::int
    - regexp_matches(t1, '\\brugpull\\b')::int - regexp_matches(t1, '\\bbearish\\b')::int - regexp_matches(t1, '\\bdump\\b')::int - regexp_matches(t1, '\\bcrash\\b')::int - regexp_matches(t1, '\\brug\\b')::int - regexp_matches(t1, '\\bbear\\b')::int
    ) as double) * 0.15, 1), -1), 6) as boost from k1"""
SCORES = """lex(word, valence) as (values ('the', 0.5::double), ('of', -0.4), ('and', 0.3), ('der', 0.2), ('la', -0.6), ('crash', -2.0)),
    words as (select doc_id, source, coalesce(text, '') as text, unnest(case when len(w) = 0 then [null] else w end) as word from (select *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}'']+'), lambda w: w <> '') as w from documents)),
    sums as (select doc_id, sum(coalesce(valence, 0)) as s, coalesce(sum(valence + 1) filter (where valence > 0), 0) as p, coalesce(sum(1 - valence) filter (where valence < 0), 0) as n, count(*) filter (where word is not null and coalesce(valence, 0) = 0) as z from words left join lex using (word) group by 1),
    base as (select sums.*, source, round(s / sqrt(s * s + 15), 4) as compound, lower(coalesce(text, '')) as t from sums join documents using (doc_id)),
    boosted as (select *, greatest(least(cast((regexp_matches(t, '\\bto the moon\\b')::int + regexp_matches(t, '\\balts are up\\b')::int + regexp_matches(t, '\\bbullish\\b')::int + regexp_matches(regexp_replace(t, '\\bto the moon\\b', '#'), '\\bmoon\\b')::int + regexp_matches(t, '\\bpump\\b')::int
      - regexp_matches(t, '\\brugpull\\b')::int - regexp_matches(t, '\\bbearish\\b')::int - regexp_matches(t, '\\bdump\\b')::int - regexp_matches(t, '\\bcrash\\b')::int - regexp_matches(t, '\\brug\\b')::int - regexp_matches(t, '\\bbear\\b')::int) as double) * 0.15, 1), -1) as boost from base),
    scored as (select *, round(greatest(least(compound + boost, 1), -1), 4) as final from boosted)"""
ORACLES["sentiment_scores"] = f"with {SCORES} select doc_id, round(coalesce(p / nullif(p + n + z, 0), 0), 4) as pos, round(coalesce(z / nullif(p + n + z, 0), 0), 4) as neu, round(coalesce(n / nullif(p + n + z, 0), 0), 4) as neg, compound, round(boost, 4) as keyword_boost, final as final_score from scored"
ORACLES["sentiment_summary"] = f"with {SCORES} select source, count(*) as total, cast(round(cast(cast(cast(sum(cast(final as decimal(18, 4))) as double) / count(*) as varchar) as decimal(20, 12)), 4) as double) as avg_sentiment, count(*) filter (where final > 0.05) as positive, count(*) filter (where final < -0.05) as negative, count(*) filter (where final between -0.05 and 0.05) as neutral from scored group by 1"

# The engine: one recursion over bars with cash, side (1, -1, 0), entry price, size, fee and what a closed trade was.
def engine(acts: str) -> str:
    """acts: r with act (entry, exit, hold) and dir (1, -1) of each row."""
    return f"""g as (select symbol, rn, ts, open as o, close as c, lag(act) {W}) as act, lag(dir) {W}) as dir from ({acts})),
    e as (select symbol, rn, cast(100000 as double) as cash, 0 as side, cast(0 as double) as entry, cast(0 as double) as size, cast(0 as double) as fee, rn as entry_rn, cast(null as double) as exit, cast(null as double) as gross, cast(null as double) as net, cast(null as double) as fees, cast(null as bigint) as held, cast(null as bigint) as was,
        cast(null as double) as was_entry, cast(null as double) as was_size from g where rn = 1
      union all select symbol, rn, cash + coalesce(net, 0) - case when opens then new_size * new_entry * 0.001 else 0 end, case when opens then dir when closes then 0 else side end, case when opens then new_entry else entry end, case when opens then new_size else size end,
        case when opens then new_size * new_entry * 0.001 else fee end, case when opens then rn else entry_rn end, fill, gross, net, fees, case when closes then rn - entry_rn end, case when closes then entry_rn end, case when closes then entry end, case when closes then size end from (
          select *, gross - fees - size * 0.0005 * (entry + fill) / 2 as net from (
            select *, case when closes then side * (fill - entry) * size end as gross, case when closes then fee + fill * size * 0.001 end as fees from (
              select g.symbol, g.rn, g.dir, e.cash, e.side, e.entry, e.size, e.fee, e.entry_rn, g.act = 'entry' and e.side = 0 and g.o > 0 and round(e.cash / (g.o * (1 + g.dir * 0.0005)), 8) > 0 as opens, g.act = 'exit' and e.side <> 0 as closes,
                g.o * (1 + g.dir * 0.0005) as new_entry, round(e.cash / nullif(g.o * (1 + g.dir * 0.0005), 0), 8) as new_size, case when g.act = 'exit' and e.side <> 0 then g.o * (1 - e.side * 0.0005) end as fill from e join g on g.symbol = e.symbol and g.rn = e.rn + 1)))),
    curve as (select e.symbol, e.rn, g.ts, cash + side * (c - entry) * size as equity, e.* exclude (symbol, rn) from e join g using (symbol, rn)),
    trades as (select t.symbol, row_number() over (partition by t.symbol order by t.rn) as trade_id, a.ts as entry_ts, t.ts as exit_ts, t.was_entry as entry_price, t.exit as exit_price, t.was_size as size, gross, net, fees, held, case when sign(gross) = sign(t.exit - t.was_entry) then 'long' else 'short' end as side
      from curve t join r a on a.symbol = t.symbol and a.rn = t.was where held is not null)"""


BY_HOUR = """select *, case when day(ts) % 2 = 0 then 1 else -1 end as dir, case when ts = max(ts) over (partition by symbol, cast(ts as date)) then 'exit' when hour(ts) in (2, 10) then 'entry' when hour(ts) in (7, 18) then 'exit' else 'hold' end as act from r"""
ENGINE = engine(BY_HOUR)
def _engine_queries(ctes: str) -> tuple[str, str, str]:
    """SQL for equity, trades and metrics of an engine."""
    equity = sql("select symbol, rn - 1 as i, ts, round(equity, 6) as equity from curve where rn > 1", ctes, True)
    trades = sql("select symbol, trade_id, side, entry_ts, exit_ts, round(entry_price, 6) as entry_price, round(exit_price, 6) as exit_price, round(size, 6) as size, round(gross, 6) as gross_pnl, round(net, 6) as net_pnl, round(fees, 6) as commission, held as bars_held from trades", ctes, True)
    metrics = sql(
    f"""select symbol, round(final, 6) as final_equity, round((final - 100000) / 100000, 6) as total_return, round(down, 6) as max_drawdown, round(case when s > 0 then sqrt(252) * m / s else 0 end, 6) as sharpe_ratio, coalesce(k, 0) as total_trades, round(coalesce(wins / k, 0), 6) as win_rate, coalesce(wins, 0) as wins,
        coalesce(k - wins, 0) as losses, round(coalesce(aw, 0), 6) as avg_win, round(coalesce(al, 0), 6) as avg_loss, case when k is null then 0 when l > 0 then round(w / l, 6) when w > 0 then 'infinity'::double else 0 end as profit_factor, round(coalesce(wins / k * aw - (1 - wins / k) * al, 0), 6) as expectancy from (
        select symbol, arg_max(equity, rn) as final, abs(min((equity - peak) / peak)) as down, avg(q) as m, stddev_pop(q) as s from (select *, max(equity) {W.replace("ts", "rn")} rows between unbounded preceding and current row) as peak, equity / lag(equity) {W.replace("ts", "rn")}) - 1 as q from curve where rn > 1) group by 1)
      left join (select symbol, count(*) as k, cast(count(*) filter (where net > 0) as bigint) as wins, coalesce(avg(net) filter (where net > 0), 0) as aw, abs(coalesce(avg(net) filter (where net <= 0), 0)) as al, coalesce(sum(net) filter (where net > 0), 0) as w, abs(coalesce(sum(net) filter (where net <= 0), 0)) as l from trades group by 1) using (symbol)""",
    ctes, True,
)
    return equity, trades, metrics


ORACLES["engine_equity"], ORACLES["engine_trades"], ORACLES["engine_metrics"] = _engine_queries(ENGINE)

TAIL = "t as (select *, row_number() over (partition by symbol order by ts) as i, count(*) over (partition by symbol) as m from (select * from r where rn > n - 100))"
FACTORS = f"""{TAIL}, d as (select *, greatest(coalesce(close - lag(close) {W}), 0), 0) as gain, greatest(coalesce(lag(close) {W}) - close, 0), 0) as loss from t),
    e as (select symbol, i, gain / 14 as u, loss / 14 as v, close / 7 as y7, close / 25 as y25, close / 50 as y50 from d where i = 1
      union all select d.symbol, d.i, case when d.i <= 15 then e.u + d.gain / 14 else (e.u * 13 + d.gain) / 14 end, case when d.i <= 15 then e.v + d.loss / 14 else (e.v * 13 + d.loss) / 14 end,
        {", ".join(f"case when d.i <= {n} then e.y{n} + d.close / {n} else e.y{n} + 2.0::double / {n + 1} * (d.close - e.y{n}) end" for n in (7, 25, 50))} from e join d on d.symbol = e.symbol and d.i = e.i + 1),
    f as (select symbol, ts, close as price, case when m < 15 then 50 when u + v = 0 then 0 else 100 * u / (u + v) end as rsi, {", ".join(f"case when m >= {n} then y{n} else 0 end as ema_{n}" for n in (7, 25, 50))} from e join d using (symbol, i) where i = m),
    w as (select symbol, case when count(*) = 20 and avg(close) <> 0 then 4 * stddev_pop(close) / avg(close) else 0 end as bollinger_width from t where i > m - 20 group by 1),
    q as (select symbol, case when any_value(m) >= 5 and avg(volume) filter (where i < m) > 0 then arg_max(volume, i) / avg(volume) filter (where i < m) else 1 end as volume_ratio from t where i > m - 20 group by 1),
    mo as (select symbol, coalesce((arg_max(close, i) - arg_min(close, i)) * 100 / nullif(arg_min(close, i), 0), 0) as momentum_pct from t where i >= m - 14 group by 1),
    fa as (select * from f join w using (symbol) join q using (symbol) join mo using (symbol))"""
_names = ("price", "rsi", "ema_7", "ema_25", "ema_50", "bollinger_width", "volume_ratio", "momentum_pct")
ORACLES["scan_factors"] = sql("select symbol, ts, " + ", ".join(f"round({n}, 6) as {n}" for n in _names) + " from fa", FACTORS, True)
_flags = {"rsi_oversold": "rsi < 30", "rsi_overbought": "rsi > 70", "trend_bullish": "ema_7 > ema_25 and ema_25 > ema_50", "trend_bearish": "ema_7 < ema_25 and ema_25 < ema_50", "high_volatility": "bollinger_width >= 0.08", "low_volatility": "bollinger_width <= 0.03", "volume_spike": "volume_ratio >= 1.5"}
ORACLES["screener_scan"] = sql(
    "select symbol, ts, " + ", ".join(f"round({n}, 6) as {n}" for n in _names) + """, array_to_string(l, ',') as filters_matched, round(len(l) / 7.0::double * 100, 6) as score from (
    select *, list_filter([""" + ", ".join(f"case when {c} then '{n}' end" for n, c in _flags.items()) + "], lambda x: x is not null) as l from fa)",
    FACTORS, True,
)
ORACLES["volume_profile_summary"] = sql(f"select symbol, round(poc_price, 6) as poc_price, poc as poc_bin, round(vah, 6) as vah_price, round(val, 6) as val_price, shape, k as bins, round(total, 6) as total_volume from {SHAPES}", PROFILE, True)
_B = "['USDT', 'usd', '/USDT', '-USDT', '-USD', 'BTC', 'USDC', '', '--x'][cast(c_custkey % 9 + 1 as bigint)]"
ORACLES["symbol_forms"] = f"""with a as (select c_custkey, substr(c_mktsegment, 1, 3) || {_B} as symbol from customer), b as (select *, upper(trim(symbol)) as s from a),
    c as (select *, case when contains(s, '/') then case when regexp_matches(s, '^[\\p{{L}}\\p{{N}}]+/[\\p{{L}}\\p{{N}}]+$') then s end when contains(s, '-') then case when regexp_matches(s, '^[\\p{{L}}\\p{{N}}]+-[\\p{{L}}\\p{{N}}]+$') and not s like '%-USD' then replace(s, '-', '/') end
      when s like '%USDT' or s like '%USDC' then s when s like '%USD' then s || 'T' end as p from b)
    select c_custkey, symbol, p as primary_form, case when contains(p, '/') then p when regexp_matches(p, '.(USDT|USDC|USD|BTC|ETH|BUSD)$') then regexp_replace(p, '^(.+?)(USDT|USDC|USD|BTC|ETH|BUSD)$', '\\1/\\2') end as market_form,
    case when s like '%USDT' then left(s, -1) when s like '%USD' then s end as legacy_form,
    case when contains(s, '/') then regexp_extract(s, '^(.*)/', 1) || '-USD' when s like '%-USD' then s when regexp_matches(s, '(USDT|USD)$') then case when not contains(s, '-') then regexp_replace(s, '(USDT|USD)$', '') || '-USD' end else regexp_replace(s, '[^\\p{{L}}\\p{{N}}]', '', 'g') || '-USD' end as secondary_form,
    regexp_replace(s, '(USDT|USD|BTC|ETH|BUSD)$', '') as base, case when contains(upper(symbol), '/') then split_part(upper(symbol), '/', 1) when contains(upper(symbol), '-') then split_part(upper(symbol), '-', 1) else regexp_replace(upper(symbol), '(USDT|USD|BTC|ETH)$', '') end as token,
    case when contains(s, '/') then s like '%/USDT' when contains(s, '-') then regexp_matches(s, '^[A-Z]+-USDT?$') else regexp_matches(s, '^.+(USDT|USDC|USD)$') end as valid from c"""


def _waves() -> str:
    """Impulses and corrections from sw, judged wave by wave."""
    lead_columns = ", ".join(f"lead({c}, {k}) over w as {n}{k + 1}" for k in range(5) for n, c in (("kind", "kind"), ("p", "price"), ("s", "from_price"), ("a", "from_ts"), ("z", "ts")))
    legs = ", ".join(f"abs(p{k} - s{k}) as w{k}" for k in range(1, 6))
    share = lambda x, of: f"case when {of} > 0 then {x} / {of} else 0 end"

    def degree(k: int) -> str:
        mean = "(" + " + ".join(f"w{j}" for j in range(1, k)) + f") / {k - 1}" if k > 1 else "0"
        return f"case when (case when {mean} > 0 then w{k} / ({mean}) else w{k} end) < 0.02 then 'micro' when (case when {mean} > 0 then w{k} / ({mean}) else w{k} end) < 0.08 then 'minor' else 'intermediate' end"

    text = lambda name, x, tail: f"'{name}' || printf('%.3f', {x}) || '{tail}'"
    parts = []
    for direction, sign in (("bullish", 1), ("bearish", -1)):
        up = direction == "bullish"
        r2, e3, r4, e5 = share("abs(p2 - p1)", "w1"), share(f"({sign} * (p3 - p1))", "w1"), share("abs(p4 - p3)", "w3"), share("abs(p5 - p4)", "w4")
        over, broken = f"({sign} * (p4 - p1) <= 0)", f"({sign} * (p5 - p4) <= 0)"
        rb, ec, cover = share("abs(p2 - p1)", "w1"), share("abs(p3 - p2)", "w1"), "(p3 >= s1)" if up else "(p3 <= s1)"
        five = [
            ("1", "null", "null", "false", "false", "true", "null"), ("2", r2, "null", "false", "false", f"({r2}) between 0.382 and 0.786", f"case when not (({r2}) between 0.382 and 0.786) then {text('wave2_retrace_', r2, '_not_in_band')} end"),
            ("3", "null", e3, "false", "false", f"({e3}) >= 1", f"case when ({e3}) < 1 then {text('wave3_extension_', e3, '_below_min')} end"),
            ("4", r4, "null", over, "false", f"(({r4}) <= 0.618 and not {over})", f"case when {over} then 'wave4_overlap_violation' when ({r4}) > 0.618 then {text('wave4_retrace_', r4, '_exceeds_max')} end"),
            ("5", "null", e5, "false", broken, f"(not {broken})", f"case when {broken} then 'wave5_invalidation_violation' end"),
        ]
        three = [
            ("A", "null", "null", "false", "false", "true", "null"), ("B", rb, "null", "false", "false", f"({rb}) between 0.382 and 0.886", f"case when not (({rb}) between 0.382 and 0.886) then {text('waveb_retrace_', rb, '_not_in_band')} end"),
            ("C", "null", ec, cover, "false", f"(({ec}) >= 1 and not {cover})", f"case when {cover} then 'wavec_overlap_violation' when ({ec}) < 1 then {text('wavec_extension_', ec, '_below_min')} end"),
        ]
        for kind, waves, kinds in (("impulse", five, "high low high low high" if up else "low high low high low"), ("corrective", three, "low high low" if up else "high low high")):
            match = " and ".join(f"kind{k} = '{x}'" for k, x in enumerate(kinds.split(), 1))
            accepted = " and ".join(f"({w[5]})" for w in waves)
            for k, (label, retrace, extension, violated, invalid, good, why) in enumerate(waves, 1):
                parts.append(
                    f"""select symbol, '{kind}_{direction}_' || i as sequence_id, '{kind}' as sequence_type, '{direction}' as direction, '{label}' as wave_label, cast({k} as bigint) as segment_order, {degree(k)} as degree, a{k} as start_ts, z{k} as end_ts, round(s{k}, 6) as start_price, round(p{k}, 6) as end_price,
                    round(p{k} - s{k}, 6) as price_delta, round(cast({retrace} as double), 6) as retrace_ratio, round(cast({extension} as double), 6) as extension_ratio, {violated} as overlap_violation, {invalid} as invalidation_violation, {good} as is_rule_compliant, cast({why} as varchar) as rejection_reason, {accepted} as is_accepted_sequence from x where {match}"""
                )
    return sql("\nunion all ".join(parts), f"{swing_ctes(0.05)}, x as (select *, {legs} from (select symbol, i, {lead_columns} from sw window w as (partition by symbol order by id)))", True)


ORACLES["elliott_waves"] = _waves()
# the last 48 bars of each symbol as `bars`, for the session scan
_s48 = sql("", "").replace("from events group by 1, 2)", "from events group by 1, 2 qualify row_number() over (partition by event_type order by date_trunc('hour', ts) desc) <= 48)", 1)
SESSION_SCAN = _s48.rstrip() + f""", s as (select *, hour({LOCAL}) * 60 + minute({LOCAL}) between 570 and 959 as inside, cast({LOCAL} as date) as d from r), today as (select symbol, arg_max(d, ts) as today from s group by 1),
    sl as (select symbol, arg_max(h, d) as session_high, arg_max(x, d) as session_low, arg_max(k, d) as session_bars from (select s.symbol, d, max(high) as h, min(low) as x, count(*) as k from s join today using (symbol) where inside and d in (today, today - 1) group by 1, 2) group by 1),
    whole as (select *, day_end - interval 24 hours as day_start from (select symbol, min(ts) as first, coalesce(median(date_diff('second', b, ts)), 0) as step, timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', max(ts)))))) as day_end
      from (select *, lag(ts) over (partition by symbol order by ts) as b from bars) group by symbol)),
    pd as (select symbol, max(high) as pdh, min(low) as pdl from r join whole using (symbol) where ts >= day_start and ts < day_end group by symbol, first, day_start, day_end, step having first <= day_start and (step <= 0 or date_diff('second', max(ts), day_end) <= step)),
    la as (select *, avg(volume) {W} rows between 19 preceding and 1 preceding) as mean from r qualify rn = n),
    j as (select la.symbol, ts, close as price, session_high, session_low, session_bars, pdh, pdl, list_filter([
        case when session_high > 0 then case when close > session_high then 'session_high_breakout' when close >= session_high * 0.995 then 'session_high_near_breakout' end end,
        case when session_low > 0 then case when close < session_low then 'session_low_breakout' when close <= session_low * 1.005 then 'session_low_near_breakout' end end,
        case when pdh > 0 then case when close > pdh then 'pdh_breakout' when close >= pdh * 0.995 then 'pdh_near_breakout' end end,
        case when pdl > 0 then case when close < pdl then 'pdl_breakout' when close <= pdl * 1.005 then 'pdl_near_breakout' end end,
        case when rn >= 5 and mean > 0 and volume >= mean * 1.5 then 'volume_confirmation' end], lambda x: x is not null) as l from la left join sl using (symbol) left join pd using (symbol))"""
ORACLES["session_scan"] = SESSION_SCAN + """
select symbol, ts, round(price, 6) as price, round(session_high, 6) as session_high, round(session_low, 6) as session_low, session_bars, round(pdh, 6) as pdh, round(pdl, 6) as pdl, array_to_string(l, ',') as filters_matched, score
    from (select *, least(coalesce(list_sum(list_transform(l, lambda x: case when x like 'session%_near_breakout' then 15 when x like 'session%' then 30 when x like '%near_breakout' then 10 when x = 'volume_confirmation' then 10 else 20 end)), 0), 100)::double as score from j where session_bars > 0 and pdh is not null)"""
ORACLES["session_scan_failures"] = SESSION_SCAN + "\nselect symbol, case when session_bars is null then 'insufficient_session_data' else 'insufficient_pdh_pdl_data' end as reason from j where session_bars is null or pdh is null"
ORACLES["supertrend"] = sql(
    "select symbol, ts, round(st, 6) as supertrend, round(way, 6) as direction from s join r using (symbol, rn)",
    f"""d as (select *, {TR} as tr, lag(close) {W}) as before from r), a as (select symbol, rn, cast(0 as double) as y from d where rn = 1 union all select d.symbol, d.rn, case when d.rn <= 11 then a.y + d.tr / 10 else (a.y * 9 + d.tr) / 10 end from a join d on d.symbol = a.symbol and d.rn = a.rn + 1),
    b as (select symbol, rn, close, before, rn >= 11 as ok, (high + low) / 2 + 3 * y as u, (high + low) / 2 - 3 * y as l from d join a using (symbol, rn)),
    s as (select symbol, rn, close as st, cast(1 as double) as way from b where rn = 1
      union all select symbol, rn, case when not ok then st when new > 0 then f else c end, case when not ok then way else new end from (select *, case when way > 0 then case when close < f then -1 else 1 end else case when close > c then 1 else -1 end end as new from (
        select b.symbol, b.rn, ok, b.close, s.st, s.way, case when l > s.st or before < s.st then l else s.st end as f, case when u < s.st or before > s.st then u else s.st end as c from s join b on b.symbol = s.symbol and b.rn = s.rn + 1)))""",
    True,
)

def _part(name: str) -> str:
    """Another query's rows as a subquery."""
    return f"({ORACLES[name]})"


ORACLES["structure_summary"] = sql(
    f"""select symbol, ts as summary_ts, round(close, 6) as current_price, regime, case when regime like 'breakout%' then case when distance_pct >= 0.003 then 0.85 else 0.75 end when regime = 'ranging' then 0.7 when regime like 'trending%' then case when abs(plus_di - minus_di) >= 5 then 0.8 else 0.7 end else 0.4 end::double as confidence,
        trend_state, classification, adx, plus_di, minus_di, range_id, range_high, range_low, range_mid, range_width_pct, containment_ratio, status as range_status, direction as breakout_direction, breakout_ts, breakout_price, distance_pct as breakout_distance_pct, recent as breakout_recent from (
        select *, case when recent and direction = 'up' then 'breakout_up' when recent and direction = 'down' then 'breakout_down' when status = 'active' and adx <= 20 then 'ranging'
            when trend_state = 'bullish' and adx >= 25 and plus_di - minus_di >= 2 then 'trending_up' when trend_state = 'bearish' and adx >= 25 and minus_di - plus_di >= 2 then 'trending_down' else 'transition' end as regime from (
            select z.*, m.trend_state, m.classification, adx, plus_di, minus_di, g.* exclude (symbol), direction, k.breakout_ts, k.breakout_price, k.distance_pct, coalesce(z.n - t.rn <= 3, false) as recent from (select * from r where rn = n and n >= 28) z
            left join (select * from {_part("market_structure")} qualify row_number() over (partition by symbol order by event_ts desc, event_id desc) = 1) m on m.symbol = z.symbol
            left join (select symbol, range_id, range_high, range_low, range_mid, range_width_pct, containment_ratio, status from {_part("price_ranges")} qualify row_number() over (partition by symbol order by end_ts desc, range_id desc) = 1) g on g.symbol = z.symbol
            left join {_part("range_breakouts")} k on k.symbol = z.symbol and k.range_id = g.range_id left join r t on t.symbol = k.symbol and t.ts = k.breakout_ts
            left join (select * from {_part("adx")} qualify row_number() over (partition by symbol order by ts desc) = 1) x on x.symbol = z.symbol))"""
)
ORACLES["page_texts"] = r"""select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text from pages"""


def bars_of(bucket: str, most: int) -> str:
    """The head of a query whose bars are the last of another length."""
    head = BARS.replace("date_trunc('hour', ts)", bucket).replace("from events group by 1, 2)", f"from events group by 1, 2 qualify row_number() over (partition by event_type order by {bucket} desc) <= {most})", 1)
    return f"with recursive {head}, {BLOCKS}"


_found = """, act as (select symbol, arg_min({direction: direction, low: zone_low, high: zone_high, age: last_i - created_i}, (last_i - created_i, -epoch_us(block_ts), direction)) as z from zn where not invalidated and last_i - created_i <= 20 group by 1), la as (select symbol, ts, close as price from r where rn = n)"""
_horizons = [("1h", 1, bars_of("date_trunc('hour', ts)", 24)), ("4h", 7, bars_of("time_bucket(interval 4 hours, ts)", 42))]
ORACLES["order_block_scan"] = "select symbol, timeframe, window_days, ts, round(price, 6) as price, zone_type, round(zone_high, 6) as zone_high, round(zone_low, 6) as zone_low, freshness, round(score, 6) as score from (" + " union all ".join(
    f"(select * from ({head}{_found} select symbol, '{t}' as timeframe, cast({d} as bigint) as window_days, ts, price, z.direction as zone_type, z.high as zone_high, z.low as zone_low, z.age as freshness, round(greatest(20 - z.age, 0) / 20.0::double, 6) as score from la join act using (symbol)))" for t, d, head in _horizons
) + ")"
ORACLES["order_block_scan_failures"] = " union all ".join(f"(select * from ({head}{_found} select symbol, '{t}' as timeframe, cast({d} as bigint) as window_days, 'no_active_order_blocks' as reason from la where symbol not in (select symbol from act)))" for t, d, head in _horizons)

# Strategies as recursions: position (1, -1, 0), stop and target.
_hit = "(case when s.side = 1 then x.low <= s.stop or x.open <= s.stop or x.high >= s.target when s.side = -1 then x.high >= s.stop or x.open >= s.stop or x.low <= s.target else false end)"
ORACLES["signals_vwap"] = sql(
    "select symbol, ts, act as signal from s join r using (symbol, rn)",
    NY + ", " + recurrence("", "close as y7, close as y25", ", ".join(ema_step("r.close", f"e.y{n}", n) for n in (7, 25))) + f""",
    x as (select r.*, vwap, y7, y25, n >= 25 as long_enough, case when r.rn >= 20 then avg(volume) over (partition by r.symbol order by r.ts rows between 19 preceding and current row) end as vm, abs(r.close - vwap) as gap from r join v using (symbol, ts, open, high, low, close, volume, rn, n) join e using (symbol, rn)),
    s as (select symbol, rn, 0 as side, cast(null as double) as stop, cast(null as double) as target, 'hold' as act from x where rn = 1
      union all select symbol, rn, case when ex then 0 when lo then 1 when sh then -1 else side end, case when lo then vwap - gap when sh then vwap + gap else stop end, case when lo then close + 4 * gap when sh then close - 4 * gap else target end,
        case when ex and side = 1 then 'long_exit' when ex then 'short_exit' when lo then 'long_entry' when sh then 'short_entry' else 'hold' end from (
          select *, side = 0 and ok and low <= vwap and vwap <= close and close > open and y7 > y25 and close > y7 and gap > 0 as lo, side = 0 and ok and high >= vwap and vwap >= close and close < open and y7 < y25 and close < y7 and gap > 0 as sh from (
            select x.*, s.side, s.stop, s.target, s.side <> 0 and ({_hit} or (s.side = 1 and x.close < vwap) or (s.side = -1 and x.close > vwap)) as ex, long_enough and vm is not null and volume >= 1.2 * vm as ok from s join x on x.symbol = s.symbol and x.rn = s.rn + 1)))""",
    True,
)
ORACLES["signals_ema_stack"] = sql(
    "select symbol, ts, act as signal from s join r using (symbol, rn)",
    STACK + f""", x as (select r.*, y7 > y25 and y25 > y50 and y50 > y200 as golden, y7 < y25 and y25 < y50 and y50 < y200 as death from r join e using (symbol, rn) where n >= 200),
    s as (select symbol, rn, 0 as side, cast(null as double) as stop, cast(null as double) as target, 'hold' as act from x where rn = 1
      union all select symbol, rn, case when ex then 0 when lo then 1 when sh then -1 else side end, case when lo then low when sh then high else stop end, case when lo then close + 2 * (close - low) when sh then close - 2 * (high - close) else target end,
        case when ex and side = 1 then 'long_exit' when ex then 'short_exit' when lo then 'long_entry' when sh then 'short_entry' else 'hold' end from (
          select *, side = 0 and golden and close > low as lo, side = 0 and death and high > close as sh from (
            select x.*, s.side, s.stop, s.target, s.side <> 0 and ({_hit} or (s.side = 1 and not golden) or (s.side = -1 and not death)) as ex from s join x on x.symbol = s.symbol and x.rn = s.rn + 1)))""",
    True,
)

ORACLES["signals_rsi"] = sql(
    "select symbol, ts, act as signal from s join r using (symbol, rn)",
    f"""q as (select * from {_part("rsi_smma")}), cr as (select symbol, ts, direction from {_part("rsi_cross")}), tw as (select * from {_part("atr")}),
    x as (select r.*, q.rsi, cr.direction as crossed, atr, last_value(case when is_low then r.close end ignore nulls) over k as lows, last_value(case when is_high then r.close end ignore nulls) over k as highs from (
        select *, close < lag(close) over w and close < lead(close) over w as is_low, close > lag(close) over w and close > lead(close) over w as is_high from r window w as (partition by symbol order by ts)) r
      left join q on q.symbol = r.symbol and q.ts = r.ts left join cr on cr.symbol = r.symbol and cr.ts = r.ts left join tw on tw.symbol = r.symbol and tw.ts = r.ts window k as (partition by r.symbol order by r.ts rows between 9 preceding and 2 preceding)),
    y as (select *, case when atr is null then close * 0.95 when lows is null then close - 1.5 * atr else lows - 1.5 * atr end as long_stop, case when atr is null then close * 1.05 when highs is null then close + 1.5 * atr else highs + 1.5 * atr end as short_stop from x),
    s as (select symbol, rn, 0 as side, cast(null as double) as stop, cast(null as double) as target, 'hold' as act from y where rn = 1
      union all select symbol, rn, case when ex then 0 when lo then 1 when sh then -1 else side end, case when lo then long_stop when sh then short_stop else stop end, case when lo then close + 2 * abs(close - long_stop) when sh then close - 2 * abs(close - short_stop) else target end,
        case when ex and side = 1 then 'long_exit' when ex then 'short_exit' when lo then 'long_entry' when sh then 'short_entry' else 'hold' end from (
          select y.*, s.side, s.stop, s.target, coalesce(case when s.side = 1 then y.low <= s.stop or y.high >= s.target or coalesce(crossed = 'bullish', false) when s.side = -1 then y.high >= s.stop or y.low <= s.target or coalesce(crossed = 'bearish', false) end, false) as ex,
            s.side = 0 and coalesce(rsi < 30, false) as lo, s.side = 0 and coalesce(rsi > 70, false) as sh from s join y on y.symbol = s.symbol and y.rn = s.rn + 1))""",
    True,
)
BY_RSI = f"select r.*, split_part(signal, '_', 1) = 'long' as long, case when signal like '%entry' then 'entry' when signal like '%exit' then 'exit' else 'hold' end as act, case when signal like 'long%' then 1 else -1 end as dir from r join {_part('signals_rsi')} using (symbol, ts)"
ORACLES["backtest_equity"], ORACLES["backtest_trades"], ORACLES["backtest_metrics"] = _engine_queries(engine(BY_RSI))
ORACLES["sentiment_dashboard"] = f"""with {SCORES}, one as (select count(*) filter (where doc_id % 2 = 0) as post_count, cast(round(cast(cast(cast(sum(cast(final as decimal(18, 4))) filter (where doc_id % 2 = 0) as double) / count(*) filter (where doc_id % 2 = 0) as varchar) as decimal(20, 12)), 4) as double) as post_avg, count(*) filter (where doc_id % 2 <> 0) as feed_count, cast(round(cast(cast(cast(sum(cast(final as decimal(18, 4))) filter (where doc_id % 2 <> 0) as double) / count(*) filter (where doc_id % 2 <> 0) as varchar) as decimal(20, 12)), 4) as double) as feed_avg from scored)
select *, round(post_avg * 0.4 + feed_avg * 0.6, 4) as sentiment_index, 'weighted' as mode, cast(null as varchar) as reason, case when round(post_avg * 0.4 + feed_avg * 0.6, 4) > 0.05 then 'bullish' when round(post_avg * 0.4 + feed_avg * 0.6, 4) < -0.05 then 'bearish' else 'neutral' end as polarity,
    case when round(post_avg * 0.4 + feed_avg * 0.6, 4) < -0.05 then 'sentiment_bearish_vs_price_bias_bullish' end as cross_signal from one"""

# Walk-forward: each split of each symbol is a symbol of its own; the engine sees the test rows only.
_bars = BARS[: BARS.index(", r as (")]
_rows = "b0" + _bars[len("bars") :] + ", b1 as (select *, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as m from b0), b2 as (select *, unnest(range(0, m - 149, 50)) as start from b1)"
_split = f"{_rows}, bars as (select symbol || '|' || cast(start / 50 as bigint) as symbol, ts, open, high, low, close, volume from b2 where i >= start and i < start + {{0}} and i >= start + {{1}})"
_signals = ORACLES["signals_rsi"].replace(_bars, _split.format(150, 0))
WINDOWS = _engine_queries(engine(f"select r.*, case when signal like '%entry' then 'entry' when signal like '%exit' then 'exit' else 'hold' end as act, case when signal like 'long%' then 1 else -1 end as dir from r join sg using (symbol, ts)"))[2]
WINDOWS = WINDOWS.replace(_bars, f"sg as ({_signals}), " + _split.format(150, 100), 1)
ORACLES["walk_forward"] = f"select * replace (split_part(symbol, '|', 1) as symbol), cast(split_part(symbol, '|', 2) as bigint) as split from ({WINDOWS})"
ORACLES["walk_forward_summary"] = f"select symbol, count(*) as window_count, round(avg(total_return), 6) as mean_return, round(avg(sharpe_ratio), 6) as mean_sharpe, round(max(total_return), 6) as best_return, round(min(total_return), 6) as worst_return from ({ORACLES['walk_forward']}) group by 1"


def _stepped(width: str, more: str = "", join: str = "") -> str:
    """The profile over steps of a width (an expression over `span`: a, z, close), in decimals, with the top as last edge."""
    exact = lambda x: f"cast(cast({x} as varchar) as decimal(28, 18))"
    edges = f"""{more}span as (select symbol, min(low) as a, max(high) as z, arg_max(close, ts) as close, max(close) - min(close) as closes from bars group by 1), steps as (select *, {exact('a')} as da, {exact(width)} as dw, cast(floor(cast({exact('z')} - {exact('a')} as double) / ({width})) as bigint) as k from span{join}),
    edges as (select symbol, j as bin, cast(da + dw * j as double) as x, case when j = k then z else cast(da + dw * (j + 1) as double) end as y from (select *, unnest(range(0, case when cast(da + dw * k as double) < z then k + 1 else k end)) as j from steps)),"""
    tail = PROFILE[PROFILE.index("touched as (select d.symbol") :]
    return sql(PROFILE_ROWS, edges + "\n    " + tail, True)


ORACLES["volume_profile_pct"] = _stepped("close * 0.05")
ORACLES["volume_profile_atr"] = _stepped("coalesce(width, closes)", f"tw as (select symbol, arg_max(atr, ts) as width from a where atr is not null group by 1), ", " left join tw using (symbol)").replace(", tw as (select symbol, arg_max", f", {ATR}, tw as (select symbol, arg_max", 1)
ORACLES["fib_confluence"] = sql(
    """select symbol, row_number() over (partition by symbol order by c) as cluster_id, round(avg(price), 6) as centre_price, round(min(price), 6) as min_price, round(max(price), 6) as max_price, count(*) as level_count, string_agg(set_id || ':' || kind || ':' || q, ',' order by k) as contributors from g group by symbol, c having count(*) >= 2""",
    f"""sa as (select symbol, max(high) as h, min(low) as x from bars group by 1), sb as (select symbol, max(high) as h, min(low) as x from r where rn > n - 48 group by 1),
    lv as (select symbol, x + (h - x) * cast(q as double) as price, 0 as set_id, 'retracement' as kind, cast(q as double) as q from sa, {RATIOS} union all select symbol, x + (h - x) * cast(q as double), 1, 'extension', cast(q as double) from sa, (values (1.272), (1.618), (2.0), (2.618)) as t(q)
      union all select symbol, x + (h - x) * cast(q as double), 2, 'retracement', cast(q as double) from sb, {RATIOS}),
    o as (select *, row_number() over (partition by symbol order by price, set_id, kind, q) as k from lv),
    g as (select symbol, k, price, set_id, kind, q, 1 as c, price as total, 1 as m from o where k = 1
      union all select o.symbol, o.k, o.price, o.set_id, o.kind, o.q, case when abs(o.price - g.total / g.m) <= abs(g.total / g.m) * 0.05 then g.c else g.c + 1 end, case when abs(o.price - g.total / g.m) <= abs(g.total / g.m) * 0.05 then g.total + o.price else o.price end,
        case when abs(o.price - g.total / g.m) <= abs(g.total / g.m) * 0.05 then g.m + 1 else 1 end from g join o on o.symbol = g.symbol and o.k = g.k + 1)""",
    True,
)

ORACLES["signals_pdh"] = sql(
    "select symbol, ts, act as signal from s join r using (symbol, rn)",
    f"""tw as (select * from {_part("atr")}), lo as (select *, cast({LOCAL} as date) as ny, cast(ts as date) as utc, quantile_cont(date_diff('second', before, ts), 0.5) over (partition by symbol order by ts rows between unbounded preceding and current row) as step,
      first_value(ts) over (partition by symbol order by ts) as start from (select *, lag(ts) over (partition by symbol order by ts) as before from r)),
    fi as (select symbol, utc, arg_min(ny, ts) as ny, arg_min(coalesce(step, 0), ts) as step, arg_min(start, ts) as start from lo group by 1, 2), dy as (select symbol, ny, max(high) as pdh, min(low) as pdl, max(ts) as final from lo group by 1, 2),
    pv as (select fi.symbol, utc, pdh, pdl from (select *, timezone('UTC', timezone('America/New_York', cast(ny as timestamp))) as day_end from fi) fi join dy on dy.symbol = fi.symbol and dy.ny = fi.ny - 1 where start <= day_end - interval 24 hours and (step <= 0 or date_diff('second', final, day_end) <= step)),
    x as (select r.*, pdh, pdl, lag(atr) over (partition by r.symbol order by r.ts) as width, hour(r.ts) between 8 and 16 or hour({LOCAL.replace("ts", "r.ts")}) * 60 + minute({LOCAL.replace("ts", "r.ts")}) between 570 and 959 as ins
      from r left join pv on pv.symbol = r.symbol and pv.utc = cast(r.ts as date) left join tw on tw.symbol = r.symbol and tw.ts = r.ts),
    s as (select symbol, rn, 0 as side, cast(null as double) as stop, cast(null as double) as target, 'hold' as act, false as was_up, false as was_down from x where rn = 1
      union all select symbol, rn, case when ex then 0 when lo then 1 when sh then -1 else side end, case when lo then close - 1.5 * width when sh then close + 1.5 * width else stop end, case when lo then close + 3 * width when sh then close - 3 * width else target end,
        case when ex and side = 1 then 'long_exit' when ex then 'short_exit' when lo then 'long_entry' when sh then 'short_entry' else 'hold' end, up, down from (
          select *, free and up and not was_up as lo, free and not (up and not was_up) and down and not was_down as sh from (
            select x.*, s.side, s.stop, s.target, s.was_up, s.was_down, s.side <> 0 and {_hit} as ex, coalesce(x.close > x.pdh, false) as up, coalesce(x.close < x.pdl, false) as down, s.side = 0 and x.pdh is not null and ins and width is not null as free from s join x on x.symbol = s.symbol and x.rn = s.rn + 1)))""",
    True,
)

# Mean-seeded indicators: running sums up to the seed, then the recurrence, all in one pass over the rows.
def _mean_seed(y: str, x: str, n: int, first: int = 1) -> str:
    """The mean of n values from row `first` on, then Wilder's step; before, the sum."""
    at = first + n - 1
    return f"case when rn < {first} then 0 when rn < {at} then {y} + {x} when rn = {at} then ({y} + {x}) / {n} else ({y} * {n - 1} + {x}) / {n} end"


def _mean_ema(y: str, x: str, n: int, first: int = 1) -> str:
    at = first + n - 1
    return f"case when rn < {first} then 0 when rn < {at} then {y} + {x} when rn = {at} then ({y} + {x}) / {n} else {y} + (2.0::double / {n + 1}) * ({x} - {y}) end"


_state = ("e7", "e25", "e50", "f12", "f26", "sig", "g", "l", "atr", "p", "m", "t", "dx", "adx", "oe")
_zero = ", ".join(f"cast({'close' if k in ('e7', 'e25', 'e50', 'f26') else 'obv' if k == 'oe' else '0'} as double) as {k}" for k in _state)
ORACLES["indicator_summaries"] = sql(
    """select symbol, round(rsi, 6) as rsi, round(macd, 6) as macd, round(sig, 6) as signal, round(macd - sig, 6) as histogram, round(k, 6) as stoch_k, round(d, 6) as stoch_d, round(adx, 6) as adx, round(pdi, 6) as plus_di, round(mdi, 6) as minus_di, round(atr, 6) as atr,
      round(mid + 2 * sd, 6) as bb_upper, round(mid, 6) as bb_middle, round(mid - 2 * sd, 6) as bb_lower, round(hv, 6) as hv, round(obv, 6) as obv, round(oe, 6) as obv_ema, round(mfi, 6) as mfi, round(e7, 6) as ema_7, round(e25, 6) as ema_25, round(e50, 6) as ema_50,
      rsi < 30 as oversold, rsi > 70 as overbought, macd > sig as macd_bullish, k > 80 as stoch_overbought, k < 20 as stoch_oversold, adx > 25 as strong_trend, pdi > mdi as trend_up, round(case when close > 0 then atr / close * 100 else 0 end, 6) as atr_percent, round(4 * sd, 6) as bb_width,
      round(case when mid > 0 then 4 * sd / mid * 100 else 0 end, 6) as bb_width_percent, round(hv * 100, 6) as hv_percent, 50.0::double as hv_percentile, obv > oe as obv_bullish, mfi > 80 as mfi_overbought, mfi < 20 as mfi_oversold from (
      select symbol, close, obv, case when n >= 15 then case when g + l = 0 then 0 else 100 * g / (g + l) end else 50 end as rsi, case when n >= 34 then f12 - f26 else 0 end as macd, case when n >= 34 then s.sig else 0 end as sig, case when n >= 18 then k else 50 end as k, case when n >= 18 then d else 50 end as d,
        case when n >= 28 then s.adx else 0 end as adx, case when n >= 15 and t <> 0 then 100 * p / t else 0 end as pdi, case when n >= 15 and t <> 0 then 100 * m / t else 0 end as mdi, case when n >= 15 then s.atr else 0 end as atr, case when n >= 20 then mid else 0 end as mid, case when n >= 20 then sd else 0 end as sd,
        case when n >= 21 then hv else 0 end as hv, case when n >= 20 then oe else 0 end as oe, case when n >= 15 then case when up + down >= 1 then 100 * up / (up + down) else 0 end else 50 end as mfi, case when n >= 7 then e7 else 0 end as e7, case when n >= 25 then e25 else 0 end as e25, case when n >= 50 then e50 else 0 end as e50
      from s join x using (symbol, rn) where rn = n)""",
    f"""c as (select *, (high + low + close) / 3 as tp, lag(close) {W}) as before, lag(high) {W}) as hb, lag(low) {W}) as lb, lag((high + low + close) / 3) {W}) as tb, max(high) {last(14)} as top, min(low) {last(14)} as bottom from r),
    c1 as (select *, case when top > bottom then 100 * (close - bottom) / (top - bottom) else 0 end as raw, case when rn = 1 then volume else sign(close - before) * volume end as ov, ln(close / before) as lr, greatest(high - low, abs(high - before), abs(low - before)) as tr,
      case when high - hb > lb - low and high > hb then high - hb else 0 end as dp, case when lb - low > high - hb and low < lb then lb - low else 0 end as dm, greatest(coalesce(close - before, 0), 0) as gain, greatest(coalesce(before - close, 0), 0) as loss from c),
    c2 as (select *, avg(raw) {last(3)} as k, sum(ov) {RUN} as obv, avg(close) {last(20)} as mid, stddev_pop(close) {last(20)} as sd, stddev_pop(lr) {last(20)} * sqrt(252) as hv, coalesce(sum(case when tp > tb then tp * volume end) {last(14)}, 0) as up, coalesce(sum(case when tp < tb then tp * volume end) {last(14)}, 0) as down from c1),
    x as (select *, avg(k) {last(3)} as d from c2),
    s as (select symbol, rn, {_zero} from x where rn = 1
      union all select symbol, rn, e7, e25, e50, f12, f26, {_mean_ema("sig", "(f12 - f26)", 9, 26)}, g, l, atr, p, m, t, dx, {_mean_seed("adx", "dx", 14, 15)}, oe from (
        select *, case when t <> 0 and p + m > 0 then 100 * abs(p - m) / (p + m) else old_dx end as dx from (
          select x.symbol, x.rn, {", ".join(f"{_mean_ema(f's.e{n}', 'x.close', n).replace('rn', 'x.rn')} as e{n}" for n in (7, 25, 50))}, {_mean_ema("s.f12", "x.close", 12, 15).replace("rn", "x.rn")} as f12, {_mean_ema("s.f26", "x.close", 26).replace("rn", "x.rn")} as f26, s.sig,
            {_mean_seed("s.g", "x.gain", 14, 2).replace("rn", "x.rn")} as g, {_mean_seed("s.l", "x.loss", 14, 2).replace("rn", "x.rn")} as l, {_mean_seed("s.atr", "x.tr", 14, 2).replace("rn", "x.rn")} as atr,
            {", ".join(f"case when x.rn <= 14 then s.{k} + x.{v} else s.{k} - s.{k} / 14 + x.{v} end as {k}" for k, v in (("p", "dp"), ("m", "dm"), ("t", "tr")))}, s.dx as old_dx, s.adx, {_mean_ema("s.oe", "x.obv", 20).replace("rn", "x.rn")} as oe from s join x on x.symbol = s.symbol and x.rn = s.rn + 1)))""",
    True,
)

# Order blocks: at each bar, the first zone that is whole, retested, of the right age and closed beyond; then the position.
ORACLES["signals_order_blocks"] = sql(
    "select symbol, ts, act as signal from s join r using (symbol, rn)",
    BLOCKS + f""", zb as (select zn.symbol, created_i, direction = 'bullish' as up, zone_low, zone_high, zn.atr, r.rn - 1 as i, close,
        bool_or(case when direction = 'bullish' then close < zone_low else close > zone_high end) over q as gone, bool_or(low <= zone_high + 0.5 * zn.atr and high >= zone_low - 0.5 * zn.atr) over q as tested
      from zn join r on r.symbol = zn.symbol and r.rn - 1 between created_i and created_i + 20 window q as (partition by zn.symbol, created_i order by r.rn rows between unbounded preceding and current row)),
    best as (select symbol, i, arg_min({{up: up, lo: zone_low, hi: zone_high, w: atr}}, created_i) as z from zb where not gone and tested and i >= created_i + 2 and case when up then close > zone_high else close < zone_low end group by 1, 2),
    x as (select r.*, z.up as up, z.lo as lo, z.hi as hi, z.w as w, case when z.up then z.lo - 1.5 * z.w else z.hi + 1.5 * z.w end as new_stop from r left join best on best.symbol = r.symbol and best.i = r.rn - 1),
    s as (select symbol, rn, case when up is null then 0 when up then 1 else -1 end as side, new_stop as stop, close + 2 * (close - new_stop) as target, lo, hi, case when up is null then 'hold' when up then 'long_entry' else 'short_entry' end as act from x where rn = 1
      union all select symbol, rn, case when enters then case when up then 1 else -1 end when ex then 0 else side end, case when enters then new_stop else stop end, case when enters then close + 2 * (close - new_stop) else target end, case when enters then lo else old_lo end, case when enters then hi else old_hi end,
        case when enters then case when up then 'long_entry' else 'short_entry' end when ex then case when side = 1 then 'long_exit' else 'short_exit' end else 'hold' end from (
          select *, up is not null and (side = 0 or ex) as enters from (
            select x.*, s.side, s.stop, s.target, s.lo as old_lo, s.hi as old_hi, case when s.side = 1 then x.low <= s.stop or x.high >= s.target or x.close < s.lo when s.side = -1 then x.high >= s.stop or x.low <= s.target or x.close > s.hi else false end as ex from s join x on x.symbol = s.symbol and x.rn = s.rn + 1)))""",
    True,
)

# Waves of three swings: at each bar, the last pattern of each side; it is entered at the next bar, if the stop allows.
_band = lambda lo, hi: f"(a <> b and ((b > a and d >= a) or (b < a and d <= a)) and abs(b - d) / abs(b - a) between {lo} and {hi})"
ORACLES["signals_elliott"] = sql(
    "select symbol, ts, act as signal from s join r using (symbol, rn)",
    f"""{CANDIDATES}, pt as (select symbol, i, case when is_high then 'high' else 'low' end as kind, case when is_high then high else low end as price from cand where is_high <> is_low),
    tri as (select symbol, i as i1, lead(i, 2) over q as i3, kind || lead(kind) over q || lead(kind, 2) over q as kinds, price as a, lead(price) over q as b, lead(price, 2) over q as d from pt window q as (partition by symbol order by i)),
    hit as (select tri.symbol, r.rn - 1 as i, i1, case when kinds = 'highlowhigh' and {_band(0.382, 0.886)} and close > a * 1.0005 then b end as long_origin,
        case when kinds = 'highlowhigh' and {_band(0.382, 0.786)} and close < b * 0.9995 then a when kinds = 'lowhighlow' and {_band(0.382, 0.886)} and close < a * 0.9995 then b end as short_origin
      from tri join r on r.symbol = tri.symbol and r.rn - 1 between i3 and i1 + 8 where (kinds = 'highlowhigh' and d < a and b < a) or (kinds = 'lowhighlow' and d > a and b > a)),
    seen as (select symbol, i, arg_max(long_origin, i1) filter (where long_origin is not null) as lo, arg_max(short_origin, i1) filter (where short_origin is not null) as so from hit group by 1, 2),
    tw as (select * from {_part("atr")}),
    x as (select r.*, r.rn - 1 >= 2 and r.rn < r.n as inner_bar, coalesce(tw.atr, 0) as w, seen.lo, seen.so from r left join seen on seen.symbol = r.symbol and seen.i = r.rn - 1 left join tw on tw.symbol = r.symbol and tw.ts = r.ts),
    s as (select symbol, rn, 0 as side, cast(null as double) as stop, cast(null as double) as target, cast(null as double) as pl, cast(null as double) as ps, 'hold' as act from x where rn = 1
      union all select symbol, rn, case when not inner_bar then side when ex then 0 when lin then 1 when sin then -1 else side end, case when not inner_bar then stop when lin then lstop when sin then sstop else stop end,
        case when not inner_bar then target when lin then close + 2 * (close - lstop) when sin then close - 2 * (sstop - close) else target end,
        case when not inner_bar then pl when ex then null when searches then lo end, case when not inner_bar then ps when ex then null when searches then so when side <> 0 or lin then ps end,
        case when not inner_bar then 'hold' when ex and side = 1 then 'long_exit' when ex then 'short_exit' when lin then 'long_entry' when sin then 'short_entry' else 'hold' end from (
          select *, side = 0 and not lin and not sin as searches from (
            select *, not lin and side = 0 and coalesce(sstop > close, false) as sin from (
              select *, side = 0 and coalesce(close > lstop, false) as lin from (
                select x.*, s.side, s.stop, s.target, s.pl, s.ps, greatest(s.pl * 0.9995, x.close - x.w) + case when s.pl is null then null else 0 end as lstop, least(s.ps * 1.0005, x.close + x.w) + case when s.ps is null then null else 0 end as sstop,
                  case when s.side = 1 then x.low <= s.stop or x.high >= s.target when s.side = -1 then x.high >= s.stop or x.low <= s.target else false end as ex from s join x on x.symbol = s.symbol and x.rn = s.rn + 1)))))""",
    True,
)

# All strategies through the engine: each strategy of each symbol is a symbol of its own.
_ids = {"pdh_session": "signals_pdh", "rsi": "signals_rsi", "vwap": "signals_vwap", "ema_stack": "signals_ema_stack", "order_blocks": "signals_order_blocks", "elliot_wave": "signals_elliott"}
_all = " union all ".join(f"select symbol || '|{k}' as symbol, ts, signal from {_part(v)}" for k, v in _ids.items())
_each = f"b0{_bars[len('bars'):]}, bars as (select symbol || '|' || id as symbol, ts, open, high, low, close, volume from b0, (values {', '.join(f'({k!r})' for k in _ids)}) as t(id))"
_compared = _engine_queries(engine("select r.*, case when signal like '%entry' then 'entry' when signal like '%exit' then 'exit' else 'hold' end as act, case when signal like 'long%' then 1 else -1 end as dir from r left join sg using (symbol, ts)"))[2].replace(_bars, f"sg as ({_all}), " + _each, 1)
# an order against the open position is an error: the strategy keeps its row, without figures, and comes last
_compared = _compared.replace(", 6) as expectancy from (", ", 6) as expectancy, open_position, error, final as whole, case when s > 0 then m / s else 0 end as steady from (", 1).replace("where rn > 1) group by 1)\n", """where rn > 1) group by 1)
      join (select symbol, arg_max(side <> 0, rn) as open_position from curve group by 1) using (symbol) left join (select g.symbol, arg_min(case when dir = 1 then 'long_' else 'short_' end || act || ' while ' || case when side = 1 then 'long' else 'short' end || ' at row ' || (g.rn - 1), g.rn) as error
        from g join e on e.symbol = g.symbol and e.rn = g.rn - 1 where act <> 'hold' and side <> 0 and side <> dir group by 1) using (symbol)\n""", 1)
_figures = ("final_equity", "total_return", "max_drawdown", "sharpe_ratio", "total_trades", "win_rate", "wins", "losses", "avg_win", "avg_loss", "profit_factor", "expectancy", "open_position")
ORACLES["compare_strategies"] = f"""select * exclude (whole, steady), row_number() over (partition by symbol order by case when error is null then whole end desc nulls last, case when error is null then steady end desc nulls last, strategy) as rank from (
    select whole, steady, split_part(symbol, '|', 1) as symbol, split_part(symbol, '|', 2) as strategy, error, {", ".join(f"case when error is null then {c} end as {c}" for c in _figures)} from ({_compared}))"""

_shown = "case when {0} is null then 'N/A' else printf('%.2f', {0}) || '{1}' end"
ORACLES["comparison_lines"] = f"""select symbol, rank, '#' || rank || ' ' || strategy as title, 'Return: ' || {_shown.format("total_return", "%")} || ' | Sharpe: ' || {_shown.format("sharpe_ratio", "")} || ' | Trades: ' || coalesce(total_trades::varchar, 'N/A') || ' | Open: ' || coalesce(open_position::varchar, 'N/A') as line,
    'Showing top 4 of 6 strategies' as footer from {_part("compare_strategies")} where rank <= 4"""
ORACLES["sma"] = sql(f"select symbol, ts, round(case when rn >= 20 then avg(close) {last(20)} end, 6) as sma from r")
ORACLES["price_ranges_default"] = ORACLES["price_ranges"].replace("<= 2.0", "<= 0.03")
# a small negative number rounds to negative zero here, and to zero in Spark
_CALM = "from (select event_id, ts, event_type, 100 + value / 100 as value from events) group by 1, 2"
for _name in ("session_scan_failures", "order_block_scan", "backtest_trades", "rsi_extremes"):
    ORACLES[f"{_name}_by_user"] = ORACLES[_name].replace("event_type as symbol", "cast(user_id as varchar) as symbol")
# with gaps between bars it matters that a scan sees the last 48 alone
ORACLES["session_scan_failures_by_user"] = ORACLES["session_scan_failures_by_user"].replace("as b from bars)", "as b from r)").replace(
    "r as (select *, row_number() over w as rn, count(*) over (partition by symbol) as n from bars window", "tail as (select * from bars qualify row_number() over (partition by symbol order by ts desc) <= 48), r as (select *, row_number() over w as rn, count(*) over (partition by symbol) as n from tail window"
)
ORACLES["price_ranges_calm"] = ORACLES["price_ranges_default"].replace("from events group by 1, 2", _CALM)
ORACLES["range_breakouts_calm"] = ORACLES["range_breakouts"].replace("<= 2.0", "<= 0.03").replace("from events group by 1, 2", _CALM)
for _name, _same in (("ema", "ema"), ("ema_stack", "ema_stack"), ("smma", "smma"), ("rsi", "rsi_smma"), ("rsi_ema", "rsi_ema"), ("macd", "macd"), ("atr", "atr"), ("adx", "adx")):
    ORACLES[f"{_name}_scan"] = ORACLES[_same]
ORACLES["bars_merged"] = ORACLES["provider_bars"] = ORACLES["bars_1h"]
_ENDS = "e as (select symbol, count(*) as bars, arg_min(close, ts) as a, arg_max(close, ts) as b, max(rise) as rise from (select *, close - lag(close) over (partition by symbol order by ts) as rise from bars) group by 1)"
ORACLES["symbol_jobs"] = sql("select symbol, bars, round(rise, 6) as largest_rise from e where b >= a", _ENDS)
ORACLES["symbol_job_failures"] = sql("select symbol, 'ValueError: the last close is below the first' as reason from e where b < a", _ENDS)
ORACLES["asof_quotes"] = """select t.event_id, t.user_id, t.ts, round(t.value, 6) as price, round(q.value, 6) as quote, q.ts as ts_right
    from (select * from events where event_type = 'purchase') t asof left join (select * from events where event_type = 'view') q on t.user_id = q.user_id and t.ts >= q.ts"""
ORACLES["interval_clicks"] = """select c.event_id, c.user_id, c.ts, s.event_id as signup_id from events c join events s on c.event_type = 'click' and s.event_type = 'signup' and c.user_id = s.user_id
    and c.ts >= s.ts and c.ts <= s.ts + to_hours(cast(s.user_id % 24 + 1 as integer))"""
for _q in ("0.0", "0.05", "0.5", "0.95", "1.0"):
    _one = f"select event_type, {_q}::double as share, round(quantile_cont(value, {_q}), 6) as quantile from events group by 1"
    ORACLES["price_quantiles"] = _one if _q == "0.0" else ORACLES["price_quantiles"] + " union all " + _one

ORACLES = {k: v.replace(", 6) as ", ", 6) + 0.0 as ") for k, v in ORACLES.items()}
