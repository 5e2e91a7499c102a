"""Rule-based strategies: signals by bar. Indicators come from their own operators; the state of a position is a machine.

A machine is a generator over rows in order of time. It yields one action a row, so it can be tested without Spark; in
Spark each symbol is one group of one Arrow group-map. Actions: long_entry, long_exit, short_entry, short_exit, hold.
"""

from __future__ import annotations

import bisect
import heapq
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrence as rec
from . import windows as win
from .groups import map_groups
from .levels import in_session

HOLD = "hold"


def _run(rows: DataFrame, machine: Callable[[pd.DataFrame], Iterable[str]]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "signal": list(machine(pdf))})

    return rows.groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, signal string")


class Position:
    """An open position with a stop and a target, judged on later bars."""

    def __init__(self, side: str, stop: float, target: float):
        self.side, self.stop, self.target = side, stop, target

    def hit(self, row, gap: bool = False) -> bool:
        """The stop first (with gap, also at the open), then the target."""
        if self.side == "long":
            return row.low <= self.stop or (gap and row.open <= self.stop) or row.high >= self.target
        return row.high >= self.stop or (gap and row.open >= self.stop) or row.low <= self.target

    def exit(self) -> str:
        return f"{self.side}_exit"


def vwap_machine(pdf: pd.DataFrame, reward: float = 2.0, surge: float = 1.2) -> Iterator[str]:
    held: Position | None = None
    for i, r in enumerate(pdf.itertuples()):
        action = HOLD
        if i and held is not None:
            back = (r.close < r.vwap if held.side == "long" else r.close > r.vwap) if r.vwap == r.vwap else False
            if held.hit(r, gap=True) or back:
                action, held = held.exit(), None
        elif i and all(x == x for x in (r.vwap, r.ema7, r.ema25, r.volume_mean)) and r.volume >= surge * r.volume_mean:
            gap = abs(r.close - r.vwap)
            if r.low <= r.vwap <= r.close and r.close > r.open and r.ema7 > r.ema25 and r.close > r.ema7 and gap > 0:
                action, held = "long_entry", Position("long", r.vwap - gap, r.close + reward * 2 * gap)
            elif r.high >= r.vwap >= r.close and r.close < r.open and r.ema7 < r.ema25 and r.close < r.ema7 and gap > 0:
                action, held = "short_entry", Position("short", r.vwap + gap, r.close - reward * 2 * gap)
        yield action


def vwap_anchored(bars: DataFrame, anchor: str = "ny", reward: float = 2.0, surge: float = 1.2) -> DataFrame:
    """Entries at a bar that touches vwap and closes beyond it with the trend and with volume."""
    rows = bars.join(win.vwap(bars, anchor).select("symbol", "ts", "vwap"), ["symbol", "ts"]).join(rec.ema_stack_frame(bars, (7, 25)), ["symbol", "ts"], "left")
    rows = rows.withColumn("volume_mean", win.full(20, F.avg("volume").over(win.frame(-19))))
    return _run(rows, lambda pdf: vwap_machine(pdf, reward, surge))


class StackMachine:
    """Entries after so many bars with the averages in order, one row after the other; what it holds is all its state."""

    def __init__(self, bars_needed: int = 1, buffer_pct: float = 0.0, reward: float = 2.0):
        self.bars_needed, self.buffer_pct, self.reward = bars_needed, buffer_pct, reward
        self.held: Position | None = None
        self.up = self.down = 0
        self.begun = False

    def step(self, r) -> str:
        golden, death = r.ema7 > r.ema25 > r.ema50 > r.ema200, r.ema7 < r.ema25 < r.ema50 < r.ema200
        if not self.begun:
            self.begun = True
            return HOLD
        if self.held is not None:
            action = HOLD
            if self.held.hit(r, gap=True) or not (golden if self.held.side == "long" else death):
                action, self.held, self.up, self.down = self.held.exit(), None, 0, 0
            return action
        self.up, self.down = (self.up + 1 if golden else 0), (self.down + 1 if death else 0)
        action = HOLD
        for count, side, stop in ((self.up, "long", r.low * (1 - self.buffer_pct)), (self.down, "short", r.high * (1 + self.buffer_pct))):
            if action == HOLD and count >= self.bars_needed:
                risk = r.close - stop if side == "long" else stop - r.close
                self.up = self.down = 0
                if risk > 0:
                    sign = 1 if side == "long" else -1
                    action, self.held = f"{side}_entry", Position(side, stop, r.close + sign * self.reward * risk)
        return action


def stack_machine(pdf: pd.DataFrame, bars_needed: int = 1, buffer_pct: float = 0.0, reward: float = 2.0) -> Iterator[str]:
    machine = StackMachine(bars_needed, buffer_pct, reward)
    return (machine.step(r) for r in pdf.itertuples())


def ema_stack(bars: DataFrame, bars_needed: int = 1, buffer_pct: float = 0.0, reward: float = 2.0) -> DataFrame:
    """Entries after so many bars with the averages in order."""
    rows = bars.join(rec.ema_stack_frame(bars, (7, 25, 50, 200)), ["symbol", "ts"])
    return _run(rows, lambda pdf: stack_machine(pdf, bars_needed, buffer_pct, reward))


def last_extremes(close: np.ndarray, look: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """For each row the last strict local low and high of close wholly within the `look` rows before it."""
    n = len(close)
    low, high = np.full(n, np.nan), np.full(n, np.nan)
    inner = np.arange(1, n - 1)
    is_low = inner[(close[1:-1] < close[:-2]) & (close[1:-1] < close[2:])] if n > 2 else np.array([], int)
    is_high = inner[(close[1:-1] > close[:-2]) & (close[1:-1] > close[2:])] if n > 2 else np.array([], int)
    rows = np.arange(n)
    for out, at in ((low, is_low), (high, is_high)):
        k = np.searchsorted(at, rows - 2, side="right") - 1
        place = at[np.maximum(k, 0)] if len(at) else rows
        ok = (k >= 0) & (place - 1 >= np.maximum(0, rows - look)) if len(at) else np.zeros(n, dtype=bool)
        out[ok] = close[place[ok]]
    return low, high


_RsiRow = namedtuple("_RsiRow", ("open", "high", "low", "close", "rsi", "atr", "cross", "divergence"))


def rsi_actions(given: dict[str, np.ndarray], oversold: float = 30.0, overbought: float = 70.0, confirm: bool = False, atr_mult: float = 1.5, reward: float = 2.0, look: int = 10) -> Iterator[str]:
    held: Position | None = None
    lows, highs = last_extremes(given["close"], look)
    for i, r in enumerate(map(_RsiRow._make, zip(*(given[c].tolist() for c in _RsiRow._fields), strict=True))):
        action = HOLD
        if held is not None:
            if held.hit(r) or r.cross == ("bullish" if held.side == "long" else "bearish"):
                action, held = held.exit(), None
        elif r.rsi == r.rsi:
            side = "long" if r.rsi < oversold else "short" if r.rsi > overbought else None
            if side and confirm and r.divergence != ("bullish" if side == "long" else "bearish"):
                side = None
            if side:
                sign = 1 if side == "long" else -1
                swing, width = float((lows if sign > 0 else highs)[i]), atr_mult * r.atr
                stop = swing - sign * width if swing == swing and width == width else r.close - sign * width if width == width else r.close * (1 - sign * 0.05)
                action, held = f"{side}_entry", Position(side, stop, r.close + sign * reward * abs(r.close - stop))
        yield action


def rsi_machine(pdf: pd.DataFrame, oversold: float = 30.0, overbought: float = 70.0, confirm: bool = False, atr_mult: float = 1.5, reward: float = 2.0, look: int = 10) -> Iterator[str]:
    words = ("cross", "divergence")
    given = {c: pdf[c].to_numpy(dtype=object if c in words else float) if c in pdf else np.full(len(pdf), None if c in words else np.nan, dtype=object if c in words else float) for c in _RsiRow._fields}
    return rsi_actions(given, oversold, overbought, confirm, atr_mult, reward, look)


def _where(good: np.ndarray, least: int, kernel: Callable[..., np.ndarray], *columns: np.ndarray) -> np.ndarray:
    """What the kernel makes of the good rows, in their places; nan elsewhere and where they are too few."""
    out = np.full(len(good), np.nan)
    if np.count_nonzero(good) >= least:
        out[good] = kernel(*(c[good] for c in columns))
    return out


def crosses(rsi: np.ndarray, threshold: float = 50.0) -> np.ndarray:
    """bullish or bearish where rsi passes the threshold, as `windows.rsi_cross` gives it; None elsewhere."""
    out, at = np.full(len(rsi), None, dtype=object), np.flatnonzero(~np.isnan(rsi))
    above = rsi[at] >= threshold
    turned = np.flatnonzero(above[1:] != above[:-1]) + 1
    out[at[turned]] = np.where(above[turned], "bullish", "bearish")
    return out


def rsi_reversion(bars: DataFrame, period: int = 14, oversold: float = 30.0, overbought: float = 70.0, confirm: bool = False, atr_mult: float = 1.5, reward: float = 2.0) -> DataFrame:
    """Entries at extremes of rsi, with `confirm` only together with a divergence.

    Strength, range and crosses are made where the machine runs, so bars are dealt once and joined with nothing; only divergences are.
    """
    rows = bars.withColumn("divergence", F.lit(None).cast("string"))
    if confirm:
        rows = bars.join(win.rsi_divergence(rec.rsi_frame(bars, period)).select("symbol", "ts", "divergence"), ["symbol", "ts"], "left")

    def run(ts, open, high, low, close, divergence):  # noqa: A002
        known = ~np.isnan(close)
        rsi = _where(known, period + 1, lambda c: rec.rsi(c, period), close)
        atr = _where(known & ~np.isnan(high) & ~np.isnan(low), 14, rec.atr, high, low, close)
        given = {"open": open, "high": high, "low": low, "close": close, "rsi": rsi, "atr": atr, "cross": crosses(rsi), "divergence": divergence}
        return {"ts": ts, "signal": list(rsi_actions(given, oversold, overbought, confirm, atr_mult, reward))}

    rows = rows.select("symbol", "ts", *[F.col(c).cast("double") for c in ("open", "high", "low", "close")], "divergence")
    return map_groups(rows, ("symbol",), "ts", run, "ts timestamp_ntz, signal string")


def breakout_machine(pdf: pd.DataFrame, atr_mult: float = 1.5, reward: float = 2.0) -> Iterator[str]:
    held: Position | None = None
    was_up = was_down = False
    before = float("nan")
    for i, r in enumerate(pdf.itertuples()):
        action, exited = HOLD, False
        if i and held is not None and held.hit(r, gap=True):
            action, held, exited = held.exit(), None, True
        if i:
            if r.pdh != r.pdh:
                was_up = was_down = False
            else:
                up, down = r.close > r.pdh, r.close < r.pdl
                if held is None and not exited and r.in_session and before == before:
                    width = atr_mult * before
                    if up and not was_up:
                        action, held = "long_entry", Position("long", r.close - width, r.close + reward * width)
                    elif down and not was_down:
                        action, held = "short_entry", Position("short", r.close + width, r.close - reward * width)
                was_up, was_down = up, down
        before = r.atr
        yield action


def running_median(x: np.ndarray) -> np.ndarray:
    """The median of the values up to each place, by two heaps."""
    low: list[float] = []  # the lesser half, negated
    high: list[float] = []
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        heapq.heappush(high, -heapq.heappushpop(low, -v))
        if len(high) > len(low):
            heapq.heappush(low, -heapq.heappop(high))
        out[i] = -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2
    return out


def previous_levels_by_day(bars: DataFrame) -> DataFrame:
    """pdh and pdl of each bar as known at the first bar of its UTC day: those of the New York day before that bar's.

    Days are summed up by New York day, and then joined on the day; null where that day is not whole. Needs no bar
    after the first of the UTC day.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    seconds = bars.withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    kernel = lambda t: {"interval": np.concatenate([[0.0], running_median(np.diff(t))])[: len(t)], "start": np.full(len(t), t[0])}
    gaps = rec.by_symbol(seconds, ("t",), kernel, "interval double, start double").withColumn("start", F.timestamp_seconds("start").cast("timestamp_ntz"))
    rows = bars.select("symbol", "ts", "high", "low", F.to_date(local).alias("ny_day"), F.to_date("ts").alias("utc_day")).join(gaps, ["symbol", "ts"])
    firsts = rows.groupBy("symbol", "utc_day").agg(F.min_by(F.struct("ny_day", "interval", "start"), "ts").alias("f"), F.min("ts").alias("first_ts")).select("symbol", "utc_day", "f.*", "first_ts")
    days = rows.groupBy("symbol", F.col("ny_day").alias("before")).agg(F.max("high").alias("pdh"), F.min("low").alias("pdl"), F.max("ts").alias("day_last"))
    joined = firsts.withColumn("before", F.date_sub("ny_day", 1)).join(days, ["symbol", "before"], "left")
    end = F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.col("ny_day").cast("timestamp_ntz"))
    lacking = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(F.col("day_last").cast("timestamp"))
    whole = (F.col("start") <= end - F.expr("interval 24 hours")) & ((F.col("interval") <= 0) | (lacking <= F.col("interval")))
    return joined.select("symbol", "utc_day", F.when(whole, F.col("pdh")).alias("pdh"), F.when(whole, F.col("pdl")).alias("pdl"))


def pdh_session(bars: DataFrame, sessions: tuple[str, ...] = ("london", "ny"), atr_period: int = 14, atr_mult: float = 1.5, reward: float = 2.0) -> DataFrame:
    """Entries at a new close beyond the previous day's range within a session."""
    inside = F.lit(False)
    for s in sessions:
        inside = inside | in_session(F.col("ts"), s)
    rows = bars.withColumns({"in_session": inside, "utc_day": F.to_date("ts")}).join(previous_levels_by_day(bars), ["symbol", "utc_day"], "left").drop("utc_day")
    rows = rows.join(rec.atr_frame(bars, atr_period), ["symbol", "ts"], "left")
    return _run(rows, lambda pdf: breakout_machine(pdf, atr_mult, reward))


def block_machine(pdf: pd.DataFrame, impulse: float = 1.0, min_age: int = 2, max_age: int = 20, tolerance: float = 0.5, stop_mult: float = 1.5, reward: float = 2.0, break_mult: float = 1.0, confirm: bool = True) -> Iterator[str]:
    """Zones are made as their displacement bar passes; each keeps whether it was retested and whether it still holds."""
    o, h, x, c = (pdf[k].to_numpy(dtype=float) for k in ("open", "high", "low", "close"))
    width = np.nan_to_num(pdf["atr"].to_numpy(dtype=float), nan=0.0)
    zones: list[dict] = []
    held: tuple[Position, dict] | None = None
    n, rows = len(c), list(pdf.itertuples())
    for i in range(n):
        # a zone that is broken or too old is never entered again
        zones = [z for z in zones if z["ok"] and i - z["at"] <= max_age]
        if 2 <= i < n - 1 and abs(c[i] - o[i]) >= impulse * width[i]:
            if c[i] > o[i] and c[i - 1] < o[i - 1] and c[i] > h[i - 1]:
                zones.append({"side": "long", "low": x[i - 1], "high": o[i - 1], "atr": width[i], "at": i, "ok": True, "tested": False})
            elif c[i] < o[i] and c[i - 1] > o[i - 1] and c[i] < x[i - 1]:
                zones.append({"side": "short", "low": o[i - 1], "high": h[i - 1], "atr": width[i], "at": i, "ok": True, "tested": False})
        for z in zones:
            if (c[i] < z["low"]) if z["side"] == "long" else (c[i] > z["high"]):
                z["ok"] = False
            z["tested"] |= bool(x[i] <= z["high"] + tolerance * z["atr"] and h[i] >= z["low"] - tolerance * z["atr"])
        action = HOLD
        if held is not None:
            position, z = held
            edge = break_mult * z["atr"]
            gone = (c[i] < z["low"] or c[i] < z["low"] - edge) if position.side == "long" else (c[i] > z["high"] or c[i] > z["high"] + edge)
            if position.hit(rows[i]) or gone:
                action, held = position.exit(), None
        if held is None:
            for z in zones:
                if z["ok"] and z["tested"] and min_age <= i - z["at"] <= max_age and (not confirm or ((c[i] > z["high"]) if z["side"] == "long" else (c[i] < z["low"]))):
                    stop = z["low"] - stop_mult * z["atr"] if z["side"] == "long" else z["high"] + stop_mult * z["atr"]
                    held = (Position(z["side"], stop, c[i] + reward * (c[i] - stop)), z)
                    action = f"{z['side']}_entry"
                    break
        yield action


def order_blocks(bars: DataFrame, atr_period: int = 14, **options: float) -> DataFrame:
    """Entries at closes beyond a retested zone; an entry on the bar of an exit takes the exit's place."""
    rows = bars.join(rec.atr_frame(bars, atr_period), ["symbol", "ts"], "left")
    return _run(rows, lambda pdf: block_machine(pdf, **options))


def wave_machine(pdf: pd.DataFrame, w: int = 2, wave3: tuple[float, float] = (0.382, 0.786), wave_c: tuple[float, float] = (0.382, 0.886), confirm: int = 1, breakout_bps: float = 5.0, invalid_bps: float = 5.0, atr_mult: float = 1.0, reward: float = 2.0, strict: bool = False) -> Iterator[str]:
    """Patterns of three swings and a close beyond a level; entry after some bars. With strict, swings need w bars after."""
    h, x, c = (pdf[k].to_numpy(dtype=float) for k in ("high", "low", "close"))
    width = np.nan_to_num(pdf["atr"].to_numpy(dtype=float), nan=0.0)
    n, points, rows = len(c), [], list(pdf.itertuples())
    for i in range(w, n - w):
        hs, xs = h[i - w : i + w + 1], x[i - w : i + w + 1]
        top, bottom = h[i] == hs.max() and h[i] > hs.min(), x[i] == xs.min() and x[i] < xs.max()
        if top != bottom:
            points.append((i, "high" if top else "low", h[i] if top else x[i]))

    def band(a, b, d, lo, hi):
        return a != b and ((b > a and d >= a) or (b < a and d <= a)) and lo <= abs(b - d) / abs(b - a) <= hi

    def level(price, sign):
        return price * (1 + sign * breakout_bps / 1e4)

    held: Position | None = None
    pending: dict[str, tuple[int, float, float]] = {}  # by side: bar of the breakout, origin, level

    def enter(side, i, origin):
        sign = 1 if side == "long" else -1
        stop = origin * (1 - sign * invalid_bps / 1e4)
        if atr_mult > 0:
            tight = c[i] - sign * atr_mult * width[i]
            stop = max(stop, tight) if sign > 0 else min(stop, tight)
        risk = sign * (c[i] - stop)
        return Position(side, stop, c[i] + sign * reward * risk) if risk > 0 else None

    for i in range(n):
        action = HOLD
        if w <= i < n - 1:
            if held is not None and held.hit(rows[i]):
                yield held.exit()
                held = None
                pending.clear()
                continue
            for side in ("long", "short"):
                if side in pending and (side == "long" or held is None):
                    at, origin, edge = pending[side]
                    if i - at >= confirm:
                        del pending[side]
                        if (new := enter(side, i, origin)) is not None:
                            held, action = new, f"{side}_entry"
                    elif (x[i] <= edge) if side == "long" else (h[i] >= edge):
                        del pending[side]
            if held is None and not pending:
                near = points[bisect.bisect_left(points, (i - 4 * w,)) : bisect.bisect_left(points, ((i - w if strict else i) + 1,))]
                for (_, ka, a), (_, kb, b), (_, kc, d) in zip(near, near[1:], near[2:], strict=False):
                    if (ka, kb, kc) == ("high", "low", "high") and d < a and b < a:
                        options = []
                        if band(a, b, d, *wave3) and c[i] < level(b, -1):
                            options.append(("short", a, level(b, -1)))
                        if band(a, b, d, *wave_c) and c[i] > level(a, 1):
                            options.append(("long", b, level(a, 1)))
                    elif (ka, kb, kc) == ("low", "high", "low") and d > a and b > a and band(a, b, d, *wave_c) and c[i] < level(a, -1):
                        options = [("short", b, level(a, -1))]
                    else:
                        options = []
                    for side, origin, edge in options:
                        if confirm:
                            pending[side] = (i, origin, edge)
                        elif (new := enter(side, i, origin)) is not None:
                            held, action = new, f"{side}_entry"
        yield action


def elliott_simplified(bars: DataFrame, atr_period: int = 14, **options) -> DataFrame:
    rows = bars.join(rec.atr_frame(bars, atr_period), ["symbol", "ts"], "left")
    return _run(rows, lambda pdf: wave_machine(pdf, **options))


# The ids of the strategies, each bars -> signals.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "pdh_session": pdh_session,
    "rsi": rsi_reversion,
    "vwap": vwap_anchored,
    "ema_stack": ema_stack,
    "order_blocks": order_blocks,
    "elliot_wave": elliott_simplified,
}
