"""Indicators in which each row follows from the one before: one exchange on the symbol, linear in its rows.

The kernels take and give arrays, so they can be tested and used apart from Spark. Two families of seeds live side by
side: those of the plain recurrences, and those seeded by a simple mean (names ending in `_sma_seed`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import map_groups


def by_symbol(bars: DataFrame, columns: tuple[str, ...], kernel: Callable[..., dict[str, np.ndarray]], out: str, least: int = 1) -> DataFrame:
    """symbol, ts and what the kernel makes of the columns' arrays in order of ts; no rows for shorter symbols."""
    names = [p.split()[0] for p in out.split(",")]

    def run(ts: np.ndarray, **given: np.ndarray) -> dict[str, np.ndarray]:
        if len(ts) < least:
            return dict.fromkeys(("ts", *names), ts[:0])
        return {"ts": ts, **kernel(*(given[c] for c in columns))}

    given = bars.dropna(subset=list(columns)).select("symbol", "ts", *[F.col(c).cast("double") for c in columns])
    result = map_groups(given, ("symbol",), "ts", run, "ts timestamp_ntz, " + out)
    return result.select("symbol", "ts", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """y0 = x0, y = y + alpha (x - y)."""
    out, y = np.empty(len(x)), None
    for i, v in enumerate(x.tolist()):
        y = v if y is None else (1 - alpha) * y + alpha * v
        out[i] = y
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return ewm(x, 2 / (n + 1))


def wilder(x: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Mean of x[skip : skip + n] at row skip + n - 1, then (y (n - 1) + x) / n; nan before."""
    out = np.full(len(x), np.nan)
    if len(x) < skip + n:
        return out
    y = float(np.mean(x[skip : skip + n]))
    out[skip + n - 1] = y
    for i, v in enumerate(x[skip + n :].tolist(), skip + n):
        y = (y * (n - 1) + v) / n
        out[i] = y
    return out


def smma(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the first n at row n - 1, then y (1 - 1/n) + x/n; a missing x repeats y."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    y = float(np.mean(x[:n]))
    out[n - 1] = y
    for i, v in enumerate(x[n:].tolist(), n):
        if v == v:
            y = y * (1 - 1 / n) + v / n
        out[i] = y
    return out


def rsi(close: np.ndarray, n: int = 14, method: str = "smma") -> np.ndarray:
    """The first change is taken as 0 and is part of the seed; 50 where nothing moved, 100 where nothing fell."""
    change = np.diff(close, prepend=close[:1])
    gain, loss = np.maximum(change, 0), np.maximum(-change, 0)
    up, down = (smma(gain, n), smma(loss, n)) if method == "smma" else (ema(gain, n), ema(loss, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100 - 100 / (1 + up / down)
    value = np.where(down == 0, np.where(up == 0, 50.0, 100.0), value)
    return np.where(np.isnan(up), np.nan, np.clip(value, 0, 100))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    return wilder(true_range(high, low, close), n)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    up, down = np.diff(high, prepend=high[:1]), -np.diff(low, prepend=low[:1])
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    tr, p, m = (ewm(x, 1 / n) for x in (true_range(high, low, close), plus, minus))
    with np.errstate(divide="ignore", invalid="ignore"):
        plus_di, minus_di = np.where(tr == 0, 0.0, 100 * p / tr), np.where(tr == 0, 0.0, 100 * m / tr)
        both = plus_di + minus_di
        dx = np.where(both == 0, 0.0, 100 * np.abs(plus_di - minus_di) / both)
    return {"adx": ewm(dx, 1 / n), "plus_di": plus_di, "minus_di": minus_di}


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 10, k: float = 3.0) -> dict[str, np.ndarray]:
    """Line and direction (1 up, -1 down) from bands of k average true ranges around the middle of the bar.

    A band moves only towards the price, unless the last close was beyond the line.
    """
    width, middle = atr_sma_seed(high, low, close, n), (high + low) / 2
    line, direction = np.empty(len(close)), np.empty(len(close))
    st, way = (float(close[0]), 1.0) if len(close) else (0.0, 1.0)
    for i in range(len(close)):
        if i and not np.isnan(width[i]):
            before, upper, lower = close[i - 1], middle[i] + k * width[i], middle[i] - k * width[i]
            floor = lower if lower > st or before < st else st
            ceiling = upper if upper < st or before > st else st
            way = (-1.0 if close[i] < floor else 1.0) if way > 0 else (1.0 if close[i] > ceiling else -1.0)
            st = floor if way > 0 else ceiling
        line[i], direction[i] = st, way
    return {"supertrend": line, "direction": direction}


def ema_sma_seed(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    y = float(np.mean(x[:n]))
    out[n - 1] = y
    for i in range(n, len(x)):
        y += 2 / (n + 1) * (x[i] - y)
        out[i] = y
    return out


def rsi_sma_seed(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Seeded by the means of the first n changes, at row n; 0 where nothing moved."""
    out = np.full(len(close), np.nan)
    change = np.diff(close)
    up, down = wilder(np.maximum(change, 0), n), wilder(np.maximum(-change, 0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[1:] = np.where(np.isnan(up), np.nan, np.where(up + down == 0, 0.0, 100 * up / (up + down)))
    return out


def atr_sma_seed(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Leaves the first bar out, so the first value is at row n."""
    return wilder(true_range(high, low, close), n, skip=1)


def macd_sma_seed(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, np.ndarray]:
    """Both averages begin at row slow - 1, each seeded by the mean of the rows just before."""
    line = np.full(len(close), np.nan)
    if len(close) >= slow:
        line[slow - 1 :] = ema_sma_seed(close[slow - fast :], fast)[fast - 1 :] - ema_sma_seed(close, slow)[slow - 1 :]
    sig = np.full(len(close), np.nan)
    if len(close) >= slow + signal - 1:
        sig[slow - 1 :] = ema_sma_seed(line[slow - 1 :], signal)
    return {"macd": np.where(np.isnan(sig), np.nan, line), "signal": sig, "histogram": line - sig}


def directional_sma_seed(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    """Running sums of n - 1 rows as seeds of the directional indicators, and the mean of the first n directional indexes."""
    out = {k: np.full(len(close), np.nan) for k in ("adx", "plus_di", "minus_di")}
    if len(close) <= n:
        return out
    up, down = np.diff(high), -np.diff(low)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(high, low, close)[1:]
    p, m, t = plus[: n - 1].sum(), minus[: n - 1].sum(), tr[: n - 1].sum()
    dx: list[float] = []
    for i in range(n - 1, len(tr)):
        p, m, t = p - p / n + plus[i], m - m / n + minus[i], t - t / n + tr[i]
        a, b = (100 * p / t, 100 * m / t) if t else (0.0, 0.0)
        out["plus_di"][i + 1], out["minus_di"][i + 1] = a, b
        dx.append(100 * abs(a - b) / (a + b) if a + b else (dx[-1] if dx else 0.0))
    out["adx"][n:] = wilder(np.array(dx), n)
    return out


def adx_sma_seed(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    return directional_sma_seed(high, low, close, n)["adx"]


def on_balance(close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    """Volumes added where the close rises and taken off where it falls, from the first volume on."""
    return np.cumsum(np.concatenate([volume[:1], np.sign(np.diff(close)) * volume[1:]]))


def _flow(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, n: int) -> float:
    """The money flow index of the last n changes; 0 where hardly anything flowed, 50 for fewer rows."""
    if len(close) <= n:
        return 50.0
    typical = (high + low + close) / 3
    change, flow = np.diff(typical)[-n:], (typical * volume)[-n:]
    up, down = flow[change > 0].sum(), flow[change < 0].sum()
    return float(100 * up / (up + down)) if up + down >= 1 else 0.0


def ema_frame(bars: DataFrame, n: int = 7) -> DataFrame:
    return by_symbol(bars, ("close",), lambda c: {"ema": ema(c, n)}, "ema double", n)


def ema_stack_frame(bars: DataFrame, periods: tuple[int, ...] = (7, 25, 50, 200)) -> DataFrame:
    return by_symbol(bars, ("close",), lambda c: {f"ema{n}": ema(c, n) for n in periods}, ", ".join(f"ema{n} double" for n in periods), max(periods))


def smma_frame(bars: DataFrame, n: int = 14) -> DataFrame:
    return by_symbol(bars, ("close",), lambda c: {"smma": smma(c, n)}, "smma double", n)


def rsi_frame(bars: DataFrame, n: int = 14, method: str = "smma") -> DataFrame:
    return by_symbol(bars, ("close",), lambda c: {"close": c, "rsi": rsi(c, n, method)}, "close double, rsi double", n + 1)


def macd_frame(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def kernel(c):
        line = ema(c, fast) - ema(c, slow)
        s = ema(line, signal)
        return {"macd": line, "signal": s, "histogram": line - s}

    return by_symbol(bars, ("close",), kernel, "macd double, signal double, histogram double", slow)


def atr_frame(bars: DataFrame, n: int = 14) -> DataFrame:
    return by_symbol(bars, ("high", "low", "close"), lambda h, x, c: {"atr": atr(h, x, c, n)}, "atr double", n)


def adx_frame(bars: DataFrame, n: int = 14) -> DataFrame:
    return by_symbol(bars, ("high", "low", "close"), lambda h, x, c: adx(h, x, c, n), "adx double, plus_di double, minus_di double", 2 * n)


def supertrend_frame(bars: DataFrame, n: int = 10, k: float = 3.0) -> DataFrame:
    return by_symbol(bars, ("high", "low", "close"), lambda h, x, c: supertrend(h, x, c, n, k), "supertrend double, direction double")


def _last_valid(x: np.ndarray, default: float) -> float:
    good = x[~np.isnan(x)]
    return float(good[-1]) if len(good) else default


# What the summaries hold where nothing is valid, and the number that stands for a percentile.
DEFAULTS = {"rsi": 50.0, "macd": 0.0, "signal": 0.0, "histogram": 0.0, "stoch_k": 50.0, "stoch_d": 50.0, "adx": 0.0, "plus_di": 0.0, "minus_di": 0.0, "atr": 0.0, "bb_upper": 0.0, "bb_middle": 0.0, "bb_lower": 0.0, "hv": 0.0, "obv": 0.0, "obv_ema": 0.0, "mfi": 50.0}
HV_PERCENTILE = 50.0


def summary_of(h: np.ndarray, x: np.ndarray, c: np.ndarray, v: np.ndarray, n: int = 14, periods: tuple[int, ...] = (7, 25, 50), band: int = 20, width: float = 2.0) -> dict[str, float]:
    """Last values of the mean-seeded indicators of one symbol."""
    with np.errstate(divide="ignore", invalid="ignore"):
        moves = np.log(c[1:] / c[:-1])
    series = {"rsi": rsi_sma_seed(c, n), "atr": atr_sma_seed(h, x, c, n), "obv": on_balance(c, v), "obv_ema": ema_sma_seed(on_balance(c, v), band)} | macd_sma_seed(c) | directional_sma_seed(h, x, c, n)
    out = {k: _last_valid(s, DEFAULTS[k]) for k, s in series.items()} | {f"ema_{p}": _last_valid(ema_sma_seed(c, p), 0.0) for p in periods}
    if len(c) >= n + 4:  # two means of three raw values each
        raw = []
        for i in range(len(c) - 5, len(c)):
            top, bottom = h[i - n + 1 : i + 1].max(), x[i - n + 1 : i + 1].min()
            raw.append(100 * (c[i] - bottom) / (top - bottom) if top > bottom else 0.0)
        k = [float(np.mean(raw[i : i + 3])) for i in range(3)]
        out |= {"stoch_k": k[-1], "stoch_d": float(np.mean(k))}
    if len(c) >= band:
        middle, s = float(c[-band:].mean()), float(c[-band:].std())
        out |= {"bb_upper": middle + width * s, "bb_middle": middle, "bb_lower": middle - width * s}
    if len(moves) >= band:
        out["hv"] = float(moves[-band:].std()) * 252**0.5
    return DEFAULTS | out | {"mfi": _flow(h, x, c, v, n)}


def summaries(bars: DataFrame, n: int = 14, periods: tuple[int, ...] = (7, 25, 50)) -> DataFrame:
    """One row a symbol: last values of the mean-seeded indicators, and what they tell."""
    names = [*DEFAULTS, *[f"ema_{p}" for p in periods]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        found = summary_of(*(pdf[k].to_numpy(dtype=float) for k in ("high", "low", "close", "volume")), n, periods)
        return pd.DataFrame([{"symbol": pdf["symbol"].iloc[0], "last": float(pdf["close"].iloc[-1])} | found])[["symbol", "last", *names]]

    rows = bars.select("symbol", "ts", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(run, "symbol string, last double, " + ", ".join(f"{k} double" for k in names))
    c = F.col
    percent = lambda x, of: F.when(of > 0, x / F.nullif(of, F.lit(0.0)) * 100).otherwise(0.0)
    return rows.withColumns(
        {
            "oversold": c("rsi") < 30, "overbought": c("rsi") > 70, "macd_bullish": c("macd") > c("signal"), "stoch_overbought": c("stoch_k") > 80, "stoch_oversold": c("stoch_k") < 20,
            "strong_trend": c("adx") > 25, "trend_up": c("plus_di") > c("minus_di"), "atr_percent": percent(c("atr"), c("last")), "bb_width": c("bb_upper") - c("bb_lower"), "bb_width_percent": percent(c("bb_upper") - c("bb_lower"), c("bb_middle")),
            "hv_percent": c("hv") * 100, "hv_percentile": F.lit(HV_PERCENTILE), "obv_bullish": c("obv") > c("obv_ema"), "mfi_overbought": c("mfi") > 80, "mfi_oversold": c("mfi") < 20,
        }
    ).drop("last")


def sma_frame(bars: DataFrame, n: int = 20) -> DataFrame:
    """The simple mean of the last n closes; null before."""
    from .windows import frame, full

    return bars.select("symbol", "ts", full(n, F.avg("close").over(frame(1 - n))).alias("sma"))
