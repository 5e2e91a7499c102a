"""The same bars and averages over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TIMEFRAME_SECONDS


def streamed_bars(ticks: DataFrame, timeframe: str = "1h", late: str = "10 minutes", symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of a stream of ticks (ts: timestamp); a bar is given once, when the watermark has passed its end."""
    key = F.struct(F.col(ts), F.col(tie))
    span = F.window(F.col(ts), f"{TIMEFRAME_SECONDS[timeframe]} seconds")
    bars = (
        ticks.withWatermark(ts, late)
        .groupBy(F.col(symbol).alias("symbol"), span.alias("span"))
        .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").cast("double").alias("volume"))
    )
    return bars.select("symbol", F.col("span.start").alias("ts"), "open", "high", "low", "close", "volume")


def streamed_sessions(bars: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each symbol, ended by a gap."""
    return bars.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("bars")).select("symbol", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "bars")


def streamed_ema(bars: DataFrame, n: int = 7, late: str = "1 hour") -> DataFrame:
    """EMA of the bars of each symbol as they come; the last value and its time are the state.

    Bars of one batch are put in order. A bar that is not after the last one of its symbol is late and passed over, as
    later values have been given already.
    """
    alpha = 2 / (n + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("ts").drop_duplicates("ts")
        y, last = state.get if state.exists else (None, None)
        if last is not None:
            rows = rows[rows["ts"] > pd.Timestamp(last)]
        out = []
        for x in rows["close"]:
            y = float(x) if y is None else (1 - alpha) * y + alpha * float(x)
            out.append(y)
        if out:
            state.update((y, rows["ts"].iloc[-1].to_pydatetime()))
        yield pd.DataFrame({"symbol": [key[0]] * len(out), "ts": rows["ts"].to_numpy(), "ema": out})

    given = bars.select("symbol", "ts", "close").withWatermark("ts", late)
    return given.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, ema double", "y double, last timestamp", "append", "NoTimeout")
