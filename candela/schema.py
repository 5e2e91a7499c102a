"""Schemas and fixed values shared by the market operators.

Every relation of bars is keyed: (symbol, ts, open, high, low, close, volume). Timestamps are without zone and mean UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of a bar, exchanges, timeframes in seconds, limits.
OHLCV = ("open", "high", "low", "close", "volume")
EXCHANGES = ("binance", "bybit", "coinbase", "kraken")
TIMEFRAME_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1wk": 604800, "1mo": 2592000}
MIN_LIMIT, MAX_LIMIT = 1, 1000

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in OHLCV]]
)

SWINGS = "symbol string, swing_id long, pivot_index long, swing_type string, pivot_ts timestamp_ntz, pivot_price double, leg_start_ts timestamp_ntz, leg_start_price double, leg_end_ts timestamp_ntz, leg_end_price double, price_delta double, pct_delta double"
