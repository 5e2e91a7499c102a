"""Costs of trades, as expressions and as numbers."""

from __future__ import annotations

from pyspark.sql import Column

# Share of the value, and basis points, that a trade costs by default; rates of two venues.
COMMISSION, SLIPPAGE_BPS = 0.001, 5.0
VENUE_RATES = {"binance": 0.001, "bybit": 0.00075}


def commission(value, rate: float = COMMISSION):
    return value * rate


def slipped(price, buy: bool, bps: float = SLIPPAGE_BPS):
    """What a buyer pays, or a seller gets."""
    return price * (1 + bps / 1e4) if buy else price * (1 - bps / 1e4)


def net_pnl(entry, exit_, size, rate: float = COMMISSION, bps: float = SLIPPAGE_BPS):
    """Gain of a long trade after both commissions and slippage on the mean price. Numbers or columns."""
    return (exit_ - entry) * size - commission(entry * size, rate) - commission(exit_ * size, rate) - size * (bps / 1e4) * (entry + exit_) / 2


def bps_to_price(price, bps: float):
    return price * bps / 1e4


def retrace_in_band(a: Column, b: Column, c: Column, low: float, high: float) -> Column:
    """Whether c takes back a share of the move from a to b that lies in the band, without passing a."""
    size = (b - a) * (b - a)
    back = (b - c) * (b - c)
    return (size > 0) & (((b > a) & (c >= a)) | ((b < a) & (c <= a))) & (back >= size * low * low) & (back <= size * high * high)
