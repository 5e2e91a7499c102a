"""Times: texts in ISO form, New York windows, day bounds, and how many bars a window holds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TIMEFRAME_SECONDS

NEW_YORK = ZoneInfo("America/New_York")

# Timeframe and days of the trading styles; the most bars of a window.
PRESETS = {"day_trade": ("1h", 1), "swing_trade": ("4h", 7)}
MOST_BARS = 1000


def parse_iso(text: str) -> datetime:
    """A time in ISO form; Z means UTC."""
    return datetime.fromisoformat(text.strip().replace("Z", "+00:00"))


def to_utc(t: datetime) -> datetime:
    """UTC without zone; a time without zone is New York's."""
    return (t if t.tzinfo else t.replace(tzinfo=NEW_YORK)).astimezone(timezone.utc).replace(tzinfo=None)


def new_york_to_utc(ts: Column) -> Column:
    return F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), ts)


def utc_to_new_york(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)


def day_bounds(ts: Column, offset: int = 0) -> tuple[Column, Column]:
    """Start and end in UTC of the New York day that holds ts, moved by whole absolute days."""
    start = new_york_to_utc(F.date_trunc("day", utc_to_new_york(ts))) + F.expr(f"interval {24 * offset} hours")
    return start, start + F.expr("interval 24 hours")


def estimated_bars(start: datetime, end: datetime, timeframe: str) -> int:
    return max(1, int((end - start).total_seconds() // TIMEFRAME_SECONDS[timeframe]))


def resolve_window(style: str | None = None, timeframe: str | None = None, start: datetime | None = None, end: datetime | None = None, max_bars: int = MOST_BARS, now: datetime | None = None) -> tuple[str, datetime, datetime]:
    """Timeframe, start and end of a window by a style or by its bounds; raises where it holds too many bars."""
    end = to_utc(end) if end else (now or datetime.now(timezone.utc).replace(tzinfo=None))
    if style in PRESETS:
        frame, days = PRESETS[style]
        timeframe, start = timeframe or frame, to_utc(start) if start else end - timedelta(days=days)
    elif style in (None, "custom"):
        if not timeframe or not start:
            raise ValueError("a custom window needs a timeframe and a start")
        start = to_utc(start)
    else:
        raise ValueError(f"unknown trade style: {style}")
    if timeframe not in TIMEFRAME_SECONDS:
        raise ValueError(f"unknown timeframe: {timeframe}")
    if start >= end:
        raise ValueError("the start is not before the end")
    if (n := estimated_bars(start, end, timeframe)) > min(max_bars, MOST_BARS):
        raise ValueError(f"the window holds {n} bars, more than {min(max_bars, MOST_BARS)}")
    return timeframe, start, end
