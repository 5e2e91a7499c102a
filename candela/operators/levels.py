"""Session and previous-day levels, and Fibonacci levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import pivot_levels

NEW_YORK = "America/New_York"

# Hours of the sessions in UTC, minutes of day in New York, level ratios.
SESSION_HOURS = {"asia": (0, 9), "london": (8, 17)}
NEW_YORK_MINUTES = (570, 960)
RETRACEMENTS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
EXTENSIONS = (1.272, 1.618, 2.0, 2.618)


def local_time(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), ts)


def in_session(ts: Column, session: str) -> Column:
    if session == "ny":
        minute = F.hour(local_time(ts)) * 60 + F.minute(local_time(ts))
        return (minute >= NEW_YORK_MINUTES[0]) & (minute < NEW_YORK_MINUTES[1])
    start, end = SESSION_HOURS[session]
    return (F.hour(ts) >= start) & (F.hour(ts) < end)


def session_day(ts: Column, session: str) -> Column:
    return F.to_date(local_time(ts)) if session == "ny" else F.to_date(ts)


def session_levels(bars: DataFrame, session: str) -> DataFrame:
    """Levels of the last bar's session day, or of the day before where that has no bars; 0 bars where neither has.

    Days are summed up first, so only one row a symbol and day is compared with the symbol's last bar.
    """
    session = "ny" if session == "new_york" else session
    if session != "ny" and session not in SESSION_HOURS:
        raise ValueError(f"unknown session: {session}")
    inside = in_session(F.col("ts"), session)
    only = lambda c: F.when(inside, F.col(c))
    days = bars.groupBy("symbol", session_day(F.col("ts"), session).alias("day")).agg(
        F.max(only("high")).alias("high"), F.min(only("low")).alias("low"), F.count(F.when(inside, 1)).alias("bars"), F.min(only("ts")).alias("start"), F.max(only("ts")).alias("end"), F.max("ts").alias("last")
    )
    last = days.groupBy("symbol").agg(F.max_by("day", "last").alias("today"))
    near = days.join(last, "symbol").where((F.col("bars") > 0) & ((F.col("day") == F.col("today")) | (F.col("day") == F.date_sub("today", 1))))
    best = near.groupBy("symbol").agg(F.max_by(F.struct("high", "low", "bars", "start", "end"), "day").alias("b"))
    return last.join(best, "symbol", "left").select(
        "symbol",
        F.lit(session).alias("session_type"),
        F.col("b.start").alias("session_start"),
        F.col("b.end").alias("session_end"),
        F.col("b.high").alias("high"),
        F.col("b.low").alias("low"),
        (F.col("b.high") - F.col("b.low")).alias("range"),
        ((F.col("b.high") + F.col("b.low")) / 2).alias("midpoint"),
        F.coalesce("b.bars", F.lit(0)).alias("bars"),
    )


def previous_day_levels(bars: DataFrame) -> DataFrame:
    """High, low and close of the New York day before the last bar's, its pivots, and where the last close stands.

    Nulls, and `insufficient_data`, where the data begin within that day or end short of it by more than the median
    interval.
    """
    w = Window.partitionBy("symbol")
    rows = bars.select("symbol", "ts", "high", "low", "close", F.lag("ts").over(w.orderBy("ts")).alias("before"))
    seconds = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("before").cast("timestamp"))).cast("double")
    whole = rows.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("close", "ts").alias("current"), F.coalesce(F.median(seconds), F.lit(0.0)).alias("interval"))
    start = F.date_trunc("day", local_time(F.col("last")))
    to_utc = lambda t: F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), t)
    # bounds are 24 absolute hours apart
    whole = whole.withColumn("day_end", to_utc(start)).withColumn("day_start", F.col("day_end") - F.expr("interval 24 hours"))
    day = rows.join(whole.select("symbol", "day_start", "day_end"), "symbol").where((F.col("ts") >= F.col("day_start")) & (F.col("ts") < F.col("day_end")))
    found = day.groupBy("symbol").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.max("ts").alias("day_last"), F.min_by("ts", F.struct(-F.col("high"), "ts")).alias("high_ts"), F.min_by("ts", F.struct("low", "ts")).alias("low_ts")
    )
    both = whole.join(found, "symbol", "left")
    lacking = F.unix_seconds(F.col("day_end").cast("timestamp")) - F.unix_seconds(F.col("day_last").cast("timestamp"))
    complete = F.col("day_last").isNotNull() & (F.col("first") <= F.col("day_start")) & ((F.col("interval") <= 0) | (lacking <= F.col("interval")))
    both = both.withColumns({c: F.when(complete, F.col(c)) for c in ("high", "low", "close", "high_ts", "low_ts")})
    both = both.withColumn("pivot", (F.col("high") + F.col("low") + F.col("close")) / 3)
    position = F.when(F.col("high").isNull(), "insufficient_data").when(F.col("current") > F.col("high"), "above_pdh").when(F.col("current") < F.col("low"), "below_pdl").otherwise("inside_range")
    return both.select(
        "symbol", F.col("high").alias("pdh"), F.col("low").alias("pdl"), F.col("close").alias("pdc"), (F.col("high") - F.col("low")).alias("pd_range"), F.col("high_ts").alias("pdh_ts"), F.col("low_ts").alias("pdl_ts"), "pivot", *pivot_levels("pivot", "high", "low"), position.alias("position")
    )


def swing_range(bars: DataFrame) -> DataFrame:
    """Each symbol's highest high and lowest low."""
    return bars.groupBy("symbol").agg(F.max("high").alias("swing_high"), F.min("low").alias("swing_low"))


def _levels(rows: DataFrame, ratios: Sequence[float], kind: str, price, trend: str | None) -> DataFrame:
    if any(r < 0 for r in ratios):
        raise ValueError("ratios must not be negative")
    ratio = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("level_ratio")
    rows = rows.select("symbol", "swing_high", "swing_low", ratio)
    return rows.select("symbol", F.lit(kind).alias("level_type"), "level_ratio", price.alias("price"), "swing_high", "swing_low", F.lit(trend).cast("string").alias("trend_direction"))


def retracements(rows: DataFrame, ratios: Sequence[float] = RETRACEMENTS) -> DataFrame:
    """low + (high - low) ratio for rows (symbol, swing_high, swing_low)."""
    return _levels(rows, ratios, "retracement", F.col("swing_low") + (F.col("swing_high") - F.col("swing_low")) * F.col("level_ratio"), None)


def extensions(rows: DataFrame, direction: str = "bullish", ratios: Sequence[float] = EXTENSIONS) -> DataFrame:
    """Up from the low when bullish, down from the high when bearish."""
    span = (F.col("swing_high") - F.col("swing_low")) * F.col("level_ratio")
    price = F.col("swing_low") + span if direction == "bullish" else F.col("swing_high") - span
    return _levels(rows, ratios, "extension", price, direction)


def confluence(level_sets: Sequence[DataFrame], tolerance: float = 0.005) -> DataFrame:
    """Clusters of two or more levels: in order of price, each joins the cluster if near its running mean."""
    union = None
    for i, levels in enumerate(level_sets):
        part = levels.select("symbol", F.struct("price", F.lit(i).alias("set"), "level_type", "level_ratio").alias("level"))
        union = part if union is None else union.unionByName(part)
    state = "struct<clusters: array<array<struct<price: double, `set`: int, level_type: string, level_ratio: double>>>, mean: double>"
    zero = F.from_json(F.lit('{"clusters": [], "mean": 0}'), state)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["price"]) / F.size(c)

    def step(a: Column, x: Column) -> Column:
        near = (F.size(a["clusters"]) > 0) & (F.abs(x["price"] - a["mean"]) <= F.abs(a["mean"]) * tolerance)
        grown = F.array_append(F.element_at(a["clusters"], -1), x)
        joined = F.array_append(F.slice(a["clusters"], 1, F.size(a["clusters"]) - 1), grown)
        return F.when(near, F.struct(joined.alias("clusters"), mean(grown).alias("mean"))).otherwise(F.struct(F.array_append(a["clusters"], F.array(x)).alias("clusters"), x["price"].alias("mean")))

    ordered = union.groupBy("symbol").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    clusters = F.aggregate("levels", zero, step, lambda a: F.filter(a["clusters"], lambda c: F.size(c) >= 2))
    rows = ordered.select("symbol", F.posexplode(clusters).alias("n", "c"))
    return rows.select(
        "symbol",
        (F.col("n") + 1).cast("long").alias("cluster_id"),
        F.round(mean(F.col("c")), 10).alias("centre_price"),
        F.array_min(F.col("c.price")).alias("min_price"),
        F.array_max(F.col("c.price")).alias("max_price"),
        F.size("c").cast("long").alias("level_count"),
        F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["set"].cast("string"), x["level_type"], x["level_ratio"].cast("string"))), ",").alias("contributors"),
    )
