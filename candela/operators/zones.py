"""Order-block zones: candidates, invalidation, and those still active at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recurrence import atr_frame
from .windows import by_time


def zone_candidates(bars: DataFrame, atr_period: int = 14, impulse: float = 1.0) -> DataFrame:
    """Zones of the last opposite candle before a bar whose body is `impulse` average true ranges and breaks it."""
    joined = bars.join(atr_frame(bars, atr_period), ["symbol", "ts"], "left")
    before = lambda c: F.lag(c).over(by_time())
    rows = joined.select(
        "symbol", "ts", "open", "high", "low", "close", F.coalesce("atr", F.lit(0.0)).alias("atr"), (F.row_number().over(by_time()) - 1).cast("long").alias("i"), (F.count(F.lit(1)).over(Window.partitionBy("symbol")) - 1).cast("long").alias("last_i"),
        *[before(c).alias(f"p_{c}") for c in ("ts", "open", "high", "low", "close")], (F.lead("low").over(by_time()) > before("high")).alias("gap_up"), (F.lead("high").over(by_time()) < before("low")).alias("gap_down"),
    )
    strong = F.abs(F.col("close") - F.col("open")) >= impulse * F.col("atr")
    up = (F.col("close") > F.col("open")) & (F.col("p_close") < F.col("p_open")) & (F.col("close") > F.col("p_high")) & strong
    down = (F.col("close") < F.col("open")) & (F.col("p_close") > F.col("p_open")) & (F.col("close") < F.col("p_low")) & strong
    rows = rows.where((F.col("i") >= 2) & (F.col("i") < F.col("last_i")) & (up | down))
    return rows.select(
        "symbol", F.when(up, "bullish").otherwise("bearish").alias("direction"), F.col("p_ts").alias("block_ts"), (F.col("i") - 1).alias("block_i"), F.col("i").alias("created_i"), F.when(up, F.col("p_low")).otherwise(F.col("p_open")).alias("zone_low"), F.when(up, F.col("p_open")).otherwise(F.col("p_high")).alias("zone_high"),
        "atr", F.when(up, F.col("gap_up")).otherwise(F.col("gap_down")).alias("has_gap"), "last_i",
    )


def with_invalidation(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds whether a close from the block's next bar on lies beyond the zone: one look at the least (largest) later close."""
    later = by_time().rowsBetween(0, Window.unboundedFollowing)
    rows = bars.select("symbol", (F.row_number().over(by_time()) - 2).cast("long").alias("block_i"), F.min("close").over(later).alias("least"), F.max("close").over(later).alias("most"))
    joined = zones.join(rows, ["symbol", "block_i"])
    bad = F.when(F.col("direction") == "bullish", F.col("least") < F.col("zone_low")).otherwise(F.col("most") > F.col("zone_high"))
    return joined.withColumn("invalidated", bad).drop("least", "most")


def active_zones(bars: DataFrame, atr_period: int = 14, impulse: float = 1.0, max_age: int = 20) -> DataFrame:
    """Zones that hold at the last bar and are young enough, with their age in bars."""
    zones = with_invalidation(bars, zone_candidates(bars, atr_period, impulse))
    age = F.col("last_i") - F.col("created_i")
    return zones.where(~F.col("invalidated") & (age <= max_age)).select("symbol", F.col("direction").alias("type"), F.col("block_ts").alias("date"), "zone_low", "zone_high", age.alias("freshness"), "has_gap")
