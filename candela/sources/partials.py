"""Bars kept up to date: partial bars that merge in any order, and a store of them that late ticks touch only where they fall.

A partial bar holds the earliest and the latest tick with their times, the highest and lowest price, the number of ticks and their
volume. Merging is associative and commutative, and the bar of no ticks is its unit, so ticks may come in any parts, as
long as each comes once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TIMEFRAME_SECONDS
from .bars import bucket

KEYS = ("symbol", "ts")


def partial_bars(ticks: DataFrame, timeframe: str = "1h", symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id", volume: str | None = None) -> DataFrame:
    """symbol, ts, first and last (at, tie, price), high, low, ticks, volume of each bar. Ticks without a price are left out."""
    value = F.col(price).cast("double")
    tick = F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"), value.alias("price"))
    return (
        ticks.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(F.col(symbol).alias("symbol"), bucket(F.col(ts), TIMEFRAME_SECONDS[timeframe]).alias("ts"))
        .agg(
            F.min(tick).alias("first"), F.max(tick).alias("last"), F.max(value).alias("high"), F.min(value).alias("low"), F.count("*").alias("ticks"),
            (F.count("*") if volume is None else F.sum(volume)).cast("double").alias("volume"),
        )
    )


def merged(*parts: DataFrame) -> DataFrame:
    """The partial bars of all parts together."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("ticks").alias("ticks"), F.sum("volume").alias("volume"))


def finished(partials: DataFrame) -> DataFrame:
    return partials.select(*KEYS, F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume")


class BarStore:
    """Partial bars as Parquet, in folders by day; an update rewrites the days that its ticks fall on, and no other file."""

    def __init__(self, spark, path: str, timeframe: str = "1h"):
        self.spark, self.path, self.timeframe = spark, path, timeframe

    def _written(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def update(self, ticks: DataFrame, **columns: str) -> None:
        """Merge new ticks in. Ticks that were given before would count twice."""
        new = partial_bars(ticks, self.timeframe, **columns).withColumn("day", F.to_date("ts"))
        if self._written():
            days = new.select("day").distinct()  # the scan of the store is pruned to these days while it runs
            old = self.spark.read.parquet(self.path).join(F.broadcast(days), "day", "left_semi")
            new = merged(old.drop("day"), new.drop("day")).withColumn("day", F.to_date("ts"))
        # dealt by day, so that a day is one file or, if large, some
        new.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def partials(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("day")

    def bars(self) -> DataFrame:
        return finished(self.partials())
