"""Bars from ticks, records and files, and what stands for a provider: ranges, tails, latest rows, order books."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BARS, EXCHANGES, MAX_LIMIT, MIN_LIMIT, OHLCV, TIMEFRAME_SECONDS


def bucket(ts: Column, seconds: int) -> Column:
    """The start of the bar that holds ts; bars are aligned to 1970-01-01 00:00 UTC."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(epoch / seconds) * seconds).cast("timestamp_ntz")


def bars_from_ticks(ticks: DataFrame, timeframe: str = "1h", symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id", volume: str | None = None) -> DataFrame:
    """First, largest, least and last price of each symbol and bar, and the number (or summed volume) of ticks.

    One aggregation with map-side partial results; a symbol's share of the ticks does not matter. Equal times are put
    in order by `tie`.
    """
    key = F.struct(F.col(ts), F.col(tie))
    return (
        ticks.where(F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double")))
        .groupBy(F.col(symbol).alias("symbol"), bucket(F.col(ts), TIMEFRAME_SECONDS[timeframe]).alias("ts"))
        .agg(
            F.min_by(price, key).cast("double").alias("open"),
            F.max(price).cast("double").alias("high"),
            F.min(price).cast("double").alias("low"),
            F.max_by(price, key).cast("double").alias("close"),
            (F.count("*") if volume is None else F.sum(volume)).cast("double").alias("volume"),
        )
    )


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Larger bars from smaller ones."""
    return (
        bars.groupBy("symbol", bucket(F.col("ts"), TIMEFRAME_SECONDS[timeframe]).alias("bar"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("bar", "ts")
    )


def canonical(frame: DataFrame, symbol: str | None = None) -> DataFrame:
    """Names in lower case with underscores, missing price columns as 0, types and order of a bar; NaN becomes null."""
    frame = frame.toDF(*[c.lower().replace(" ", "_") for c in frame.columns])
    for name in ("timestamp", "date", "datetime"):
        if "ts" not in frame.columns and name in frame.columns:
            frame = frame.withColumnRenamed(name, "ts")
    if "symbol" not in frame.columns:
        frame = frame.withColumn("symbol", F.lit(symbol))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if c in frame.columns else F.lit(0.0)
    return frame.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), *[number(c).alias(c) for c in OHLCV])


def bars_from_records(records: DataFrame, symbol: str = "symbol", record: str = "record") -> DataFrame:
    """Bars from arrays [milliseconds, open, high, low, close, volume]."""
    at = lambda i: F.get(F.col(record), F.lit(i)).cast("double")
    return records.select(F.col(symbol).alias("symbol"), F.timestamp_millis(at(0).cast("long")).cast("timestamp_ntz").alias("ts"), *[at(i + 1).alias(c) for i, c in enumerate(OHLCV)])


def to_columns(bars: DataFrame) -> DataFrame:
    """One row for each symbol with arrays of times and prices in order."""
    rows = F.sort_array(F.collect_list(F.struct("ts", *OHLCV)))
    return bars.groupBy("symbol").agg(rows.alias("r")).select("symbol", F.col("r.ts").alias("ts"), *[F.col(f"r.{c}").alias(c) for c in OHLCV])


def from_columns(columns: DataFrame) -> DataFrame:
    """The inverse of to_columns."""
    return columns.select("symbol", F.inline(F.arrays_zip("ts", *OHLCV)))


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)


def violations(bars: DataFrame) -> DataFrame:
    """Counts of broken rules by symbol: repeated times, missing or non-finite values, high below low, volume below 0."""
    w = Window.partitionBy("symbol").orderBy("ts")
    finite = F.lit(True)
    for c in OHLCV:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return (
        bars.withColumn("before", F.lag("ts").over(w))
        .groupBy("symbol")
        .agg(
            F.count("*").alias("bars"),
            F.count_if(F.col("ts") == F.col("before")).alias("repeated"),
            F.count_if(~finite).alias("not_finite"),
            F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
            F.count_if(F.col("volume") < 0).alias("negative_volume"),
        )
    )


def in_range(bars: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Bars of [start, end); the bounds are literals, so they reach the scan."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def fetch_start(start: datetime, end: datetime, timeframe: str, limit: int, warmup: int = 0) -> datetime:
    """Where a fetch may begin, so that it holds no more than the bars allowed."""
    return max(start, end - timedelta(seconds=TIMEFRAME_SECONDS[timeframe] * min(MAX_LIMIT, limit + warmup)))


def fetch_limit(start: datetime, end: datetime, timeframe: str) -> int:
    return min(MAX_LIMIT, max(MIN_LIMIT, math.ceil((end - start).total_seconds() / TIMEFRAME_SECONDS[timeframe])))


def check_request(exchange: str, timeframe: str, limit: int, warmup: int = 0, symbol: str = "") -> None:
    if not symbol.strip():
        raise ValueError("symbol is empty")
    if exchange not in EXCHANGES:
        raise ValueError(f"unknown exchange: {exchange}")
    if timeframe not in TIMEFRAME_SECONDS:
        raise ValueError(f"unknown timeframe: {timeframe}")
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be {MIN_LIMIT} to {MAX_LIMIT}")
    if warmup < 0:
        raise ValueError("warm-up must not be negative")


# What ends a name of the secondary provider's own form, the timeframes that it knows, and its default span.
NATIVE_END = "-USD"
SECONDARY_TIMEFRAMES = tuple(t for t in TIMEFRAME_SECONDS if t != "4h")
SECONDARY_DAYS = 30


def is_native(symbol: str) -> bool:
    """Whether a name has the form of the secondary provider."""
    return symbol.strip().upper().endswith(NATIVE_END)


def canonical_name(symbol: str) -> str:
    """BASE-USD as BASE/USDT; other names in capitals."""
    name = symbol.strip().upper()
    base = name[: -len(NATIVE_END)]
    return f"{base}/USDT" if is_native(name) and base.isalnum() else name


def without_empty(bars: DataFrame) -> DataFrame:
    """bars without those whose prices are all missing; such bars alone make an answer empty."""
    return bars.where(~F.forall(F.array("open", "high", "low", "close"), lambda x: x.isNull() | F.isnan(x)))


class Sources:
    """Named providers of bars, tried in order: each takes a session and returns bars; the first with rows is used.

    Names of the secondary provider's own form pass over the others; bars whose prices are all missing are none.
    """

    def __init__(self) -> None:
        self.providers: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self.secondary: str | None = None

    def register(self, name: str, read: Callable[[SparkSession], DataFrame], secondary: bool = False) -> None:
        self.providers[name] = read
        if secondary:
            self.secondary = name

    def fetch(self, spark: SparkSession, symbol: str, timeframe: str, start: datetime | None, end: datetime, limit: int = MAX_LIMIT, warmup: int = 0, exchange: str = "binance") -> tuple[DataFrame, dict]:
        """The last limit + warm-up bars in the range, and which provider gave them, warnings, and why there are none.

        Without a start, the range is that of the last SECONDARY_DAYS days before its end.
        """
        check_request(exchange, timeframe, limit, warmup, symbol)
        start = start or end - timedelta(days=SECONDARY_DAYS)
        begin, warnings = fetch_start(start, end, timeframe, limit, warmup), []
        native = is_native(symbol) and self.secondary is not None
        told = {"canonical_symbol": canonical_name(symbol), "provider_symbol": symbol.strip().upper() if native else symbol}
        for name, read in self.providers.items():
            if native and name != self.secondary:
                continue
            if name == self.secondary and timeframe not in SECONDARY_TIMEFRAMES:
                warnings.append(f"{name}: unsupported timeframe")
                continue
            try:
                rows = without_empty(canonical(read(spark)).where(F.col("symbol") == told["provider_symbol"]))
                found = last_bars(in_range(rows, begin, end), limit + warmup)
                if not found.isEmpty():
                    return found, {"source_used": name, "warnings": warnings, "failure_reason": None, **told}
                warnings.append(f"{name}: no rows")
            except Exception as e:  # a provider that fails is passed over, and said so
                warnings.append(f"{name}: {type(e).__name__}")
        return empty_bars(spark), {"source_used": None, "warnings": warnings, "failure_reason": "no provider has rows", **told}


def latest_ticker(ticks: DataFrame, symbol: str = "event_type", ts: str = "ts", price: str = "value", tie: str = "event_id", bid: str | None = None, ask: str | None = None, volume: str | None = None) -> DataFrame:
    """The latest price, bid and ask of each symbol, their time, and change (in percent) and volume of the last 24 hours.

    bid, ask and volume name columns of the ticks, if there are such; without volume, ticks are counted.
    """
    key, none = F.struct(F.col(ts), F.col(tie)), F.lit(None).cast("double")
    named = ticks.select(F.col(symbol).alias("symbol"), F.col(ts).alias("at"), key.alias("key"), F.col(price).alias("price"), *[(F.col(c).cast("double") if c else none).alias(n) for n, c in (("bid", bid), ("ask", ask))], (F.col(volume).cast("double") if volume else F.lit(1.0)).alias("volume"))
    last = named.groupBy("symbol").agg(F.max_by(F.struct("price", "bid", "ask"), "key").alias("l"), F.max("at").alias("ts"))
    # one row a symbol, so it goes to the ticks
    day = named.select("symbol", "at", "key", "price", "volume").join(last.select("symbol", "ts"), "symbol")
    early = F.col("at") <= F.col("ts") - F.expr("interval 24 hours")
    summed = day.groupBy("symbol").agg(F.max_by("price", F.when(early, F.col("key"))).alias("before"), F.sum(F.when(~early, F.col("volume"))).alias("volume_24h"))
    change = (F.col("l.price") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)) * 100
    return last.join(summed, "symbol").select("symbol", "ts", "l.price", "l.bid", "l.ask", change.alias("change_pct_24h"), "volume_24h")


def order_book(levels: DataFrame, depth: int, symbol: str = "symbol", side: str = "side", price: str = "price", amount: str = "amount") -> DataFrame:
    """The best `depth` levels of each symbol and side: bids from the highest price, asks from the lowest."""
    best = F.when(F.col(side) == "bid", -F.col(price)).otherwise(F.col(price))
    summed = levels.groupBy(symbol, side, price).agg(F.sum(amount).alias(amount))
    w = Window.partitionBy(symbol, side).orderBy(best)
    return summed.withColumn("level", F.row_number().over(w).cast("long")).where(F.col("level") <= depth)


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Bars of a file of any of Spark's formats, in canonical form."""
    return canonical(spark.read.format(kind).options(**options).load(path))


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with one folder a symbol, so that a filter on the symbol reads only its files."""
    bars.repartition("symbol", F.to_date("ts")).sortWithinPartitions("symbol", "ts").write.mode(mode).partitionBy("symbol").parquet(path)
