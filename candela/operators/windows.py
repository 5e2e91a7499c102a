"""Indicators that look at a bounded or running frame of bars: built-in windows, one exchange on the symbol.

Every function takes bars and returns the columns named, in the order of (symbol, ts) of its rows. Divisions by zero give
the values stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    """The rows of a symbol in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def frame(a: int, b: int = 0):
    return by_time().rowsBetween(a, b)


def running():
    return frame(Window.unboundedPreceding)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def full(n: int, value: Column) -> Column:
    """value where the last n rows are all there, else null."""
    return F.when(F.count(F.lit(1)).over(frame(-(n - 1))) == n, value)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def true_range_of() -> Column:
    before = F.lag("close").over(by_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def true_range(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", true_range_of().alias("true_range"))


def enough(bars: DataFrame, n: int) -> DataFrame:
    """Bars of the symbols that have n bars or more."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("_n") >= n).drop("_n")


def stochastic(bars: DataFrame, k: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    """%K and %D; a flat range counts as 50; both are clipped to 0..100 at the end."""
    bars = enough(bars.dropna(subset=["high", "low", "close"]), k)
    low, high = F.min("low").over(frame(1 - k)), F.max("high").over(frame(1 - k))
    raw = F.when(high == low, 50.0).otherwise(100 * (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)))
    out = bars.select("symbol", "ts", full(k, raw).alias("raw"), F.row_number().over(by_time()).alias("rn"))
    mean = lambda c, n, first: F.when(F.col("rn") >= first, F.avg(c).over(frame(1 - n)))
    out = out.withColumn("k", mean("raw", smooth, k + smooth - 1) if smooth > 1 else F.col("raw"))
    out = out.withColumn("d", mean("k", d, k + smooth - 1 + d - 1 if smooth > 1 else k + d - 1))
    clip = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(100.0)))
    return out.select("symbol", "ts", clip("k").alias("k"), clip("d").alias("d"))


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index; null where the mean deviation is 0."""
    tp = bars.select("symbol", "ts", typical().alias("tp"))
    tp = tp.withColumn("mean", full(n, F.avg("tp").over(frame(1 - n)))).withColumn("all", F.collect_list("tp").over(frame(1 - n)))
    deviation = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean"))) / n
    return tp.select("symbol", "ts", ratio(F.col("tp") - F.col("mean"), 0.015 * deviation).alias("cci"))


def williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    """0 to -100; a flat range counts as -50."""
    low, high = F.min("low").over(frame(1 - n)), F.max("high").over(frame(1 - n))
    value = F.when(high == low, -50.0).otherwise(-100 * (high - F.col("close")) / F.nullif(high - low, F.lit(0.0)))
    return bars.select("symbol", "ts", full(n, value).alias("williams_r"))


def roc(bars: DataFrame, n: int = 12) -> DataFrame:
    before = F.lag("close", n).over(by_time())
    return bars.select("symbol", "ts", ratio(100 * (F.col("close") - before), before).alias("roc"))


def bollinger_width(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Width of the bands over the mean; rows before the first full frame are left out."""
    bars = bars.dropna(subset=["close"])
    mean, deviation = F.avg("close").over(frame(1 - n)), F.stddev_pop("close").over(frame(1 - n))
    return bars.select("symbol", "ts", full(n, ratio(2 * k * deviation, mean)).alias("bollinger_width")).dropna(subset=["bollinger_width"])


def log_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_time())
    return bars.withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)))


def historical_volatility(bars: DataFrame, n: int = 252, annualize: bool = True) -> DataFrame:
    """Population deviation of n log returns; symbols with a price of 0 or less give no rows."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    bars = bars.withColumn("_least", F.min("close").over(Window.partitionBy("symbol"))).where("_least > 0")
    out = log_returns(bars).select("symbol", "ts", "log_return", F.row_number().over(by_time()).alias("rn"))
    value = F.stddev_pop("log_return").over(frame(1 - n)) * (math.sqrt(252) if annualize else 1.0)
    return out.withColumn("volatility", value).where(F.col("rn") > n).select("symbol", "ts", "volatility")


def latest_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Sample deviation of the last n log returns of each symbol, and in percent."""
    out = log_returns(bars).withColumn("hv", F.stddev_samp("log_return").over(frame(1 - n)) * math.sqrt(252))
    last = out.groupBy("symbol").agg(F.max_by("hv", "ts").alias("hv"))
    return last.select("symbol", "hv", (F.col("hv") * 100).alias("hv_pct"), F.lit(50.0).alias("percentile"))


def obv(bars: DataFrame) -> DataFrame:
    """On-balance volume, beginning with the first bar's volume."""
    bars = bars.dropna(subset=["close", "volume"])
    before = F.lag("close").over(by_time())
    signed = F.when(before.isNull(), F.col("volume")).when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0.0)
    return bars.withColumn("_signed", signed).select("symbol", "ts", F.sum("_signed").over(running()).alias("obv"))


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index from the n - 1 changes within each frame; rows from number n + 1 on."""
    bars = bars.dropna(subset=["high", "low", "close", "volume"])
    flows = bars.select("symbol", "ts", typical().alias("tp"), (typical() * F.col("volume")).alias("flow"), F.row_number().over(by_time()).alias("rn"))
    before = F.lag("tp").over(by_time())
    flows = flows.withColumns({"up": F.when(F.col("tp") > before, F.col("flow")).otherwise(0.0), "down": F.when(F.col("tp") < before, F.col("flow")).otherwise(0.0)})
    flows = flows.withColumns({c: F.sum(c).over(frame(2 - n)) for c in ("up", "down")})
    value = F.when((F.col("up") == 0) & (F.col("down") == 0), 50.0).when(F.col("down") == 0, 100.0).when(F.col("up") == 0, 0.0).otherwise(100 - 100 / (1 + ratio(F.col("up"), F.col("down"))))
    return flows.where(F.col("rn") > n).select("symbol", "ts", value.alias("mfi"))


# Zone and time of day at which a session of each anchor begins.
ANCHORS = {"asia": ("UTC", 0, 0), "london": ("UTC", 8, 0), "ny": ("America/New_York", 9, 30), "daily": ("America/New_York", 0, 0)}


def session_key(ts: Column, anchor: str) -> Column:
    """The local day whose session ts belongs to; before the day's boundary it is the day before."""
    zone, hour, minute = ANCHORS[anchor]
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    return F.to_date(F.date_trunc("day", local - F.expr(f"interval {hour * 60 + minute} minutes")))


def vwap(bars: DataFrame, anchor: str = "ny") -> DataFrame:
    """Volume-weighted mean of the typical price since the session began; the typical price while there is no volume."""
    rows = bars.select("symbol", "ts", "close", "volume", typical().alias("tp"), session_key(F.col("ts"), anchor).alias("session"))
    w = Window.partitionBy("symbol", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(ratio(F.sum(F.col("tp") * F.col("volume")).over(w), F.sum("volume").over(w)), F.col("tp"))
    return rows.select("symbol", "ts", "session", "close", value.alias("vwap"))


def vwap_bands(bars: DataFrame, anchor: str = "ny", k: float = 2.0, strict: bool = False) -> DataFrame:
    """Bands at k deviations of close from vwap, over all of a symbol's rows; with strict, over the rows so far."""
    rows = vwap(bars, anchor)
    w = running() if strict else Window.partitionBy("symbol")
    deviation = F.stddev_pop(F.col("close") - F.col("vwap")).over(w)
    return rows.select("symbol", "ts", "vwap", (F.col("vwap") + k * deviation).alias("upper"), (F.col("vwap") - k * deviation).alias("lower"))


def vwap_cross(bars: DataFrame, anchor: str = "ny") -> DataFrame:
    """Rows at which close passes to the other side of vwap."""
    rows = vwap(bars, anchor).dropna(subset=["close", "vwap"]).withColumn("above", F.col("close") >= F.col("vwap"))
    return rows.withColumn("before", F.lag("above").over(by_time())).where("above <> before").select("symbol", "ts", "close", "vwap", F.when(F.col("above"), "bullish").otherwise("bearish").alias("direction"))


def zone(value: Column, low: float = 30.0, high: float = 70.0) -> Column:
    return F.when(value <= low, "oversold").when(value >= high, "overbought").otherwise("neutral")


def rsi_extremes(rsi: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """Changes of zone of rows (symbol, ts, rsi); the first row counts unless it is neutral."""
    rows = rsi.dropna(subset=["rsi"]).withColumn("zone", zone(F.col("rsi"), low, high))
    return rows.withColumn("before", F.lag("zone", 1, "neutral").over(by_time())).where("zone <> before").select("symbol", "ts", "rsi", "zone")


def rsi_cross(rsi: DataFrame, threshold: float = 50.0) -> DataFrame:
    rows = rsi.dropna(subset=["rsi"]).withColumn("above", F.col("rsi") >= threshold)
    return rows.withColumn("before", F.lag("above").over(by_time())).where("above <> before").select("symbol", "ts", "rsi", F.when(F.col("above"), "bullish").otherwise("bearish").alias("direction"))


def rsi_divergence(rows: DataFrame, window: int = 20) -> DataFrame:
    """Divergences of close and rsi at strict local extremes against the extreme before it within the window.

    rows: symbol, ts, close, rsi. Positions count the rows in which both are there.
    """
    rows = rows.dropna(subset=["close", "rsi"]).withColumns({"i": F.row_number().over(by_time()) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    before, after = F.lag("close").over(by_time()), F.lead("close").over(by_time())
    rows = rows.withColumns({"is_low": (F.col("close") < before) & (F.col("close") < after), "is_high": (F.col("close") > before) & (F.col("close") > after)})
    past = frame(1 - window, -2)
    last = lambda flag: F.last(F.when(F.col(flag), F.struct("close", "rsi")), ignorenulls=True).over(past)
    rows = rows.withColumns({"low": last("is_low"), "high": last("is_high")})
    half = window // 2
    bullish = F.col("is_low") & (F.col("close") < F.col("low.close")) & (F.col("rsi") > F.col("low.rsi"))
    bearish = F.col("is_high") & (F.col("close") > F.col("high.close")) & (F.col("rsi") < F.col("high.rsi"))
    kind = F.when(bullish, "bullish").when(bearish, "bearish")
    return rows.where((F.col("i") >= half) & (F.col("i") < F.col("n") - half)).withColumn("divergence", kind).where("divergence is not null").select("symbol", "ts", "close", "rsi", "divergence")


def ema_cross(rows: DataFrame, fast: str = "fast", slow: str = "slow") -> DataFrame:
    """Crosses of two columns: up when strictly above after not being; down when no longer above."""
    rows = rows.dropna(subset=[fast, slow]).withColumn("above", F.col(fast) > F.col(slow))
    return rows.withColumn("before", F.lag("above").over(by_time())).where("above <> before").select("symbol", "ts", fast, slow, F.when(F.col("above"), "cross_up").otherwise("cross_down").alias("cross"))


def ema_order(rows: DataFrame, columns: tuple[str, ...] = ("ema7", "ema25", "ema50", "ema200")) -> DataFrame:
    """Of each symbol's last row: whether the averages stand in falling (golden) or rising (death) order."""
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("ts", *columns), "ts").alias("r")).select("symbol", "r.*")
    pairs = list(zip(columns, columns[1:], strict=False))
    every = lambda f: F.coalesce(F.forall(F.array(*[f(F.col(a), F.col(b)) for a, b in pairs]), lambda x: x), F.lit(False))
    return last.select("symbol", "ts", every(lambda a, b: a > b).alias("golden"), every(lambda a, b: a < b).alias("death"))


def swing_candidates(bars: DataFrame, w: int = 2) -> DataFrame:
    """Rows whose high (low) is the extreme of the frame of w rows to both sides, and not of a flat frame."""
    high, low = F.max("high").over(frame(-w, w)), F.min("low").over(frame(-w, w))
    rows = bars.select("symbol", "ts", "high", "low", (F.row_number().over(by_time()) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    rows = rows.withColumns({"is_high": (F.col("high") == high) & (F.col("high") > F.min("high").over(frame(-w, w))), "is_low": (F.col("low") == low) & (F.col("low") < F.max("low").over(frame(-w, w)))})
    return rows.where((F.col("i") >= w) & (F.col("i") < F.col("n") - w) & (F.col("is_high") | F.col("is_low"))).select("symbol", "ts", "i", "is_high", "is_low", "high", "low")


def local_extremes(bars: DataFrame) -> DataFrame:
    """Strict extremes of close against both neighbours."""
    before, after = F.lag("close").over(by_time()), F.lead("close").over(by_time())
    rows = bars.withColumn("kind", F.when((F.col("close") < before) & (F.col("close") < after), "low").when((F.col("close") > before) & (F.col("close") > after), "high"))
    return rows.where("kind is not null").select("symbol", "ts", "close", "kind")


def strict_swings(bars: DataFrame, w: int = 2) -> DataFrame:
    """Swing candidates that are an extreme of one side only."""
    return swing_candidates(bars, w).where("is_high <> is_low").select("symbol", "ts", "i", F.when(F.col("is_high"), "high").otherwise("low").alias("kind"), F.when(F.col("is_high"), F.col("high")).otherwise(F.col("low")).alias("price"))


def volume_ratio(bars: DataFrame) -> DataFrame:
    """Last volume over the mean of the up to 19 before it; 1 where there are fewer than 5 bars or no volume before."""
    rows = bars.select("symbol", "ts", "volume", F.avg("volume").over(frame(-19, -1)).alias("mean"), F.row_number().over(by_time()).alias("n"))
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("volume", "mean", "n"), "ts").alias("r"))
    return last.select("symbol", F.when((F.col("r.n") >= 5) & (F.col("r.mean") > 0), F.col("r.volume") / F.nullif(F.col("r.mean"), F.lit(0.0))).otherwise(1.0).alias("volume_ratio"))


def momentum_pct(bars: DataFrame, n: int = 14) -> DataFrame:
    """Change of close over the last n bars, or as many as there are, in percent; 0 for a single bar."""
    rows = bars.select("symbol", "ts", "close", F.coalesce(F.lag("close", n).over(by_time()), F.first("close").over(running())).alias("before"))
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("close", "before"), "ts").alias("r"))
    return last.select("symbol", F.coalesce(ratio((F.col("r.close") - F.col("r.before")) * 100, F.col("r.before")), F.lit(0.0)).alias("momentum_pct"))


def gap_sessions(bars: DataFrame, hours: int = 4) -> DataFrame:
    """Number of each row's session; a gap of more than so many hours begins a new one."""
    new = (F.col("ts") - F.lag("ts").over(by_time()) > F.expr(f"interval {hours} hours")).cast("int")
    return bars.withColumn("_new", F.coalesce(new, F.lit(1))).select("symbol", "ts", F.sum("_new").over(running()).cast("long").alias("session"))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Bars between whose neighbours price has left a gap."""
    up, down = F.lead("low").over(by_time()) > F.lag("high").over(by_time()), F.lead("high").over(by_time()) < F.lag("low").over(by_time())
    rows = bars.select("symbol", "ts", F.coalesce(up, F.lit(False)).alias("bullish"), F.coalesce(down, F.lit(False)).alias("bearish"))
    return rows.where("bullish or bearish")


def pivot_points(bars: DataFrame) -> DataFrame:
    """Classic pivots of each symbol's last bar."""
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("high", "low", "close"), "ts").alias("b")).select("symbol", "b.*")
    return last.withColumn("pp", typical()).select("symbol", "pp", *pivot_levels("pp", "high", "low"))


def pivot_levels(pp: str, high: str, low: str) -> list[Column]:
    p, h, x = F.col(pp), F.col(high), F.col(low)
    return [(2 * p - x).alias("r1"), (2 * p - h).alias("s1"), (p + (h - x)).alias("r2"), (p - (h - x)).alias("s2")]
