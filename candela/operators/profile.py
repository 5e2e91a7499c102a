"""Volume profile and time-price chart.

Bars are not held against all bins: a bar is exploded to the bins that its range can touch, found by arithmetic, and
each candidate is re-checked on the exact edges. So the work is the number of touched cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recurrence import atr_frame

# Quantiles of high and low volume nodes; limits of a chart; default markers.
HIGH_NODE, LOW_NODE = 0.8, 0.2
MOST_PERIODS, MOST_ROWS, MOST_CELLS = 1000, 10_000, 1_000_000
MARKERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def value_area(weights: np.ndarray, poc: int, share: float) -> tuple[int, int]:
    """Bounds that grow from poc to the heavier neighbour, to the left at a tie, until they hold the share."""
    total, lo, hi = float(weights.sum()), poc, poc
    if total == 0:
        return 0, len(weights) - 1
    held = float(weights[poc])
    while held < total * share and (lo > 0 or hi < len(weights) - 1):
        left = weights[lo - 1] if lo > 0 else -np.inf
        right = weights[hi + 1] if hi < len(weights) - 1 else -np.inf
        if left >= right:
            lo -= 1
            held += float(left)
        else:
            hi += 1
            held += float(right)
    return lo, hi


def profile_shape(v: np.ndarray, poc: int) -> str:
    n, total = len(v), float(v.sum())
    if n == 1:
        return "single"
    if n == 0 or total == 0:
        return "flat"
    if v.max() / total > 0.8:
        return "single"
    if np.var(v / v.max(), ddof=1) < 0.05:
        return "flat"
    peaks = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    if n >= 4 and len(peaks) >= 2 and peaks[-1] - peaks[0] >= 0.3 * n:
        return "bimodal"
    left, right, place = float(v[:poc].sum()), float(v[poc + 1 :].sum()), poc / (n - 1)
    return "directional" if (place < 0.3 and left > 2 * right) or (place > 0.7 and right > 2 * left) else "bell"


def _decimal(x: Column) -> Column:
    """The decimal that a double is written as; narrow enough that its products with counts lose no digits."""
    return x.cast("string").cast("decimal(28,18)")


def _stepped(low: Column, high: Column, width: Column, to_end: bool) -> Column:
    """Edges low, low + width, ... in decimals; the last is `high` itself, or one more step beyond it."""
    steps = F.floor((_decimal(high) - _decimal(low)) / _decimal(width)).cast("int")
    edges = F.transform(F.sequence(F.lit(0), steps), lambda k: (_decimal(low) + _decimal(width) * k.cast("decimal(8,0)")).cast("double"))
    last = F.element_at(edges, -1)
    more = F.array(high) if to_end else F.array((_decimal(last) + _decimal(width)).cast("double"))
    return F.when(low == high, F.array(low, high)).when(last < high, F.concat(edges, more)).otherwise(edges)


def _touched(bars: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each bar and bin that it touches: symbol, ts, low, high, volume, bin, bin_low, bin_high.

    edges: symbol, edges (array), first, width. A bar without range belongs to the first bin that holds its price.
    """
    rows = bars.join(edges, "symbol")
    n = F.size("edges") - 1
    at = lambda p: F.when(F.col("width") > 0, F.floor((p - F.col("first")) / F.nullif("width", F.lit(0.0)))).otherwise(0).cast("int")
    bins = F.sequence(F.greatest(at(F.col("low")) - 1, F.lit(0)), F.greatest(F.least(at(F.col("high")) + 1, n - 1), F.lit(0)))
    cells = F.transform(bins, lambda j: F.struct(j.alias("bin"), F.get("edges", j).alias("bin_low"), F.get("edges", j + 1).alias("bin_high")))
    point = F.col("low") == F.col("high")
    holding = F.slice(F.filter(cells, lambda c: (c["bin_low"] <= F.col("low")) & (F.col("low") <= c["bin_high"])), 1, 1)
    crossing = F.filter(cells, lambda c: (c["bin_low"] < F.col("high")) & (c["bin_high"] > F.col("low")))
    return rows.select("symbol", "ts", "low", "high", "volume", F.explode(F.when(point, holding).otherwise(crossing)).alias("c")).select("symbol", "ts", "low", "high", "volume", "c.*")


def _spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.max_by("close", "ts").alias("close"))


def profile_edges(bars: DataFrame, bins: int = 100, mode: str = "fixed", atr_period: int = 14, atr_mult: float = 1.0, range_pct: float | None = None) -> DataFrame:
    """symbol, edges, first, width: equal bins over the range, or steps by the average true range or a share of the price."""
    spans = _spans(bars)
    if mode == "fixed":
        if not 1 <= bins <= 500:
            raise ValueError("bins must be 1 to 500")
        width = (F.col("last") - F.col("first")) / bins
        edges = F.when(F.col("first") == F.col("last"), F.array("first", "last")).otherwise(F.concat(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.col("first") + k * width), F.array("last")))
        return spans.select("symbol", edges.alias("edges"), "first", width.alias("width"))
    if mode == "atr":
        last = atr_frame(bars, atr_period).dropna(subset=["atr"]).groupBy("symbol").agg(F.max_by("atr", "ts").alias("atr"))
        whole = bars.groupBy("symbol").agg((F.max("close") - F.min("close")).alias("closes"))
        spans = spans.join(whole, "symbol").join(last, "symbol", "left")
        width = F.coalesce(F.col("atr") * atr_mult, F.col("closes"))
    elif mode == "pct" and range_pct and range_pct > 0:
        width = F.col("close") * range_pct
    else:
        raise ValueError("mode is fixed, atr, or pct with a range_pct above 0")
    whole = F.when(F.col("last") > F.col("first"), F.col("last") - F.col("first")).otherwise(1.0)
    spans = spans.withColumn("width", F.when(width > 0, width).otherwise(whole))
    return spans.select("symbol", _stepped(F.col("first"), F.col("last"), F.col("width"), True).alias("edges"), "first", "width")


def _summed(bars: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol, bin, bin_low, bin_high, volume, candles for every bin, touched or not.

    Volumes are rounded to nine places, so that ties do not turn on the order of addition.
    """
    part = F.when(F.col("low") == F.col("high"), 1.0).otherwise((F.least("high", "bin_high") - F.greatest("low", "bin_low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    cells = _touched(bars, edges).groupBy("symbol", "bin").agg(F.round(F.sum(F.when(F.col("volume") > 0, F.col("volume") * part).otherwise(0.0)), 9).alias("volume"), F.count("*").alias("candles"))
    bins = edges.select("symbol", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("bin", "bin_low"), "edges")
    bins = bins.select("symbol", "bin", "bin_low", F.get("edges", F.col("bin") + 1).alias("bin_high"))
    return bins.join(cells, ["symbol", "bin"], "left").fillna({"volume": 0.0, "candles": 0})


def _with_area(cells: DataFrame, weight: str, share: float) -> DataFrame:
    """Adds poc, area_low and area_high (bins) and shape, by one group-map over the bins of a symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        v = pdf["weight"].to_numpy(dtype=float)
        poc = int(v.argmax())
        lo, hi = value_area(v, poc, share)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "poc": [poc], "area_low": [lo], "area_high": [hi], "shape": [profile_shape(v, poc)], "total": [float(v.sum())]})

    found = cells.select("symbol", "bin", F.col(weight).cast("double").alias("weight")).groupBy("symbol").applyInPandas(run, "symbol string, poc long, area_low long, area_high long, shape string, total double")
    return cells.join(found, "symbol")


def volume_profile(bars: DataFrame, share: float = 0.7, **edges) -> DataFrame:
    """Rows of bins with volume, candles, high and low volume nodes, and whether they are in the value area."""
    cells = _with_area(_summed(bars, profile_edges(bars, **edges)), "volume", share)
    w = Window.partitionBy("symbol")
    cells = cells.withColumns({"high_cut": F.percentile("volume", HIGH_NODE).over(w), "low_cut": F.percentile("volume", LOW_NODE).over(w)})
    some = F.col("total") > 0
    return cells.select(
        "symbol", F.col("bin").cast("long").alias("bin"), "bin_low", "bin_high", ((F.col("bin_low") + F.col("bin_high")) / 2).alias("bin_mid"), "volume", F.col("candles").cast("long").alias("candles"),
        (some & (F.col("volume") >= F.col("high_cut"))).alias("is_hvn"), (some & (F.col("volume") <= F.col("low_cut"))).alias("is_lvn"), F.col("bin").between(F.col("area_low"), F.col("area_high")).alias("in_value_area"), "poc", "shape",
    )


def volume_profile_summary(bars: DataFrame, share: float = 0.7, **edges) -> DataFrame:
    """One row a symbol: point of control, value area, shape, bins and total volume."""
    rows = volume_profile(bars, share, **edges)
    area = F.col("in_value_area")
    return rows.groupBy("symbol").agg(
        F.max(F.when(F.col("bin") == F.col("poc"), F.col("bin_mid"))).alias("poc_price"), F.first("poc").alias("poc_bin"), F.max(F.when(area, F.col("bin_high"))).alias("vah_price"), F.min(F.when(area, F.col("bin_low"))).alias("val_price"),
        F.first("shape").alias("shape"), F.count("*").alias("bins"), F.sum("volume").alias("total_volume"),
    )


def _charts(bars: DataFrame, row_size: float, markers: int) -> DataFrame:
    """symbol, edges, first, width of its chart, and the reason why it is refused."""
    width = F.lit(float(row_size))
    spans = bars.groupBy("symbol").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("n"))
    rows = spans.withColumn("rows", F.ceil((F.col("last") - F.col("first")) / width))  # an estimate, so that no huge array is made
    too_many = F.when(F.col("n") > MOST_PERIODS, "too_many_periods").when(F.col("n") > markers, "more_periods_than_markers").when(F.col("rows") > MOST_ROWS + 1, "too_many_rows")
    rows = rows.withColumn("reason", too_many).withColumn("edges", F.when(F.col("reason").isNull(), _stepped(F.col("first"), F.col("last"), width, False)))
    size = F.size("edges") - 1
    late = F.when(F.col("edges").isNotNull() & (size > MOST_ROWS), "too_many_rows").when(F.col("edges").isNotNull() & (F.col("n") * size > MOST_CELLS), "too_many_cells")
    return rows.withColumn("width", width).withColumn("reason", F.coalesce("reason", late))


def tpo_refused(bars: DataFrame, row_size: float, markers: str | list[str] = MARKERS) -> DataFrame:
    """symbol and reason, for the symbols that are beyond the limits of a chart."""
    return _charts(bars, row_size, len(markers)).where("reason is not null").select("symbol", "reason")


def tpo_chart(bars: DataFrame, row_size: float, share: float = 0.7, markers: str | list[str] = MARKERS) -> DataFrame:
    """Rows of a time-price chart: which periods touch each row, and whether it is in the value area.

    Symbols with more periods than markers, or beyond the limits of a chart, give no rows; `tpo_refused` names them.
    """
    if row_size <= 0:
        raise ValueError("row_size must be above 0")
    marks = [str(m) for m in markers]
    if len(set(marks)) != len(marks) or "" in marks:
        raise ValueError("markers must be unique and not empty")
    judged = _charts(bars, row_size, len(marks))
    edges = judged.where("reason is null").select("symbol", "edges", "first", "width")
    numbered = bars.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    cells = _touched(numbered.select("symbol", "ts", "low", "high", F.col("i").cast("double").alias("volume")), edges)
    marked = cells.groupBy("symbol", "bin").agg(F.countDistinct("ts").alias("tpo_count"), F.sort_array(F.collect_list(F.col("volume").cast("int"))).alias("periods"))
    rows = edges.select("symbol", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("bin", "bin_low"), "edges").select("symbol", "bin", "bin_low", F.get("edges", F.col("bin") + 1).alias("bin_high"))
    rows = _with_area(rows.join(marked, ["symbol", "bin"], "left").fillna({"tpo_count": 0}), "tpo_count", share)
    signs = F.array(*[F.lit(m) for m in marks])
    return rows.select(
        "symbol", F.col("bin").cast("long").alias("row"), F.col("bin_low").alias("row_low"), F.col("bin_high").alias("row_high"), ((F.col("bin_low") + F.col("bin_high")) / 2).alias("row_mid"), "tpo_count",
        F.array_join(F.transform(F.coalesce("periods", F.array().cast("array<int>")), lambda i: F.get(signs, i - 1)), "").alias("markers"), F.col("bin").between(F.col("area_low"), F.col("area_high")).alias("in_value_area"), "poc",
    )


def initial_balance(bars: DataFrame) -> DataFrame:
    """The first bar's range of each symbol, and whether later bars went beyond it."""
    first = bars.groupBy("symbol").agg(F.min_by(F.struct("high", "low"), "ts").alias("b"), F.max("high").alias("high"), F.min("low").alias("low"))
    return first.select("symbol", F.col("b.low").alias("ib_low"), F.col("b.high").alias("ib_high"), (F.col("high") > F.col("b.high")).alias("expanded_up"), (F.col("low") < F.col("b.low")).alias("expanded_down"))
