"""Swings, market structure, price ranges, breakouts, their summary, and Elliott waves.

The confirmation of swings is a state machine, and runs as one Arrow group-map a symbol, as does the search for breakouts.
What else follows from swings is windows, arrays of a bounded length, and joins on the symbol and a bucket of bars. Names
of columns, classes, regimes and reasons are fixed values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SWINGS
from ..session import checkpointed
from .recurrence import adx as adx_kernel
from .recurrence import by_symbol


def find_candidates(high: np.ndarray, low: np.ndarray, w: int) -> list[tuple[int, str, float]]:
    """(row, kind, price) of the extremes of the frames of w rows to both sides; a low comes before a high."""
    out = []
    for i in range(w, len(high) - w):
        h, x = high[i - w : i + w + 1], low[i - w : i + w + 1]
        if low[i] == x.min() and low[i] < x.max():
            out.append((i, "low", float(low[i])))
        if high[i] == h.max() and high[i] > h.min():
            out.append((i, "high", float(high[i])))
    return out


def confirm(candidates: list[tuple[int, str, float]], close: np.ndarray, w: int, least: float) -> list[dict]:
    """Alternating swings: one of the same kind replaces the last if more extreme; another kind must move by `least`."""
    out: list[dict] = []
    for i, kind, price in candidates:
        if not out:
            start = max(0, i - w)
            out.append({"i": i, "kind": kind, "price": price, "from": start, "from_price": float(close[start])})
        elif out[-1]["kind"] == kind:
            if price >= out[-1]["price"] if kind == "high" else price <= out[-1]["price"]:
                out[-1] |= {"i": i, "price": price}
        else:
            last = out[-1]["price"]
            if abs(price - last) / (abs(last) if last else 1.0) >= least:
                out.append({"i": i, "kind": kind, "price": price, "from": out[-1]["i"], "from_price": last})
    return out


def swings(bars: DataFrame, w: int = 2, min_pct: float = 0.02) -> DataFrame:
    """Confirmed swings, numbered within the symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        high, low, close, ts = (pdf[c].to_numpy() for c in ("high", "low", "close", "ts"))
        found = confirm(find_candidates(high, low, w), close, w, min_pct)
        price, start = np.array([s["price"] for s in found]), np.array([s["from_price"] for s in found])
        at, begin = np.array([s["i"] for s in found], dtype=int), np.array([s["from"] for s in found], dtype=int)
        delta = price - start
        return pd.DataFrame(
            {
                "symbol": [pdf["symbol"].iloc[0]] * len(found), "swing_id": np.arange(1, len(found) + 1), "pivot_index": at, "swing_type": [s["kind"] for s in found], "pivot_ts": ts[at], "pivot_price": price,
                "leg_start_ts": ts[begin], "leg_start_price": start, "leg_end_ts": ts[at], "leg_end_price": price, "price_delta": delta, "pct_delta": np.abs(delta) / np.where(start == 0, 1.0, np.abs(start)),
            }
        )

    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(run, SWINGS)


def market_structure(found: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Each swing against the one before of its type, and the trend that the latest pair of classes tells."""
    w = Window.partitionBy("symbol", "swing_type").orderBy("swing_id")
    rows = found.withColumns({"reference_swing_id": F.lag("swing_id").over(w), "reference_price": F.lag("pivot_price").over(w)}).where("reference_price is not null")
    delta = F.col("pivot_price") - F.col("reference_price")
    same = F.abs(delta) <= epsilon
    high = F.when(same, "EH").when(delta > 0, "HH").otherwise("LH")
    low = F.when(same, "EL").when(delta < 0, "LL").otherwise("HL")
    rows = rows.withColumn("classification", F.when(F.col("swing_type") == "high", high).otherwise(low))
    order = Window.partitionBy("symbol").orderBy("swing_id")
    latest = lambda kind: F.last(F.when(F.col("swing_type") == kind, F.col("classification")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    h, x = latest("high"), latest("low")
    trend = (
        F.when(h.isNull() | x.isNull(), "transition").when(h.isin("HH", "EH") & (x == "HL"), "bullish").when((h == "LH") & x.isin("LL", "EL"), "bearish").when((h == "LH") & (x == "HL"), "transition").otherwise("range")
    )
    return rows.select(
        "symbol", F.row_number().over(order).cast("long").alias("event_id"), F.col("pivot_ts").alias("event_ts"), "swing_id", "swing_type", "classification", "reference_swing_id", "reference_price",
        F.col("pivot_price").alias("current_price"), delta.alias("price_delta"), F.when(F.col("reference_price") == 0, 0.0).otherwise(F.abs(delta) / F.nullif(F.abs("reference_price"), F.lit(0.0))).alias("pct_delta"), trend.alias("trend_state"),
    )


#: Bars in a bucket, in which bars meet the ranges that cover them.
BUCKET = 256


def _between_highs(found: DataFrame, lookback: int) -> DataFrame:
    """Each swing high with an array of itself and the lookback - 1 highs after it.

    An entry holds the high, and the lows from its bar on to the next high's, and those at its bar alone. No join: lows
    find their high by the running number of highs.
    """
    order = Window.partitionBy("symbol").orderBy("pivot_index", "swing_type").rowsBetween(Window.unboundedPreceding, 0)  # a high comes before a low
    high = F.col("swing_type") == "high"
    rows = found.where(F.col("swing_type").isin("high", "low")).withColumn("k", F.count_if(high).over(order)).where("k > 0")
    steps = rows.groupBy("symbol", "k").agg(
        F.min(F.when(high, F.struct("pivot_ts", "pivot_price", "pivot_index"))).alias("h"),
        F.min(F.when(~high, F.struct("pivot_index", "pivot_price"))).alias("first"),
        F.min(F.when(~high, F.col("pivot_price"))).alias("least"),
        F.count_if(~high).alias("lows"),
    )
    at_once = F.col("first.pivot_index") == F.col("h.pivot_index")  # one low at most stands at a bar
    entry = F.struct(F.col("h.pivot_ts").alias("at"), F.col("h.pivot_price").alias("price"), "least", "lows", F.when(at_once, F.col("first.pivot_price")).alias("own"), F.coalesce(at_once, F.lit(False)).cast("long").alias("owns"))
    after = Window.partitionBy("symbol").orderBy("k").rowsBetween(0, lookback - 1)
    return steps.select("symbol", F.collect_list(entry).over(after).alias("e"))


def price_ranges(bars: DataFrame, found: DataFrame, lookback: int = 20, max_pct: float = 0.03, containment: float = 0.8, buffer_pct: float = 0.001) -> DataFrame:
    """Ranges between two swing highs at most `lookback` highs apart, with two lows or more between, that hold the closes.

    Pairs come from arrays of at most `lookback` highs. Closes meet ranges within buckets of BUCKET bars, so the cost is that
    of the ranges' own bars. A symbol without swings has no range.
    """
    pairs = _between_highs(found, lookback).where(F.size("e") > 1).select("symbol", "e", F.explode(F.sequence(F.lit(2), F.size("e"))).alias("n"))
    part = F.slice("e", F.lit(1), F.col("n") - 1)
    end = F.get("e", F.col("n") - 1)
    least = F.array_min(F.concat(F.transform(part, lambda x: x["least"]), F.array(end["own"])))
    lows = F.aggregate(part, end["owns"], lambda a, x: a + x["lows"])
    held = pairs.select("symbol", F.get("e", F.lit(0))["at"].alias("start_ts"), end["at"].alias("end_ts"), F.array_max(F.transform(F.slice("e", F.lit(1), F.col("n")), lambda x: x["price"])).alias("range_high"), least.alias("range_low"), lows.alias("lows"))
    held = held.where("lows >= 2").withColumn("range_mid", (F.col("range_high") + F.col("range_low")) / 2).withColumn("range_width", F.col("range_high") - F.col("range_low"))
    held = held.withColumn("range_width_pct", F.when(F.col("range_mid") == 0, 0.0).otherwise(F.col("range_width") / F.nullif("range_mid", F.lit(0.0)))).where(F.col("range_width_pct") <= max_pct)
    held = held.withColumns({"top": F.col("range_high") - F.col("range_width") * buffer_pct, "bottom": F.col("range_low") + F.col("range_width") * buffer_pct})
    numbered = bars.select("symbol", "ts", "close", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).alias("i"))
    # swings stand at bars, whose numbers are found by their times
    at = lambda name, i: numbered.select("symbol", F.col("ts").alias(name), F.col("i").alias(i))
    held = held.join(at("start_ts", "start_i"), ["symbol", "start_ts"]).join(at("end_ts", "end_i"), ["symbol", "end_ts"])
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    spread = held.withColumn("bucket", F.explode(F.sequence(bucket("start_i"), bucket("end_i"))))
    inside = spread.join(numbered.withColumn("bucket", bucket("i")), ["symbol", "bucket"]).where(F.col("i").between(F.col("start_i"), F.col("end_i")))
    keys = ["symbol", "start_ts", "end_ts", "range_high", "range_low", "range_mid", "range_width", "range_width_pct", "top", "bottom"]
    summed = inside.groupBy(*keys).agg(F.count("*").alias("bars_evaluated"), F.avg(F.when(F.col("close").between(F.col("bottom"), F.col("top")), 1.0).otherwise(0.0)).alias("contained"), F.max_by("close", "ts").alias("last_close"))
    kept = summed.where(F.col("contained") + 1e-9 >= containment)
    status = F.when(F.col("last_close") > F.col("top"), "broken_up").when(F.col("last_close") < F.col("bottom"), "broken_down").otherwise("active")
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("start_ts", "end_ts", "range_high", "range_low")).cast("long")
    return kept.select("symbol", number.alias("range_id"), "start_ts", "end_ts", "range_high", "range_low", "range_mid", "range_width", "range_width_pct", "bars_evaluated", F.round("contained", 4).alias("containment_ratio"), status.alias("status"))


def first_above(values: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each start, the first place from there on whose value exceeds the bound; the number of values if none does.

    Maxima of stretches of doubling lengths let each search skip forward, so it takes logarithmic time.
    """
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
    at = np.minimum(start, len(values)).astype(np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(at + (1 << k) <= len(values))
        skip = fits[levels[k][at[fits]] <= bound[fits]]
        at[skip] += 1 << k
    return at


def range_breakouts(bars: DataFrame, ranges: DataFrame, confirm_bars: int = 1, buffer_pct: float = 0.001) -> DataFrame:
    """The first run of closes beyond a boundary from the range's end on; the earlier side, up at a tie.

    Bars and ranges of a symbol meet in one group, in which each range takes two searches of logarithmic time.
    """

    def run(bars_of: pd.DataFrame, ranges_of: pd.DataFrame) -> pd.DataFrame:
        bars_of, ranges_of = bars_of.sort_values("ts", kind="stable"), ranges_of.sort_values("range_id", kind="stable")
        close, ts = bars_of["close"].to_numpy(dtype=float), bars_of["ts"].to_numpy()
        n = max(0, len(close) - confirm_bars + 1)
        runs = np.lib.stride_tricks.sliding_window_view(close, confirm_bars) if n else np.empty((0, confirm_bars))
        low, high = runs.min(axis=1), runs.max(axis=1)
        top, bottom = (ranges_of[c].to_numpy(dtype=float) for c in ("range_high", "range_low"))
        start, buffer = np.searchsorted(ts, ranges_of["end_ts"].to_numpy()), (top - bottom) * buffer_pct
        up, down = first_above(low, start, top + buffer), first_above(-high, start, buffer - bottom)
        at, kept = np.minimum(up, down), np.flatnonzero(np.minimum(up, down) < n)
        rose, at = up[kept] <= down[kept], at[kept]
        edge = np.where(rose, top[kept], bottom[kept])
        distance = np.where(rose, close[at] - edge, edge - close[at])
        return pd.DataFrame(
            {
                "symbol": ranges_of["symbol"].to_numpy()[kept], "breakout_id": np.arange(1, len(kept) + 1), "range_id": ranges_of["range_id"].to_numpy()[kept], "breakout_ts": ts[at], "direction": np.where(rose, "up", "down"),
                "breakout_price": close[at], "boundary_price": edge, "distance": distance, "distance_pct": np.divide(distance, edge, out=np.zeros(len(edge)), where=edge != 0), "confirm_bars": np.full(len(kept), confirm_bars),
            }
        )

    schema = "symbol string, breakout_id long, range_id long, breakout_ts timestamp_ntz, direction string, breakout_price double, boundary_price double, distance double, distance_pct double, confirm_bars long"
    given = ranges.select("symbol", "range_id", "range_high", "range_low", "end_ts")
    return bars.select("symbol", "ts", "close").groupBy("symbol").cogroup(given.groupBy("symbol")).applyInPandas(run, schema)


def structure_summary(
    bars: DataFrame, w: int = 2, min_pct: float = 0.02, lookback: int = 20, max_pct: float = 0.03, containment: float = 0.8, buffer_pct: float = 0.001, confirm_bars: int = 1, breakout_buffer_pct: float = 0.001,
    adx_period: int = 14, recent_bars: int = 3, trending_adx: float = 25.0, ranging_adx: float = 20.0, di_spread: float = 2.0,
) -> DataFrame:
    """One row a symbol: latest structure, range and breakout, trend strength, and the regime they tell, with confidence."""
    least = max(2 * adx_period, lookback, 2 * w + 3)
    bars = checkpointed(bars)  # swings, ranges, breakouts and trend each read them
    order = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "_i": F.row_number().over(order)}).where(F.col("_n") >= least)
    last = rows.groupBy("symbol").agg(F.max("ts").alias("summary_ts"), F.max_by("close", "ts").alias("current_price"), F.max("_i").alias("n"))
    found = swings(rows.drop("_n", "_i"), w, min_pct)
    shape = market_structure(found)
    ranges = price_ranges(rows.select("symbol", "ts", "close"), found, lookback, max_pct, containment, buffer_pct)
    trend = by_symbol(rows, ("high", "low", "close"), lambda h, x, c: adx_kernel(h, x, c, adx_period), "adx double, plus_di double, minus_di double", 2 * adx_period)
    trend = trend.groupBy("symbol").agg(F.max_by(F.struct("adx", "plus_di", "minus_di"), "ts").alias("t")).select("symbol", "t.*")
    shape = shape.groupBy("symbol").agg(F.max_by(F.struct("classification", "trend_state", "event_ts"), F.struct("event_ts", "event_id")).alias("s")).select("symbol", "s.*")
    latest = ranges.groupBy("symbol").agg(F.max_by(F.struct("range_id", "range_high", "range_low", "range_mid", "range_width_pct", "containment_ratio", "status", "end_ts"), F.struct("end_ts", "range_id")).alias("r")).select("symbol", "r.*")
    # only the latest range's breakout is looked for
    breaks = range_breakouts(rows.select("symbol", "ts", "close"), latest, confirm_bars, breakout_buffer_pct)
    broken = breaks.join(rows.select("symbol", F.col("ts").alias("breakout_ts"), F.col("_i").alias("breakout_i")), ["symbol", "breakout_ts"])
    broken = broken.select("symbol", "direction", "breakout_ts", "breakout_price", F.col("distance_pct").alias("breakout_distance_pct"), "breakout_i")
    all_ = last.join(shape, "symbol", "left").join(latest, "symbol", "left").join(broken, "symbol", "left").join(trend, "symbol", "left")
    recent = F.coalesce((F.col("n") - F.col("breakout_i")) <= recent_bars, F.lit(False))
    spread = F.abs(F.col("plus_di") - F.col("minus_di"))
    strong = (F.col("adx") >= trending_adx) & (spread >= di_spread)
    regime = (
        F.when(recent & (F.col("direction") == "up"), "breakout_up")
        .when(recent & (F.col("direction") == "down"), "breakout_down")
        .when((F.col("status") == "active") & (F.col("adx") <= ranging_adx), "ranging")
        .when((F.col("trend_state") == "bullish") & strong & (F.col("plus_di") > F.col("minus_di")), "trending_up")
        .when((F.col("trend_state") == "bearish") & strong & (F.col("minus_di") > F.col("plus_di")), "trending_down")
        .otherwise("transition")
    )
    all_ = all_.withColumn("regime", regime)
    confidence = (
        F.when(F.col("regime").startswith("breakout"), F.when(F.col("breakout_distance_pct") >= 0.003, 0.85).otherwise(0.75))
        .when(F.col("regime") == "ranging", 0.70)
        .when(F.col("regime").startswith("trending"), F.when(spread >= 5, 0.80).otherwise(0.70))
        .otherwise(0.40)
    )
    return all_.select(
        "symbol", "summary_ts", "current_price", "regime", confidence.alias("confidence"), "trend_state", "classification", "adx", "plus_di", "minus_di", "range_id", "range_high", "range_low", "range_mid", "range_width_pct",
        "containment_ratio", F.col("status").alias("range_status"), F.col("direction").alias("breakout_direction"), "breakout_ts", "breakout_price", "breakout_distance_pct", recent.alias("breakout_recent"),
    )


def _degree(delta: Column, legs: list[Column], thresholds: tuple[float, float]) -> Column:
    """By the wave's size over the mean of the legs before it; the first wave by its size itself."""
    size = F.abs(delta)
    mean = sum(legs[1:], legs[0]) / len(legs) if legs else F.lit(0.0)
    ratio = F.when(mean > 0, size / F.nullif(mean, F.lit(0.0))).otherwise(size)
    return F.when(ratio < thresholds[0], "micro").when(ratio < thresholds[1], "minor").otherwise("intermediate")


def elliott_waves(
    found: DataFrame, wave2: tuple[float, float] = (0.382, 0.786), wave3: float = 1.0, wave4: float = 0.618, wave_b: tuple[float, float] = (0.382, 0.886), wave_c: float = 1.0, thresholds: tuple[float, float] = (0.02, 0.08), include_rejected: bool = True,
) -> DataFrame:
    """Impulses of five swings and corrections of three, in both directions, judged by the rules given."""
    order = Window.partitionBy("symbol").orderBy("swing_id")
    fields = {"kind": "swing_type", "price": "pivot_price", "start": "leg_start_price", "start_ts": "leg_start_ts", "end_ts": "pivot_ts"}
    rows = found.select("symbol", "swing_id", "pivot_index", *[F.lead(c, k).over(order).alias(f"{n}{k + 1}") for k in range(5) for n, c in fields.items()])
    p, s, kind = ({k: F.col(f"{n}{k}") for k in range(1, 6)} for n in ("price", "start", "kind"))
    share = lambda x, of: F.when(of > 0, x / F.nullif(of, F.lit(0.0))).otherwise(0.0)
    none, no = F.lit(None).cast("double"), F.lit(False)
    parts = []
    for direction, kinds in (("bullish", "high low high low high"), ("bearish", "low high low high low")):
        up = direction == "bullish"
        sign = 1 if up else -1
        w = [F.abs(p[k] - s[k]) for k in range(1, 6)]
        r2, e3, r4, e5 = share(F.abs(p[2] - p[1]), w[0]), share(sign * (p[3] - p[1]), w[0]), share(F.abs(p[4] - p[3]), w[2]), share(F.abs(p[5] - p[4]), w[3])
        overlap, broken = (sign * (p[4] - p[1])) <= 0, (sign * (p[5] - p[4])) <= 0
        text = lambda name, x, tail: F.concat(F.lit(name), F.format_string("%.3f", x), F.lit(tail))
        ok = [F.lit(True), r2.between(*wave2), e3 >= wave3, r4 <= wave4, F.lit(True)]
        why = [
            F.lit(None).cast("string"), F.when(~ok[1], text("wave2_retrace_", r2, "_not_in_band")), F.when(~ok[2], text("wave3_extension_", e3, "_below_min")),
            F.when(overlap, "wave4_overlap_violation").when(~ok[3], text("wave4_retrace_", r4, "_exceeds_max")), F.when(broken, "wave5_invalidation_violation"),
        ]
        five = [("1", none, none, no, no), ("2", r2, none, no, no), ("3", none, e3, no, no), ("4", r4, none, overlap, no), ("5", none, e5, no, broken)]
        parts.append((rows, "impulse", direction, kinds.split(), five, ok, why, w))
        rb, ec = share(F.abs(p[2] - p[1]), w[0]), share(F.abs(p[3] - p[2]), w[0])
        over = (p[3] >= s[1]) if up else (p[3] <= s[1])
        ok3 = [F.lit(True), rb.between(*wave_b), ec >= wave_c]
        why3 = [F.lit(None).cast("string"), F.when(~ok3[1], text("waveb_retrace_", rb, "_not_in_band")), F.when(over, "wavec_overlap_violation").when(~ok3[2], text("wavec_extension_", ec, "_below_min"))]
        three = [("A", none, none, no, no), ("B", rb, none, no, no), ("C", none, ec, over, no)]
        parts.append((rows, "corrective", direction, (["low", "high", "low"] if up else ["high", "low", "high"]), three, ok3, why3, w))
    out = None
    for given, kind_of, direction, kinds, waves, ok, why, legs in parts:
        match = F.lit(True)
        for k, x in enumerate(kinds, 1):
            match = match & (kind[k] == x)
        good = [o & ~v & ~b for o, (_, _, _, v, b) in zip(ok, waves, strict=True)]
        accepted = good[0]
        for g in good[1:]:
            accepted = accepted & g
        structs = [
            F.struct(
                F.lit(label).alias("wave_label"), F.lit(k).cast("long").alias("segment_order"), _degree(p[k] - s[k], legs[: k - 1], thresholds).alias("degree"), F.col(f"start_ts{k}").alias("start_ts"), F.col(f"end_ts{k}").alias("end_ts"), s[k].alias("start_price"), p[k].alias("end_price"),
                (p[k] - s[k]).alias("price_delta"), retrace.alias("retrace_ratio"), extension.alias("extension_ratio"), violated.alias("overlap_violation"), invalid.alias("invalidation_violation"), good[k - 1].alias("is_rule_compliant"), why[k - 1].alias("rejection_reason"),
            )
            for k, (label, retrace, extension, violated, invalid) in enumerate(waves, 1)
        ]
        name = F.concat(F.lit(f"{kind_of}_{direction}_"), F.col("pivot_index").cast("string"))
        part = given.where(match).select("symbol", name.alias("sequence_id"), F.lit(kind_of).alias("sequence_type"), F.lit(direction).alias("direction"), F.explode(F.array(*structs)).alias("w"), accepted.alias("is_accepted_sequence"))
        part = part.select("symbol", "sequence_id", "sequence_type", "direction", "w.*", "is_accepted_sequence")
        out = part if out is None else out.unionByName(part)
    return out if include_rejected else out.where("is_accepted_sequence")
