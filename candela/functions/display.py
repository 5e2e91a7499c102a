"""Texts for display: numbers, percentages, prices, scores, clipped texts, and the first rows with their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What stands for a missing number, bounds of marks, rows shown.
MISSING = "N/A"
GOOD_SCORE, FAIR_SCORE = 70, 40
BULLISH, BEARISH = ("bullish", "positive", "buy"), ("bearish", "negative", "sell")
SHOWN = 10


def number_text(x: Column, places: int = 2, after: str = "") -> Column:
    """x with so many places; N/A for null and numbers that are not finite."""
    value = x.cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.coalesce(F.when(finite, F.format_string(f"%.{places}f{after}", value)), F.lit(MISSING))


def price_text(x: Column) -> Column:
    return number_text(x, 4)


def percent_text(x: Column) -> Column:
    return number_text(x, 2, "%%")


def plain_text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(MISSING))


def hundredths(score: Column) -> Column:
    """A score of 0 to 1, or of 0 to 100, as one of 0 to 100."""
    value = score.cast("double")
    return F.when(value.isNotNull(), F.least(F.greatest(F.when(value > 1, value).otherwise(value * 100), F.lit(0.0)), F.lit(100.0)))


def score_mark(score: Column) -> Column:
    """good, fair or poor, by the score of 0 to 100; empty for null."""
    return F.when(score.isNull(), "").when(score >= GOOD_SCORE, "good").when(score >= FAIR_SCORE, "fair").otherwise("poor")


def mood(polarity: Column) -> Column:
    word = F.lower(polarity)
    return F.when(word.isin(*BULLISH), "bullish").when(word.isin(*BEARISH), "bearish").otherwise("neutral")


def clipped(text: Column, most: int) -> Column:
    """The text, or its start and three points, in at most so many characters."""
    cut = F.substring(text, 1, most) if most <= 3 else F.concat(F.substring(text, 1, most - 3), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def unpinged(text: Column) -> Column:
    """The text with at signs that call nobody, as a space of no width follows them."""
    return F.regexp_replace(text, r"@(?!\u200b)", "@\u200b")


def comparison_lines(compared: DataFrame, most: int = SHOWN) -> DataFrame:
    """symbol, rank, title and line of the best strategies of each symbol, and how many of how many are shown."""
    line = F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), x) for n, x in (("Return", percent_text(F.col("total_return"))), ("Sharpe", number_text(F.col("sharpe_ratio"))), ("Trades", plain_text(F.col("total_trades"))), ("Open", plain_text(F.col("open_position"))))])
    total = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    footer = F.concat(F.lit("Showing top "), F.least(total, F.lit(most)), F.lit(" of "), total, F.lit(" strategies"))
    rows = compared.select("symbol", "rank", F.concat(F.lit("#"), F.col("rank"), F.lit(" "), F.col("strategy")).alias("title"), line.alias("line"), footer.alias("footer"))
    return rows.where(F.col("rank") <= most)
