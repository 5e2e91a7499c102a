"""Sentiment of texts about an instrument: word scores from a lexicon relation, keyword boosts, and summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import valence
from ..functions.symbols import FEED_QUOTES, POST_QUOTES, base_token

# Boosts of keywords in the order in which they claim their place; names of tokens; weights and bounds.
BOOSTS = (("to the moon", 0.15), ("alts are up", 0.15), ("bullish", 0.15), ("moon", 0.15), ("pump", 0.15), ("rugpull", -0.15), ("bearish", -0.15), ("dump", -0.15), ("crash", -0.15), ("rug", -0.15), ("bear", -0.15))
ALIASES = {"BTC": ("bitcoin",), "ETH": ("ethereum",), "DOGE": ("dogecoin",), "SOL": ("solana",), "ADA": ("cardano",), "XRP": ("ripple",), "LTC": ("litecoin",), "BNB": ("binance coin",)}
#: So many of the first boosts are of terms that hold a later one.
_CLAIMING = 1
POST_WEIGHT, FEED_WEIGHT = 0.4, 0.6
BOUND = 0.05


def keyword_boost(text: Column) -> Column:
    """Sum of the boosts of the terms found as whole words, within -1 and 1.

    A term counts once, at its first place that no earlier term has claimed. Terms only overlap where one is a word of
    another, so the claimed places are blanked before the next term is looked for. Expressions are tried on texts alone that
    hold the letters of a term, and the text is lower-cased once.
    """

    def boosted(lower: Column) -> Column:
        total = _boosts(lower, BOOSTS[:_CLAIMING], F.lit(0.0))
        rest = reduce(lambda t, term: F.when(F.contains(t, F.lit(term)), _blank_first(t, rf"(?U)\b{term}\b", term)).otherwise(t), [t for t, _ in BOOSTS[:_CLAIMING]], lower)
        return _bound(rest, lambda t: _boosts(t, BOOSTS[_CLAIMING:], total))

    total = _bound(F.lower(F.coalesce(text, F.lit(""))), boosted)
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(-1.0))


def _boosts(lower: Column, boosts: tuple[tuple[str, float], ...], total: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.contains(lower, F.lit(term)) & lower.rlike(rf"(?U)\b{term}\b"), F.lit(boost)).otherwise(0.0) for term, boost in boosts], total)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """A column of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _blank_first(text: Column, pattern: str, term: str) -> Column:
    """text with its first match replaced by signs that are no part of a word."""
    return F.regexp_replace(text, rf"(?s)^(.*?){pattern}", "$1" + "#" * len(term))


def mentions(text: Column, symbol: str, token: str) -> Column:
    """Whether the symbol, its token, or a name of the token stands in the text, not inside a longer word."""
    terms = dict.fromkeys(t for t in (symbol.lower(), token.lower(), *ALIASES.get(token.upper(), ())) if t)
    lower = F.lower(F.coalesce(text, F.lit("")))
    quote = lambda t: "".join(c if c.isalnum() or c == " " else "\\" + c for c in t)
    return reduce(lambda a, b: a | b, [lower.rlike(f"(?<![a-z0-9]){quote(t)}(?![a-z0-9])") for t in terms])


#: A lexicon of up to so many words goes to each task; a larger one is joined.
MOST_WORDS = 200_000
#: Words of a bucket of the lexicon, in which a word is looked for.
IN_BUCKET = 8
METHODS = ("plain", "rules")


def words_of(text: Column) -> Column:
    """The words of a text in lower case: runs of letters, digits and apostrophes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+"), lambda w: w != "")


def distinct_words(lexicon: DataFrame) -> DataFrame:
    """word in lower case and valence, once each; of several valences of a word the largest. Null words and valences are left out."""
    given = lexicon.select(F.lower("word").alias("word"), F.col("valence").cast("double").alias("valence")).where("word is not null and valence is not null")
    return given.groupBy("word").agg(F.max("valence").alias("valence"))


def plain_scores(sums: Column) -> dict[str, Column]:
    """Shares and compound from the sums s (valences), p and m (weights of words above and below 0) and z (other words)."""
    s, p, m, z = (sums[k] for k in ("s", "p", "m", "z"))
    whole = F.nullif(p + m + z, F.lit(0.0))
    share = lambda x: F.round(F.coalesce(x / whole, F.lit(0.0)), 4)
    return {"pos": share(p), "neu": share(z), "neg": share(m), "compound": F.round(s / F.sqrt(s * s + 15), 4)}


def with_valences(texts: DataFrame, text: str, lexicon: DataFrame, n: int) -> DataFrame:
    """texts with `_v`: the valences of the words of a text, 0 for those that are not in a lexicon of n words.

    The lexicon is one value of a scalar subquery: buckets by a hash of the word, so that few words are compared.
    """
    buckets = max(1, -(n // -IN_BUCKET))
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(buckets))
    held = lexicon.select(bucket(F.col("word")).alias("id"), "word", "valence").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word", "valence"))).alias("e"))
    every = lexicon.sparkSession.range(buckets).join(held, "id", "left").select("id", F.col("e.word").alias("words"), F.col("e.valence").alias("values"))
    table = every.agg(F.sort_array(F.collect_list(F.struct("id", "words", "values")))).scalar()

    def valence(w: Column) -> Column:
        row = F.get(F.col("_table"), bucket(w).cast("int"))
        return F.coalesce(F.get(row["values"], F.array_position(row["words"], w).cast("int") - 1), F.lit(0.0))

    return texts.withColumn("_table", table).withColumn("_v", F.transform(words_of(F.col(text)), valence)).drop("_table")


def joined_scores(texts: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """h1, h2 (hashes of the text), pos, neu, neg and compound by the plain sum for each different text, for a lexicon of any size.

    Words are counted within each text before they are dealt, so a frequent word makes one row a text.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select(*text_key(value), words_of(value).alias("w")).dropDuplicates(["h1", "h2"])
    counted = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("word"), F.size(F.filter("w", lambda y: y == x)).alias("n")))
    rows = rows.select("h1", "h2", F.explode_outer(counted).alias("c")).select("h1", "h2", "c.word", F.coalesce("c.n", F.lit(0)).alias("n"))
    joined = rows.join(lexicon, "word", "left").withColumn("v", F.coalesce("valence", F.lit(0.0)))
    v, n = F.col("v"), F.col("n")
    summed = joined.groupBy("h1", "h2").agg(F.struct(F.sum(v * n).alias("s"), F.sum(F.when(v > 0, (v + 1) * n).otherwise(0.0)).alias("p"), F.sum(F.when(v < 0, (1 - v) * n).otherwise(0.0)).alias("m"), F.sum(F.when(v == 0, n).otherwise(0)).alias("z")).alias("sums"))
    return summed.select("h1", "h2", *[c.alias(k) for k, c in plain_scores(F.col("sums")).items()])


def text_key(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def lexicon_scores(texts: DataFrame, lexicon: DataFrame, keys: list[str] | None = None, text: str = "text", method: str = "rules") -> DataFrame:
    """texts with pos, neu, neg (shares) and compound (-1 to 1), rounded to four places. lexicon: word, valence.

    method: `rules` follows negations, boosters, capitals, idioms, contrasts and emphasis, in Arrow batches; `plain` sums words
    in column functions. A lexicon within the bound is sent to the tasks, and no text is shuffled; beyond it, `plain` joins on the
    words, and joins the scores back by the text itself, so null and repeated keys are of no account. Each row keeps all its
    columns; `keys` is not needed any more.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {sorted(METHODS)}")
    names = ("pos", "neu", "neg", "compound")
    given = distinct_words(lexicon)
    n = given.limit(MOST_WORDS + 1).count()
    if method == "plain" and n <= MOST_WORDS:
        v = F.col("_v")
        of = lambda value, rule: F.aggregate(F.filter(v, rule), F.lit(0.0), lambda a, x: a + value(x))
        sums = F.struct(of(lambda x: x, lambda x: x != 0).alias("s"), of(lambda x: x + 1, lambda x: x > 0).alias("p"), of(lambda x: 1 - x, lambda x: x < 0).alias("m"), F.size(F.filter(v, lambda x: x == 0)).cast("double").alias("z"))
        found = with_valences(texts, text, given, n).withColumn("_sums", sums)
        return found.withColumns(plain_scores(F.col("_sums"))).drop("_v", "_sums")
    if n > MOST_WORDS:
        if method == "rules":
            raise ValueError(f"rules need a lexicon of at most {MOST_WORDS} words")
        h1, h2 = text_key(F.coalesce(F.col(text), F.lit("")))
        scores = joined_scores(texts, given, text).select((F.col("h1") + 0).alias("_h1"), F.col("h2").alias("_h2"), *names)
        return texts.withColumns({"_a": h1, "_b": h2}).join(scores, (F.col("_a") == F.col("_h1")) & (F.col("_b") == F.col("_h2"))).drop("_a", "_b", "_h1", "_h2")
    shared = texts.sparkSession.sparkContext.broadcast({r.word: r.valence for r in given.collect()})

    @F.pandas_udf("struct<pos: double, neu: double, neg: double, compound: double>")
    def score(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([valence.ruled(t, shared.value) for t in batch], columns=list(names), dtype=float)

    found = texts.withColumn("_scores", score(F.coalesce(F.col(text), F.lit(""))))
    return found.withColumns({n: F.round(F.col("_scores")[n], 4) for n in names}).drop("_scores")


def score_texts(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", method: str = "rules") -> DataFrame:
    """Lexicon scores, keyword boost, and their sum within -1 and 1."""
    found = lexicon_scores(texts, lexicon, keys, text, method)
    boost = F.col("_boost")
    final = F.greatest(F.least(F.col("compound") + boost, F.lit(1.0)), F.lit(-1.0))
    return found.withColumn("_boost", keyword_boost(F.col(text))).withColumns({"keyword_boost": F.round(boost, 4), "final_score": F.round(final, 4)}).drop("_boost")


def summarize(scored: DataFrame, by: list[str], score: str = "final_score") -> DataFrame:
    """Number, mean score, and how many are above 0.05, below -0.05, and between. The mean is exact, whatever the order."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"), F.round(F.avg(F.col(score).cast("decimal(12, 6)")), 4).cast("double").alias("avg_sentiment"), F.count_if(F.col(score) > BOUND).alias("positive"), F.count_if(F.col(score) < -BOUND).alias("negative"), F.count_if(F.col(score).between(-BOUND, BOUND)).alias("neutral")
    )


def polarity(score: Column) -> Column:
    return F.when(score > BOUND, "bullish").when(score < -BOUND, "bearish").otherwise("neutral")


def posts_about(posts: DataFrame, symbol: str) -> DataFrame:
    """Posts (title, body) whose title or body mentions the symbol."""
    token = _token(symbol, POST_QUOTES)
    return posts.where(mentions(F.col("title"), symbol, token) | mentions(F.col("body"), symbol, token))


def items_about(items: DataFrame, symbol: str) -> DataFrame:
    """Feed items (title, description) that mention the symbol."""
    token = _token(symbol, FEED_QUOTES)
    return items.where(mentions(F.concat_ws(" ", "title", "description"), symbol, token))


def _token(symbol: str, quotes: tuple[str, ...]) -> str:
    """The same rule as base_token, for one name."""
    s = symbol.upper()
    for sign in "/-":
        if sign in s:
            return s.split(sign)[0]
    return next((s[: -len(q)] for q in quotes if s.endswith(q) and len(s) > len(q)), s)


def dashboard(posts: DataFrame, items: DataFrame, bias: str = "neutral") -> DataFrame:
    """One row from two summaries of at most one row each: weighted index, its polarity, and a flag against a price bias.

    A source without rows, or without a finite mean, leaves its weight to the other.
    """
    one = lambda df, n: df.agg(F.first("total").alias(f"{n}_count"), F.first("avg_sentiment").alias(f"{n}_avg"))
    rows = one(posts, "post").join(one(items, "feed"), F.lit(True))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    p, f = finite("post_avg"), finite("feed_avg")
    index = F.when(p & f, F.col("post_avg") * POST_WEIGHT + F.col("feed_avg") * FEED_WEIGHT).when(p, F.col("post_avg")).when(f, F.col("feed_avg"))
    rows = rows.withColumn("sentiment_index", F.round(index, 4)).withColumn("mode", F.when(p & f, "weighted").when(p | f, "single_source").otherwise("unavailable"))
    rows = rows.withColumn("reason", F.when(p & ~f, "feed source not usable").when(f & ~p, "post source not usable").when(~p & ~f, "neither source usable"))
    rows = rows.withColumn("polarity", F.when(F.col("sentiment_index").isNotNull(), polarity(F.col("sentiment_index"))))
    against = (F.lit(bias) == "bullish") & (F.col("polarity") == "bearish") | (F.lit(bias) == "bearish") & (F.col("polarity") == "bullish")
    return rows.withColumn("cross_signal", F.when(against, F.concat(F.lit("sentiment_"), F.col("polarity"), F.lit(f"_vs_price_bias_{bias}"))))


__all__ = ["BOOSTS", "base_token", "dashboard", "items_about", "keyword_boost", "lexicon_scores", "mentions", "polarity", "posts_about", "score_texts", "summarize"]
