"""Posts and feed items from JSON and XML texts held in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The part of a listing that is used.
LISTING = "struct<data: struct<children: array<struct<data: struct<title: string, selftext: string, score: bigint, num_comments: bigint, upvote_ratio: double, link_flair_text: string, created_utc: double>>>>>"


def posts_from_listings(listings: DataFrame, column: str = "json", board: str = "board", most: int = 25) -> DataFrame:
    """One row for each of the first `most` posts of each listing."""
    children = F.slice(F.from_json(F.col(column), LISTING)["data"]["children"], 1, most)
    return listings.select(board, F.explode(children).alias("c")).select(board, "c.data.*").withColumnRenamed("selftext", "body")


def items_from_feeds(feeds: DataFrame, column: str = "xml", feed: str = "feed") -> DataFrame:
    """title, link, description, published of the items of RSS 2.0 and the entries of Atom; malformed texts give none."""
    x = F.try_validate_utf8(F.col(column)) if hasattr(F, "try_validate_utf8") else F.col(column)
    plain = _well_formed(x)
    element = r"(?s)<(item|entry)(\s[^>]*)?>(.*?)</\1>"
    rows = feeds.select(feed, F.explode(F.regexp_extract_all(plain, F.lit(element), F.lit(3))).alias("x"))
    body = lambda names: F.coalesce(*[F.nullif(F.regexp_extract("x", rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), F.lit("")) for n in names], F.lit(""))
    link = F.coalesce(F.nullif(F.regexp_extract("x", r"(?s)<link(?:\s[^>]*)?>([^<]+)</link>", 1), F.lit("")), F.nullif(F.regexp_extract("x", r"<link\s[^>]*href=[\"']([^\"']*)", 1), F.lit("")), F.lit(""))
    clean = lambda c: F.trim(_unescaped(F.regexp_replace(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"^\s+|\s+$", "")))
    return rows.select(feed, clean(body(["title"])).alias("title"), clean(link).alias("link"), clean(body(["description", "summary", "content"])).alias("description"), clean(body(["pubDate", "published", "updated"])).alias("published"))


def feed_failures(feeds: DataFrame, column: str = "xml", feed: str = "feed") -> DataFrame:
    """feed and reason, of the feeds whose text is missing or is no feed. Their loss matters only if no feed is left."""
    text = F.col(column)
    reason = F.when(text.isNull(), "not_fetched").when(_well_formed(text).isNull(), "malformed")
    return feeds.select(feed, reason.alias("reason")).where("reason is not null")


def items_or_error(feeds: DataFrame, column: str = "xml", feed: str = "feed") -> DataFrame:
    """The items of the feeds that can be read; raises ValueError only if none of them can."""
    total, failed = feeds.count(), feed_failures(feeds, column, feed).count()
    if total and failed == total:
        raise ValueError(f"all {total} feeds failed")
    return items_from_feeds(feeds, column, feed)


def _well_formed(x):
    """The text of a feed without name spaces; null if it is none. Default name spaces hide names from expressions."""
    plain = F.regexp_replace(x, r"\sxmlns(:\w+)?=(\"[^\"]*\"|'[^']*')", "")
    return F.when(plain.rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<(rss|feed|rdf:RDF)[\s>].*</(rss|feed|rdf:RDF)>\s*$"), plain)


def _unescaped(c):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def text_of_html(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds title and text of pages: scripts, styles and tags dropped, white space run together."""
    x = F.col(column)
    bare = F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return pages.withColumns({"title": F.trim(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1)), "text": F.trim(F.regexp_replace(_unescaped(bare), r"\s+", " "))})
