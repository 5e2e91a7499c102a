"""Names of instruments: from one venue's form to another's, as column expressions.

An unknown or malformed name gives null where a strict function would raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote currencies in the order in which endings are tried, and which count as dollars.
MARKET_QUOTES = ("USDT", "USDC", "USD", "BTC", "ETH", "BUSD")
BASE_QUOTES = ("USDT", "USD", "BTC", "ETH", "BUSD")
POST_QUOTES = ("USDT", "USD", "BTC", "ETH")
FEED_QUOTES = ("USDT", "USDC", "FDUSD", "TUSD", "USD", "BTC", "ETH", "BNB", "EUR")
DOLLARS = ("USDT", "USD", "USDC", "US")

# Bar lengths as the two providers name them.
PRIMARY_INTERVALS = {"1m": "1m", "5m": "5m", "15m": "15m", "30m": "30m", "1h": "1h", "4h": "4h", "1d": "1d", "1wk": "1w", "1mo": "1M"}
SECONDARY_INTERVALS = {"1m": "1m", "5m": "5m", "15m": "15m", "30m": "30m", "1h": "1h", "1d": "1d", "1wk": "1wk", "1mo": "1mo"}

_PAIR = r"^([\p{L}\p{N}]+)/([\p{L}\p{N}]+)$"
_DASH = r"^([\p{L}\p{N}]+)-([\p{L}\p{N}]+)$"


def upper(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def sanitized(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"[^\p{L}\p{N}]", "")


def to_primary(symbol: Column) -> Column:
    """BTCUSDT or BTC/USDT: dashes become slashes, dollars become USDT; BTC-USD has no such name."""
    s = upper(symbol)
    return (
        F.when(F.contains(s, F.lit("/")), F.when(s.rlike(_PAIR), s))
        .when(F.contains(s, F.lit("-")), F.when(s.rlike(_DASH) & ~s.endswith("-USD"), F.regexp_replace(s, "-", "/")))
        .when(s.rlike("(USDT|USDC)$"), F.when(s.rlike(r"^[\p{L}\p{N}]+(USDT|USDC)$"), s))
        .when(s.endswith("USD"), F.concat(F.regexp_replace(s, "USD$", ""), F.lit("USDT")))
    )


def to_market(symbol: Column) -> Column:
    """BASE/QUOTE."""
    s = to_primary(symbol)
    return F.when(F.contains(s, F.lit("/")), s).when(s.rlike(f".({'|'.join(MARKET_QUOTES)})$"), F.regexp_replace(s, f"^(.+?)({'|'.join(MARKET_QUOTES)})$", "$1/$2"))


def to_legacy(symbol: Column) -> Column:
    """BTCUSD."""
    s = upper(symbol)
    return F.when(s.endswith("USDT"), F.regexp_replace(s, "T$", "")).when(s.endswith("USD"), s)


def to_secondary(symbol: Column) -> Column:
    """BTC-USD; names that end in no dollar get one."""
    s = upper(symbol)
    base, quote = F.regexp_extract(s, _PAIR, 1), F.regexp_extract(s, _PAIR, 2)
    plain = F.regexp_extract(s, r"^([\p{L}\p{N}]+?)(USDT|USD)$", 1)
    rest = sanitized(s)
    return (
        F.when(s == "", None)
        .when(F.contains(s, F.lit("/")), F.when(base != "", F.when(quote.isin(*DOLLARS), F.concat(base, F.lit("-USD"))).otherwise(F.concat_ws("-", base, quote))))
        .when(s.endswith("USD") & F.contains(s, F.lit("-")), F.when(s.rlike(r"^[\p{L}\p{N}]+-USD$"), s))
        .when(s.rlike("(USDT|USD)$"), F.when(plain != "", F.concat(plain, F.lit("-USD"))))
        .when(rest != "", F.concat(rest, F.lit("-USD")))
    )


def base_currency(symbol: Column) -> Column:
    """The name without the first quote currency that ends it."""
    s, out = upper(symbol), None
    for q in BASE_QUOTES:
        out = F.when(s.endswith(q), F.regexp_replace(s, f"{q}$", "")) if out is None else out.when(s.endswith(q), F.regexp_replace(s, f"{q}$", ""))
    return F.coalesce(out.otherwise(s), F.lit(""))


def base_token(symbol: Column, quotes: tuple[str, ...] = POST_QUOTES) -> Column:
    """The part before a slash or dash, or without the first quote currency that ends it and leaves something."""
    s = F.upper(symbol)
    out = F.when(F.contains(s, F.lit("/")), F.get(F.split(s, "/"), F.lit(0))).when(F.contains(s, F.lit("-")), F.get(F.split(s, "-"), F.lit(0)))
    for q in quotes:
        out = out.when(s.endswith(q) & (F.length(s) > len(q)), F.regexp_replace(s, f"{q}$", ""))
    return out.otherwise(s)


def is_valid(symbol: Column) -> Column:
    s = upper(symbol)
    dollars = "|".join(DOLLARS)
    return F.coalesce(
        F.when(F.contains(s, F.lit("/")), s.rlike(rf"^[\p{{L}}\p{{N}}]+/({dollars})$"))
        .when(F.contains(s, F.lit("-")), s.rlike(rf"^[\p{{L}}\p{{N}}]+-({dollars})$"))
        .otherwise(s.rlike(r"^[\p{L}\p{N}]+(USDT|USDC|USD)$")),
        F.lit(False),
    )
