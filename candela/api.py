"""The 21 tools as calls that give envelopes: {success, data} or {success, error: {code, message}}.

Each call builds one DataFrame query; a query over all symbols is the same call without a symbol. Rows reach the driver
as JSON; an answer of more than MOST_ROWS rows is refused, never cut: envelopes are for display, pipelines take the
DataFrames.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import times
from .operators import backtest as bt
from .operators import levels, profile, recurrence, screener, sentiment, strategies, structure, windows, zones
from .schema import EXCHANGES, MAX_LIMIT, TIMEFRAME_SECONDS
from .sources import bars as src

# Codes of errors, the form of a symbol, and the most rows of an answer.
ERRORS = {
    "validation": 1000, "symbol": 1001, "timeframe": 1002, "exchange": 1003, "parameter": 1004, "missing_parameter": 1005, "data_source": 3000, "data_not_found": 3003, "rate_limit": 3004, "network": 3005,
    "indicator": 5000, "insufficient_data": 5001, "calculation": 5002, "internal": 9000, "unexpected": 9001,
}
SYMBOL = re.compile(r"^[A-Za-z0-9/\-_.]{2,20}$")
MOST_ROWS = 10_000
SCAN_SYMBOLS = 25


class Refused(ValueError):
    """A call that is not carried out, with the kind of its error."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def tool(f: Callable) -> Callable:
    """Give an envelope for what f returns or raises."""

    @functools.wraps(f)
    def call(self, *args, **options) -> dict:
        try:
            return {"success": True, "data": f(self, *args, **options)}
        except Refused as e:
            return {"success": False, "error": {"code": ERRORS[e.kind], "message": str(e)}}
        except ValueError as e:
            return {"success": False, "error": {"code": ERRORS["validation"], "message": str(e)}}
        except Exception as e:  # the envelope is the contract; the kind of failure is named
            return {"success": False, "error": {"code": ERRORS["internal"], "message": type(e).__name__}}

    call.is_tool = True
    return call


def records(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """Rows as JSON values; numbers that are not finite become null."""
    finite = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    rows = df.select(*finite).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise Refused("parameter", f"more than {most} rows; name a symbol, or take the DataFrame")
    return [json.loads(r.j) for r in rows]


class Market:
    """Tools over relations: bars (of one timeframe), and where there are any ticks, book levels, posts, feed items, lexicon."""

    def __init__(self, bars: DataFrame, ticks: DataFrame | None = None, levels: DataFrame | None = None, posts: DataFrame | None = None, items: DataFrame | None = None, lexicon: DataFrame | None = None):
        self.bars, self.ticks, self.levels, self.posts, self.items, self.lexicon = bars, ticks, levels, posts, items, lexicon

    def _of(self, symbol: str | None, limit: int | None = None, least: int = 1, exchange: str = "binance") -> DataFrame:
        if exchange not in EXCHANGES:
            raise Refused("exchange", f"unknown exchange: {exchange}")
        rows = self.bars
        if symbol is not None:
            if not SYMBOL.match(symbol):
                raise Refused("symbol", f"malformed symbol: {symbol!r}")
            rows = rows.where(F.col("symbol") == symbol)
        if limit is not None:
            if not 1 <= limit <= MAX_LIMIT:
                raise Refused("parameter", f"limit must be 1 to {MAX_LIMIT}")
            rows = src.last_bars(rows, limit)
        if symbol is not None and (n := rows.limit(least).count()) < least:  # reads no more than it needs to know
            raise Refused("insufficient_data" if n else "data_not_found", f"{n} bars, {least} needed")
        return rows

    def _needs(self, name: str) -> DataFrame:
        if (rows := getattr(self, name)) is None:
            raise Refused("data_source", f"no {name} are given")
        return rows

    @tool
    def fetch_ticker(self, symbol: str | None = None) -> list[dict]:
        rows = src.latest_ticker(self._needs("ticks"))
        return records(rows if symbol is None else rows.where(F.col("symbol") == symbol))

    @tool
    def fetch_klines(self, symbol: str, limit: int = 100, timeframe: str | None = None, exchange: str = "binance") -> list[dict]:
        if timeframe is not None and timeframe not in TIMEFRAME_SECONDS:
            raise Refused("timeframe", f"unknown timeframe: {timeframe}")
        rows = self._of(symbol, exchange=exchange)
        return records(src.last_bars(src.resample(rows, timeframe) if timeframe else rows, limit).orderBy("ts"))

    @tool
    def fetch_orderbook(self, symbol: str, depth: int = 20) -> list[dict]:
        return records(src.order_book(self._needs("levels").where(F.col("symbol") == symbol), depth).orderBy("side", "level"))

    @tool
    def indicator_rsi(self, symbol: str | None = None, period: int = 14, limit: int = 100, method: str = "smma") -> list[dict]:
        rows = recurrence.rsi_frame(self._of(symbol, least=period + 1), period, method).withColumn("zone", windows.zone(F.col("rsi")))
        return records(rows.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("n") <= limit).drop("n").orderBy("symbol", "ts"))

    def _backtest(self, name: str, symbol: str | None, capital: float, **options) -> dict:
        if capital <= 0:
            raise Refused("parameter", "capital must be above 0")
        rows = self._of(symbol, least=2)
        done = bt.simulate(bt.normalize_signals(rows, strategies.STRATEGIES[name](rows, **options)), capital=capital)
        return {"metrics": records(bt.metrics(done, capital=capital)), "trades": records(bt.trades_of(done)), "errors": records(done.where("kind = 'error'").select("symbol", "error"))}

    @tool
    def backtest_pdh_session(self, symbol: str | None = None, initial_capital: float = bt.CAPITAL, **options) -> dict:
        return self._backtest("pdh_session", symbol, initial_capital, **options)

    @tool
    def backtest_rsi(self, symbol: str | None = None, initial_capital: float = bt.CAPITAL, **options) -> dict:
        return self._backtest("rsi", symbol, initial_capital, **options)

    @tool
    def backtest_vwap(self, symbol: str | None = None, initial_capital: float = bt.CAPITAL, **options) -> dict:
        return self._backtest("vwap", symbol, initial_capital, **options)

    @tool
    def backtest_ema_stack(self, symbol: str | None = None, initial_capital: float = bt.CAPITAL, **options) -> dict:
        return self._backtest("ema_stack", symbol, initial_capital, **options)

    @tool
    def backtest_order_blocks(self, symbol: str | None = None, initial_capital: float = bt.CAPITAL, **options) -> dict:
        return self._backtest("order_blocks", symbol, initial_capital, **options)

    @tool
    def backtest_elliot_wave(self, symbol: str | None = None, initial_capital: float = bt.CAPITAL, **options) -> dict:
        return self._backtest("elliot_wave", symbol, initial_capital, **options)

    @tool
    def compare_strategies(self, ids: list[str], symbol: str | None = None, initial_capital: float = bt.CAPITAL) -> list[dict]:
        if len(ids) < 2 or len(set(ids)) != len(ids) or (unknown := set(ids) - set(strategies.STRATEGIES)):
            raise Refused("parameter", f"two or more different ids of {sorted(strategies.STRATEGIES)} are needed; unknown: {sorted(unknown) if len(ids) > 1 and len(set(ids)) == len(ids) else []}")
        return records(bt.compare(self._of(symbol, least=2), {k: strategies.STRATEGIES[k] for k in ids}, initial_capital).orderBy("symbol", "rank"))

    def _many(self, symbols: list[str] | None) -> tuple[DataFrame, list[dict]]:
        """Bars of the symbols, and a failure for each symbol without any."""
        if symbols is None:
            return self._of(None), []
        wanted = list(dict.fromkeys(s.strip().upper() for s in symbols))
        if not wanted or len(wanted) > SCAN_SYMBOLS:
            raise Refused("parameter", f"1 to {SCAN_SYMBOLS} symbols are needed")
        rows = self.bars.where(F.upper("symbol").isin(*wanted))
        return rows, records(screener.missing(rows, wanted))

    @staticmethod
    def _outcome(found: list[dict], failed: list[dict]) -> dict:
        if not screener.succeeded(len(found), len(failed)):
            reasons = sorted({f["reason"] for f in failed})
            raise Refused("data_source", f"all symbols failed: {', '.join(reasons)}")
        return {"results": found, "failures": failed}

    @tool
    def screener_scan(self, symbols: list[str] | None = None, filters: list[str] | None = None, min_score: float = 0.0) -> dict:
        if not 0 <= min_score <= 100:
            raise Refused("parameter", "min_score must be 0 to 100")
        rows, lacking = self._many(symbols)
        return self._outcome(records(screener.scan(rows, tuple(filters or screener.DEFAULT_FILTERS), min_score)), lacking)

    @tool
    def session_breakout_scan(self, session: str = "ny", symbols: list[str] | None = None, proximity_pct: float = 0.5, volume_multiplier: float = 1.5) -> dict:
        rows, lacking = self._many(symbols)
        found, failed = screener.session_scan(rows, session, proximity_pct, volume_multiplier)
        return self._outcome(records(found), sorted(lacking + records(failed), key=lambda f: f["symbol"]))

    @tool
    def order_block_screener_scan(self, symbols: list[str] | None = None, atr_period: int = 14, impulse_atr_mult: float = 1.0, max_zone_age_bars: int = 20) -> dict:
        rows, lacking = self._many(symbols)
        found, failed = screener.order_block_scan(rows, atr_period, impulse_atr_mult, max_zone_age_bars, fetched=True)
        horizons = [{**f, "timeframe": t, "window_days": d} for f in lacking for t, d, _ in screener.HORIZONS]
        return self._outcome(records(found), sorted(horizons + records(failed), key=lambda f: (f["symbol"], f["timeframe"], f["window_days"], f["reason"])))

    @tool
    def calculate_volume_profile(self, symbol: str, limit: int = 100, bins: int = 100, value_area_pct: float = 0.7) -> dict:
        rows = self._of(symbol, limit)
        return {"summary": records(profile.volume_profile_summary(rows, value_area_pct, bins=bins)), "bins": records(profile.volume_profile(rows, value_area_pct, bins=bins).orderBy("bin"))}

    @tool
    def detect_order_blocks(self, symbol: str, limit: int = 100, **options) -> list[dict]:
        return records(zones.active_zones(self._of(symbol, limit, 3), **options).orderBy("freshness"))

    @tool
    def calculate_fibonacci(self, symbol: str, limit: int = 100, direction: str = "bullish") -> dict:
        rows = levels.swing_range(self._of(symbol, limit))
        return {"retracements": records(levels.retracements(rows)), "extensions": records(levels.extensions(rows, direction))}

    @tool
    def calculate_tpo(self, symbol: str, row_size: float, limit: int = 48, value_area_pct: float = 0.7) -> dict:
        rows = self._of(symbol, limit)
        return {"rows": records(profile.tpo_chart(rows, row_size, value_area_pct).orderBy("row")), "balance": records(profile.initial_balance(rows))}

    @tool
    def detect_elliot_wave(self, symbol: str, limit: int = 500, swing_window: int = 2, min_swing_pct: float = 0.05, **options) -> list[dict]:
        return records(structure.elliott_waves(structure.swings(self._of(symbol, limit), swing_window, min_swing_pct), **options).orderBy("sequence_id", "segment_order"))

    @tool
    def get_market_structure(self, symbol: str | None = None, limit: int = 500, **options) -> list[dict]:
        return records(structure.structure_summary(self._of(symbol, limit, 28 if symbol else 1), **options))

    @tool
    def get_combined_sentiment_dashboard(self, symbol: str, price_bias: str = "neutral") -> dict:
        if price_bias not in ("bullish", "bearish", "neutral"):
            raise Refused("parameter", f"unknown price bias: {price_bias}")
        lexicon = self._needs("lexicon")

        def summary(rows: DataFrame, text: str) -> DataFrame:
            keyed = rows.withColumn("_id", F.monotonically_increasing_id())
            return sentiment.summarize(sentiment.score_texts(keyed, lexicon, ["_id"], text).withColumn("kind", F.lit(text)), ["kind"])

        posts = summary(sentiment.posts_about(self._needs("posts"), symbol), "title")
        items = sentiment.items_about(self._needs("items"), symbol).withColumn("whole", F.concat_ws(" ", "title", "description"))
        return records(sentiment.dashboard(posts, summary(items, "whole"), price_bias))[0]


TOOLS = sorted(n for n, f in vars(Market).items() if getattr(f, "is_tool", False))
parse_iso, resolve_window = times.parse_iso, times.resolve_window
