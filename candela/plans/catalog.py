"""Registered queries of the market operators, each over whole tables, and the SQL that gives the same rows.

Doubles are rounded to six places on both sides. Bars come from `events`: one symbol for each event type.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display
from ..functions import symbols as sym
from ..operators import backtest as bt
from ..operators import isolation, joins, quantiles, scan, zones
from ..operators import levels as lev
from ..operators import profile as prof
from ..operators import recurrence as rec
from ..operators import screener as scr
from ..operators import sentiment as sent
from ..operators import strategies as strat
from ..operators import structure as struc
from ..operators import windows as win
from ..sources import bars as src
from ..sources import feeds, partials, provider
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, counts as whole numbers of 64 bits."""
    of = {"double": lambda c: F.round(c, places), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[of.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_ticks(table(spark, sf_dir, "events"), "1h")


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each user: many symbols with few bars each."""
    return src.bars_from_ticks(table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string")), "1h", "user")


def calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of prices that move by a few hundredths: 100 and a hundredth of the value."""
    return src.bars_from_ticks(table(spark, sf_dir, "events").withColumn("value", 100 + F.col("value") / 100), "1h")


def query(f: Callable) -> Callable:
    """Register a query of (spark, sf_dir)."""
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def on_bars(bars: Callable[[SparkSession, str], DataFrame] = hourly, **queries: Callable[[DataFrame], DataFrame]) -> None:
    """Register queries of hourly bars."""
    for name, f in queries.items():
        QUERIES[name] = lambda spark, sf_dir, f=f: rounded(f(bars(spark, sf_dir)))


on_bars(
    bars_1h=lambda b: b,
    bars_4h=lambda b: src.resample(b, "4h"),
    bars_1d=lambda b: src.resample(b, "1d"),
    last_n_bars=lambda b: src.last_bars(b, 100),
    bar_violations=src.violations,
    bar_columns=lambda b: src.from_columns(src.to_columns(b)),
    true_range=win.true_range,
    stochastic=win.stochastic,
    cci=win.cci,
    williams_r=win.williams_r,
    roc=win.roc,
    bollinger_width=win.bollinger_width,
    hist_vol=lambda b: win.historical_volatility(b, 24),
    latest_vol=win.latest_volatility,
    obv=win.obv,
    mfi=win.mfi,
    vwap_ny=lambda b: win.vwap(b, "ny").select("symbol", "ts", "vwap"),
    vwap_asia=lambda b: win.vwap(b, "asia").select("symbol", "ts", "vwap"),
    vwap_london=lambda b: win.vwap(b, "london").select("symbol", "ts", "vwap"),
    vwap_daily=lambda b: win.vwap(b, "daily").select("symbol", "ts", "vwap"),
    vwap_bands=win.vwap_bands,
    vwap_cross=win.vwap_cross,
    volume_ratio=win.volume_ratio,
    momentum_pct=win.momentum_pct,
    gap_sessions=lambda b: win.gap_sessions(b),
    fair_value_gaps=win.fair_value_gaps,
    pivot_points=win.pivot_points,
    swing_candidates=win.swing_candidates,
    strict_swings=win.strict_swings,
    local_extremes=win.local_extremes,
    session_levels_ny=lambda b: lev.session_levels(b, "ny"),
    session_levels_asia=lambda b: lev.session_levels(b, "asia"),
    session_levels_london=lambda b: lev.session_levels(b, "london"),
    pdh_pdl=lev.previous_day_levels,
    fib_levels=lambda b: lev.retracements(lev.swing_range(b)),
    fib_extension=lambda b: lev.extensions(lev.swing_range(b), "bullish").unionByName(lev.extensions(lev.swing_range(b), "bearish")),
    fib_confluence=lambda b: lev.confluence([lev.retracements(lev.swing_range(b)), lev.extensions(lev.swing_range(b), "bullish"), lev.retracements(lev.swing_range(src.last_bars(b, 48)))], 0.05),
    sma=rec.sma_frame,
    ema=lambda b: rec.ema_frame(b, 7),
    smma=lambda b: rec.smma_frame(b, 14),
    ema_stack=rec.ema_stack_frame,
    ema_cross=lambda b: win.ema_cross(rec.ema_stack_frame(b, (7, 25)), "ema7", "ema25"),
    ema_order=lambda b: win.ema_order(rec.ema_stack_frame(b)),
    macd=rec.macd_frame,
    rsi_smma=rec.rsi_frame,
    rsi_ema=lambda b: rec.rsi_frame(b, 14, "ema"),
    rsi_extremes=lambda b: win.rsi_extremes(rec.rsi_frame(b)),
    rsi_cross=lambda b: win.rsi_cross(rec.rsi_frame(b)),
    rsi_divergence=lambda b: win.rsi_divergence(rec.rsi_frame(b)),
    atr=rec.atr_frame,
    adx=rec.adx_frame,
    ema_scan=scan.ema,
    ema_stack_scan=scan.ema_stack,
    smma_scan=scan.smma,
    rsi_scan=scan.rsi,
    rsi_ema_scan=lambda b: scan.rsi(b, 14, "ema"),
    macd_scan=scan.macd,
    atr_scan=scan.atr,
    adx_scan=scan.adx,
    supertrend=rec.supertrend_frame,
    indicator_summaries=rec.summaries,
    swings=lambda b: struc.swings(b, 2, 0.02),
    market_structure=lambda b: struc.market_structure(struc.swings(b)),
    price_ranges=lambda b: struc.price_ranges(b, struc.swings(b), max_pct=2.0),
    price_ranges_default=lambda b: struc.price_ranges(b, struc.swings(b)),
    range_breakouts=lambda b: struc.range_breakouts(b, struc.price_ranges(b, struc.swings(b), max_pct=2.0)),
    structure_summary=lambda b: struc.structure_summary(b, max_pct=2.0),
    elliott_waves=lambda b: struc.elliott_waves(struc.swings(b, 2, 0.05)),
    volume_profile=lambda b: prof.volume_profile(b, bins=50),
    volume_profile_atr=lambda b: prof.volume_profile(b, mode="atr"),
    volume_profile_pct=lambda b: prof.volume_profile(b, mode="pct", range_pct=0.05),
    volume_profile_summary=lambda b: prof.volume_profile_summary(b, bins=50),
    tpo=lambda b: prof.tpo_chart(b.withColumn("symbol", F.concat_ws("|", "symbol", F.to_date("ts"))), 5.0),
    tpo_refused=lambda b: prof.tpo_refused(b, 5.0),
    initial_balance=prof.initial_balance,
    order_block_candidates=lambda b: zones.with_invalidation(b, zones.zone_candidates(b)).drop("last_i"),
    order_blocks=zones.active_zones,
    scan_factors=lambda b: scr.factors(src.last_bars(b, 100)),
    screener_scan=lambda b: _flat(scr.scan(b, scr.FILTERS)),
    session_scan=lambda b: _flat(scr.session_scan(b, "ny")[0]),
    session_scan_failures=lambda b: scr.session_scan(b, "ny")[1],
    order_block_scan=lambda b: scr.order_block_scan(b)[0],
    order_block_scan_failures=lambda b: scr.order_block_scan(b)[1],
    signals_vwap=strat.vwap_anchored,
    signals_ema_stack=strat.ema_stack,
    signals_rsi=strat.rsi_reversion,
    signals_pdh=strat.pdh_session,
    signals_order_blocks=strat.order_blocks,
    signals_elliott=strat.elliott_simplified,
    backtest_trades=lambda b: bt.trades_of(_simulated(b, strat.rsi_reversion, ("trade",))),
    backtest_equity=lambda b: bt.equity_of(_simulated(b, strat.rsi_reversion)),
    backtest_metrics=lambda b: bt.metrics(_simulated(b, strat.rsi_reversion)),
    compare_strategies=lambda b: bt.compare(b, strat.STRATEGIES),
    comparison_lines=lambda b: display.comparison_lines(rounded(bt.compare(b, strat.STRATEGIES)), 4),
    engine_equity=lambda b: bt.equity_of(_by_hour(b)),
    engine_trades=lambda b: bt.trades_of(_by_hour(b)),
    engine_metrics=lambda b: bt.metrics(_by_hour(b)),
    walk_forward=lambda b: bt.walk_forward(b, strat.rsi_reversion, 100, 50, 50),
    walk_forward_summary=lambda b: bt.walk_forward_summary(bt.walk_forward(b, strat.rsi_reversion, 100, 50, 50)),
    walk_forward_splits=lambda b: bt.splits(b, 100, 50, 50),
    return_metrics=lambda b: bt.return_metrics(_returns(b)),
)


def _rising(pdf: pd.DataFrame) -> pd.DataFrame:
    """A job that refuses symbols whose last close is below the first: the number of bars, and the largest rise from bar to bar."""
    if pdf["close"].iloc[-1] < pdf["close"].iloc[0]:
        raise ValueError("the last close is below the first")
    return pd.DataFrame([{"bars": len(pdf), "largest_rise": pdf["close"].diff().max()}])


def _jobs(bars: DataFrame) -> DataFrame:
    return isolation.run_jobs(bars, _rising, "bars long, largest_rise double")


on_bars(
    by_user,
    session_scan_failures_by_user=lambda b: scr.session_scan(b, "ny")[1],
    order_block_scan_by_user=lambda b: scr.order_block_scan(b)[0],
    backtest_trades_by_user=lambda b: bt.trades_of(_simulated(b, strat.rsi_reversion, ("trade",))),
    rsi_extremes_by_user=lambda b: win.rsi_extremes(rec.rsi_frame(b)),
)
on_bars(
    calm,
    price_ranges_calm=lambda b: struc.price_ranges(b, struc.swings(b)),
    range_breakouts_calm=lambda b: struc.range_breakouts(b, struc.price_ranges(b, struc.swings(b))),
)
on_bars(symbol_jobs=lambda b: isolation.results(_jobs(b)), symbol_job_failures=lambda b: isolation.failures(_jobs(b)))


def _returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(win.by_time())
    return bars.select("symbol", F.col("ts").alias("i"), (F.col("close") / before - 1).alias("r")).where("r is not null")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("filters_matched", F.array_join("filters_matched", ","))


def _simulated(bars: DataFrame, strategy: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...] = bt.KINDS) -> DataFrame:
    return bt.simulate(bt.normalize_signals(bars, strategy(bars)), kinds=kinds)


def _by_hour(bars: DataFrame) -> DataFrame:
    """The engine on signals told by the hour of the day alone; long on even days, short on odd ones, flat at the end of each."""
    hour, side = F.hour("ts"), F.when(F.dayofmonth("ts") % 2 == 0, "long").otherwise("short")
    last = F.max("ts").over(Window.partitionBy("symbol", F.to_date("ts")))
    action = F.when(F.col("ts") == last, F.concat(side, F.lit("_exit"))).when(hour.isin(2, 10), F.concat(side, F.lit("_entry"))).when(hour.isin(7, 18), F.concat(side, F.lit("_exit"))).otherwise("hold")
    return bt.simulate(bt.normalize_signals(bars, bars.select("symbol", "ts", action.alias("signal"))))


@query
def bars_merged(spark, sf_dir):
    """Bars of three parts of the ticks, each summed up apart, merged."""
    ticks = table(spark, sf_dir, "events")
    return partials.finished(partials.merged(*[partials.partial_bars(ticks.where(F.col("event_id") % 3 == k)) for k in range(3)]))


@query
def provider_bars(spark, sf_dir):
    """All hourly bars by way of the data source, in pages of 200 bars."""
    provider.register(spark)
    ticks = table(spark, sf_dir, "events")
    names = ",".join(sorted(r.event_type for r in ticks.select("event_type").distinct().collect()))
    first, last = ticks.agg(F.min("ts"), F.max("ts")).first()
    options = {"provider": "candela.sources.provider:bars_of_ticks", "path": f"{sf_dir}/events.parquet", "symbols": names, "start": first.replace(minute=0, second=0, microsecond=0).isoformat(), "end": (last + timedelta(hours=1)).isoformat(), "page": "200"}
    return spark.read.format(provider.NAME).options(**options).load()


@query
def asof_quotes(spark, sf_dir):
    """Each purchase with the user's last view at or before it."""
    events = table(spark, sf_dir, "events")
    trades = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.col("value").alias("price"))
    quotes = events.where("event_type = 'view'").select("event_id", "user_id", "ts", F.col("value").alias("quote"))
    return joins.asof_join(trades, quotes, ("user_id",), "ts", "ts", ("quote", "ts"), tie=("event_id",))


@query
def interval_clicks(spark, sf_dir):
    """Each click within an hour to a day after a signup of the same user; the more the user id, the longer."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    spans = events.where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), "user_id", F.col("ts").alias("begin"), (F.col("ts") + F.make_dt_interval(hours=F.col("user_id") % 24 + 1)).alias("end"))
    return joins.interval_join(clicks, spans, ("user_id",), "ts", "begin", "end", ("signup_id",))


@query
def price_quantiles(spark, sf_dir):
    return quantiles.exact_quantiles(table(spark, sf_dir, "events"), ("event_type",), "value", (0.0, 0.05, 0.5, 0.95, 1.0), held=200)


@query
def latest_ticker(spark, sf_dir):
    return src.latest_ticker(table(spark, sf_dir, "events"))


@query
def bars_daily_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_totalprice").cast("double").alias("price"))
    return src.bars_from_ticks(orders, "1d", "o_orderpriority", "at", "price", "o_orderkey")


@query
def order_book(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    price = F.round(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double"), 2)
    levels = lines.select(F.col("l_linestatus").alias("symbol"), F.when(F.col("l_returnflag") == "A", "bid").otherwise("ask").alias("side"), price.alias("price"), F.col("l_quantity").cast("double").alias("amount"))
    return src.order_book(levels, 10)


@query
def bars_from_records(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    records = bars.select("symbol", F.array((F.unix_millis(F.col("ts").cast("timestamp"))).cast("double"), "open", "high", "low", "close", "volume").alias("record"))
    return src.bars_from_records(records)


@query
def keyword_boost(spark, sf_dir):
    words = F.concat_ws(" ", F.element_at(F.array(F.lit("to the moon moon"), F.lit("pump and dump"), F.lit("bears bear bull"), F.lit("rugpull rug crash"), F.lit("bullish")), (F.col("doc_id") % 5 + 1).cast("int")), "text")
    return table(spark, sf_dir, "documents").select("doc_id", sent.keyword_boost(words).alias("boost"))


@query
def symbol_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sent.mentions(F.col("text"), "the", "of").alias("mentioned"))


@query
def symbol_forms(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    ending = F.element_at(F.array(*[F.lit(x) for x in ("USDT", "usd", "/USDT", "-USDT", "-USD", "BTC", "USDC", "", "--x")]), (F.col("c_custkey") % 9 + 1).cast("int"))
    s = F.concat(F.substring("segment", 1, 3), ending)
    return people.select("c_custkey", s.alias("symbol"), sym.to_primary(s).alias("primary_form"), sym.to_market(s).alias("market_form"), sym.to_legacy(s).alias("legacy_form"), sym.to_secondary(s).alias("secondary_form"), sym.base_currency(s).alias("base"), sym.base_token(s).alias("token"), sym.is_valid(s).alias("valid"))


@query
def page_texts(spark, sf_dir):
    pages = feeds.text_of_html(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "title", "text")


def _lexicon(spark: SparkSession) -> DataFrame:
    # a toy lexicon: the operator takes any relation of words and valences
    return spark.sql("select * from values ('the', 0.5D), ('of', -0.4D), ('and', 0.3D), ('der', 0.2D), ('la', -0.6D), ('crash', -2.0D) as t(word, valence)")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return sent.score_texts(docs, _lexicon(spark), ["doc_id"], method="plain")


@query
def sentiment_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "pos", "neu", "neg", "compound", "keyword_boost", "final_score")


@query
def sentiment_rules(spark, sf_dir):
    """By rules; without SQL, tests hold the rules against sentences of known scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sent.score_texts(docs, _lexicon(spark), ["doc_id"]).drop("text")


@query
def sentiment_summary(spark, sf_dir):
    return sent.summarize(_scored(spark, sf_dir), ["source"])


@query
def sentiment_dashboard(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "post").otherwise("feed"))
    of = lambda kind: sent.summarize(scored.where(F.col("kind") == kind), ["kind"])
    return sent.dashboard(of("post"), of("feed"), "bullish")
