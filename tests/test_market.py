"""Operators on small relations with closed-form results, and refusals."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candela.functions import symbols, times
from candela.operators import levels, recurrence, screener, sentiment, strategies, structure, windows, zones
from candela.operators import profile as prof
from candela.schema import BARS
from candela.sources import bars as src
from candela.sources import feeds

START = datetime(2024, 3, 15)


def make(spark, rows, symbol="x", start=START, step=timedelta(hours=1)):
    """rows of (open, high, low, close, volume)."""
    return spark.createDataFrame([(symbol, start + i * step, *map(float, r)) for i, r in enumerate(rows)], BARS)


def test_asia_session_of_one_day(spark):
    bars = make(spark, [(100 + 0.1 * i, 101 + 0.1 * i, 99 + 0.1 * i, 100.5 + 0.1 * i, 1) for i in range(24)])
    row = levels.session_levels(bars, "asia").first()
    assert row.bars == 9 and row.high == pytest.approx(101.8) and row.low == pytest.approx(99.0)


def test_session_before_it_begins_is_the_day_before(spark):
    bars = make(spark, [(1, 2, 0.5, 1, 1)] * 30)  # the last bar is at 05:00 of the second day
    row = levels.session_levels(bars, "london").first()
    assert row.bars == 9 and row.session_start == START + timedelta(hours=8)


def test_vwap_of_three_bars(spark):
    rows = [(102, 105, 100, 103, 1000), (103, 106, 101, 104, 1000), (104, 107, 102, 105, 1000)]
    got = [r.vwap for r in windows.vwap(make(spark, rows), "ny").orderBy("ts").collect()]
    tp = [(h + x + c) / 3 for _, h, x, c, _ in rows]
    assert got == pytest.approx([tp[0], sum(tp[:2]) / 2, sum(tp) / 3])


def test_vwap_without_volume_is_the_typical_price(spark):
    row = windows.vwap(make(spark, [(1, 3, 1, 2, 0)]), "daily").first()
    assert row.vwap == 2


def test_flat_ranges_have_their_set_values(spark):
    bars = make(spark, [(5, 5, 5, 5, 1)] * 20)
    assert windows.williams_r(bars).orderBy(F.desc("ts")).first().williams_r == -50
    assert windows.stochastic(bars).orderBy(F.desc("ts")).first().k == 50
    assert windows.mfi(bars).orderBy(F.desc("ts")).first().mfi == 50


def test_previous_day_needs_the_whole_day(spark):
    few = levels.previous_day_levels(make(spark, [(1, 2, 0.5, 1, 1)] * 20)).first()
    assert few.position == "insufficient_data" and few.pdh is None
    many = levels.previous_day_levels(make(spark, [(1, 2, 0.5, 1, 1)] * 72)).first()
    assert many.position == "inside_range" and many.pdh == 2


def test_empty_bars_give_empty_results(spark):
    none = src.empty_bars(spark)
    for f in (windows.true_range, windows.obv, levels.previous_day_levels, structure.swings, src.violations, zones.zone_candidates, prof.volume_profile):
        assert f(none).count() == 0


def test_canonical_fills_what_is_missing(spark):
    frame = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as `Date`, 1 as `Open`, double('nan') as `High`")
    row = src.canonical(frame, "s").first()
    assert (row.symbol, row.open, row.high, row.close) == ("s", 1.0, None, 0.0)


def test_sources_fall_back(spark):
    found = src.Sources()
    found.register("broken", lambda s: s.read.parquet("/nowhere"))
    found.register("good", lambda s: make(s, [(1, 2, 0, 1, 1)] * 5))
    rows, told = found.fetch(spark, "x", "1h", START, START + timedelta(hours=5), limit=3)
    assert rows.count() == 3 and told["source_used"] == "good" and len(told["warnings"]) == 1
    with pytest.raises(ValueError):
        found.fetch(spark, "x", "7h", START, START + timedelta(days=1))


def test_volume_is_shared_by_overlap(spark):
    rows = prof.volume_profile(make(spark, [(0, 10, 0, 5, 100), (0, 5, 5, 5, 10)]), bins=2).orderBy("bin").collect()
    assert [r.volume for r in rows] == pytest.approx([60, 50])  # the point bar belongs to the first bin that holds it
    assert [r.candles for r in rows] == [2, 1]


def test_tpo_rows(spark):
    rows = prof.tpo_chart(make(spark, [(1, 2, 1, 1, 1), (2, 3, 2, 2, 1), (1, 3, 1, 2, 1)]), 1.0).orderBy("row").collect()
    assert [(r.tpo_count, r.markers) for r in rows] == [(2, "AC"), (2, "BC")]


def test_ranges_equal_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    close = 100 + rng.normal(0, 1, 160)
    bars = make(spark, [(c, c + abs(rng.normal()), c - abs(rng.normal()), c, 1) for c in close])
    found = structure.swings(bars, 2, 0.001)
    got = {(r.start_ts, r.end_ts): (round(r.range_high, 9), round(r.range_low, 9), r.bars_evaluated) for r in structure.price_ranges(bars, found, 6, 0.5, 0.5).collect()}
    rows, sw = bars.orderBy("ts").collect(), found.orderBy("swing_id").collect()
    highs, lows, expected = [s for s in sw if s.swing_type == "high"], [s for s in sw if s.swing_type == "low"], {}
    for i in range(len(highs)):
        for j in range(i + 1, min(i + 6, len(highs))):
            inside = [x.pivot_price for x in lows if highs[i].pivot_index <= x.pivot_index <= highs[j].pivot_index]
            if len(inside) < 2:
                continue
            top, bottom = max(h.pivot_price for h in highs[i : j + 1]), min(inside)
            if (top - bottom) / ((top + bottom) / 2) > 0.5:
                continue
            part = [r.close for r in rows if highs[i].pivot_ts <= r.ts <= highs[j].pivot_ts]
            edge = (top - bottom) * 0.001
            if sum(bottom + edge <= c <= top - edge for c in part) / len(part) + 1e-9 >= 0.5:
                expected[highs[i].pivot_ts, highs[j].pivot_ts] = (round(top, 9), round(bottom, 9), len(part))
    assert got == expected and expected


@pytest.mark.parametrize(("text", "boost"), [("DOGE to the moon", 0.15), ("to the moon moon", 0.30), ("to the moon pump moon", 0.45), ("bears", 0.0), ("rugpull rug", -0.30), (None, 0.0), ("Bullish, BEARISH!", 0.0)])
def test_keyword_boost(spark, text, boost):
    row = spark.createDataFrame([(text,)], "t string").select(sentiment.keyword_boost(F.col("t")).alias("b")).first()
    assert row.b == pytest.approx(boost)


def test_mentions_are_whole_words(spark):
    rows = spark.createDataFrame([("Bitcoin up",), ("btcs",), ("buy BTC!",), (None,)], "t string").select(sentiment.mentions(F.col("t"), "BTCUSDT", "BTC").alias("m")).collect()
    assert [r.m for r in rows] == [True, False, True, False]


@pytest.mark.parametrize(("name", "primary", "market", "secondary"), [("btcusd", "BTCUSDT", "BTC/USDT", "BTC-USD"), ("BTC-USDT", "BTC/USDT", "BTC/USDT", None), ("BTC-USD", None, None, "BTC-USD"), ("eth/usdc", "ETH/USDC", "ETH/USDC", "ETH-USD"), ("A--B", None, None, "AB-USD")])
def test_symbol_forms(spark, name, primary, market, secondary):
    s = F.lit(name)
    row = spark.range(1).select(symbols.to_primary(s).alias("p"), symbols.to_market(s).alias("m"), symbols.to_secondary(s).alias("s")).first()
    assert (row.p, row.m, row.s) == (primary, market, secondary)


def test_windows_of_time():
    now = datetime(2024, 1, 10)
    assert times.resolve_window("swing_trade", now=now) == ("4h", now - timedelta(days=7), now)
    with pytest.raises(ValueError):
        times.resolve_window("custom", "1m", datetime(2024, 1, 1), datetime(2024, 1, 5))
    assert times.to_utc(datetime(2024, 1, 1)) == datetime(2024, 1, 1, 5)


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x</link><description><![CDATA[c]]></description><pubDate>d</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://a"><entry><title>T</title><link href="http://y"/><summary>s</summary><updated>u</updated></entry></feed>'
    rows = feeds.items_from_feeds(spark.createDataFrame([("r", rss), ("a", atom), ("bad", "<rss>")], "feed string, xml string")).orderBy("feed").collect()
    assert [tuple(r) for r in rows] == [("a", "T", "http://y", "s", "u"), ("r", "A & B", "http://x", "c", "d")]
    post = '{"data": {"children": [{"data": {"title": "t", "selftext": "b", "score": 1}}]}}'
    row = feeds.posts_from_listings(spark.createDataFrame([("b", post)], "board string, json string")).first()
    assert (row.board, row.title, row.body, row.score) == ("b", "t", "b", 1)


def test_comparison_takes_all_strategies(spark):
    from candela.operators import strategies
    from candela.plans import catalog

    rows = catalog.QUERIES["compare_strategies"](spark, "/root/testdata/sf0.001").collect()
    symbols = {r.symbol for r in rows}
    assert {(r.symbol, r.strategy) for r in rows} == {(s, k) for s in symbols for k in strategies.STRATEGIES}
    assert all(sorted(r["rank"] for r in rows if r.symbol == s) == list(range(1, 7)) for s in symbols)


LEXICON = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "great": 3.1, "sux": -1.5, "uncompelling": -0.9}


@pytest.mark.parametrize(
    ("text", "compound"),
    [
        ("VADER is smart, handsome, and funny.", 0.8316), ("VADER is smart, handsome, and funny!", 0.8439), ("VADER is very smart, handsome, and funny.", 0.8545), ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227), ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
        ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469), ("VADER is not smart, handsome, nor funny.", -0.7424), ("The book was good.", 0.4404), ("At least it isn't a horrible book.", 0.431), ("The book was only kind of good.", 0.3832),
        ("The plot was good, but the characters are uncompelling and the dialog is not great.", -0.7042), ("Today SUX!", -0.5461), ("", 0.0), (None, 0.0), ("nothing known", 0.0),
    ],
)
def test_rules_give_the_published_scores(spark, text, compound):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    row = sentiment.score_texts(spark.createDataFrame([(1, text)], "id long, text string"), lexicon, ["id"]).first()
    assert row.compound == compound and row.final_score == compound
    if text == "VADER is smart, handsome, and funny.":
        assert (round(row.pos, 3), round(row.neu, 3), row.neg) == (0.746, 0.254, 0.0)


def test_joined_scores_equal_those_in_place(spark, monkeypatch):
    lexicon = spark.createDataFrame([("the", 0.5), ("The", 0.5), ("the", 0.1), ("of", -0.4), ("a", -2.0), (None, 1.0), ("x", None), ("été", 1.0), ("don't", -1.0)], "word string, valence double")
    rows = [(0, "the the of a cat"), (1, ""), (2, None), (3, "dog's day don't"), (4, "A of the THE"), (None, "the été"), (None, "of"), (7, "the"), (7, "a, a"), (7, "a, a"), (8, "_the_ ÉTÉ")]
    texts = spark.createDataFrame(rows, "id long, text string")
    found = sentiment.lexicon_scores(texts, lexicon, ["id"], method="plain")
    assert "Python" not in found._jdf.queryExecution().toString()
    here = sorted(map(str, found.collect()))
    monkeypatch.setattr(sentiment, "MOST_WORDS", 3)
    assert here == sorted(map(str, sentiment.lexicon_scores(texts, lexicon, ["id"], method="plain").collect()))
    by_id = {r.id: r for r in found.where("id in (0, 2, 4)").collect()}
    assert len(here) == len(rows) and by_id[0].compound == round((0.5 + 0.5 - 0.4 - 2) / ((0.5 + 0.5 - 0.4 - 2) ** 2 + 15) ** 0.5, 4) and by_id[2].pos == 0
    with pytest.raises(ValueError):
        sentiment.lexicon_scores(texts, lexicon, ["id"])


def test_repeated_words_take_no_place_in_the_bound(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "MOST_WORDS", 3)
    lexicon = spark.createDataFrame([("same", 1.0)] * 20 + [("good", 2.0), ("bad", -2.0)], "word string, valence double")
    texts = spark.createDataFrame([("good",), ("bad",)], "text string")
    for method in ("plain", "rules"):
        assert [r.compound != 0 for r in sentiment.lexicon_scores(texts, lexicon, method=method).collect()] == [True, True]


def test_native_names_go_to_the_secondary_provider(spark):
    rows = [("BTC-USD", datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 3.0), ("BTC-USD", datetime(2024, 1, 2), None, None, None, None, 0.0), ("ETH", datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 3.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    found, asked = src.Sources(), []
    found.register("first", lambda s: asked.append("first") or bars)
    found.register("second", lambda s: asked.append("second") or bars, secondary=True)
    got, told = found.fetch(spark, " btc-usd", "1d", None, datetime(2024, 1, 10))
    assert asked == ["second"] and got.count() == 1 and told["source_used"] == "second" and (told["canonical_symbol"], told["provider_symbol"]) == ("BTC/USDT", "BTC-USD")
    got, told = found.fetch(spark, "BTC-USD", "4h", None, datetime(2024, 1, 10))
    assert got.isEmpty() and told["warnings"] == ["second: unsupported timeframe"]
    assert found.fetch(spark, "ETH", "4h", None, datetime(2024, 1, 10))[1]["source_used"] == "first"
    assert found.fetch(spark, "ETH", "1d", None, datetime(2024, 3, 10))[0].isEmpty()  # 30 days back by default


def test_feeds_fail_only_together(spark):
    good = "<rss><channel><item><title>t</title></item></channel></rss>"
    df = spark.createDataFrame([("a", good), ("b", "<html/>"), ("c", None)], "feed string, xml string")
    assert {(r.feed, r.reason) for r in feeds.feed_failures(df).collect()} == {("b", "malformed"), ("c", "not_fetched")}
    assert [r.title for r in feeds.items_or_error(df).collect()] == ["t"]
    with pytest.raises(ValueError):
        feeds.items_or_error(df.where("feed <> 'a'"))


def test_ticker_with_quotes(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", 10.0, 9.0, 11.0, 2.0), ("a", 2, "2024-01-02 12:00:00", 15.0, 14.0, 16.0, 3.0), ("a", 3, "2024-01-02 13:00:00", 20.0, 19.0, 21.0, 4.0)]
    df = spark.createDataFrame(rows, "s string, id long, t string, p double, b double, a double, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    row = src.latest_ticker(df, "s", "t", "p", "id", "b", "a", "v").first()
    assert (row.price, row.bid, row.ask, row.change_pct_24h, row.volume_24h) == (20.0, 19.0, 21.0, 100.0, 7.0)


def test_rsi_confirmed_by_divergence_enters_less(spark):
    bars = src.bars_from_ticks(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    entries = lambda **o: {(r.symbol, r.ts) for r in strategies.rsi_reversion(bars, oversold=45.0, overbought=55.0, **o).where("signal like '%entry'").collect()}
    shown = {(r.symbol, r.ts) for r in windows.rsi_divergence(recurrence.rsi_frame(bars)).collect()}
    confirmed = entries(confirm=True)
    assert confirmed and confirmed <= shown and len(confirmed) < len(entries())


def test_min_score_drops_low_scores_without_failure(spark):
    bars = src.bars_from_ticks(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    rows = screener.scan(bars, screener.FILTERS).collect()
    least = max(r.score for r in rows)
    assert {r.symbol for r in screener.scan(bars, screener.FILTERS, least).collect()} == {r.symbol for r in rows if r.score >= least}


def test_texts_for_display(spark):
    from candela.functions import display

    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1.23456, "a@b long text", "BUY"), (None, None, None), (nan, "x", "sell"), (inf, "abc", "odd")], "x double, t string, p string")
    c = F.col
    got = [tuple(r) for r in rows.select(display.price_text(c("x")), display.percent_text(c("x")), display.number_text(c("x"), 1), display.clipped(display.unpinged(c("t")), 8), display.mood(c("p"))).collect()]
    assert got == [("1.2346", "1.23%", "1.2", "a@\u200bb ...", "bullish"), ("N/A", "N/A", "N/A", None, "neutral"), ("N/A", "N/A", "N/A", "x", "bearish"), ("N/A", "N/A", "N/A", "abc", "neutral")]
    scores = spark.createDataFrame([(0.75,), (55.0,), (0.1,), (140.0,), (None,)], "s double").select(display.hundredths(c("s")).alias("h")).select("h", display.score_mark(c("h"))).collect()
    assert [tuple(r) for r in scores] == [(75.0, "good"), (55.0, "fair"), (10.0, "poor"), (100.0, "good"), (None, "")]


def test_order_block_scan_measures_impulses_over_the_whole_history(spark):
    wild, flat = [(100, 150, 50, 100, 1)] * 20, (102, 102.5, 101.5, 102, 1)
    calm = [(100, 101, 99, 100, 1), (100, 101, 99, 100, 1), (100, 100.5, 98, 99, 1), (99, 103, 99, 102, 1), *[flat] * 20]
    bars = make(spark, wild + calm)
    found, failed = screener.order_block_scan(bars)
    assert found.where("timeframe = '1h'").count() == 0 and failed.where("timeframe = '1h'").count() == 1
    # the tool sees 24 bars, in whose first no average is known
    assert screener.order_block_scan(bars, fetched=True)[0].where("timeframe = '1h'").first().zone_low == 98
