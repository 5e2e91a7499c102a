import time

import pytest
from pyspark.sql import functions as F

from candela import api
from candela.sources import bars as src
from candela.streaming.bars import streamed_bars, streamed_ema, streamed_sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def market(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = spark.createDataFrame([("the", 0.5), ("of", -0.2)], "word string, valence double")
    posts = docs.select(F.concat(F.lit("BTC "), F.substring("text", 1, 40)).alias("title"), F.col("text").alias("body"))
    items = docs.select(F.lit("bitcoin").alias("title"), F.substring("text", 1, 60).alias("description"))
    levels = spark.createDataFrame([("click", "bid", 1.0, 2.0), ("click", "ask", 1.5, 2.0)], "symbol string, side string, price double, amount double")
    return api.Market(src.bars_from_ticks(events).cache(), events, levels, posts, items, lexicon)


def test_there_are_21_tools():
    assert len(api.TOOLS) == 21


CALLS = {
    "fetch_ticker": {}, "fetch_klines": {"symbol": "click", "timeframe": "4h"}, "fetch_orderbook": {"symbol": "click"}, "indicator_rsi": {"symbol": "click"}, "backtest_pdh_session": {"symbol": "click"}, "backtest_rsi": {},
    "backtest_vwap": {"symbol": "click"}, "backtest_ema_stack": {}, "backtest_order_blocks": {}, "backtest_elliot_wave": {}, "compare_strategies": {"ids": ["rsi", "elliot_wave"]}, "screener_scan": {"symbols": ["CLICK", "view"]},
    "session_breakout_scan": {}, "order_block_screener_scan": {}, "calculate_volume_profile": {"symbol": "click"}, "detect_order_blocks": {"symbol": "click"}, "calculate_fibonacci": {"symbol": "click"},
    "calculate_tpo": {"symbol": "click", "row_size": 5.0}, "detect_elliot_wave": {"symbol": "click"}, "get_market_structure": {}, "get_combined_sentiment_dashboard": {"symbol": "BTCUSDT"},
}


@pytest.mark.parametrize("name", api.TOOLS)
def test_each_tool_gives_data(market, name):
    answer = getattr(market, name)(**CALLS[name])
    if name == "order_block_screener_scan":  # these bars hold no active block, so all symbols fail
        assert answer["error"]["code"] == api.ERRORS["data_source"]
        return
    assert answer["success"], answer
    assert answer["data"] is not None


def test_scans_name_symbols_without_bars(market):
    answer = market.screener_scan(symbols=["click", "nosuch", " click"])
    assert answer["success"] and [r["symbol"] for r in answer["data"]["results"]] == ["click"]
    assert answer["data"]["failures"] == [{"symbol": "NOSUCH", "reason": "no_data"}]
    assert market.screener_scan(symbols=["nosuch"])["error"]["code"] == api.ERRORS["data_source"]
    assert market.screener_scan(symbols=["click"], min_score=100.0)["success"]


def test_long_answers_are_refused_not_cut(market, monkeypatch):
    monkeypatch.setattr(api, "records", lambda df, most=3, f=api.records: f(df, most))
    assert market.fetch_klines(symbol="click", limit=3)["success"]
    assert market.fetch_klines(symbol="click", limit=4)["error"]["code"] == api.ERRORS["parameter"]


@pytest.mark.parametrize(("name", "options", "kind"), [("fetch_klines", {"symbol": "?"}, "symbol"), ("fetch_klines", {"symbol": "nothing"}, "data_not_found"), ("fetch_klines", {"symbol": "click", "timeframe": "2h"}, "timeframe"), ("fetch_klines", {"symbol": "click", "exchange": "x"}, "exchange"), ("compare_strategies", {"ids": ["rsi"]}, "parameter"), ("screener_scan", {"min_score": 101}, "parameter"), ("calculate_tpo", {"symbol": "click", "row_size": -1}, "validation")])
def test_refusals_have_codes(market, name, options, kind):
    answer = getattr(market, name)(**options)
    assert not answer["success"] and answer["error"]["code"] == api.ERRORS[kind]


def test_streamed_bars_equal_bars(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = events.agg(F.max("ts")).first()[0]
    late = spark.createDataFrame([(10**9, end + __import__("datetime").timedelta(days=2), 1, "zz", 1.0, "{}")], events.schema)
    for k, part in enumerate((events, late)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    done = streamed_bars(stream).writeStream.format("memory").queryName("bars").outputMode("append").start()
    done.processAllAvailable()
    done.stop()
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars").where("symbol <> 'zz'").collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in src.bars_from_ticks(events).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def _streamed(spark, tmp_path, rows, made, name):
    """What a stream gives for files that come one after the other."""
    for part in rows:
        part.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    done = made(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    done.processAllAvailable()
    done.stop()
    return spark.table(name).collect()


def test_streamed_ema_equals_the_batch(spark, tmp_path):
    from candela.operators.recurrence import ema_frame

    bars = src.bars_from_ticks(spark.read.parquet(f"{SF}/events.parquet"))
    late = bars.where("ts < '2024-01-02'").withColumn("close", F.lit(1e9))
    got = _streamed(spark, tmp_path, [bars.where("ts < '2024-01-15'"), bars.where("ts >= '2024-01-15'"), late], streamed_ema, "ema")
    want = {(r.symbol, r.ts): r.ema for r in ema_frame(bars).collect()}
    assert {(r.symbol, r.ts): r.ema for r in got} == want and len(got) == len(want)  # late bars change nothing


def test_streamed_sessions_end_by_a_gap(spark, tmp_path):
    rows = spark.sql("select 'a' as symbol, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h) as ts from values (0), (1), (2), (8), (9), (40) as t(h)")
    got = _streamed(spark, tmp_path, [rows, rows.select("symbol", (F.col("ts") + F.expr("interval 20 days")).alias("ts"))], streamed_sessions, "sessions")
    assert [r.bars for r in sorted(got, key=lambda r: r.start)][:3] == [3, 2, 1]


def test_written_bars_are_read_again(spark, tmp_path):
    bars = src.bars_from_ticks(spark.read.parquet(f"{SF}/events.parquet"))
    src.write_bars(bars, f"{tmp_path}/bars")
    again = src.read_bars(spark, f"{tmp_path}/bars")
    assert sorted(map(tuple, again.select(*bars.columns).collect())) == sorted(map(tuple, bars.collect()))
    plan = again.where("symbol = 'click'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan
