"""Trades and swings over streams equal those of the batch, whatever order bars come in."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from candela.operators import backtest, strategies, structure
from candela.sources import bars as src
from candela.streaming import ordered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def bars(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('view', 'click', 'error', 'purchase', 'signup') and (event_type <> 'error' or ts < '2024-01-03')")
    return src.bars_from_ticks(events).cache()


def streamed(spark, path, bars, made, name):
    """Three files: halves of the bars in turns of six hours, so that bars of one come after later bars of the other, and a far one."""
    rows = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    turn = F.floor(F.unix_seconds("ts") / 21600) % 2
    far = rows.limit(1).withColumns({"symbol": F.lit("zz"), "ts": F.to_timestamp(F.lit("2025-01-01"))})
    first = rows.where((turn == 0) | (F.col("ts") < "2024-01-10"))
    # some bars come twice
    for part in (first.where("ts < '2024-01-20'"), first.where("ts >= '2024-01-20'").unionByName(rows.where((turn == 1) & (F.col("ts") >= "2024-01-10"))).unionByName(first.limit(5)), far, far.withColumn("ts", F.to_timestamp(F.lit("2025-06-01")))):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    done = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/state").start()
    try:
        done.processAllAvailable()
    finally:
        done.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.table(name).where("symbol <> 'zz'").collect()


def test_streamed_trades_equal_the_batch(spark, bars, tmp_path):
    got = streamed(spark, tmp_path, bars, lambda s: ordered.streamed_trades(s, late="12 days"), "trades")
    batch = backtest.trades_of(backtest.simulate(backtest.normalize_signals(bars, strategies.ema_stack(bars)))).collect()
    names = ("symbol", "side", "entry_ts", "exit_ts", "bars_held")
    key = lambda r: tuple(str(r[n]) for n in names)
    want = {key(r): r for r in batch}
    assert sorted(map(key, got)) == sorted(want) and len(want) > 3
    for r in got:
        assert [r[n] for n in ("entry_price", "exit_price", "size", "net_pnl")] == pytest.approx([want[key(r)][n] for n in ("entry_price", "exit_price", "size", "net_pnl")])


def test_streamed_swings_equal_the_batch(spark, bars, tmp_path):
    got = streamed(spark, tmp_path, bars, lambda s: ordered.streamed_swings(s, late="12 days"), "swings")
    names = ("symbol", "swing_id", "pivot_index", "swing_type", "pivot_ts", "pivot_price", "leg_start_ts", "leg_start_price", "price_delta", "pct_delta")
    rows = structure.swings(bars).collect()
    last = {r.symbol: max(x.swing_id for x in rows if x.symbol == r.symbol) for r in rows}
    want = sorted(str(tuple(r[n] for n in names)) for r in rows if r.swing_id < last[r.symbol])
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == want and len(want) > 50


def test_machines_go_on_from_their_state(bars):
    """Put away and taken up again after every bar, a machine gives what it gives at a stretch."""
    rows = [ordered.SimpleNamespace(at=int(t.timestamp() * 1e6), open=o, high=h, low=x, close=c, volume=v) for _, t, o, h, x, c, v in bars.where("symbol = 'click'").orderBy("ts").collect()]
    for make in (ordered.StackTrades, ordered.SwingMachine):
        whole, state, out = make(), None, []
        want = [r for b in rows for r in whole.step(b)]
        for b in rows:
            machine = make()
            if state is not None:
                machine.load(json.loads(state))
            out += machine.step(b)
            state = json.dumps(machine.dump())
        assert out == want and out
