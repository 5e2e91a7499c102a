"""Operators for symbols of any length, failures by symbol, joins by time, merging bars, quantiles, the data source."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import isolation, joins, quantiles, recurrence, scan
from candela.sources import bars as src
from candela.sources import partials, provider

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
START = datetime(2024, 1, 1)


def walk(symbol, n, seed, gap=0):
    rng = random.Random(seed)
    rows, price, at = [], 100.0, START
    for _ in range(n):
        o, price = price, max(1.0, price + rng.choice([0, 0, 1, -1, 0.3]))
        rows.append((symbol, at, o, max(o, price) + rng.random(), min(o, price) - rng.random(), price, float(rng.randint(0, 9))))
        at += timedelta(hours=1 + (rng.randint(0, 40) if rng.random() < gap else 0))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    rows = walk("A", 900, 1) + walk("B", 300, 2, 0.1) + walk("C", 13, 3) + walk("D", 1, 4) + [("E", START, None, 1.0, 1.0, None, 1.0), ("E", START + timedelta(hours=1), 1.0, float("nan"), 1.0, float("nan"), 1.0)]
    rng = random.Random(9)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, BARS).repartition(3).cache()


KERNELS = {
    "ema": (scan.ema, recurrence.ema_frame),
    "smma": (scan.smma, recurrence.smma_frame),
    "rsi": (scan.rsi, recurrence.rsi_frame),
    "macd": (scan.macd, recurrence.macd_frame),
    "atr": (scan.atr, recurrence.atr_frame),
    "adx": (scan.adx, recurrence.adx_frame),
}


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_scans_equal_walking_each_symbol(bars, name):
    there, here = ({(r.symbol, r.ts): tuple(r)[2:] for r in f(bars).collect()} for f in KERNELS[name])
    assert there.keys() == here.keys() and here
    for k, v in here.items():
        assert [x is None for x in v] == [x is None for x in there[k]]
        assert [x for x in there[k] if x is not None] == pytest.approx([x for x in v if x is not None], abs=1e-9)


def test_a_scan_splits_a_symbol_and_runs_no_python(spark, bars):
    found = scan.ema(bars, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Window" not in plan
    chunks = scan.Chunks.of(bars.where("symbol = 'A'"), ("close",))
    assert chunks.frame.count() > 10 and chunks.frame.agg(F.max(F.size("rows"))).first()[0] <= scan.CHUNK


@pytest.mark.parametrize("size", [2, 3, 1000])
def test_levels_of_a_scan_do_not_change_it(bars, size):
    """Chunks of two bars need ten levels, chunks of 1000 one."""
    chunks = scan._indexed(bars, ("close",), 3600, size).scan(size, y=scan.average(lambda r: r["close"], 0.25))
    got = {(r.symbol, r.ts): (r.i, r.y, r.before_y) for r in chunks.rows("i", "y", "before_y").collect()}
    want = {}
    for symbol, rows in bars.dropna(subset=["close"]).toPandas().sort_values("ts").groupby("symbol"):
        y, before = recurrence.ewm(rows["close"].to_numpy(), 0.25), 0.0
        for i, (t, v) in enumerate(zip(rows["ts"], y, strict=True)):
            want[symbol, t.to_pydatetime()] = (i + 1, v, before)
            before = v
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_scans_of_no_bars(bars):
    assert scan.ema(bars.where("false")).count() == 0 and scan.adx(bars.where("symbol = 'C'")).count() == 0


def test_one_failing_symbol_of_five_leaves_four_results(spark):
    rows = spark.createDataFrame([(s, START + timedelta(hours=h), float(h)) for s in "ABCDE" for h in range(3)] + [(None, START, 1.0)], "symbol string, ts timestamp_ntz, close double")

    def job(pdf):
        if pdf["symbol"].iloc[0] == "C":
            raise ZeroDivisionError("no range")
        return pd.DataFrame({"n": [len(pdf)], "text": ["x"], "nothing": [None]})

    done = isolation.run_jobs(rows, job, "n long, text string, nothing double", least=2)
    assert sorted(map(tuple, isolation.results(done).collect())) == [(s, 3, "x", None) for s in "ABDE"]
    assert sorted(map(str, isolation.failures(done).collect())) == ["Row(symbol='C', reason='ZeroDivisionError: no range')", "Row(symbol=None, reason='insufficient_data')"]
    with pytest.raises(ValueError):
        isolation.run_jobs(rows, job, "symbol string")
    assert isolation.run_jobs(rows.where("false"), job, "n long, text string, nothing double").count() == 0


def ticks_and_quotes(seed, n=400):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    at = lambda: None if rng.random() < 0.03 else START + timedelta(seconds=rng.randint(0, 3000))
    left = [(i, key(), at()) for i in range(n)] + [(1, "hot", START)] * 2 + [(900, "alone", START)]
    right = [(key(), at(), rng.choice([None, float(i)]), i) for i in range(n)] + [("other", START, 1.0, 0)]
    return left, right


@pytest.mark.parametrize("seed, rows, tolerance", [(1, 20, None), (2, 100_000, None), (3, 7, 30_000_000)])
def test_asof_join_equals_looking_back_from_each_row(spark, seed, rows, tolerance):
    left, right = ticks_and_quotes(seed)
    a = spark.createDataFrame(left, "id long, k string, at timestamp_ntz").repartition(3)
    b = spark.createDataFrame(right, "k string, at timestamp_ntz, price double, n long").repartition(3)
    got = joins.asof_join(a, b, ("k",), "at", "at", ("price", "n", "at"), tie=("n",), tolerance=tolerance, bucket_rows=rows)
    assert got.columns == ["id", "k", "at", "price", "n", "at_right"]
    want = []
    for i, k, t in left:
        best = max(((u, n, p) for kk, u, p, n in right if k is not None and kk == k and u is not None and t is not None and u <= t), key=lambda x: x[:2], default=None)
        if best and tolerance is not None and t - best[0] > timedelta(microseconds=tolerance):
            best = None
        want.append((i, k, t, *(best and (best[2], best[1], best[0]) or (None, None, None))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_asof_join_of_no_rows(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id long, k string, at long")
    assert joins.asof_join(a.where("false"), a, ("k",), "at", "at", ("id",)).count() == 0
    assert [tuple(r) for r in joins.asof_join(a, a.where("false"), ("k",), "at", "at", ("id",)).collect()] == [(1, "x", 5, None)]
    with pytest.raises(TypeError):
        joins.asof_join(a, a, ("k",), "k", "k", ("id",))


@pytest.mark.parametrize("seed, part", [(1, 5), (2, 100_000)])
def test_interval_join_equals_comparing_all_pairs(spark, seed, part):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    points = [(i, key(), rng.choice([None, *[rng.randint(-500, 500) for _ in range(30)]])) for i in range(300)] + [(1, "hot", 0)] * 2
    spans = [(i, key(), a, None if rng.random() < 0.03 else a + rng.choice([-3, 0, 0, 1, 2, 7, 64, 900])) for i, a in enumerate(rng.randint(-500, 500) for _ in range(200))]
    a = spark.createDataFrame(points, "id long, k string, t long").repartition(3)
    b = spark.createDataFrame(spans, "id long, k string, low long, high long").repartition(3)
    got = joins.interval_join(a, b, ("k",), "t", "low", "high", ("id",), part_rows=part)
    assert got.columns == ["id", "k", "t", "id_right"]
    want = [(i, k, t, j) for i, k, t in points for j, kk, x, y in spans if k is not None and k == kk and t is not None and y is not None and x <= t <= y]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert joins.interval_join(a, b.where("false"), ("k",), "t", "low", "high", ("id",)).count() == 0


def test_comparisons_read_the_ticks_once(spark, tmp_path):
    from candela.operators import backtest, strategies, structure

    some_ticks(spark).write.parquet(f"{tmp_path}/ticks")
    bars = src.bars_from_ticks(spark.read.parquet(f"{tmp_path}/ticks"))
    for made in (backtest.compare(bars, strategies.STRATEGIES), structure.structure_summary(bars)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "ExistingRDD" in plan


def some_ticks(spark, n=600):
    rng = random.Random(6)
    rows = [(i, rng.choice("AAAB"), START + timedelta(minutes=rng.randint(0, 60 * 24 * 4)), rng.choice([None, float("nan"), *[float(rng.randint(1, 99)) for _ in range(30)]])) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, value double")


def test_merged_parts_equal_the_whole(spark):
    ticks = some_ticks(spark)
    parts = [partials.partial_bars(ticks.where(F.col("event_id") % 4 == k)) for k in range(4)]
    whole = sorted(map(tuple, src.bars_from_ticks(ticks).collect()))
    assert sorted(map(tuple, partials.finished(partials.merged(*parts)).collect())) == whole
    again = partials.merged(partials.merged(parts[3], parts[1]), partials.merged(parts[2], parts[0], parts[0].where("false")))
    assert sorted(map(tuple, partials.finished(again).collect())) == whole


def test_late_ticks_rewrite_the_days_they_touch(spark, tmp_path):
    ticks = some_ticks(spark).cache()
    late = (F.to_date("ts") == "2024-01-02") & (F.col("event_id") % 2 == 0)
    store = partials.BarStore(spark, str(tmp_path / "bars"))
    store.update(ticks.where(~late))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path) for f in names if f.startswith("part-")}
    before = files()
    store.update(ticks.where(late))
    after = files()
    assert {f for f in before if f in after} == {f for f in before if "2024-01-02" not in f} and all(before[f] == after[f] for f in before if f in after)
    assert any("2024-01-02" in f for f in after)
    assert sorted(map(tuple, store.bars().collect())) == sorted(map(tuple, src.bars_from_ticks(ticks).collect()))


@pytest.mark.parametrize("bins, held", [(16, 20), (256, 1000)])
def test_exact_quantiles(spark, bins, held):
    rng = random.Random(7)
    values = {"even": [float(i) for i in range(500)], "steep": [10.0 ** rng.randint(-300, 300) for _ in range(300)], "same": [2.5] * 400, "few": [1.0, -4.0], "mixed": [rng.choice([0.0, -1.5, 7.0, rng.gauss(0, 1e-9)]) for _ in range(400)], None: [3.0, 1.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("few", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = (0.0, 0.25, 0.5, 0.93, 1.0)
    got = {(r.k, r.share): r.quantile for r in quantiles.exact_quantiles(df, ("k",), "v", shares, bins, held).collect()}
    assert got.keys() == {(k, s) for k in values for s in shares}
    for (k, s), q in got.items():
        assert q == pytest.approx(float(np.quantile(values[k], s)), rel=1e-12, abs=1e-300)
    assert quantiles.exact_quantiles(df.where("false"), ("k",), "v", shares).count() == 0


def steps(symbol, timeframe, start, end, options):
    """A provider for the tests: a bar each hour of the year, and some beyond what it was asked for; one symbol fails."""
    if symbol == "bad":
        raise RuntimeError("no such market")
    first = datetime(2024, 1, 1)
    n = int((end - first).total_seconds() // 3600) + 2
    return [(first + timedelta(hours=h), 1.0, 2.0, 0.5, float(h), 1.0) for h in range(n)]


def test_data_source_pushes_symbols_and_times(spark):
    provider.register(spark)
    options = {"provider": "tests.test_scale:steps", "symbols": "A, B,bad", "timeframe": "1h", "start": "2024-01-01", "end": "2024-03-01", "page": "100"}
    bars = spark.read.format(provider.NAME).options(**options).load()
    narrow = bars.where("symbol = 'B' and ts >= timestamp_ntz'2024-01-02 00:00:00' and ts < timestamp_ntz'2024-01-08 12:00:00' and close > 30")
    rows = narrow.collect()  # the failing symbol is not asked
    assert sorted(r.close for r in rows) == [float(h) for h in range(31, 24 * 7 + 12)] and {r.symbol for r in rows} == {"B"}
    assert narrow.rdd.getNumPartitions() == 2  # 156 hours in pages of 100
    reader = provider.BarsReader(options)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    rest = list(reader.pushFilters([In(("symbol",), ("B", "X")), GreaterThan(("ts",), datetime(2024, 1, 5)), LessThanOrEqual(("ts",), datetime(2024, 1, 6)), EqualTo(("close",), 1.0)]))
    assert [f.attribute for f in rest] == [("close",)] and reader.symbols == ["B"]
    (page,) = reader.partitions()
    assert (page.start, page.end) == (datetime(2024, 1, 5, 0, 0, 0, 1), datetime(2024, 1, 6, 0, 0, 0, 1))
    assert bars.where("symbol = 'none'").count() == 0
    with pytest.raises(Exception, match="no such market"):
        bars.where("symbol = 'bad'").count()
    with pytest.raises(ValueError):
        provider.BarsReader(options | {"page": "100000"})
