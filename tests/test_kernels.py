"""Kernels and state machines against hand-made inputs and slow forms."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candela.operators import backtest, profile, recurrence, strategies, structure

PRICES = st.lists(st.floats(1, 1000, allow_nan=False), min_size=1, max_size=60)


def test_ema_is_seeded_by_the_first_value():
    assert recurrence.ema(np.array([1.0, 2.0, 3.0]), 3).tolist() == [1.0, 1.5, 2.25]


@given(PRICES)
@settings(max_examples=50, deadline=None)
def test_ema_equals_pandas(values):
    x = np.array(values)
    assert np.allclose(recurrence.ema(x, 7), pd.Series(x).ewm(span=7, adjust=False).mean())


@given(PRICES)
@settings(max_examples=50, deadline=None)
def test_rsi_is_bounded_and_starts_at_its_seed(values):
    x = recurrence.rsi(np.array(values), 5)
    assert np.isnan(x[:4]).all() and ((x[4:] >= 0) & (x[4:] <= 100)).all()


def test_rsi_of_flat_and_rising_prices():
    assert recurrence.rsi(np.full(20, 5.0))[-1] == 50
    assert recurrence.rsi(np.arange(1.0, 21.0))[-1] == 100


def test_wilder_seed_and_step():
    x = np.array([1.0, 2.0, 3.0, 10.0])
    assert recurrence.wilder(x, 3)[2:].tolist() == [2.0, (2.0 * 2 + 10) / 3]


def test_value_area_grows_left_at_a_tie():
    assert profile.value_area(np.array([1.0, 2, 5, 2, 1]), 2, 0.6) == (1, 2)
    assert profile.value_area(np.zeros(3), 0, 0.7) == (0, 2)
    assert profile.value_area(np.array([5.0, 1, 1]), 0, 0.8) == (0, 1)


@pytest.mark.parametrize(("volumes", "shape"), [([1], "single"), ([0, 0], "flat"), ([100, 1, 1], "single"), ([5, 5, 5, 5], "flat"), ([0, 9, 0, 0, 9, 0], "bimodal")])
def test_profile_shapes(volumes, shape):
    v = np.array(volumes, dtype=float)
    assert profile.profile_shape(v, int(v.argmax())) == shape


def test_swings_replace_and_alternate():
    found = structure.confirm([(2, "high", 10.0), (4, "high", 12.0), (6, "low", 11.9), (8, "low", 8.0), (9, "high", 9.0)], np.full(10, 9.0), 2, 0.05)
    assert [(s["i"], s["kind"], s["price"]) for s in found] == [(4, "high", 12.0), (8, "low", 8.0), (9, "high", 9.0)]
    assert found[0]["from"] == 0 and found[1]["from"] == 4


def test_engine_charges_both_sides():
    engine = backtest.Engine(1000.0, 0.001, 0.0)
    curve = engine.run(["long_entry", "hold", "long_exit", "hold"], [10.0, 10, 10, 11], [10.0, 10, 10, 11], range(4))
    trade = engine.trades[0]
    assert trade["entry_price"] == 10 and trade["exit_price"] == 11 and trade["bars_held"] == 2
    assert trade["net_pnl"] == pytest.approx(100 - 1.0 - 1.1)
    assert curve[-1] == pytest.approx(1000 - 1.0 + 100 - 2.1)


def test_engine_refuses_an_entry_against_the_position():
    with pytest.raises(ValueError):
        backtest.Engine().run(["long_entry", "short_entry", "hold"], [1.0] * 3, [1.0] * 3, range(3))


def test_splits():
    assert backtest.plan_splits(10, 4, 2, 2) == [(0, 4, 6), (2, 6, 8), (4, 8, 10)]
    with pytest.raises(ValueError):
        backtest.plan_splits(5, 4, 2, 1)


def test_drawdown():
    assert backtest.drawdown(np.array([1.0, 2, 1, 3])) == 0.5


def test_last_extremes_look_only_back():
    low, high = strategies.last_extremes(np.array([3.0, 1, 2, 4, 2, 5]), 10)
    assert np.isnan(low[:3]).all() and low[3] == 1 and high[5] == 4


def test_machine_actions_alternate():
    rng = np.random.default_rng(5)
    close = 100 + rng.normal(0, 3, 400).cumsum()
    pdf = pd.DataFrame({"open": close - 0.5, "high": close + 2, "low": close - 2, "close": close, "atr": 2.0, "rsi": recurrence.rsi(close), "cross": None, "divergence": None})
    state = None
    for action in strategies.rsi_machine(pdf):
        if action.endswith("entry"):
            assert state is None
            state = action.split("_")[0]
        elif action.endswith("exit"):
            assert action.startswith(state)
            state = None


def test_running_median_and_first_above_equal_loops():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 100):
        x = rng.integers(0, 9, n).astype(float)
        assert strategies.running_median(x).tolist() == [float(np.median(x[: i + 1])) for i in range(n)]
        start, bound = rng.integers(0, n + 2, 50), rng.integers(0, 10, 50).astype(float)
        want = [next((i for i in range(s, n) if x[i] > b), n) for s, b in zip(start, bound, strict=True)]
        assert structure.first_above(x, start, bound).tolist() == want


def _walk(n: int) -> pd.DataFrame:
    rng = np.random.default_rng(n)
    close = 1000 + rng.normal(0, 1, n).cumsum()
    open_ = np.concatenate([close[:1], close[:-1]]) + rng.normal(0, 0.2, n)
    return pd.DataFrame({"open": open_, "high": np.maximum(open_, close) + 0.5, "low": np.minimum(open_, close) - 0.5, "close": close, "atr": 1.0, "rsi": recurrence.rsi(close), "cross": None, "divergence": None})


@pytest.mark.parametrize("machine", [strategies.block_machine, strategies.wave_machine, strategies.rsi_machine])
def test_machines_take_time_in_proportion_to_the_bars(machine):
    import time

    took = {}
    for n in (5_000, 50_000):
        pdf = _walk(n)
        began = time.process_time()
        assert sum(1 for _ in machine(pdf)) == n
        took[n] = time.process_time() - began
    assert took[50_000] < 30 * max(took[5_000], 0.05)


def test_groups_are_whole_whatever_the_batches(spark):
    """Many small groups and one that passes through several batches, each seen once and whole, in order; no pandas frame a group."""
    from pyspark.sql import functions as F

    from candela.operators.groups import map_groups

    rows = spark.range(30_000).select(F.when(F.col("id") < 25_000, "long").otherwise(F.concat(F.lit("s"), F.floor(F.col("id") / 2))).alias("symbol"), F.timestamp_micros(-F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("x"))
    rows = rows.unionByName(spark.sql("select cast(null as string) as symbol, timestamp_ntz '2024-01-01' as ts, 1.0D as x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = map_groups(rows, ("symbol",), "ts", lambda ts, x: {"n": [len(x)], "sorted": [bool((ts[1:] > ts[:-1]).all())], "last": x[-1:]}, "n long, sorted boolean, last double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2502 and all(r.sorted for r in got)
    assert {r.symbol: (r.n, r.last) for r in got if r.symbol in ("long", None)} == {"long": (25_000, 0.0), None: (1, 1.0)}
    assert {r.n for r in got if r.symbol not in ("long", None)} == {2}


def test_simulation_of_many_symbols_takes_no_milliseconds_a_symbol(spark):
    """20,000 symbols of two bars; with a pandas frame for each this did not end within 100 s."""
    import time

    from pyspark.sql import functions as F

    bars = spark.range(40_000).select(F.floor(F.col("id") / 2).cast("string").alias("symbol"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    began = time.monotonic()
    done = backtest.simulate(backtest.normalize_signals(bars, strategies.rsi_reversion(bars)))
    assert done.where("kind = 'equity'").count() == 20_000
    assert time.monotonic() - began < 25


def test_rules_look_each_plain_word_up_once():
    """The words near are only judged where one of them is of account to a rule."""
    from candela.functions import valence

    class Counted(dict):
        asked = 0

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

    lexicon = Counted({"good": 1.9, "awful": -2.5})
    text = "a good day and a dull, awful day " * 500
    found = valence.ruled(text, lexicon)
    assert lexicon.asked <= 4000 and found["neu"] == pytest.approx(3000 / (3000 + 500 * 2.9 + 500 * 3.5))
    for near in ("not good", "GOOD but awful", "very good", "isn't so good", "no good or awful", "kind of good"):
        assert valence.ruled(near, lexicon) != valence.ruled("good", lexicon)
