"""State machines over streams of bars: rows of a symbol in order of their time, with state that outlives the batches.

A bar waits until the watermark has passed it; a timer then releases all waiting bars in order, so what comes in any order
within `late` gives what the batch gives. State is kept by symbol in the state store, as rows of the waiting bars and one value of
the machine, so a symbol's past is never read again, and a restart goes on where the last batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.backtest import CAPITAL, Engine
from ..operators.strategies import Position, StackMachine
from ..schema import OHLCV

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Steps a machine through the bars of each key. A bar of a time that was passed or is waiting already is left out."""

    def __init__(self, make: Callable[[], "Machine"], out: str):
        self.make, self.names = make, T.StructType.fromDDL(out).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, " + ", ".join(f"{c} double" for c in OHLCV))
        self.past = handle.getValueState("past", "last long, machine string")

    def _known(self) -> tuple[int, dict | None]:
        if not self.past.exists():
            return -(1 << 62), None
        last, machine = self.past.get()
        return last, json.loads(machine)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, _ = self._known()
        held = {r[0]: tuple(r) for r in self.waiting.get()}
        new = []
        for frame in rows:
            for r in frame[["at", *OHLCV]].itertuples(index=False):
                if r.at > last and r.at not in held:
                    held[r.at] = tuple(r)
                    new.append((int(r.at), *(float(x) for x in r[1:])))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        out: list[tuple] = []
        if ready:
            _, state = self._known()
            machine = self.make()
            if state is not None:
                machine.load(state)
            for at, *prices in ready:
                out += machine.step(SimpleNamespace(at=at, **dict(zip(OHLCV, prices, strict=True))))
            self.past.update((ready[-1][0], json.dumps(machine.dump())))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if not out:
            return iter(())
        found = pd.DataFrame([(key[0], *r) for r in out], columns=self.names)
        for n in self.names:
            if n.endswith("ts"):
                found[n] = pd.to_datetime(found[n], unit="us", utc=True)
        return iter([found])

    def close(self) -> None:
        pass


class Machine:
    """What a stream steps through: `step` gives rows for a bar, `dump` and `load` its state as plain values."""

    def step(self, bar: SimpleNamespace) -> list[tuple]:
        raise NotImplementedError

    def dump(self) -> dict:
        raise NotImplementedError

    def load(self, state: dict) -> None:
        raise NotImplementedError


def stepped(bars: DataFrame, make: Callable[[], Machine], out: str, late: str = "1 hour") -> DataFrame:
    """The rows that a machine gives for the bars (ts: timestamp) of each symbol in order; out begins with the symbol."""
    use_state_store(bars.sparkSession)
    given = bars.withWatermark("ts", late).select("symbol", "ts", F.unix_micros("ts").alias("at"), *[F.col(c).cast("double").alias(c) for c in OHLCV])
    return given.groupBy("symbol").transformWithStateInPandas(InOrder(make, out), T.StructType.fromDDL(out), "Append", "EventTime")


PERIODS = (7, 25, 50, 200)


class StackTrades(Machine):
    """The strategy of ordered averages and the engine in one: trades as they end.

    As the batch asks for as many bars as the longest average, trades wait until there are so many.
    """

    def __init__(self, capital: float = CAPITAL, **options: float):
        self.machine, self.engine = StackMachine(**options), Engine(capital)
        self.averages: list[float] | None = None
        self.signal, self.count, self.early = "hold", 0, []

    def step(self, bar: SimpleNamespace) -> list[tuple]:
        if self.count:
            self.engine.act(self.signal, bar.open, self.count, bar.at)
        self.averages = [bar.close if self.averages is None else (1 - a) * y + a * bar.close for a, y in zip([2 / (n + 1) for n in PERIODS], self.averages or PERIODS, strict=True)]
        self.signal = self.machine.step(SimpleNamespace(**vars(bar), **{f"ema{n}": y for n, y in zip(PERIODS, self.averages, strict=True)}))
        self.count += 1
        done = [(t["side"], t["entry_ts"], t["exit_ts"], t["entry_price"], t["exit_price"], t["size"], t["net_pnl"], t["bars_held"]) for t in self.engine.trades]
        self.engine.trades = []
        if self.count < max(PERIODS):
            self.early += done
            return []
        done, self.early = self.early + done, []
        return [tuple(t) for t in done]

    def dump(self) -> dict:
        held, e = self.machine.held, self.engine
        position = {k: getattr(e, k) for k in ("side", "entry", "size", "entry_i", "entry_ts", "fee")} if e.side else None
        return {
            "averages": self.averages, "signal": self.signal, "count": self.count, "early": self.early, "cash": e.cash, "position": position,
            "held": held and [held.side, held.stop, held.target], "turns": [self.machine.up, self.machine.down, self.machine.begun],
        }

    def load(self, state: dict) -> None:
        self.averages, self.signal, self.count, self.early = (state[k] for k in ("averages", "signal", "count", "early"))
        self.engine.cash = state["cash"]
        for k, v in (state["position"] or {}).items():
            setattr(self.engine, k, v)
        self.machine.held = state["held"] and Position(*state["held"])
        self.machine.up, self.machine.down, self.machine.begun = state["turns"]


TRADES = "symbol string, side string, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, size double, net_pnl double, bars_held long"


def streamed_trades(bars: DataFrame, late: str = "1 hour", **options: float) -> DataFrame:
    """Trades of the strategy of ordered averages over a stream of bars, each given once, when it has ended."""
    return stepped(bars, lambda: StackTrades(**options), TRADES, late)


class SwingMachine(Machine):
    """Alternating swings; one is given when the next has been confirmed, as until then it may move on."""

    def __init__(self, w: int = 2, least: float = 0.02):
        self.w, self.least = w, least
        self.window: list[list] = []  # the last 2 w + 1 bars: time, high, low, close
        self.count, self.number = 0, 0
        self.last: dict | None = None

    def step(self, bar: SimpleNamespace) -> list[tuple]:
        self.window = [*self.window[-2 * self.w :], [bar.at, bar.high, bar.low, bar.close]]
        self.count += 1
        if len(self.window) <= 2 * self.w:
            return []
        highs, lows = [b[1] for b in self.window], [b[2] for b in self.window]
        out = []
        for kind, price, found in (("low", lows[self.w], lows[self.w] == min(lows) and lows[self.w] < max(lows)), ("high", highs[self.w], highs[self.w] == max(highs) and highs[self.w] > min(highs))):
            if found:
                out += self._met(kind, price)
        return out

    def _met(self, kind: str, price: float) -> list[tuple]:
        here = {"i": self.count - 1 - self.w, "at": self.window[self.w][0], "price": price}
        if self.last is None:
            self.last = {"kind": kind, **here, "from_at": self.window[0][0], "from_price": self.window[0][3]}
        elif self.last["kind"] == kind:
            if price >= self.last["price"] if kind == "high" else price <= self.last["price"]:
                self.last |= here
        else:
            before = self.last["price"]
            if abs(price - before) / (abs(before) if before else 1.0) >= self.least:
                row = self._row()
                self.last = {"kind": kind, **here, "from_at": self.last["at"], "from_price": before}
                return [row]
        return []

    def _row(self) -> tuple:
        s = self.last
        self.number += 1
        delta = s["price"] - s["from_price"]
        return self.number, s["i"], s["kind"], s["at"], s["price"], s["from_at"], s["from_price"], delta, abs(delta) / (abs(s["from_price"]) if s["from_price"] else 1.0)

    def dump(self) -> dict:
        return {k: getattr(self, k) for k in ("window", "count", "number", "last")}

    def load(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, v)


SWING_ROWS = "symbol string, swing_id long, pivot_index long, swing_type string, pivot_ts timestamp, pivot_price double, leg_start_ts timestamp, leg_start_price double, price_delta double, pct_delta double"


def streamed_swings(bars: DataFrame, w: int = 2, min_pct: float = 0.02, late: str = "1 hour") -> DataFrame:
    """The swings of the batch but for the last of each symbol, which may still move."""
    return stepped(bars, lambda: SwingMachine(w, min_pct), SWING_ROWS, late)
