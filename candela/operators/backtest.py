"""Backtest engine, metrics, walk-forward evaluation and ranking of strategies.

A signal of one bar is filled at the open of the next. The engine is one pass over a key's bars; the keys (symbol, or
symbol and strategy, or symbol and split) are independent groups of one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import COMMISSION, SLIPPAGE_BPS, commission, slipped
from ..session import checkpointed
from .groups import map_groups

CAPITAL = 100_000.0

# Whole-number signals of older callers.
NUMBERED = {1: "long_entry", -1: "long_exit", 0: "hold"}
KINDS = ("trade", "equity", "error")
ACTIONS = ("long_entry", "long_exit", "short_entry", "short_exit", "hold")


def normalize_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """bars with a signal each: numbers by their names, hold where there is none."""
    kind = dict(signals.dtypes)["signal"]
    if kind == "boolean":
        raise ValueError("signals must not be boolean")
    value = F.col("signal")
    if kind != "string":
        value = reduce(lambda out, known: out.when(F.col("signal") == known[0], known[1]), NUMBERED.items(), F.when(F.lit(False), "hold"))
    given = signals.select("symbol", "ts", value.alias("signal"))
    return bars.join(given, ["symbol", "ts"], "left").withColumn("signal", F.coalesce("signal", F.lit("hold")))


class Engine:
    """Cash, one position at most, and what became of it."""

    def __init__(self, capital: float = CAPITAL, rate: float = COMMISSION, bps: float = SLIPPAGE_BPS):
        self.cash, self.rate, self.bps = capital, rate, bps
        self.side: str | None = None
        self.trades: list[dict] = []
        self.error: str | None = None

    def act(self, action: str, price: float, i: int, ts) -> None:
        if action == "hold" or action not in ACTIONS:
            return
        side, what = action.split("_")
        if what == "entry":
            if self.side is None:
                self.open(side, price, i, ts)
            elif self.side != side:
                raise ValueError(f"{action} while {self.side} at row {i}")
        elif self.side == side:
            self.close(price, i, ts)
        elif self.side is not None:
            raise ValueError(f"{action} while {self.side} at row {i}")

    def open(self, side: str, price: float, i: int, ts) -> None:
        fill = slipped(price, side == "long", self.bps)
        size = round(self.cash / fill, 8) if fill else 0.0
        if size <= 0:
            return
        self.side, self.entry, self.size, self.entry_i, self.entry_ts = side, fill, size, i, ts
        self.fee = commission(fill * size, self.rate)
        self.cash -= self.fee

    def close(self, price: float, i: int, ts) -> None:
        fill = slipped(price, self.side == "short", self.bps)
        sign = 1 if self.side == "long" else -1
        gross = sign * (fill - self.entry) * self.size
        fees = self.fee + commission(fill * self.size, self.rate)
        net = gross - fees - self.size * self.bps / 1e4 * (self.entry + fill) / 2
        self.cash += net
        self.trades.append({"side": self.side, "entry_ts": self.entry_ts, "exit_ts": ts, "entry_price": self.entry, "exit_price": fill, "size": self.size, "gross_pnl": gross, "net_pnl": net, "commission": fees, "bars_held": i - self.entry_i})
        self.side = None

    def equity(self, close: float) -> float:
        if self.side is None:
            return self.cash
        return self.cash + (1 if self.side == "long" else -1) * (close - self.entry) * self.size

    def run(self, signals: Sequence[str], open_: Sequence[float], close: Sequence[float], ts: Sequence) -> list[float]:
        """Equity from the second bar on; sides holds the side of the position at each of these bars."""
        out, self.sides = [], []
        for i in range(1, len(signals)):
            self.act(signals[i - 1], open_[i], i, ts[i])
            out.append(self.equity(close[i]))
            self.sides.append(self.side)
        return out


def simulate(signalled: DataFrame, keys: tuple[str, ...] = ("symbol",), capital: float = CAPITAL, rate: float = COMMISSION, bps: float = SLIPPAGE_BPS, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """keys, kind (trade, equity or error; those of `kinds`) and the fields of each; a group with an impossible order gives its error."""
    trade = {"i": "long", "ts": "timestamp_ntz", "equity": "double", "side": "string", "entry_ts": "timestamp_ntz", "exit_ts": "timestamp_ntz", "entry_price": "double", "exit_price": "double", "size": "double", "gross_pnl": "double", "net_pnl": "double", "commission": "double", "bars_held": "long", "error": "string"}

    def run(ts: np.ndarray, open: np.ndarray, close: np.ndarray, signal: np.ndarray) -> dict[str, list]:  # noqa: A002
        engine, ts = Engine(capital, rate, bps), ts.tolist()
        out: dict[str, list] = {n: [] for n in ("kind", *trade)}

        def tell(kind: str, rows: int, **found: Sequence) -> None:
            if kind in kinds:
                for n, held in out.items():
                    held.extend([kind] * rows if n == "kind" else found.get(n, [None] * rows))

        try:
            curve = engine.run(signal.tolist(), open.tolist(), close.tolist(), ts)
            tell("equity", len(curve), i=range(1, len(ts)), ts=ts[1:], equity=curve, side=engine.sides)
            done = engine.trades
            tell("trade", len(done), i=range(1, len(done) + 1), **{n: [t[n] for t in done] for n in (done[0] if done else ())})
        except ValueError as e:
            tell("error", 1, error=[str(e)])
        return out

    given = signalled.select(*keys, "ts", F.col("open").cast("double"), F.col("close").cast("double"), "signal")
    out = map_groups(given, keys, "ts", run, "kind string, " + ", ".join(f"{n} {t}" for n, t in trade.items()))
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in trade.items() if t == "double"})


def trades_of(simulated: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return simulated.where("kind = 'trade'").select(*keys, F.col("i").alias("trade_id"), "side", "entry_ts", "exit_ts", "entry_price", "exit_price", "size", "gross_pnl", "net_pnl", "commission", "bars_held")


def equity_of(simulated: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return simulated.where("kind = 'equity'").select(*keys, "i", "ts", "equity")


def _trade_sums(count: Column) -> list[Column]:
    """Sums over trades, of which rows without net_pnl are none."""
    win, sum_of = F.col("net_pnl") > 0, lambda x: F.coalesce(x, F.lit(0.0))
    return [
        count.alias("total_trades"), F.count_if(win).alias("wins"), F.count_if(~win).alias("losses"), sum_of(F.avg(F.when(win, F.col("net_pnl")))).alias("avg_win"), F.abs(sum_of(F.avg(F.when(~win, F.col("net_pnl"))))).alias("avg_loss"),
        sum_of(F.sum(F.when(win, F.col("net_pnl")))).alias("gain"), F.abs(sum_of(F.sum(F.when(~win, F.col("net_pnl"))))).alias("loss"),
    ]


def _trade_figures() -> list[Column]:
    rate = F.coalesce(F.col("wins") / F.nullif(F.col("total_trades"), F.lit(0)), F.lit(0.0))
    factor = F.when(F.col("loss") > 0, F.col("gain") / F.nullif("loss", F.lit(0.0))).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(0.0)
    return ["total_trades", rate.alias("win_rate"), "wins", "losses", "avg_win", "avg_loss", factor.alias("profit_factor"), (rate * F.col("avg_win") - (1 - rate) * F.col("avg_loss")).alias("expectancy")]


def _with_moves(equity: DataFrame, w: Window) -> DataFrame:
    """Adds down, the distance to the highest equity so far, and r, the move since the row before."""
    peak, before = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lag("equity").over(w)
    return equity.withColumns({"down": (F.col("equity") - peak) / peak, "r": (F.col("equity") - before) / F.nullif(before, F.lit(0.0))})


def _equity_sums() -> list[Column]:
    return [F.max_by("equity", F.when(F.col("equity").isNotNull(), F.col("i"))).alias("final_equity"), F.abs(F.min("down")).alias("max_drawdown"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std")]


def _equity_figures(capital: float) -> list[Column]:
    sharpe = F.when(F.col("std") > 0, math.sqrt(252) * F.col("mean") / F.nullif("std", F.lit(0.0))).otherwise(0.0)
    return ["final_equity", ((F.col("final_equity") - capital) / capital).alias("total_return"), "max_drawdown", sharpe.alias("sharpe_ratio")]


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts, mean win and loss, profit factor (infinite without losses) and expectancy."""
    return trades.groupBy(*keys).agg(*_trade_sums(F.count("*"))).select(*keys, *_trade_figures())


def equity_stats(equity: DataFrame, keys: tuple[str, ...] = ("symbol",), capital: float = CAPITAL) -> DataFrame:
    """Total return, largest drawdown (the capital at the start is no peak) and Sharpe ratio over 252 bars a year."""
    rows = _with_moves(equity.select(*keys, "i", "equity"), Window.partitionBy(*keys).orderBy("i"))
    return rows.groupBy(*keys).agg(*_equity_sums()).select(*keys, *_equity_figures(capital))


def outcomes(simulated: DataFrame, keys: tuple[str, ...] = ("symbol",), capital: float = CAPITAL) -> DataFrame:
    """One row a key: all figures of its trades and equity, whether a position is open at the end, and the error of a key that failed.

    Trades, equity and errors are summed up in one pass over what the engine gave.
    """
    rows = _with_moves(simulated, Window.partitionBy(*keys, "kind").orderBy("i"))
    open_ = F.max_by(F.col("side").isNotNull(), F.when(F.col("kind") == "equity", F.col("i"))).alias("open_position")
    found = rows.groupBy(*keys).agg(*_equity_sums(), *_trade_sums(F.count_if(F.col("kind") == "trade")), open_, F.max("error").alias("error"))
    return found.select(*keys, *_equity_figures(capital), *_trade_figures(), "open_position", "error")


def metrics(simulated: DataFrame, keys: tuple[str, ...] = ("symbol",), capital: float = CAPITAL) -> DataFrame:
    """One row a key: all figures of its trades and equity; zeros where it never traded. Keys that failed have none."""
    return outcomes(simulated, keys, capital).where("final_equity is not null").drop("open_position", "error")


def return_metrics(returns: DataFrame, keys: tuple[str, ...] = ("symbol",), value: str = "r", order: str = "i") -> DataFrame:
    """Sharpe, Sortino, drawdown of the product of returns, and volatility, for rows of returns."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("_g", F.exp(F.sum(F.log1p(value)).over(w)))
    grown = grown.withColumn("_down", F.col("_g") / F.max("_g").over(w) - 1)
    out = grown.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.stddev_pop(F.when(F.col(value) < 0, F.col(value))).alias("down_std"), F.min("_down").alias("max_drawdown"))
    year = math.sqrt(252)
    share = lambda s: F.when(F.col(s) > 0, year * F.col("mean") / F.nullif(s, F.lit(0.0))).otherwise(0.0)
    return out.select(*keys, share("std").alias("sharpe"), share("down_std").alias("sortino"), "max_drawdown", (F.col("std") * year).alias("volatility"))


def plan_splits(rows: int, train: int, test: int, step: int) -> list[tuple[int, int, int]]:
    """(first training row, first test row, end) of each split."""
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be 1 or more")
    out = [(s, s + train, s + train + test) for s in range(0, rows - train - test + 1, step)]
    if not out:
        raise ValueError("not enough rows for one split")
    return out


def splits(bars: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """symbol, split, start, test_start, end (row numbers from 0) for every split that fits in a symbol's rows."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= train + test)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - (train + test), F.lit(step).cast("long"))).alias("start")
    return counts.select("symbol", start).select("symbol", (F.col("start") / step).cast("long").alias("split"), "start", (F.col("start") + train).alias("test_start"), (F.col("start") + train + test).alias("end"))


def walk_forward(bars: DataFrame, strategy: Callable[[DataFrame], DataFrame], train: int, test: int, step: int, capital: float = CAPITAL) -> DataFrame:
    """Metrics of each split: signals from its training and test rows, engine over its test rows from a flat start.

    All splits of all symbols are one query: a split is a symbol of its own to the strategy.
    """
    i = (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long")
    plan = splits(bars, train, test, step)
    # each row goes to the splits that hold it, found by arithmetic rather than by a range join
    rows = bars.withColumn("i", i).withColumn("split", F.explode(F.sequence(F.greatest(F.ceil((F.col("i") - (train + test) + 1) / step), F.lit(0)).cast("long"), F.floor(F.col("i") / step).cast("long"))))
    rows = rows.join(plan, ["symbol", "split"]).where((F.col("i") >= F.col("start")) & (F.col("i") < F.col("end")))
    named = rows.withColumn("name", F.col("symbol")).withColumn("symbol", F.concat_ws("\u0001", "symbol", "split"))
    signals = strategy(named.select("symbol", "ts", "open", "high", "low", "close", "volume"))
    tested = normalize_signals(named.where("i >= test_start"), signals)
    return metrics(simulate(tested, ("symbol",), capital), ("symbol",), capital).withColumn("split", F.element_at(F.split("symbol", "\u0001"), 2).cast("long")).withColumn("symbol", F.element_at(F.split("symbol", "\u0001"), 1))


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    """Mean, best and worst of each symbol's splits; values that are not finite are passed over."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return windows.groupBy("symbol").agg(
        F.count("*").alias("window_count"), F.avg(finite("total_return")).alias("mean_return"), F.avg(finite("sharpe_ratio")).alias("mean_sharpe"), F.max(finite("total_return")).alias("best_return"), F.min(finite("total_return")).alias("worst_return")
    )


def compare(bars: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], capital: float = CAPITAL) -> DataFrame:
    """Figures of each symbol and strategy, ranked within the symbol; a strategy that failed has its error alone and comes last.

    Strategies and their indicators refer to the bars many times, so the bars are made once and put down; they are few beside
    the ticks they come from.
    """
    bars, signals = checkpointed(bars), None
    for name, strategy in strategies.items():
        part = normalize_signals(bars, strategy(bars)).withColumn("strategy", F.lit(name))
        signals = part if signals is None else signals.unionByName(part)
    keys = ("symbol", "strategy")
    found = outcomes(simulate(signals, keys, capital), keys, capital)
    known = set(keys) | {"error"}
    return rank_strategies(found.select(*[c if c in known else F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in found.columns]))


def rank_strategies(rows: DataFrame) -> DataFrame:
    """Rank by return, then Sharpe ratio, then id; values that are not finite come last."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    order: list[Column] = [finite("total_return").desc_nulls_last(), finite("sharpe_ratio").desc_nulls_last(), F.asc("strategy")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)).cast("long"))


def drawdown(equity: np.ndarray) -> float:
    peaks = np.maximum.accumulate(equity)
    return float(abs(((equity - peaks) / peaks).min())) if len(equity) else 0.0
