"""A Python data source of bars: `spark.read.format("candela_bars")`, with partitions by symbol and time and pushed filters.

A provider is a function named as `module:function`. It is called in the tasks with (symbol, timeframe, start, end, options) for a
range of at most `page` bars, and gives rows (ts, open, high, low, close, volume) or an Arrow table of these columns, in any
order. What it gives outside its range is left out. Filters on `symbol` and `ts` choose symbols and cut the range before
partitions are laid out, so a narrow query asks the provider for what it needs, and no more.

Options: provider; symbols (comma-separated); timeframe; start and end (ISO times, end exclusive); page (at most 1000); all
options go to the provider. Cases: no symbol or an empty range gives no partition; a provider that raises fails its task, and
Spark tries it again; repeated bars stay as given.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schema import BARS, MAX_LIMIT, TIMEFRAME_SECONDS

NAME = "candela_bars"
_PRICES = pa.schema([("ts", pa.timestamp("us")), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "volume")]])
_ARROW = pa.schema([("symbol", pa.string()), *_PRICES])


@dataclass
class Page(InputPartition):
    symbol: str
    start: datetime
    end: datetime


class BarsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.timeframe = options.get("timeframe", "1h")
        self.symbols = list(dict.fromkeys(s.strip() for s in options.get("symbols", "").split(",") if s.strip()))
        self.start, self.end = (datetime.fromisoformat(options[k]).replace(tzinfo=None) for k in ("start", "end"))
        self.page = int(options.get("page", MAX_LIMIT))
        if not 1 <= self.page <= MAX_LIMIT:
            raise ValueError(f"page is from 1 to {MAX_LIMIT}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take filters on symbol and ts; give back the others, which Spark applies."""
        for f in filters:
            name = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            tick = timedelta(microseconds=1)
            if name == ("symbol",) and isinstance(f, EqualTo):
                self.symbols = [s for s in self.symbols if s == value]
            elif name == ("symbol",) and isinstance(f, In):
                self.symbols = [s for s in self.symbols if s in f.value]
            elif name == ("ts",) and isinstance(value, datetime) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                value = value.replace(tzinfo=None)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, value + tick if isinstance(f, GreaterThan) else value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, value if isinstance(f, LessThan) else value + tick)
            else:
                yield f

    def partitions(self) -> list[Page]:
        step = timedelta(seconds=TIMEFRAME_SECONDS[self.timeframe] * self.page)
        out = []
        for s in self.symbols:
            at = self.start
            while at < self.end:
                out.append(Page(s, at, min(at + step, self.end)))
                at += step
        return out or [Page("", self.start, self.start)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        module, _, name = self.options["provider"].partition(":")
        found = getattr(importlib.import_module(module), name)(partition.symbol, self.timeframe, partition.start, partition.end, self.options)
        if not isinstance(found, pa.Table):
            columns = list(zip(*found, strict=True)) or [[]] * 6
            found = pa.table({f.name: pa.array(c, f.type) for f, c in zip(_PRICES, columns, strict=True)})
        found = found.select(_PRICES.names).cast(_PRICES)
        inside = pc.and_(pc.greater_equal(found["ts"], pa.scalar(partition.start, pa.timestamp("us"))), pc.less(found["ts"], pa.scalar(partition.end, pa.timestamp("us"))))
        found = found.filter(inside)
        yield from pa.table([pa.array([partition.symbol] * found.num_rows, pa.string()), *found.columns], schema=_ARROW).to_batches()


class BarsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return BARS

    def reader(self, schema) -> BarsReader:
        return BarsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarsSource)


def bars_of_ticks(symbol: str, timeframe: str, start: datetime, end: datetime, options: dict[str, str]) -> pa.Table:
    """A provider over a Parquet table of ticks (option `path`): the bars of one page, from the row groups that its range touches."""
    import pyarrow.dataset as ds

    key, at, price, tie = (options.get(k, v) for k, v in (("symbolcolumn", "event_type"), ("timecolumn", "ts"), ("pricecolumn", "value"), ("tiecolumn", "event_id")))
    seconds = TIMEFRAME_SECONDS[timeframe]
    # whole bars, as a range may begin within one
    first, last = (datetime(1970, 1, 1) + timedelta(seconds=int((t - datetime(1970, 1, 1)).total_seconds() // seconds + k) * seconds) for t, k in ((start, 0), (end, 1)))
    rule = (ds.field(key) == symbol) & (ds.field(at) >= pa.scalar(first, pa.timestamp("us"))) & (ds.field(at) < pa.scalar(last, pa.timestamp("us"))) & ds.field(price).is_valid()
    rows = ds.dataset(options["path"]).to_table(columns=[at, price, tie], filter=rule).sort_by([(at, "ascending"), (tie, "ascending")])
    micros = pc.cast(rows[at], pa.timestamp("us")).cast(pa.int64())
    width = seconds * 1_000_000
    bar = pc.multiply(pc.floor(pc.divide(micros.cast(pa.float64()), float(width))).cast(pa.int64()), width).cast(pa.timestamp("us"))
    table = pa.table({"ts": bar, "p": rows[price].cast(pa.float64())})
    out = table.group_by("ts", use_threads=False).aggregate([("p", "first"), ("p", "max"), ("p", "min"), ("p", "last"), ("p", "count")])
    return pa.table({"ts": out["ts"], "open": out["p_first"], "high": out["p_max"], "low": out["p_min"], "close": out["p_last"], "volume": out["p_count"].cast(pa.float64())})
