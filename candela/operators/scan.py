"""Recurrences y = m y + c over long symbols: a prefix scan of affine maps, in DataFrame functions alone.

The maps of consecutive rows compose to one map, so a symbol need not be walked in one task. Bars are gathered into chunks
of `CHUNK` bars of time; each chunk's maps are composed to one; the chunks' maps are composed again by `CHUNK`, as often as
the range of time needs, until a symbol has one group. Coming down, each group gives its members the value they begin
with, and at last each chunk is folded from its own. Bars are dealt once, by symbol and chunk; what is joined to them later are
a few numbers for each chunk, so a symbol of any length is split over all tasks and no Python worker runs.

Several recurrences run in one scan, and later scans may use what earlier ones gave: indexes and previous closes first,
averages next, averages of averages last.

Cases: rows with a null or NaN in a column that is used take no part; symbols with fewer rows than an indicator needs have
no rows; repeated times are ordered by the values; gaps in time only make chunks smaller; an empty table gives an empty
result. A chunk is a range of time, so it holds more rows than `CHUNK` where bars are closer than `seconds`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bars of a chunk, and chunks of a group.
CHUNK = 64

#: For an element of a chunk, the factor and the summand of its map.
Map = Callable[[Column], tuple[Column, Column]]


def number(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


class Chunks:
    """Rows of each symbol in chunks of time: symbol, chunk, rows (array of structs that begin with ts)."""

    def __init__(self, frame: DataFrame, levels: int):
        self.frame, self.levels = frame, levels

    @classmethod
    def of(cls, bars: DataFrame, columns: tuple[str, ...], seconds: int = 3600, size: int = CHUNK) -> Chunks:
        """seconds: the usual time from bar to bar."""
        good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])
        chunk = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (seconds * size))
        rows = bars.where(good).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in columns], chunk.alias("chunk"))
        low, high = rows.agg(F.min("chunk"), F.max("chunk")).first()
        levels, reach = 1, size
        while low is not None and high - low + 1 > reach:
            levels, reach = levels + 1, reach * size
        return cls(rows.groupBy("symbol", "chunk").agg(F.sort_array(F.collect_list(F.struct("ts", *columns))).alias("rows")), levels)

    def fields(self) -> list[str]:
        return self.frame.schema["rows"].dataType.elementType.names

    def add(self, **columns: Callable[[Column], Column]) -> Chunks:
        """Each row with more fields made of its own."""
        keep = self.fields()
        rows = F.transform("rows", lambda r: F.struct(*[r[k].alias(k) for k in keep], *[f(r).alias(n) for n, f in columns.items()]))
        return Chunks(self.frame.select("symbol", "chunk", rows.alias("rows")), self.levels)

    def scan(self, size: int = CHUNK, **states: Map) -> Chunks:
        """Each row with the value of each state after it, and as `before_` the value before it (0 before the first row)."""
        names, keep = list(states), self.fields()
        maps = F.struct(*[F.struct(number(1.0).alias("m"), number(0.0).alias("c")).alias(n) for n in names])

        def compose(done: Column, r: Column) -> Column:
            steps = {n: f(r) for n, f in states.items()}
            return F.struct(*[F.struct((number(m) * done[n]["m"]).alias("m"), (number(m) * done[n]["c"] + number(c)).alias("c")).alias(n) for n, (m, c) in steps.items()])

        whole = self.frame.select("symbol", "chunk", F.aggregate("rows", maps, compose).alias("map"))
        begin = _values_before(whole, names, self.levels, size)
        joined = self.frame.join(begin.withColumnRenamed("symbol", "_s").withColumnRenamed("chunk", "_k"), F.expr("symbol <=> _s and chunk = _k")).select("symbol", "chunk", "rows", "begin")
        zero = F.struct(F.col("begin").alias("y"), F.transform(F.slice("rows", 1, 0), lambda r: _row(r, keep, names, lambda n: number(0.0), lambda n: number(0.0))).alias("out"))

        def step(done: Column, r: Column) -> Column:
            after = {n: number(f(r)[0]) * done["y"][n] + number(f(r)[1]) for n, f in states.items()}
            one = _row(r, keep, names, lambda n: after[n], lambda n: done["y"][n])
            return F.struct(F.struct(*[after[n].alias(n) for n in names]).alias("y"), F.array_append(done["out"], one).alias("out"))

        return Chunks(joined.select("symbol", "chunk", F.aggregate("rows", zero, step, lambda done: done["out"]).alias("rows")), self.levels)

    def rows(self, *columns: str) -> DataFrame:
        return self.frame.select("symbol", F.inline("rows")).select("symbol", "ts", *columns)


def _row(r: Column, keep: list[str], names: list[str], after: Callable[[str], Column], before: Callable[[str], Column]) -> Column:
    rest = [r[k].alias(k) for k in keep if k not in names and k not in {f"before_{n}" for n in names}]
    return F.struct(*rest, *[after(n).alias(n) for n in names], *[before(n).alias(f"before_{n}") for n in names])


def _values_before(maps: DataFrame, names: list[str], levels: int, size: int) -> DataFrame:
    """symbol, chunk and the values that the chunk begins with, from the map of each chunk."""
    grouped = maps.withColumn("up", F.floor(F.col("chunk") / size)).groupBy("symbol", "up" if levels > 1 else F.lit(0).alias("up")).agg(F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("members"))
    if levels > 1:
        unit = F.struct(*[F.struct(number(1.0).alias("m"), number(0.0).alias("c")).alias(n) for n in names])
        join = lambda done, x: F.struct(*[F.struct((x["map"][n]["m"] * done[n]["m"]).alias("m"), (x["map"][n]["m"] * done[n]["c"] + x["map"][n]["c"]).alias("c")).alias(n) for n in names])
        above = _values_before(grouped.select("symbol", F.col("up").alias("chunk"), F.aggregate("members", unit, join).alias("map")), names, levels - 1, size)
        grouped = grouped.join(above.withColumnRenamed("symbol", "_s").withColumnRenamed("chunk", "_k"), F.expr("symbol <=> _s and up = _k")).select("symbol", "members", "begin")
    else:
        grouped = grouped.select("symbol", "members", F.struct(*[number(0.0).alias(n) for n in names]).alias("begin"))
    empty = F.transform(F.slice("members", 1, 0), lambda x: F.struct(x["chunk"].alias("chunk"), F.struct(*[number(0.0).alias(n) for n in names]).alias("begin")))

    def step(done: Column, x: Column) -> Column:
        after = F.struct(*[(x["map"][n]["m"] * done["y"][n] + x["map"][n]["c"]).alias(n) for n in names])
        return F.struct(after.alias("y"), F.array_append(done["out"], F.struct(x["chunk"].alias("chunk"), done["y"].alias("begin"))).alias("out"))

    told = F.aggregate("members", F.struct(F.col("begin").alias("y"), empty.alias("out")), step, lambda done: done["out"])
    return grouped.select("symbol", F.inline(told))


def index(r: Column) -> tuple[Column, Column]:
    """The number of the row in its symbol, from 1."""
    return F.lit(1.0), F.lit(1.0)


def last(column: str) -> Map:
    """The column itself; the value before is that of the previous row."""
    return lambda r: (F.lit(0.0), r[column])


def average(value: Callable[[Column], Column], alpha: float) -> Map:
    """y + alpha (x - y), begun with the first x."""
    return lambda r: (F.when(r["i"] == 1, 0.0).otherwise(1 - alpha), F.when(r["i"] == 1, value(r)).otherwise(value(r) * alpha))


def smoothed(value: Callable[[Column], Column], n: int) -> Map:
    """The mean of the first n, then (y (n - 1) + x) / n: a running mean whose number of rows stops at n."""
    return lambda r: ((F.least(r["i"], F.lit(float(n))) - 1) / F.least(r["i"], F.lit(float(n))), value(r) / F.least(r["i"], F.lit(float(n))))


def _enough(chunks: Chunks, least: int, columns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows of symbols with `least` rows or more."""
    found = chunks.add(**{f"out_{n}": f for n, f in columns.items()})
    sizes = chunks.frame.groupBy("symbol").agg(F.sum(F.size("rows")).alias("_n")).where(F.col("_n") >= least).select(F.col("symbol").alias("_s"))
    rows = found.rows(*[F.col(f"out_{n}").alias(n) for n in columns])
    return rows.join(sizes, F.col("symbol").eqNullSafe(F.col("_s")), "left_semi")


def _value(name: str) -> Callable[[Column], Column]:
    return lambda r: r[name]


def _indexed(bars: DataFrame, columns: tuple[str, ...], seconds: int, size: int = CHUNK) -> Chunks:
    """Rows with their number `i` and the values before them."""
    return Chunks.of(bars, columns, seconds, size).scan(size, i=index, **{f"last_{c}": last(c) for c in columns})


def _true_range(r: Column) -> Column:
    span = r["high"] - r["low"]
    return F.when(r["i"] == 1, span).otherwise(F.greatest(span, F.abs(r["high"] - r["before_last_close"]), F.abs(r["low"] - r["before_last_close"])))


def ema_stack(bars: DataFrame, periods: tuple[int, ...] = (7, 25, 50, 200), seconds: int = 3600) -> DataFrame:
    chunks = _indexed(bars, ("close",), seconds).scan(**{f"ema{n}": average(_value("close"), 2 / (n + 1)) for n in periods})
    return _enough(chunks, max(periods), {f"ema{n}": _value(f"ema{n}") for n in periods})


def ema(bars: DataFrame, n: int = 7, seconds: int = 3600) -> DataFrame:
    return ema_stack(bars, (n,), seconds).withColumnRenamed(f"ema{n}", "ema")


def smma(bars: DataFrame, n: int = 14, seconds: int = 3600) -> DataFrame:
    chunks = _indexed(bars, ("close",), seconds).scan(y=smoothed(_value("close"), n))
    return _enough(chunks, n, {"smma": lambda r: F.when(r["i"] >= n, r["y"])})


def atr(bars: DataFrame, n: int = 14, seconds: int = 3600) -> DataFrame:
    chunks = _indexed(bars, ("high", "low", "close"), seconds).scan(y=smoothed(_true_range, n))
    return _enough(chunks, n, {"atr": lambda r: F.when(r["i"] >= n, r["y"])})


def rsi(bars: DataFrame, n: int = 14, method: str = "smma", seconds: int = 3600) -> DataFrame:
    """The first change is taken as 0; 50 where nothing moved, 100 where nothing fell."""
    if method not in ("smma", "ema"):
        raise ValueError("method is smma or ema")
    change = lambda r: F.when(r["i"] == 1, 0.0).otherwise(r["close"] - r["before_last_close"])
    rule = (lambda f: smoothed(f, n)) if method == "smma" else (lambda f: average(f, 2 / (n + 1)))
    zero = F.lit(0.0)
    chunks = _indexed(bars, ("close",), seconds).scan(up=rule(lambda r: F.greatest(change(r), zero)), down=rule(lambda r: F.greatest(-change(r), zero)))

    def value(r: Column) -> Column:
        ratio = 100 - 100 / (1 + r["up"] / F.nullif(r["down"], zero))
        found = F.when(r["down"] == 0, F.when(r["up"] == 0, 50.0).otherwise(100.0)).otherwise(F.greatest(F.least(ratio, F.lit(100.0)), zero))
        return F.when(r["i"] >= n, found) if method == "smma" else found

    return _enough(chunks, n + 1, {"close": _value("close"), "rsi": value})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, seconds: int = 3600) -> DataFrame:
    chunks = _indexed(bars, ("close",), seconds).scan(a=average(_value("close"), 2 / (fast + 1)), b=average(_value("close"), 2 / (slow + 1)))
    chunks = chunks.add(line=lambda r: r["a"] - r["b"]).scan(s=average(_value("line"), 2 / (signal + 1)))
    return _enough(chunks, slow, {"macd": _value("line"), "signal": _value("s"), "histogram": lambda r: r["line"] - r["s"]})


def adx(bars: DataFrame, n: int = 14, seconds: int = 3600) -> DataFrame:
    up = lambda r: F.when(r["i"] == 1, 0.0).otherwise(r["high"] - r["before_last_high"])
    down = lambda r: F.when(r["i"] == 1, 0.0).otherwise(r["before_last_low"] - r["low"])
    plus = lambda r: F.when((up(r) > down(r)) & (up(r) > 0), up(r)).otherwise(0.0)
    minus = lambda r: F.when((down(r) > up(r)) & (down(r) > 0), down(r)).otherwise(0.0)
    share = lambda x, of: F.coalesce(100 * x / F.nullif(of, F.lit(0.0)), F.lit(0.0))
    chunks = _indexed(bars, ("high", "low", "close"), seconds).scan(tr=average(_true_range, 1 / n), p=average(plus, 1 / n), m=average(minus, 1 / n))
    chunks = chunks.add(plus_di=lambda r: share(r["p"], r["tr"]), minus_di=lambda r: share(r["m"], r["tr"]))
    chunks = chunks.add(dx=lambda r: share(F.abs(r["plus_di"] - r["minus_di"]), r["plus_di"] + r["minus_di"])).scan(a=average(_value("dx"), 1 / n))
    return _enough(chunks, 2 * n, {"adx": _value("a"), "plus_di": _value("plus_di"), "minus_di": _value("minus_di")})
