"""Joins by time: the last row at or before a time, and points within intervals. Both split hot keys.

Neither compares all rows of a key with each other, and neither holds a key's rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket of time that an as-of join aims at; points of a part of a bin.
BUCKET_ROWS, PART_ROWS = 100_000, 100_000


def _micros(df: DataFrame, column: str) -> Column:
    """A time or a whole number as a whole number that keeps its order."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(column).cast("long")
    raise TypeError(f"{column} is neither a time nor a whole number")


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(F.col(n)) for m, n in zip(a, b, strict=True)], F.lit(True))


def asof_join(left: DataFrame, right: DataFrame, by: tuple[str, ...], left_at: str, right_at: str, columns: tuple[str, ...], tie: tuple[str, ...] = (), tolerance: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """left with the columns of the last row of right that has the same keys and whose time is not after the row's.

    Both sides are tagged and put in one relation, cut by key and by a bucket of time of about `bucket_rows` rows. A window within each
    bucket gives most answers; what a bucket begins with is the last right row of the buckets before, found among one
    row for each bucket. So a hot key is split by time, and no row meets more than its bucket.

    tie: columns of right that decide between rows of one time, the largest winning, after them `columns` themselves.
    tolerance: rows further back count as none, in microseconds (of times), days (of dates) or units (of numbers). Cases: a left
    row without an answer, or with a null key or time, has nulls; right rows with a null key or time are no answers;
    repeated left rows have an answer each; times are microseconds; a name on both sides gets `_right` at its end.
    """
    names = [f"{c}_right" if c in left.columns else c for c in columns]
    keys = [f"__k{i}" for i in range(len(by))]
    row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(left.columns)])
    l_side = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], _micros(left, left_at).alias("__t"), row.alias("__row"))
    payload = F.struct(_micros(right, right_at).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"p{i}") for i, c in enumerate(columns)])
    r_side = right.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], _micros(right, right_at).alias("__t"), payload.alias("__p"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "__t"]])
    lost = l_side.where(~known)
    both = l_side.where(known).select(*keys, "__t", F.lit(1).alias("__side"), "__row", F.lit(None).cast(r_side.schema["__p"].dataType).alias("__p")).unionByName(
        r_side.where(known).select(*keys, "__t", F.lit(0).alias("__side"), F.lit(None).cast(l_side.schema["__row"].dataType).alias("__row"), "__p")
    )
    # the width of a bucket follows from the key that has most rows
    most = both.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__t").alias("a"), F.max("__t").alias("b")).agg(F.max_by(F.struct("n", "a", "b"), "n").alias("s")).select("s.*").first()
    width = 1 if most is None or most["n"] is None else max(1, (most["b"] - most["a"] + 1) // max(1, -(-most["n"] // bucket_rows)))
    both = both.withColumn("__b", F.floor(F.col("__t") / width))
    inside = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", F.col("__p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = both.withColumn("__p", F.last("__p", ignorenulls=True).over(inside)).where("__side = 1").select(*keys, "__t", "__b", "__row", "__p")
    ends = both.groupBy(*keys, "__b").agg(F.max("__p").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("__b").alias("__bc"), F.last("__end", ignorenulls=True).over(before).alias("__carried")).where("__carried is not null")
    joined = answered.join(carried, _same([*keys, "__b"], [*[f"{k}c" for k in keys], "__bc"]), "left").withColumn("__p", F.coalesce("__p", "__carried"))
    found = joined.select("__t", "__row", "__p").unionByName(lost.select("__t", "__row", F.lit(None).cast(r_side.schema["__p"].dataType).alias("__p")))
    near = F.lit(True) if tolerance is None else F.coalesce(F.col("__t") - F.col("__p.t") <= tolerance, F.lit(False))
    return found.select(*[F.col(f"__row.v{i}").alias(c) for i, c in enumerate(left.columns)], *[F.when(near, F.col(f"__p.p{i}")).alias(n) for i, n in enumerate(names)])


def interval_join(points: DataFrame, intervals: DataFrame, by: tuple[str, ...], at: str, start: str, end: str, columns: tuple[str, ...], part_rows: int = PART_ROWS) -> DataFrame:
    """points with the columns of each interval of the same keys that holds their time: start <= at <= end.

    Intervals are cut by their lengths into levels of powers of two, and at each level lie in at most two bins of its width; a point
    looks into one bin of each level that there is. So a join on equal bins finds all pairs, long intervals make no more
    rows than short ones, and only pairs of one bin are compared. Bins with many points are split into parts, to which
    their intervals are copied. Cases: null keys and times meet nothing; an interval that ends before it starts holds
    nothing; repeated rows are kept on both sides; a name on both sides gets `_right` at its end.
    """
    names = [f"{c}_right" if c in points.columns else c for c in columns]
    keys = [f"__k{i}" for i in range(len(by))]
    right = intervals.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], _micros(intervals, start).alias("__a"), _micros(intervals, end).alias("__z"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(columns)])
    right = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys], F.lit(True)) & (F.col("__a") <= F.col("__z")))
    # the width 2^level is above the length of the interval
    level = F.length(F.bin(F.col("__z") - F.col("__a")))
    right = right.withColumn("__l", level.cast("int"))
    right = right.withColumn("__bin", F.explode(F.array_distinct(F.array(F.expr("shiftright(__a, __l)"), F.expr("shiftright(__z, __l)")))))
    # there are 64 levels at most
    levels = sorted(r["__l"] for r in right.select("__l").distinct().collect())
    left = points.select(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(points.columns)]).alias("__row"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], _micros(points, at).alias("__t"))
    left = left.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "__t"]]))
    left = left.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__bin", F.expr("shiftright(__t, __l)"))
    cell = [*keys, "__l", "__bin"]
    left = left.join(right.select(*cell).distinct(), cell, "left_semi") if levels else left.where("false")
    heavy = left.groupBy(*cell).count().where(F.col("count") > part_rows).select(*cell, F.ceil(F.col("count") / part_rows).cast("int").alias("__parts"))
    left = left.join(heavy, cell, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("__row", "__t"), F.coalesce("__parts", F.lit(1))).cast("int"))).drop("__parts")
    right = right.join(heavy, cell, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    met = left.join(right, [*cell, "__part"]).where((F.col("__t") >= F.col("__a")) & (F.col("__t") <= F.col("__z")))
    return met.select(*[F.col(f"__row.v{i}").alias(c) for i, c in enumerate(points.columns)], *[F.col(f"__p{i}").alias(n) for i, n in enumerate(names)])
