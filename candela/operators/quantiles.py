"""Exact quantiles of keys of any size, by counts over ranges of values.

A wanted order statistic lies in a known range. Each pass cuts the range into bins, counts the values in each, and goes on with
the bin that holds the statistic, between the least and the greatest value in it, until few values are left, or equal ones.
Only counts are dealt, `BINS` at most for each task, key and statistic, so no task holds the values of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Bins of a pass, and values that are sorted at last.
BINS, HELD = 256, 1000


def _on(keys: list[str], other: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)], F.lit(True))


def exact_quantiles(df: DataFrame, by: tuple[str, ...], value: str, shares: tuple[float, ...], bins: int = BINS, held: int = HELD) -> DataFrame:
    """by, share, quantile: between neighbouring values by linear interpolation. Null and NaN values take no part; infinite ones are refused."""
    keys = [f"__k{i}" for i in range(len(by))]
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], x.alias("__x"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    ends = sizes.agg(F.min("low"), F.max("high")).first()
    if ends[0] is not None and (ends[0] == float("-inf") or ends[1] == float("inf")):
        raise ValueError("quantiles of infinite values are not defined")
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", (F.col("n") - 1) * F.col("share"))
    ranks = wanted.select(*keys, "low", "high", "n", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    todo = checkpointed(ranks.select(*keys, "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    solved = None
    while True:
        done = todo.where((F.col("low") == F.col("high")) | (F.col("inside") <= held))
        solved = done if solved is None else solved.unionByName(done)
        todo = todo.where((F.col("low") < F.col("high")) & (F.col("inside") > held))
        if not todo.limit(1).count():
            break
        todo = checkpointed(_narrowed(rows, todo, keys, bins))
    other = [f"{k}s" for k in keys]
    single = solved.where("low = high").select(*keys, "rank", F.col("low").alias("found"))
    few = solved.where("low < high").select(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], "rank", "low", "high", "below")
    values = rows.join(few, _on(keys, other)).where(F.col("__x").between(F.col("low"), F.col("high"))).groupBy(*keys, "rank", "below").agg(F.sort_array(F.collect_list("__x")).alias("v"))
    found = single.unionByName(values.select(*keys, "rank", F.get("v", (F.col("rank") - F.col("below")).cast("int")).alias("found")))
    of = lambda rank, name: found.select(*[F.col(k).alias(f"{k}{name}") for k in keys], F.col("rank").alias(f"rank_{name}"), F.col("found").alias(name))
    asked = wanted.withColumns({"i": F.floor("at"), "j": F.ceil("at")})
    for name, rank in (("a", "i"), ("b", "j")):
        asked = asked.join(of(rank, name), _on([*keys, rank], [*[f"{k}{name}" for k in keys], f"rank_{name}"]))
    part = F.col("at") - F.col("i")
    return asked.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "share", F.when(part == 0, F.col("a")).otherwise(F.col("a") + part * (F.col("b") - F.col("a"))).alias("quantile"))


def _narrowed(rows: DataFrame, todo: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The bins that hold the wanted ranks, with the number of values below them."""
    other = [f"{k}t" for k in keys]
    asked = todo.select(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], "rank", "low", "high", "below")
    met = rows.join(asked, _on(keys, other)).where(F.col("__x").between(F.col("low"), F.col("high")))
    # bins of a high root, so that values of very different sizes part quickly; of the values where the roots are equal.
    # Both rise with the value, and the least and the greatest value never share a bin, so each pass gains. Halves, as a width may be beyond the doubles
    root = lambda c: F.signum(c) * F.pow(F.abs(c), F.lit(1 / 64))
    part = lambda f: (f(F.col("__x")) / 2 - f(F.col("low")) / 2) / (f(F.col("high")) / 2 - f(F.col("low")) / 2)
    share = F.when(root(F.col("high")) > root(F.col("low")), part(root)).otherwise(part(lambda c: c))
    counts = met.groupBy(*keys, "rank", "below", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("inside"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    so_far = F.sum("inside").over(Window.partitionBy(*keys, "rank").orderBy("bin"))
    upto = counts.withColumn("upto", F.col("below") + so_far)
    return upto.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("inside"))).select(*keys, "rank", "low", "high", (F.col("upto") - F.col("inside")).alias("below"), "inside")
