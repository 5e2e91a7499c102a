"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source are put in order by a hash and cut into blocks. With weights a_i / H (whole numbers that add up to
the period H), block k of source i may run from slot floor(k H / a_i) on and must run before slot ceil((k + 1) H / a_i).
Of the blocks that may run, each slot takes the one with the earliest deadline. All windows are kept then, and in
every prefix of a phase the number of a source's blocks differs from its due number by less than one. The whole
numbers are in exactly the ratios of the weights given, as they are written in decimals. When a source runs out, a new
phase begins, in which the others share its weight. All rows are kept.

After H slots every source has had exactly its due number of blocks, so the schedule of a phase repeats with the
period. The driver lays out one period of each phase, or the whole phase where that is shorter: at most MOST_SLOTS slots in
all phases together, whatever the number of rows (24 bytes each, and about two seconds for a million). A block finds its
phase by its number, and its slot by the number within the period. Weights that need more are refused with an error, and
nothing is rounded in silence; the caller rounds them to fewer parts, and then knows the targets. Without given weights they are
whole parts of PARTS, which MOST_SOURCES sources keep within the bound.

Cases: a null source counts as the empty name; sources without a weight get the rest's least weight; equal ids are put
in order by their text, so equal rows may change places only with each other; null ids count as the empty text, and
very long texts matter by their hash alone; an empty table gives an empty result; extra columns, whatever their names,
are kept by `in_schedule_order` and ignored by `schedule`.
"""

from __future__ import annotations

import bisect
import heapq
import json
from array import array
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows in a block, the power of a source's share that gives its default weight, rows in a part of a source.
BLOCK_ROWS, POWER, PART_ROWS = 8, 0.7, 250
#: Default weights are whole parts of about so many, one at least.
PARTS = 10_000
#: Slots that are laid out for all phases at most.
MOST_SLOTS = 1 << 21
#: Parts whose sizes are summed up in one step.
RUN_PARTS = 1024
#: Each source may begin a phase and has a part in the plan.
MOST_SOURCES = 256
#: Blocks in a row of the plan; entries of a plan that is broadcast, of 24 bytes; later deadlines are told as FARTHEST.
CHUNK, SMALL_PLAN, FARTHEST = 512, 1 << 20, (1 << 63) - 1


def whole_weights(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Weights as whole numbers of any size in exactly the ratios of the decimals given, and their sum, the period."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    common_multiple = lcm(*[w.denominator for w in exact.values()])
    out = {k: int(w * common_multiple) for k, w in exact.items()}
    shared = gcd(*out.values())
    out = {k: w // shared for k, w in out.items()}
    return out, sum(out.values())


@dataclass
class Phase:
    """The slots from `start` on, in which the sources of `slots` take turns.

    first: by source, the number of its first block; slots, releases, deadlines: by source and block within the
    period, counted from the start of a period; period: 0 if the phase is shorter than its period.
    """

    start: int
    period: int
    first: dict[str, int]
    slots: dict[str, array]
    releases: dict[str, array]
    deadlines: dict[str, array]


def lay_out(whole: dict[str, int], period: int, left: dict[str, int], most: int | None = None) -> tuple[dict[str, array], dict[str, array], dict[str, array], int]:
    """Slots, releases and deadlines of the blocks up to the end of the period, or until a source runs out, and that end."""
    most = MOST_SLOTS if most is None else most
    slots, releases, deadlines = ({k: array("q") for k in whole} for _ in range(3))
    waiting, ready, slot = [(0, k) for k in whole], [], 0
    heapq.heapify(waiting)
    while slot < period:
        if slot == most:
            raise ValueError(f"the schedule needs more than {MOST_SLOTS} slots before it repeats (a period here is {period}); round the weights to fewer parts")
        while waiting and waiting[0][0] <= slot:
            release, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-((len(slots[k]) + 1) * period // -whole[k]), k, release))
        deadline, k, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        slots[k].append(slot)
        releases[k].append(release)
        deadlines[k].append(min(deadline, FARTHEST))
        slot += 1
        if len(slots[k]) == left[k]:
            break
        heapq.heappush(waiting, (len(slots[k]) * period // whole[k], k))
    return slots, releases, deadlines, slot


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[Phase]:
    """The phases of the schedule: in each, the earliest deadline first among the released blocks."""
    out: list[Phase] = []
    room = MOST_SLOTS
    left, start = {k: n for k, n in blocks.items() if n}, 0
    while left:
        whole, period = whole_weights({k: weights[k] for k in left})
        slots, releases, deadlines, end = lay_out(whole, period, left, room)
        room -= end
        out.append(Phase(start, period, {k: blocks[k] - n for k, n in left.items()}, slots, releases, deadlines))
        if end < period or any(left[k] == len(s) for k, s in slots.items()):
            done, out[-1].period = {k: len(s) for k, s in slots.items()}, 0
        else:  # whole periods follow: the phase ends with the last block of the source that runs out first
            end = min((n - 1) // whole[k] * period + slots[k][(n - 1) % whole[k]] + 1 for k, n in left.items())
            done = {k: end // period * whole[k] + bisect.bisect_left(slots[k], end % period) for k in left}
        left = {k: n - done[k] for k, n in left.items() if n > done[k]}
        start += end
    return out


def slot_of(phase: Phase, source: str, block: int) -> int:
    """The slot of a block of a phase, as `_scheduled` finds it."""
    turn, at = divmod(block - phase.first[source], len(phase.slots[source]))
    return phase.start + turn * phase.period + phase.slots[source][at]


def default_weights(counts: dict[str, int], power: float = POWER, parts: int = PARTS) -> dict[str, int]:
    """Shares to a power below one, in whole parts of about `parts`: small sources get more than their share."""
    total = sum(n**power for n in counts.values())
    return {k: max(1, round(parts * n**power / total)) for k, n in counts.items()}


def _tables(spark: SparkSession, plan: list[Phase]) -> tuple[DataFrame, DataFrame, int]:
    """The plan as two tables, and the number of its entries.

    By source (at most MOST_SOURCES rows): an array of its phases. By source, phase and chunk of CHUNK blocks: arrays of
    slots, releases and deadlines within the period.
    """
    ranges: dict[str, list[dict]] = {}
    layout, entries = [], 0
    for number, p in enumerate(plan):
        for k, s in p.slots.items():
            if s:  # a source may wait for its first block when a short phase ends
                ranges.setdefault(k, []).append({"phase": number, "first": p.first[k], "start": p.start, "size": len(s), "period": p.period})
            entries += len(s)
            layout += [(k, number, i // CHUNK, *(x[k][i : i + CHUNK].tolist() for x in (p.slots, p.releases, p.deadlines))) for i in range(0, len(s), CHUNK)]
    phase = "phase bigint, first bigint, start bigint, size bigint, period bigint"
    by_source = _relation(spark, list(ranges.items()), f"__source string, __phases array<struct<{phase}>>")
    return by_source, _relation(spark, layout, "__source string, __phase bigint, __chunk bigint, __slots array<bigint>, __releases array<bigint>, __deadlines array<bigint>"), entries


def _relation(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of rows of the driver, as a literal that the JVM reads: no worker takes part."""
    names = [c.split()[0] for c in columns.split(", __")]
    names = [names[0], *[f"__{n}" for n in names[1:]]]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{columns}>>")).alias("r")).select("r.*")


def order_key(doc_id: Column) -> Column:
    """Where a row stands in its source: the first 60 bits of the md5 sum of its id's decimal form, which SQL knows too."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _scheduled(rows: DataFrame, weights: dict[str, float] | None, source: str, doc_id: str, text: str, block_rows: int) -> DataFrame:
    """rows with columns __source, __block, __slot, __place, __release, __deadline, __phase, __position."""
    spark = rows.sparkSession
    rows = rows.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("__hash", order_key(F.col(doc_id)))
    counts = {r["__source"]: r["n"] for r in rows.groupBy("__source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    counts = dict(sorted(counts.items()))
    given = default_weights(counts) if weights is None else {k: weights.get(k, min(weights.values())) for k in counts}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be above 0")
    blocks = {k: -(n // -block_rows) for k, n in counts.items()}
    plan = phases(blocks, given)
    # the last block of a source may be short: the rows it lacks are taken off the positions after it
    short = []
    for k, n in counts.items():
        if n % block_rows:
            last = next(p for p in reversed(plan) if p.first.get(k, blocks[k]) < blocks[k] and p.slots[k])
            short.append({"slot": slot_of(last, k, blocks[k] - 1), "lacks": block_rows - n % block_rows})
    parts = max(1, -(max(counts.values(), default=0) // -PART_ROWS))
    rows = rows.withColumn("__part", F.pmod("__hash", F.lit(parts)).cast("int"))
    sizes = rows.groupBy("__source", "__part").agg(F.count("*").alias("n"))
    # sums of the parts before, in two steps, so that no task gets a row for each part of a source
    sizes = sizes.withColumn("__run", F.floor(F.col("__part") / RUN_PARTS).cast("int"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("__part" if len(keys) > 1 else "__run").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda *keys: F.coalesce(F.sum("n").over(before(*keys)), F.lit(0))
    runs = sizes.groupBy("__source", "__run").agg(F.sum("n").alias("n")).select("__source", "__run", earlier("__source").alias("__runs_before"))
    starts = sizes.withColumn("__parts_before", earlier("__source", "__run")).join(runs, ["__source", "__run"])
    starts = starts.select("__source", "__part", (F.col("__runs_before") + F.col("__parts_before")).alias("__before"))
    order = Window.partitionBy("__source", "__part").orderBy("__hash", F.col(doc_id), F.xxhash64(F.col(text)))
    rows = rows.withColumn("__rank", F.row_number().over(order)).join(starts, ["__source", "__part"]).withColumn("__rank", F.col("__before") + F.col("__rank") - 1)
    rows = rows.withColumn("__block", F.floor(F.col("__rank") / block_rows)).withColumn("__place", F.col("__rank") % block_rows)
    by_source, layout, entries = _tables(spark, plan)
    rows = rows.join(F.broadcast(by_source), "__source").withColumn("__p", F.element_at(F.filter("__phases", lambda p: p["first"] <= F.col("__block")), -1)).drop("__phases")
    within = F.col("__block") - F.col("__p.first")
    rows = rows.withColumns({"__phase": F.col("__p.phase"), "__turn": F.floor(within / F.col("__p.size")), "__at": within % F.col("__p.size")})
    rows = rows.withColumn("__chunk", F.floor(F.col("__at") / CHUNK)).join(F.broadcast(layout) if entries <= SMALL_PLAN else layout, ["__source", "__phase", "__chunk"])
    base, at = F.col("__p.start") + F.col("__turn") * F.col("__p.period"), (F.col("__at") % CHUNK).cast("int")
    slot, release, deadline = (F.get(F.col(f"__{n}"), at) for n in ("slots", "releases", "deadlines"))
    rows = rows.withColumns({"__slot": base + slot, "__release": base + release, "__deadline": F.when(deadline > FARTHEST - base, F.lit(FARTHEST)).otherwise(base + deadline)})
    lacking = F.from_json(F.lit(json.dumps(short)), "array<struct<slot bigint, lacks bigint>>")
    lost = F.aggregate(F.filter(lacking, lambda s: s["slot"] < F.col("__slot")), F.lit(0).cast("long"), lambda x, s: x + s["lacks"])
    return rows.withColumn("__position", F.col("__slot") * block_rows + F.col("__place") - lost)


def schedule(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, phase, block, release, deadline, slot, place in the block and position in the whole mix."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("text"))
    out = _scheduled(slim, weights, "source", "doc_id", "text", block_rows)
    return out.select("doc_id", F.col("__source").alias("source"), *[F.col(f"__{n}").cast("long").alias(n) for n in ("phase", "block", "release", "deadline", "slot", "place", "position")])


def in_schedule_order(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows and columns of df, dealt and sorted by their positions, so that written files follow the schedule."""
    own = common.numbered(df)
    out = _scheduled(own, weights, *(common.place(df, c) for c in (source, doc_id, text)), block_rows)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return out.repartitionByRange(parts, "__position").sortWithinPartitions("__position").select(*own.columns).toDF(*df.columns)


def deviation(weights: dict[str, int], period: int, taken: dict[str, int], slots: int) -> float:
    """The largest difference between the blocks taken and the blocks due after so many slots of a phase."""
    return max(abs(taken[k] - slots * w / period) for k, w in weights.items())


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(common.table(spark, sf_dir, "documents"))
