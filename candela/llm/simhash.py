"""SimHash fingerprints, and the search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words, each weighing 1 + ln(its count). Every term's hash votes with its weight on
each bit, for a one or against it, and the signs of the sums are the fingerprint. The search cuts fingerprints into
blocks and keeps a table for each choice of blocks: two fingerprints within the radius agree on all but `radius`
blocks, so they meet in at least one table.

Cases: null text counts as empty; the fingerprint of a text without any term is all zeros; a text of one word has
that word as its term, one without words its characters; equal texts have equal fingerprints; an empty table gives
an empty result; extra columns are ignored, or kept where asked for, and a kept column that is named like a result gets
`_in` at its end; very long texts are read whole. In `edited_fingerprints`, rows come in descending order of the id, null
ids last, rows of one id by the hash of their text. In the search, null fingerprints have no neighbours, and rows with
one fingerprint count once.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 128
WORDS = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = (np.arange(1, 17, dtype=np.uint64) * _GOLD).astype(np.uint64)
#: The bits of each byte value.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) > self.bound:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.uint64)


class SimHasher:
    def __init__(self, bits: int = BITS):
        if bits % 64:
            raise ValueError("bits must be a multiple of 64")
        self.bits, self.known = bits, WordHashes()

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = WORDS.findall(text.lower()) or [c for c in text if not c.isspace()]
        hashes = self.known.of(words)
        if len(hashes) > 1:
            hashes = mix(hashes[:-1] * _GOLD + (hashes[1:] ^ (hashes[1:] >> np.uint64(29))))
        return np.unique(hashes, return_counts=True)

    def __call__(self, text: str) -> bytes:
        terms, counts = self.terms(text)
        wide, places = self.bits // 64, self.bits // 8
        sums = np.zeros(places * 256)
        weights = 1 + np.log(counts)
        for k in range(0, len(terms), 8192):  # weights summed by the values of each byte of the hashes
            part = terms[k : k + 8192]
            values = mix(part[:, None] + _SHIFTS[:wide]).view(np.uint8) + np.arange(places, dtype=np.int32) * 256
            sums += np.bincount(values.reshape(-1), weights=np.repeat(weights[k : k + 8192], places), minlength=places * 256)
        ones = sums.reshape(places, 256) @ _BYTE_BITS
        return np.packbits(2 * ones.reshape(-1) - weights.sum() > 1e-6).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """keep columns and the fingerprint as hexadecimal digits."""

    def make():
        hasher = SimHasher(bits)
        return lambda texts: {"fingerprint": [hasher(t).hex() for t in texts]}

    return common.map_texts(df, text, keep, make, "fingerprint string")


def _edges(blocks: int, bits: int) -> list[int]:
    """The hexadecimal digits at which blocks begin, and the end."""
    return [round(i * (bits // 4) / blocks) for i in range(blocks + 1)]


def _tables(radius: int, blocks: int | None, bits: int):
    """The choices of blocks that make the tables, and a function that cuts block i out of a column."""
    blocks = blocks or radius + 1
    if blocks <= radius:
        raise ValueError("there must be more blocks than the radius")
    edges = _edges(blocks, bits)
    return list(combinations(range(blocks), blocks - radius)), lambda c, i: F.substring(c, edges[i] + 1, edges[i + 1] - edges[i])


def near_fingerprints(df: DataFrame, radius: int = 3, blocks: int | None = None, fingerprint: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """All pairs of different fingerprints within the radius: a < b, distance. Equal ones count once.

    A pair that meets in several tables is kept in the first of them. With radius + 1 blocks there is a table for each
    block; more blocks make more tables with longer keys, for when a block's bits are few against the fingerprints.
    """
    choices, part = _tables(radius, blocks, bits)
    distinct = df.select(F.col(fingerprint).alias("f")).where(F.col("f").isNotNull()).distinct()
    keys = F.array(*[F.xxhash64(F.lit(n), *[part(F.col("f"), i) for i in c]) for n, c in enumerate(choices)])
    # the number of the table is part of the key's hash, and fingerprints travel as bytes
    tables = distinct.select(F.unhex("f").alias("f"), F.posexplode(keys).alias("n", "key"))
    left, right = tables.select(F.col("f").alias("a"), "n", "key"), tables.select(F.col("f").alias("b"), F.col("key").alias("other"))
    met = left.join(right, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b"))).select("n", F.lower(F.hex("a")).alias("a"), F.lower(F.hex("b")).alias("b"))
    agree = lambda c: F.forall(F.array(*[part(F.col("a"), i) == part(F.col("b"), i) for i in c]), lambda x: x)
    first = F.coalesce(*[F.when(agree(c), F.lit(n)) for n, c in enumerate(choices)])
    return met.withColumn("distance", hamming(F.col("a"), F.col("b"), bits)).where((F.col("distance") <= radius) & (F.col("n") == first)).select("a", "b", "distance")


def hamming(a: Column, b: Column, bits: int = BITS) -> Column:
    """The number of bits in which two fingerprints of hexadecimal digits differ."""
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(bits // 32)), F.lit(0))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie above the key, found in two steps so that a row takes the square root of their number."""
    if not bounds:
        return F.lit(0)
    bounds, step = sorted(bounds, reverse=True), max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    above = lambda values: F.size(F.filter(values, lambda b: b > key))
    whole = above(F.lit([g[-1] for g in groups]))
    rest = F.coalesce(F.get(F.array(*[F.lit(g) for g in groups]), whole), F.lit([]).cast("array<bigint>"))
    return whole * step + above(rest)


def in_descending_order(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt to partitions in runs of descending ids; each run ends with a copy of the row that follows it.

    Columns doc_id, text, run, copy. One shuffle of the texts; only the bounds and heads of the runs reach the driver.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    rows = df.select(F.col(doc_id).alias("doc_id"), common.text_of(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(lowest)).alias("key"))
    # quantiles are doubles; as bounds they only deal rows out, and need not be ids
    found = rows.approxQuantile("key", [i / (4 * parts) for i in range(1, 4 * parts)], 1 / (16 * parts)) if parts > 1 else []
    values = [max(lowest, min(int(x), (1 << 63) - 1)) for x in found]
    # an id that stands at several quantiles has many rows: it gets runs of its own, cut by the order of the texts' hashes
    repeated = sorted({x for x in found if found.count(x) > 1})
    heavy: dict[int, int] = {}
    if repeated:
        total = rows.count()
        near = rows.where(F.col("key").cast("double").isin(repeated)).groupBy("key").agg(F.count("*").alias("n"))
        # of ids with more than an eighth of a partition there are 8 * parts at most
        heavy = {r["key"]: -(-4 * parts * r["n"] // total) + 1 for r in near.where(F.col("n") * 8 * parts > total).collect()}
    bounds = sorted(set(values) | set(heavy) | {min(k + 1, (1 << 63) - 1) for k in heavy})
    rows = rows.withColumn("tie", F.xxhash64("text"))
    at = F.array_position(F.lit([*heavy] or [lowest]).cast("array<bigint>"), F.col("key")).cast("int")
    cuts = F.coalesce(F.get(F.lit([*heavy.values()] or [1]), at - 1), F.lit(1))
    within = F.least(F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * cuts), cuts - 1)
    rows = rows.withColumn("run", (_bucket(F.col("key"), bounds) * (4 * parts + 1) + within).cast("int"))
    heads = sorted((r.run, r.head.key, -r.head.turned - 1) for r in rows.groupBy("run").agg(F.max(F.struct("key", F.expr("~tie").alias("turned"))).alias("head")).collect())
    # the first row of each run is copied to the run before it, that of the first run to the last
    follows = [(heads[i - 1][0], run, key, tie) for i, (run, key, tie) in enumerate(heads)]
    links = spark.createDataFrame(follows or [(0, 0, 0, 0)], "to int, run int, key long, tie long")
    copies = rows.join(F.broadcast(links), ["run", "key", "tie"]).select("doc_id", "text", "key", F.col("to").alias("run"), "tie", F.lit(True).alias("copy"))
    both = rows.select("doc_id", "text", "key", "run", "tie", F.lit(False).alias("copy")).unionByName(copies)
    # runs are dealt in turn, so that each partition gets as many
    span = 4 * parts + 1
    turn = F.pmod(F.floor(F.col("run") / span) + F.col("run") % span, F.lit(parts)).cast("int")
    return both.repartitionById(parts, turn).sortWithinPartitions("run", "copy", F.desc("key"), "tie").select("doc_id", "text", "run", "copy")


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of each text, and of the text with its last third replaced by the start of the next row's."""
    ordered = in_descending_order(df, doc_id, text)
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def make():
        hasher, before = SimHasher(bits), []

        def work(rows):
            out = {n: [] for n in names}
            for i, t, run, copy in zip(rows["doc_id"], rows["text"], rows["run"], rows["copy"], strict=True):
                own = hasher(t)
                if before and before[0][2] == run and not before[0][3]:
                    j, u, _, _, mine = before[0]
                    cut = len(u) // 3
                    edited = u[: len(u) - cut] + t[:cut]
                    other = hasher(edited)
                    row = (j, len(u), hashlib.sha256(edited.encode()).hexdigest(), mine.hex(), other.hex(), likeness(mine, other), likeness(mine, own))
                    for n, v in zip(names, row, strict=True):
                        out[n].append(v)
                before[:] = [(i, t, run, copy, own)]
            return out

        return work

    return common.map_rows(ordered, make, f"doc_id {ordered.dtypes[0][1]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


#: Members of a bucket that are held against each other in one block.
BLOCK = 2048


def near_counts(df: DataFrame, radius: int = 3, blocks: int | None = None, fingerprint: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """fingerprint, near_count (above 0): how many other different fingerprints lie within the radius.

    As `near_fingerprints`, but each pair of blocks of a bucket is one unit of work that gives sums by fingerprint, so a
    large group of near copies makes no row for each of its pairs, and no task holds a bucket.
    """
    choices, part = _tables(radius, blocks, bits)
    distinct = df.select(F.lower(F.col(fingerprint)).alias("f")).where(F.col("f").isNotNull()).distinct()
    keys = F.array(*[F.xxhash64(F.lit(n), *[part(F.col("f"), i) for i in c]) for n, c in enumerate(choices)])
    members = distinct.select(F.unhex("f").alias("f"), F.posexplode(keys).alias("n", "key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select((F.col("key") + 0).alias("key"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    cut = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("f", F.lit(1)), F.col("blocks")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "n", "f", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = spread.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n")
    digits, edges = bits // 4, _edges(blocks or radius + 1, bits)
    # for each choice of blocks, the bits that must be equal, as the 32-bit words of a fingerprint
    masks = np.array([list(bytes.fromhex("".join("f" if any(edges[b] <= d < edges[b + 1] for b in c) else "0" for d in range(digits)))) for c in choices], dtype=np.uint8)

    def make():
        held: list[tuple] = []

        def compare(out: dict[str, list]) -> None:
            n = held[0][1]
            f = np.frombuffer(b"".join(h[2] for h in held), dtype=np.uint8).reshape(len(held), -1)
            left = np.array([h[3] == h[4] for h in held])
            same = held[0][4] == held[0][5]
            a, b = (np.arange(len(f)), np.arange(len(f))) if same else (np.flatnonzero(left), np.flatnonzero(~left))
            counts = np.zeros(len(f), dtype=np.int64)
            for x in a.tolist():
                differ = f[b] ^ f[x]
                near = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= radius
                near &= b != x
                # a pair that meets in several tables counts in the first
                near[near] = ~((differ[near][:, None, :] & masks[None, :n]) == 0).all(axis=2).any(axis=1) & ((differ[near] & masks[n]) == 0).all(axis=1)
                counts[x] += int(near.sum())
                if not same:
                    counts[b[near]] += 1
            for x in np.flatnonzero(counts).tolist():
                out["f"].append(held[x][2])
                out["near"].append(int(counts[x]))
            held.clear()

        def work(rows):
            out = {"f": [], "near": []}
            if rows is None:
                compare(out) if held else None
                return out
            for row in zip(*(rows[c] for c in ("key", "n", "f", "block", "i", "j")), strict=True):
                # tables whose keys have one hash are kept apart by their number
                if held and (held[0][0], held[0][4], held[0][5], held[0][1]) != (row[0], row[4], row[5], row[1]):
                    compare(out)
                held.append(row)
            return out

        return work

    found = common.map_rows(ordered, make, "f binary, near long", finish=True)
    return found.groupBy("f").agg(F.sum("near").alias("near_count")).select(F.lower(F.hex("f")).alias("fingerprint"), "near_count")


def with_near_count(df: DataFrame, radius: int = 3, fingerprint: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """df with near_count: how many other different fingerprints among its rows lie within the radius of the row's own."""
    counts = near_counts(df, radius, None, fingerprint, bits).select(F.concat("fingerprint", F.lit("")).alias("__f"), F.col("near_count").alias("__n"))
    joined = df.join(counts, F.lower(F.col(fingerprint)) == F.col("__f"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__n", F.lit(0)).alias("near_count"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near_count(common.checkpointed(edited_fingerprints(common.table(spark, sf_dir, "documents"))))
