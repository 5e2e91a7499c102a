"""Near-duplicate detection with BagMinHash signatures.

A text is the bag of its five-word shingles, each with its count. The signature is that of the public BagMinHash
method for integer weights: the weights' axis is cut into the strips [0,1), [1,2), [2,4), [4,8) and so on, and each
shingle and strip has a Poisson process of points (time, height, component), seeded by the shingle. Heights are split
by halves within a strip, so a strip is used by all weights that reach into it, and points above a weight are passed
over. A component of the signature is the first point below the weights; points are made in order of time, until they
come after the latest of the components. Two signatures agree in a component with the probability of the weighted
Jaccard similarity of the bags.

Candidates share a band of the signature; links are verified by the overlap of the bags. Equal bags are one node from
the start. In each bucket of a band all members are held against one member, the hub; then, in buckets whose members
are still in different components, all pairs of different components are compared by signature, in blocks, and the
likely ones are verified in place. So a bucket of copies gives one pair a member, and no link is left out because a
bucket is large.

Cases: null text counts as empty; texts of fewer than five words have one shingle, of all their words; texts without
words are in one class if they are equal; copies, equal ids and null ids each keep their row; a class is named by
its smallest id, or by a negative number if it has only null ids; an empty table gives an empty result; very long texts are
read whole; extra columns, whatever their names, are kept by `one_of_each` and ignored otherwise.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import WordHashes, mix

WORDS = re.compile(r"\w+")
SHINGLE, SIMILARITY = 5, 0.8
COMPONENTS, ROWS = 128, 5
#: Members of a bucket that are compared in one block.
BLOCK = 2048
#: Parts in which names are joined to the bags of a class and to the rows of a bag.
SALTS = 16
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


# A column written as `(c + 0)` has no known partitioning, so a join deals both sides anew, and Spark can split a side
# whose key is hot.


def shingles(text: str, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    words = WORDS.findall(text.lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = known.of(words)
    width = min(width, len(hashes))
    out = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * _GOLD + hashes[k : len(hashes) - width + 1 + k])
    return out


def sign(bags: list[tuple[np.ndarray, np.ndarray]], components: int = COMPONENTS) -> np.ndarray:
    """16-bit signatures of bags (elements, counts), one row each; zeros for an empty bag."""
    elements = np.concatenate([e for e, _ in bags] or [np.empty(0, np.uint64)])
    weights = np.concatenate([w for _, w in bags] or [np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    first = np.full(len(bags) * components, np.inf)
    # one process for each element and strip that its weight reaches into
    parts = []
    strip, low, width = 0, 0, 1
    here = np.arange(len(elements))
    while len(here):
        parts.append((owner[here], mix(elements[here] + np.uint64(strip * int(_STEP) % 2**64)), weights[here], np.full(len(here), low), np.full(len(here), width)))
        strip, low, width = strip + 1, low + width, max(1, low + width)
        here = here[weights[here] > low]
    if parts:
        own, seed, weight, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
        time, turn = np.zeros(len(own)), 0
        latest = np.full(len(bags), np.inf)
        while len(own):
            turn += 1
            draw = mix(seed + np.uint64(turn * int(_GOLD) % 2**64))
            time = time - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
            draw = mix(draw + _STEP)
            component = (draw & np.uint64(0xFFFFFF)).astype(np.int64) % components
            height = low + ((draw >> np.uint64(24)).astype(np.float64) * 2.0**-40 * width).astype(np.int64)
            use = (height < weight) & (time < latest[own])
            np.minimum.at(first, own[use] * components + component[use], time[use])
            active = np.unique(own)
            latest[active] = first.reshape(len(bags), components)[active].max(axis=1)
            stay = time < latest[own]
            own, seed, weight, low, width, time = own[stay], seed[stay], weight[stay], low[stay], width[stay], time[stay]
    bits = np.where(np.isfinite(first), first, 0.0).view(np.uint64)
    return (mix(bits) >> np.uint64(48)).astype("<u2").reshape(len(bags), components)


def as_set(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bag as a sorted set of 32-bit hashes of (element, number of occurrence): overlaps of bags are those of sets."""
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique((mix(np.repeat(elements, counts) + number.astype(np.uint64) * _STEP) >> np.uint64(32)).astype("<u4"))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags as sets; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def overlaps(a: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """The similarity of one bag to each of many, none of them empty."""
    sizes = np.array([len(b) for b in many])
    joined = np.concatenate(many)
    hits = a[np.minimum(np.searchsorted(a, joined), len(a) - 1)] == joined
    shared = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes)
    return shared / (len(a) + sizes - shared)


def signed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", components: int = COMPONENTS, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, bag_id (a hash of the bag), signature, and the bag as a set of 32-bit hashes."""

    def make():
        known = WordHashes()

        def work(rows):
            found = [shingles(t, known, width) for t in rows["text"]]
            bags = [np.unique(s, return_counts=True) for s in found]
            bag_ids = []
            for t, s in zip(rows["text"], found, strict=True):
                value = xxhash.xxh3_64_intdigest(np.sort(s).tobytes()) if len(s) else xxhash.xxh3_64_intdigest("no words: " + t)
                bag_ids.append(value - (1 << 64) if value >> 63 else value)
            signatures = sign(bags, components)
            return {
                "doc_id": rows["doc_id"],
                "text_hash": rows["text_hash"],
                "bag_id": bag_ids,
                "signature": [s.tobytes() if len(e) else None for s, (e, _) in zip(signatures, bags, strict=True)],
                "bag": [as_set(*b).tobytes() for b in bags],
            }

        return work

    kept = df.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).alias("text"), F.xxhash64(common.text_of(text)).alias("text_hash"))
    return common.map_rows(kept, make, "doc_id long, text_hash long, bag_id long, signature binary, bag binary")


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap by `least` or more, with that similarity."""
    bag = lambda n: nodes.select((F.col("bag_id") + 0).alias(n), F.col("bag").alias(f"bag_{n}"))
    joined = pairs.select((F.col("a") + 0).alias("a"), "b").join(bag("a"), "a").join(bag("b"), "b").select("a", "b", "bag_a", "bag_b")

    def make():
        def work(rows):
            out = {"a": [], "b": [], "similarity": []}
            for a, b, x, y in zip(rows["a"], rows["b"], rows["bag_a"], rows["bag_b"], strict=True):
                if (s := overlap(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))) >= least:
                    out["a"].append(a)
                    out["b"].append(b)
                    out["similarity"].append(s)
            return out

        return work

    return common.map_rows(joined, make, "a long, b long, similarity double")


def residual_links(members: DataFrame, bags: DataFrame, least: float, components: int = COMPONENTS, rows_in_band: int = ROWS) -> DataFrame:
    """Links between members (bucket, band, bag_id, component) of one bucket in different components; bags: of each bag_id.

    Buckets are cut into blocks by a hash, and each pair of blocks is one unit of work, so no task holds a bucket.
    Pairs whose signatures are likely are verified by their bags at once, and only links that join two components of
    the unit are given, so their number is below the number of members.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).select((F.col("bucket") + 0).alias("bucket"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cut = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("bag_id", F.lit(1)), F.col("blocks")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", "band", "bag_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # signatures and bags come in last, so that they are dealt once
    spread = spread.join(bags.select((F.col("bag_id") + 0).alias("bag_id"), "signature", "bag"), "bag_id")
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = spread.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "bag_id")
    slack = 4 * (least * (1 - least) / components) ** 0.5

    def compare(group: list[tuple], out: dict[str, list]) -> None:
        kept: list[tuple] = list({g[2]: g for g in group}.values())
        band = kept[0][1]
        s = np.frombuffer(b"".join(g[4] for g in kept), "<u2").reshape(len(kept), components)
        bags = [np.frombuffer(g[5], "<u4") for g in kept]
        names: dict[int, int] = {}
        comp = np.array([names.setdefault(g[3], len(names)) for g in kept])
        for k in range(len(kept) - 1):
            if len(names) < 2 or (comp == comp[0]).all():
                return
            rest = np.flatnonzero(comp[k + 1 :] != comp[k]) + k + 1
            if not len(rest):
                continue
            equal = s[rest] == s[k]
            likely = equal.mean(axis=1) >= least - slack
            rest, equal = rest[likely], equal[likely]
            if len(rest) and band:  # a pair that shares several bands is held in the first
                rest = rest[~equal[:, : band * rows_in_band].reshape(len(rest), band, rows_in_band).all(axis=2).any(axis=1)]
            if not len(rest):
                continue
            for x in rest[overlaps(bags[k], [bags[r] for r in rest]) >= least]:
                if comp[x] != comp[k]:
                    out["a"].append(kept[k][2])
                    out["b"].append(kept[x][2])
                    comp[comp == comp[x]] = comp[k]

    def make():
        held: list[tuple] = []

        def work(rows):
            out = {"a": [], "b": []}
            if rows is None:
                compare(held, out) if held else None
                return out
            for row in zip(*(rows[n] for n in ("bucket", "band", "bag_id", "component", "signature", "bag", "i", "j")), strict=True):
                if held and (held[0][0], held[0][6], held[0][7]) != (row[0], row[6], row[7]):
                    compare(held, out)
                    held.clear()
                held.append(row)
            return out

        return work

    return common.map_rows(ordered, make, "a long, b long", finish=True)


#: Bits of the table of candidates: 4 MB for any input. Beyond about as many candidates it lets more through.
TABLE_BITS = 1 << 25


def likely_in(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The rows whose column may be among the values: all that are, and few others.

    So the bags of documents without any candidate are not dealt. The joins that follow decide.
    """
    place = lambda x: mix(x.view(np.uint64)) & np.uint64(TABLE_BITS - 1)

    def gather():
        def work(part):
            at = place(np.array(part[column], dtype=np.int64)).astype(np.int64)
            words, back = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(words), dtype=np.int64)
            np.bitwise_or.at(bits, back, np.left_shift(np.int64(1), at & 63))
            return {"word": words, "bits": bits}

        return work

    words = common.map_rows(values.select(column), gather, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(TABLE_BITS // 64, dtype=np.int64)
    table[words["word"].to_numpy(dtype=int)] = words["bits"].to_numpy(dtype=np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def make():
        known = shared.value

        def work(part):
            at = place(np.array(part[column], dtype=np.int64)).astype(np.int64)
            keep = np.flatnonzero((known[at >> 6] >> (at & 63)) & 1).tolist()
            return {k: [v[i] for i in keep] for k, v in part.items()}

        return work

    return common.map_rows(rows, make, ", ".join(f"{n} {t}" for n, t in rows.dtypes))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, components: int = COMPONENTS, rows_in_band: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, bag_id and class_id, the smallest id of the class, for each row."""
    rows = common.checkpointed(signed(df, doc_id, text, components, width))
    nodes = common.checkpointed(rows.groupBy("bag_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature")))
    keys = F.array(*[F.xxhash64(F.substring("signature", 2 * rows_in_band * k + 1, 2 * rows_in_band), F.lit(k)) for k in range(components // rows_in_band)])
    bands = nodes.where(F.col("signature").isNotNull()).select("bag_id", F.posexplode(keys).alias("band", "bucket"))
    # each bucket's hub is its smallest member under a mask of its own, so the buckets of a group of copies have many hubs
    mask = F.xxhash64("bucket")
    hubs = bands.groupBy("bucket").agg(F.min(F.col("bag_id").bitwiseXOR(mask)).alias("hub"), F.count("*").alias("n")).where("n > 1").select((F.col("bucket") + 0).alias("bucket"), F.col("hub").bitwiseXOR(mask).alias("hub"))
    shared = common.checkpointed(bands.join(hubs, "bucket").select("bag_id", "band", "bucket", "hub"))
    stars = shared.where("bag_id <> hub").select(F.col("bag_id").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = likely_in(rows.select("bag_id", "signature", "bag"), shared, "bag_id")
    bags = common.checkpointed(wanted.groupBy("bag_id").agg(F.first("signature").alias("signature"), F.first("bag").alias("bag")))
    edges = common.checkpointed(verified(stars, bags, least).select("a", "b"))
    found = connected_components(edges)
    label = found.select((F.col("node") + 0).alias("bag_id"), "component")
    members = shared.select((F.col("bag_id") + 0).alias("bag_id"), "band", "bucket").join(label, "bag_id", "left").withColumn("component", F.coalesce("component", "bag_id"))
    members = common.checkpointed(members)
    # only buckets that hold more than one component are looked at again
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select((F.col("bucket") + 0).alias("bucket"))
    more = common.checkpointed(residual_links(members.join(mixed, "bucket"), bags, least, components, rows_in_band))
    final = connected_components(edges.unionByName(more))
    # classes of several bags, and bags of several rows; as either may be large, names are joined in so many parts
    parted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")
    several = final.select((F.col("node") + 0).alias("bag_id"), "component").join(nodes.select((F.col("bag_id") + 0).alias("bag_id"), "rep").hint("merge"), "bag_id")
    named = several.groupBy("component").agg(F.coalesce(F.min("rep"), -F.abs(F.col("component")) - 1).alias("name")).select((F.col("component") + 0).alias("component"), "name")
    several = several.withColumn("salt", F.pmod(F.xxhash64("bag_id", F.lit(2)), F.lit(SALTS))).join(parted(named), ["component", "salt"]).select((F.col("bag_id") + 0).alias("bag_id"), "name")
    of_bag = nodes.select((F.col("bag_id") + 0).alias("bag_id"), "rep", "copies").join(several.hint("merge"), "bag_id", "left").where("name is not null or copies > 1")
    of_bag = parted(of_bag.select((F.col("bag_id") + 0).alias("bag_id"), F.coalesce("name", "rep", -F.abs(F.col("bag_id")) - 1).alias("class_id")))
    slim = rows.select("doc_id", "text_hash", "bag_id", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).alias("salt"))
    # the other rows are classes of their own
    return slim.join(of_bag, ["bag_id", "salt"], "left").select("doc_id", "text_hash", "bag_id", F.coalesce("class_id", "doc_id", -F.abs(F.col("bag_id")) - 1).alias("class_id"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df, one of each class: that of the smallest id (null ids last), then of the smallest hash of its text."""
    lowest = -(1 << 63)
    classes = near_duplicates(df, doc_id, text, **options)
    kept = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    kept = kept.select(F.coalesce("k.doc_id", F.lit(lowest)).alias("__id"), F.col("k.text_hash").alias("__hash"))
    own = common.numbered(df)
    i, t = common.place(df, doc_id), common.place(df, text)
    keyed = own.withColumns({"__id": F.coalesce(F.col(i).cast("long"), F.lit(lowest)), "__hash": F.xxhash64(common.text_of(t))})
    rest = [F.col(c) for c, kind in own.dtypes if c not in (i, t) and "map<" not in kind]
    order = Window.partitionBy("__id", "__hash").orderBy(*rest or [F.lit(0)])
    chosen = keyed.join(kept, ["__id", "__hash"], "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return chosen.select(*own.columns).toDF(*df.columns)


def op10_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id")
