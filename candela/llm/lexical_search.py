"""Ranked lexical search by Fagin's threshold algorithm, exact, over shards of documents.

A term's impact on a document is fixed by the corpus (see `weights` and `impacts`), so each shard sorts the postings of a term by impact once.
For an item, the lists of its terms are read in turn, a block of each at a time; a document that is met for the first time
is scored whole by its row of the forward index. The threshold is the sum of the next impacts of all lists: no document
that was not met can score more. When it falls strictly below the kth score, the item is done; at equality it goes on,
as a smaller id may still win a tie.

Documents are read once and become a forward index of the terms that any item has (`forward`). Shards are cut from its
partitions by a number of postings, so a task holds one shard, and its best rows of each item, which it takes from shard to
shard so that later ones stop earlier. Items come in blocks of bounded text, so vocabularies and weights of a block may be
sent to all tasks.

Cases: null text counts as empty and has no terms; documents without terms are not counted and never found; rows with one
id are documents of their own; a null id comes last among equal scores; each row of items is an item of its own, a null text has
no terms and finds nothing; a repeated term of an item counts once; texts are read whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes that belong to terms: digits, letters, and all beyond ASCII; A-Z are lower-cased, the rest becomes a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Postings of a shard, and bytes of items in a block.
SHARD, ITEMS = 2_000_000, 4_000_000
#: Postings of each list in the first block; later blocks double.
FIRST = 32
#: Parts in which the best rows of an item are merged first.
PARTS = 64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def blocks_of_items(items: DataFrame, item_id: str, text: str, most: int) -> tuple[DataFrame, int]:
    """item_id, text and the block of each item, and the number of blocks."""
    value = common.text_of(text)
    size = items.agg(F.sum(F.octet_length(value))).first()[0] or 0
    blocks = max(1, -(-size // most))
    return items.select(F.col(item_id).alias("item_id"), value.cast("binary").alias("text"), F.pmod(F.xxhash64(F.col(item_id).cast("string"), value), F.lit(blocks)).alias("block")), blocks


def forward(df: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms of the vocabulary with their counts, for documents that have any term."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = shared.value

        def work(rows):
            out: dict[str, list] = {n: [] for n in ("doc_id", "n", "terms", "counts")}
            for i, t in zip(rows["doc_id"], rows["text"], strict=True):
                words = terms_of(t)
                if not words:
                    continue
                held = np.array([k for w in words if (k := number.get(w)) is not None], dtype=np.uint32)
                terms, counts = np.unique(held, return_counts=True)
                for n, v in zip(out, (i, len(words), terms.tobytes(), counts.astype(np.uint32).tobytes()), strict=True):
                    out[n].append(v)
            return out

        return work

    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).cast("binary").alias("text"))
    return common.map_rows(given, make, "doc_id long, n long, terms binary, counts binary")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """In how many documents of the index each term of the vocabulary is."""

    def make():
        total = np.zeros(size, dtype=np.int64)

        def work(rows):
            if rows is None:
                held = np.flatnonzero(total)
                return {"term": held, "df": total[held]}
            # a row holds a term once, so counting all rows together counts documents
            np.add(total, np.bincount(np.frombuffer(b"".join(rows["terms"]), np.uint32), minlength=size), out=total)
            return None

        return work

    found = common.map_rows(index.select("terms"), make, "term long, df long", finish=True).groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class Shard:
    """Documents with their forward index and the impact-sorted lists of its terms."""

    def __init__(self, rows: list[tuple], weight: np.ndarray, documents: int, total: int):
        self.ids = np.array([i or 0 for i, *_ in rows], dtype=np.int64)
        self.nameless = np.array([i is None for i, *_ in rows])
        self.terms = np.frombuffer(b"".join(t for _, _, t, _ in rows), np.uint32).astype(np.int64)
        tf = np.frombuffer(b"".join(c for *_, c in rows), np.uint32).astype(np.int64)
        sizes = np.array([len(t) // 4 for _, _, t, _ in rows], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        length = {n: 100 - 50 + 50 * n * documents // total for n in {n for _, n, *_ in rows}}  # in Python's integers, as products may pass 64 bits
        self.doc = np.repeat(np.arange(len(rows)), sizes)
        m = np.array([length[n] for _, n, *_ in rows], dtype=np.int64)[self.doc]
        self.impact = weight[self.terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        order = np.lexsort((-self.impact, self.terms))
        self.listed, self.sorted = self.doc[order], self.impact[order]
        self.at = np.searchsorted(self.terms[order], np.arange(len(weight) + 1))

    def scores(self, docs: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The scores of documents by their rows of the forward index; mark: the terms of the item."""
        sizes = self.begin[docs + 1] - self.begin[docs]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(first - self.begin[docs], sizes)
        return np.add.reduceat(np.where(mark[self.terms[at]], self.impact[at], 0), first)  # a document that was met has a posting

    def search(self, terms: np.ndarray, best: Best, mark: np.ndarray) -> int:
        """Bring an item's best rows up to date; gives the number of documents that were scored."""
        low, high = self.at[terms], self.at[terms + 1]
        seen = np.zeros(len(self.ids), dtype=bool)
        depth, block, scored = 0, FIRST, 0
        mark[terms] = True
        while True:
            open_ = low + depth < high
            if not open_.any():
                break
            threshold = int(self.sorted[(low + depth)[open_]].sum())
            if best.full() and threshold < best.last():
                break
            if threshold == 0:  # what is left scores nothing
                break
            met = np.unique(np.concatenate([self.listed[a : min(a + block, b)] for a, b in zip((low + depth)[open_].tolist(), high[open_].tolist(), strict=True)]))
            met = met[~seen[met]]
            seen[met] = True
            if len(met):
                best.add(self.scores(met, mark), self.ids[met], self.nameless[met])
                scored += len(met)
            depth, block = depth + block, block * 2
        mark[terms] = False
        return scored


class Best:
    """The k highest scores above 0 so far, ties to the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.nameless = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def full(self) -> bool:
        return len(self.score) == self.k

    def last(self) -> int:
        return int(self.score[-1])

    def add(self, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        use = score >= max(1, self.last() if self.full() else 1)
        score, ids, nameless = (np.concatenate([a, b[use]]) for a, b in ((self.score, score), (self.id, ids), (self.nameless, nameless)))
        order = np.lexsort((ids, nameless, -score))[: self.k]
        self.score, self.id, self.nameless = score[order], ids[order], nameless[order]


def search_block(index: DataFrame, items: list, vocabulary: dict[bytes, int], k: int, shard: int) -> DataFrame:
    """item (place in the list), doc_id, score: the best k of each task for each item."""
    spark = index.sparkSession
    totals = index.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    documents, total = totals["n"], totals["l"] or 1
    weight = weights(documents, document_counts(index, len(vocabulary)))
    queries = [np.unique([vocabulary[t] for t in terms_of(r["text"])]).astype(np.int64) for r in items]
    shared = spark.sparkContext.broadcast((weight, queries))

    def make():
        weight, queries = shared.value
        mark = np.zeros(len(weight), dtype=bool)
        best = [Best(k) for _ in queries]
        held: list[tuple] = []
        size = 0

        def run() -> None:
            part = Shard(held, weight, documents, total)
            held.clear()
            for terms, own in zip(queries, best, strict=True):
                if len(terms):
                    part.search(terms, own, mark)

        def work(rows):
            nonlocal size
            if rows is None:
                if held:
                    run()
                sizes = [len(b.score) for b in best]
                ids = [None if x else i for b in best for i, x in zip(b.id.tolist(), b.nameless.tolist(), strict=True)]
                return {"item": np.repeat(np.arange(len(best)), sizes).tolist(), "doc_id": ids, "score": [s for b in best for s in b.score.tolist()]}
            for row in zip(*(rows[n] for n in ("doc_id", "n", "terms", "counts")), strict=True):
                if row[2]:  # others hold no term of any item
                    held.append(row)
                    size += len(row[2]) // 4
                    if size >= shard:
                        run()
                        size = 0
            return None

        return work

    return common.map_rows(index.select("doc_id", "n", "terms", "counts"), make, "item long, doc_id long, score long", finish=True)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item with their ranks, merged in parts first."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 50, shard: int = SHARD, item_bytes: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, with scores above 0."""
    spark = df.sparkSession
    given, blocks = blocks_of_items(items, item_id, item_text, item_bytes)
    results = []
    for b in range(blocks):
        own = given.where(F.col("block") == b).select("item_id", "text").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({t for r in own for t in terms_of(r["text"])}))}
        index = common.checkpointed(forward(df, doc_id, text, vocabulary))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item long, item_id {given.schema['item_id'].dataType.simpleString()}")
        results.append(ranked(search_block(index, own, vocabulary, k, shard), k).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
