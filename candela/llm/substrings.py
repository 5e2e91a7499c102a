"""Exact substring deduplication on a compacted de Bruijn graph of words.

Edges are runs of `width` words, nodes runs of one word less. A node at which all occurrences have the same word before and
the same word after, and which no text begins or ends with, does not branch; cut at the other nodes, texts fall into
paths whose edges all occur in the same places. A path is named by a digest of its words, read at its coordinates in the
text, so equal names mean equal words. Joined by name, paths learn the smallest document they occur in.

Texts are dealt once into cells of a few MB, and all traffic is between cells and buckets of keys, each key once a cell, so
a passage that a third of all documents hold costs no task more than one key for each cell:
1. minimizers: the least hash of the short runs within a window. Equal windows have equal minimizers, so windows whose
   minimizer is in one text only are single, and go no further. This is a quarter of a key for each word, and no window is lost.
2. nodes of the remaining windows, with the word before and after where a cell knows only one; buckets find those that
   branch anywhere, and tell the cells.
3. paths: cells cut their texts; Spark groups paths by name, and joins the smallest document back to the paths.
4. spans: cells remove the words of paths that begin in a smaller document.
Equal texts are one text from the start, with their smallest id; the others of its rows lose all windows.

Cases: null text counts as empty and has no words; texts of fewer words than a window keep them all; a window that is
repeated within one document only, or in rows of one id, stays; a null id counts as larger than all; repeated rows get equal
results; words may be of any length and any bytes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .words import among, group_starts, inside, lowest, runs, words_of

GAPS = b" \t\n\x0b\x0c\r"
WIDTH = 13
#: Words of the short runs from which minimizers are taken.
SHORT = 5
#: Bytes of text in a cell, and bytes of text whose keys share a bucket.
CELL, SHARE = 4 << 20, 16 << 20
LAST = (1 << 63) - 1
_KEPT = inside(GAPS)


def dealt(df: DataFrame, doc_id: str, text: str, cells: int) -> DataFrame:
    """One row or more for each different text, in the partition of its cell: two hashes, smallest id, number of words, digest of its words, packed text.

    Each task sends a text once, and once more its smallest id if the text came again.
    """
    value = common.text_of(text)
    given = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"), value.cast("binary").alias("text"))

    def make():
        seen: dict[tuple, list] = {}  # the smallest id that was sent, and the smallest id

        def work(rows):
            out: dict[str, list] = {n: [] for n in ("h1", "h2", "first", "n_words", "whole", "packed")}
            if rows is None:
                for key, (sent, least) in seen.items():
                    if least < sent:
                        for n, v in zip(out, (*key, least, None, None, None), strict=True):
                            out[n].append(v)
                return out
            for i, a, b, t in zip(rows["id"], rows["h1"], rows["h2"], rows["text"], strict=True):
                if (known := seen.get((a, b))) is not None:
                    known[1] = min(known[1], i)
                    continue
                seen[a, b] = [i, i]
                words = t.split()
                packed = pa.compress(t, codec="zstd", asbytes=True)
                for n, v in zip(out, (a, b, i, len(words), hashlib.sha256(b" ".join(words)).digest(), len(t).to_bytes(8, "little") + packed), strict=True):
                    out[n].append(v)
            return out

        return work

    rows = common.map_rows(given, make, "h1 long, h2 long, first long, n_words long, whole binary, packed binary", finish=True)
    return common.checkpointed_by(rows.withColumn("cell", F.pmod("h1", F.lit(cells))), cells, "cell")


class Cell:
    """The different texts of a cell, and their words one after another."""

    def __init__(self, rows: pa.Table):
        held: dict[tuple, list] = {}
        for a, b, i, packed in zip(*(rows[n].to_pylist() for n in ("h1", "h2", "first", "packed")), strict=True):
            entry = held.setdefault((a, b), [i, None])
            entry[0] = min(entry[0], i)
            entry[1] = packed if packed is not None else entry[1]
        self.keys, self.firsts = list(held), [i for i, _ in held.values()]
        self.texts = [pa.decompress(p[8:], decompressed_size=int.from_bytes(p[:8], "little"), codec="zstd", asbytes=True) for _, p in held.values()]

    def parse(self, width: int) -> None:
        starts, _, (self.hashes,) = words_of(b"\n".join(self.texts), _KEPT)
        begins = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        self.text_of = np.searchsorted(begins, starts, side="right") - 1
        self.begin = np.searchsorted(self.text_of, np.arange(len(self.texts)))
        n = max(0, len(starts) - width + 1)
        self.valid = self.text_of[:n] == self.text_of[width - 1 : width - 1 + n]
        self.minimizer = lowest(runs(self.hashes, SHORT), width - SHORT + 1)[:n] & ~np.uint64(1)

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        return self.valid & among(self.minimizer, repeated)


def by_bucket(cell: int, keys: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> dict[str, list]:
    """Rows of a cell for the buckets of its keys, with columns as bytes."""
    bucket = ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = group_starts(bucket[order])
    out: dict[str, list] = {"cell": [cell] * len(at), "bucket": bucket[order][at].tolist()}
    return out | {n: [part.tobytes() for part in np.split(c[order], at[1:])] if len(at) else [] for n, c in columns.items()}


def in_cells(cells: DataFrame, told: DataFrame | None, work: Callable[[int, Cell, dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """work(cell number, cell, what it was told) for each cell."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    common.bound_batches(cells.sparkSession)
    table = lambda out: pa.table({f.name: pa.array(out[f.name], type=f.type) for f in arrow}, schema=arrow)
    if told is None:
        return cells.groupBy("cell").applyInArrow(lambda rows: table(work(rows["cell"][0].as_py(), Cell(rows), {})), struct)

    def both(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows or not told.num_rows:
            return arrow.empty_table()
        return table(work(rows["cell"][0].as_py(), Cell(rows), told.to_pydict()))

    return cells.groupBy("cell").cogroup(told.groupBy("cell")).applyInArrow(both, struct)


def in_buckets(df: DataFrame, work: Callable[..., np.ndarray], names: tuple[str, ...]) -> DataFrame:
    """(cell, keys): the keys of each cell among those that work gives for a bucket in ascending order, from its columns by name."""
    struct = T.StructType.fromDDL("cell long, keys binary")

    def run(rows: pa.Table) -> pa.Table:
        arrays = [[np.frombuffer(v, dtype=np.uint64) for v in rows[n].to_pylist()] for n in names]
        wanted = work(*arrays)
        found = [(c, own[among(own & ~np.uint64(1), wanted)]) for c, own in zip(rows["cell"].to_pylist(), arrays[0], strict=True)]
        found = [(c, (k & ~np.uint64(1)).tobytes()) for c, k in found if len(k)]
        return pa.table({"cell": pa.array([c for c, _ in found], pa.int64()), "keys": pa.array([k for _, k in found], pa.binary())})

    return df.groupBy("bucket").applyInArrow(run, struct)


def minimizers(number: int, cell: Cell, told: dict, width: int, buckets: int) -> dict[str, list]:
    """The cell's different minimizers; the lowest bit tells those of several texts."""
    cell.parse(width)
    values, owners = cell.minimizer[cell.valid], cell.text_of[: len(cell.valid)][cell.valid]
    change = np.ones(len(values), dtype=bool)
    change[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[change], owners[change]
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    at = group_starts(values)
    keys = values[at]
    if len(at):
        keys = keys | (np.minimum.reduceat(owners, at) < np.maximum.reduceat(owners, at)).astype(np.uint64)
    return by_bucket(number, keys, {"keys": keys}, buckets)


def in_several_texts(keys: list[np.ndarray]) -> np.ndarray:
    marked = np.sort(np.concatenate(keys))
    plain = marked & ~np.uint64(1)
    at = group_starts(plain)
    if not len(at):
        return plain
    counts = np.diff(np.append(at, len(plain)))
    return plain[at[(counts > 1) | (np.maximum.reduceat(marked & np.uint64(1), at) > 0)]]


def one_or_none(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value of each group if it has only one, else 0."""
    low = np.minimum.reduceat(values, at)
    return np.where(low == np.maximum.reduceat(values, at), low, np.uint64(0))


def node_keys(cell: Cell, width: int) -> np.ndarray:
    return runs(cell.hashes, width - 1) & ~np.uint64(1)


def nodes(number: int, cell: Cell, told: dict, width: int, buckets: int) -> dict[str, list]:
    """The nodes of the cell's windows, with the words before and after; 0 stands for several words, or for an end of a text."""
    cell.parse(width)
    windows = cell.windows(np.sort(np.concatenate([np.frombuffer(k, np.uint64) for k in told["keys"]])))
    keys = node_keys(cell, width)
    use = np.zeros(len(keys), dtype=bool)
    use[:-1] |= windows
    use[1:] |= windows
    here = np.flatnonzero(use)
    before, after = np.zeros(len(here), np.uint64), np.zeros(len(here), np.uint64)
    owner, n = cell.text_of, len(cell.hashes)
    has = (here > 0) & (owner[here - 1] == owner[here])
    before[has] = cell.hashes[here[has] - 1]
    following = np.minimum(here + width - 1, n - 1)
    has = (here + width - 1 < n) & (owner[following] == owner[here])
    after[has] = cell.hashes[following[has]]
    order = np.argsort(keys[here], kind="stable")
    ordered = keys[here][order]
    at = group_starts(ordered)
    if not len(at):
        return {n: [] for n in ("cell", "bucket", "keys", "before", "after")}
    columns = {"keys": ordered[at], "before": one_or_none(before[order], at), "after": one_or_none(after[order], at)}
    return by_bucket(number, columns["keys"], columns, buckets)


def branching(keys: list[np.ndarray], before: list[np.ndarray], after: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    at = group_starts(every[order])
    if not len(at):
        return every
    sides = [one_or_none(np.concatenate(x)[order], at) == 0 for x in (before, after)]
    return every[order][at][sides[0] | sides[1]]


def paths(number: int, cell: Cell, told: dict, width: int) -> dict[str, list]:
    """The paths of the cell's texts: coordinates in words, and a digest of the words."""
    cell.parse(width)
    keys = lambda kind: np.sort(np.concatenate([np.frombuffer(k, np.uint64) for k, own in zip(told["keys"], told["kind"], strict=True) if own == kind] or [np.empty(0, np.uint64)]))
    windows = cell.windows(keys(0))
    cut = among(node_keys(cell, width), keys(1))
    here = np.flatnonzero(windows)
    out: dict[str, list] = {n: [] for n in ("cell", "h1", "h2", "first", "start", "words", "p1", "p2")}
    if not len(here):
        return out
    opens = np.concatenate([[True], (np.diff(here) > 1) | cut[here[1:]]])
    begin = here[opens]
    end = here[np.append(np.flatnonzero(opens)[1:] - 1, len(here) - 1)] + width
    known, words = -1, []
    for b, e, t in zip(begin.tolist(), end.tolist(), cell.text_of[begin].tolist(), strict=True):
        if t != known:
            known, words = t, cell.texts[t].split()
        start = b - int(cell.begin[t])
        digest = xxhash.xxh3_128_digest(b" ".join(words[start : start + e - b]))
        row = (number, *cell.keys[t], cell.firsts[t], start, e - b, *np.frombuffer(digest, np.int64).tolist())
        for n, v in zip(out, row, strict=True):
            out[n].append(v)
    return out


def removals(number: int, cell: Cell, told: dict) -> dict[str, list]:
    """For each text with spans, the number of its words that they cover, and a digest of the rest."""
    spans: dict[tuple, list] = {}
    for a, b, start, words in zip(told["h1"], told["h2"], told["start"], told["words"], strict=True):
        spans.setdefault((a, b), []).append((start, words))
    out: dict[str, list] = {n: [] for n in ("h1", "h2", "n_removed", "kept")}
    for key, text in zip(cell.keys, cell.texts, strict=True):
        if key in spans:
            words = text.split()
            stay = np.ones(len(words), dtype=bool)
            for start, length in spans[key]:
                stay[start : start + length] = False
            kept = b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])
            for n, v in zip(out, (*key, int(len(words) - stay.sum()), hashlib.sha256(kept).digest()), strict=True):
                out[n].append(v)
    return out


def repeated_paths(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, cell_bytes: int = CELL, share_bytes: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """The cells, and the paths of their texts (cell, h1, h2, first, start, words, p1, p2), those of one text alone among them."""
    if width < SHORT + 1:
        raise ValueError(f"a window has more than {SHORT} words")
    size = df.agg(F.sum(F.octet_length(common.text_of(text)))).first()[0] or 0
    cells, buckets = max(1, -(-size // cell_bytes)), max(1, -(-size // share_bytes))
    texts = dealt(df, doc_id, text, cells)
    packed = "cell long, bucket long, keys binary"
    several = common.checkpointed(in_buckets(in_cells(texts, None, lambda c, x, t: minimizers(c, x, t, width, buckets), packed), in_several_texts, ("keys",)))
    sides = f"{packed}, before binary, after binary"
    cuts = in_buckets(in_cells(texts, several, lambda c, x, t: nodes(c, x, t, width, buckets), sides), branching, ("keys", "before", "after"))
    told = several.withColumn("kind", F.lit(0)).unionByName(cuts.withColumn("kind", F.lit(1)))
    found = in_cells(texts, told, lambda c, x, t: paths(c, x, t, width), "cell long, h1 long, h2 long, first long, start long, words long, p1 long, p2 long")
    return texts, common.checkpointed(found)


def repeated_spans(found: DataFrame) -> DataFrame:
    """The paths that also occur in a smaller document, with that document (`source`).

    A path is summed up within each cell first, and learns its source once for each cell, so a path that very many texts hold is
    dealt as one row of each cell.
    """
    name = ["cell", "p1", "p2"]
    in_cell = found.groupBy(*name).agg(F.min("first").alias("low"), F.max("first").alias("high"))
    least = in_cell.groupBy("p1", "p2").agg(F.min("low").alias("source"), F.max("high").alias("last")).where("source < last")
    least = least.select((F.col("p1") + 0).alias("p1"), "p2", "source")
    told = in_cell.join(least, ["p1", "p2"]).where("source < high").select((F.col("cell") + 0).alias("cell"), "p1", "p2", "source")
    return found.join(told, name).where("source < first")


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    texts, found = repeated_paths(df, doc_id, text, width, **options)
    spans = repeated_spans(found).select("cell", "h1", "h2", "start", "words")
    removed = in_cells(texts, spans, removals, "h1 long, h2 long, n_removed long, kept binary")
    whole = texts.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("n_words").alias("n_words"), F.max("whole").alias("whole"))
    known = whole.join(removed, ["h1", "h2"], "left").select((F.col("h1") + 0).alias("h1"), "h2", "first", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("own"), F.coalesce("kept", "whole").alias("kept"), "whole")
    value = common.text_of(text)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"))
    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("first")
    short = F.col("n_words") < width
    return rows.join(known, ["h1", "h2"]).select(
        "doc_id", "n_words", F.when(first, F.col("own")).when(short, F.lit(0).cast("long")).otherwise(F.col("n_words")).alias("n_removed"),
        F.lower(F.when(first, F.hex("kept")).when(short, F.hex("whole")).otherwise(F.lit(hashlib.sha256(b"").hexdigest()))).alias("kept_sha256"),
    )


def op13_de_bruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents"))
