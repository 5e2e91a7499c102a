"""Collocations of two and three words for each language, with exact counts.

A word of a language is a 64-bit hash of both; that no two candidate words share one is checked before anything is
counted by it. Three passes over the texts, however many candidates there are:
1. hashed counters of words, kept sparse: of 2^22 slots in each bucket only those that were met. A slot's count is at least that
   of each of its words, so a word in a light slot is no part of any candidate.
2. the same for phrases all of whose words may be frequent; those words are told with it, and numbered.
3. candidates: phrases whose own slot, whose words and whose shorter phrases are all heavy, as the numbers of their words (as their
   hashes, where a word has no number), with their counts. An eighth of the texts goes first. A minimal perfect hash over those that
   were most frequent there, with their keys stored, goes to all tasks, which count them by slot in one array, and words by number;
   the arrays are summed in a tree. A task tells each other candidate once, with its count; these are dealt by hash and summed.
Counts of parts are then joined to the frequent phrases, and of each task's phrases those go on that are among its first.

Tables that go to all tasks are bounded: bit tables of heavy slots by `TABLE_BITS` (when they are full, more candidates pass, and no
frequent one is lost), numbered words by `WORDS` (those beyond travel as hashes), the perfect hash by `SLICE` and `KNOWN` candidates.

Cases: null text counts as empty, null language as `und`; empty pieces have no words; texts are read whole, words may be of any length;
repeated rows count each; an empty table, or one without frequent phrases, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .simhash import mix
from .words import among, group_starts, inside

LEAST, LONGEST, FIRST, INSIDE = 10, 3, 2000, 50
#: Bytes as they count: A-Z lower-cased, ends of pieces as line ends.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_KEPT = inside(b" \t\n")
#: Bits of a table of heavy slots at most, and for each of them; candidates of the perfect hash at most.
TABLE_BITS, BITS_EACH, SLICE = 1 << 30, 16, 2_000_000
#: Words that have a number at most; as many bits as three numbers in 64.
WORDS = (1 << 21) - 1
#: Bytes of text whose phrases share a bucket of slots (half of a bucket of candidates); phrases that a task gathers before it sums them up;
#: candidates of which it tells what it has; counts of a block of the array.
SHARE, GATHER, TUPLES, BLOCK = 8 << 20, 3_000_000, 1_000_000, 1 << 16
#: Bytes of texts that are taken apart at a time.
PART = 2 << 20
#: Of how many texts one goes first for candidates, bytes of texts of a task then, and candidates that are known to all tasks afterwards at most.
FIRST_OF, FIRST_SHARE, KNOWN = 8, 32 << 20, 2_000_000
#: Buckets of slots for each bucket of words, which are told together.
NAMES = 8
#: Slots of a bucket: 1.5 for each phrase of a bucket's text, if words are of six bytes. With more of them the steps between slots take
#: more bits; here about 0.6 others share a slot with a phrase, which makes few rare phrases candidates.
_LOW = np.uint64((1 << 22) - 1)
#: Counts by their bytes.
_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
#: Set in the hash of a word where it stands beside numbers of words.
_TOP = np.uint64(1 << 63)
#: Bits that a heavy slot sets in its word of a bit table.
SET = 4
_GOLD, _OVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xE7037ED1A0B428DB)
#: The first so many bytes of eight.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Bytes from which a word is hashed by itself.
LONG = 256


class Part(NamedTuple):
    """Words of some texts: hashes with the language, the piece each lies in, the text it lies in."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    text: np.ndarray


def language(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def of_language(found: np.ndarray, langs: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of words with those of their languages."""
    hashes = mix(found + langs)
    return np.where(hashes == 0, _GOLD, hashes)  # 0 fills up short phrases


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and a 64-bit hash of each, eight bytes at a time."""
    held = np.empty(len(data) + 2, dtype=bool)
    held[0] = held[-1] = False
    np.take(_KEPT, np.frombuffer(data, np.uint8), out=held[1:-1])
    edge = np.flatnonzero(held[1:] != held[:-1])
    starts, ends = edge[0::2], edge[1::2]
    sizes = ends - starts
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), data + bytes(8), 0, (1,))  # what begins at each byte
    hashes = mix((eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _GOLD)
    at, more = 8, np.flatnonzero(sizes > 8)
    while len(more) and at < LONG:
        hashes[more] = mix(hashes[more] * _OVER + (eight[starts[more] + at] & _FIRST_BYTES[np.minimum(sizes[more] - at, 8)]))
        at += 8
        more = more[sizes[more] > at]
    for i in more.tolist():
        hashes[i] = np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]]))
    return starts, ends, hashes


def part_of(rows: dict[str, list]) -> Part:
    data = b"\n".join(rows["text"]).translate(_BYTES)
    starts, ends, found = hashed_words(data)
    begins = np.cumsum([0] + [len(t) + 1 for t in rows["text"]])
    text = np.repeat(np.arange(len(rows["text"])), np.diff(np.searchsorted(starts, begins)))
    langs = {lang: language(lang) for lang in set(rows["lang"])}
    of_text = np.array([langs[lang] for lang in rows["lang"]], dtype=np.uint64)
    hashes = of_language(found, of_text[text]) if len(found) else found
    ends_of_pieces = np.searchsorted(starts, np.flatnonzero(np.frombuffer(data, np.uint8) == 10))
    piece = np.repeat(np.arange(len(ends_of_pieces) + 1), np.diff(ends_of_pieces, prepend=0, append=len(starts)))
    return Part(data, starts, ends, hashes, piece, text)


def parts_of(rows: dict[str, list]) -> Iterator[tuple[Part, list[str]]]:
    """The words of the texts, about PART bytes at a time, and the languages of those texts."""
    at, size = 0, 0
    for i, t in enumerate(rows["text"]):
        size += len(t)
        if size >= PART or i + 1 == len(rows["text"]):
            own = {n: rows[n][at : i + 1] for n in ("text", "lang")}
            yield part_of(own), own["lang"]
            at, size = i + 1, 0


def slots(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, and its counter there."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), keys & _LOW


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes of equal rank together, compressed; with `opened` as the way back."""
    planes = b"".join((values >> values.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(values.itemsize))
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def opened(packed: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def squeezed_steps(ordered: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits by their steps: the low bits, which are random, as they are, the rest, which is small, compressed."""
    steps = np.diff(ordered, prepend=np.uint32(0))
    bits = max(0, int(steps.mean()).bit_length() - 3) if len(steps) else 0
    low = b"".join(np.packbits((steps >> np.uint32(k)).astype(np.uint8) & np.uint8(1)).tobytes() for k in range(bits))
    return bytes([bits]) + len(low).to_bytes(8, "little") + low + squeezed(steps >> np.uint32(bits))


def opened_steps(packed: bytes) -> np.ndarray:
    bits, end = packed[0], 9 + int.from_bytes(packed[1:9], "little")
    high = opened(packed[end:], np.uint32)
    low = np.zeros(len(high), dtype=np.uint32)
    for k, plane in enumerate(np.frombuffer(packed[9:end], np.uint8).reshape(bits, -1) if bits else ()):
        low |= np.unpackbits(plane, count=len(high)).astype(np.uint32) << np.uint32(k)
    return np.cumsum((high << np.uint32(bits)) | low, dtype=np.uint32)


class BitTable:
    """Heavy slots, each by some bits of one word of 64 in its bucket's part of the table; it may hold others, and lacks none."""

    def __init__(self, words: np.ndarray, buckets: int):
        self.words, self.buckets = words.view(np.uint64), buckets

    @staticmethod
    def place(bucket: np.ndarray | int, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of each slot among the `size` of its bucket, and its bits there."""
        key = mix((np.uint64(bucket) << np.uint64(32)) | slot)
        bits = np.uint64(1) << (key >> np.uint64(58))
        for k in range(1, SET):
            bits |= np.uint64(1) << ((key >> np.uint64(58 - 6 * k)) & np.uint64(63))
        return (((key & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64), bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        bucket, slot = slots(keys, self.buckets)
        size = len(self.words) // self.buckets
        at, bits = self.place(bucket, slot, size)
        return self.words[bucket.astype(np.int64) * size + at] & bits == bits


def bit_table(heavy: DataFrame, buckets: int) -> BitTable:
    """The table of heavy (bucket, slots); heavy: one row for each bucket, slots packed."""
    n = heavy.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    size = max(1, min(TABLE_BITS, max(1 << 10, n // 4 * BITS_EACH)) // 64 // buckets)

    def make():
        def work(rows):
            tables = []
            for b, s in zip(rows["bucket"], rows["slots"], strict=True):
                own = np.zeros(size, dtype=np.uint64)
                np.bitwise_or.at(own, *BitTable.place(b, np.frombuffer(s, np.uint32).astype(np.uint64), size))
                tables.append(own.tobytes())
            return {"bucket": rows["bucket"], "words": tables}

        return work

    found = common.map_rows(heavy.select("bucket", "slots"), make, "bucket long, words binary").toArrow()
    words = np.zeros((buckets, size), dtype=np.uint64)
    for b, own in zip(found["bucket"].to_pylist(), found["words"], strict=True):
        words[b] = np.frombuffer(own.as_buffer(), np.uint64)
    return BitTable(words.reshape(-1), buckets)


def texts_of(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(common.text_of(text).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def keys_at(hashes: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the phrases that begin there."""
    out = np.full(len(at), width, dtype=np.uint64)
    for k in range(width):
        out = out * _OVER + hashes[at + k]
    return mix(out)


def frequent_runs(part: Part, words: BitTable | np.ndarray | None, phrases: BitTable | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """For each width, where phrases begin that may be candidates by the tables (or by what is known of the words), and their keys; none for known words."""
    every = np.arange(len(part.hashes))
    if words is None:
        usable = np.ones(len(every), dtype=bool)
    else:
        usable = words if isinstance(words, np.ndarray) else words.has(keys_at(part.hashes, 1, every))
    shorter = usable
    for width in range(1, longest + 1):
        n = max(0, len(every) - width + 1)
        fit = usable.copy() if width == 1 else shorter[:n] & shorter[1 : n + 1] & (part.piece[:n] == part.piece[width - 1 : width - 1 + n])
        at = np.flatnonzero(fit)
        keys = None if width == 1 and isinstance(words, np.ndarray) else keys_at(part.hashes, width, at)
        if width > 1 and phrases is not None:
            heavy = phrases.has(keys)
            fit[at[~heavy]] = False
            at, keys = at[heavy], keys[heavy]
        yield width, at, keys
        shorter = fit


def names_told(names: list[tuple[np.ndarray, np.ndarray, list[bytes]]], langs: list[str], buckets: int) -> dict[str, list]:
    """Words in the columns of slots, in buckets below 0: their texts in order, as neighbours begin alike. Hashes follow from them."""
    values, code, texts = np.concatenate([n[0] for n in names]), np.concatenate([n[1] for n in names]), np.array([t for n in names for t in n[2]], dtype=object)
    place = (values % np.uint64(buckets)).astype(np.int64) * len(langs) + code
    order = np.argsort(place, kind="stable")
    at = group_starts(place[order])
    own = place[order][at]
    out: dict[str, list] = {"bucket": (-1 - own // len(langs)).tolist(), "lang": [langs[c] for c in (own % len(langs)).tolist()], "single": [None] * len(own), "slots": [None] * len(own), "counts": []}
    for t in np.split(texts[order], at[1:]):
        out["counts"].append(squeezed(np.frombuffer(b"\n".join(sorted(t)), np.uint8)))
    return out


def different_names(rows: pa.Table) -> pa.Table:
    """word, lang, text of what `names_told` gave for a bucket."""
    parts = []
    for lang, counts in zip(*[rows[n].to_pylist() for n in ("lang", "counts")], strict=True):
        texts = opened(counts, np.uint8).tobytes().split(b"\n")
        parts.append(pa.table({"lang": pa.array([lang] * len(texts), pa.string()), "text": pa.array(texts, pa.binary())}))
    found = pa.concat_tables(parts).group_by(["lang", "text"], use_threads=False).aggregate([])
    hashes = hashed_words(b"\n".join(found["text"].to_pylist()))[2]
    langs = found["lang"].combine_chunks().dictionary_encode()
    of = np.array([language(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
    return found.append_column("word", pa.array(of_language(hashes, of[langs.indices.to_numpy()]).view(np.int64)))


def heavy_slots(df: DataFrame, widths: tuple[int, ...], words: Broadcast | None, buckets: int, least: int) -> DataFrame:
    """One row for each bucket: the slots whose counters reach `least`, packed. With a table of words also a row for each that it lets
    through, without one a row for each language, with the number of all its words in `word`."""

    def make():
        known = None if words is None else words.value
        held: list[np.ndarray] = []
        names: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        codes: dict[str, int] = {}  # languages of the task
        totals: dict[str, int] = {}
        told = np.empty(0, dtype=np.uint64)
        late = np.zeros(1 << 20, dtype=np.uint64)  # the last word of each place, to leave out most repeats

        def tell() -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in ("bucket", "single", "slots", "counts")}
            if held:
                bucket, slot = slots(np.concatenate(held), buckets)
                held.clear()
                # by bucket and slot, so that a bucket's slots ascend
                place, counts = np.unique((bucket << np.uint64(32)) | slot, return_counts=True)
                bucket, slot, counts = (place >> np.uint64(32)).astype(np.int64), place.astype(np.uint32), counts.astype(np.uint32)
                for s, c, b in zip(np.split(slot, group_starts(bucket)[1:]), np.split(counts, group_starts(bucket)[1:]), bucket[group_starts(bucket)].tolist(), strict=True):
                    several = c > 1
                    for n, v in zip(out, (b, squeezed_steps(s[~several]), squeezed_steps(s[several]), squeezed(c[several])), strict=True):
                        out[n].append(v)
            out["lang"] = [None] * len(out["bucket"])
            if names:
                more = names_told(names, list(codes), -(-buckets // NAMES))
                names.clear()
                out = {n: out[n] + more[n] for n in out}
            return out

        def name(part: Part, langs: list[str], at: np.ndarray) -> None:
            nonlocal told
            values = part.hashes[at]
            places = (values >> np.uint64(44)).astype(np.int64)
            at = at[late[places] != values]
            late[places] = values
            values, first = np.unique(part.hashes[at], return_index=True)
            fresh = ~among(values, told)
            if fresh.any():
                told, i = np.sort(np.concatenate([told, values[fresh]])), at[first[fresh]]
                code_of = np.array([codes.setdefault(x, len(codes)) for x in langs], dtype=np.int64)
                names.append((values[fresh], code_of[part.text[i]], [part.data[b:e] for b, e in zip(part.starts[i].tolist(), part.ends[i].tolist(), strict=True)]))

        def work(rows):
            if rows is None:
                out = tell()
                for lang, n in totals.items():
                    for column, v in (("bucket", -1 - xxhash.xxh3_64_intdigest(lang) % buckets), ("lang", lang), ("single", None), ("slots", None), ("counts", n.to_bytes(8, "little"))):
                        out[column].append(v)
                return out
            for part, langs in parts_of(rows):
                if known is None:
                    for lang, n in zip(langs, np.bincount(part.text, minlength=len(langs)).tolist(), strict=True):
                        totals[lang] = totals.get(lang, 0) + n
                for width, at, keys in frequent_runs(part, known, None, max(widths)):
                    if width == 1 and known is not None:
                        name(part, langs, at)
                    if width in widths and len(keys):
                        held.append(keys)
            return tell() if sum(map(len, held)) >= GATHER else None

        return work

    schema = pa.schema({"bucket": pa.int64(), "slots": pa.binary(), "word": pa.int64(), "lang": pa.string(), "text": pa.binary()})

    def total(rows: pa.Table) -> pa.Table:
        if rows["bucket"][0].as_py() < 0:
            if words is None:
                found = pa.table({"lang": rows["lang"], "word": pa.array([int.from_bytes(x, "little") for x in rows["counts"].to_pylist()], pa.int64())}).group_by("lang", use_threads=False).aggregate([("word", "sum")]).rename_columns({"word_sum": "word"})
            else:
                found = different_names(rows)
            return pa.table({n: found[n] if n in found.column_names else pa.nulls(len(found), schema.field(n).type) for n in schema.names}, schema=schema)
        arrays = {n: np.concatenate([back(x) for x in rows[n].to_pylist()]) for n, back in (("single", opened_steps), ("slots", opened_steps), ("counts", lambda x: opened(x, np.uint32)))}
        slot, count = np.concatenate([arrays["single"], arrays["slots"]]), np.concatenate([np.ones(len(arrays["single"]), np.int64), arrays["counts"].astype(np.int64)])
        order = np.argsort(slot, kind="stable")
        at = group_starts(slot[order])
        heavy = slot[order][at][np.add.reduceat(count[order], at) >= least] if len(at) else slot
        return pa.table({"bucket": rows["bucket"][:1], "slots": pa.array([heavy.tobytes()], pa.binary()), "word": pa.nulls(1, pa.int64()), "lang": pa.nulls(1, pa.string()), "text": pa.nulls(1, pa.binary())}, schema=schema)

    told = common.map_rows(df, make, "bucket long, lang string, single binary, slots binary, counts binary", finish=True)
    return told.groupBy("bucket").applyInArrow(total, "bucket long, slots binary, word long, lang string, text binary")


class Vocabulary:
    """Numbers of words, from 1 on, and the languages of those words; complete: all that may be frequent have one. Phrases of words that
    all have a number are one whole number each."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, names: list[str], longest: int, complete: bool):
        self.ordered = np.append(hashes, np.uint64(2**64 - 1))
        self.langs, self.names, self.longest, self.bits, self.complete = langs, names, longest, np.uint64(64 // longest), complete
        # where the hashes with given upper bits begin, of which there are few
        self.upper = np.uint64(64 - (2 * len(hashes) + 2).bit_length())
        self.begins = np.searchsorted(hashes, np.arange(1 << (64 - int(self.upper)), dtype=np.uint64) << self.upper).astype(np.int32)

    @property
    def hashes(self) -> np.ndarray:
        return self.ordered[:-1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or 0."""
        ordered = self.ordered
        at = self.begins[(hashes >> self.upper).astype(np.int64)].astype(np.int64)
        more = np.flatnonzero(ordered[at] < hashes)
        while len(more):
            at[more] += 1
            more = more[ordered[at[more]] < hashes[more]]
        return np.where((ordered[at] == hashes) & (at < len(self.hashes)), at + 1, 0).astype(np.uint64)

    def coded(self, columns: list[np.ndarray]) -> np.ndarray:
        """Phrases by the numbers of their first word, second word, and so on."""
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for k, c in enumerate(columns):
            out |= c << (self.bits * np.uint64(self.longest - 1 - k))
        return out

    def columns(self, coded: np.ndarray) -> list[np.ndarray]:
        low = (np.uint64(1) << self.bits) - np.uint64(1)
        return [(coded >> (self.bits * np.uint64(self.longest - 1 - k))) & low for k in range(self.longest)]

    def packed(self, coded: np.ndarray) -> bytes:
        """Ascending phrases by columns, the first by its steps."""
        first, *others = self.columns(coded)
        kind = np.uint32 if self.bits <= 32 else np.uint64
        return squeezed(np.concatenate([np.diff(first, prepend=np.uint64(0)), *others]).astype(kind))

    def opened(self, packed: list[bytes | None]) -> np.ndarray:
        out = [np.empty(0, dtype=np.uint64)]
        for p in packed:
            if p is not None:
                first, *others = opened(p, np.uint32 if self.bits <= 32 else np.uint64).astype(np.uint64).reshape(self.longest, -1)
                out.append(self.coded([np.cumsum(first, dtype=np.uint64), *others]))
        return np.concatenate(out)


def vocabulary(names: DataFrame, longest: int) -> Vocabulary:
    """The words of `names`, or WORDS of them."""
    n, most = names.count(), min(WORDS, (1 << min(62, 64 // longest)) - 1)
    own = names.select("word", "lang")
    if n > most:
        own = own.where(F.pmod(F.col("word"), F.lit(-(-n // max(1, most)))) == 0)
    found = own.toArrow()
    words, first = np.unique(found["word"].to_numpy().view(np.uint64), return_index=True)
    langs = found["lang"].combine_chunks().dictionary_encode()
    return Vocabulary(words[:most], langs.indices.to_numpy()[first][:most].astype(np.int32), langs.dictionary.to_pylist(), longest, n <= most)


def tuples_of(part: Part, width: int, at: np.ndarray, longest: int) -> np.ndarray:
    """The words of phrases, one row each, filled up with zeros."""
    out = np.zeros((len(at), longest), dtype=np.uint64)
    for k in range(width):
        out[:, k] = part.hashes[at + k]
    return out


def keys_of(tuples: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each row of words."""
    out = np.full(len(tuples), tuples.shape[1], dtype=np.uint64)
    for k in range(tuples.shape[1]):
        out = mix(out * (_GOLD + np.uint64(2 * which)) + tuples[:, k])
    return out


def once(tuples: np.ndarray) -> np.ndarray:
    """The different rows."""
    return tallied(tuples, np.ones(len(tuples), dtype=np.int64))[0]


def tallied(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, or rows of words, in order, and the sums of their counts."""
    order = np.argsort(keys) if keys.ndim == 1 else np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    change = np.ones(len(keys), dtype=bool)
    change[1:] = keys[1:] != keys[:-1] if keys.ndim == 1 else (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(change)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def packed_counts(counts: np.ndarray) -> bytes:
    kind = next(k for k in _KINDS.values() if counts.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + squeezed(counts.astype(kind))


def opened_counts(packed: list[bytes]) -> list[np.ndarray]:
    return [opened(p[1:], _KINDS[p[0]]).astype(np.int64) for p in packed]


def packed_rows(tuples: np.ndarray) -> bytes:
    """Rows in order, by columns, as neighbours in a column are more alike."""
    return squeezed(np.ascontiguousarray(tuples.T).reshape(-1))


def opened_rows(packed: list[bytes | None], longest: int) -> np.ndarray:
    return np.concatenate([np.empty((0, longest), np.uint64), *[opened(p, np.uint64).reshape(longest, -1).T for p in packed if p is not None]])


def counts_told(df: DataFrame, tables_: tuple[Broadcast, Broadcast], numbered: Broadcast, known_: Broadcast, longest: int, buckets: int) -> DataFrame:
    """bucket, lang, coded, plain, counts, branch: how often each task met each candidate. Those of numbered words (coded) have no
    language, others (plain) have one. Numbered words and known candidates are counted in one array, told in blocks, in buckets below 0."""

    def make():
        tables, own, known = [t.value for t in tables_], numbered.value, known_.value
        counts = np.zeros(1 + len(own.hashes) + len(known.stored), dtype=np.int64)
        coded: list[np.ndarray] = []  # as they were met
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # those that are not known
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of words, with their language last
        codes: dict[str, int] = {}  # languages of the task
        none: dict[str, list] = {n: [] for n in ("bucket", "lang", "coded", "plain", "counts")}

        def settle() -> None:
            if coded:
                keys, n = np.unique(np.concatenate(coded), return_counts=True)
                coded.clear()
                real, at = known.find(keys[:, None])
                counts[1 + len(own.hashes) + at] += n[real]
                kept.append((keys[~real], n[~real]))
            for some in (kept, held):
                if len(some) > 1 and sum(len(k) for k, _ in some) >= TUPLES // 2:
                    some[:] = [tallied(*map(np.concatenate, zip(*some, strict=True)))]

        def dealt(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The order of rows by place, where each place begins in it, and the places."""
            order = np.argsort(places.astype(np.min_scalar_type(int(places.max(initial=0)))), kind="stable")
            at = group_starts(places[order])
            return order, at, places[order][at]

        def tell() -> dict[str, list]:
            out = {n: list(v) for n, v in none.items()}
            if kept:
                keys, n = tallied(*map(np.concatenate, zip(*kept, strict=True)))
                kept.clear()
                order, at, place = dealt(keys, (mix(keys) % np.uint64(buckets)).astype(np.int64))
                for b, k, c in zip(place.tolist(), np.split(keys[order], at[1:]), np.split(n[order], at[1:]), strict=False):
                    for column, v in zip(out, (b, None, own.packed(k), None, packed_counts(c)), strict=True):
                        out[column].append(v)
            if held:
                rows, n = tallied(*map(np.concatenate, zip(*held, strict=True)))
                held.clear()
                names = list(codes)
                order, at, place = dealt(rows, (keys_of(rows[:, :longest], 0) % np.uint64(buckets)).astype(np.int64) + rows[:, longest].astype(np.int64) * buckets)
                for b, k, c in zip(place.tolist(), np.split(rows[order], at[1:]), np.split(n[order], at[1:]), strict=False):
                    for column, v in zip(out, (b % buckets, names[b // buckets], None, packed_rows(k[:, :longest]), packed_counts(c)), strict=True):
                        out[column].append(v)
            return out

        def work(rows):
            if rows is None:
                settle()
                out = tell()
                for b in range(-(-len(counts) // BLOCK)):
                    if (part := counts[b * BLOCK : (b + 1) * BLOCK]).any():
                        for column, v in zip(out, (-1 - b, None, None, None, packed_counts(part)), strict=True):
                            out[column].append(v)
                return out
            out = None
            for part, langs in parts_of(rows):
                code_of = np.array([codes.setdefault(x, len(codes)) for x in langs], dtype=np.uint64)
                number = own.numbers(part.hashes)
                usable = number > 0
                if not own.complete:
                    others = np.flatnonzero(~usable)
                    usable[others] = tables[0].has(keys_at(part.hashes, 1, others))
                for width, at, _ in frequent_runs(part, usable, tables[1], longest):
                    if not own.complete:
                        every = np.logical_and.reduce([number[at + k] > 0 for k in range(width)])
                        tuples = np.column_stack([tuples_of(part, width, at[~every], longest), code_of[part.text[at[~every]]]])
                        held.append(tallied(tuples, np.ones(len(tuples), dtype=np.int64)))
                        at = at[every]
                    if width == 1:
                        np.add.at(counts, number[at].astype(np.int64), 1)
                    else:
                        coded.append(own.coded([number[at + k] for k in range(width)]))
                if sum(map(len, coded)) + 2 * sum(len(k) for k, _ in held) >= GATHER:
                    settle()
                    if sum(len(k) for k, _ in kept + held) >= TUPLES:
                        more = tell()
                        out = more if out is None else {n: out[n] + v for n, v in more.items()}
            return out

        return work

    told = common.map_rows(df, make, "bucket long, lang string, coded binary, plain binary, counts binary", finish=True)
    return told.withColumn("branch", F.when(F.col("bucket") < 0, F.pmod(F.spark_partition_id(), F.lit(16))).otherwise(0))


def summed(told: DataFrame, numbered: Broadcast, known: Broadcast, longest: int, least: int, most: int = 0) -> DataFrame:
    """The same columns with the sums of the counts, without the candidates that are not known and do not reach `least`.
    often, n: of those with numbers the most frequent, at most so many, and how many those are."""

    def add(rows: pa.Table) -> pa.Table:
        own, coded, plain, often, n = numbered.value, None, None, None, 0
        counts = opened_counts(rows["counts"].to_pylist())
        if rows["bucket"][0].as_py() < 0:
            total = np.zeros(max(map(len, counts)), dtype=np.int64)  # the last block of the first texts is shorter
            for c in counts:
                total[: len(c)] += c
        elif rows["coded"][0].as_py() is None:
            tuples, total = tallied(opened_rows(rows["plain"].to_pylist(), longest), np.concatenate(counts))
            plain, total = packed_rows(tuples[total >= least]), total[total >= least]
        else:
            keys, total = tallied(own.opened(rows["coded"].to_pylist()), np.concatenate(counts))
            use = (total >= least) | known.value.find(keys[:, None])[0]
            keys, total = keys[use], total[use]
            coded, n = own.packed(keys), min(most, len(keys))
            often = own.packed(np.sort(keys[np.argsort(-total, kind="stable")[:most]]))
        return pa.table({n: rows[n][:1] for n in ("bucket", "lang")} | {n: pa.array([v], pa.binary()) for n, v in (("coded", coded), ("plain", plain), ("counts", packed_counts(total)))} | {"branch": rows["branch"][:1], "often": pa.array([often], pa.binary()), "n": pa.array([n], pa.int64())})

    return told.groupBy("bucket", "lang", "branch").applyInArrow(add, "bucket long, lang string, coded binary, plain binary, counts binary, branch int, often binary, n long")


def counted(df: DataFrame, size: int, tables: tuple[Broadcast, Broadcast], numbered: Broadcast, longest: int, buckets: int, least: int) -> tuple[DataFrame, Broadcast, np.ndarray]:
    """What `summed` gives for all texts, the perfect hash of the known candidates, and the counts of what stands in the array; size: bytes of the texts.

    Most candidates occur in most tasks. So the texts of an eighth of all hashes, which are read by fewer tasks, tell theirs first. Those
    that are frequent in them get slots, in which all tasks count them, and what else they meet they tell with its count.
    """
    spark = df.sparkSession
    early = F.pmod(F.xxhash64("text"), F.lit(FIRST_OF)) == 0
    none = spark.sparkContext.broadcast(PerfectHash(np.empty((0, 1), dtype=np.uint64)))
    few = df.where(early).coalesce(max(1, -(-size // (FIRST_OF * FIRST_SHARE))))
    limit = min(KNOWN, SLICE)
    most = -(-limit // buckets)
    first = common.checkpointed(summed(counts_told(few, tables, numbered, none, longest, buckets), numbered, none, longest, 0, most))
    n = first.agg(F.sum("n")).first()[0] or 0
    kept = first.where((F.col("bucket") >= 0) & (F.col("bucket") % max(1, -(-n // limit)) == 0))
    often = numbered.value.opened(kept.select("often").toArrow()["often"].to_pylist())
    known = spark.sparkContext.broadcast(PerfectHash(np.sort(often)[:, None]))
    told = counts_told(df.where(~early), tables, numbered, known, longest, buckets)
    found = common.checkpointed(summed(told.unionByName(first.drop("often", "n")), numbered, known, longest, least))
    blocks = summed(found.where("bucket < 0").withColumn("branch", F.lit(0)), numbered, known, longest, least).select("bucket", "counts").toArrow()
    counts = np.zeros(1 + len(numbered.value.hashes) + len(known.value.stored), dtype=np.int64)
    for b, part in zip(blocks["bucket"].to_pylist(), opened_counts(blocks["counts"].to_pylist()), strict=True):
        counts[(-1 - b) * BLOCK : (-1 - b) * BLOCK + len(part)] += part
    return found.where("bucket >= 0"), known, counts


class PerfectHash:
    """A minimal perfect hash in levels: a key's slot is the rank of its bit in the first level where no other key has that bit."""

    def __init__(self, tuples: np.ndarray):
        a, b = keys_of(tuples, 0), keys_of(tuples, 1)
        self.sizes: list[int] = []
        parts = []
        while len(a):
            size = -(-2 * len(a) // 64) * 64
            at = self.place(a, b, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            parts.append(alone)
            stay = ~alone[at]
            a, b = a[stay], b[stay]
        bits = np.concatenate(parts) if parts else np.zeros(64, dtype=bool)
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.stored = np.zeros_like(tuples)
        if len(tuples):
            self.stored[self.slots(tuples)] = tuples

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + np.uint64((level + 1) * int(_GOLD) % 2**64) + mix(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def slots(self, tuples: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for what is no key."""
        out = np.full(len(tuples), -1, dtype=np.int64)
        a, b, left, start = keys_of(tuples, 0), keys_of(tuples, 1), np.arange(len(tuples)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + self.place(a, b, level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = rank
            left, a, b, start = left[~hit], a[~hit], b[~hit], start + size
        return out

    def find(self, tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are keys, by the stored words, and the slots of those."""
        at = self.slots(tuples)
        real = at >= 0
        real[real] = (self.stored[at[real]] == tuples[real]).all(axis=1)
        return real, at[real]


def frequent(found: DataFrame, known_: Broadcast, counts_: Broadcast, numbered: Broadcast, least: int, longest: int) -> DataFrame:
    """lang, w1, w2 and so on, a, head, tail: frequent phrases by the numbers of their words (by their hashes and _TOP, where a word has
    none), filled up with zeros, and the counts of their first and their last words, if numbered. Words alone only without a number."""
    names = [f"w{k + 1}" for k in range(longest)]
    schema = "lang string, " + ", ".join(f"{n} long" for n in names) + ", a long, head long, tail long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, counts = numbered.value, known_.value, counts_.value
        texts = np.array(own.names, dtype=object)
        for batch in batches:
            for row in batch.to_pylist():  # a bucket
                (a,) = opened_counts([row["counts"]])
                if row["coded"] is not None:
                    keys = own.opened([row["coded"]])
                    real, at = known.find(keys[:, None])
                    a[real] += counts[1 + len(own.hashes) + at]
                    a, numbers = a[a >= least], np.column_stack(own.columns(keys[a >= least]))
                    words, lang = numbers, texts[own.langs[numbers[:, 0].astype(np.int64) - 1]] if len(numbers) else texts[:0]
                else:
                    tuples = opened_rows([row["plain"]], longest)
                    numbers = np.column_stack([own.numbers(tuples[:, k]) for k in range(longest)])
                    words, lang = np.where(numbers > 0, numbers, np.where(tuples > 0, tuples | _TOP, 0)), np.full(len(tuples), row["lang"], dtype=object)
                ends = numbers[np.arange(len(words)), (words > 0).sum(axis=1) - 1]
                parts = [pa.array(counts[n.astype(np.int64)], pa.int64(), mask=n == 0) for n in (numbers[:, 0], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), *[pa.array(words[:, k].view(np.int64)) for k in range(longest)], pa.array(a), *parts], names=["lang", *names, "a", "head", "tail"])

    return found.select("lang", "coded", "plain", "counts").mapInArrow(run, schema)


def scored(rows: DataFrame, longest: int, inside_of: int, complete: bool) -> list[DataFrame]:
    """For each width from 2 on lang, w1, w2 and so on, a, l, r, score: phrases with their lowest-scoring cuts, without those that lie in a
    longer phrase with inside_of hundredths of their count or more. A longest such phrase has one word more, and its parts are known."""
    names = [f"w{k + 1}" for k in range(longest)]
    if not complete:
        singles = rows.where(F.col(names[1]) == 0)
        rows = rows.where(F.col(names[1]) != 0)
        for part, word in (("head", F.col(names[0])), ("tail", F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in reversed(names)]))):
            rows = rows.withColumn("at_end", word).join(singles.select((F.col(names[0]) + 0).alias("at_end"), (F.col("a") + 0).alias("n")), "at_end", "left")
            rows = rows.withColumn(part, F.coalesce(part, "n")).drop("at_end", "n")
        rows = common.checkpointed(rows)
    of_width = lambda m: rows.where((F.col(names[m - 1]) != 0) & (F.col(names[m]) == 0 if m < longest else F.lit(True)))
    out: list[DataFrame] = []
    for m in range(2, longest + 1):
        own = of_width(m).withColumnsRenamed({"head": "l1", "tail": "r1"})
        for j in range(2, m):
            for side, words in (("l", names[:j]), ("r", names[m - j : m])):
                parts = of_width(j).select(*[(F.col(n) + 0).alias(w) for n, w in zip(names, words, strict=False)], (F.col("a") + 0).alias(f"{side}{j}"))
                own = own.join(parts, words)
        small = (F.col("a") < 3_000_000) & F.greatest(*[F.col(f"{x}{j}") for x in "lr" for j in range(1, m)], F.lit(0)).between(0, 3_000_000_000)
        cuts = []
        for k in range(1, m):
            score = F.when(small, F.expr(f"(1000000 * a * a) div (l{k} * r{m - k})")).otherwise(F.expr(f"(cast(a as decimal(18, 0)) * a * 1000000) div (cast(l{k} as decimal(18, 0)) * r{m - k})"))
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{m - k}").alias("r")))
        own = own.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        own = own.select("lang", *names, "a", *[F.col(f"cut.{n}").alias(n) for n in ("l", "r", "score")], *[f"{x}{m - 1}" for x in "lr" if m > 2])
        if m > 2:
            own = common.checkpointed(own)
            inner = [own.where(100 * F.col("a") >= inside_of * F.col(part)).select(*[(F.col(w) + 0).alias(n) for n, w in zip(names, words, strict=False)]) for part, words in ((f"l{m - 1}", names[: m - 1]), (f"r{m - 1}", names[1:m]))]
            out[-1] = out[-1].join(inner[0].unionByName(inner[1]), names[: m - 1], "left_anti")
        out.append(own.select("lang", *names, "a", "l", "r", "score"))
    return out


def best_of_tasks(df: DataFrame, first: int) -> DataFrame:
    """The rows of each language that are among the first of their task by score and count, ties included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, np.ndarray] = {}
        held: list[pa.RecordBatch] = []

        def left(batch: pa.RecordBatch, fresh: bool) -> pa.RecordBatch:
            rank = (batch["score"].to_numpy() << 43) + np.minimum(batch["a"].to_numpy(), (1 << 43) - 1)  # a score has 20 bits
            langs = batch["lang"].dictionary_encode()
            code, use = langs.indices.to_numpy(), np.zeros(len(rank), dtype=bool)
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                own = code == c
                if fresh:
                    ranks = np.concatenate([best.get(lang, rank[:0]), rank[own]])
                    best[lang] = np.partition(ranks, -first)[-first:] if len(ranks) > first else ranks
                use |= own & ((len(best[lang]) < first) | (rank >= best[lang].min()))
            return batch.filter(pa.array(use))

        for batch in batches:
            held.append(left(batch, True))
            if sum(b.num_rows for b in held) > 100_000:
                held[:] = [left(b, False) for b in held]
                if sum(b.num_rows for b in held) > 50_000:
                    yield from held
                    held.clear()
        yield from (left(b, False) for b in held)

    return df.mapInArrow(run, df.schema)


def with_hashes(df: DataFrame, numbered: Broadcast, longest: int) -> DataFrame:
    """Words of phrases by their hashes and _TOP, all of them."""
    names = [f"w{k + 1}" for k in range(longest)]

    def make():
        hashes = (np.concatenate([np.zeros(1, np.uint64), numbered.value.hashes]) | _TOP).view(np.int64)
        hashes[0] = 0
        return lambda rows: rows | {n: np.where((w := np.array(rows[n], dtype=np.int64)) >= 0, hashes[np.maximum(w, 0)], w) for n in names}

    return common.map_rows(df, make, df.schema)


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, inside_of: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    given = texts_of(df, text, lang)
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // SHARE))
    share = given.sparkSession.sparkContext.broadcast
    one = common.checkpointed(heavy_slots(given, (1,), None, buckets, least))
    words, n = share(bit_table(one.where("slots is not null"), buckets)), one.where("slots is null").select("lang", F.col("word").alias("n"))
    told = common.checkpointed(heavy_slots(given, tuple(range(2, longest + 1)), words, buckets, least))
    tables, names = (words, share(bit_table(told.where("slots is not null"), buckets))), told.where("word is not null").select(F.col("word").bitwiseOR(F.lit(-(1 << 63))).alias("word"), "lang", "text")
    numbered = share(vocabulary(told.where("word is not null"), longest))
    if names.groupBy("word").count().where("count > 1").limit(1).count():
        raise RuntimeError("two words of one language share a hash of 63 bits; change the multipliers of hashed_words")
    found, known, counts = counted(given, size, tables, numbered, longest, -(-buckets // 2), least)
    rows = frequent(found, known, share(counts), numbered, least, longest)
    best = [best_of_tasks(x, first) for x in scored(rows, longest, inside_of, numbered.value.complete)]
    # words are joined to those alone that may be among the first: by score and count, ties included
    found = functools.reduce(DataFrame.unionByName, best)
    for part in ([F.pmod(F.xxhash64("w1", "w2"), F.lit(16))], []):
        found = found.withColumn("at_best", F.rank().over(Window.partitionBy("lang", *part).orderBy(F.desc("score"), F.desc("a")))).where(F.col("at_best") <= first)
    found = with_hashes(found, numbered, longest)
    for k in range(1, longest + 1):
        found = found.join(names.select((F.col("word") + 0).alias(f"w{k}"), F.col("text").alias(f"t{k}")), f"w{k}", "left")
    phrase = F.array_join(F.array_compact(F.array(*[F.col(f"t{k}").cast("string") for k in range(1, longest + 1)])), " ")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = found.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_perfect_hash_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))
