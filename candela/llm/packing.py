"""Packing by power-of-two decomposition.

Each document (its ids and the end id) is cut into pieces whose lengths are powers of two: as many of the full
length as fit, then the binary digits of the rest, longest first. A piece is a sequence of its own, so no sequence
crosses documents, and none needs padding. Sequences of one length form a bucket; sequence_id carries the bucket
in its leading bits, so an order by sequence_id gives runs of equal lengths from which batches are cut.

Cases: null text counts as empty, and gives the end id alone; repeated rows get sequences of their own; an empty
table gives an empty result; extra columns are ignored; a text of any length is cut without loss.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LENGTH = 4096
END_ID = 2
#: Below this code point, letters and digits are told apart by a class built from their categories.
PLAIN = 0x300
#: Texts on which a vocabulary shows whether it is of the make that `WordIds` puts together.
PROBES = ("It's A Test,  don't 12.5!", "Été naïve--x\n\tI'LL go_on (7)", "a  b", "ß¼ x²")


def _class(kinds: str) -> str:
    return "".join(f"\\x{c:02x}" if c < 256 else f"\\u{c:04x}" for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds)


class WordIds:
    """Ids of whole texts, put together from the ids of their words.

    The vocabulary drops white space, lower-cases, and never merges across its words, so the ids of a text are
    those of its words, one after the other. Each word is encoded by the library once and then kept, up to a bound.
    Texts outside the plain range, or with special strings, go to the library as they are.
    """

    def __init__(self, library, bound: int = 700_000):
        self.library, self.bound, self.known = library, bound, {}
        self.ends = np.zeros(library.get_vocab_size(), dtype=bool)
        self.ends[[i for w, i in library.get_vocab().items() if w.endswith("</w>")]] = True
        letters, digits = _class("L"), _class("N")
        self.words = re.compile(rf"[{letters}]+|[{digits}]|'s|'t|'re|'ve|'m|'ll|'d|[^{letters}{digits}\t-\r \xa0]+")
        # beyond the plain range, signs of other kinds of white space, and a letter whose lower form is two
        self.odd = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u02ff]")
        # a vocabulary of another make is left to the library
        ids = lambda t: np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.whole = not self.ends.any() or any(b"".join(ids(w) for w in self.words.findall(t.lower())) != ids(t) for t in PROBES)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned little-endian 32-bit numbers."""
        out: list[bytes] = []
        get = self.known.__getitem__
        for k in range(0, len(texts), 128):
            new: dict[int, list[str]] = {}  # texts with words that are not known yet
            for t in texts[k : k + 128]:
                if self.whole or "<|" in t or self.odd.search(t):
                    out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())
                    continue
                words = self.words.findall(t.lower())
                try:
                    out.append(b"".join(map(get, words)))
                except KeyError:
                    new[len(out)] = words
                    out.append(b"")
            if not new:
                continue
            unknown = set().union(*new.values()).difference(self.known)
            if len(self.known) + len(unknown) > self.bound:
                self.known.clear()
                unknown = set().union(*new.values())
            words = list(unknown)
            for i in range(0, len(words), 4096):
                self.learn(words[i : i + 4096])
            for at, words in new.items():
                out[at] = b"".join(map(get, words))
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words as one text, set apart by spaces, and cut its ids after each one that ends a word."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or len(ids) != cuts[-1]:
            for w in words:
                self.known[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        raw, at = ids.tobytes(), 0
        for w, cut in zip(words, (4 * cuts).tolist(), strict=True):
            self.known[w] = raw[at:cut]
            at = cut


@functools.lru_cache(maxsize=1)
def kept_word_ids(tokenizer: str) -> WordIds:
    """Kept for the life of the worker process, so that words are learned once in it and not once in each task."""
    return WordIds(common.load_tokenizer(tokenizer))


def piece_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to n, longest first."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(df: DataFrame, tokenizer: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, most: int = MAX_LENGTH, with_ids: bool = False, keep_words: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids (if asked for), sequence_id, offset, bucket.

    With keep_words, a worker keeps the words it has learned from task to task: less time, for about 60 MB of a worker's
    memory until it ends. Results are the same.
    """

    def make():
        encode = kept_word_ids(tokenizer) if keep_words else WordIds(common.load_tokenizer(tokenizer))
        end = np.array([end_id], dtype="<u4").tobytes()

        def work(rows):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for i, ids in zip(rows["doc_id"], encode(rows["text"]), strict=True):
                raw, at = ids + end, 0
                for n in piece_lengths(len(raw) // 4, most):
                    out["doc_id"].append(i)
                    out["start"].append(at)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    out["doc_tokens"].append(len(raw) // 4)
                    if with_ids:
                        out["ids"].append(np.frombuffer(raw, dtype="<i4", count=n, offset=4 * at))
                    at += n
            return out

        return work

    kept = df.select(F.col(doc_id).alias("doc_id"), common.text_of(text).alias("text"))
    pieces = common.map_rows(kept, make, f"doc_id {kept.dtypes[0][1]}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    pieces = pieces.withColumn("bucket", F.round(F.log2("length")).cast("int"))
    shift = 59 if most < 1 << 16 else 55
    pieces = pieces.withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), shift) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return pieces.sortWithinPartitions("sequence_id").select(*[c for c in pieces.columns if c != "bucket"], "bucket")


def op2_power_of_two_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), keep_words=True)
