"""Token counts with overlap resynchronisation.

A huge text is encoded in overlapping chunks, with offsets, and the encodings are spliced at a boundary that is
proven to be one in the encoding of the whole text. A position p is proven when

* text[p] is a plain space between two characters that are not white space, and
* a token ends at p in the encodings of both chunks.

The pre-tokenizer of byte-level vocabularies lets a space only begin a piece, so a piece always starts at such a
p, whatever stands to its left; merges never cross pieces, and added tokens hold no space. Where an overlap has no
such position (a long run without spaces), the overlap is doubled, up to the rest of the text.

Other texts, where no ids are asked for, are cut at all their plain spaces between two characters that are not white space: the
counts of the parts add up to the text's. A worker lets the library encode a part once and keeps its count, up to a bound.
This is done only where the vocabulary shows that it is of this make; texts of others are encoded whole.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and ids are counted row by row; an empty table
gives an empty result; extra columns are ignored, or kept where asked for; a kept column that is named like a result
gets `_in` at its end.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import DataFrame

from . import common

STABLE = re.compile(r"(?<=\S) (?=\S)")
#: A part whose count is kept: without plain spaces, no white space at its ends, not long. A space ahead marks a text's first part.
KEPT = re.compile(r" ?\S(?:[^ ]{0,62}\S)?")
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256


def encode_spliced(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of the whole text, found chunk by chunk."""
    out: list[int] = []
    start, done = 0, 0  # where the chunk begins; ids are out for text[:done]
    here, end = None, 0
    while True:
        if here is None:
            end = min(len(text), start + chunk)
            here = tokenizer.encode(text[start:end], add_special_tokens=False)
        ends = [start + e for _, e in here.offsets]
        first = _after(ends, done)
        if end == len(text):
            out += here.ids[first:]
            return out
        width = overlap
        while True:
            back = max(done, end - width)
            stop = min(len(text), back + max(chunk, 2 * width))
            there = tokenizer.encode(text[back:stop], add_special_tokens=False)
            both = set(ends).intersection(back + e for _, e in there.offsets)
            splice = next((m.start() for m in reversed(list(STABLE.finditer(text, back, end))) if m.start() in both and m.start() > back), None)
            if splice is not None:
                out += here.ids[first : _after(ends, splice)]
                start, done = back, splice
                here, end = there, stop  # encoded already
                break
            if back == done:  # the overlap holds all that is left of this chunk: widen to the right
                chunk *= 2
                start, here = done, None
                break
            width *= 2


def _after(ends: list[int], position: int) -> int:
    """The number of tokens that end at or before position."""
    import bisect

    return bisect.bisect_right(ends, position)


def spaces_begin_pieces(library) -> bool:
    """Whether a vocabulary is of the make for which the positions above are proven without a look at its tokens."""
    made = json.loads(library.to_str())
    pieces, model = made["pre_tokenizer"] or {}, made["model"]
    return (
        made["normalizer"] is None
        and pieces.get("type") == "ByteLevel"
        and pieces.get("use_regex", True)
        and not pieces["add_prefix_space"]
        and model["type"] == "BPE"
        and not model.get("dropout")
        # an added token of letters alone may stand inside words
        and not any(re.search(r"\s|^[A-Za-z]+$", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in made["added_tokens"])
    )


class PartCounts:
    """Numbers of tokens of whole texts, added up from those of their parts.

    When `bound` parts are known they become the older ones, from which a part that comes again is taken over, and those
    that were older until then are forgotten.
    """

    def __init__(self, library, bound: int = 400_000):
        self.batch, self.bound = getattr(library, "encode_batch_fast", library.encode_batch), bound
        self.merge = library.model.tokenize
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.whole = not spaces_begin_pieces(library)

    def __call__(self, texts: list[str]) -> list[int]:
        some = self.of_whole if self.whole else self.of_parts
        return [n for k in range(0, len(texts), 64) for n in some(texts[k : k + 64])]

    def of_whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.batch(texts, add_special_tokens=False)]

    def of_parts(self, texts: list[str]) -> list[int]:
        if len(self.known) >= self.bound:
            self.known, self.older = {}, self.known
        totals, rests = [], []
        for t in texts:
            total, rest = self.look(t.split(" "))
            if not all(map(KEPT.fullmatch, rest)):  # spaces beside white space, or a long part
                total, rest = self.look(STABLE.split(t))
            totals.append(total)
            rests.append(rest)
        new = set().union(*rests)
        counts = {w: self.older[w] for w in new if w in self.older}
        self.learn([w for w in new if w not in counts], counts)
        self.known.update((w, n) for w, n in counts.items() if KEPT.fullmatch(w))
        return [n + sum(map(counts.__getitem__, rest)) for n, rest in zip(totals, rests, strict=True)]

    def look(self, parts: list[str]) -> tuple[int, list[str]]:
        """The tokens of the parts that are known, and the other parts."""
        parts[0] = " " + parts[0]
        found = list(map(self.known.get, parts))
        return sum(filter(None, found)), [w for w, n in zip(parts, found, strict=True) if n is None]

    def learn(self, parts: list[str], counts: dict[str, int]) -> None:
        others = []
        for w in parts:
            if w.isascii() and w.isalpha():  # one piece with the space ahead, whose sign is the first letter here
                counts[w] = len(self.merge("\u0120" + w))
            else:
                others.append(w)
        for k in range(0, len(others), 64):
            words = others[k : k + 64]
            counts.update(zip(words, self.of_whole([w[1:] if w[0] == " " else " " + w for w in words]), strict=True))


@functools.lru_cache(maxsize=1)
def kept_part_counts(tokenizer: str) -> PartCounts:
    """Kept for the life of the worker process, so that parts are learned once in it and not once in each task."""
    return PartCounts(common.load_tokenizer(tokenizer))


def count_tokens(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, with_ids: bool = False) -> DataFrame:
    """keep columns, n_bytes, n_tokens, over_limit (n_tokens > limit) and, if asked for, the ids of each text."""

    def make():
        library = common.load_tokenizer(tokenizer)
        batch = getattr(library, "encode_batch_fast", library.encode_batch)
        parts = None if with_ids else kept_part_counts(tokenizer)

        def work(texts):
            found: list = [None] * len(texts)  # ids, or their number
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            if with_ids:
                for k in range(0, len(short), 64):
                    part = short[k : k + 64]
                    for i, e in zip(part, batch([texts[i] for i in part], add_special_tokens=False), strict=True):
                        found[i] = e.ids
            else:
                for i, n in zip(short, parts([texts[i] for i in short]), strict=True):
                    found[i] = n
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    ids = encode_spliced(library, t, chunk, overlap)
                    found[i] = ids if with_ids else len(ids)
            counts = [len(x) for x in found] if with_ids else found
            out = {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}
            return out | ({"ids": found} if with_ids else {})

        return work

    return common.map_texts(df, text, keep, make, "n_bytes long, n_tokens long, over_limit boolean" + ", ids array<int>" * with_ids)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
