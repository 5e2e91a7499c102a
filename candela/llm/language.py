"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator seeded by its code point. An n-gram is bound
by multiplying its letters' vectors, each rotated by its place from the right; a text is the bundle (sum) of its
n-grams, a language the bundle of its texts scaled to length one. A text gets the language of the largest cosine.

Letters are the characters of the lower-cased text for which `str.isalpha` holds; all else is a word end. Sums are of
whole numbers and exact, so a text has one vector, whatever rows a task has met before.

Cases: null text, and text without letters, give `und` with score 0; short texts are padded with word ends, so one
letter suffices; very long texts are bundled piece by piece; ties go to the first language in alphabetical order; with
nothing to learn from, all are `und`; repeated rows each count; an empty table gives an empty result; extra columns are
ignored, or kept where asked for; a kept column that is named like a result gets `_in` at its end.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import mix

DIMENSIONS = 1024
UNKNOWN = "und"
#: Bits of a letter within the key of an n-gram; word ends are 0.
LETTER_BITS = 21
#: n-grams of a text that are bundled in one piece, and of texts that are bundled together.
PIECE, TOGETHER = 1 << 20, 1 << 18


@functools.lru_cache(maxsize=16_384)
def letter_vector(letter: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([7, letter])).choice(np.array([-1, 1], dtype=np.int8), dimensions)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Bundler:
    """Bundles of texts, as rows of a matrix.

    The vectors of the n-grams met are kept, up to a bound, as rows of a matrix, and a group of texts is a matrix of
    counts times that matrix. Keys of n-grams find their row in a table by their hash; those whose place in the table
    is another's are looked up one by one.
    """

    TABLE = 1 << 18

    def __init__(self, n: int = 3, dimensions: int = DIMENSIONS, bound: int = 16_384):
        if not 1 <= n <= 63 // LETTER_BITS:
            raise ValueError(f"n must be from 1 to {63 // LETTER_BITS}")
        self.n, self.dimensions, self.bound = n, dimensions, bound
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, self.dimensions), dtype=np.float32)
        self.keys, self.places = np.full(self.TABLE, -1, dtype=np.int64), np.zeros(self.TABLE, dtype=np.int64)

    def vector(self, key: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.int8)
        for k in range(self.n):
            letter = key >> (LETTER_BITS * k) & (1 << LETTER_BITS) - 1
            out = out * np.roll(letter_vector(letter or ord(" "), self.dimensions), k)
        return out

    def grams(self, text: str) -> np.ndarray:
        """The keys of the text's n-grams; none for a text without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        code = np.where(_letters()[points], points, 0).astype(np.int64)
        if not code.any():
            return np.empty(0, dtype=np.int64)
        code = np.concatenate([[0], code, [0]])
        code = code[(code != 0) | np.concatenate([[True], code[:-1] != 0])]
        size = len(code) - self.n + 1
        return functools.reduce(lambda out, k: out << LETTER_BITS | code[k : k + size], range(1, self.n), code[:size])

    def find(self, keys: np.ndarray) -> np.ndarray | None:
        """The matrix rows of keys; none if there is no room for those that are new."""
        slots = (mix(keys.astype(np.uint64)) & np.uint64(self.TABLE - 1)).astype(np.int64)
        at, missed = self.places[slots], self.keys[slots] != keys
        if missed.any():
            new, back = np.unique(keys[missed], return_inverse=True)
            found = [self.rows.get(k, -1) for k in new.tolist()]
            if len(self.rows) + found.count(-1) > 2 * self.bound:
                return None
            for i, row in enumerate(found):
                if row < 0:
                    row = found[i] = self.rows[int(new[i])] = len(self.rows)
                    if row == len(self.matrix):
                        self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
                    self.matrix[row] = self.vector(int(new[i]))
            rows = np.array(found)
            at[missed] = rows[back]
            slots = slots[missed]
            self.keys[slots], self.places[slots] = keys[missed], at[missed]
        return at

    def add(self, out: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> None:
        """Add the vectors of keys to rows of out. parts: row of out, keys."""
        keys = np.concatenate([k for _, k in parts])
        at = self.find(keys)
        if at is None:
            if self.rows:
                self.clear()
                self.add(out, parts)
            elif len(parts) > 1:
                self.add(out, parts[: len(parts) // 2])
                self.add(out, parts[len(parts) // 2 :])
            else:
                (row, keys), *_ = parts
                self.add(out, [(row, keys[: len(keys) // 2])])
                self.add(out, [(row, keys[len(keys) // 2 :])])
            return
        width = len(self.rows)
        owner = np.repeat(np.arange(len(parts)) * width, [len(k) for _, k in parts])
        counts = np.bincount(owner + at, minlength=len(parts) * width).reshape(len(parts), width).astype(np.float32)
        used = np.flatnonzero(counts.any(axis=0))
        sums = counts[:, used] @ self.matrix[used] if 2 * len(used) < width else counts @ self.matrix[:width]
        for (row, _), s in zip(parts, sums, strict=True):
            out[row] += s

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row for each text; zeros for a text without letters."""
        out = np.zeros((len(texts), self.dimensions))
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            keys = self.grams(text)
            for k in range(0, len(keys), PIECE):
                waiting.append((i, keys[k : k + PIECE]))
                held += len(waiting[-1][1])
                if held > TOGETHER or len(waiting) == 64:
                    self.add(out, waiting)
                    waiting, held = [], 0
        if waiting:
            self.add(out, waiting)
        return out


def fit_prototypes(df: DataFrame, text: str = "text", lang: str = "lang", n: int = 3, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A unit vector for each language, over all rows with a language. Only languages x dimensions numbers reach the driver."""

    def make():
        bundle, sums = Bundler(n, dimensions), {}

        def work(rows):
            if rows is None:
                where = [(k, i) for k in sums for i in range(dimensions)]
                return {"lang": [k for k, _ in where], "dimension": [i for _, i in where], "value": [float(sums[k][i]) for k, i in where]}
            vectors = bundle(rows["text"])
            sizes = np.linalg.norm(vectors, axis=1)
            for v, size, k in zip(vectors, sizes, rows["lang"], strict=True):
                if size:
                    sums[k] = sums.get(k, 0) + v / size
            return None

        return work

    kept = df.select(common.text_of(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    parts = common.map_rows(kept, make, "lang string, dimension int, value double", finish=True)
    out: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "dimension").agg(F.sum("value").alias("value")).collect():
        out.setdefault(row.lang, np.zeros(dimensions))[row.dimension] = row.value
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = 3) -> DataFrame:
    """keep columns, lang_pred and score, the cosine with that language's prototype (0 where negative)."""
    names = list(prototypes)
    dimensions = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    matrix = np.array([prototypes[k] for k in names]) if names else np.zeros((0, dimensions))

    def make():
        bundle = Bundler(n, dimensions)

        def work(texts):
            vectors = bundle(texts)
            sizes = np.linalg.norm(vectors, axis=1)
            known = (sizes > 0) & bool(names)
            cosines = vectors @ matrix.T / np.where(known, sizes, 1)[:, None] if names else np.zeros((len(vectors), 1))
            best = np.argmax(cosines, axis=1)
            scores = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0), 0.0)
            return {"lang_pred": [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], "score": scores.tolist()}

        return work

    return common.map_texts(df, text, keep, make, "lang_pred string, score double")


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.crc_mod("doc_id", 3) == 1
    prototypes = fit_prototypes(documents.where(~held_out))
    return identify(documents, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
