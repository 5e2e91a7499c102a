"""Toxicity scores of texts restored by a noisy-channel decoder.

1. A character language model is counted over all documents: n-grams of folded letters and word ends.
2. Tokens with a letter and a digit or sign that may stand for one, a mask, a sign inside, or a letter repeated, and
   letters set apart, become lattices: each position lists what it may stand for, at a cost, and the Viterbi path of least cost under the
   language model restores the span. A word without such traces has a lattice of one path, which is the word itself.
3. Words of the restored text, and their first letters, are held against a lexicon of terms that tell labelled toxic
   texts from others; a logistic model of the evidence gives the score.

The fit takes at most `most` labelled texts, those with the smallest hashes of their ids and texts; the lexicon, of their
terms, and its size follow from that bound. The counts of the language
model cover all rows; their number is bounded by the alphabet (28 symbols to the power of 4).

Cases: null text counts as empty, and an empty text gets the score of no evidence; with no labelled rows, or one
label only, the lexicon is empty and the score is the smoothed share of label 1 (0.5 without rows, capped by nothing
else); rows of one id are scored each; ties between paths go to the first found; an empty table gives an empty
result; extra columns are ignored, or kept where asked for; a kept column that is named like a result gets `_in` at
its end.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import MOST_LABELLED, labelled_sample

#: Symbols: 0 is a word end, 1 to 26 are letters, 27 is any other letter.
SYMBOLS, ORDER = 28, 4
#: Code points from here on are not folded to a to z.
FOLDED = 0x250

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c",
}
WILD = "*#"
GAPS = " .-_~|*'/\t"
#: In a lattice, any of the 26 letters.
ANY = SYMBOLS
LETTERS = np.arange(1, 27)
#: Spans of up to so many characters are remembered; paths are cut back to their common start after so many positions.
REMEMBERED, SETTLE = 192, 128
#: Up to so many states of a lattice with masked letters are followed one by one.
FEW = 100
#: From so many states on, the paths of a masked letter are held against each other in one table.
WIDE = 1000

# Kinds of characters: letters; signs that stand for letters; masks; signs that may stand inside a word; white space;
# digits.
LETTER, SIGN, MASK, INNER, SPACE, DIGIT = 1, 2, 4, 8, 16, 32

# Costs of the channel, in nats.
COST_LEET, COST_WILD, COST_JOIN, COST_GAP, COST_SHORTEN, COST_DOUBLE, COST_SINGLE, COST_LITERAL = 0.5, 3.0, 0.5, 0.5, 0.5, 0.5, 3.5, 4.0

#: Three or more single characters, set apart.
APART = re.compile(r"(?<!\w)[^\W_](?:[ ._\-*~|/]{1,3}[^\W_](?!\w)){2,}")
OTHER_WORD = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the symbol; the byte of the folded text (a to z, space, ~ for another letter); what it can be."""
    symbols = np.fromiter((27 if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for c in range(FOLDED):
        base = unicodedata.normalize("NFKD", chr(c).lower())[:1]
        if "a" <= base <= "z":
            symbols[c] = ord(base) - 96
    letters = np.frombuffer(b" abcdefghijklmnopqrstuvwxyz~", dtype=np.uint8)
    kinds = np.where(symbols > 0, LETTER, 0).astype(np.uint8)
    for c in LEET:
        kinds[ord(c)] |= SIGN
    for c in WILD:
        kinds[ord(c)] |= MASK
    for c in WILD + "._-~'":
        kinds[ord(c)] |= INNER
    for c in range(0x3001):
        kinds[c] |= SPACE * chr(c).isspace()
    for c in range(48, 58):
        kinds[c] |= DIGIT
    return symbols, letters[symbols], kinds


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def count_ngrams(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all n-grams of ORDER symbols over all rows, as an array of SYMBOLS ** ORDER."""
    size = SYMBOLS**ORDER

    def make():
        symbols, _, _ = _tables()
        total = np.zeros(size, dtype=np.int64)

        def work(rows):
            if rows is None:
                at = np.flatnonzero(total)
                return {"code": at, "n": total[at]}
            for t in rows["text"]:
                s = symbols[_points(t)]
                s = s[(s != 0) | np.concatenate([[False], s[:-1] != 0])] if len(s) else s  # one word end is enough
                s = np.concatenate([[0, 0, 0], s, [0] if not len(s) or s[-1] else []]).astype(np.int32)
                if len(s) > 4:
                    np.add(total, np.bincount(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:], minlength=size), out=total) if len(s) > 50_000 else np.add.at(total, ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:], 1)
            return None

        return work

    parts = common.map_rows(df.select(common.text_of(text).alias("text")), make, "code int, n long", finish=True)
    summed = parts.groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # no more rows than the alphabet allows
    out = np.zeros(size)
    out[summed["code"].to_numpy(dtype=int)] = summed["n"].to_numpy(dtype=float)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a symbol after three others; orders are interpolated by Witten and Bell's rule."""
    full = counts.reshape((SYMBOLS,) * ORDER)
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER - 1, -1, -1):
        c = full.sum(axis=tuple(range(k))) if k else full
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        n = c.sum(axis=-1, keepdims=True)
        lower = np.where(n > 0, (c + kinds * lower) / np.maximum(n + kinds, 1), lower)
    return -np.log(np.maximum(lower, 1e-12)).astype(np.float32).reshape(-1)


#: Fills up rows of added symbols.
NOTHING = 255


def _best(states: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The place of the least cost of each state, the first one of equals."""
    order = np.lexsort((costs, states))
    return order[np.concatenate([[True], np.diff(states[order]) != 0])] if len(order) else order


class Decoder:
    def __init__(self, costs: np.ndarray, bound: int = 50_000):
        self.costs, self.bound, self.known = costs.tolist() if len(costs) < 1 << 20 else costs, bound, {}
        self.table = np.asarray(costs, dtype=np.float64)
        # two paths at one position go on at costs that differ by no more, as contexts are equal after three symbols
        self.slack = 3 * float(self.table.max(initial=0)) + 1e-6
        # what a symbol costs at least; a word end may be free, and any letter costs as the cheapest one
        least = self.table.reshape(-1, SYMBOLS).min(axis=0).tolist()
        self.least = [0.0, *least[1:], min(least[1:27])]
        self.symbols, _, self.kinds = _tables()

    def lattice(self, span: str) -> list[list[tuple[tuple[int, ...], float]]]:
        """For each run of equal characters, or of masks, what it may stand for: symbols and a cost."""
        out, at = [], 0
        while at < len(span):
            c, end = span[at], at + 1
            while end < len(span) and (span[end] == c or (c in WILD and span[end] in WILD)):
                end += 1
            n, at = end - at, end
            symbol = int(self.symbols[ord(c)])
            if symbol:
                if n > 2:
                    out.append([((symbol,), COST_SHORTEN), ((symbol, symbol), COST_SHORTEN + COST_DOUBLE)])
                elif n == 2:
                    out.append([((symbol, symbol), 0.0), ((symbol,), COST_SINGLE)])
                else:
                    out.append([((symbol,), 0.0)])
                continue
            # an exclamation mark at the end and a bracket at the start are what they are elsewhere
            plain = (c == "!" and at == len(span)) or (c == "(" and at == n)
            options = [((0,), COST_LITERAL if c in LEET and not plain else COST_GAP)]
            for x in LEET.get(c, ""):
                k = ord(x) - 96
                options += [((k,), COST_LEET)] if n == 1 else [((k, k), COST_LEET), ((k,), COST_LEET + COST_SINGLE)] if n == 2 else [((k,), COST_LEET + COST_SHORTEN)]
            if c in GAPS:
                options.append(((), COST_JOIN))
            if c in WILD:
                options.append(((ANY,) * n, COST_WILD))
            out.append(options)
        return out

    def __call__(self, span: str) -> str:
        """The restored span: words of a to z, one space between them."""
        if (found := self.known.get(span)) is not None:
            return found
        lattice = [*self.lattice(span), [((0,), 0.0)]]
        out = self._masked_path(lattice) if any(c in span for c in WILD) else self._path(lattice)[0]
        text = "".join(" abcdefghijklmnopqrstuvwxyz~"[x] for x in out).strip()
        if len(span) <= REMEMBERED:
            if len(self.known) >= self.bound:
                self.known.clear()
            self.known[span] = text
        return text

    def _path(self, lattice: list[list[tuple[tuple[int, ...], float]]]) -> tuple[list[int], float]:
        """The symbols and the cost of the path of least cost, for lattices of few choices at each position."""
        costs = self.costs
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last three symbols
        for options in lattice:
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (cost, back) in paths.items():
                for emitted, extra in options:
                    s, total, link = state, cost + extra, back
                    for x in emitted:
                        if not x and not s % SYMBOLS:
                            continue  # one word end is enough
                        total += costs[s * SYMBOLS + x]
                        s = (s * SYMBOLS + x) % SYMBOLS**3
                        link = (x, link)
                    if s not in new or total < new[s][0]:
                        new[s] = (total, link)
            paths = new
        total, link = min(paths.values(), key=lambda p: p[0])
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        return out[::-1], total

    def _few_paths(self, lattice: list[list[tuple[tuple[int, ...], float]]], bound: float, ahead: list[float]) -> list[int] | None:
        """As _path, without what exceeds the bound; none if more than FEW states are open at a position."""
        costs, any_letter = self.costs, self.least[ANY]
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options, after in zip(lattice, ahead, strict=True):
            new: dict[int, tuple[float, tuple | None]] = {}
            for emitted, extra in options:
                part = {s: (cost + extra, link) for s, (cost, link) in paths.items()}
                for k, x in enumerate(emitted, 1):
                    further: dict[int, tuple[float, tuple | None]] = {}
                    most = bound - after - (len(emitted) - k) * any_letter * (x == ANY)
                    for s, (cost, link) in part.items():
                        if not x and not s % SYMBOLS:
                            if cost <= most and (s not in further or cost < further[s][0]):
                                further[s] = (cost, link)
                            continue
                        for y in range(1, 27) if x == ANY else (x,):
                            code = s * SYMBOLS + y
                            total, state = cost + costs[code], code % SYMBOLS**3
                            if total <= most and (state not in further or total < further[state][0]):
                                further[state] = (total, (y, link))
                    part = further
                    if len(part) > FEW:
                        return None
                for s, path in part.items():
                    if path[0] <= bound - after and (s not in new or path[0] < new[s][0]):
                        new[s] = path
            if len(new) > FEW:
                return None
            paths = new
        out, link = [], min(paths.values(), key=lambda p: p[0], default=(0.0, None))[1]
        while link:
            out.append(link[0])
            link = link[1]
        return out[::-1]

    def _advance(self, states: np.ndarray, costs: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths with one of the symbols added, the best for each new state: states, costs, places of the paths before."""
        if len(symbols) > 1 and len(states) > WIDE:
            full, place = np.full(SYMBOLS**3, np.inf), np.zeros(SYMBOLS**3, dtype=np.int64)
            full[states], place[states] = costs, np.arange(len(states))
            sums = full.reshape(SYMBOLS, -1, 1) + self.table.reshape(SYMBOLS, SYMBOLS**2, SYMBOLS)
            first = sums.argmin(axis=0)
            best = np.take_along_axis(sums, first[None], 0)[0].reshape(-1)
            before = (first * SYMBOLS**2 + np.arange(SYMBOLS**2)[:, None]).reshape(-1)
            new = np.flatnonzero((best < np.inf) & np.isin(np.arange(SYMBOLS**3) % SYMBOLS, symbols))
            return new, best[new], place[before[new]]
        codes = (states[:, None] * SYMBOLS + symbols).reshape(-1)
        totals = np.repeat(costs, len(symbols)) + self.table[codes]
        new = codes % SYMBOLS**3
        kept = _best(new, totals)
        return new[kept], totals[kept], kept // len(symbols)

    def _masked_path(self, lattice: list[list[tuple[tuple[int, ...], float]]]) -> list[int]:
        """As _path, for lattices with masked letters, where up to SYMBOLS ** 3 states are open at a position."""
        states, costs = np.zeros(1, dtype=np.int64), np.zeros(1)
        # a path is dropped once its cost and the least it has still to pay exceed the best path without masked letters
        plain, bound = self._path([[(e, x) for e, x in options if ANY not in e] for options in lattice])
        bound += 1e-6
        ahead = [0.0]
        for options in reversed(lattice):
            ahead.append(ahead[-1] + min(x + sum(self.least[k] for k in e) for e, x in options))
        ahead = ahead[-2::-1]  # by position: what is paid after it
        if (few := self._few_paths(lattice, bound, ahead)) is not None:
            return few or plain
        settled: list[int] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []  # for each position and path: the path before, what it added

        def settle(at: int, upto: int) -> None:
            """Put down what a path added in the first `upto` positions."""
            parts = []
            for before, added in reversed(links[:upto]):
                parts.append(added[at])
                at = before[at]
            settled.extend(int(x) for part in reversed(parts) for x in part if x != NOTHING)
            del links[:upto]

        for position, options in enumerate(lattice):
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for emitted, extra in options:
                s, v, origin, added = states, costs + extra, np.arange(len(states)), np.zeros((len(states), 0), dtype=np.uint8)
                if emitted == (0,) and (ended := s % SYMBOLS == 0).any():  # one word end is enough
                    found.append((s[ended], v[ended], origin[ended], added[ended]))
                    s, v, origin, added = s[~ended], v[~ended], origin[~ended], added[~ended]
                for k, x in enumerate(emitted, 1):
                    s, v, back = self._advance(s, v, LETTERS if x == ANY else np.array([x]))
                    origin, added = origin[back], np.concatenate([added[back], (s % SYMBOLS).astype(np.uint8)[:, None]], axis=1)
                    if x == ANY:
                        most = min(bound - ahead[position] - (len(emitted) - k) * self.least[ANY], min((f[1].min() for f in found), default=np.inf) + self.slack)
                        kept = v <= most
                        s, v, origin, added = s[kept], v[kept], origin[kept], added[kept]
                        if not len(s):
                            break
                if len(s):
                    found.append((s, v, origin, added))
            wide = max(f[3].shape[1] for f in found)
            s, v, origin = (np.concatenate([f[i] for f in found]) for i in range(3))
            added = np.concatenate([np.pad(f[3], ((0, 0), (0, wide - f[3].shape[1])), constant_values=NOTHING) for f in found])
            kept = _best(s, v)
            kept = kept[v[kept] <= min(v.min() + self.slack, bound - ahead[position])]
            if not len(kept):
                return plain  # by rounding alone
            states, costs = s[kept], v[kept]
            links.append((origin[kept].astype(np.int32), added[kept]))
            if len(links) % SETTLE == 0:
                at = np.arange(len(states))
                for k in range(len(links) - 1, -1, -1):
                    at = np.unique(links[k][0][at])
                    if len(at) == 1:  # all paths share what comes before
                        settle(int(at[0]), k)
                        break
        settle(int(costs.argmin()), len(links))
        return settled

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where disguise may be, in order and apart from each other."""
        points = _points(text)
        kind = self.kinds[points]
        padded = np.concatenate([[SPACE], kind, [SPACE]])
        before, after = padded[:-2], padded[2:]
        letter = kind & LETTER
        trace = (kind & (SIGN | INNER)) != 0
        if len(points) > 2:
            same = points[1:] == points[:-1]
            trace[1:-1] |= same[1:] & same[:-1] & (letter[1:-1] != 0)
        # of these, what lies in a token with a letter, and between the first and last of its characters that can be one
        spaces, letters, cores = (np.flatnonzero(kind & k) for k in (SPACE, LETTER, LETTER | SIGN | MASK))
        traces = np.flatnonzero(trace)
        ends = np.concatenate([[-1], spaces, [len(points)]])
        token = np.searchsorted(ends, traces)
        within = lambda places, low, high: np.searchsorted(places, low) < np.searchsorted(places, high)
        start, end = ends[token - 1] + 1, ends[token]
        traces = traces[within(letters, start, end) & within(cores, start, traces + 1) & within(cores, traces, end)]
        found, done = [], 0
        for at in traces.tolist():
            if at < done:
                continue
            a, b = at, at + 1
            while a and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            found.append((a, b))
            done = b
        word = LETTER | DIGIT
        single = np.flatnonzero(((kind & word) != 0) & ((before & word) == 0) & ((after & word) == 0))
        if len(single) > 2 and (single[2:] - single[:-2] <= 8).any():
            found += [m.span() for m in APART.finditer(text) if any(c.isalpha() for c in m[0])]
        found.sort()
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def restore(self, text: str) -> str:
        text = text.lower()
        out, at = [], 0
        for a, b in self.spans(text):
            # signs at the ends that can be no letter stay as they are
            cores = np.flatnonzero(self.kinds[_points(text[a:b])] & (LETTER | SIGN | MASK))
            a, b = a + int(cores[0]), a + int(cores[-1]) + 1
            out += [text[at:a], self(text[a:b])]
            at = b
        return "".join([*out, text[at:]]) if out else text


def words_of(text: str) -> set[str]:
    """The different words of a lower-case text, folded to a to z; words with other letters as they are."""
    _, letters, _ = _tables()
    folded = letters[_points(text)].tobytes().decode("ascii")
    words = set(folded.split())
    if "~" in folded:
        words = {w for w in words if "~" not in w} | {w for w in OTHER_WORD.findall(text) if not w.isascii()}
    return words


#: Beside the whole word, so many of its first letters are terms too, marked by a star.
STEMS = (4, 5, 6)


def terms_of(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}


class ToxicityModel:
    """weights: log odds of terms; coefficients: of the intercept and the evidence."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], coefficients: list[float]):
        self.costs, self.weights, self.coefficients = costs, weights, coefficients

    def evidence(self, words: set[str]) -> list[float]:
        found = sorted((self.weights[t] for t in terms_of(words) & self.weights.keys()), reverse=True)
        return [sum(found[:1]), math.log1p(sum(found)), math.log1p(len(found)), math.log1p(len(words))]


def restored_terms(df: DataFrame, costs: np.ndarray, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep columns and the array of different restored words."""
    shared = df.sparkSession.sparkContext.broadcast(costs)

    def make():
        decoder = Decoder(shared.value)

        return lambda texts: {"words": [sorted(words_of(decoder.restore(t))) for t in texts]}

    return common.map_texts(df, text, keep, make, "words array<string>")


#: A term of the lexicon is in so many labelled texts at least, and its signed root likelihood ratio is this at least.
LEAST_TEXTS, LEAST_RATIO = 3, 4.0


def fit_toxicity(documents: DataFrame, labels: DataFrame, counted: DataFrame | None = None, label: str = "toxic", text: str = "text", most: int = MOST_LABELLED) -> ToxicityModel:
    """Language model over `counted` (all documents), lexicon and logistic model over the labelled rows."""
    costs = language_model(count_ngrams(counted if counted is not None else documents, text))
    sample = labelled_sample(documents.select("doc_id", F.col(text).alias("text")), labels, label, most)
    rows = restored_terms(sample, costs, ("doc_id", "__label"))
    rows = common.checkpointed(rows.select(F.col("__label").cast("double").alias("y"), "words", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("second")))
    sizes = {r.second: (r.n, r.ones or 0.0) for r in rows.groupBy("second").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()}
    total, ones = sum(n for n, _ in sizes.values()), sum(o for _, o in sizes.values())
    prior = (ones + 0.5) / (total + 1)
    flat = ToxicityModel(costs, {}, [math.log(prior / (1 - prior)), 0.0, 0.0, 0.0, 0.0])
    first_n, first_ones = sizes.get(False, (0, 0.0))
    if not first_ones or first_ones == first_n:
        return flat
    stem = lambda n: F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(w.substr(F.lit(1), F.lit(n)), F.lit("*")))
    stems = [stem(n) for n in STEMS]
    lexicon = lambda part, n, one: (
        part.select("y", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
        .groupBy("term")
        .agg(F.sum("y").alias("a"), F.count("*").alias("df"))
        .where((F.col("df") >= LEAST_TEXTS) & (F.col("a") / F.col("df") > one / n))
        .withColumn("ratio", F.sqrt(2 * (_xlogx(F.col("a"), F.col("df") * one / n) + _xlogx(F.col("df") - F.col("a"), F.col("df") * (1 - one / n)))))
        .where(F.col("ratio") >= LEAST_RATIO)
        .withColumn("weight", F.log((F.col("a") + 0.5) / (F.lit(float(one)) + 1)) - F.log((F.col("df") - F.col("a") + 0.5) / (F.lit(float(n - one)) + 1)))
        .select("term", "weight")
        .collect()
    )
    model = ToxicityModel(costs, {r.term: r.weight for r in lexicon(rows.where(~F.col("second")), first_n, first_ones)}, [0.0] * 5)
    second = rows.where("second").select("y", "words")

    def make():
        return lambda part: {"y": part["y"], "evidence": [model.evidence(set(w)) for w in part["words"]]}

    seen = common.map_rows(second, make, "y double, evidence array<double>").collect()  # no more than the sample
    y = np.array([r.y for r in seen])
    if not len(y) or y.min() == y.max():
        return flat
    x = np.array([r.evidence for r in seen])
    coefficients = logistic(x, y)
    full = {r.term: r.weight for r in lexicon(rows, total, ones)}
    return ToxicityModel(costs, full, coefficients)


def _xlogx(a, expected):
    return F.when(a > 0, a * F.log(a / expected)).otherwise(F.lit(0.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Intercept and coefficients by Newton's steps, with a ridge on scaled columns."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate([np.ones((len(y), 1)), (x - mean) / scale], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return [float(w[0] - mean @ slopes), *map(float, slopes)]


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3, with_text: bool = False) -> DataFrame:
    """keep columns, score, predicted and, if asked for, the restored text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        decoder, (b, *w) = Decoder(model.costs), model.coefficients

        def work(texts):
            restored = [decoder.restore(t) for t in texts]
            margins = [b + sum(c * e for c, e in zip(w, model.evidence(words_of(t)), strict=True)) for t in restored]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, m)))) for m in margins]
            out = {"score": scores, "predicted": [int(s >= threshold) for s in scores]}
            return out | ({"restored": restored} if with_text else {})

        return work

    return common.map_texts(df, text, keep, make, "score double, predicted int" + ", restored string" * with_text)


def without_toxic(df: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that the model, fitted to df and the labels, scores below the threshold."""
    model = fit_toxicity(df, labels, text=text)
    own = common.numbered(df)
    scored = score_toxicity(own, model, common.place(df, text), tuple(own.columns), threshold)
    return scored.where("predicted = 0").select(*own.columns).toDF(*df.columns)


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = common.crc_mod("doc_id", 4) == 2
    model = fit_toxicity(documents, labels.where(~held_out), counted=documents)
    return score_toxicity(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
