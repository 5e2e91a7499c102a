"""Valences of the words of one text, and what they add up to, by the rules of the public valence-aware scorer (its rules and word lists are under the MIT licence).

A small helper for Arrow batches: `ruled` follows negations, boosters, capitals, idioms, contrasts and signs of emphasis. It
takes a text and a dictionary of lower-case words and valences, and gives pos, neu, neg (shares) and compound, not rounded.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Mapping

# Fixed values of the public scorer: words that raise or lower the next one, negations, idioms, and scales.
RAISE, LOWER = 0.293, -0.293
BOOSTERS = dict.fromkeys(
    """absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin
    frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly hugely incredible incredibly intensely major majorly more most particularly purely quite really
    remarkably so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very""".split(), RAISE,
) | dict.fromkeys(["almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally", "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sort of", "sorta", "sortof", "sort-of"], LOWER)
NEGATIONS = set(
    """aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't
    neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite""".split()
)
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9}
NEGATED, CAPITALS, NEVER, SMOOTH = -0.74, 0.733, 1.25, 15.0
FADING = (1.0, 0.95, 0.9)
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
#: Of each phrase and word that a rule asks for, one word: where none stands near, a word has the valence of the lexicon.
TELLING = {max(phrase.split(), key=len) for phrase in (*BOOSTERS, *IDIOMS)} | NEGATIONS | {"no", "least"}
#: Pieces of text whose words are kept.
MOST_PIECES = 200_000


def shares(valences: list[float], emphasis: float = 0.0, others: int = 0) -> dict[str, float]:
    """Shares and compound of the valences of words, and of so many others without one."""
    total = sum(valences)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0.0
    pos, neg = sum(v + 1 for v in valences if v > 0), sum(1 - v for v in valences if v < 0)
    pos, neg = (pos + emphasis, neg) if pos > neg else (pos, neg + emphasis) if neg > pos else (pos, neg)
    neutral = others + sum(not v for v in valences)
    whole = pos + neg + neutral
    compound = max(-1.0, min(1.0, total / (total * total + SMOOTH) ** 0.5))
    return {"pos": pos / whole, "neu": neutral / whole, "neg": neg / whole, "compound": compound} if whole else dict.fromkeys(("pos", "neu", "neg", "compound"), 0.0)


def bare(piece: str) -> str:
    """A piece between white space without the signs around it, unless little is left."""
    word = piece.strip(string.punctuation)
    return word if len(word) > 2 else piece


def tokens(text: str) -> list[str]:
    return [bare(piece) for piece in text.split()]


class _Lower(dict):
    """Pieces and their words in lower case."""

    def __missing__(self, piece: str) -> str:
        if len(self) >= MOST_PIECES:
            self.clear()
        self[piece] = word = bare(piece).lower()
        return word


_LOWER_OF = _Lower()


class _Text:
    def __init__(self, text: str, lexicon: Mapping[str, float]):
        self.text, self.lexicon, self.pieces = text, lexicon, text.split()
        self.lower = list(map(_LOWER_OF.__getitem__, self.pieces))

    @functools.cached_property
    def mixed(self) -> bool:
        loud = sum(bare(p).isupper() for p in self.pieces)
        return 0 < loud < len(self.pieces)

    def loud(self, i: int) -> bool:
        return bare(self.pieces[i]).isupper() and self.mixed

    def boost(self, i: int, valence: float) -> float:
        """What the word at i adds to a valence after it."""
        scale = BOOSTERS.get(self.lower[i], 0.0)
        if not scale:
            return 0.0
        scale = -scale if valence < 0 else scale
        return scale + (CAPITALS if valence > 0 else -CAPITALS) * self.loud(i)

    def negated(self, i: int, back: int, valence: float) -> float:
        word, between = self.lower[i - back], self.lower[i - back + 1 : i]
        if back > 1 and word == "never" and {"so", "this"} & set(between):
            return valence * NEVER
        if back > 1 and word == "without" and "doubt" in between:
            return valence
        return valence * NEGATED if word in NEGATIONS or "n't" in word else valence

    def idiom(self, i: int, valence: float) -> float:
        low = self.lower
        span = lambda a, b: " ".join(low[i + a : i + b + 1])
        for a, b in ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)):
            if (phrase := span(a, b)) in IDIOMS:
                valence = IDIOMS[phrase]
                break
        for b in (1, 2):
            if i + b < len(low) and (phrase := span(0, b)) in IDIOMS:
                valence = IDIOMS[phrase]
        return valence + sum(BOOSTERS.get(span(a, b), 0.0) for a, b in ((-3, -1), (-3, -2), (-2, -1)))

    def valence(self, i: int) -> float:
        low, lexicon = self.lower, self.lexicon
        if low[i] in BOOSTERS or low[i : i + 2] == ["kind", "of"] or low[i] not in lexicon:
            return 0.0
        v = lexicon[low[i]]
        if low[i] == "no" and i + 1 < len(low) and low[i + 1] in lexicon:
            v = 0.0
        if "no" in low[max(0, i - 2) : i] or (i > 2 and low[i - 3] == "no" and low[i - 1] in ("or", "nor")):
            v = lexicon[low[i]] * NEGATED
        if self.loud(i):
            v += CAPITALS if v > 0 else -CAPITALS
        for back, fade in enumerate(FADING, 1):
            if i >= back and low[i - back] not in lexicon:
                v = self.negated(i, back, v + fade * self.boost(i - back, v))
                if back == 3:
                    v = self.idiom(i, v)
        if i and low[i - 1] == "least" and "least" not in lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= NEGATED
        return v

    def found(self) -> tuple[list[int], list[float]]:
        """The places of the words of the lexicon, and their valences; all other words have none."""
        low, pieces, lexicon = self.lower, self.pieces, self.lexicon
        places = [i for i, w in enumerate(low) if w in lexicon]
        # a word with n't is telling too
        quiet = TELLING.isdisjoint(low) and "n't" not in self.text.lower()
        plain = lambda near: TELLING.isdisjoint(near) and not any("n't" in w for w in near)
        return places, [float(lexicon[low[i]]) if not pieces[i].isupper() and (quiet or plain(low[max(0, i - 3) : i + 3])) else self.valence(i) for i in places]

    def valences(self) -> list[float]:
        places, out = self.found()
        if "but" not in self.lower:
            return out
        turn = self.lower.index("but")
        return [v * (BEFORE_BUT if i < turn else AFTER_BUT if i > turn else 1.0) for i, v in zip(places, out, strict=True)]

    def emphasis(self) -> float:
        asked = self.text.count("?")
        return min(self.text.count("!"), MOST_EXCLAMATIONS) * EXCLAMATION + (0.0 if asked < 2 else asked * QUESTION if asked <= 3 else MANY_QUESTIONS)


def ruled(text: str, lexicon: Mapping[str, float]) -> dict[str, float]:
    whole = _Text(text, lexicon)
    valences = whole.valences()
    return shares(valences, whole.emphasis(), len(whole.lower) - len(valences))
