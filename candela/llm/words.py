"""Words of byte strings as numpy arrays: where they lie, and hashes of them and of runs of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .simhash import mix

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the polynomials over bytes and over words, one for each of two independent hashes.
_OVER_BYTES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_OVER_WORDS = (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
_OF_BYTE = tuple(mix(np.arange(1, 257, dtype=np.uint64) * m) for m in _OVER_BYTES)
#: Bytes of which words are found at a time.
PIECE = 1 << 20


def inside(gaps: bytes) -> np.ndarray:
    """Which byte values belong to words: all but the gaps."""
    out = np.ones(256, dtype=bool)
    out[list(gaps)] = False
    return out


class Powers:
    """Powers of an odd number modulo 2^64, as many as the longest word needs."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            self.known = np.concatenate([self.known, self.known * (self.known[-1:] * self.base)])
        return self.known


_POWERS = tuple(Powers(m) for m in _OVER_BYTES)


def pieces(data: bytes, kept: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of parts of about `most` bytes, none of which ends within a word."""
    whole, at = np.frombuffer(data, dtype=np.uint8), 0
    while at < len(whole):
        end = min(at + most, len(whole))
        step = 4096
        while end < len(whole):  # a word that is longer than a part keeps its part open
            gap = np.flatnonzero(~kept[whole[end : end + step]])
            if len(gap):
                end += int(gap[0])
                break
            end, step = end + step, step * 2
        end = min(end, len(whole))
        yield at, whole[at:end]
        at = end


def words_of(data: bytes, kept: np.ndarray, hashes: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and ends of the maximal runs of kept bytes, and so many independent 64-bit hashes of each, never 0."""
    starts, ends, found = [], [], [[] for _ in range(hashes)]
    for at, part in pieces(data, kept):
        held = kept[part]
        edge = np.flatnonzero(np.diff(held.view(np.int8), prepend=0, append=0))
        s, e = edge[0::2], edge[1::2]
        if not len(s):
            continue
        starts.append(s + at)
        ends.append(e + at)
        sizes, flat = e - s, part[held]
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(flat)) - np.repeat(first, sizes)
        for k in range(hashes):
            value = np.add.reduceat(_OF_BYTE[k][flat] * _POWERS[k].upto(int(sizes.max()))[place], first)
            value = mix(value + sizes.astype(np.uint64) * _GOLD)
            found[k].append(np.where(value == 0, _GOLD, value))
    if not starts:
        none = np.empty(0, dtype=np.int64)
        return none, none, [np.empty(0, dtype=np.uint64) for _ in range(hashes)]
    return np.concatenate(starts), np.concatenate(ends), [np.concatenate(f) for f in found]


def runs(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `width` neighbouring words."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * _OVER_WORDS[which] + hashes[k : k + n]
    return mix(out)


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: max(0, len(out) - step)], out[step:])
        have += step
    return out


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ascending array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)
