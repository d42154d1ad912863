"""Hashes of all words of a text at once.

A word's hash is a polynomial over a table of random numbers for its bytes, modulo 2**64, from one running sum over the text:
the sum up to a word's end less that up to its start, times the inverse power of its place. It is mixed at the end."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
#: White space beyond ASCII's, as str.split() sees it.
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: ASCII's white space, as bytes.split() sees it, and with the separators that str.split() takes for it too.
SPACES, MORE_SPACES = np.zeros(256, bool), np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
MORE_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def plain_spaces(text: str) -> str:
    """The text with a space for every white space that isn't ASCII's."""
    return text if text.isascii() else _ODD_SPACE.sub(" ", text)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(20_260_105)
    base = int(rng.integers(1, 1 << 62)) * 2 + 1
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, base, inverse = _tables()
    both = []
    for x in (base, inverse):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


def word_hashes(data: bytes, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word between white space."""
    raw, table = np.frombuffer(data, np.uint8), _tables()[0]
    hashes, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        if end < len(raw):  # never inside a word
            cuts = np.flatnonzero(spaces[raw[at:end]])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:
                while end < len(raw) and not spaces[raw[end]]:
                    end += 1
        b = raw[at:end]
        edge = np.diff(np.concatenate([[True], spaces[b], [True]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = (p[: len(b) + 1] for p in _powers(max(BLOCK, len(b)) + 1))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * power[:-1], out=total[1:])
        hashes.append(mixed((total[ends] - total[starts]) * inverse[starts]))
        places.append(at + starts)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def run_hashes(words: np.ndarray, many: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of so many words each: the hash of each run of `size` words, of all words if there are fewer; how many of each text."""
    ends = np.cumsum(many)
    runs = np.where(many > 0, np.maximum(1, many - size + 1), 0)
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(whole)])
    inside = np.arange(len(whole)) + size <= np.repeat(ends, many)[: len(whole)]
    found = np.zeros(int(runs.sum()), np.uint64)
    long_ = np.repeat(many >= size, runs)
    found[long_] = whole[inside]
    at = np.cumsum(runs) - runs
    for i in np.flatnonzero((many > 0) & (many < size)).tolist():
        h = np.zeros(1, np.uint64)
        for w in words[ends[i] - many[i] : ends[i]]:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)
        found[at[i]] = h[0]
    return found, runs
