"""Positions at which a text can be cut without changing any token.

A single ASCII space or newline between two characters that are not white space separates
pre-tokens in every tokenizer of the public set: no pattern joins the characters on its two
sides, no normalisation composes across it, and no special token's string holds it.
The white space itself always goes to the right-hand part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_STABLE = re.compile(r"(?<=\S)[ \n](?=\S)")


def stable_positions(text: str, start: int = 0, end: int | None = None) -> Iterator[int]:
    """All stable positions p, start <= p < end, in rising order."""
    for m in _STABLE.finditer(text, max(0, start), len(text) if end is None else end):
        yield m.start()


def first_stable(text: str, n: int) -> list[int]:
    """The first n stable positions, or as many as there are."""
    out = []
    for p in stable_positions(text):
        out.append(p)
        if len(out) == n:
            break
    return out


def last_stable(text: str, n: int) -> list[int]:
    """The last n stable positions in rising order; looks back in growing steps."""
    reach = 128
    while True:
        lo = max(0, len(text) - reach)
        found = [p for p in stable_positions(text, lo)]
        if len(found) >= n or lo == 0:
            return found[-n:]
        reach *= 4
