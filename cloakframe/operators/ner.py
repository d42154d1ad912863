"""Names and addresses by a model: windows, selection of spans, and the Arrow-batched call.

No model comes with the library. `model_spans` takes a function that loads one in each Python worker and gives, for the
words of a window, scored word ranges; nothing is claimed for names without it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Window sizes, the longest word that can be a name, the word shapes and the model's labels.
WINDOW, OVERLAP, LONG_WORD, WIDEST, FLOOR = 320, 64, 40, 12, 0.30
WORD = re.compile(r"[A-Z]?[a-z]+(?=[A-Z])|\w+(?:[-_]\w+)*|\S")
LABELS = {"name": "PERSON", "location address": "ADDRESS", "location street": "ADDRESS"}

#: (words, text) of a window -> (first word, last word, entity type, score)
Predict = Callable[[list[str]], list[tuple[int, int, str, float]]]


def windows(lengths: list[int], budget: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of words of at most `budget` tokens. A word too long to be a name is in none and ends a stretch; within a stretch
    the next range begins inside the last, by at most `overlap` tokens. Ends and beginnings are looked up in running sums."""
    sums = [0, *accumulate(lengths)]
    edges = [-1, *(i for i, n in enumerate(lengths) if n > LONG_WORD), len(lengths)]
    out: list[tuple[int, int]] = []
    for before, stop in pairwise(edges):
        at = before + 1
        while at < stop:
            end = min(stop, max(at + 1, bisect_right(sums, sums[at] + budget) - 1))
            out.append((at, end))
            at = stop if end == stop else max(at + 1, bisect_left(sums, sums[end] - overlap))
    return out


def best_apart(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The best spans, none of which overlaps a better one that was taken. Taken ones are disjoint, so a look at the two
    neighbours of a place tells."""
    taken: list[tuple[int, int, float]] = []
    for s in sorted(spans, key=lambda s: (-s[2], s[0], s[1])):
        at = bisect_left(taken, s)
        if (at == 0 or taken[at - 1][1] <= s[0]) and (at == len(taken) or s[1] <= taken[at][0]):
            taken.insert(at, s)
    return taken


def spans_of(text: str, predict: Predict, tokens: Callable[[list[str]], list[int]], budget: int = WINDOW) -> list[tuple[int, int, str, float]]:
    """(start, end, entity type, score) of a text."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    found: dict[str, list[tuple[int, int, float]]] = {}
    for a, b in windows(tokens([text[s:e] for s, e in words]), budget) if words else []:
        for first, last, kind, score in predict([text[s:e] for s, e in words[a:b]]):
            if score > FLOOR and last - first < WIDEST:
                found.setdefault(kind, []).append((words[a + first][0], words[a + last][1], score))
    return [(s, e, kind, score) for kind in sorted(found) for s, e, score in best_apart(found[kind])]


def model_spans(load: Callable[[], tuple[Predict, Callable[[list[str]], list[int]]]], budget: int = WINDOW) -> Callable[[Column], Column]:
    """A column function text -> spans for detect(model=...); `load` runs once in each worker's call."""

    @F.pandas_udf("array<struct<start:int,end:int,entity_type:string,score:double,detector:string,validated:boolean>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict, tokens = load()
        for texts in parts:
            yield pd.Series([[{"start": s, "end": e, "entity_type": k, "score": p, "detector": "model", "validated": False} for s, e, k, p in spans_of(t or "", predict, tokens, budget)] for t in texts])

    return run


def verified_model(path: str | Path, sha256: str) -> bytes:
    """The content of a model file whose SHA-256 is as expected; else it raises, and nothing of the file is used."""
    data = Path(path).read_bytes()
    if hashlib.sha256(data).hexdigest() != sha256.lower():
        raise ValueError("a model file doesn't have the expected SHA-256")
    return data
