"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fit, from rows of the training folds only:
1. A bounded sample of labelled texts (the smallest hashes of their ids, at most `sample` of either
   label) is taken; exact and near copies among them count once.
2. Terms are words and their prefixes of four to six letters. Those kept are at least four times as frequent in toxic texts,
   by more than chance (log-likelihood ratio); one term is kept of a family of extensions. All other words
   of a text are pooled in one background term, so that length does not matter but their presence does.
3. Document frequencies of the kept terms are counted over all texts of the table.
4. Every sampled text becomes a unit TF-IDF vector in an inverted index: examples lie in blocks of 64,
   and each term has its largest weight for every block it occurs in.

Scoring: blocks are taken in the order of their upper bounds until the bound falls below the k-th best
cosine, so the k nearest examples are exact. Their labels vote with weights that fall with distance; a
monotone map, fitted on votes with each example left out of its own, calibrates the vote. The nearest
examples and the terms found are the evidence. Vectors seen before are looked up.

Defined results: null and empty texts hold the background term only and are scored like any other text
without kept terms; without a toxic and a clean labelled text every score is 0; of several labels of one
id the larger counts, of several texts of one the least by hash; labels that are null or whose document is missing are left out; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies, words
from .common import ship, text_of

FOLDS, HELD_OUT = 5, 0
#: At most so many labelled texts of either label are fitted on.
SAMPLE = 4_096
NEIGHBOURS, BLOCK = 16, 64
#: Log-likelihood ratio of a term's counts from which it is kept: one in 10,000 by chance, at every size.
SIGNIFICANT = 15.14
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"\w+")


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


# --- index ----------------------------------------------------------------------------------------


class BlockMaxIndex:
    """Unit vectors of examples; top(v) gives the k nearest by exact cosine; which of equally near ones is fixed by the index."""

    def __init__(self, vectors: list[dict[int, float]], terms: int, block: int = BLOCK):
        n = len(vectors)
        # Similar examples side by side make tight blocks.
        self.order = np.array(sorted(range(n), key=lambda i: (sorted(vectors[i].items(), key=lambda x: -x[1])[:3], i)), np.int64)
        self.block, blocks = block, max(1, -(-n // block))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for at, i in enumerate(self.order.tolist()):
            for t, w in vectors[i].items():
                postings[t].append((at, w))
        self.at = [np.array([a for a, _ in p], np.int64) for p in postings]
        self.weight = [np.array([w for _, w in p]) for p in postings]
        self.cuts = [np.searchsorted(a, np.arange(blocks + 1) * block) for a in self.at]
        self.most = np.zeros((terms, blocks), np.float64)
        for t in range(terms):
            if len(self.at[t]):
                np.maximum.at(self.most[t], self.at[t] // block, self.weight[t])
        self.n, self.blocks = n, blocks
        self.opened = 0

    def top(self, v: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, example), best first."""
        bound = np.zeros(self.blocks)
        for t, w in v.items():
            bound += w * self.most[t]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if len(best) == k and bound[b] <= best[-1][0]:
                break
            self.opened += 1
            lo = b * self.block
            scores = np.zeros(min(self.block, self.n - lo))
            for t, w in v.items():
                i, j = self.cuts[t][b], self.cuts[t][b + 1]
                if i < j:
                    scores[self.at[t][i:j] - lo] += w * self.weight[t][i:j]
            found = [(round(float(s), 9), int(e)) for s, e in zip(scores, self.order[lo : lo + self.block], strict=True)]
            best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
        return best


# --- model ----------------------------------------------------------------------------------------


class Model:
    """Kept terms, their weights, the examples' index and the calibration."""

    def __init__(self, terms: list[str], idf: np.ndarray, background: float, examples: list[tuple[int, int, dict[int, int]]], rates: tuple[float, float], k: int = NEIGHBOURS):
        self.ids = {t: i for i, t in enumerate(terms)}
        self.terms, self.idf, self.background, self.k = terms, idf, background, k
        self.labels = np.array([y for _, y, _ in examples], np.float64)
        self.keys = [key for key, _, _ in examples]
        self.each = np.where(self.labels == 1, rates[1], rates[0])
        self.index = BlockMaxIndex([self.vector(c) for _, _, c in examples], len(terms) + 1)
        self.map_x, self.map_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.seen: OrderedDict[tuple, tuple[float, list[int]]] = OrderedDict()
        self.words: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": OrderedDict(), "words": {}}

    def counts(self, text: str) -> dict[int, int]:
        """Occurrences of kept terms."""
        found, seen, out = _WORD.findall(text.lower()), self.words, {}
        if len(seen) > 300_000:
            seen.clear()
        for w in set(found):
            hit = seen.get(w)
            if hit is None:
                hit = seen[w] = tuple(self.ids[t] for t in terms_of(w) if t in self.ids)
            if hit:
                n = found.count(w)
                for t in hit:
                    out[t] = out.get(t, 0) + n
        return out

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * float(self.idf[t]) for t, n in counts.items()}
        v[len(self.terms)] = self.background
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 in the votes of neighbours; a vote falls with the square of the distance."""
        if not near:
            return 0.0
        w = np.array([1 / (2 - 2 * s + 0.05) for s, _ in near])
        return float(w @ self.labels[[e for _, e in near]] / w.sum())

    def calibrate(self, examples: list[tuple[int, int, dict[int, int]]]) -> float:
        """Fits the monotone map on left-out votes; gives their weighted error."""
        near: dict[tuple, list[tuple[float, int]]] = {}  # one more than needed, so that an example can be left out of its own
        votes = np.zeros(len(examples))
        for i, (_, _, c) in enumerate(examples):
            key = tuple(sorted(c.items()))
            if key not in near:
                near[key] = self.index.top(self.vector(c), self.k + 1)
            votes[i] = self.vote([x for x in near[key] if x[1] != i][: self.k])
        self.map_x, self.map_y = isotonic(votes, self.labels, self.each)
        p = np.interp(votes, self.map_x, self.map_y)
        return float((self.each * (p - self.labels) ** 2).sum() / self.each.sum())

    def score(self, text: str) -> tuple[float, list[int], list[str]]:
        """Score, ids of the nearest examples, kept terms of the text."""
        counts = self.counts(text)
        key = tuple(sorted(counts.items()))
        hit = self.seen.get(key)
        if hit is None:
            near = self.index.top(self.vector(counts), self.k)
            raw = self.vote(near)
            p = float(np.interp(raw, self.map_x, self.map_y))
            hit = self.seen[key] = (min(1.0, max(0.0, 0.98 * p + 0.02 * raw if p < 0.5 else 0.5 + (p - 0.5) * 0.98 + 0.01 * raw)), [self.keys[e] for _, e in near[:3]])
            if len(self.seen) > 50_000:
                self.seen.popitem(last=False)
        return hit[0], hit[1], [self.terms[t] for t in sorted(counts)]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing map of x to y, by pooling adjacent violators; a little prior weight keeps it off 0 and 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, lowest x, highest x
    for i in order.tolist():
        if pools and pools[-1][3] == x[i]:
            pools[-1][0] += w[i]
            pools[-1][1] += w[i] * y[i]
        else:
            pools.append([w[i], w[i] * y[i], x[i], x[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            b = pools.pop()
            a = pools[-1]
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    kx, ky = [], []
    for weight, total, lo, hi in pools:
        p = (total + 0.01) / (weight + 0.02)
        kx += [lo, hi] if hi > lo else [lo]
        ky += [p, p] if hi > lo else [p]
    ky = np.maximum.accumulate(np.array(ky)).tolist()
    return np.array(kx), np.array(ky)


def without_copies(rows: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The rows (id, label, text) without copies: a row goes if a kept one of the same label has 0.8 of its runs of four words in
    common (Jaccard). Candidates share one of eight least hashes."""
    known: dict[tuple[int, int, int], list[np.ndarray]] = {}
    out, factors = [], words.mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    for lo in range(0, len(rows), 256):
        values, sizes = near_copies.shingles([text for _, _, text in rows[lo : lo + 256]], 4)
        for row, runs in zip(rows[lo : lo + 256], np.split(values, np.cumsum(sizes)[:-1]), strict=True):
            marks = [(row[1], k, int((runs * f).min()) if len(runs) else 0) for k, f in enumerate(factors)]
            near = {id(other): other for m in marks for other in known.get(m, ())}
            if any((both := len(np.intersect1d(runs, other, assume_unique=True))) >= 0.8 * (len(runs) + len(other) - both) for other in near.values()):
                continue
            runs = runs.copy()
            for m in marks:
                known.setdefault(m, []).append(runs)
            out.append(row)
    return out


def choose_terms(rows: list[tuple[int, int, str]]) -> list[str]:
    """Terms that are at least four times as frequent in label 1 and more so than chance has it (SIGNIFICANT), one of each family."""
    n, df = Counter(y for _, y, _ in rows), (Counter(), Counter())
    if not n[0] or not n[1]:
        return []
    for _, y, text in rows:
        if y:
            df[1].update({t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)})
    # Without any use in label 0 a term needs so many texts to be significant; only such terms are counted there.
    fewest = SIGNIFICANT / (2 * math.log((n[0] + n[1]) / n[1]))
    df = (df[0], {t: a for t, a in df[1].items() if a >= fewest})
    known: dict[str, tuple[str, ...]] = {}
    for _, y, text in rows:
        if not y:
            found: set[str] = set()
            for w in set(_WORD.findall(text.lower())):
                hit = known.get(w)
                if hit is None:
                    hit = known[w] = tuple(t for t in terms_of(w) if t in df[1])
                found.update(hit)
            df[0].update(found)
    scored = []
    for t, a in df[1].items():
        b = df[0][t]
        if a / n[1] < 4 * (b + 0.5) / (n[0] + 1):
            continue
        g = 0.0
        for seen, of in ((a, n[1]), (b, n[0])):
            expected = (a + b) * of / (n[0] + n[1])
            g += 2 * seen * math.log(seen / expected) if seen else 0.0
        if g < SIGNIFICANT:
            continue
        scored.append((-g, -len(t.rstrip("*")), t.endswith("*"), t))
    kept: list[str] = []
    stems: set[str] = set()
    for _, _, _, t in sorted(scored):
        s = t.rstrip("*")
        family = {s[:k] for k in range(min(PREFIXES), len(s) + 1)} or {s}
        if stems & family or any(k.startswith(s) for k in stems):
            continue
        stems.add(s)
        kept.append(t)
    return kept


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """A model from labelled rows of the training folds, or None where these lack a label."""
    spark = ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != HELD_OUT)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample ids: a bounded broadcast.
    own = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    one = own.groupBy("id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))  # of a repeated id one text
    rows = [(r["id"], r["y"], r["text"]) for r in one.collect()]
    rows = without_copies(sorted(rows, key=lambda r: (str(r[0]), r[2])))
    n = Counter(y for _, y, _ in rows)
    if not n[0] or not n[1]:
        return None
    rates = (sizes[0] / n[0], sizes[1] / n[1])
    terms = choose_terms(rows)
    df, total = _document_frequencies(docs, terms, text_col)
    idf = np.log((total + 1) / (df + 1)) + 1
    probe = Model(terms, idf, 1.0, [], rates)
    examples = [(key, y, probe.counts(text)) for key, y, text in rows]
    model = Model(terms, idf, float(idf.mean()) if len(idf) else 1.0, examples, rates)
    model.calibrate(examples)
    return model


def _document_frequencies(docs: DataFrame, terms: list[str], text_col: str) -> tuple[np.ndarray, int]:
    """Of each term, and the number of texts, over the whole table."""
    probe = docs.sparkSession.sparkContext.broadcast(Model(terms, np.ones(len(terms)), 1.0, [], (1.0, 1.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, df, n = probe.value, np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hit = model.counts(text)
                if hit:
                    df[list(hit)] += 1
            n += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], names=["term", "n"])

    out, total = np.zeros(len(terms)), 0
    for r in docs.select(text_of(text_col).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            total = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, total


# --- operator -------------------------------------------------------------------------------------


def scores(spark, model: Model | None) -> object:
    """A column function text -> struct(score, neighbours, terms)."""
    shared = ship(spark).sparkContext.broadcast(model)

    @F.pandas_udf("score double, neighbours array<long>, terms array<string>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in parts:
            found = [(0.0, [], []) if own is None else own.score(t) for t in texts]
            yield pd.DataFrame({"score": [f[0] for f in found], "neighbours": [f[1] for f in found], "terms": [f[2] for f in found]})

    return score


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Per row: id_col, held_out, score, predicted, neighbours (ids of the nearest examples), terms (kept terms found)."""
    score = scores(docs.sparkSession, fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample))
    rows = docs.select(F.col(id_col), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), score(text_of(text_col)).alias("s"))
    return rows.select(id_col, "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.neighbours", "s.terms")


def reject_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, with a score below 0.5."""
    score = scores(docs.sparkSession, fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample))
    return docs.where(score(text_of(text_col))["score"] < 0.5)
