"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

1. Every document is encoded once; longer ones are cut into full pieces, the shorter remainder first.
2. Pieces are dealt by a hash to groups of about `group_docs` documents, so that no task gets more
   than that however large the input is; at most one sequence a group is left half empty for it.
3. A group is packed best fit, longest first. Then the emptiest sequence is taken again and again and
   its pieces are moved to others, or exchanged one for one or two for one, each step raising the sum
   of squared fills, until sequences empty or no step helps, or the lower bound is reached.

Defined results: a null text is an empty document and gives the end token alone; repeated rows are
packed as often as they occur (`copy` and the input's partition salt the hash, so that one repeated id does not land in one group);
other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer_files
from .common import ship, text_of

GROUP_DOCS = 8_192
_LONG_RUN = re.compile(r"\s{1000}|\S{2000}")


# --- packing of one group -------------------------------------------------------------------------


class Bins:
    """Sequences of one group and where their free room is."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[set[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each to the fullest sequence that has room for it."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0  # bit f: some sequence has f free
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            if room := mask >> n:
                f = n + (room & -room).bit_length() - 1
                b = by_free[f].pop()
                if not by_free[f]:
                    mask &= ~(1 << f)
            else:
                f, b = self.capacity, len(self.items)
                self.items.append(set())
                self.free.append(f)
            self.items[b].add(i)
            self.free[b] = f - n
            by_free[f - n].append(b)
            mask |= 1 << (f - n)

    def fewest(self) -> int:
        """No packing has fewer sequences: by volume, and as pieces over half need one each."""
        return max(-(-sum(self.lengths) // self.capacity), sum(2 * n > self.capacity for n in self.lengths))

    def _put(self, i: int, b: int) -> None:
        self.items[b].add(i)
        self.free[b] -= self.lengths[i]

    def _take(self, i: int, b: int) -> None:
        self.items[b].discard(i)
        self.free[b] += self.lengths[i]

    def search(self) -> None:
        """Empties the emptiest sequences by moves and exchanges until none is left to empty or no step helps. Each step raises
        the sum of squared fills, which is bounded, so this ends."""
        used, least = sum(bool(x) for x in self.items), self.fewest()
        index, changed = _Index(self), True
        while changed and used > least:
            changed = False
            for b in sorted(index.open, key=lambda b: -self.free[b]):
                if not self.items[b] or used <= least:
                    continue
                changed |= self._drain(b, index)
                used -= not self.items[b]

    def _drain(self, b: int, index: _Index) -> bool:
        """Sends what it can of sequence b elsewhere, to sequences that are fuller with it than b was; whether it sent anything."""
        index.close(b)
        sent = False
        while self.items[b] and (step := self._step(b, index)):
            to, take, put = step
            index.change(to, take=take, put=put, source=b)
            sent = True
        index.reopen(b)
        return sent

    def _step(self, b: int, index: _Index) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """A move of a piece of b, else an exchange of one for one, else of two for one: where to, what back, what there. Pieces of
        one length are alike, so lengths are tried and not pieces."""
        by: dict[int, list[int]] = defaultdict(list)
        for i in self.items[b]:
            by[self.lengths[i]].append(i)
        lengths = sorted(by, reverse=True)
        for n in lengths:
            to = index.room(n)
            if to is not None and self.free[to] - n < self.free[b]:
                return to, (), (by[n][0],)
            if hit := index.exchange(n, self.free[b]):
                return hit[0], (hit[1],), (by[n][0],)
        sums: dict[int, tuple[int, int]] = {}
        for k, n in enumerate(lengths):
            for m in lengths[k + (len(by[n]) < 2) :]:
                if n + m <= self.capacity:
                    sums.setdefault(n + m, (by[n][0], by[m][1] if n == m else by[m][0]))
        for total, pair in sorted(sums.items(), reverse=True):
            if hit := index.exchange(total, self.free[b]):
                return hit[0], (hit[1],), pair
        return None


class _Index:
    """Underfull sequences by free room, and by free room with a piece's length."""

    def __init__(self, bins: Bins):
        self.bins = bins
        self.open: set[int] = set()
        self.by_free: dict[int, set[int]] = defaultdict(set)
        self.pairs: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # free -> length -> sequences
        self.lengths_at: dict[int, int] = defaultdict(int)  # free -> bits of the lengths in pairs
        self.mask = 0
        for b, items in enumerate(bins.items):
            if items and bins.free[b] > 0:
                self.reopen(b)

    def reopen(self, b: int) -> None:
        f = self.bins.free[b]
        if f <= 0:
            return
        self.open.add(b)
        self.by_free[f].add(b)
        self.mask |= 1 << f
        for i in self.bins.items[b]:
            self.pairs[f][self.bins.lengths[i]].add(b)
            self.lengths_at[f] |= 1 << self.bins.lengths[i]

    def close(self, b: int) -> None:
        if b not in self.open:
            return
        f = self.bins.free[b]
        self.open.discard(b)
        self.by_free[f].discard(b)
        if not self.by_free[f]:
            self.mask &= ~(1 << f)
        for i in self.bins.items[b]:
            at = self.pairs[f][self.bins.lengths[i]]
            at.discard(b)
            if not at:
                self.lengths_at[f] &= ~(1 << self.bins.lengths[i])

    def room(self, n: int) -> int | None:
        """The fullest sequence with room for n more."""
        m = self.mask >> n
        return min(self.by_free[n + (m & -m).bit_length() - 1]) if m else None

    def exchange(self, n: int, source_free: int) -> tuple[int, int] | None:
        """A sequence that gives up one piece y shorter than n and then holds n, as full as can be; the source, which
        has source_free, must stay the emptier one."""
        best, m = None, self.mask
        while m and (best is None or best[0]):
            f = (m & -m).bit_length() - 1
            m &= m - 1
            if f > source_free:
                break
            low = max(1, n - f)
            if shorter := self.lengths_at[f] >> low:
                y = low + (shorter & -shorter).bit_length() - 1
                if y < n and (best is None or f + y - n < best[0]):
                    best = (f + y - n, f, y)
        if best is None:
            return None
        _, f, y = best
        b = min(self.pairs[f][y])
        return b, min(i for i in self.bins.items[b] if self.bins.lengths[i] == y)

    def change(self, to: int, take: tuple[int, ...], put: tuple[int, ...], source: int) -> None:
        self.close(to)
        for i in take:
            self.bins._take(i, to)
            self.bins._put(i, source)
        for i in put:
            self.bins._take(i, source)
            self.bins._put(i, to)
        self.reopen(to)


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each sequence."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    return [sorted(x) for x in bins.items if x]


# --- operator -------------------------------------------------------------------------------------


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: full ones, the remainder first."""
    return [n % capacity] * bool(n % capacity) + [capacity] * (n // capacity)


def _encoder(tokenizer_path: str, ranks_path: str | None):
    """texts -> arrays of ids. A file of the same vocabulary's ranks gives the same ids in a quarter of the time; texts
    with special strings or very long runs always go to the tokenizer itself."""
    tok = tokenizer_files.load(tokenizer_path)
    fast = tokenizer_files.load_ranks(ranks_path) if ranks_path else None
    special = tokenizer_files.special_strings(tokenizer_path)

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if fast is None or any(s in t for s in special) or _LONG_RUN.search(t):
                slow.append(i)
            else:
                out[i] = np.array(fast.encode_ordinary(t), "<u4")
        if slow:
            for i, e in zip(slow, tok.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4")
        return out

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, copy, and with with_ids its ids."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, ranks_path)
        from pyspark import TaskContext

        tail, copy = np.array([end_id], "<u4"), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in tokenizer_files.by_bytes(texts):
                cols: list[list] = [[] for _ in range(7)]
                for i, ids in zip(range(lo, hi), encode(texts[lo:hi]), strict=True):
                    ids, at = np.concatenate([ids, tail]), 0
                    for k, n in enumerate(cut_lengths(len(ids), capacity)):
                        part = ids[at : at + n]
                        for c, v in zip(cols, (i, k, at, n, zlib.crc32(part.tobytes()), copy, part.astype(np.int32) if with_ids else None), strict=True):
                            c.append(v)
                        at += n
                    copy += 1
                out = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:6])]
                if with_ids:
                    out.append(pa.array(cols[6], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "ids_crc32", "copy", "ids"][: len(out)])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, copy long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids its ids."""
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, tokenizer_path, ranks_path=ranks_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    cut = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.col(id_col), F.col("piece"), F.col("copy")), F.lit(groups)))
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("copy", "pack_group")] + ["sequence_id long", "offset long"]

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=["copy", "pack_group"])
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows["length"].tolist()
        order = rows.reset_index(drop=True).sort_values([id_col, "piece"], kind="stable").index.tolist()
        for s, members in enumerate(pack([lengths[i] for i in order], capacity)):
            at = 0
            for m in members:
                sequence[order[m]], offset[order[m]] = (int(key[0]) << 32) + s, at
                at += lengths[order[m]]
        return rows.assign(sequence_id=sequence, offset=offset)

    names = [f.name for f in cut.schema if f.name not in ("copy", "pack_group")] + ["sequence_id", "offset"]
    return cut.groupBy("pack_group").applyInPandas(place, ", ".join(shape)).select(*names)
