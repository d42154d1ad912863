"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, lower-cased and split at white space, as 52 bits of a hash each (a false match in some
10**12 pairs of lines of 40 words). A line is removed if an earlier line has a Jaccard similarity of at least `threshold`,
whether or not that one is removed itself. Lines are ordered by (id, line number), then by a hash of their tokens.

1. Each batch of texts keeps the first of its equal lines (equal sets of tokens) and marks the others as removed, so that a
   line which a third of all texts hold travels once a batch. What is kept is dealt by a 128-bit digest and written in
   buckets of it; at its digest each set of tokens has one first line. Only these go on.
2. Rarity: token counts over all first lines, by 2**22 hash buckets, a byte each (4 MB in a broadcast, whatever the input).
   Any common order is correct; the rarest tokens first makes candidates few.
3. Prefix filter: two lines that match share one of the first n - ceil(threshold * n) + 1 tokens of this order. A row for
   each of these goes to its token: order, size, position and a 128-bit parity sketch. Tokens of one line only meet nobody
   and are left out. At a token of very many lines the first two common tokens meet in place of the first: a row for each
   pair of it and a later token of the prefix, which is one longer then. Lines so short that only equal tokens reach the
   threshold (up to three at 0.8) are settled by step 1.
4. At its token a line meets the earlier lines. Length filter, positional filter and the sketch (each token of the symmetric
   difference flips at most one bit) are necessary conditions. A line sends on only its nearest partner by the sketch, so a
   group of near copies gives as many links as it has lines, not all pairs.
5. Links are verified with the tokens themselves, read from their buckets. A line none of whose links holds meets all its
   candidates once more, so none is lost.

Plans are the same at every size, and each step's shuffle files go when its result is written.

Defined results: lines are split at "\\n"; lines of fewer than `min_words` distinct words (at 1: lines without a word) always
stay; a null text has no line and stays null; ids that aren't whole numbers are ordered by their hash, a null id comes first;
rows with the same id are told apart by a 64-bit hash of the text; rows repeated in whole are one row with equal results; an
input column lines_removed goes; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import bucketed, discard, order_id, ship, text_of, written

THRESHOLD, MIN_WORDS = 0.8, 1
BUCKETS, SIEVE = 1 << 22, 1 << 22
#: Rows at a token from which pairs of tokens meet.
HOT = 1 << 16
#: Runs of more lines at a token are compared by blocks.
LONG_RUN = 4_096
#: A rarity of n lines is kept as the whole part of this times log2(n + 1).
STEPS = 7.9
LINES = T.StructType([T.StructField(n, t) for n, t in (("d", T.LongType()), ("d2", T.LongType()), ("id", T.LongType()), ("no", T.IntegerType()), ("row", T.LongType()), ("n", T.IntegerType()), ("tokens", T.BinaryType()), ("gone", T.ArrayType(T.IntegerType())))])


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Sets of 52-bit numbers, in 7 bytes each."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((np.r_[0, np.cumsum(sizes)] * 7).astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all sets, and the size of each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view("<u8").ravel(), np.diff(ends) // 7


def sets_of(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list of 52-bit numbers sorted and without repeats."""
    out, counts, at = [], [], np.r_[0, np.cumsum(sizes)]
    for lo in range(0, len(sizes), 4096):
        many = sizes[lo : lo + 4096]
        key = np.sort(np.repeat(np.arange(len(many), dtype=np.uint64), many) << np.uint64(52) | values[at[lo] : at[min(lo + 4096, len(sizes))]])
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        out.append(key & np.uint64((1 << 52) - 1))
        counts.append(np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=len(many)))
    return np.concatenate([np.empty(0, np.uint64), *out]), np.concatenate([np.empty(0, np.int64), *counts])


def prefix_length(n: int, threshold: float = THRESHOLD) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


# --- at a token -----------------------------------------------------------------------------------


def nearest_partners(token: np.ndarray, order: np.ndarray, n: np.ndarray, pos: np.ndarray, sig: np.ndarray, sig2: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of indices: of each line at a token one pair at most, with the earlier line nearest to it by the
    sketch among those that pass the length, positional and sketch filters. `token` is sorted; `order` ranks the lines.

    Runs are sorted by size, so that a line's candidates are its neighbours; a lag is compared for all runs at once. In long
    runs lines are compared by blocks, from their own one back to the first, and leave after the block of their first hit."""
    best, least = np.full(len(token), -1, np.int64), np.full(len(token), 1 << 20, np.int64)
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    each = np.repeat(sizes, sizes)
    rem, half = n - pos, threshold / (1 + threshold)

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        both = n[x] + n[y]
        need = np.ceil(half * both - 1e-9).astype(np.int64)
        ok = np.flatnonzero((rem[x] >= need) & (rem[y] >= need) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9))
        x, y, room = x[ok], y[ok], (both - 2 * need)[ok]
        far = np.bitwise_count(sig[x] ^ sig[y]).astype(np.int64) + np.bitwise_count(sig2[x] ^ sig2[y])
        hit = np.flatnonzero(far <= room)
        x, y, far = x[hit], y[hit], far[hit]
        swap = order[x] < order[y]
        late, early = np.where(swap, y, x), np.where(swap, x, y)
        at = np.lexsort((far, late))  # of each later line the nearest of these
        at = at[np.r_[True, late[at][1:] != late[at][:-1]]] if len(at) else at
        at = at[far[at] < least[late[at]]]
        best[late[at]], least[late[at]] = early[at], far[at]

    short = np.flatnonzero((each > 1) & (each <= LONG_RUN))
    if len(short):
        by = short[np.lexsort((n[short], token[short]))]
        tok, size = token[by], n[by]
        at, lag = np.arange(1, len(by)), 1
        while len(at):
            at = at[at >= lag]
            at = at[(tok[at] == tok[at - lag]) & (size[at - lag] >= threshold * size[at] - 1e-9)]
            compare(by[at], by[at - lag])
            lag += 1
    for s, c in zip(starts[sizes > LONG_RUN].tolist(), sizes[sizes > LONG_RUN].tolist(), strict=True):
        run = s + np.argsort(order[s : s + c])
        for lo in range(0, c, 512):
            left = np.arange(lo, min(lo + 512, c))
            for a in range(lo, -1, -512):
                right = np.arange(a, min(a + 512, c))
                x, y = np.repeat(left, len(right)), np.tile(right, len(left))
                keep = y < x
                compare(run[x[keep]], run[y[keep]])
                left = left[best[run[left]] == -1]
                if not len(left):
                    break
    late = np.flatnonzero(best >= 0)
    return late, best[late]


# --- lines and their first ones -------------------------------------------------------------------


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """As LINES: of each batch the first of its equal lines, and for each text the numbers of its others (gone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, size, lo = [], 0, 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                parts.append(text)
                size += len(text or "")
                if size >= words.BLOCK or i + 1 == batch.num_rows:
                    yield lines_of(parts, ids[lo : i + 1], rows[lo : i + 1], min_words)
                    parts, size, lo = [], 0, i + 1

    rows = docs.select(order_id(docs, id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, LINES)


def lines_of(texts: list[str | None], ids: np.ndarray, rows: np.ndarray, min_words: int) -> pa.RecordBatch:
    doc = np.array([i for i, t in enumerate(texts) if t is not None], np.int64)
    whole = [t for t in texts if t is not None]
    many = np.array([t.count("\n") + 1 for t in whole], np.int64)
    data = words.plain_spaces("\n".join(whole)).lower().encode("utf-8")
    values, places = words.word_hashes(data, words.MORE_SPACES)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), places)
    values, sizes = sets_of(values >> np.uint64(12), np.bincount(line, minlength=int(many.sum())))
    nos = np.arange(len(sizes)) - np.repeat(np.cumsum(many) - many, many)
    which = np.flatnonzero(sizes >= max(1, min_words))
    own = np.repeat(doc, many)[which]
    return batch_of_lines(values, sizes, which, ids[own], nos[which], rows[own])


def batch_of_lines(values: np.ndarray, sizes: np.ndarray, which: np.ndarray, ids: np.ndarray, nos: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Of lines at (id, no, row), each with a set of tokens: the first line of each set, and (id, row) with the numbers of others."""
    import xxhash

    sets, ends = packed(values, sizes), np.r_[0, np.cumsum(sizes)] * 7
    data = memoryview(sets.buffers()[2])
    digests = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    halves, seen = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), {}
    same = np.array([seen.setdefault(x, len(seen)) for x in digests], np.int64)
    at = np.lexsort((rows, nos, ids, same[which]))
    which, ids, nos, rows = which[at], ids[at], nos[at], rows[at]
    group = same[which]
    new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = (ids != ids[lead]) | (nos != nos[lead]) | (rows != rows[lead])
    gone: dict[tuple[int, int], set[int]] = {}
    for key, row, no in zip(ids[other].tolist(), rows[other].tolist(), nos[other].tolist(), strict=True):
        gone.setdefault((key, row), set()).add(no)
    first, m, more = which[new], int(new.sum()), len(gone)
    own = lambda a, kind: pa.concat_arrays([pa.array(a, kind), pa.nulls(more, kind)])
    both = lambda a, k: pa.array(np.r_[a, np.array([g[k] for g in gone], np.int64)], pa.int64())
    cols = [
        both(halves[first, 0], 1), own(halves[first, 1], pa.int64()), both(ids[new], 0), own(nos[new], pa.int32()), both(rows[new], 1), own(sizes[first], pa.int32()),
        pa.concat_arrays([sets.take(pa.array(first)), pa.nulls(more, pa.binary())]), pa.array([*[None] * m, *map(sorted, gone.values())], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(cols, names=LINES.names)


def ranked(lines: DataFrame) -> DataFrame:
    """Lines in buckets of d, with first (whether no equal line is earlier) and tokens for one first line of each digest."""
    dealt = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "d")
    same = Window.partitionBy("d", "d2").orderBy("id", "no", "row")
    placed = dealt.withColumns({"first": F.rank().over(same) == 1, "one": F.row_number().over(same) == 1})
    kept = placed.withColumns({"first": F.col("first") & F.col("d2").isNotNull(), "tokens": F.when(F.col("one"), F.col("tokens"))}).drop("one")
    return bucketed(kept, "lines", "d")


# --- the join -------------------------------------------------------------------------------------


def _table(buckets: DataFrame, size: int) -> np.ndarray:
    """Rows (at, byte, 128 less than the value), at most `size`, as an array."""
    out = np.zeros(size, np.uint8)
    for batch in buckets.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint8) ^ 0x80
    return out


def _rarity(firsts: DataFrame) -> np.ndarray:
    """Counts of tokens by hash bucket over all first lines, on a logarithmic scale."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            np.add.at(out, (unpacked(batch.column(0))[0] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at])], names=["at", "n"])

    counts = firsts.select("tokens").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return _table(counts.select("at", (F.least(F.floor(F.log2(F.col("n") + 1) * STEPS), F.lit(255)).cast("int") - 128).cast("byte").alias("level")), BUCKETS)


def _prefixes(firsts: DataFrame, rarity, threshold: float, wanted=None) -> DataFrame:
    """A row for each prefix token of each line: meet (the token), id, shape (line number, size, position), d, sig, sig2; with
    `wanted` only those whose token it may hold. Sizes beyond 2**24 - 1 and positions beyond 255 are cut: filters weaken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = rarity.value
        single, hot = int(STEPS), int(STEPS * math.log2(HOT + 1))
        sieve = None if wanted is None else wanted.value
        for batch in batches:
            ids, nos, ds = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for lo in range(0, batch.num_rows, 4096):
                h, sizes = unpacked(batch.column(3).slice(lo, 4096))
                line = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.cumsum(sizes) - sizes
                level = levels[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
                bit, half = np.uint64(1) << (h >> np.uint64(46)), h >> np.uint64(45) & np.uint64(1)
                sig, sig2 = (np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), starts) for k in (0, 1))
                # The rarest first, then by 44 bits of the hash, which are the token from here on: one order for all lines.
                key = np.sort(line.astype(np.uint64) << np.uint64(52) | level.astype(np.uint64) << np.uint64(44) | h >> np.uint64(8))
                meet, level = key & np.uint64((1 << 44) - 1), (key >> np.uint64(44)).astype(np.uint8).astype(np.int64)
                pos = np.arange(len(h)) - np.repeat(starts, sizes)
                last = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64)  # the last place of each prefix
                plain = np.flatnonzero((pos <= last[line]) & (level > single) & (level < hot))
                found = [(line[plain], pos[plain], meet[plain])]
                often = np.flatnonzero((pos <= last[line] + 1) & (level >= hot))  # the end of a prefix, and one place more
                if len(often):
                    own, begin, many = np.unique(line[often], return_index=True, return_counts=True)
                    for c in np.unique(many[many > 1]).tolist():
                        a, b = np.triu_indices(c, 1)
                        base = often[begin[many == c]][:, None]
                        i, j = (base + a).ravel(), (base + b).ravel()
                        mixed = meet[i] * np.uint64(0x9E3779B97F4A7C15) ^ meet[j] * np.uint64(0xC2B2AE3D27D4EB4F)
                        found.append((np.repeat(own[many == c], len(a)), pos[i], mixed >> np.uint64(20) | np.uint64(1 << 44)))
                line, pos, meet = (np.concatenate(x) for x in zip(*found, strict=True))
                if sieve is not None:
                    some = sieve[(meet % np.uint64(SIEVE)).astype(np.int64)] > 0
                    line, pos, meet = line[some], pos[some], meet[some]
                shape = nos[lo + line].astype(np.int64) << 32 | np.minimum(sizes[line], (1 << 24) - 1) << 8 | np.minimum(pos, 255)
                cols = (meet.view(np.int64), ids[lo + line], shape, ds[lo + line], sig[line].view(np.int64), sig2[line].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["meet", "id", "shape", "d", "sig", "sig2"])

    return firsts.select("id", "no", "d", "tokens").mapInArrow(run, "meet long, id long, shape long, d long, sig long, sig2 long")


def _links(prefixes: DataFrame, threshold: float) -> DataFrame:
    """For each line the nearest earlier line at each of its tokens: late, early (d of both)."""
    sent = prefixes.repartition("meet").sortWithinPartitions("meet")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last token, which may go on
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(6)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if held and (cut or held[0][0][0] != cols[0][0]):
                yield from _at_tokens([np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)], threshold)
                held = []
            elif cut:
                yield from _at_tokens([c[:cut] for c in cols], threshold)
            held.append([c[cut:] for c in cols])
        if held:
            yield from _at_tokens([np.concatenate(x) for x in zip(*held, strict=True)], threshold)

    return sent.mapInArrow(meet, "late long, early long").distinct()


def _at_tokens(cols: list[np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    token, ids, shape, d, sig, sig2 = cols
    order = np.empty(len(ids), np.int64)
    order[np.lexsort((d, shape >> 32, ids))] = np.arange(len(ids))
    a, b = nearest_partners(token, order, shape >> 8 & 0xFFFFFF, shape & 0xFF, sig.view(np.uint64), sig2.view(np.uint64), threshold)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(d[a]), pa.array(d[b])], names=["late", "early"])


def _verified(links: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """d, d2, held: whether a link of the line holds, by the tokens themselves."""
    pairs = links.join(firsts.select(F.col("d").alias("early"), F.col("tokens").alias("b")), "early").select("late", "b")
    pairs = pairs.join(firsts.select(F.col("d").alias("late"), "d2", F.col("tokens").alias("a")), "late")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for lo in range(0, batch.num_rows, 4096):
                (a, n), (b, m) = (unpacked(batch.column(c).slice(lo, 4096)) for c in (2, 3))
                of = lambda v, sizes: np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(52) | v
                key = np.sort(np.r_[of(a, n), of(b, m)])
                both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(52)).astype(np.int64), minlength=len(n))
                held.append(both >= threshold * (n + m - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.empty(0, bool), *held]))], names=["d", "d2", "held"])

    found = pairs.select(F.col("late").alias("d"), "d2", "a", "b").mapInArrow(compare, "d long, d2 long, held boolean")
    return found.groupBy("d", "d2").agg(F.max("held").alias("held"))


def _retry(missed: DataFrame, firsts: DataFrame, rarity, threshold: float) -> DataFrame:
    """All candidates of the missed lines, as links."""
    spark = firsts.sparkSession
    mine = written(_prefixes(firsts.join(missed, _same(firsts, missed), "left_semi"), rarity, threshold), "lines")
    asked = _table(mine.select(F.pmod("meet", F.lit(SIEVE)).cast("int").alias("at"), F.lit(1).cast("byte").alias("some")).distinct(), SIEVE)
    theirs = _prefixes(firsts, rarity, threshold, spark.sparkContext.broadcast(asked)).select("meet", *[F.col(c).alias(f"e_{c}") for c in ("id", "shape", "d", "sig", "sig2")])
    part = lambda c: (F.shiftright(c, 32), F.shiftright(c, 8).bitwiseAND(0xFFFFFF), F.col(c).bitwiseAND(0xFF))
    (no, n, pos), (e_no, m, e_pos) = part("shape"), part("e_shape")
    need = F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    earlier = F.struct(F.col("e_id").alias("i"), e_no.alias("n"), F.col("e_d").alias("d")) < F.struct(F.col("id").alias("i"), no.alias("n"), F.col("d").alias("d"))
    far = F.bit_count(F.col("sig").bitwiseXOR(F.col("e_sig"))) + F.bit_count(F.col("sig2").bitwiseXOR(F.col("e_sig2")))
    near = (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (F.least(n - pos, m - e_pos) >= need) & (far <= n + m - 2 * need)
    return mine.join(theirs, (mine["meet"] == theirs["meet"]) & earlier & near).select(F.col("d").alias("late"), F.col("e_d").alias("early")).distinct()


def _same(lines: DataFrame, others: DataFrame) -> Column:
    """Equal digests. Only d is an equality to Spark, so that lines are read in their buckets of d."""
    return (lines["d"] == others["d"]) & (lines["d2"] >= others["d2"]) & (lines["d2"] <= others["d2"])


def similar(table: DataFrame, threshold: float) -> DataFrame:
    """Of ranked lines those first ones that are similar to an earlier one: d, d2."""
    longer = table.where("tokens is not null").where(F.col("n") >= threshold * (F.col("n") + 1) - 1e-9)  # shorter ones match equal tokens only
    rarity = table.sparkSession.sparkContext.broadcast(_rarity(longer))
    links = written(_links(_prefixes(longer, rarity, threshold), threshold), "lines")
    found = written(_verified(links, longer, threshold), "lines")
    discard(links)
    near, missed = found.where("held").select("d", "d2"), found.where("not held").select("d", "d2")
    if missed.limit(1).count():
        again = written(_retry(missed, longer, rarity, threshold), "lines")
        near = near.unionByName(_verified(again, longer, threshold).where("held").select("d", "d2"))
    return near


def removed(table: DataFrame, threshold: float) -> DataFrame:
    """Of ranked lines: id, row, gone (the numbers of removed lines)."""
    near, lines = similar(table, threshold).withColumn("near", F.lit(True)), table.where("d2 is not null")
    seen = lines.join(near, _same(lines, near), "left")
    late = seen.where(~F.col("first") | F.coalesce("near", F.lit(False))).select("id", "row", F.array("no").alias("gone"))
    all_ = late.unionByName(table.where("d2 is null").select("id", "row", "gone"))
    return all_.groupBy("id", "row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


# --- operator -------------------------------------------------------------------------------------


def dedup_lines(docs: DataFrame, *, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", count_col: str = "lines_removed") -> DataFrame:
    """docs with all columns, its texts without the removed lines, and count_col (long; an input column of that name goes)."""
    ship(docs.sparkSession)
    table = ranked(_lines(docs, id_col, text_col, min_words))
    gone = written(removed(table, threshold), "lines").select(F.col("id").alias("cf_id"), F.col("row").alias("cf_row"), F.col("gone").alias("cf_gone"))
    discard(table)
    joined = docs.join(gone, (order_id(docs, id_col) == F.col("cf_id")) & (F.xxhash64(text_col) == F.col("cf_row")), "left")
    numbered = F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.array_contains("cf_gone", s["i"])), lambda s: s["x"]), "\n")
    text = F.when(F.col("cf_gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col], F.coalesce(F.size("cf_gone"), F.lit(0)).cast("long").alias(count_col))
