"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart share a variant at most r bits from each. So every distinct
fingerprint emits all its variants within r bits (2,081 for r = 2) and those that emit an equal
variant are linked; by the triangle inequality such a pair is never further than 2r apart, which is
verified all the same.

The shuffle is on the variants, packed: variants that share their first `prefix` bits travel as one
row (bucket, fingerprint) and are written out only where they meet, so that a fingerprint costs
79 rows (12 bits) in place of 2,081. The prefix grows with the logarithm of the number of
fingerprints, which keeps a bucket within memory. A bucket emits a spanning star of each of
its groups, at most one row a fingerprint, never all pairs. Texts with equal fingerprints are
merged before.

Defined results: words are split at ASCII white space after lower-casing A-Z; a text of fewer than
`words` words has one shingle, a null, empty or blank one none and fingerprint zero; texts with
fingerprint zero are linked like others; repeated rows get equal results; rows with a null id are
fingerprinted too, and a component of nulls only has a null id; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of, written
from .components import components

WORDS, SEED, BITS = 4, 42, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import xxhash

    parts = text.encode("utf-8").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        shingles = [joined]
    else:
        ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
        starts = [0, *(e + 1 for e in ends)]
        shingles = [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=False)]
    digest = xxhash.xxh64_digest
    total = np.zeros((8, 256), np.int64)
    for lo in range(0, len(shingles), 1 << 20):
        raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles[lo : lo + (1 << 20)]]), np.uint8).reshape(-1, 8)
        total += np.bincount((raw + np.arange(8, dtype=np.uint16) * 256).ravel(), minlength=2048).reshape(8, 256)
    ones = (total @ _BIT_OF_BYTE).ravel()  # from the highest bit
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp (the fingerprint as a signed long)."""
    return _fingerprinted(docs, words, id_col, text_col).drop("hash")


def _fingerprinted(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, fp, hash (of the text, which tells rows of one id apart)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["id", "fp", "hash"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("hash"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long, hash long")


def flips(bits: int, most: int) -> list[int]:
    """All masks of at most `most` set bits among the lowest `bits`."""
    out, layer = [0], [(0, 0)]
    for _ in range(most):
        layer = [(m | 1 << k, k + 1) for m, at in layer for k in range(at, bits)]
        out += [m for m, _ in layer]
    return out


def star_links(fps: np.ndarray, buckets: np.ndarray, prefix: int, radius: int) -> np.ndarray:
    """Links of the fingerprints whose variants meet in these buckets, each (smaller, larger) once and without circles.

    fps[i] (uint64) was sent to buckets[i]; its variants there differ from it in at most radius bits in all."""
    low = BITS - prefix
    away = np.bitwise_count((fps >> np.uint64(low)) ^ buckets).astype(np.int64)
    made, owner = [], []
    base = (fps & np.uint64((1 << low) - 1)) | (buckets << np.uint64(low))
    for j in range(radius + 1):
        at = np.flatnonzero(away == j)
        masks = np.array(flips(low, radius - j), np.uint64)
        for part in np.array_split(at, max(1, len(at) * len(masks) // (1 << 22))):
            made.append((base[part][:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(part, len(masks)))
    variants, own = np.concatenate(made), np.concatenate(owner)
    order = np.argsort(variants)
    variants, mine = variants[order], fps[own[order]]
    del order, own
    first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
    sizes = np.diff(np.r_[first, len(variants)])
    many = sizes > 1
    if not many.any():
        return np.empty((0, 2), np.uint64)
    keep = np.repeat(many, sizes)
    mine, sizes = mine[keep], sizes[many]
    least = np.repeat(np.minimum.reduceat(mine, np.r_[0, np.cumsum(sizes)[:-1]]), sizes)
    links = np.unique(np.stack([least, mine], 1)[least != mine], axis=0)
    links = links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 2 * radius]
    return _forest(links)


def _forest(links: np.ndarray) -> np.ndarray:
    """The links without those whose ends are already connected."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for a, b in links.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, np.uint64).reshape(-1, 2)


def ball_links(distinct: DataFrame, n: int, radius: int = 2) -> DataFrame:
    """Links (a, b) of the distinct fingerprints fp within 2 * radius bits, enough to connect each group."""
    prefix = 12 + max(0, (n >> 25).bit_length())
    low = BITS - prefix
    buckets = F.transform(F.array(*[F.lit(m).cast("int") for m in flips(prefix, radius)]), lambda m: F.shiftrightunsigned("fp", low).cast("int").bitwiseXOR(m))
    sent = distinct.select("fp", F.explode(buckets).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_f, left_b = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def links(f: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            found = star_links(f, b, prefix, radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            f = np.concatenate([left_f, batch.column(0).to_numpy().view(np.uint64)])
            b = np.concatenate([left_b, batch.column(1).to_numpy().astype(np.uint64)])
            cut = int(np.searchsorted(b, b[-1])) if len(b) else 0  # the last bucket may go on
            left_f, left_b = f[cut:], b[cut:]
            if cut:
                yield links(f[:cut], b[:cut])
        if len(left_f):
            yield links(left_f, left_b)

    return sent.mapInArrow(meet, "a long, b long")


def _grouped(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp, least) with the root of each fingerprint's component."""
    roots = components(ball_links(distinct.select("fp"), distinct.count(), radius))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, words: int = WORDS, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, fingerprint (16 lower-case hex digits), component_id: the smallest id reachable over links of at most 2 * radius bits."""
    rows = written(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "simhash")
    grouped = _grouped(written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash"), radius)
    of_root = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(of_root, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, words: int = WORDS, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one stays of each group: that with the smallest id (a null id comes last), then the
    smallest hash of the text. Rows are told apart by id and text, so that rows that share an id do not stand for one another."""
    rows = written(_fingerprinted(docs, words, id_col, text_col), "simhash")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("least")
    first = _grouped(written(rows.groupBy("fp").agg(least), "simhash"), radius).groupBy("root").agg(F.min("least").alias("least"))
    kept = first.select(F.col("least.id").alias("cf_kept_id"), F.col("least.hash").alias("cf_kept_hash"))
    own = docs.withColumn("cf_hash", F.xxhash64(text_of(text_col)))
    left = own.join(kept, F.col(id_col).eqNullSafe(F.col("cf_kept_id")) & (F.col("cf_hash") == F.col("cf_kept_hash")), "left_semi")
    if rows.groupBy("id", "hash").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates([id_col, "cf_hash"])
    return left.drop("cf_hash")
