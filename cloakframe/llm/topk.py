"""Exact top-k search by inner product, in tiles.

Queries are cut into blocks and candidates into shards by counts known beforehand; every (block,
shard) pair is a tile with a key of its own, so tiles spread over all tasks and each needs two blocks
of bounded size. A tile is one matrix product; a partial selection takes each query's best k of it,
with ties in favour of smaller ids. The lists of a query are merged in a tree, 32 at a time.

Vectors are made integral first (floor(scale * x)); products are computed in float64 when every sum
is provably below 2**53, in Python integers otherwise, so scores are exact. A score beyond a long raises.

Defined results: rows whose id or vector is null, or whose vector holds a null or non-finite component,
take no part; shorter vectors count as padded with zeros; of repeated query ids the least vector is the
query; repeated candidate rows may each take a rank; rows with the query's id are its own; a query
without candidates gives no rows; other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

QUERY_ROWS, SHARD_ROWS, FAN_IN = 2_048, 8_192, 32


def tile_top(q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best of shard s for each query, ties to smaller ids; rows with the query's id left out."""
    order = np.argsort(s_ids, kind="stable")
    s_ids, s = s_ids[order], s[order]
    top = float(np.abs(q).max(initial=0)) * float(np.abs(s).max(initial=0)) * q.shape[1]
    exact = top < 2.0**53
    if not exact:
        q, s = (x.astype(object).astype(int).astype(object) if x.size else x.astype(object) for x in (q, s))
    out: tuple[list, list, list] = ([], [], [])
    for lo in range(0, len(q), 256):
        scores = q[lo : lo + 256] @ s.T
        for own, row in zip(q_ids[lo : lo + 256], scores, strict=True):
            at = np.flatnonzero(s_ids != own) if own in _Sorted(s_ids) else None
            ids, vals = (s_ids, row) if at is None else (s_ids[at], row[at])
            if exact and len(vals) > k:
                least = np.partition(vals, len(vals) - k)[len(vals) - k]
                above = np.flatnonzero(vals > least)
                best = np.concatenate([above, np.flatnonzero(vals == least)[: k - len(above)]])
            else:
                best = np.array(sorted(range(len(vals)), key=lambda i: (-vals[i], i))[:k], np.int64)
            out[0].append(np.full(len(best), own))
            out[1].append(ids[best])
            out[2].append(np.array([int(v) for v in vals[best]], np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


class _Sorted:
    """Membership in a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __contains__(self, x: int) -> bool:
        i = int(np.searchsorted(self.values, x))
        return i < len(self.values) and self.values[i] == x


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per query and rank: query_id, rank (from 1), id_col, score."""
    ship(vectors.sparkSession)
    usable = F.col(id_col).isNotNull() & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), is_query.alias("asks"))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    n, n_asked, width = (x or 0 for x in rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first())
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // query_rows))
    # Of equal rows at most k can be among the best. Shards go by what a row holds, so that a task run again deals it alike.
    cand = rows.groupBy("id", "v").agg(F.count("*").alias("n")).select("id", "v", F.explode(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k)))).alias("copy"))
    cand = cand.select("id", "v", F.pmod(F.xxhash64("id", "v", "copy"), F.lit(shards)).alias("shard"))
    cand = cand.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard").select(F.col("id").alias("sid"), F.col("v").alias("sv"), (F.col("block") * shards + F.col("shard")).alias("stile"))
    ask = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    ask = ask.select("id", "v", (F.col("block") * shards + F.col("shard")).cast("long").alias("tile"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        query, ids, score, at = *(np.empty(0, np.int64),) * 3, 0
        if left.num_rows and right.num_rows:  # an absent side comes without columns
            (q, q_ids), (s, s_ids) = ((_matrix(t.column(v), width), t.column(i).to_numpy()) for t, i, v in ((left, "id", "v"), (right, "sid", "sv")))
            at = left.column("tile")[0].as_py()
            query, ids, score = tile_top(q_ids, q, s_ids, s, k)
        return pa.table({"query_id": pa.array(query, pa.int64()), "part": pa.array(np.full(len(query), at % shards), pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    best = ask.groupBy("tile").cogroup(cand.groupBy("stile")).applyInArrow(tile, "query_id long, part long, id long, score long")
    entry = F.struct((-F.col("score")).alias("low"), F.col("id").alias("id"))
    lists, parts = best.groupBy("query_id", (F.col("part") / FAN_IN).cast("long").alias("part")).agg(_best(F.collect_list(entry), k).alias("top")), -(-shards // FAN_IN)
    while parts > 1:
        lists = lists.groupBy("query_id", (F.col("part") / FAN_IN).cast("long").alias("part")).agg(_best(F.flatten(F.collect_list("top")), k).alias("top"))
        parts = -(-parts // FAN_IN)
    return lists.select("query_id", F.posexplode("top").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.low")).alias("score"))


def _best(entries: Column, k: int) -> Column:
    return F.slice(F.array_sort(entries), 1, k)
