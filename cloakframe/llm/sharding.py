"""Sharding by extendible hashing, in DataFrame operations only.

A row's place is a 60-bit hash of its id and its text's digest. The directory starts as one bucket and
only buckets over the byte limit are split on their next bit, until each fits. A round looks at 16 more
bits at once: bytes are summed by these bits (at most 65,536 cells for each bucket that is still too
large, pre-aggregated before the shuffle), buckets of the lower 8 bits are summed from cells and those
of the upper 8 from the highest of these, and a row's bucket is the shallowest that fits. A bucket of the
upper bits meets its cells as the buckets half way down, so that a key has at most 256 cells. Rows are
joined to cells by hash bits; only rows of cells that fit at no depth go to the next round.

Rows whose hashes are all equal (the same id and text again and again) cannot be told apart by any bit.
Such a bucket is paged instead: rows are numbered through counts by input partition, so that no task
gets the whole group, and page p is named after the bits with "/p". A single row over the limit is a
shard of its own.

Defined results: a null text has 0 bytes and counts as empty, a null id as the empty string in the hash;
an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

HASH_BITS, STEP = 60, 16


def extendible_shards(docs: DataFrame, *, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """Per row: id_col, n_bytes, shard (its hash bits, "" for the whole table, with "/page" for pages), depth, shard_docs, shard_bytes."""
    body = text_of(text_col)
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(body.cast("binary")))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(body).cast("long").alias("n"), F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"))
    todo = rows = written(rows, "shards")
    placed, base = None, 0
    while base < HASH_BITS:
        deep = min(base + step, HASH_BITS)
        cells = _cells(todo, base, deep, max_bytes)
        cells = written(cells, "shards")
        at = F.shiftright("h", HASH_BITS - deep)
        hit = todo.withColumn("cell", at).join(cells.where("depth is not null"), "cell").drop("cell")
        placed = hit if placed is None else placed.unionByName(hit)
        left = cells.where("depth is null").select("cell")
        if not left.limit(1).count():
            break
        todo, base = written(todo.withColumn("cell", at).join(left, "cell", "left_semi").drop("cell"), "shards"), deep
    name = F.when(F.col("depth") == 0, "").otherwise(F.substring(F.lpad(F.conv(F.col("h").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), F.col("depth")))
    named = placed.select("id", "n", "h", name.alias("shard"), "depth", "docs", "bytes", "paged")
    whole = named.where("not paged").select("id", "n", "shard", "depth", F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
    if named.where("paged").limit(1).count():
        whole = whole.unionByName(_pages(named.where("paged"), max_bytes))
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), "shard", "depth", "shard_docs", "shard_bytes")


def _cells(rows: DataFrame, base: int, deep: int, max_bytes: int) -> DataFrame:
    """Cells of `deep` bits: cell, and of the shallowest bucket above it, from `base` bits on, that fits or can't be
    split: depth, docs, bytes, paged; nulls where none does."""
    cells = rows.groupBy(F.shiftright("h", HASH_BITS - deep).alias("cell")).agg(F.sum("n").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("low"), F.max("h").alias("high"))
    half = (base + deep) // 2
    sums = [F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high")]
    low = cells.select("*", F.explode(F.sequence(F.lit(half), F.lit(deep))).alias("depth")).groupBy("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("bits")).agg(*sums)
    fits = (F.col("bytes") <= max_bytes) | (F.col("low") == F.col("high"))
    is_leaf = F.struct("depth", "docs", "bytes", ((F.col("bytes") > max_bytes) & (F.col("docs") > 1)).alias("paged")).alias("leaf")
    leaf = low.where(fits).select(F.col("depth").alias("meet"), "bits", is_leaf)
    if half > base:
        high = low.where(F.col("depth") == half).withColumnRenamed("bits", "at").drop("depth").select("*", F.explode(F.sequence(F.lit(base), F.lit(half - 1))).alias("depth"))
        high = high.groupBy("depth", F.expr(f"shiftright(at, {half} - depth)").alias("bits")).agg(*sums).where(fits)
        below = F.expr(f"explode(sequence(shiftleft(bits, {half} - depth), shiftleft(bits + 1, {half} - depth) - 1))")
        leaf = leaf.unionByName(high.select(F.lit(half).alias("meet"), below.alias("bits"), is_leaf))
    leaf = leaf.groupBy("meet", "bits").agg(F.min("leaf").alias("leaf"))
    up = cells.select("cell", F.explode(F.sequence(F.lit(half), F.lit(deep))).alias("meet")).withColumn("bits", F.expr(f"shiftright(cell, {deep} - meet)"))
    found = up.join(leaf, ["meet", "bits"]).groupBy("cell").agg(F.min("leaf").alias("leaf"))
    return cells.select("cell").join(found, "cell", "left").select("cell", "leaf.depth", "leaf.docs", "leaf.bytes", "leaf.paged")


def _pages(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of buckets that no bit can split, dealt to pages of as many rows as fit."""
    part = written(rows.withColumn("part", F.spark_partition_id()), "shards")
    before = part.groupBy("shard", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    mine = part.withColumn("own", F.row_number().over(Window.partitionBy("shard", "part").orderBy("id")))
    number = mine.join(before.select("shard", "part", F.coalesce("before", F.lit(0)).alias("before")), ["shard", "part"])
    each = F.greatest(F.lit(1), F.expr(f"{max_bytes} div n"))
    page = F.expr("cast((before + own - 1) div each as long)")
    paged = number.withColumn("each", each).withColumn("page", page)
    on_page = F.least("each", F.col("docs") - F.col("page") * F.col("each"))
    return paged.select("id", "n", F.concat_ws("/", "shard", F.col("page").cast("string")).alias("shard"), "depth", on_page.alias("shard_docs"), (on_page * F.col("n")).alias("shard_bytes"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes docs to one folder a shard; ids must be unique here."""
    docs.join(shards.select(id_col, "shard"), id_col).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(max_bytes: int, table: str = "documents") -> str:
    """The same as DuckDB SQL, for tables whose shards need at most 24 bits and no pages."""
    return f"""
    with s as (select doc_id, strlen(coalesce(text, '')) n, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) h from {table}),
    up as (select doc_id, n, t, h >> (60 - t) as bits, h from s, (select unnest(range(0, 25)) t)),
    b as (select t, bits, sum(n) as bytes, count(*) docs, min(h) lo, max(h) hi from up group by t, bits),
    leaf as (select u.doc_id, u.n, min(u.t) depth from up u join b on u.t = b.t and u.bits = b.bits where b.bytes <= {max_bytes} or b.lo = b.hi group by u.doc_id, u.n, u.h)
    select l.doc_id, l.n as n_bytes, case when l.depth = 0 then '' else substr(lpad(bin(s.h), 60, '0'), 1, l.depth) end as shard, l.depth::int as depth,
           b.docs as shard_docs, cast(b.bytes as bigint) as shard_bytes
    from leaf l join s on s.doc_id is not distinct from l.doc_id and s.n = l.n join b on b.t = l.depth and b.bits = (s.h >> (60 - l.depth))
    """
