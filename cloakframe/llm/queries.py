"""Queries and oracle SQL of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_codec, line_dedup, mpeg, packing, sharding, simhash, token_counts, topk, toxicity, warc

#: Byte limit of a shard. A parameter: a cluster's files would rather take 256 MiB; this makes test tables split too.
SHARD_BYTES = 1 << 20


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg.media_of_texts(_read(spark, sf_dir, "documents"))
    return found.withColumn("seek_offsets", F.concat_ws(",", F.col("seek_offsets").cast("array<string>")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op6_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.code_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_nearest_examples_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.withColumns({"neighbours": F.concat_ws(",", "neighbours"), "terms": F.concat_ws(",", "terms")})


def op10_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(_read(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
w as (select html, max(page_id) as top from p where strlen(html) >= 1000 group by html)
select p.page_id, strlen(p.html) as payload_bytes, sha1(p.html) as payload_digest,
       case when w.top is not null and p.page_id is distinct from w.top then 'revisit' else 'response' end as record_type,
       case when p.page_id is distinct from w.top then w.top end as refers_to
from p left join w on p.html = w.html
"""

#: Candidates by the rarest tokens, as any exact join may take them; every pair is verified by its tokens.
OP5_SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents where text is not null),
t as (select doc_id, no, line, doc_id * 4294967296 + no as place,
             list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''))) as toks from l),
s as (select toks, min(place) as first, len(toks) as n from t where len(toks) > 0 group by toks),
w as (select first, n, unnest(toks) as tok from s),
r as (select first, n, tok, row_number() over (partition by first order by c, tok) as pos from w join (select tok, count(*) as c from w group by tok) using (tok)),
p as (select first, n, tok from r where pos <= n - ceil(0.8 * n - 1e-9) + 1),
c as (select distinct a.first as late, b.first as early from p a join p b on a.tok = b.tok and b.first < a.first and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
v as (select late, x.n + y.n as n, len(list_intersect(x.toks, y.toks)) as common from c join s x on x.first = c.late join s y on y.first = c.early),
near as (select distinct late from v where common >= 0.8 * (n - common) - 1e-9),
m as (select t.doc_id, t.no, t.line, s.first is not null and (s.first <> t.place or near.late is not null) as gone
      from t left join s on s.toks = t.toks left join near on near.late = s.first),
k as (select doc_id, string_agg(line, chr(10) order by no) filter (not gone) as kept, count(*) filter (gone) as lines_removed from m group by doc_id)
select d.doc_id, case when coalesce(k.lines_removed, 0) = 0 then d.text else coalesce(k.kept, '') end as text, cast(coalesce(k.lines_removed, 0) as bigint) as lines_removed
from documents d left join k on k.doc_id = d.doc_id
"""

OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_mpeg_audio, op3_best_fit_packing, op4_warc_index, op5_line_dedup, op6_tiled_top_k, op7_bpe_codec, op8_simhash_ball, op9_nearest_examples_toxicity, op10_extendible_hashing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_index": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_tiled_top_k": OP6_SQL, "op10_extendible_hashing": sharding.oracle(SHARD_BYTES)}
