"""The corpus pipeline: toxic documents go, repeated lines go, documents near to an earlier one go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents. run()
writes each stage's result to the shared folder as Parquet and reads it again for the next. Nulls, empty texts,
repeated rows, empty tables and further columns have the results that the operators' docstrings state; a document
whose lines all go stays with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import line_dedup, near_copies, packing, simhash, toxicity
from cloakframe.llm.common import discard, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, count_col="cf_lines_removed")
    if "n_chars" in docs.columns:  # follows the text
        out = out.withColumn("n_chars", F.when(F.col("cf_lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (five words, 4 of 64 bits). Copies of a similarity near 0.8 differ in about ten
    bits, which no ball of a payable radius reaches: those are found by the exact join of shingle sets."""
    kept = written(simhash.keep_one(docs, words=near_copies.WORDS), "kept")
    return near_copies.drop_near_copies(kept)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup_stage), ("best_fit_packing", packing_stage)]

#: Tokenizers and learned scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
