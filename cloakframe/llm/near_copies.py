"""Near copies of documents: exact Jaccard similarity of word shingles, by the set-similarity join of line_dedup.

A document's tokens are 52 bits of the hashes of its distinct runs of `size` words, lower-cased (A-Z) and split at ASCII white
space. A document goes if an earlier one, in the order of (id, hash of the text), has a Jaccard similarity of at least
`threshold`, whether or not that one goes itself: no two documents that stay are that similar.

Defined results: a text of fewer than `size` words has one shingle; null, empty and blank texts have none and equal each
other; ids that aren't whole numbers are ordered by their hash, a null id comes first; rows of one id are told apart by a
64-bit hash of the text; of rows repeated in whole one stays; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import line_dedup, words
from .common import discard, order_id, ship, text_of, written

WORDS, THRESHOLD = 5, 0.8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of words, 52 bits of each, of all texts; how many of each."""
    parts = [t.encode("utf-8").translate(_LOWER) for t in texts]
    found, places = words.word_hashes(b"\n".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    many = np.diff(np.searchsorted(places, np.r_[0, ends])) if parts else np.empty(0, np.int64)
    values, runs = words.run_hashes(found, many, size)
    return line_dedup.sets_of(values >> np.uint64(12), runs)


def _sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """As line_dedup's lines, one for each document; the later ones of equal documents of a batch as gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, length, lo = [], 0, 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                texts.append(text)
                length += len(text)
                if length >= words.BLOCK or i + 1 == batch.num_rows:
                    values, sizes = shingles(texts, size)
                    n = i + 1 - lo
                    yield line_dedup.batch_of_lines(values, sizes, np.arange(n), ids[lo : i + 1], np.zeros(n, np.int64), rows[lo : i + 1])
                    texts, length, lo = [], 0, i + 1

    rows = docs.select(order_id(docs, id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("row"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, line_dedup.LINES)


def drop_near_copies(docs: DataFrame, *, size: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those similar to an earlier one."""
    ship(docs.sparkSession)
    sets = line_dedup.ranked(_sets(docs, size, id_col, text_col))
    gone = written(line_dedup.removed(sets, threshold).select(F.col("id").alias("cf_gone_id"), F.col("row").alias("cf_gone_row")), "near")
    discard(sets)
    own = docs.withColumns({"cf_id": order_id(docs, id_col), "cf_row": F.xxhash64(text_of(text_col))})
    left = own.join(gone, (F.col("cf_id") == F.col("cf_gone_id")) & (F.col("cf_row") == F.col("cf_gone_row")), "left_anti")
    if own.groupBy("cf_id", "cf_row").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["cf_id", "cf_row"])
    return left.drop("cf_id", "cf_row")
