"""Operations on the spans of one text, on arrays (no shuffle) and as relations of span rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.columns import SPAN
from ..plans import spec

NONE = f"array<{SPAN}>"


def span(start: Column, end: Column, entity: Column, score: Column, detector: Column, validated: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), entity.alias("entity_type"), score.cast("double").alias("score"), detector.alias("detector"), validated.alias("validated"))


def _on_arrays(f, kind: str, arrow: pa.DataType):
    """A column function from a function of Python values; arrays of spans come as lists of tuples."""

    @F.arrow_udf(kind)
    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in parts:
            rows = zip(*(c.to_pylist() for c in (cols if isinstance(cols, tuple) else (cols,))), strict=True)
            made = [None if None in r else f(*[[tuple(x.values()) for x in v] if isinstance(v, list) else v for v in r]) for r in rows]
            yield pa.array([m and [dict(zip(NAMES, x, strict=True)) if isinstance(x, tuple) else x for x in m] for m in made], arrow)

    return run


NAMES = ("start", "end", "entity_type", "score", "detector", "validated")
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()), ("detector", pa.string()), ("validated", pa.bool_())]))


def without_contained(spans: Column) -> Column:
    """Spans that no better span of their type covers."""
    return _on_arrays(scan.without_contained, NONE, SPANS)(spans)


def merge(spans: Column) -> Column:
    """Spans that overlap become one; see scan.merged."""
    return _on_arrays(scan.merged, NONE, SPANS)(spans)


def with_cues(text: Column, spans: Column) -> Column:
    """Weak spans lifted where a cue stands shortly before them or heads their table column."""
    return _on_arrays(lambda t, s: scan.scanner((), ()).with_cues(t, s), NONE, SPANS)(text, spans)


def table_headers(text: Column) -> Column:
    """For each line of the text the number of the first line of its run of lines that hold "|"."""
    return _on_arrays(scan.table_headers, "array<int>", pa.list_(pa.int32()))(text)


# --- the same on rows ---------------------------------------------------------------------------------


def dedupe_rows(spans: DataFrame, *keys: str) -> DataFrame:
    """without_contained() on rows: a left anti self-join within (keys, entity_type)."""
    order = lambda s: F.struct(-F.col(f"{s}.score"), F.col(f"{s}.start"), F.col(f"{s}.start") - F.col(f"{s}.end"), F.col(f"{s}.detector"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "entity_type")]
    covered = (F.col("r.start") <= F.col("s.start")) & (F.col("r.end") >= F.col("s.end")) & (order("r") < order("s"))
    cond = covered
    for c in same:
        cond = c & cond
    return spans.where("score > 0").dropDuplicates().alias("s").join(spans.where("score > 0").alias("r"), cond, "left_anti")


def merge_rows(spans: DataFrame, *keys: str) -> DataFrame:
    """merge() on rows: islands by a running maximum of ends, then the greatest struct of each."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "entity_type", "detector", "score", "validated")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("width"), "validated", "score", "entity_type", "detector"))
    out = marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("best"))
    return out.select(*keys, "start", "end", "best.entity_type", "best.score", "best.detector", "best.validated")


def join_address_rows(spans: DataFrame, *keys: str, gap: int = spec.ADDRESS_GAP) -> DataFrame:
    """Spans over two neighbouring addresses at most gap apart, by lead(). Addresses of one place and detector follow each other
    by score and validation, so the rows' order in the table has no say."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "detector", "score", "validated")
    nxt = spans.where("entity_type = 'ADDRESS'").withColumns({"next_start": F.lead("start").over(w), "next_end": F.lead("end").over(w), "next_score": F.lead("score").over(w)})
    near = nxt.where((F.col("next_start") - F.col("end") > 0) & (F.col("next_start") - F.col("end") <= gap))
    return near.select(*keys, "start", F.col("next_end").alias("end"), "entity_type", F.greatest("score", "next_score").alias("score"), F.lit("address.join").alias("detector"), F.lit(False).alias("validated"))
