"""detect(): texts -> spans. One Arrow-batched pass with all rules (functions/scan.py), without a shuffle.

Single rules are native column expressions too (rule_spans, term_spans), for queries that need one pattern only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scan
from ..functions.unicode import canonical as canonical_form
from ..functions.unicode import canonicalise
from ..plans import spec
from ..session import ship
from . import spans as S

FOUND = f"struct<clean:string,source:array<int>,spans:array<{C.SPAN}>>"
SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()), ("detector", pa.string()), ("validated", pa.bool_())])
FOUND_TYPE = pa.struct([("clean", pa.string()), ("source", pa.list_(pa.int32())), ("spans", pa.list_(SPAN_TYPE))])


def as_dicts(spans: Iterable[scan.Span]) -> list[dict]:
    return [dict(zip(("start", "end", "entity_type", "score", "detector", "validated"), s, strict=True)) for s in spans]


def as_tuples(spans: list[dict] | None) -> list[scan.Span]:
    return [tuple(s.values()) for s in spans or ()]


def scanned(text: str, own: scan.Scanner, fold: bool, more: Iterable[scan.Span]) -> tuple[str, list[int] | None, list[scan.Span]]:
    """The text the rules saw, its offset map (None for the identity), the spans."""
    clean, source = canonical_form(text) if fold else (text, None)
    return clean, source, own.spans(clean, more)


def prepared(docs: DataFrame, text_col: str, canonical: bool, model: Callable[[Column], Column] | None) -> tuple[DataFrame, Column, Column, bool]:
    """docs, text, spans of the model, whether the text is still to be folded. A model sees the folded text, which then needs a column."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if model is None:
        return docs, text, F.lit(None).cast(f"array<{C.SPAN}>"), canonical
    if not canonical:
        return docs, text, model(text), False
    folded = docs.withColumn("cf_folded", canonicalise(text))
    return folded, F.col("cf_folded.clean"), model(F.col("cf_folded.clean")), False


def detect(docs: DataFrame, *, text_col: str = "text", terms: Sequence[str] = (), rules: Iterable[spec.Rule] = spec.RULES, model: Callable[[Column], Column] | None = None, canonical: bool = True) -> DataFrame:
    """docs with cf_clean (the text the detectors saw), cf_source (offset map, null for the identity) and cf_spans (array).

    A null text is empty. `model` is a column function text -> array of spans (see operators/ner.py)."""
    ship(docs.sparkSession)
    rules, terms = tuple(rules), tuple(terms)
    docs, text, more, fold = prepared(docs, text_col, canonical, model)

    @F.arrow_udf(FOUND)
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = scan.scanner(rules, terms)
        for texts, extra in parts:
            out = []
            for t, x in zip(texts.to_pylist(), extra.to_pylist(), strict=True):
                clean, source, spans = scanned(t, own, fold, as_tuples(x))
                out.append({"clean": None if source is None else clean, "source": source, "spans": as_dicts(spans)})
            yield pa.array(out, FOUND_TYPE)

    seen = docs.withColumn("cf_found", run(text, more))
    whole, source = F.coalesce("cf_found.clean", text), F.col("cf_found.source")
    if model is not None and canonical:
        source = F.col("cf_folded.source")
    return seen.withColumns({"cf_clean": whole, "cf_source": source, "cf_spans": F.col("cf_found.spans")}).drop("cf_found", "cf_folded")


# --- single rules, natively ---------------------------------------------------------------------------


def _checked(rule: spec.Rule, hits: Column) -> Column:
    """Hits of a rule as spans; validators raise the score to 1 or drop the hit."""
    if rule.check == "ssn":
        hits = F.filter(hits, lambda h: C.ssn_issued(h["value"]))
    elif rule.check == "luhn":
        hits = F.filter(hits, lambda h: C.luhn(h["value"]))
    elif rule.check == "card":
        hits = F.filter(hits, lambda h: F.length(C.digits(h["value"])).between(13, 19) & C.luhn(h["value"]))
    score = 1.0 if rule.check in ("luhn", "card") else rule.score
    sure = rule.entity in spec.CONFIRMED and score >= spec.CONFIRMED_SCORE
    return F.transform(hits, lambda h: S.span(h["start"], h["end"], F.lit(rule.entity), F.lit(score), F.lit(rule.source), F.lit(sure)))


def rule_spans(text: Column, rule: spec.Rule) -> Column:
    return _checked(rule, C.matches(text, rule.java, rule.java_only))


def iban_spans(text: Column) -> Column:
    """IBANs at every position, glued to a label or not: certain if the checksum holds, else still a likely misread."""
    starts = C.matches(text, "[A-Z]{2}[0-9]{2}", "[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}")
    found = F.filter(F.transform(starts, lambda h: F.struct(h["start"].alias("start"), C.iban_at(text, h["start"]).alias("value"))), lambda h: h["value"].isNotNull())

    def one(h: Column) -> Column:
        sure = C.mod97(F.replace(h["value"], F.lit(" "), F.lit(""))) == 1
        return S.span(h["start"], h["start"] + F.length(h["value"]), F.lit("IBAN"), F.when(sure, 1.0).otherwise(0.6), F.lit("glued_iban"), sure)

    return F.transform(found, one)


def term_spans(text: Column, terms: Sequence[str]) -> Column:
    out = [C.matches(text, f"(?Uiu){spec.term_pattern(t)}") for t in dict.fromkeys(terms) if t.strip()]
    return F.transform(F.concat(*out), lambda h: S.span(h["start"], h["end"], F.lit("COMPANY_TERM"), F.lit(1.0), F.lit("company_term"), F.lit(True))) if out else F.array().cast(S.NONE)


def span_rows(docs: DataFrame, rules: Iterable[spec.Rule], *keys: str, text_col: str = "text") -> DataFrame:
    """Raw spans of some rules as rows, with their values."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(*[rule_spans(text, r) for r in rules])
    rows = docs.select(*keys, text.alias("body"), F.explode(spans).alias("s"))
    return rows.select(*keys, "s.*", F.substring("body", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


# --- for SQL ------------------------------------------------------------------------------------------


def register(spark: SparkSession, name: str = "detect_pii", terms: Sequence[str] = ()) -> None:
    """A table function for SQL: select * from docs, lateral detect_pii(docs.text)."""
    ship(spark)
    own_terms = tuple(terms)

    @F.udtf(returnType="start: int, end: int, entity_type: string, score: double, detector: string, validated: boolean, value: string")
    class Detect:
        def eval(self, text: str):
            text = text or ""
            clean, source, spans = scanned(text, scan.scanner(spec.RULES, own_terms), True, ())
            for start, end, *rest in spans:
                if source is not None:
                    start, end = source[start], source[end - 1] + 1
                yield start, end, *rest, text[start:end]

    spark.udtf.register(name, Detect)
