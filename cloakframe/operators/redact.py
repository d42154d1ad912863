"""The engine: detect, decide, number, splice, audit, over a table of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scan
from ..plans import spec
from ..plans.policy import DECISION, DECISIONS, Decider, Policy
from ..session import ship, spread, written
from . import vault as V
from .detectors import as_tuples, prepared, scanned
from .spans import NONE  # noqa: F401  (the type of an empty span array, for models)

CHECKED = pa.struct([("decisions", DECISIONS), ("failed", pa.string())])


@dataclass
class Redacted:
    """texts: the input with redacted, decisions and entity_counts; vault_rows: what the run adds to the vault."""

    texts: DataFrame
    vault_rows: DataFrame | None


def decided(docs: DataFrame, policy: Policy, *, text_col: str = "text", site: str | None = None, model=None, go_on: bool = False) -> DataFrame:
    """docs with decisions and entity_counts, in one pass over the texts and without a shuffle; a null text has no decisions.

    With `go_on` a text on which detection fails has null decisions and the kind of its error in `failed`, and the others go on;
    else the query fails."""
    ship(docs.sparkSession)
    own, terms = Decider(policy, site), tuple(policy.company_terms())
    seen, text, more, fold = prepared(spread(docs), text_col, True, model)
    source = F.col("cf_folded.source") if model is not None else F.lit(None).cast("array<int>")

    @F.arrow_udf(f"struct<decisions:array<{DECISION}>,failed:string>")
    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        scanner = scan.scanner(spec.RULES, terms)
        for cols in parts:
            out = []
            for t, m, x in zip(*(c.to_pylist() for c in cols), strict=True):
                try:
                    clean, mapped, spans = scanned(t, scanner, fold, as_tuples(x))
                    out.append({"decisions": own.decisions(clean, mapped if fold else m, spans), "failed": None})
                except Exception as e:
                    if not go_on:
                        raise
                    out.append({"decisions": None, "failed": type(e).__name__})
            yield pa.array(out, CHECKED)

    run = run.asNondeterministic()  # else a filter on decisions, also the one that explode() implies, would repeat the pass
    out = seen.withColumn("cf_checked", run(text, source, more)).withColumn("decisions", F.col("cf_checked.decisions"))
    kinds = F.transform("decisions", lambda d: d["entity_type"])
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda t: F.struct(t, F.size(F.filter(kinds, lambda x: x == t)).cast("long"))))
    out = out.withColumns({"entity_counts": counts} | ({"failed": F.col("cf_checked.failed")} if go_on else {}))
    return out.drop("cf_checked", "cf_folded")


def without_labels(policy: Policy) -> Policy:
    """The policy with values struck out where it would number them: for use without a vault."""
    return replace(policy, entities={k: replace(e, action="strike") if e.action == "pseudonymize" else e for k, e in policy.entities.items()})


def redact(docs: DataFrame, policy: Policy, *, id_col: str = "doc_id", text_col: str = "text", scope_col: str | None = None, seq_col: str | None = None, key: bytes | None = None, vault: DataFrame | None = None, now: float = 0.0, site: str | None = None, model=None, go_on: bool = False) -> Redacted:
    """Redacts a table of texts.

    Masks, strikes and omissions are spliced in the scan's own stage. Only values to pseudonymise leave their row: they
    are numbered per (scope, type) in the order of (seq, id, row, position), by default in one scope for each id, and their
    labels come back to those rows that need some, by a number of the row. Ids may repeat or be null: rows of one id share
    its scope, null is a scope of its own. Without a key, a policy that pseudonymises fails. A text that failed (go_on) has a
    null `redacted`, never its own text."""
    spark = docs.sparkSession
    found = decided(docs, policy, text_col=text_col, site=site, model=model, go_on=go_on)
    if not any(e.action == "pseudonymize" for e in policy.live().values()):
        return Redacted(found.withColumn("redacted", spliced(F.col(text_col), F.col("decisions"))), None)
    if key is None:
        raise V.VaultError("this policy pseudonymises: a vault key is needed")
    found = written(found.withColumn("cf_row", F.monotonically_increasing_id()), "decided")  # detection runs once, rows keep their number
    mine = F.filter("decisions", lambda d: d["action"] == "pseudonymize")
    scope = F.coalesce(F.col(scope_col or id_col).cast("string"), F.lit("\x00"))
    value = lambda d: F.substring(F.col(text_col), d["start"] + 1, d["end"] - d["start"])
    each = found.select(scope.alias("scope"), F.col(seq_col or id_col).alias("seq"), F.col(id_col).alias("id"), "cf_row", F.explode(F.transform(mine, lambda d: F.struct(d["start"].alias("start"), d["entity_type"].alias("entity_type"), value(d).alias("value")))).alias("d"))
    values = each.select("scope", "d.entity_type", "d.value", "seq", "id", "cf_row", "d.start")
    numbers, rows = V.number(values, vault if vault is not None else V.empty(spark), key, now)
    named = F.struct("start", C.label(F.col("entity_type"), F.col("n")).alias("label"))
    labels = values.join(numbers, ["scope", "entity_type", "value"]).groupBy("cf_row").agg(F.collect_list(named).alias("cf_labels"))
    some = F.coalesce(F.size(mine) > 0, F.lit(False))
    plain = found.where(~some).withColumn("redacted", spliced(F.col(text_col), F.col("decisions")))
    back = found.where(some).join(labels, "cf_row", "left").withColumn("redacted", spliced(F.col(text_col), F.col("decisions"), F.col("cf_labels"))).drop("cf_labels")
    return Redacted(plain.unionByName(back).drop("cf_row"), rows)


def replaced(action: str, value: str, label: str | None) -> str:
    """What stands for a value. A missing label or an unknown action raises, since the value would survive."""
    if action == "mask":
        return "".join("*" if c.isalpha() or c.isnumeric() else c for c in value)
    if action in ("strike", "box"):
        return "█" * len(value)
    if action == "omit":
        return ""
    if action == "pseudonymize" and label is not None:
        return label
    raise ValueError("a value to pseudonymise has no number" if action == "pseudonymize" else "unknown action")


def spliced(text: Column, decisions: Column, labels: Column | None = None) -> Column:
    """The text with each of its sorted, disjoint decisions carried out; null without decisions (null). Texts without any never leave the JVM."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, found: pa.Array, named: pa.Array) -> pa.Array:
        out = []
        for t, cuts, labels in zip(texts.to_pylist(), found.to_pylist(), named.to_pylist(), strict=True):
            if t is None or cuts is None:
                out.append(None)
                continue
            own, at, parts = {x["start"]: x["label"] for x in labels or ()}, 0, []
            for c in cuts:
                parts += (t[at : c["start"]], replaced(c["action"], t[c["start"] : c["end"]], own.get(c["start"])))
                at = c["end"]
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    cuts = F.transform(decisions, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["action"].alias("action")))
    some = F.size(decisions) > 0
    done = run(F.when(some, text), F.when(some, cuts), labels if labels is not None else F.lit(None).cast("array<struct<start:int,label:string>>"))
    return F.when(some, done).when(decisions.isNotNull(), text)
