"""Audit events: one validated, structured shape for each event, so that no free text can reach the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policy import ACTIONS

# Codes, destinations and shapes that fields may take.
REASONS = ("host_down", "timeout", "review_timeout", "policy_block")
DESTINATIONS = ("outbox", "clipboard", "cli")
SOURCES = ("download", "package")
ENTITY = "^[A-Z_]{2,32}$"
RULE = r"^([a-z0-9_.]{1,64}|entities\.[A-Z_]{2,32})$"
FILE_TYPE = "^[a-z0-9]{1,8}$"
HOST = r"^(?!-)[A-Za-z0-9-]{1,63}(?<!-)(\.(?!-)[A-Za-z0-9-]{1,63}(?<!-))+$"
SHA256 = "^[0-9a-f]{64}$"

_like = lambda p: lambda c: c.rlike(p) & ~c.contains("\n")
_count = lambda c: c >= 0
_dial = lambda c: c.between(1, 5)
_flag = lambda c: c.isNotNull()
_number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
_among = lambda *v: lambda c: c.isin(*v)
_destination = lambda c: c.isin(*DESTINATIONS) | _like(HOST)(c)
_counts = lambda c: F.forall(F.map_entries(c), lambda e: _like(ENTITY)(e["key"]) & (e["value"] >= 0))

DECISION = {"entity_type": _like(ENTITY), "detector": _like(RULE), "score": _number, "threshold": _number, "rule_id": _like(RULE), "action": _among(*ACTIONS), "validated": _flag, "needs_review": _flag}


def _decisions(c: Column) -> Column:
    def one(d: Column) -> Column:
        ok = F.lit(True)
        for name, check in DECISION.items():
            ok = ok & F.coalesce(check(d[name]), F.lit(False))
        return ok

    return F.forall(c, one)


EVENTS = {
    "engine_start": {"version": _like(RULE)},
    "policy_loaded": {"dial": _dial, "admin_floor": _dial, "entity_count": _count, "locked_count": _count},
    "model_verified": {"model": _like(RULE), "source": _among(*SOURCES), "revision": _like(RULE), "sha256": _like(SHA256)},
    "redaction": {"file_type": _like(FILE_TYPE), "destination": _destination, "entity_counts": _counts, "dial": _dial, "decisions": _decisions},
    "review_decision": {"rule_id": _like(RULE), "action": _among(*ACTIONS), "approved": _flag},
    "upload_blocked": {"destination": _destination, "reason_code": _among(*REASONS)},
    "vault_purge": {"purged_count": _count, "retention_days": _count},
    "remap": {"site": _destination, "label_count": _count, "restored_count": _count, "entity_counts": _counts},
    "copies_purge": {"purged_count": _count, "dropped_count": _count, "kept_count": _count, "retention_days": _count, "index_readable": _flag},
}


def events(rows: DataFrame, event: str, ts: Column | None = None) -> DataFrame:
    """rows as JSON lines of an event. A field too many or too few is refused at once, a value of another shape when the
    line is made; the message names the field, never the value."""
    if event not in EVENTS:
        raise ValueError(f"unknown event {event!r}")
    fields = EVENTS[event]
    if extra := set(rows.columns) - set(fields):
        raise ValueError(f"{event}: unexpected field(s) {sorted(extra)}")
    if missing := set(fields) - set(rows.columns):
        raise ValueError(f"{event}: missing field(s) {sorted(missing)}")
    checked = [F.when(F.coalesce(fields[n](F.col(n)), F.lit(False)), F.col(n)).otherwise(F.raise_error(F.lit(f"{event}: invalid value for field {n!r}")).cast(rows.schema[n].dataType)).alias(n) for n in fields]
    stamp = F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts")
    cols = dict(zip(fields, checked, strict=True)) | {"event": F.lit(event).alias("event"), "ts": stamp}
    return rows.select(F.to_json(F.struct(*[cols[n] for n in sorted(cols)])).alias("value"))


def redaction_events(decided: DataFrame, *, file_type: str, destination: str, dial: int) -> DataFrame:
    """The redaction event of each row with decisions and entity_counts."""
    short = F.transform("decisions", lambda d: F.struct(
        d["entity_type"].alias("entity_type"), F.lower(d["detector"]).alias("detector"), F.round(d["score"], 3).alias("score"), d["threshold"].alias("threshold"), d["rule_id"].alias("rule_id"),
        d["action"].alias("action"), d["validated"].alias("validated"), d["needs_review"].alias("needs_review")))
    return events(decided.select(F.lit(file_type).alias("file_type"), F.lit(destination).alias("destination"), "entity_counts", F.lit(dial).alias("dial"), short.alias("decisions")), "redaction")
