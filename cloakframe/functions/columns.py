"""Scalar functions as native Column expressions: spans of matches, checksums, replacements, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import spec

SPAN = "struct<start:int,end:int,entity_type:string,score:double,detector:string,validated:boolean>"
HIT = "struct<start:int,end:int,value:string>"


def matches(text: Column, pattern: str, only: str | None = None) -> Column:
    """All matches of a Java pattern as array<struct<start,end,value>>, half-open code-point offsets.

    One fold over the matches and the gaps between them gives the positions. Valid for patterns that never match the
    empty string. `only` is a cheaper pattern without which there is no match."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.length(acc["gaps"][i])
        end = start + F.length(acc["found"][i])
        hit = F.struct(start.alias("start"), end.alias("end"), acc["found"][i].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(hit)).alias("out"), acc["found"].alias("found"), acc["gaps"].alias("gaps"))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{HIT}>").alias("out"), found.alias("found"), gaps.alias("gaps"))
    spans = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), begin, step, lambda acc: acc["out"])
    some = text.rlike(only) if only else F.lit(True)
    return F.when(some & text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{HIT}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", digits(value))


def mod97(iban: Column) -> Column:
    """ISO 7064 remainder of an IBAN without spaces; valid ones give 1."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97))


def ssn_issued(value: Column) -> Column:
    d = digits(value)
    area = F.substring(d, 1, 3)
    return ~(area.isin("000", "666") | (F.substring(d, 1, 1) == "9") | (F.substring(d, 4, 2) == "00") | (F.substring(d, 6, 4) == "0000"))


def iban_at(text: Column, start: Column) -> Column:
    """The IBAN that starts at an offset, by its country's length and with single spaces allowed; null if there is none."""
    lengths = F.create_map(*[F.lit(x) for kv in spec.IBAN_LENGTHS.items() for x in kv])
    n = F.try_element_at(lengths, F.substring(text, start + 1, 2))
    shape = F.format_string("^(?:[A-Z0-9] ?){%d}[A-Z0-9]", n - 1)
    found = F.call_function("regexp_extract", F.substring(text, start + 1, 70), shape, F.lit(0))
    return F.when(n.isNotNull() & (found != ""), found)


def mask(value: Column) -> Column:
    """Every letter and digit as "*"."""
    return F.regexp_replace(value, r"[\p{L}\p{N}]", "*")


def strike(value: Column) -> Column:
    return F.repeat(F.lit("█"), F.length(value))


def label(entity_type: Column, n: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("_"), n.cast("string"), F.lit("]"))


def replacement(action: Column, value: Column, labelled: Column) -> Column:
    """What stands for a value; a missing label of a pseudonymised value fails, since the value would survive."""
    named = F.coalesce(labelled, F.raise_error(F.lit("a value to pseudonymise has no number")).cast("string"))
    return (
        F.when(action == "pseudonymize", named).when(action == "mask", mask(value)).when(action.isin("strike", "box"), strike(value))
        .when(action == "omit", F.lit("")).otherwise(F.raise_error(F.lit("unknown action")).cast("string"))
    )


def splice(text: Column, cuts: Column) -> Column:
    """text with each of the sorted, disjoint cuts (array<struct<start,end,sub>>) replaced by its sub."""
    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, c: F.struct(c["end"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, c["start"] - acc["pos"]), c["sub"]).alias("out"))
    return F.aggregate(cuts, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def hmac_sha256(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC as hex, from the key's inner and outer pads as binary columns."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)
