"""Queries of the library's operators over the driver's tables, and the same as SQL where SQL can express them.

Texts of the tables hold few shapes, so several queries build theirs from numeric columns, in both engines alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.unicode import canonicalise, casefold, fuzzy_contains, subkey
from ..operators import audit, chunks, evaluate, geometry, spans, vault
from ..operators.detectors import iban_spans, rule_spans, span_rows, term_spans
from ..operators.redact import decided, redact
from ..session import ship
from ..sources.files import first_claims, output_name, output_suffixes
from ..streaming.watch import latest_versions
from . import spec
from .policy import decide_rows, load_policy

#: For queries over synthetic tables only; a deployment passes its own from a secret store.
DEMO_KEY = bytes(range(32))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _rule(entity: str, name: str) -> spec.Rule:
    return next(r for r in spec.RULES if (r.entity, r.name) == (entity, name))


def _found(df: DataFrame, key: str, rule: spec.Rule) -> DataFrame:
    """key, n, found (sorted values in one text) of rows with a match of the rule."""
    rows = span_rows(df, [rule], key)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("value")), " ").alias("found"))


def _synthetic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made of events: doc, start, end, entity_type, score, detector, validated, all from event_id."""
    e = _read(spark, sf_dir, "events")
    start = (F.col("event_id") * 37) % 2000
    kinds = F.array(*[F.lit(x) for x in ("EMAIL", "PHONE", "ADDRESS", "US_SSN", "PERSON")])
    return e.select(
        F.col("user_id").alias("doc"), start.cast("int").alias("start"), (start + 1 + (F.col("event_id") * 11) % 60).cast("int").alias("end"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("entity_type"),
        (((F.col("event_id") * 13) % 21) / 20).alias("score"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("detector"), (F.col("event_id") % 4 == 0).alias("validated"),
    )


_SPANS = """s as (select user_id as doc, cast((event_id * 37) % 2000 as int) as start, cast((event_id * 37) % 2000 + 1 + (event_id * 11) % 60 as int) as "end",
 ['EMAIL', 'PHONE', 'ADDRESS', 'US_SSN', 'PERSON'][(event_id % 5 + 1)::int] as entity_type, ((event_id * 13) % 21) / 20.0::double as score,
 'd' || (event_id % 3) as detector, event_id % 4 = 0 as validated from events)"""


# --- detectors ----------------------------------------------------------------------------------------


def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_read(spark, sf_dir, "documents"), "doc_id", _rule("EMAIL", "email"))


def email_spans_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_read(spark, sf_dir, "pages").withColumnRenamed("html", "text"), "page_id", _rule("EMAIL", "email"))


def card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spec.Rule("CREDIT_CARD", "run", r"(?<!\d)\d{13,19}(?!\d)", 0.8, check="card", only="[0-9]{13}")
    return _found(_read(spark, sf_dir, "documents"), "doc_id", runs)


def phone_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_read(spark, sf_dir, "documents"), "doc_id", _rule("PHONE", "bare"))


def _orders_text(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


def _nine() -> F.Column:
    return F.lpad(((F.col("o_orderkey") * 7919 + 123_456_789) % 1_000_000_000).cast("string"), 9, "0")


_NINE = "lpad(cast((o_orderkey * 7919 + 123456789) % 1000000000 as varchar), 9, '0')"


def ssn_issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_orders_text(spark, sf_dir, F.concat(F.lit("SSN "), _nine(), F.lit("."))), "o_orderkey", _rule("US_SSN", "bare"))


def ssn_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nine()
    return _found(_orders_text(spark, sf_dir, F.concat_ws("-", F.substring(n, 1, 3), F.substring(n, 4, 2), F.substring(n, 6, 4))), "o_orderkey", _rule("US_SSN", "separated"))


def sin_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_orders_text(spark, sf_dir, F.concat(F.lit("SIN"), _nine())), "o_orderkey", _rule("CA_SIN", "sin"))


def uk_nino(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.element_at(F.split(F.lit("A,B,C,D,E,F"), ","), (F.col("o_orderkey") % 6 + 1).cast("int"))
    text = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "no BG").otherwise("no AB"), F.substring(_nine(), 1, 6), letters, F.lit(" end"))
    return _found(_orders_text(spark, sf_dir, text), "o_orderkey", _rule("UK_NINO", "nino"))


def passport_lettered(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Passport PP CF").otherwise("Deadline "), F.substring(_nine(), 1, 6))
    return _found(_orders_text(spark, sf_dir, text), "o_orderkey", _rule("PASSPORT", "lettered"))


def key_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.upper(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 16))
    df = _read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("key="), F.when(F.col("c_custkey") % 2 == 0, F.lit("AKIA")).otherwise(F.lit("AKIX")), secret).alias("text"))
    return _found(df, "c_custkey", _rule("API_KEY", "aws id"))


def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every GB-shaped number of the right length is found; those with a right checksum are certain."""
    text = F.concat(F.lit("ref GB"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), F.lit("WEST"), F.lpad((F.col("c_custkey") * 104_729 % 100_000_000).cast("string"), 14, "7"))
    one = _read(spark, sf_dir, "customer").select("c_custkey", F.get(F.filter(iban_spans(text), lambda s: s["start"] == 4), F.lit(0)).alias("s"))
    return one.select("c_custkey", "s.start", "s.end", F.round(F.col("s.score") * 100).cast("int").alias("score"), F.col("s.validated"))


def dob_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates count only after a cue word."""
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Date of birth: ").otherwise("Delivery due: "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = _orders_text(spark, sf_dir, text)
    lifted = spans.with_cues(F.col("text"), rule_spans(F.col("text"), _rule("DATE_OF_BIRTH", "y-m-d")))
    return df.select("o_orderkey", F.explode(lifted).alias("s")).select("o_orderkey", "s.start", "s.end", F.round(F.col("s.score") * 100).cast("int").alias("score"), "s.detector")


def company_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with gaps of any kind, without case; a short one only as a whole word."""
    text = F.concat(F.lit("re:"), F.when(F.col("c_custkey") % 2 == 0, "PROJECT bluefinch").otherwise("ProjectBluefinch"), F.lit(" for "), F.when(F.col("c_custkey") % 3 == 0, "Acmeville").otherwise("acme"), F.lit("."))
    df = _read(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return df.select("c_custkey", F.explode(term_spans(F.col("text"), ["Project Bluefinch", "Acme"])).alias("s")).groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("s.start").alias("first"), F.max("s.end").alias("last"))


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line of a table the number of its header line."""
    df = _read(spark, sf_dir, "documents").where(F.col("text").contains("|"))
    tops = df.select("doc_id", F.posexplode(spans.table_headers(F.col("text"))).alias("line", "top"))
    return tops.where("top >= 0")


# --- spans --------------------------------------------------------------------------------------------


def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_rows(_synthetic_spans(spark, sf_dir), "doc").withColumn("score", F.round(F.col("score") * 100).cast("int"))


def dedupe_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedupe_rows(_synthetic_spans(spark, sf_dir), "doc").withColumn("score", F.round(F.col("score") * 100).cast("int"))


def address_gap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.join_address_rows(_synthetic_spans(spark, sf_dir), "doc").withColumn("score", F.round(F.col("score") * 100).cast("int"))


def threshold_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted spans by type and dial under the default policy."""
    policy, s = load_policy(), _synthetic_spans(spark, sf_dir)
    out = None
    for dial in range(1, 6):
        part = decide_rows(s, policy, dial).groupBy("entity_type", "action", F.lit(dial).alias("dial")).agg(F.count("*").alias("n"), F.sum(F.when(~F.col("validated") & (F.round(F.col("score") * 100) < F.round(F.col("threshold") * 100) + 15), 1).otherwise(0)).alias("to_review"))
        out = part if out is None else out.unionByName(part)
    return out


def allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no allowlist entry equals without case."""
    exempt = spark.createDataFrame([(f"CUSTOMER#{i:09d}".casefold(),) for i in range(0, 2_000, 7)], "name string")
    c = _read(spark, sf_dir, "customer").withColumn("name", casefold(F.col("c_name")))
    return c.join(F.broadcast(exempt), "name", "left_anti").select("c_custkey", "c_name")


# --- replacements -------------------------------------------------------------------------------------


def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", C.mask(F.col("text")).alias("masked"))


def strike_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", C.strike(F.col("c_name")).alias("struck"))


def splice_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every email omitted."""
    hits = C.matches(F.col("text"), _rule("EMAIL", "email").java, "@")
    cuts = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit("").alias("sub")))
    return _read(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", C.splice(F.col("text"), cuts).alias("spliced"))


def label_masked_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of emails by source, in reading order."""
    found = span_rows(_read(spark, sf_dir, "documents"), [_rule("EMAIL", "email")], "source", "doc_id")
    values = found.select(F.col("source").alias("scope"), "entity_type", "value", "doc_id", "start")
    numbers, _ = vault.number(values, vault.empty(spark), DEMO_KEY, 0.0)
    return numbers.select("scope", "value", C.label(F.col("entity_type"), F.col("n")).alias("label"))


def remap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose labels stand for customers; labels nobody has stay."""
    names = _read(spark, sf_dir, "customer").select(F.lit("shop").alias("scope"), F.lit("CUST").alias("entity_type"), F.col("c_name").alias("value"), F.col("c_custkey").alias("seq"))
    _, rows = vault.number(names, vault.empty(spark), DEMO_KEY, 0.0)
    text = F.concat(F.lit("to [CUST_"), (F.col("o_custkey") + 1).cast("string"), F.lit("] not [CUST_01]"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.lit("shop").alias("scope"), text.alias("text"))
    out = vault.remap(orders, rows, DEMO_KEY, id_col="o_orderkey")
    return out.select("o_orderkey", "remapped", F.col("labels_seen").cast("long").alias("labels_seen"), F.coalesce(F.col("restored")["CUST"], F.lit(0)).cast("long").alias("restored"))


def vault_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("created_at", F.unix_timestamp("ts").cast("double"))
    now = e.agg(F.max("created_at")).first()[0] or 0.0
    return vault.purge(e, 10, now).groupBy("event_type").agg(F.count("*").alias("kept"))


# --- files and evaluation -----------------------------------------------------------------------------


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in (".txt", ".DOCX", ".pdf", ".jpeg", ".webp")])
    p = _read(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int"))))
    return p.select("p_partkey", F.col("name"), F.explode(output_suffixes(F.col("name"))).alias("suffix")).select("p_partkey", output_name(F.col("name"), F.col("suffix")).alias("output"))


def first_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_claims(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("modificationTime"), "event_id")
    return latest_versions(e).select("path", "event_id")


def recall_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded and removed by two keys with all totals: quality stands for survival here."""
    seeded = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("toxic").cast("string").alias("kind"), (F.col("quality") == 1).alias("survived"))
    return evaluate.recall(seeded, "lang", "kind")


def precision_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.sha2("text", 256).alias("value_digest"))
    return evaluate.precision(d.select("lang", "source", "value_digest"), d.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("lang", "value_digest"), "lang", "source")


# --- without SQL --------------------------------------------------------------------------------------


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine: documents redacted under the default policy, with labels in one scope for each source."""
    done = redact(_read(spark, sf_dir, "documents"), load_policy(), scope_col="source", key=DEMO_KEY)
    return done.texts.select("doc_id", "redacted", F.size("decisions").alias("n_decisions"), F.to_json("entity_counts").alias("entity_counts"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by language and type with all totals."""
    found = decided(_read(spark, sf_dir, "documents"), load_policy()).select("lang", F.explode("decisions").alias("d"))
    return found.rollup("lang", "d.entity_type").agg(F.count("*").alias("n"), F.sum(F.col("d.needs_review").cast("int")).alias("to_review"))


def engine_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on emails of the whole engine, by document."""
    found = decided(_read(spark, sf_dir, "documents"), load_policy()).select("doc_id", F.filter("decisions", lambda d: d["entity_type"] == "EMAIL").alias("d"), "text")
    values = F.array_sort(F.transform("d", lambda d: F.substring("text", d["start"] + 1, d["end"] - d["start"])))
    return found.where(F.size("d") > 0).select("doc_id", F.size("d").cast("long").alias("n"), F.array_join(values, " ").alias("found"))


def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decided(_read(spark, sf_dir, "pages"), load_policy(), text_col="html", site="chatgpt.com")
    return found.select("page_id", F.size("decisions").alias("n_decisions"), F.to_json("entity_counts").alias("entity_counts"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decided(_read(spark, sf_dir, "documents"), load_policy()).where(F.size("decisions") > 0)
    return audit.redaction_events(found, file_type="txt", destination="cli", dial=3).select(F.get_json_object("value", "$.entity_counts").alias("entity_counts"))


def canonical_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(canonicalise(F.col("text"))["clean"]).alias("n"))


def fuzzy_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names with one letter changed, found in their own mention."""
    c = _read(spark, sf_dir, "customer")
    return c.select("c_custkey", fuzzy_contains(F.lower("c_name"), F.concat(F.lit("to "), F.lower(F.regexp_replace("c_name", "m", "n")), F.lit(" only"))).alias("found"))


def hmac_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pads = vault.keys(spark, DEMO_KEY).select("inner", "outer").withColumn("one", F.lit(1))
    c = _read(spark, sf_dir, "customer").withColumn("one", F.lit(1)).join(pads, "one")
    return c.select("c_custkey", C.hmac_sha256(F.col("inner"), F.col("outer"), F.col("c_name")).alias("mac"))


# --- pages of recognised text, chunks, rankings -------------------------------------------------------


def _page_lines(spark: SparkSession, sf_dir: str, text: Column, quad: Column) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", F.expr("event_id div 20").alias("page"), (F.col("event_id") % 20).alias("line"))
    return e.withColumn("text", text).withColumn("quad", quad)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 20 lines, turned by quarters; the sixth line of each reads across the others."""
    slot = (F.col("line") * 7) % 20
    x, y = 100 * (slot % 4) + F.col("line") % 3, 30 * F.floor(slot / 4) + (F.col("event_id") * 13) % 17
    way = (F.col("page") + F.when(F.col("line") == 5, 1).otherwise(0)) % 4
    turned = lambda a, b: F.when(way == 0, geometry.point(a, b)).when(way == 1, geometry.point(-b, a)).when(way == 2, geometry.point(-a, -b)).otherwise(geometry.point(b, -a))
    quad = F.array(turned(x, y), turned(x + 80, y), turned(x + 80, y + 20), turned(x, y + 20))
    return geometry.reading_order(_page_lines(spark, sf_dir, F.lit(""), quad), "page")


def span_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _page_lines(spark, sf_dir, F.repeat(F.lit("x"), ((F.col("event_id") * 7) % 23).cast("int")), F.lit(None))
    start = (F.col("event_id") * 37) % 200
    found = _read(spark, sf_dir, "events").select("event_id", F.expr("event_id div 20").alias("page"), start.alias("start"), (start + F.col("event_id") % 40).alias("end"))
    return geometry.pieces_of_spans(found, lines.select("page", "line", "text"), "page")


def masked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes a page over its upper lines; one has a label."""
    text = F.concat(F.lit("ab cd "), F.col("event_id").cast("string"))
    wide, top = F.length(text) * 10, F.col("line") * 20
    zero = F.lit(0)
    lines = _page_lines(spark, sf_dir, text, F.array(geometry.point(zero, top), geometry.point(wide, top), geometry.point(wide, top + 20), geometry.point(zero, top + 20)))
    left = F.col("box") * 20 + 5 + F.col("page") % 7
    rect = F.array(geometry.point(left, zero), geometry.point(left + 35, zero), geometry.point(left + 35, F.lit(200)), geometry.point(left, F.lit(200)))
    boxes = lines.select("page").distinct().select("page", F.explode(F.array(F.lit(0), F.lit(1))).alias("box")).select("page", "box", rect.alias("quad"), F.when((F.col("page") + F.col("box")) % 2 == 0, "[X_1]").alias("label"))
    return geometry.masked_lines(lines, boxes, "page")


def chunked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of four chunks of 8 bytes and less; of five, one is right and four have a fault each."""
    e = _read(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("request"), (F.col("event_id") % 4).alias("seq"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("m"))
    fault = F.col("request") % 5
    many = F.when((fault == 1) & (F.col("seq") == 2), 7).when(F.col("seq") == 3, 5).otherwise(8)
    data = F.when((fault == 4) & (F.col("seq") == 1), "***").otherwise(F.base64(F.substring("m", F.lit(1), many).cast("binary")))
    sent = e.where((fault != 2) | (F.col("seq") != 3)).select("request", F.when(fault == 3, -F.col("seq")).otherwise(F.col("seq")).alias("arrival"), "seq", F.lit(4).alias("total"), F.lit(29).alias("size"), data.alias("data"))
    return chunks.reassembled(sent, chunk_bytes=8).withColumn("payload", F.col("payload").cast("string"))


def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.timings(_read(spark, sf_dir, "events"), "value", "event_type").withColumn("median", F.round("median", 6))


def newest_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.newest_scopes(_read(spark, sf_dir, "events").withColumn("second", F.unix_timestamp("ts")), "user_id", "second")


ALL = (
    email_spans, email_spans_in_pages, card_luhn, phone_bare, ssn_issued, ssn_separated, sin_luhn, uk_nino, passport_lettered, key_prefixes, iban_mod97, dob_cue, company_terms, header_rows,
    merge_overlaps, dedupe_contained, address_gap_join, threshold_decide, allowlist_anti, mask_text, strike_text, splice_emails, label_masked_emails, remap_labels, vault_purge, output_names, first_claim,
    latest_version, recall_rollup, precision_by_source, redact_documents, entity_counts, engine_emails, redact_pages, audit_lines, canonical_lengths, fuzzy_leak, hmac_lookup,
    reading_order, span_pieces, masked_lines, chunked_requests, timing_stats, newest_scopes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _all_of(table: str, key: str, values: str) -> str:
    return f"with f as (select {key}, {values} as v from {table}) select {key}, len(v) as n, array_to_string(list_sort(v), ' ') as found from f where len(v) > 0"


_EMAIL = r"regexp_extract_all({}, '[\pL\pN_.%+-]+@[\pL\pN_-]+(?:\.[\pL\pN_-]+)+')"
_LUHN = "list_sum(list_transform(range(len({v})), lambda i: case when i % 2 = 1 then case when cast({v}[len({v}) - i] as int) > 4 then cast({v}[len({v}) - i] as int) * 2 - 9 else cast({v}[len({v}) - i] as int) * 2 end else cast({v}[len({v}) - i] as int) end)) % 10 = 0"
_ISSUED = "substr({n}, 1, 3) not in ('000', '666') and substr({n}, 1, 1) <> '9' and substr({n}, 4, 2) <> '00' and substr({n}, 6, 4) <> '0000'"
_RUNS = "regexp_extract_all({}, '[0-9]+')"

_PADS = dict(zip(("inner", "outer"), (bytes(b ^ x for b in subkey(DEMO_KEY, b"vault hmac").ljust(64, b"\0")).hex() for x in (0x36, 0x5C)), strict=True))

SQL = {
    "reading_order": """with recursive l as (select event_id // 20 as page, event_id % 20 as line, 100 * (((event_id % 20) * 7) % 20 % 4) + (event_id % 20) % 3 + 40 as x, 30 * (((event_id % 20) * 7) % 20 // 4) + (event_id * 13) % 17 + 10 as y from events),
 c as (select page, line, case when line = 5 then -y else x end as x, case when line = 5 then x else y end as y from l),
 o as (select *, row_number() over (partition by page order by y, line) as k from c),
 r(page, k, line, x, y, "row", top) as (select page, k, line, x, y, 0, y from o where k = 1 union all
  select o.page, o.k, o.line, o.x, o.y, case when abs(o.y - r.top) < 10 then r."row" else r."row" + 1 end, case when abs(o.y - r.top) < 10 then r.top else o.y end from r join o on o.page = r.page and o.k = r.k + 1)
 select page, line, cast("row" as int) as "row", cast(row_number() over (partition by page order by "row", x, y, line) - 1 as int) as place from r""",
    "span_pieces": """with l as (select event_id // 20 as page, event_id % 20 as line, (event_id * 7) % 23 as n from events),
 a as (select *, coalesce(sum(n + 1) over (partition by page order by line rows between unbounded preceding and 1 preceding), 0) as at from l),
 s as (select event_id, event_id // 20 as page, (event_id * 37) % 200 as start, (event_id * 37) % 200 + event_id % 40 as "end" from events)
 select s.event_id, s.page, s.start, s."end", a.line, cast(greatest(s.start - a.at, 0) as bigint) as "from", cast(least(s."end" - a.at, a.n) as bigint) as "to"
 from s join a on a.page = s.page and s.start < a.at + a.n and s."end" > a.at and s.start < s."end" and a.n > 0""",
    "masked_lines": """with l as (select event_id // 20 as page, event_id % 20 as line, 'ab cd ' || event_id as text from events),
 c as (select page, line, unnest(range(len(text))) as i, unnest(string_split(text, '')) as ch from l),
 b as (select page, box, 20 * box + 5 + page % 7 - 5.25 as x0, 20 * box + 40 + page % 7 + 5.25 as x1, case when (page + box) % 2 = 0 then '[X_1]' end as label from (select distinct page from l), (values (0), (1)) v(box)),
 h as (select c.page, c.line, c.i, c.ch, (select min(box) from b where b.page = c.page and 10 * c.i + 5 between x0 and x1 and 20 * c.line + 10 <= 205.25) as own from c),
 f as (select *, case when ch = ' ' then case when lag(own) over w is not distinct from lead(own) over w then lag(own) over w end else own end as box from h window w as (partition by page, line order by i)),
 n as (select *, sum(case when box is null or box is distinct from was then 1 else 0 end) over (partition by page, line order by i) as run from (select *, lag(box) over (partition by page, line order by i) as was from f)),
 g as (select page, line, run, box, count(*) as n, min(ch) as ch from n group by page, line, run, box)
 select g.page, g.line, string_agg(case when g.box is null then g.ch else coalesce(b.label, repeat('█', g.n)) end, '' order by g.run) as masked from g left join b on b.page = g.page and b.box = g.box group by g.page, g.line""",
    "chunked_requests": """with c as (select event_id // 4 as request, string_agg(substr(md5(cast(event_id as varchar)), 1, case when event_id % 4 = 3 then 5 else 8 end), '' order by event_id) as whole from events group by 1)
 select request, case request % 5 when 0 then 'complete' when 2 then 'incomplete' when 4 then 'bad_message' else 'bad_sequence' end as state, case when request % 5 = 0 then whole end as payload from c""",
    "timing_stats": "select event_type, round(median(value), 6) as median, min(value) as least, max(value) as most, count(value) as runs from events group by event_type",
    "newest_scopes": "select user_id, max(cast(floor(epoch(ts)) as bigint)) as last_use from events where user_id is not null group by user_id order by last_use desc, user_id limit 5000",
    "engine_emails": _all_of("documents", "doc_id", _EMAIL.format("text")),
    "hmac_lookup": f"select c_custkey, sha256(unhex('{_PADS['outer']}') || unhex(sha256(unhex('{_PADS['inner']}') || encode(c_name)))) as mac from customer",
    "fuzzy_leak": "select c_custkey, levenshtein(lower(c_name), lower(regexp_replace(c_name, 'm', 'n'))) <= 1 as found from customer",
    "email_spans": _all_of("documents", "doc_id", _EMAIL.format("text")),
    "email_spans_in_pages": _all_of("pages", "page_id", _EMAIL.format("html")),
    "card_luhn": _all_of("documents", "doc_id", f"list_filter({_RUNS.format('text')}, lambda x: len(x) between 13 and 19 and {_LUHN.format(v='x')})"),
    "phone_bare": _all_of("documents", "doc_id", r"list_filter(regexp_extract_all(text, '\+?[0-9]+'), lambda x: x[1] <> '+' and len(x) between 10 and 11)"),
    "ssn_issued": f"select o_orderkey, 1::bigint as n, d as found from (select o_orderkey, {_NINE} d from orders) where {_ISSUED.format(n='d')}",
    "ssn_separated": f"select o_orderkey, 1::bigint as n, substr(d, 1, 3) || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 4) as found from (select o_orderkey, {_NINE} d from orders) where {_ISSUED.format(n='d')}",
    "sin_luhn": f"select o_orderkey, 1::bigint as n, d as found from (select o_orderkey, {_NINE} d from orders) where substr(d, 1, 1) not in ('0', '8') and {_LUHN.format(v='d')}",
    "uk_nino": f"select o_orderkey, 1::bigint as n, 'AB' || substr({_NINE}, 1, 6) || ['A', 'B', 'C', 'D'][(o_orderkey % 6 + 1)::int] as found from orders where o_orderkey % 5 <> 0 and o_orderkey % 6 < 4",
    "passport_lettered": f"select o_orderkey, 1::bigint as n, 'CF' || substr({_NINE}, 1, 6) as found from orders where o_orderkey % 2 = 0",
    "key_prefixes": "select c_custkey, 1::bigint as n, 'AKIA' || upper(substr(md5(cast(c_custkey as varchar)), 1, 16)) as found from customer where c_custkey % 2 = 0",
    "iban_mod97": """with t as (select c_custkey, 'WEST' || lpad(cast(c_custkey * 104729 % 100000000 as varchar), 14, '7') || 'GB' || lpad(cast(c_custkey % 97 + 2 as varchar), 2, '0') as turned from customer),
 m as (select c_custkey, list_reduce(list_prepend(0, list_transform(string_split(turned, ''), lambda c: case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end)),
  lambda a, d: (case when d > 9 then a * 100 else a * 10 end + d) % 97) = 1 as validated from t)
 select c_custkey, 4 as start, 26 as "end", case when validated then 100 else 60 end as score, validated from m""",
    "dob_cue": "select o_orderkey, case when o_orderkey % 2 = 0 then 15 else 14 end as start, case when o_orderkey % 2 = 0 then 25 else 24 end as \"end\", case when o_orderkey % 2 = 0 then 85 else 15 end as score, case when o_orderkey % 2 = 0 then 'date_of_birth_pattern.context' else 'date_of_birth_pattern' end as detector from orders",
    "company_terms": "select c_custkey, case when c_custkey % 3 = 0 then 1 else 2 end::bigint as n, 3 as first, case when c_custkey % 3 = 0 then 0 else 9 end + case when c_custkey % 2 = 0 then 20 else 19 end as last from customer",
    "header_rows": """with l as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as body from documents where contains(text, '|')),
 m as (select *, contains(body, '|') as is_row, coalesce(not lag(contains(body, '|')) over (partition by doc_id order by line), true) as fresh from l)
 select doc_id, line::int as line, (max(case when is_row and fresh then line end) over (partition by doc_id order by line))::int as top from m qualify is_row""",
    "merge_overlaps": f"""with {_SPANS}, a as (select *, max("end") over (partition by doc order by start, "end", entity_type, detector, score, validated rows between unbounded preceding and 1 preceding) as b from s),
 g as (select *, sum(case when b is null or start >= b then 1 else 0 end) over (partition by doc order by start, "end", entity_type, detector, score, validated rows between unbounded preceding and current row) as island from a),
 r as (select *, row_number() over (partition by doc, island order by "end" - start desc, validated desc, score desc, entity_type desc, detector desc) as rn from g),
 u as (select doc, island, min(start) as start, max("end") as "end" from g group by doc, island)
 select u.doc, u.start, u."end", r.entity_type, cast(round(r.score * 100) as int) as score, r.detector, r.validated from u join r on u.doc = r.doc and u.island = r.island and r.rn = 1""",
    "dedupe_contained": f"""with {_SPANS}, p as (select distinct * from s where score > 0)
 select doc, start, "end", entity_type, cast(round(score * 100) as int) as score, detector, validated from p x where not exists (select 1 from p r where r.doc = x.doc and r.entity_type = x.entity_type and r.start <= x.start and r."end" >= x."end"
  and (r.score > x.score or (r.score = x.score and (r.start < x.start or (r.start = x.start and (r."end" > x."end" or (r."end" = x."end" and r.detector < x.detector)))))))""",
    "address_gap_join": f"""with {_SPANS}, n as (select *, lead(start) over w as ns, lead("end") over w as ne, lead(score) over w as nscore from s where entity_type = 'ADDRESS' window w as (partition by doc order by start, "end", detector))
 select doc, start, ne as "end", entity_type, cast(round(greatest(score, nscore) * 100) as int) as score, 'address.join' as detector, false as validated from n where ns - "end" > 0 and ns - "end" <= 40""",
    "threshold_decide": f"""with {_SPANS}, p(entity_type, action, locked, contact, model) as (values ('EMAIL', 'pseudonymize', false, 5, 0), ('PHONE', 'mask', false, 5, 0), ('ADDRESS', 'pseudonymize', false, 5, 15), ('US_SSN', 'mask', true, 0, 0), ('PERSON', 'pseudonymize', false, 0, 15)),
 d(dial, base) as (values (1, 90), (2, 80), (3, 65), (4, 50), (5, 35)),
 t as (select *, case when locked then 35 when model > 0 then greatest(30, base - contact - model) else base - contact end as limit_ from p, d)
 select s.entity_type, t.action, t.dial, count(*) as n, cast(sum(case when not validated and round(score * 100) < limit_ + 15 then 1 else 0 end) as bigint) as to_review from s join t on s.entity_type = t.entity_type where (locked and validated) or round(score * 100) >= limit_ group by all""",
    "allowlist_anti": "select c_custkey, c_name from customer where not (cast(substr(c_name, 10) as int) % 7 = 0 and cast(substr(c_name, 10) as int) < 2000)",
    "mask_text": r"select conv_id, turn, regexp_replace(text, '[\pL\pN]', '*', 'g') as masked from conversations",
    "strike_text": "select c_custkey, repeat('█', len(c_name)) as struck from customer",
    "splice_emails": r"select doc_id, regexp_replace(text, '[\pL\pN_.%+-]+@[\pL\pN_-]+(?:\.[\pL\pN_-]+)+', '', 'g') as spliced from documents where contains(text, '@')",
    "label_masked_emails": f"""with e as (select source, doc_id, {_EMAIL.format("text")} as v from documents), u as (select source, doc_id, unnest(range(len(v))) as i, unnest(v) as value from e),
 f as (select source, lower(value) as same, min(doc_id * 1000000 + i) as first from u group by all), r as (select *, row_number() over (partition by source order by first) as n from f)
 select distinct u.source as scope, u.value, '[EMAIL_' || r.n || ']' as label from u join r on u.source = r.source and lower(u.value) = r.same""",
    "remap_labels": """with v as (select row_number() over (order by c_custkey) as n, c_name from customer)
 select o_orderkey, 'to ' || coalesce(v.c_name, '[CUST_' || (o_custkey + 1) || ']') || ' not [CUST_01]' as remapped, 1::bigint as labels_seen, case when v.n is null then 0 else 1 end::bigint as restored from orders left join v on v.n = o_custkey + 1""",
    "vault_purge": "select event_type, count(*) as kept from events where floor(epoch(ts)) >= (select max(floor(epoch(ts))) from events) - 10 * 86400 group by event_type",
    "output_names": """select p_partkey, unnest(case p_partkey % 5 when 0 then ['f' || p_partkey || '.txt'] when 1 then ['f' || p_partkey || '.DOCX.md'] when 2 then ['f' || p_partkey || '.pdf', 'f' || p_partkey || '.pdf.md'] when 3 then ['f' || p_partkey || '.jpeg'] else ['f' || p_partkey || '.webp.png'] end) as output from part""",
    "first_claim": "select p_partkey, p_brand from part qualify row_number() over (partition by lower(p_brand) order by p_partkey) = 1",
    "latest_version": "select cast(user_id as varchar) as path, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "recall_rollup": "select lang, cast(toxic as varchar) as kind, count(*) as seeded, cast(sum(case when quality = 1 then 0 else 1 end) as bigint) as removed from labels join documents using (doc_id) group by rollup (lang, kind)",
    "precision_by_source": """with d as (select lang, source, doc_id, sha256(text) as h from documents), k as (select distinct lang, h from d where doc_id in (select doc_id from labels))
 select d.source, count(k.h) as true_positive, count(*) as redacted, round(count(k.h) / count(*), 4) as precision from d left join k on d.lang = k.lang and d.h = k.h group by d.source""",
}
