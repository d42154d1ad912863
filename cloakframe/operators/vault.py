"""Pseudonyms: one number for each value of a scope and type, kept in an encrypted vault table.

The vault is a DataFrame (scope_id, entity_type, n, lookup, ciphertext, created_at) of no readable value: scopes and
values are looked up by HMAC, values are AES-GCM encrypted and bound to their row. Keys are derived on the driver and
reach executors in a broadcast one-row relation, never as literals of a plan.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.unicode import identities, subkey
from ..session import ship, written

SCHEMA = "scope_id string, entity_type string, n int, lookup string, ciphertext binary, created_at double"
LABEL = r"\[([A-Z](?:[A-Z_]{0,30}[A-Z])?)_([1-9][0-9]{0,8})\]"


class VaultError(ValueError):
    pass


def keys(spark: SparkSession, key: bytes) -> DataFrame:
    """One row: aes, inner and outer (the HMAC key's pads)."""
    if len(key) != 32:
        raise VaultError("vault key must be 32 bytes")
    mac = subkey(key, b"vault hmac").ljust(64, b"\0")
    row = (subkey(key, b"vault aes"), bytes(b ^ 0x36 for b in mac), bytes(b ^ 0x5C for b in mac))
    return F.broadcast(spark.createDataFrame([tuple(map(bytearray, row))], "aes binary, inner binary, outer binary"))


def _with_keys(df: DataFrame, key: bytes) -> DataFrame:
    return df.withColumn("_one", F.lit(1)).join(keys(df.sparkSession, key).withColumn("_one", F.lit(1)), "_one").drop("_one")


def _mac(message: Column) -> Column:
    return C.hmac_sha256(F.col("inner"), F.col("outer"), message)


def _row_id() -> Column:
    return F.concat_ws("|", "scope_id", "entity_type", F.col("n").cast("string"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def number(values: DataFrame, vault: DataFrame, key: bytes, now: float) -> tuple[DataFrame, DataFrame]:
    """values(scope, entity_type, value, seq...): the columns after value order first sights. Gives the distinct
    (scope, entity_type, value, n) and the new vault rows. Known values keep their number; new ones follow the largest,
    in the order they were first seen. The value first seen is what the vault keeps."""
    ship(values.sparkSession)
    order = F.struct(*[F.col(c) for c in values.columns if c not in ("scope", "entity_type", "value")])
    firsts = values.groupBy("scope", "entity_type", "value").agg(F.min(order).alias("first"))
    named = _with_keys(firsts.withColumn("same", identities(F.col("value"))), key)
    named = named.withColumns({"scope_id": _mac(F.col("scope")), "lookup": _mac(F.concat_ws("|", "scope", "entity_type", "same"))}).drop("same", "inner", "outer")
    entries = named.groupBy("scope_id", "entity_type", "lookup").agg(F.min("first").alias("first"), F.min_by("value", "first").alias("value"), F.first("aes").alias("aes"))
    known = vault.select("scope_id", "entity_type", "lookup", "n")
    largest = vault.groupBy("scope_id", "entity_type").agg(F.max("n").alias("top"))
    fresh = entries.join(known, ["scope_id", "entity_type", "lookup"], "left_anti").join(largest, ["scope_id", "entity_type"], "left")
    fresh = _ranked(fresh).withColumn("n", (F.coalesce("top", F.lit(0)) + F.col("rank")).cast("int"))
    sealed = F.aes_encrypt(F.col("value").cast("binary"), F.col("aes"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _row_id().cast("binary"))
    rows = fresh.select("scope_id", "entity_type", "n", "lookup", sealed.alias("ciphertext"), F.lit(float(now)).alias("created_at"))
    numbers = known.unionByName(fresh.select("scope_id", "entity_type", "lookup", "n"))
    return named.join(numbers, ["scope_id", "entity_type", "lookup"]).select("scope", "entity_type", "value", "n"), rows


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rank: the place in (scope_id, entity_type) by `first`. Rows are dealt by ranges and numbered within them; what
    earlier ranges hold of a group is added, so that no task has a whole group."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, "scope_id", "entity_type", "first").withColumn("part", F.spark_partition_id()), "vault")
    group = ["scope_id", "entity_type"]
    counts = dealt.groupBy(*group, "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*group, "part").orderBy("first"))
    return dealt.withColumn("own", own).join(counts, [*group, "part"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "part")


def reveal(wanted: DataFrame, vault: DataFrame, key: bytes) -> DataFrame:
    """wanted(scope, entity_type, n) with value: null for labels the vault doesn't hold; a row that was tampered with fails."""
    asked = _with_keys(wanted.select("scope", "entity_type", "n").distinct(), key).withColumn("scope_id", _mac(F.col("scope")))
    held = asked.join(vault.select("scope_id", "entity_type", "n", "ciphertext"), ["scope_id", "entity_type", "n"], "left")
    opened = F.aes_decrypt("ciphertext", F.col("aes"), F.lit("GCM"), F.lit("DEFAULT"), _row_id().cast("binary"))
    return held.select("scope", "entity_type", "n", F.when(F.col("ciphertext").isNotNull(), opened.cast("string")).alias("value"))


def remap(texts: DataFrame, vault: DataFrame, key: bytes, *, id_col: str, text_col: str = "text", scope_col: str = "scope") -> DataFrame:
    """texts with `remapped`: labels of the row's own scope replaced by their values, others left; labels_seen, restored (counts by type)."""
    hits = C.matches(F.col(text_col), LABEL, r"\[[A-Z]")
    own = written(texts.withColumns({"cf_row": F.monotonically_increasing_id(), "cf_hits": hits}), "remap")
    each = own.select("cf_row", F.coalesce(F.col(scope_col).cast("string"), F.lit("\x00")).alias("scope"), F.explode("cf_hits").alias("h"))
    parts = each.select("cf_row", "scope", "h.start", "h.end", F.regexp_extract("h.value", LABEL, 1).alias("entity_type"), F.regexp_extract("h.value", LABEL, 2).cast("int").alias("n"))
    real = parts.join(reveal(parts, vault, key), ["scope", "entity_type", "n"]).where("value is not null")
    cuts = real.groupBy("cf_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("value").alias("sub")))).alias("cf_cuts"), F.array_sort(F.collect_list("entity_type")).alias("cf_types"))
    out = own.join(cuts, "cf_row", "left")
    restored = F.map_from_entries(F.transform(F.array_distinct("cf_types"), lambda t: F.struct(t, F.size(F.filter("cf_types", lambda x: x == t)))))
    remapped = F.when(F.col("cf_cuts").isNull(), F.col(text_col)).otherwise(C.splice(F.col(text_col), F.col("cf_cuts")))
    return out.withColumns({"remapped": remapped, "labels_seen": F.coalesce(F.size("cf_hits"), F.lit(0)), "restored": restored}).drop("cf_row", "cf_hits", "cf_cuts", "cf_types")


def purge(vault: DataFrame, retention_days: int, now: float) -> DataFrame:
    """The rows that stay: none older than the retention."""
    return vault.where(F.col("created_at") >= now - retention_days * 86_400)


def hmac_hex(key: bytes, message: str) -> str:
    """The vault's HMAC of a text, on the driver."""
    return hmac.new(subkey(key, b"vault hmac"), message.encode("utf-8"), hashlib.sha256).hexdigest()


def newest_scopes(uses: DataFrame, scope_col: str, at_col: str, most: int = 5_000) -> DataFrame:
    """The scopes used last, `most` of them: those are remembered and older ones forgotten. Ties go to the smaller scope."""
    return uses.where(F.col(scope_col).isNotNull()).groupBy(scope_col).agg(F.max(at_col).alias("last_use")).orderBy(F.desc("last_use"), scope_col).limit(most)
