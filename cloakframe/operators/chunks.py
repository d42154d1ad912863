"""Payloads that arrive in numbered chunks, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes in a full chunk, and in the largest payload.
CHUNK_BYTES, MOST_BYTES = 393_216, 67_108_864


def reassembled(chunks: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """chunks(request, arrival, seq, total, size, data in base64) -> request, state, payload.

    A request is `complete` when chunks 0 to total - 1 came in order, each of chunk_bytes but the last, which has the rest of
    `size`. It is `incomplete` while all that came is right and some is missing. A chunk out of order or after the last, of
    another length, total or size than its request's first one said, or a size beyond most_bytes make it `bad_sequence`; data
    that is no base64 `bad_message`. Only complete requests have a payload. A request is bounded by most_bytes, so one group
    is, whatever the number of requests; what exceeds that is left out before anything is gathered. Null requests are left out.
    """
    rows = chunks.where("request is not null").select("request", "arrival", "seq", "total", "size", F.expr("try_to_binary(data, 'base64')").alias("raw"))
    want = F.least(F.lit(chunk_bytes), F.col("size") - F.col("seq") * chunk_bytes)
    wrong = (F.col("size") < 0) | (F.col("size") > most_bytes) | (F.col("seq") < 0) | (F.col("seq") >= F.col("total")) | (F.col("total") != F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes))) | (F.octet_length("raw") != want)
    known = F.col("seq").isNotNull() & F.col("total").isNotNull() & F.col("size").isNotNull()
    rows = rows.withColumns({"wrong": ~known | F.coalesce(wrong, F.lit(False)), "unread": F.col("raw").isNull()})
    order = F.array_sort(F.collect_list(F.struct("arrival", "seq")))
    told = rows.groupBy("request").agg(
        F.max("wrong").alias("wrong"), F.max("unread").alias("unread"), F.count("*").alias("n"), F.count_distinct("seq").alias("own"), F.min("total").alias("total"),
        ((F.min("total") != F.max("total")) | (F.min("size") != F.max("size"))).alias("mixed"),
    )
    right = told.where("not wrong and not unread and not mixed and n = own").select("request", "total")
    parts = rows.join(right, ["request", "total"]).groupBy("request").agg(order.alias("came"), F.array_sort(F.collect_list(F.struct("seq", "raw"))).alias("parts"))
    in_order = F.forall(F.transform("came", lambda c, i: c["seq"] == i), lambda x: x)
    payload = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["raw"]))
    whole = parts.select("request", in_order.alias("in_order"), F.when(in_order, payload).alias("payload"))
    bad = F.col("wrong") | F.col("mixed") | (F.col("n") != F.col("own")) | ~F.coalesce("in_order", F.lit(True))
    state = F.when(F.col("unread"), "bad_message").when(bad, "bad_sequence").when(F.col("n") < F.col("total"), "incomplete").otherwise("complete")
    return told.join(whole, "request", "left").select("request", state.alias("state"), "payload").withColumn("payload", F.when(F.col("state") == "complete", F.col("payload")))
