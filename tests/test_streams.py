"""Streams: counters keep their numbers over batches, files are redacted once."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.redact import redact, without_labels
from cloakframe.plans.policy import load_policy
from cloakframe.streaming import watch


def test_counters_over_batches(spark, tmp_path):
    schema = "scope string, entity_type string, seq long, value string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([("c", "EMAIL", 2, "x@y.z"), ("c", "EMAIL", 1, "a@b.c")])
    got = []
    for more in ([], [("c", "EMAIL", 3, "A@B.C"), ("c", "EMAIL", 4, "n@n.n"), ("d", "EMAIL", 1, "n@n.n")]):
        if more:
            write(more)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = watch.number_stream(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["scope"], r["value"]): r["n"] for r in got} == {("c", "a@b.c"): 1, ("c", "x@y.z"): 2, ("c", "A@B.C"): 1, ("c", "n@n.n"): 3, ("d", "n@n.n"): 1}


def test_files_are_redacted_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("SSN 123-45-6789 mail a@b.de", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff mail a@b.de")
    seen = []
    for _ in range(2):
        texts = watch.texts_of(watch.files(spark, str(tmp_path / "in")))
        q = watch.redact_stream(texts, load_policy(), lambda df, n: seen.extend(df.withColumn("name", F.element_at(F.split("path", "/"), -1)).collect()), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {r["name"]: (r["redacted"], r["failed"]) for r in seen} == {"a.txt": ("SSN ***-**-**** mail ██████", None), "b.txt": (None, "not UTF-8")} and len(seen) == 2
    assert "6789" not in str(seen) and "a@b" not in str(seen)


def test_a_text_that_fails_does_not_stop_the_others(spark):
    """A model that gives nonsense for one text: that text is withheld with a reason, or stops the query where asked to."""
    df = spark.createDataFrame([(1, "a@b.de"), (2, "bad a@b.de")], "doc_id int, text string")
    broken = lambda c: F.when(c.startswith("bad"), F.expr("array(named_struct('start', 0, 'end', 3, 'entity_type', 'EMAIL', 'score', cast(null as double), 'detector', 'x', 'validated', true))"))
    policy = without_labels(load_policy())
    got = {r["doc_id"]: (r["redacted"], r["failed"]) for r in redact(df, policy, go_on=True, model=broken).texts.collect()}
    assert got == {1: ("██████", None), 2: (None, "TypeError")}
    with pytest.raises(Exception):
        redact(df, policy, model=broken).texts.collect()


def test_expiry_deletes_only_unchanged_old_copies(spark, tmp_path):
    rows = []
    for name in ("old", "new", "changed"):
        f = tmp_path / name
        f.write_text("x")
        st = os.lstat(f)
        rows.append((str(f), time.time() - (0 if name == "new" else 90 * 86_400), st.st_dev, st.st_ino, st.st_size, st.st_mtime_ns))
    (tmp_path / "changed").write_text("other")
    rows.append((str(tmp_path / "gone"), 0.0, 1, 1, 1, 1))
    copies = spark.createDataFrame(rows, "path string, written double, dev long, ino long, size long, mtime_ns long")
    assert watch.expire_copies(copies, 30, time.time()) == {"purged": 1, "dropped": 2, "kept": 1}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["changed", "new"]
