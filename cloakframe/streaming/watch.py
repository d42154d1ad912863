"""Streams: redacting files as they arrive, pseudonym counters as keyed state, retention of copies."""

from __future__ import annotations

import stat
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.unicode import identity
from ..operators.redact import redact, without_labels
from ..plans.policy import Policy
from ..session import ship

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, inbox: str, per_batch: int = 1_000) -> DataFrame:
    """Files of a folder, top level only. The source's own log takes each version (path and time) once, without state that grows
    in memory. Files must be renamed into the folder when they are whole."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "false").load(inbox)


def texts_of(found: DataFrame) -> DataFrame:
    """path, text, failed of files: a file that isn't UTF-8, or whose size isn't the one it was listed with (it was changed or
    swapped meanwhile), has no text but a reason."""
    body = F.col("content").cast("string")
    reason = F.when(F.length("content") != F.col("length"), "changed").when(~F.is_valid_utf8(body), "not UTF-8")
    return found.select("path", F.when(reason.isNull(), F.regexp_replace(body, "\r\n?", "\n")).alias("text"), reason.alias("failed"))


def redact_stream(texts: DataFrame, policy: Policy, write: Callable[[DataFrame, int], None], checkpoint: str, *, text_col: str = "text", once: bool = True) -> StreamingQuery:
    """Redacts a stream of texts batch by batch; the checkpoint keeps what is done over restarts. `write` gets the rows without
    their text, with `redacted`, decisions, entity_counts and failed. Labels need a vault, so values that the policy would
    number are struck out. A text that fails has a null `redacted` and a reason, and the others go on; so has one that came
    with a reason."""
    own = without_labels(policy)

    def batch(df: DataFrame, n: int) -> None:
        early = "failed" in df.columns
        done = redact(df.withColumnRenamed("failed", "cf_early") if early else df, own, text_col=text_col, go_on=True).texts
        failed = F.coalesce("cf_early", "failed") if early else F.col("failed")
        write(done.withColumns({"failed": failed, "redacted": F.when(failed.isNull(), F.col("redacted"))}).drop(text_col, "cf_early"), n)

    writer = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def number_stream(values: DataFrame) -> DataFrame:
    """values(scope, entity_type, seq, value) of a stream with n: each scope and type counts its values in the order of
    first sight, over all batches. One state a (scope, type); a batch's values are put in order of seq first."""
    ship(values.sparkSession)

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        numbers = [known.setdefault(identity(v), len(known) + 1) for v in rows["value"]]
        state.update((list(known), list(known.values())))
        yield rows.assign(n=numbers)[["scope", "entity_type", "seq", "value", "n"]]

    return values.groupBy("scope", "entity_type").applyInPandasWithState(
        count, "scope string, entity_type string, seq long, value string, n int", "names array<string>, numbers array<int>", "append", GroupStateTimeout.NoTimeout
    )


def latest_versions(seen: DataFrame) -> DataFrame:
    """The newest version of each path, by an aggregate."""
    cols = [c for c in seen.columns if c not in ("path", "modificationTime")]
    best = seen.groupBy("path").agg(F.max(F.struct("modificationTime", *cols)).alias("v"))
    return best.select("path", "v.*")


def expire_copies(copies: DataFrame, retention_days: int, now: float, inbox: str | None = None) -> dict[str, int]:
    """Deletes recorded copies older than the retention that are still as they were written: regular files with the same
    identity, outside the inbox. Counts of purged, dropped and kept. Runs on the driver, which owns the folder."""
    counts = {"purged": 0, "dropped": 0, "kept": 0}
    cutoff = now - retention_days * 86_400
    for r in copies.toLocalIterator():
        counts[_expire(r, cutoff, inbox)] += 1
    return counts


def _expire(copy: Row, cutoff: float, inbox: str | None) -> str:
    """What becomes of one recorded copy. Only the very file that was written is ever deleted, and none from the inbox, whose
    files are inputs; a file that can't be looked at or removed now is kept for the next time."""
    where = Path(copy["path"])
    identity = {"st_dev": "dev", "st_ino": "ino", "st_size": "size", "st_mtime_ns": "mtime_ns"}
    try:
        seen = where.lstat()
        ours = stat.S_ISREG(seen.st_mode) and all(getattr(seen, a) == copy[b] for a, b in identity.items())
        if not ours or inbox and where.parent.resolve() == Path(inbox).resolve():
            return "dropped"
        if copy["written"] < cutoff:
            where.unlink()
            return "purged"
    except FileNotFoundError:
        return "dropped"
    except OSError:
        pass
    return "kept"
