"""WARC archives, index first.

Writing gives, for every record, one row of an index: archive, offset, length, URL, digest and the
rest of what a selection needs; the index is written beside the archives before anything is read.
Reading starts from index rows, all or selected: they are dealt by ranges of (archive, offset),
sorted, neighbouring byte ranges are coalesced to one read, and each record is inflated from its
slice, parsed, and checked against its digest.

Of records with equal payloads of at least `min_revisit` bytes that with the largest id is the
response and the others revisit it. Records are gzip members of their own. A file is named by the
task attempt that wrote it, and only the committed attempt's rows are in the index, so that lost or
repeated tasks leave nothing wrong behind.

Defined results: a null payload is empty; a null URL is left out of the header; characters that a header
can't hold are percent-encoded; rows that repeat the id and payload of the response are responses
too; a row with a null id is never referred to, and revisits only a response with an id; other columns
are left out; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archive_files import Folder
from .common import parallelism, shared_dir, ship, text_of

MIN_REVISIT = 1_000
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(chr(c) for c in range(33, 127))


def record_id(key: str, digest_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest_hex}')}>"


def build_record(key: str | None, url: str | None, payload: bytes, digest_hex: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the record with id refers_to and the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(str(key), digest_hex)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}")
    if key is not None:
        head.append(f"X-Page-Id: {key}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest_hex)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload: what follows the HTTP header of the block."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its content")
    return headers, rest[:n].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives to `folder` and its index to `folder`/index; gives the index read back."""
    spark = ship(pages.sparkSession)
    body = text_of(payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("digest"))
    # The hot digests of a skewed table are split by the join itself; small payloads need no partner and are dealt by id.
    rows = rows.withColumn("meet", F.when(F.col("bytes") >= min_revisit, F.col("digest")).otherwise(F.concat_ws(":", F.lit("own"), F.col("id").cast("string"), F.col("url"))))
    winners = pages.select(F.col(id_col).alias("id"), body.alias("body")).where(F.octet_length("body") >= min_revisit).groupBy(F.sha1(F.col("body").cast("binary")).alias("meet")).agg(F.max("id").alias("winner"))
    joined = rows.join(winners, "meet", "left").select("id", "url", "body", "bytes", "digest", F.when(~F.col("winner").eqNullSafe(F.col("id")), F.col("winner")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, parts, index, size, n = TaskContext.get(), Folder(folder), [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal parts, index, size, n
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:04d}.warc.gz"
            out.write(name, b"".join(parts))
            cols = list(zip(*index, strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)] + [pa.array([name] * len(index))], names=["id", "url", "digest", "bytes", "refers_to", "offset", "length", "archive"])
            parts, index, size, n = [], [], 0, n + 1
            return made

        for batch in batches:
            kinds = [batch.column(0).type, pa.string(), pa.string(), pa.int64(), batch.column(0).type, pa.int64(), pa.int64()]
            for key, url, text, nbytes, digest, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = _gzip(build_record(None if key is None else str(key), url, text.encode("utf-8"), digest, None if ref is None else str(ref)))
                parts.append(record)
                index.append((key, url, digest, nbytes, ref, size, len(record)))
                size += len(record)
                if size >= archive_bytes:
                    yield close()
        if parts:
            yield close()

    kind = joined.schema["id"].dataType.simpleString()
    index = joined.mapInArrow(write, f"id {kind}, url string, digest string, bytes long, refers_to {kind}, offset long, length long, archive string")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def coalesced(places: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (archive, offset, length) -> reads (archive, from, to, indices of what they hold)."""
    run: list[int] = []
    for i, (name, offset, length) in enumerate(places):
        if run:
            last, start = places[run[-1]], places[run[0]][1]
            if last[0] != name or offset - (last[1] + last[2]) > gap or offset + length - start > most:
                yield last[0], start, last[1] + last[2], run
                run = []
        run.append(i)
    if run:
        last = places[run[-1]]
        yield last[0], places[run[0]][1], last[1] + last[2], run


def read_records(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """Per index row what its record holds: id, payload_bytes, payload_digest, record_type, refers_to, url and, with
    with_payload, payload (null for revisits). Fails on a record that doesn't match its digest."""
    spark = ship(index.sparkSession)
    kind = index.schema["id"].dataType.simpleString()
    dealt = index.select("archive", "offset", "length").repartitionByRange(parallelism(spark), "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(folder)
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for name, start, end, held in coalesced(places):
                data, out = files.read_at(name, start, end - start), []
                for i in held:
                    _, offset, length = places[i]
                    headers, payload = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't match its digest")
                    out.append((headers.get("x-page-id"), int(headers["x-payload-length"]) if revisit else len(payload), digest, headers["warc-type"], headers.get("x-refers-to-page"), headers.get("warc-target-uri"), payload if with_payload and not revisit else None))
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()][: 6 + with_payload]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: len(types)])

    found = dealt.mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string" + ", payload binary" * with_payload)
    return found.withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def archive_and_read(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all pages to archives in the shared folder and reads every record back through the index."""
    folder = shared_dir(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col=id_col, url_col=url_col, payload_col=payload_col)
    return read_records(index, folder).select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
