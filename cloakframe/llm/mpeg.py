"""MPEG audio columns: building, parsing and resynchronising streams of frames.

`parse` walks a stream as a player would: it skips an ID3v2 tag and an ID3v1 tag, reads Xing, Info
and VBRI tables, takes a frame header only if the next header, where this one's length leads, agrees
with it (or the stream ends there), and otherwise searches for the next header byte by byte. The
checksum of every protected frame is verified; a frame that fails it is counted and its data not
used. Durations are exact: a count of samples over the sampling rate. Seek offsets are the byte
positions of all frames.

`wrap` stores bytes losslessly as a stream: payload in the data part of Layer III frames that decode
to silence, with CRC, a Xing table with a seek table in front, an ID3v2 tag that holds the payload's
length, and an ID3v1 tag at the end. The last frame is as short as a bitrate allows.

Defined results: a null text is empty; payloads are padded with zero bytes to a positive multiple of
64; repeated rows get equal values; other columns are left out; an empty table gives an empty table.
A stream without any frame parses to no frames, no samples and no data.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

# Fixed values of ISO/IEC 11172-3 and 13818-3: kilobits by (MPEG 1 or not, layer), samples a second by version.
KILOBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
CRC_POLYNOMIAL, CRC_START = 0x8005, 0xFFFF


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ CRC_POLYNOMIAL if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


@lru_cache(maxsize=65_536)
def crc16(data: bytes) -> int:
    table, c = _crc_table(), CRC_START
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ table[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kilobits: int
    rate: int
    length: int
    samples: int
    mono: bool

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate


@lru_cache(maxsize=65_536)
def header(four: bytes) -> Header | None:
    """A frame header, or None if the bytes aren't one. Free-format frames, whose length isn't stated, count as none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    one, pad = version == 3, four[2] >> 1 & 1
    kilobits, rate = KILOBITS[one, layer][bits], RATES[version][rate]
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1_152
    length = (12_000 * kilobits // rate + pad) * 4 if layer == 1 else samples // 8 * 1_000 * kilobits // rate + pad
    return Header(version, layer, not four[1] & 1, kilobits, rate, length, samples, four[3] >> 6 == 3)


@dataclass
class Stream:
    """What parse() found."""

    kind: str = ""
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    kilobits: set[int] = field(default_factory=set)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    toc: bytes = b""
    data: bytes = b""

    @property
    def duration(self) -> str:
        """Exact seconds as a fraction in lowest terms."""
        if not self.rate:
            return "0/1"
        d = gcd(self.samples, self.rate) or 1
        return f"{self.samples // d}/{self.rate // d}"

    def feature(self) -> str:
        seek = zlib.crc32(struct.pack(f"<{len(self.offsets)}I", *self.offsets))
        return (
            f"mpeg{self.kind};rate={self.rate};frames={len(self.offsets)};samples={self.samples};seconds={self.duration};kbps={'/'.join(map(str, sorted(self.kilobits)))};"
            f"crc={self.crc_good}+{self.crc_bad};skipped={self.skipped};table={self.table.get('frames', -1)}/{self.table.get('bytes', -1)};toc={zlib.crc32(self.toc):08x};seek={seek:08x}"
        )


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """End of the ID3v2 tag at the start, and its user-defined texts."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 0x7F:
        return 0, {}
    size = sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    end, at, texts = 10 + size + 10 * bool(data[5] & 0x10), 10, {}
    while at + 10 <= min(10 + size, len(data)) and data[at : at + 4].strip(b"\0"):
        raw = data[at + 4 : at + 8]
        n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if data[3] >= 4 else int.from_bytes(raw, "big")
        if data[at : at + 4] == b"TXXX":
            name, _, value = data[at + 11 : at + 10 + n].partition(b"\0")
            texts[name.decode("latin-1")] = value.decode("latin-1")
        at += 10 + n
    return min(end, len(data)), texts


def _table(frame: bytes, h: Header) -> tuple[dict[str, int], bytes] | None:
    """Counts and seek table of a Xing, Info or VBRI frame."""
    at = 4 + h.side
    for at in (4 + h.side, 6 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at, out, toc = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {}, b""
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                toc, at = frame[at : at + 100], at + 100
            return out, toc
    if frame[36:40] == b"VBRI":
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        return {"bytes": size, "frames": frames, "scale": scale}, frame[62 : 62 + entries * width]
    return None


def parse(data: bytes) -> Stream:
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.tags["id3v1"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    kind, first, parts = None, True, []
    while at + 4 <= end:
        h = header(data[at : at + 4])
        nxt = at + h.length if h else 0
        ok = h is not None and nxt <= end and (kind is None or h.kind == kind)
        if ok and nxt + 4 <= end:
            following = header(data[nxt : nxt + 4])
            ok = following is not None and following.kind == h.kind or kind is not None and _good_crc(data, at, h)
        if not ok:
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out.skipped += to - at
            at = to
            continue
        if kind is None:
            kind, out.rate, out.kind = h.kind, h.rate, f"{VERSIONS[h.version]}l{h.layer}"
        if first and h.layer == 3 and (found := _table(data[at:nxt], h)):
            out.table, out.toc = found
        else:
            good = _good_crc(data, at, h) if h.protected and h.layer == 3 else None
            out.crc_good += good is True
            out.crc_bad += good is False
            out.offsets.append(at)
            out.kilobits.add(h.kilobits)
            out.samples += h.samples
            if h.layer == 3 and good is not False:
                parts.append(data[at + 4 + 2 * h.protected + h.side : nxt])
        first, at = False, nxt
    out.skipped += max(0, end - at)
    out.data = b"".join(parts)
    if "payload_bytes" in out.tags:
        out.data = out.data[: int(out.tags["payload_bytes"])]
    return out


def _good_crc(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected Layer III frame's checksum is right."""
    return h.protected and h.layer == 3 and crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")


_SIDE = bytes(17)  # mono; main data starts here, no coded data: silence


@lru_cache(maxsize=16)
def _start(index: int) -> bytes:
    """Header, checksum and side information of a protected mono frame at 32 kHz."""
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    return head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE


def wrap(payload: bytes) -> bytes:
    """A stream that holds the payload; parse(wrap(p)).data == p."""
    sizes = [144 * k // 32 for k in KILOBITS[True, 3]]
    lead, top = len(_start(14)), len(sizes) - 1
    room, frames, offsets, at = sizes[top] - lead, [], [], 144
    for lo in range(0, len(payload), room):
        part = payload[lo : lo + room]
        index = next(i for i in range(1, len(sizes)) if sizes[i] - lead >= len(part))
        frames.append(_start(index) + part.ljust(sizes[index] - lead, b"\0"))
        offsets.append(at)
        at += sizes[index]
    toc = bytes(min(255, 256 * offsets[len(offsets) * i // 100] // at) if offsets else 0 for i in range(100))
    info = (bytes((0xFF, 0xFB, 1 << 4 | 2 << 2, 0xC0)) + _SIDE + b"Xing" + struct.pack(">III", 15, len(frames), at) + toc + struct.pack(">I", 0)).ljust(144, b"\0")
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + info + b"".join(frames) + b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"


def padded(data: bytes, unit: int = 64) -> bytes:
    """data with zero bytes up to a positive multiple of the unit."""
    return data + bytes(unit - len(data) if len(data) < unit else -len(data) % unit)


def media_of_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Per row: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, duration
    (seconds as a fraction), seek_offsets, and with with_media the stream itself. All but n_bytes come from parsing the
    stored stream; a payload that doesn't come back whole raises."""
    ship(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())] + [pa.binary()] * with_media
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration", "seek_offsets"] + ["media"] * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows, size, start = [], 0, at
                while at < batch.num_rows and size < 8 << 20:
                    raw = batch.column(1)[at].as_py().encode("utf-8")
                    sent = padded(raw)
                    media = wrap(sent)
                    got = parse(media)
                    if got.data != sent:
                        raise ValueError("a stored payload did not come back whole")
                    rows.append((len(raw), len(got.data), hashlib.sha256(got.data).hexdigest(), zlib.crc32(got.data[-64:]), len(media), hashlib.sha256(media).hexdigest(), got.feature(), got.duration, got.offsets) + (media,) * with_media)
                    size += len(media)
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shape = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration string, seek_offsets array<int>" + ", media binary" * with_media
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {shape}").withColumnRenamed("id", id_col)


def parse_media(media: DataFrame, *, id_col: str, media_col: str = "media") -> DataFrame:
    """Any MPEG streams: id_col, kind, rate, frames, samples, duration, crc_good, crc_bad, skipped, table_frames, seek_offsets. A null stream has no frames."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(x or b"") for x in batch.column(1).to_pylist()]
            cols = [
                pa.array([g.kind for g in got], pa.string()), pa.array([g.rate for g in got], pa.int32()), pa.array([len(g.offsets) for g in got], pa.int64()), pa.array([g.samples for g in got], pa.int64()),
                pa.array([g.duration for g in got], pa.string()), pa.array([g.crc_good for g in got], pa.int64()), pa.array([g.crc_bad for g in got], pa.int64()), pa.array([g.skipped for g in got], pa.int64()),
                pa.array([g.table.get("frames") for g in got], pa.int64()), pa.array([g.offsets for g in got], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "kind", "rate", "frames", "samples", "duration", "crc_good", "crc_bad", "skipped", "table_frames", "seek_offsets"])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    shape = "kind string, rate int, frames long, samples long, duration string, crc_good long, crc_bad long, skipped long, table_frames long, seek_offsets array<int>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {shape}").withColumnRenamed("id", id_col)
