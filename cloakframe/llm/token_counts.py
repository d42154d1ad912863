"""Token counts with overlap resynchronisation.

Texts of more than `chunk_chars` are cut into overlapping chunks that are encoded with offsets; a
shorter one is a single chunk. Two neighbouring chunks are spliced where both give the same tokens between
two stable positions (see boundaries.py) of the overlap: there neither chunk's cut edge can reach.
Where an overlap holds no such place it is widened, doubling each time, until it swallows the chunk
before it; a text without white space thus ends up encoded whole. Where Python surely normalises a text as the tokenizer
would, it does, and the library is spared its slowest step; if no token of it reaches over a space either, a worker encodes
each word of the chunks once while it stays in a bounded table.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows give repeated
rows; other columns of the input are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boundaries, tokenizer_files
from .common import ship, text_of

CHUNK_CHARS = 4_096
OVERLAP_CHARS = 256
#: How much of an overlap resync_count() encodes at first.
PROBE_CHARS = 48

#: Ids and (start, end) character offsets of a text's tokens.
Encoded = tuple[list[int], list[tuple[int, int]]]


def _common(text: str, lo: int, hi: int, a: Encoded, a0: int, b: Encoded, b0: int) -> tuple[int, int] | None:
    """Of two encodings that start at a0 and b0: (tokens of a to keep, tokens of b to drop) at the first place in
    lo..hi where they agree on all tokens between two neighbouring stable positions."""
    places = boundaries.stable_positions(text, lo + 1, hi - 1)
    p = next(places, None)
    while p is not None:
        q = next(places, None)
        if q is None:
            return None
        ia, ja = _first_from(a[1], p - a0), _first_from(a[1], q - a0)
        ib, jb = _first_from(b[1], p - b0), _first_from(b[1], q - b0)
        if ja - ia == jb - ib > 0 and a[0][ia:ja] == b[0][ib:jb] and _clean(a[1], ia, p - a0) and _clean(b[1], ib, p - b0):
            mine = [(s + a0, e + a0) for s, e in a[1][ia:ja]]
            if mine == [(s + b0, e + b0) for s, e in b[1][ib:jb]]:
                return ia, ib
        p = q
    return None


def _first_from(offsets: list[tuple[int, int]], at: int) -> int:
    """Index of the first token that starts at `at` or later."""
    lo, hi = 0, len(offsets)
    while lo < hi:
        mid = (lo + hi) // 2
        if offsets[mid][0] < at:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _clean(offsets: list[tuple[int, int]], i: int, at: int) -> bool:
    """True if no token lies across the position."""
    return i == 0 or offsets[i - 1][1] <= at


def resync_encode(encode: Callable[[list[str]], list[Encoded]], text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of the whole text from overlapping chunks of it."""
    if len(text) <= chunk:
        return encode([text])[0][0]
    overlap = max(2, min(overlap, chunk // 2))
    starts = list(range(0, max(1, len(text) - overlap), chunk - overlap))
    coded = encode([text[s : s + chunk] for s in starts])
    done: list[int] = []  # tokens that no later splice can touch
    at, now, end = 0, coded[0], min(chunk, len(text))
    for start, nxt in zip(starts[1:], coded[1:], strict=True):
        stop, wide = min(start + chunk, len(text)), overlap
        while (cut := _common(text, start, end, now, at, nxt, start)) is None and start > at:
            wide *= 2
            start = max(at, end - wide)
            nxt = encode([text[start:stop]])[0]
        if cut is None:  # start == at: the new chunk holds all of the one before it
            now, end = nxt, stop
            continue
        done += now[0][: cut[0]]
        now = (nxt[0][cut[1] :], nxt[1][cut[1] :])
        now, at, end = (now[0], [(s, e) for s, e in now[1]]), start, stop
    return done + now[0]


def resync_count(words: tokenizer_files.Words, encode: Callable[[list[str]], list[Encoded]], text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """len(resync_encode()) for a tokenizer whose words stand apart: chunks are counted by words, and only as much of an overlap is
    encoded with offsets, from both sides, as it takes for both to agree."""
    if len(text) <= chunk:
        return words.count(text)
    overlap = max(2, min(overlap, chunk // 2))
    done, at, end = 0, 0, chunk  # done: tokens before the chunk at..end, less those of it that the splice dropped
    for start in range(chunk - overlap, max(1, len(text) - overlap), chunk - overlap):
        stop, wide, reach = min(start + chunk, len(text)), overlap, PROBE_CHARS
        while start > at:  # else the new chunk holds all of the one before it
            hi = min(end, start + reach)
            mine = next(boundaries.stable_positions(text, start, hi), None)
            if mine is not None:
                a, b = encode([text[mine:hi], text[start:hi]])
                if (cut := _common(text, start, hi, a, mine, b, start)) is not None:
                    done += words.count(text[at:mine]) + cut[0] - cut[1]
                    at = start
                    break
            if hi < end:
                reach *= 4
            else:
                wide, reach = 2 * wide, PROBE_CHARS
                start = max(at, end - wide)
        end = stop
    return done + words.count(text[at:end])


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), without special tokens added."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, bare = tokenizer_files.load(tokenizer_path), tokenizer_files.load_plain(tokenizer_path)
        words = tokenizer_files.load_words(tokenizer_path)

        def sides(parts: list[str]) -> list[Encoded]:
            return [(e.ids, e.offsets) for e in bare.encode_batch(parts, add_special_tokens=False)]

        def counted(tok, texts: list[str]) -> list[int]:
            def with_offsets(parts: list[str]) -> list[Encoded]:
                return [(e.ids, e.offsets) for e in tok.encode_batch(parts, add_special_tokens=False)]

            out = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            for lo, hi in tokenizer_files.by_bytes([texts[i] for i in short]):
                for i, e in zip(short[lo:hi], tok.encode_batch_fast([texts[i] for i in short[lo:hi]], add_special_tokens=False), strict=True):
                    out[i] = len(e)
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    out[i] = len(resync_encode(with_offsets, t, chunk_chars, overlap_chars))
            return out

        for batch in batches:
            texts = batch.column(1).to_pylist()
            plain = [tokenizer_files.plain(t) if bare else None for t in texts]  # normalised already, where that is surely the same
            normal = [p for p in plain if p is not None]
            easy, rest = iter([resync_count(words, sides, t, chunk_chars, overlap_chars) for t in normal] if words else counted(bare, normal)), iter(counted(whole, [t for t, p in zip(texts, plain, strict=True) if p is None]))
            counts = [next(rest if p is None else easy) for p in plain]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
