"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the last 32 bytes cuts every text into chunks at places that depend on the
bytes around them only, so a passage that many documents share gives the same chunks in each.
A chunk is encoded once in a Python worker while it stays in a bounded cache (workers are kept
between tasks). A cut falls anywhere, also inside words; therefore every join of two chunks is
repaired: the text from the second last stable position of the left chunk to the second one of
the right chunk is encoded anew, and taken only if its first and last parts agree exactly with
the tokens that the chunks have there. A join that doesn't agree, or whose chunks hold too few
stable positions, is widened by making the two chunks one. Where Python surely normalises a text as
the tokenizer would, it does, and the library is spared its slowest step.

Defined results: a null text counts as empty, with no ids and the empty decoding; repeated rows
give repeated rows; other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boundaries, tokenizer_files
from .common import ship, text_of

WINDOW = 32
MIN_BYTES, MAX_BYTES, MASK_BITS = 512, 16_384, 11
CACHE_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20_240_601).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 data, never inside a character."""
    n = len(data)
    if n <= min_bytes:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h, step = _gear()[raw], 1
    while step < WINDOW:  # after the loop h[i] is the gear hash of the 32 bytes that end at i
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, 2 * step
    found = np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1
    ends, at, k = [], 0, 0
    while n - at > min_bytes:
        k = int(np.searchsorted(found, at + min_bytes))
        end = min(int(found[k]) if k < len(found) else n, at + max_bytes, n)
        while end < n and raw[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


class ChunkCodec:
    """Encodes texts through chunks. `encoded` and `reused` count chunks, `repaired` joins, `widened` merges."""

    def __init__(self, tokenizer_path: str, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES, mask_bits: int = MASK_BITS, cache_bytes: int = CACHE_BYTES, tokenizer=None):
        self.tok, self.path = tokenizer or tokenizer_files.load(tokenizer_path), tokenizer_path
        self.cut, self.most = (min_bytes, max_bytes, mask_bits), cache_bytes
        self.cache: OrderedDict[str, tuple[np.ndarray, tuple[int, ...]]] = OrderedDict()
        self.size = self.encoded = self.reused = self.repaired = self.widened = 0

    def _encode(self, texts: list[str]) -> list:
        """The library's encodings, with offsets."""
        out = []
        for lo, hi in tokenizer_files.by_bytes(texts):
            out += self.tok.encode_batch(texts[lo:hi], add_special_tokens=False)
        return out

    @staticmethod
    def _token_at(e, p: int) -> int:
        """Index of the token that starts after the white space at the stable position p; -1 if none does."""
        i = e.char_to_token(p + 1)
        return -1 if i is None or e.token_to_chars(i)[0] != p + 1 else i

    def _record(self, text: str, e) -> tuple[np.ndarray, tuple[int, ...]]:
        """Ids of a chunk, and the tokens at its first two and last two stable positions."""
        return np.array(e.ids, np.uint32), tuple(self._token_at(e, p) for p in boundaries.first_stable(text, 2) + boundaries.last_stable(text, 2))

    def _chunks(self, texts: list[str]) -> dict[str, tuple[np.ndarray, tuple[int, ...]]]:
        """The encodings of these chunks; each that isn't known is encoded once."""
        got, todo = {}, []
        for t in dict.fromkeys(texts):
            if (hit := self.cache.get(t)) is not None:
                self.cache.move_to_end(t)
                got[t] = hit
            else:
                todo.append(t)
        for t, e in zip(todo, self._encode(todo), strict=True):
            got[t] = self.cache[t] = self._record(t, e)
            self.size += 4 * len(t) + 4 * len(got[t][0]) + 600
        while self.size > self.most and self.cache:
            t, e = self.cache.popitem(last=False)
            self.size -= 4 * len(t) + 4 * len(e[0]) + 600
        self.encoded += len(todo)
        self.reused += len(texts) - len(todo)
        return got

    def split(self, text: str) -> list[str]:
        """Chunks of a text, those with fewer than four stable positions joined to a neighbour."""
        data, at, parts = text.encode("utf-8"), 0, []
        for end in cut_points(data, *self.cut):
            parts.append(data[at:end].decode("utf-8"))
            at = end
        out: list[str] = []
        for p in parts:
            if out and (len(boundaries.first_stable(p, 4)) < 4 or len(boundaries.first_stable(out[-1], 4)) < 4):
                out[-1] += p
            else:
                out.append(p)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every whole text, as the tokenizer gives them. Joins that were repaired stay while both of their chunks do;
        all that fail are widened at once."""
        split = [self.split(t) for t in texts]
        joins: list[list[tuple | None]] = [[None] * (len(c) - 1) for c in split]
        known: dict[str, tuple[np.ndarray, tuple[int, ...]]] = {}
        todo = range(len(texts))
        while todo:
            known |= self._chunks([c for i in todo for c in split[i] if c not in known])
            open_ = [(i, k) for i in todo for k, done in enumerate(joins[i]) if done is None]
            edges = [(boundaries.last_stable(split[i][k], 2), boundaries.first_stable(split[i][k + 1], 2)) for i, k in open_]
            windows = [split[i][k][p[0] :] + split[i][k + 1][: q[1]] for (i, k), (p, q) in zip(open_, edges, strict=True)]
            failed: dict[int, set[int]] = {}
            for (i, k), ((p0, p1), (q0, _)), e in zip(open_, edges, self._encode(windows), strict=True):
                (lid, lat), (rid, rat) = known[split[i][k]], known[split[i][k + 1]]
                ids, (a0, a1), (b0, b1) = np.array(e.ids, np.uint32), lat[-2:], rat[:2]
                h, t = self._token_at(e, p1 - p0), self._token_at(e, len(split[i][k]) - p0 + q0)
                if min(a0, a1, b0, b1, h, t) >= 0 and np.array_equal(ids[:h], lid[a0:a1]) and np.array_equal(ids[t:], rid[b0:b1]):
                    joins[i][k] = (a0, ids, b1)
                    self.repaired += 1
                else:
                    failed.setdefault(i, set()).add(k)
            for i, bad in failed.items():
                split[i], joins[i] = self._widened(split[i], joins[i], bad)
                self.widened += len(bad)
            todo = sorted(failed)
        return [self._spliced([known[c][0] for c in chunks], own) for chunks, own in zip(split, joins, strict=True)]

    @staticmethod
    def _widened(chunks: list[str], joins: list[tuple | None], bad: set[int]) -> tuple[list[str], list[tuple | None]]:
        """Chunks made one across the bad joins, and the joins that are left: known where both sides are as they were."""
        runs = [[0]]
        for k in range(len(joins)):
            if k in bad:
                runs[-1].append(k + 1)
            else:
                runs.append([k + 1])
        kept = [joins[a[-1]] if len(a) == len(b) == 1 else None for a, b in zip(runs, runs[1:], strict=False)]
        return ["".join(chunks[k] for k in run) for run in runs], kept

    @staticmethod
    def _spliced(ids: list[np.ndarray], joins: list[tuple | None]) -> np.ndarray:
        parts, lo = [], 0
        for own, (hi, window, nxt) in zip(ids, joins, strict=False):
            parts += [own[lo:hi], window]
            lo = nxt
        return np.concatenate([*parts, ids[-1][lo:]]) if ids else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """As the tokenizer's decode() with special tokens kept."""
        if self.tok.decoder is None:
            table = tokenizer_files.id_strings(self.path)
            return " ".join([table[i] for i in ids.tolist()])
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


class Codecs:
    """A codec for texts that Python normalises, if the tokenizer allows it, and one for all others."""

    def __init__(self, tokenizer_path: str, cache_bytes: int):
        self.whole = ChunkCodec(tokenizer_path, cache_bytes=cache_bytes // 2)
        bare = tokenizer_files.load_plain(tokenizer_path)
        self.plain = bare and ChunkCodec(tokenizer_path, cache_bytes=cache_bytes, tokenizer=bare)
        self.decode = self.whole.decode

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        forms = [tokenizer_files.plain(t) if self.plain else None for t in texts]
        easy, rest = (iter(c.encode_batch(x) if x else []) for c, x in ((self.plain, [f for f in forms if f is not None]), (self.whole, [t for t, f in zip(texts, forms, strict=True) if f is None])))
        return [next(rest if f is None else easy) for f in forms]


@lru_cache(maxsize=2)
def codec(tokenizer_path: str, cache_bytes: int) -> Codecs:
    """One for each worker and tokenizer, kept between tasks."""
    return Codecs(tokenizer_path, cache_bytes)


def encode_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Per row: id_col, ids (array of int), decoded."""
    return _coded(docs, tokenizer_path, id_col, text_col, cache_bytes, digests=False)


def code_digests(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of UTF-8)."""
    return _coded(docs, tokenizer_path, id_col, text_col, cache_bytes, digests=True)


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, cache_bytes: int, digests: bool) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, cache_bytes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in tokenizer_files.by_bytes(texts):
                coded = own.encode_batch(texts[lo:hi])
                if digests:
                    cols = [
                        pa.array([len(x) for x in coded], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded], pa.string()),
                        pa.array([hashlib.sha256(own.decode(x).encode("utf-8")).hexdigest() for x in coded], pa.string()),
                    ]
                else:
                    cols = [pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array([own.decode(x) for x in coded], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=["id", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"))
    return out.withColumnRenamed("id", id_col)
