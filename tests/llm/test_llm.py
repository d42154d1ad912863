"""Operators of the subpackage on odd tables, and each method against a brute-force version."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cloakframe.llm import chunk_codec, components, line_dedup, mpeg, near_copies, packing, sharding, simhash, token_counts, topk, toxicity, warc

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 97} lorem" for i in range(9_000))
ODD = ["", " \n\t ", "a", "ΑΣ Σ <|endoftext|> <|ENDOFTEXT|>", "é́ ﬁ ﬀ it's", "中文 字 x", "x" * 5_000, "a \n b\n\nc", "\x1c y \x85 z", LONG]
#: Null ids and texts, repeats, columns with names that operators use themselves.
ROWS = [(i, t, "s", i, 1) for i, t in enumerate(ODD)] + [(100, None, "s", 0, 1), (None, "no id here", "s", 0, 1), (1, " \n\t ", "s", 1, 1), (101, "a", "s", 0, 1)]
SCHEMA = "doc_id long, text string, id string, rank long, n long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t, *_ in ROWS]


# --- tokens -------------------------------------------------------------------------------------------


def test_token_counts(docs, none):
    tok = Tokenizer.from_file(WORDS)
    got = token_counts.count_tokens(docs, WORDS, limit=100, chunk_chars=400, overlap_chars=60).collect()
    want = [(i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 100) for i, t in texts()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(none, WORDS).count() == 0


def test_overlaps_widen_until_they_agree():
    tok = Tokenizer.from_file(WORDS)
    encode = lambda xs: [(e.ids, e.offsets) for e in tok.encode_batch(xs, add_special_tokens=False)]
    for t in [*ODD, "ab" * 700 + " c d e " * 40, " ".join("x" * 90 for _ in range(40))]:
        for chunk, overlap in ((50, 10), (120, 30)):
            assert token_counts.resync_encode(encode, t, chunk, overlap) == tok.encode(t, add_special_tokens=False).ids


def test_texts_normalised_in_python_give_the_same_ids():
    from cloakframe.llm import tokenizer_files

    rng, whole, bare = random.Random(4), tokenizer_files.load(WORDS), tokenizer_files.load_plain(WORDS)
    chars = [chr(c) for r in ((0x20, 0x7F), (0xA1, 0x250), (0x300, 0x370), (0x2010, 0x2028), (0x2030, 0x205F), (0x3041, 0x3100), (0x4E00, 0x4E40)) for c in range(*r)] + list(" \n\t  ") * 30
    seen = 0
    for _ in range(1_500):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(1, 80)))
        if (form := tokenizer_files.plain(text)) is not None:
            assert bare.encode(form, add_special_tokens=False).ids == whole.encode(text, add_special_tokens=False).ids, text
            seen += 1
    assert seen > 1_000


def test_words_are_encoded_once_and_counted_as_in_the_whole_text():
    from cloakframe.llm import tokenizer_files

    rng, bare, encoded = random.Random(9), tokenizer_files.load_plain(WORDS), []

    class Spy:
        def encode(self, text, add_special_tokens):
            encoded.append(text)
            return bare.encode(text, add_special_tokens=add_special_tokens)

    sides = lambda xs: [(e.ids, e.offsets) for e in bare.encode_batch(xs, add_special_tokens=False)]
    pieces = ["the", "don't", "'re'lly", "x1y2.", "日本語", "é\u0301", "naïve,", "###", "12345", "a" * 70, "q…r", "<x|>", "_", "'"]
    made = [" ".join(rng.choice(pieces) + rng.choice(["", "s", "'ll", "9"]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    forms = [p for t in [*ODD, *made, "ab" * 700 + " c d e " * 40, "c d e " * 40 + "ab" * 700, "", "é" * 900] if (p := tokenizer_files.plain(t)) is not None]
    assert len(forms) > 40
    for most in (1 << 20, 200):  # a table that holds all, and one that is halved again and again
        words = tokenizer_files.Words(Spy(), most)
        for t in forms:
            for chunk, overlap in ((4_096, 256), (50, 10), (120, 30), (400, 60)):
                assert token_counts.resync_count(words, sides, t, chunk, overlap) == len(bare.encode(t, add_special_tokens=False).ids), (t, chunk)
            assert words.size <= most + len(t) + sum(map(len, t.split(" "))) + 500
        if most > 200:
            seen = [w for t in encoded for w in t.split(" ")]
            assert len(seen) == len(set(seen))


def test_only_tokenizers_with_words_apart_are_counted_by_words(tmp_path):
    from cloakframe.llm import tokenizer_files

    assert tokenizer_files.load_words(WORDS) is not None
    spec = json.loads(tokenizer_files.load(WORDS).to_str())
    joined = tmp_path / "joined.json"  # its pattern takes a space into the token
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r" ?[\p{L}]+|[\s\S]"}
    joined.write_text(json.dumps(spec))
    assert tokenizer_files.load_plain(str(joined)) is not None and tokenizer_files.load_words(str(joined)) is None


def test_chunk_codec(docs, none):
    tok = Tokenizer.from_file(WORDS)
    got = {(r["doc_id"], r["decoded_sha256"]): r for r in chunk_codec.code_digests(docs, WORDS).collect()}
    for i, t in texts():
        ids = tok.encode(t, add_special_tokens=False).ids
        r = got[i, hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert chunk_codec.code_digests(none, WORDS).count() == 0


def test_chunks_are_shared_and_joins_repaired():
    tok, codec = Tokenizer.from_file(WORDS), chunk_codec.Codecs(WORDS, 1 << 22)
    for c in (codec.plain, codec.whole):
        c.cut = (64, 400, 5)
    passage = " ".join(f"shared{i * 7919 % 1000} text" for i in range(300))
    batch = [f"first {passage}", f"another beginning, {passage} and end", *ODD]
    assert [x.tolist() for x in codec.encode_batch(batch)] == [tok.encode(t, add_special_tokens=False).ids for t in batch]
    assert codec.plain.reused > 5 and codec.plain.repaired > 5


# --- media, archives, shards ----------------------------------------------------------------------------


def test_mpeg_columns(docs, none):
    got = {(r["doc_id"], r["n_bytes"]): r for r in mpeg.media_of_texts(docs, with_media=True).collect()}
    for i, t in texts():
        raw = t.encode()
        sent = raw + bytes(64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
        r = got[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(sent), hashlib.sha256(sent).hexdigest(), zlib.crc32(sent[-64:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert mpeg.media_of_texts(none).count() == 0


def test_mpeg_resynchronises_and_checks():
    whole = mpeg.wrap(b"x" * 5_000)
    a = mpeg.parse(whole)
    assert (len(a.offsets), a.samples, a.duration, a.crc_good, a.skipped) == (4, 4_608, "18/125", 4, 0) and a.table["frames"] == 4 and len(a.toc) == 100
    junk = whole[: a.offsets[2]] + b"\xff\xfbjunk\xff" + whole[a.offsets[2] :]
    b = mpeg.parse(junk)
    assert b.samples == a.samples and b.skipped == 7 and b.data == b"x" * 5_000
    bad = bytearray(whole)
    bad[a.offsets[1] + 8] ^= 1
    assert mpeg.parse(bytes(bad)).crc_bad == 1
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"\xff" * 50).samples == 0
    assert mpeg.crc16(b"123456789") == 0xAEE7  # poly 0x8005, start 0xffff, not reflected


def test_warc(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/ b\r\n", big), (5, "http://b", big), (9, None, big), (9, None, big), (2, "u", "small"), (3, "u", "small"), (4, "u", None), (None, "u", big), (7, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.archive_and_read(pages).collect(), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == big and i != 9
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.archive_and_read(pages.where("false")).count() == 0
    named = ("body", "bytes", "digest", "meet", "salt", "winner", "id", "archive", "offset")
    hot = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(big).alias("html"), *[F.lit(0).alias(c) for c in named])
    kinds = {(r["record_type"], r["refers_to"]): r["n"] for r in warc.archive_and_read(hot).groupBy("record_type", "refers_to").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("revisit", 299): 299, ("response", None): 1}
    assert [x[3] for x in warc.coalesced([("a", 0, 5), ("a", 5, 5), ("a", 500, 5), ("b", 0, 5)], gap=10)] == [[0, 1], [2], [3]]


def test_shards(spark, docs, none):
    def check(df, limit):
        got = sharding.extendible_shards(df, max_bytes=limit, step=5).collect()
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r)
        for rows in by.values():
            assert len(rows) == rows[0]["shard_docs"] and sum(r["n_bytes"] for r in rows) == rows[0]["shard_bytes"]
            assert rows[0]["shard_bytes"] <= limit or len(rows) == 1
        bits = sorted({s.split("/")[0] for s in by})
        assert all(not b.startswith(a) for a, b in zip(bits, bits[1:]))  # no shard holds another
        return got

    many = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    assert len(check(many, 700)) == 500
    # Brute force: the shallowest prefix of the hash whose bytes fit, whatever the number of bits of a round.
    place = {i: f"{int(hashlib.md5(f'{i}:{hashlib.md5(b"x" * (i % 50)).hexdigest()}'.encode()).hexdigest()[:15], 16):060b}" for i in range(500)}
    fits = lambda bits: sum(j % 50 for j, p in place.items() if p.startswith(bits)) <= 700
    want = {i: next(p[:d] for d in range(61) if fits(p[:d])) for i, p in place.items()}
    for step in (1, 5, 16):
        assert {r["doc_id"]: r["shard"] for r in sharding.extendible_shards(many, max_bytes=700, step=step).collect()} == want
    same = many.unionByName(spark.range(200).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot hot hot").alias("text")))
    assert len(check(same, 700)) == 700
    assert len(check(docs, 3_000)) == len(ROWS) and check(none, 10) == []


# --- packing, search, links -----------------------------------------------------------------------------


def test_packing(docs, none):
    tok = Tokenizer.from_file(BYTES)
    got = packing.pack_documents(docs, BYTES, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=64).collect()
    want = []
    for i, t in texts():
        ids, at = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4"), 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 64)):
            want.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(none, BYTES).count() == 0


def test_local_search_empties_bins():
    random.seed(3)
    for lengths in ([random.choice([341, 342, 350, 400, 500, 520, 600]) for _ in range(1_500)], [random.randint(1, 1_024) for _ in range(800)], [], [1_024], [1] * 50):
        bins = packing.Bins(lengths, 1_024)
        bins.best_fit()
        before = sum(map(bool, bins.items))
        got = packing.pack(lengths, 1_024)
        assert sorted(i for b in got for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 1_024 for b in got)
        assert bins.fewest() <= len(got) <= before
    assert len(packing.pack([600, 500, 424, 524], 1_024)) == 2


def test_local_search_beats_best_fit():
    rng = random.Random(5)
    better = 0
    for _ in range(20):
        lengths = [rng.randint(200, 420) for _ in range(150)]
        plain = packing.Bins(lengths, 1024)
        plain.best_fit()
        got = packing.pack(lengths, 1024)
        assert sorted(i for x in got for i in x) == list(range(150)) and all(sum(lengths[i] for i in x) <= 1024 for x in got)
        assert plain.fewest() <= len(got) <= len(plain.items)
        better += len(got) < len(plain.items)
    assert better >= 5


def test_one_repeated_id_is_dealt_to_many_groups(spark):
    df = spark.createDataFrame([(7, "a few words")] * 400, "doc_id long, text string").repartition(8)
    cut = packing.pieces(df, public_tokenizers.path("byte_bpe_50k.json"))
    assert cut.select("copy").distinct().count() == 400


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (None, [1.0] * 6), (303, [2.0]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, query_rows=4, shard_rows=16).collect()))
    ok = [(i, [np.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 20 == 0:
            all_ = sorted((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in ok if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(all_)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    copies = spark.createDataFrame([(0, [1.0]), *[(9, [1.0])] * 30, (8, [0.5])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(copies, F.col("vec_id") == 0, shard_rows=4).orderBy("rank").collect()] == [(9, 65_536)] * 5


def test_exact_scores_beyond_doubles():
    q, s = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**20, 4.0]])
    assert topk.tile_top(np.array([1]), q, np.array([5, 6]), s, 2)[2].tolist() == [2**60 + 4, 2**60 + 3]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (2, 1), (9, 8), (5, 5), (3, 4), (20, 4)], "a long, b long")
    assert sorted(map(tuple, components.components(links).collect())) == [(2, 1), (3, 1), (4, 1), (9, 8), (20, 1)]
    assert components.components(links.where("false")).count() == 0


def test_star_links_find_every_pair_within_four_bits():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in range(7)})
    masks = simhash.flips(12, 2)
    sent = sorted(((f >> 52) ^ m, f) for f in fps for m in masks)
    links = simhash.star_links(np.array([f for _, f in sent], np.uint64), np.array([b for b, _ in sent], np.uint64), 12, 2)
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links.tolist():
        assert (a ^ b).bit_count() <= 4
        up[root(a)] = root(b)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                assert root(a) == root(b)


def test_fingerprints_equal_a_plain_count():
    import xxhash

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Alpha", "beta", "É", "x\u00a0y", "GAMMA"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", " \t\n", "one", "a b c", "a b c d\x0be"]
    for text in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
        runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want, text


def test_near_duplicates(spark, docs, none):
    long = [f"tok{i * 31 % 1009}" for i in range(900)]
    near = [" ".join(long), " ".join(long[:450] + ["changed"] + long[451:]), " ".join(random.Random(1).sample(long, 900))]
    df = docs.select("doc_id", "text", "id").unionByName(spark.createDataFrame([(900 + i, t, "s") for i, t in enumerate(near)], "doc_id long, text string, id string"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got[0] == ("0" * 16, 0) and got[100] == ("0" * 16, 0) and got[1] == ("0" * 16, 0)
    assert got[2][1] == got[101][1] == 2 and got[900][1] == got[901][1] == 900 and got[902][1] == 902
    kept = [r["doc_id"] for r in simhash.keep_one(df).collect()]
    assert kept.count(0) == 1 and 1 not in kept and 100 not in kept and 101 not in kept and 901 not in kept and 902 in kept
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randint(0, 9_999)}" for _ in range(60))
    one, two, three, four, five = (text() for _ in range(5))
    rows = [(1, one), (7, two), (7, three), (None, one), (None, four), (None, five), (9, two), (7, two)]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(1, one), (7, two), (7, three), (None, four), (None, five)], key=str)


# --- lines, toxicity, pipeline ----------------------------------------------------------------------------


def brute_lines(rows):
    lines = [(i, k, frozenset(x.lower().split())) for i, t in sorted(rows) for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= line_dedup.MIN_WORDS]
    return {(i, k) for n, (i, k, w) in enumerate(lines) if any(len(w & v) >= 0.8 * len(w | v) for _, _, v in lines[:n])}


def test_line_dedup(spark, docs, none):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 40))] for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randint(0, 300)}"
            lines.append(" ".join(w))
        rows.append((i, "\n".join([*lines, "", "ab"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = brute_lines(rows)
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    for i, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        assert got[i] == ("\n".join(kept), len(t.split("\n")) - len(kept))
    odd = line_dedup.dedup_lines(docs)
    assert odd.count() == len(ROWS) and odd.where("text is null").count() == 1 and set(odd.columns) >= set(docs.columns)
    assert line_dedup.dedup_lines(none).count() == 0


def test_hot_tokens_and_retry(spark, monkeypatch):
    """Pairs of tokens in place of hot tokens, and the second join of lines whose links fail, lose nothing."""
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(4, 30))] for _ in range(25)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 40)}"
        rows.append((i, " ".join(words)))
    gone = brute_lines(rows)
    assert 10 < len(gone) < 80
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(line_dedup, "HOT", 3)
    found = lambda: {r["doc_id"] for r in line_dedup.dedup_lines(df).collect() if r["lines_removed"]}
    assert found() == {i for i, _ in gone}
    verified, calls = line_dedup._verified, []

    def none_hold(links, firsts, threshold):
        out = verified(links, firsts, threshold)
        calls.append(1)
        return out.withColumn("held", F.lit(False)) if len(calls) % 2 else out

    monkeypatch.setattr(line_dedup, "_verified", none_hold)
    assert found() == {i for i, _ in gone} and len(calls) == 2


def test_ids_of_any_kind_and_repeats(spark):
    two = "alpha beta gamma delta epsilon\nzeta eta theta iota kappa"
    rows = [("b", two), ("a", "zeta eta theta iota kappa\nown words of this one text"), ("a", two), ("a", two), (None, "alpha beta gamma delta epsilon")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string").repartition(2)).collect()
    assert len(got) == 5 and sum("alpha beta gamma" in r["text"] for r in got if r["doc_id"] != "a") <= 1
    assert sum(len(r["text"].split("\n")) - (r["text"] == "") for r in got) >= 3
    whole = [r["text"] for r in got if r["doc_id"] == "a"]
    assert sum("own words of this one text" in t for t in whole) == 1
    same = [(7, two), (7, two), (8, two)]
    got = sorted((r["doc_id"], r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(same, "doc_id long, text string").repartition(3)).collect())
    assert got == [(7, two, 0), (7, two, 0), (8, "", 2)]


def test_word_hashes(monkeypatch):
    from cloakframe.llm import words

    rng = random.Random(3)
    data = "".join(rng.choice(["ab", "b", "é", " ", "\n", "\t", "文", "xyz"]) for _ in range(4_000)).encode()
    whole, places = words.word_hashes(data)
    parts = data.split()
    assert [data[p : p + len(w)] for p, w in zip(places, parts)] == parts and len(places) == len(parts)
    by = {}
    assert all(by.setdefault(w, h) == h for w, h in zip(parts, whole.tolist())) and len(set(by.values())) == len(by)
    monkeypatch.setattr(words, "BLOCK", 7)
    small, _ = words.word_hashes(data)
    assert (small == whole).all()
    odd = "a\u3000b\x1cc\u00a0d e"
    assert words.plain_spaces(odd).replace("\x1c", " ").split(" ") == odd.split()
    many = np.array([0, 3, 40, 0, 5, 1, 9])
    runs, each = words.run_hashes(whole[: many.sum()], many, 5)
    assert each.tolist() == [0, 1, 36, 0, 1, 1, 5]
    alone = [words.run_hashes(whole[e - n : e], np.array([n]), 5)[0].tolist() for e, n in zip(np.cumsum(many), many)]
    assert runs.tolist() == sum(alone, [])


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "Les.\nErheed. Titionly.\n\n \n文書の一行目です\na b c d"), (2, "les.\nTitionly. Erheed.\nLes. Les.\n\nother"), (3, "文書の一行目です\nb c a\nd c b a e"), (4, "Les\nc b a")]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nother", 3), 3: ("b c a", 2), 4: ("Les", 1)}


def test_long_runs_equal_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    c = 300
    n, order = rng.integers(8, 12, c), rng.permutation(c)
    args = np.zeros(c, np.int64), order, n, np.zeros(c, np.int64), rng.integers(0, 4, c).astype(np.uint64), np.zeros(c, np.uint64)
    found = []
    for run in (4_096, 1):
        monkeypatch.setattr(line_dedup, "LONG_RUN", run)
        a, b = line_dedup.nearest_partners(*args)
        assert (order[a] > order[b]).all()
        found.append(sorted(a.tolist()))
    assert found[0] == found[1]


def toxic_corpus(spark, n=240):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randint(0, 60)}" for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(["zorgish", "blaggard", "snivelo", "zorgisher", "blaggards"], 3):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, none):
    df, labels = toxic_corpus(spark)
    rows = toxicity.score_documents(df, labels).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = [r for r in rows if r["held_out"] and r["predicted"] != (r["doc_id"] % 4 == 0)]
    assert not wrong and all(0 <= r["score"] <= 1 for r in rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert [r["score"] for r in toxicity.score_documents(df, flipped).collect()] == [r["score"] for r in rows]  # held-out labels are not used
    kept = toxicity.reject_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 180
    odd = toxicity.score_documents(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    assert odd.count() == len(ROWS) and odd.agg(F.max("score")).first()[0] == 0
    assert toxicity.score_documents(none, labels).count() == 0


def test_only_verified_copies_of_a_label_go():
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9_999)}" for _ in range(100)]
    near, far = [*base[:-2], "x", "y"], [*base[:50], *(f"v{i}" for i in range(50))]
    rows = [(1, 1, " ".join(base)), (2, 1, " ".join(near)), (3, 0, " ".join(base)), (4, 1, " ".join(far)), (5, 0, ""), (6, 0, " "), (7, 1, " ".join(base))]
    assert [i for i, _, _ in toxicity.without_copies(rows)] == [1, 3, 4, 5]


def test_index_is_exact():
    rng = random.Random(9)
    vectors = []
    for _ in range(300):
        v = {t: rng.random() for t in rng.sample(range(40), rng.randint(1, 6))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 40, block=8)
    for v in vectors[:60]:
        want = sorted((round(sum(x * w.get(t, 0) for t, x in v.items()), 9) for w in vectors), reverse=True)[:10]
        assert [round(s, 9) for s, _ in index.top(v, 10)] == pytest.approx(want)
    assert index.opened < 60 * index.blocks


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{rng.randint(0, 5_000)}" for _ in range(rng.randint(20, 200))]
        for k in range(4):  # copies with 0 to 5 changed words, on both sides of 0.8
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 5_000)}"
            rows.append((None if g == 11 else g * 10 + k // 2 if g == 10 else g * 10 + k, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "Two words"), (203, "two  words"), (204, "two"), (204, "two")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()]
    sets = lambda t: frozenset(near_copies.shingles([t or ""])[0].tolist())
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    kept = [sets(t) for _, t in left]
    assert not any(like(a, b) for i, a in enumerate(kept) for b in kept[:i])
    gone = set(rows) - set(left)
    assert len(gone) > 10 and all(any(like(sets(t), sets(u)) and (j is None or i is not None and j <= i) for j, u in rows if (j, u) != (i, t)) for i, t in gone)
    assert {i for i, _ in left if i and i >= 200} == {200, 202, 204}


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns with the names that operators use, no rows at all."""
    names = "doc_id long, text string, lines_removed long, score double, id long, row long, d string, cf_x int, sequence_id string"
    many = [(None, None), (None, "only this one line here"), (None, "only this one line here"), (1, ""), (1, "a b c d e f g\nh i j"), (1, "a b c d e f g\nh i j"), (2, "x " * 40_000)]
    rows = [(i, t, 7, 0.5, 3, 4, "d", 5, "s") for i, t in many]
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("some", spark.createDataFrame(rows, names)), ("empty", spark.createDataFrame([], names))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        now = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for step, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path / name))
            assert out.columns == df.columns, step
            out.write.parquet(str(tmp_path / name / step))
            now = spark.read.parquet(str(tmp_path / name / step))
        left = now.collect()
        assert all(r["lines_removed"] == 7 and r["score"] == 0.5 and r["id"] == 3 for r in left)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path / name)).collect()
        assert len({r["doc_id"] for r in packed}) == len({r["doc_id"] for r in left}) and (name == "some") == bool(left)


def test_pipeline(spark, tmp_path):
    df, labels = toxic_corpus(spark)
    extra = spark.createDataFrame([(1_000, "", "e"), (1_001, None, "e"), (1_002, "an only line that nobody else has", "e"), (1_003, "an only line that nobody else has", "e")], df.schema)
    docs = df.unionByName(extra).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    left = {r["doc_id"]: r["text"] for r in now.collect()}
    assert not any(i % 4 == 0 for i in left if i < 240) and 1_002 in left and 1_003 not in left and len([i for i in left if i >= 1_000]) == 2
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)
