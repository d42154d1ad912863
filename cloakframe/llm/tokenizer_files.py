"""Tokenizers by the path of their file, loaded once in each Python worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@lru_cache(maxsize=4)
def load(path: str):
    """A tokenizers.Tokenizer without truncation and padding; special strings are handled as its default."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def load_ranks(path: str):
    """A tiktoken encoding of a file of ranks, with the public set's pattern and no special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def id_strings(path: str) -> list[str]:
    """The vocabulary's strings by id."""
    tok = load(path)
    return [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]


#: Characters whose normal form, case and white space Python and the library surely see alike; Σ, which Python lowers by
#: its place in a word, is not among them.
_COMMON = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u0300-\\u036f\\u2010-\\u2027\\u2030-\\u205e\\u3041-\\u30ff\\u4e00-\\u9fff]")
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


@lru_cache(maxsize=4)
def load_plain(path: str):
    """The tokenizer without its normaliser, if that is one which plain() does; else None."""
    from tokenizers import Tokenizer

    spec = json.loads(load(path).to_str())
    if (spec["normalizer"] or {}).get("normalizers") != _NORMALIZER or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return None
    return Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))


#: Runs of letters, digits and other signs, in which a space never has a part.
_PRETOKENS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class Words:
    """Token counts of texts that plain() gave: their words, between single spaces, have the same tokens in every text, so the library
    encodes each once while it stays in a table of about `most` characters, the earlier half of which stays for good."""

    def __init__(self, tok, most: int):
        self.tok, self.most, self.size, self.known = tok, most, 0, {"": 0}

    def _learn(self, words: list[str]) -> None:
        if self.size > self.most:
            self._halve()
        new = list(set(words).difference(self.known))
        for lo, hi in by_bytes(new, 1 << 16):
            part = new[lo:hi]
            starts = [s for s, _ in self.tok.encode(" ".join(part), add_special_tokens=False).offsets]
            i = at = 0
            for word in part:
                at += len(word) + 1
                upto = bisect_left(starts, at, i, min(len(starts), i + 4 * len(word)))  # at most four bytes, thus tokens, a character
                self.known[word] = upto - i
                i = upto
            self.size += at

    def _halve(self) -> None:
        kept, size = {}, 0
        for word, n in self.known.items():
            size += len(word) + 1
            if size > self.most // 2:
                break
            kept[word] = n
        self.known, self.size = kept, size

    def count(self, text: str) -> int:
        words = text.split(" ")
        self._learn(words)
        return sum(map(self.known.__getitem__, words))


@lru_cache(maxsize=4)
def load_words(path: str, most: int = 1 << 22) -> Words | None:
    """Words over load_plain(), if there is one and no token of it can reach over a space; else None."""
    if (bare := load_plain(path)) is None:
        return None
    spec = json.loads(bare.to_str())
    apart = (spec["pre_tokenizer"] or {}).get("pretokenizers") == _PRETOKENS and spec["post_processor"] is None and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
    return Words(bare, most) if apart and not any(" " in t["content"] for t in spec["added_tokens"]) else None


def plain(text: str) -> str | None:
    """A text as NFC, single spaces and lower case, by Python at many times the library's speed; None where the two
    might differ. White space at the ends, which gives no token, goes too."""
    if "<|" in text or _COMMON.search(text):
        return None
    return " ".join(unicodedata.normalize("NFC", text).split()).lower()


def by_bytes(texts: list[str], most: int = 4 << 20):
    """(from, to) of runs of texts of about `most` characters, so that encodings in memory stay bounded."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
