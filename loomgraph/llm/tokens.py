"""Sizes in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary of ranks; a path parameter of every operator that sizes texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts were split before merging (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MADE: dict[str, Sizer] = {}


def _ranges(letters: str) -> str:
    """A sorted set of letters as ranges for a character class."""
    out: list[list[int]] = []
    for c in map(ord, letters):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


class Sizer:
    """Token counts, exact and fast: a text is split as the tokenizer splits it, and the count of
    each distinct word is remembered (at most ``keep`` words of up to 64 characters)."""

    def __init__(self, vocabulary: bytes, keep: int = 500_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self.encoding.encode_ordinary

        class Memo(dict):
            def __missing__(self, word):
                n = len(encode(word))
                if len(word) <= 64:
                    if len(self) >= keep:
                        self.clear()
                    self[word] = n
                return n

        self.memo = Memo()
        ends, other = r"'s|'t|'re|'ve|'m|'ll|'d", r"|\s+(?!\S)|\s+"
        self.split_ascii = re.compile(ends + "| ?[A-Za-z]+| ?[0-9]+| ?[^\\sA-Za-z0-9]+" + other).findall
        # Latin letters as ranges are faster than letter classes; exact where a text has no other letters or numbers.
        kinds = {chr(c): unicodedata.category(chr(c)) for c in range(0x3100)}
        latin = "".join(c for c, k in kinds.items() if k[0] == "L" and c < "\u0250")
        self.plain = frozenset(c for c, k in kinds.items() if c not in "\x1c\x1d\x1e\x1f" and (k[0] in "PSZ" or k == "Cc" or c in latin or c in "0123456789"))
        ranges = _ranges(latin)
        self.split_latin = re.compile(ends + rf"| ?[{ranges}]+| ?[0-9]+| ?[^\s{ranges}0-9]+" + other).findall
        self.split_any = regex.compile(PATTERN).findall

    def words(self, text: str) -> list[str]:
        """The text in the pieces within which merging happens."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self.split_any(text)  # white space to ``re``, but not to the tokenizer
        if text.isascii():
            return self.split_ascii(text)
        return self.split_latin(text) if self.plain.issuperset(set(text)) else self.split_any(text)

    def count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.words(text)))


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """Read on the driver and sent along (under 1 MB), so executors need no such file."""
    return Path(path).read_bytes()


def sizer(vocabulary: bytes) -> Sizer:
    """The sizer of this Python worker, made once."""
    key = hashlib.md5(vocabulary).hexdigest()
    if key not in _MADE:
        _MADE[key] = Sizer(vocabulary)
    return _MADE[key]


def count_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; null and empty texts have none."""
    data = read_vocabulary(vocabulary)

    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        count = sizer(data).count
        return pa.array([count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return size(text)
