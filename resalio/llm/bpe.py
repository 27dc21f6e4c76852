"""Byte-level BPE in linear time, from a table of ranks alone.

A sequence of tokens is the one that merging by rank gives if and only if each token and each two neighbours are
what merging their own bytes gives. So a piece is encoded from its end: an Aho-Corasick automaton over the
vocabulary, bytes read as Latin-1, finds in one pass every token that ends at each place; the longest one that fits
the token after it is taken, shorter ones next, and a place from which no token leads on is never tried again.
Whether two tokens may stand side by side is worked out by merging their few bytes, once, and remembered.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held, open_store, table, texts
from .tokens import TOGETHER, Units

#: A space that ends a run of white space which no word follows: where cutting at spaces is not safe.
UNSAFE_SPACE = re.compile(r" (?<=\s )(?!\S)")
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Answers on token pairs remembered at once.
PAIRS = 250_000
#: Units remembered in each of two generations, after a space and without one.
SPACED, FIRST = 300_000, 20_000


class BytePairs:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for b in ranks:
            self.automaton.add_word(b.decode("latin-1"), b)
        self.automaton.make_automaton()
        self.sound: dict[bytes, bool] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Merging by rank, step by step; for the few bytes of one token or two."""
        rank, none = self.ranks.get, len(self.ranks)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def whole(self, b: bytes) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (known := self.sound.get(b)) is None:
            known = self.sound[b] = self.merged(b) == [b]
        return known

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether b may follow a."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(a + b) == [a, b]
        return known

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (known := self.ranks.get(piece)) is not None:
            return [known]
        found = list(self.automaton.iter(piece.decode("latin-1")))  # by last byte, the longest first
        n, sound, fits = len(found), self.sound, self.fits
        dead = bytearray(len(piece) + 1)
        at, taken = len(piece), []
        k = bisect_left(found, (at - 1,))
        tried = []  # where the search goes on at each place, once what was taken there has led nowhere
        while at:
            after = taken[-1] if taken else None
            while k < n and found[k][0] == at - 1:
                b = found[k][1]
                k += 1
                if dead[at - len(b)] or not (sound[b] if b in sound else self.whole(b)):
                    continue
                if after is None or (fits[b, after] if (b, after) in fits else self.beside(b, after)):
                    taken.append(b)
                    tried.append(k)
                    at -= len(b)
                    k = bisect_left(found, (at - 1,))
                    break
            else:
                if not taken:
                    raise ValueError("a byte of the text is in no token")
                dead[at] = 1
                at += len(taken.pop())
                k = tried.pop()
        return [self.ranks[b] for b in reversed(taken)]

    def encode(self, strings: list[str]) -> list[bytes]:
        """Each string's ids, little-endian unsigned 32-bit; every match of the pattern by itself."""
        return [np.array([i for m in self.pattern.findall(s) for i in self.piece(m.encode())], "<u4").tobytes() for s in strings]


class ByteLevel:
    """Texts to ids with a memory of units: cut before each space that a word follows, where the pattern cuts too."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]) -> None:
        self.encode = encode
        self.first, self.spaced = Units(encode, "", FIRST), Units(encode, " ", SPACED)

    def many(self, texts: list[str]) -> list[bytes]:
        out = []
        for part in (texts[k : k + TOGETHER] for k in range(0, len(texts), TOGETHER)):
            safe = [not UNSAFE_SPACE.search(t) for t in part]
            cut = [t.encode().split(b" ") for t, s in zip(part, safe) if s]
            heads = self.first.each([units[0] for units in cut])
            tails = self.spaced.joined([units[1:] for units in cut])
            known = iter([h + t for h, t in zip(heads, tails)])
            other = iter(self.encode([t for t, s in zip(part, safe) if not s]))
            out += [next(known if s else other) for s in safe]
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def read_ranks(path: str) -> dict[bytes, int]:
    fs, path = open_store(path)
    with fs.open_input_file(path) as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def token_bytes(name: str) -> dict[int, bytes]:
    """The bytes of each id; all that decoding needs."""
    return {i: b for b, i in read_ranks(public_tokenizers.path(name) if "/" not in name else name).items()}


def decode(ids: bytes, token: dict[int, bytes]) -> bytes:
    return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def byte_pairs(name: str) -> BytePairs:
    return BytePairs(read_ranks(public_tokenizers.path(name) if "/" not in name else name), public_tokenizers.PATTERN)


def byte_level(name: str) -> ByteLevel:
    return ByteLevel(byte_pairs(name).encode)


def _encode(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = held(byte_level, name)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode.many(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])


def encode_texts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids): one row per row of docs (doc_id, text), ids little-endian unsigned 32-bit.

    Null and empty texts have no ids. Repeated rows and null doc_ids stay as they are; an empty table gives no
    rows; other columns are ignored; texts of any length take time and memory in proportion.
    """
    return texts(docs).mapInArrow(partial(_encode, ranks), "doc_id long, ids binary")


def _decode(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = held(token_bytes, name)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([decode(i or b"", token) for i in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids", "bytes"])


def decode_ids(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that ids stand for. Null ids are none."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, ranks), "doc_id long, ids binary, bytes binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return both.selectExpr("doc_id", "cast(octet_length(ids) div 4 as bigint) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(bytes, 256) AS decoded_sha256")
