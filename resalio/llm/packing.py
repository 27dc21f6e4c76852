"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. What is left of a document after its full windows goes to the
open window with the least room that still holds it; if none holds it and all windows are open, the fullest is
topped up with the head of the piece, if its room is worth a cut, and emitted. When the partition ends, the open
windows are merged: their pieces fill windows one after another, and what remains at the very end leaves as
sequences whose lengths are powers of two, which need no padding. No rows are shuffled, a partition holds
open_windows * size ids at most besides the document at hand, and a task that runs again makes the same sequences.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, table, texts
from .tokens import Merger

SIZE, OPEN_WINDOWS, LEAST_CUT, END_ID = 1024, 64, 8, 0
TOKENIZER = "byte_bpe_50k.json"
#: Texts encoded together.
TOGETHER = 100
SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
#: doc_id, start, ids, doc_tokens
Piece = tuple


class Packer:
    """Pieces to sequences (lists of pieces) of at most size ids."""

    def __init__(self, size: int, open_windows: int, least_cut: int) -> None:
        self.size, self.most, self.least_cut = size, open_windows, least_cut
        self.open: list[tuple[int, int, list[Piece]]] = []  # by room, then age
        self.made = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, at = len(ids), 0
        while total - at >= self.size:
            yield [(doc_id, at, ids[at : at + self.size], total)]
            at += self.size
        while at < total:
            need = total - at
            k = bisect_left(self.open, (need, -1))
            if k < len(self.open):
                room, age, pieces = self.open.pop(k)
            elif len(self.open) < self.most:
                self.made += 1
                room, age, pieces = self.size, self.made, []
            else:
                room, age, pieces = self.open.pop(0)  # the fullest goes
                if room >= self.least_cut:
                    pieces.append((doc_id, at, ids[at : at + room], total))
                    at += room
                yield pieces
                continue
            pieces.append((doc_id, at, ids[at:], total))
            at = total
            if room == need:
                yield pieces
            else:
                insort(self.open, (room - need, age, pieces))

    def close(self) -> Iterator[list[Piece]]:
        left = [p for _, _, pieces in sorted(self.open, key=lambda w: w[1]) for p in pieces]
        count = sum(len(p[2]) for p in left)
        room = want = self.size if count >= self.size else 1 << max(count.bit_length() - 1, 0)
        out: list[Piece] = []
        for doc_id, start, ids, total in left:
            at = 0
            while at < len(ids):
                out.append((doc_id, start + at, part := ids[at : at + room], total))
                at, room = at + len(part), room - len(part)
                if not room:
                    yield out
                    count, out = count - want, []
                    room = want = self.size if count >= self.size else 1 << max(count.bit_length() - 1, 0)


def _pack(tokenizer: str, end_id: int, size: int, open_windows: int, least_cut: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, packer = held(Merger, tokenizer), Packer(size, open_windows, least_cut)
    number, end = TaskContext.get().partitionId() << 33, np.array([end_id], "<u4").tobytes()

    def rows(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
        nonlocal number
        for pieces in sequences:
            offset = 0
            for doc_id, start, ids, total in pieces:
                yield doc_id, start, ids.tobytes(), total, number, offset
                offset += len(ids)
            number += 1

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

    for b in batches:
        found: list[tuple] = []
        for part in (b.slice(k, TOGETHER) for k in range(0, b.num_rows, TOGETHER)):
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                found += rows(packer.add(doc_id, np.frombuffer(ids + end, "<u4")))
            if found:
                yield batch(found)
                found = []
    if found := list(rows(packer.close())):
        yield batch(found)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SIZE, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT) -> DataFrame:
    """Token sequences of docs (doc_id, text): one row per piece (doc_id, start, ids, doc_tokens, sequence_id, offset).

    ids: little-endian unsigned 32-bit ids. A null or empty text is the end id alone. Every row of docs is packed,
    repeated ones too; a null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    return texts(docs).mapInArrow(partial(_pack, tokenizer, end_id, size, open_windows, least_cut), SCHEMA)


def pieces(docs: DataFrame) -> DataFrame:
    """The contract's columns of every piece."""
    return pack(docs).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
