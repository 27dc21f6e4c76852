"""Token ids in binary files: frequency-ranked ids, one to four bytes each, lengths in separate control bytes.

The token counts of all documents rank the ids, so that the 256 most frequent take one byte. Documents are
range-partitioned and sorted by doc_id; each task writes files of about FILE_BYTES to the shared folder, which are
blocks of about BLOCK_IDS ids one after another:

    magic "RTOK0001", then n_docs, n_ids, control bytes, data bytes (little-endian unsigned 64-bit)
    doc_id of each document (signed 64-bit; the least value stands for null), ids of each (unsigned 32-bit)
    control: two bits per id, low bits first, its length in bytes less one
    data: the rank of each id, low byte first, without its leading zero bytes

beside one vocabulary file, the ids in rank order (unsigned 32-bit). A file is written whole or not at all, under a
name that a retried task repeats. Readers look lengths up by control byte and ids up by rank, in numpy. Writers and
readers hold a block at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, materialize, new_folder, open_store, put, table, texts, writing
from .tokens import Merger

TOKENIZER, END_ID = "word_bpe_49k.json", 1
MAGIC, HEAD, NULL_ID = b"RTOK0001", struct.Struct("<8s4Q"), -(1 << 63)
BLOCK_IDS, FILE_BYTES = 1 << 20, 128 << 20
#: Texts encoded together; parts whose sizes are summed together.
TOGETHER, PARTS = 100, 1000
BYTE = np.arange(4, dtype=np.uint8)
#: control byte -> the lengths of its four ids
LENGTHS = ((np.arange(256)[:, None] >> (2 * BYTE)[None, :]) & 3).astype(np.uint8) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[BYTE[None, :] <= size[:, None]]
    four = np.pad(size, (0, -len(size) % 4)).reshape(-1, 4)
    return (four << (2 * BYTE)).sum(axis=1, dtype=np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[BYTE[None, :] < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _ids(tokenizer: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ids, two bytes each where that is enough; at the end one row with the counts of all ids."""
    encode, end = held(Merger, tokenizer), np.array([end_id], "<u4").tobytes()
    total = np.zeros(1 << 16, np.int64)
    names = ["doc_id", "width", "ids", "counts"]
    for b in batches:
        for part in (b.slice(k, TOGETHER) for k in range(0, b.num_rows, TOGETHER)):
            ids = [i + end for i in encode(part.column(1).to_pylist())]
            flat = np.frombuffer(b"".join(ids), "<u4")
            seen = np.bincount(flat, minlength=len(total))
            total = np.pad(total, (0, len(seen) - len(total)))
            total += seen
            small = len(seen) <= 1 << 16
            if small:
                stops, raw = np.cumsum([0, *(len(i) // 2 for i in ids)]).tolist(), flat.astype("<u2").tobytes()
                ids = [raw[x:y] for x, y in zip(stops, stops[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([2 if small else 4] * len(ids), pa.int8()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int8()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)


def _flat(width: list[int], ids: list[bytes]) -> np.ndarray:
    """The ids of many rows, one after another."""
    if all(w == 2 for w in width):
        return np.frombuffer(b"".join(ids), "<u2").astype("<u4")
    return np.concatenate([np.frombuffer(i, f"<u{w}").astype("<u4") for w, i in zip(width, ids)])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of many tasks as (id, n)."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for counts in b.column(0).to_pylist():
            seen = np.frombuffer(counts, "<i8")
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
    found = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["id", "n"])


def vocabulary(tokenized: DataFrame) -> np.ndarray:
    """The ids in use, most frequent first, ties by id. As many rows at most as the tokenizer has ids."""
    counts = tokenized.select("counts").filter("counts IS NOT NULL").mapInArrow(_sum, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r.id for r in counts.orderBy(F.desc("n"), "id").collect()], "<u4")


def _write(folder: str, ids_by_rank, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab, part = ids_by_rank.value, TaskContext.get().partitionId()
    rank = np.zeros(int(vocab.max(initial=0)) + 1, "<u4")
    rank[vocab] = np.arange(len(vocab), dtype="<u4")

    def blocks() -> Iterator[tuple[bytes, int, int]]:
        """Bytes, documents and ids of each block."""
        doc_ids, widths, rows, n = [], [], [], 0
        for b in batches:
            for doc_id, width, ids in zip(*(b.column(k).to_pylist() for k in range(3))):
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                widths.append(width)
                rows.append(ids)
                n += len(ids) // width
                if n >= BLOCK_IDS:
                    yield block(doc_ids, widths, rows, n)
                    doc_ids, widths, rows, n = [], [], [], 0
        if rows:
            yield block(doc_ids, widths, rows, n)

    def block(doc_ids: list[int], widths: list[int], rows: list[bytes], n: int) -> tuple[bytes, int, int]:
        control, data = encode(rank[_flat(widths, rows)])
        sizes = np.array([len(r) // w for r, w in zip(rows, widths)], "<u4")
        return HEAD.pack(MAGIC, len(rows), n, len(control), len(data)) + np.array(doc_ids, "<i8").tobytes() + sizes.tobytes() + control + data, len(rows), n

    made, more = [], blocks()
    first = next(more, None)
    while first:
        name, at, n_docs, n_ids = f"{folder}/part-{part:06d}-{len(made):05d}.tok", 0, 0, 0
        with writing(name) as out:
            while first and at < FILE_BYTES:
                out.write(first[0])
                at, n_docs, n_ids = at + len(first[0]), n_docs + first[1], n_ids + first[2]
                first = next(more, None)
        made.append((name, part, len(made), n_docs, n_ids))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], ["uri", "part", "number", "n_docs", "n_ids"])


def with_base(files: DataFrame) -> DataFrame:
    """files (part, number, n_ids) with base: the ids in all files before. Files are summed by PARTS parts, so that only these sums meet in one task."""
    files = files.withColumn("block", F.floor(F.col("part") / PARTS))
    sums = files.groupBy("block").agg(F.sum("n_ids").alias("in_block"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("block", before("in_block", Window.orderBy("block")).alias("start"))
    inside = before("n_ids", Window.partitionBy("block").orderBy("part", "number"))
    return files.withColumn("base", inside).join(starts, "block").withColumn("base", F.col("base") + F.col("start")).drop("block", "start")


def write_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Write the ids of docs (doc_id, text) in ascending doc_id order; returns the folder and its manifest.

    The manifest has a row per file (uri, part, number, n_docs, n_ids, base: ids in all files before). Null texts
    are empty: the end id alone. Null doc_ids come first, rows that share a doc_id stand in an order of their ids.
    An empty table gives no file but the vocabulary. Other columns are ignored. Texts are encoded once: the ids
    are written, with each task's counts, before they are sorted.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    tokenized = materialize(texts(docs).mapInArrow(partial(_ids, tokenizer, end_id), "doc_id long, width byte, ids binary, counts binary"), "ids", compression="zstd")
    vocab = vocabulary(tokenized)
    put(f"{folder}/vocabulary.u32", vocab.tobytes())
    ordered = tokenized.filter("counts IS NULL").drop("counts").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    written = materialize(ordered.mapInArrow(partial(_write, folder, spark.sparkContext.broadcast(vocab)), "uri string, part long, number long, n_docs long, n_ids long"), "token-manifest")
    return folder, with_base(written)


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, path = open_store(folder)
    with fs.open_input_file(f"{path}/vocabulary.u32") as f:
        vocab = np.frombuffer(f.read(), "<u4")
    for b in batches:
        for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, path = open_store(uri)
            with fs.open_input_file(path) as f:
                while head := f.read(HEAD.size):
                    magic, n_docs, n_ids, n_control, n_data = HEAD.unpack(head)
                    if magic != MAGIC:
                        raise ValueError(f"{uri} is not a token file")
                    doc_ids, sizes = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(4 * n_docs), "<u4")
                    ids = vocab[decode(f.read(n_control), f.read(n_data), n_ids)]
                    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
                    raw = pa.Array.from_buffers(pa.large_binary(), n_docs, [None, pa.py_buffer(4 * ends), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(ends[:-1] + base), pa.array(sizes.astype(np.int64)), raw.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    base += n_ids


def read_ids(folder: str, manifest: DataFrame) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    spark = manifest.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("uri", "base").repartition(width, "uri").mapInArrow(partial(_read, folder), "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_ids(*write_ids(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
