"""Media columns: content-addressed payloads in tar shards, with digest, offset and length beside each row.

A payload is kept as a grayscale image: WIDTH samples a row, 8 bits each, in PNG (lossless; its header states width,
height and depth). Each task writes the payloads of its rows to tar files of about SHARD bytes in the shared folder,
each under its SHA-256 and only once a file; no payload is shuffled. Rows carry the shard, digest, offset and length
of the member's bytes. Metadata columns come from range reads of the first HEAD bytes alone; features, after that,
from the members' bytes. A shard is written whole or not at all, under a name that a retried task repeats.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, open_store, put, table, texts

UNIT, WIDTH, FILL = 576, 576, b"\xff"
SHARD, HEAD, LEVEL = 32 << 20, 33, 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Members of one shard whose answers are remembered while its rows are read.
KEPT = 4096


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """data up to the next positive multiple of unit."""
    return data + FILL * (max(unit, -(-len(data) // unit) * unit) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """Rows of 8-bit gray samples, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">2I5B", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """Width, height and depth from the first HEAD bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    width, height, depth, color, *_ = struct.unpack(">2I5B", head[16:29])
    if (depth, color) != (8, 0):
        raise ValueError("not 8-bit gray")
    return width, height, depth


def read_png(data: bytes) -> np.ndarray:
    """The samples of an image that write_png wrote."""
    width, height, _ = header(data[:HEAD])
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Height, mean, deviation, and the shares (in thousandths) of eight bands of values."""
    bands = np.bincount(samples.reshape(-1) >> 5, minlength=8) * 1000 // samples.size
    return f"{samples.shape[0]}:{samples.mean():.4f}:{samples.std():.4f}:" + ",".join(map(str, bands.tolist()))


class Shard:
    """A tar file in memory, each content once."""

    def __init__(self) -> None:
        self.buffer, self.places = io.BytesIO(), {}
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)

    def add(self, digest: str, data: bytes) -> None:
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(data)
        self.places[digest] = (self.buffer.tell() + 512, len(data))
        self.tar.addfile(info, io.BytesIO(data))

    def close(self) -> bytes:
        self.tar.close()
        return self.buffer.getvalue()


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), 0
    shard, rows, made = Shard(), [], {}

    def flush() -> pa.RecordBatch:
        uri = f"{folder}/part-{part:06d}-{count:05d}.tar"
        places = shard.places
        put(uri, shard.close())
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        full = [(i, n, uri, d, *places[d]) for i, n, d in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full), kinds)], ["doc_id", "n_bytes", "shard", "digest", "offset", "length"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            key = hashlib.blake2b(raw, digest_size=16).digest()
            if (digest := made.get(key)) is None:
                data = write_png(pad(raw))
                digest = made[key] = hashlib.sha256(data).hexdigest()
                if digest not in shard.places:
                    shard.add(digest, data)
            rows.append((doc_id, len(raw), digest))
            if shard.buffer.tell() >= SHARD:
                yield flush()
                shard, rows, made, count = Shard(), [], {}, count + 1
    if rows:
        yield flush()


def store(docs: DataFrame) -> DataFrame:
    """Write the texts of docs (doc_id, text) as media: doc_id, n_bytes, shard, digest, offset, length, one row per row.

    Null texts are empty ones: a payload of FILL alone. Equal texts have one digest and, in one shard, one member.
    Repeated rows and null doc_ids stay; an empty table gives no rows and no shards; other columns are ignored.
    """
    folder = new_folder(docs.sparkSession, "media")
    return materialize(texts(docs).mapInArrow(partial(_write, folder), "doc_id long, n_bytes long, shard string, digest string, offset long, length long"), "media-index")


def _read(whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with what their members' first bytes tell, or what their whole bytes hold."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"] if whole else ["width", "height", "depth"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] if whole else [pa.int64()] * 3
    file, at, known = None, None, {}
    for b in batches:
        found = []
        for uri, digest, offset, length in zip(*(b.column(k).to_pylist() for k in ("shard", "digest", "offset", "length"))):
            if uri != at:
                if file:
                    file.close()
                fs, path = open_store(uri)
                file, at, known = fs.open_input_file(path), uri, {}
            if offset not in known:
                if len(known) >= KEPT:
                    known.clear()
                file.seek(offset)
                data = file.read(length if whole else HEAD)
                row = [] if whole else [*header(data)]
                if whole:
                    samples = read_png(data)
                    payload, stored = samples.tobytes(), hashlib.sha256(data).hexdigest()
                    if stored != digest:
                        raise ValueError(f"{uri} at {offset}: the bytes are not those of {digest}")
                    row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), stored, describe(samples)]
                known[offset] = row
            found.append(known[offset])
        more = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])
    if file:
        file.close()


INDEX = "doc_id long, n_bytes long, shard string, digest string, offset long, length long"
HEADER = "width long, height long, depth long"
WHOLE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def by_shard(index: DataFrame) -> DataFrame:
    """The index dealt out by shards, each read from its start on: tasks share the payloads' bytes evenly, not the index's, by which Spark would join them."""
    spark = index.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return index.repartition(width, "shard").sortWithinPartitions("shard", "offset")


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and depth, of each member's first HEAD bytes alone: one range read a member."""
    return index.mapInArrow(partial(_read, False), f"{INDEX}, {HEADER}")


def features(filled: DataFrame) -> DataFrame:
    """The index with its metadata, and what the members' whole bytes hold: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature."""
    return filled.mapInArrow(partial(_read, True), f"{INDEX}, {HEADER}, {WHOLE}")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features(metadata(by_shard(store(table(spark, sf_dir, "documents")))))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height")
