"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits is a ring of 16 segments of 4 bits. If two fingerprints differ in at most 3 bits, then
from some segment on every chain of l segments differs in at most 3 l / 16 bits: the first 5 segments not at all,
the first 10 in one bit at most, the first 15 in two at most. So each fingerprint is rotated to each of the 16
starts; one of the two halves of segments 6 to 10 must then agree too, and the key of a start is 20 + 10 bits.
Fingerprints that share a key are candidates; the chain's budgets prune them before the full Hamming check.

Only distinct fingerprints are compared, so exact copies cost nothing. Large groups of near copies are first tied
to the least and greatest fingerprint of each key (one comparison a row). The second, complete pass takes only keys
that still hold fingerprints of several components, and compares those of different ones: pairs within a component,
however large, are neither listed nor met.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dealt, materialize, table, texts

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of hashes that are unpacked to bits at once.
BLOCK = 1 << 14


def fingerprint(text: str, width: int = 3, hashed=partial(xxhash.xxh64_intdigest, seed=42)) -> int:
    """SimHash of the word shingles, repeats included: a bit is 1 if it is set in over half the hashes. No words: 0."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    rows = list(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(hashed, rows), np.uint64, len(rows))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def _fingerprints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(t, width) for t in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs."""
    return texts(docs).mapInArrow(partial(_fingerprints, width), "doc_id long, fp long")


def differing(a: str, b: str, bits: int = 64) -> Column:
    """In how many of their leading bits two columns differ."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(x if bits == 64 else F.shiftrightunsigned(x, 64 - bits))


def _starts(fps: DataFrame, *also: str) -> DataFrame:
    """One row per fingerprint, start of the ring and half: key (long), rot (the fingerprint rotated to the start)."""
    fp = F.col("fp")
    turns = F.array(*[F.struct(F.lit(i).alias("start"), (F.shiftleft(fp, 4 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 4 * i)) if i else fp).alias("rot")) for i in range(16)])
    one = fps.select("fp", *also, F.inline(turns))
    head, mid = F.shiftrightunsigned("rot", 44), F.shiftrightunsigned(F.shiftleft("rot", 20), 44)
    halves = F.array(F.shiftrightunsigned(mid, 10), mid.bitwiseAND(F.lit(1023)))
    return one.select("fp", *also, "rot", "start", head.alias("head"), F.posexplode(halves).alias("half", "part")).select(
        "fp", *also, "rot", (((F.col("head") * 1024 + F.col("part")) * 16 + F.col("start")) * 2 + F.col("half")).alias("key")
    )


def linked(fps: DataFrame) -> DataFrame:
    """(fp, root) for distinct fingerprints fps: root is the least fingerprint reachable over links of 3 or fewer differing bits. Rows only for fingerprints that are not their own root."""
    near = lambda: (differing("rot", "rot2", 40) <= 1) & (differing("rot", "rot2", 60) <= 2) & (differing("rot", "rot2") <= 3)
    keyed = _starts(fps)
    ends = keyed.groupBy("key").agg(F.min("rot").alias("a"), F.max("rot").alias("b"), F.min_by("fp", "rot").alias("fa"), F.max_by("fp", "rot").alias("fb")).filter("a <> b")
    # keys are many times as many as fingerprints, which plans don't see: no side of their joins is to be broadcast
    ends = dealt(ends.select("key", F.inline(F.array(F.struct(F.col("a").alias("rot2"), F.col("fa").alias("v")), F.struct(F.col("b").alias("rot2"), F.col("fb").alias("v"))))))
    stars = keyed.join(ends, (keyed.key == ends.key) & near() & (F.col("fp") != F.col("v"))).select(F.col("fp").alias("u"), "v")
    first = components(stars)
    tied = materialize(fps.join(first.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root")), "tied")
    keyed = _starts(tied, "root")
    open_keys = keyed.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v")).filter("u <> v").select("key")
    rows = materialize(keyed.join(dealt(open_keys), "key", "left_semi").select("key", "rot", "root"), "unsettled")
    roots = rows.select("key", "root").distinct()
    apart = roots.withColumnRenamed("root", "u").join(dealt(roots.withColumnRenamed("root", "v")), "key").filter("u < v")
    one, two = rows.withColumnRenamed("root", "u"), rows.withColumnsRenamed({"root": "v", "rot": "rot2"})
    more = apart.join(dealt(one), ["key", "u"]).join(dealt(two), ["key", "v"]).filter(near()).select("u", "v").distinct()
    second = components(more)
    return tied.join(second.withColumnRenamed("u", "root"), "root", "left").select("fp", F.coalesce("v", "root").alias("root")).filter("fp <> root")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """SimHash classes of docs (doc_id, text): doc_id, fp, component_id (the least doc_id reachable over links of 3 or fewer differing bits).

    One row per row of docs. Null and empty texts, and texts of white space, have fingerprint 0 and link like
    any other. A repeated doc_id has a row for each of its rows; a null doc_id is never a component_id unless
    nothing else is in the component. An empty table gives no rows. Other columns are ignored.
    """
    found = materialize(fingerprints(docs, width), "fingerprints")
    least = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = materialize(least.join(linked(least.select("fp")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    part = root.groupBy("root").agg(F.min("least").alias("component_id"))
    # one row a fingerprint from here on; the join with the documents is the only one with hot keys, and Spark splits those
    classes = materialize(root.join(part, "root").select("fp", "component_id"), "classes")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
