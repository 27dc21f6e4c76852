"""Near copies by the Jaccard similarity of word shingles.

A document is its set of shingles (WIDTH words, as 64-bit hashes). Two are near copies if their sets have a
similarity of ALIKE or more. Candidates come from two methods, and every one is then judged by the sets themselves.

The first is op7's: SimHash fingerprints, linked by pigeonring at 3 or fewer of 64 bits; each set is a candidate with
one of its fingerprint's class. It reaches few pairs near 0.8: there some 10 bits differ, up to 17 in one pair of a
hundred, and no chain of segments that allows so many is selective. And it links what isn't alike, as texts that repeat
the same passage. So, second, candidates share one of BANDS keys of ROWS min-hashes each: a pair at 0.8 has none in
common with a probability of 3 in a million.

Only distinct sets are compared. Large groups are first tied to a set of their fingerprints' class and to the least and
greatest set of each key; the second, complete pass takes only keys that still hold sets of several components, and
compares those of different ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dealt, forget, materialize, small, texts
from .simhash import LOWER, fingerprint
from .simhash import linked as linked_fingerprints

WIDTH, BANDS, ROWS = 5, 32, 5
#: The least similarity, as a fraction.
ALIKE = (4, 5)
#: Shingles that are hashed for all bands at once.
BLOCK = 1 << 12
_SEEDS = np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
FACTORS, TERMS = _SEEDS[0] | np.uint64(1), _SEEDS[1]


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's distinct shingles, ordered; of fewer than width words they are one shingle, of none there is none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    rows = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, rows), np.uint64))


def keys(found: np.ndarray) -> list[int]:
    """A key for each band: a hash of the band's number and its min-hashes."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        h = found[at : at + BLOCK, None] * FACTORS + TERMS
        h ^= h >> np.uint64(32)
        np.minimum(least, (h * FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _fp(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _keyed(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in small(batches):
        rows = [(_fp(s), len(s), keys(s), fingerprint(t)) for t in b.column(1).to_pylist() for s in (shingles(t, width),)]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "fp", "size", "keys", "print"])


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        sets = [shingles(t, width) for t in b.column(0).to_pylist()]
        offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        flat = pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(map(_fp, sets), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["fp", "shingles"])


def _confirmed(pairs: DataFrame, least: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those of pairs (a, b) of fingerprints, with their other columns, whose sets are alike. Only the texts of these are read again."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(least.select("fp", "least"), "fp").select("least").distinct(), "wanted")
    read = texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).select("text")
    sets = materialize(read.mapInArrow(partial(_sets, width), "fp long, shingles array<long>").dropDuplicates(["fp"]), "shingle-sets")
    mine, other = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))
    both = pairs.join(mine, "a").join(other, "b")
    part, whole = ALIKE
    return both.filter((part + whole) * F.size(F.array_intersect("of_a", "of_b")) >= part * (F.size("of_a") + F.size("of_b"))).drop("of_a", "of_b")


def fingerprint_pairs(least: DataFrame) -> DataFrame:
    """(a, b, size, size2): each of the distinct sets (fp, size, print) with the least set of its fingerprint's class, op7's links of 3 or fewer bits."""
    prints = materialize(least.select(F.col("print").alias("fp")).distinct(), "prints")
    classes = linked_fingerprints(prints).withColumnRenamed("fp", "print")
    of = materialize(least.select("fp", "size", "print").join(classes, "print", "left").select("fp", "size", F.coalesce("root", "print").alias("class")), "print-classes")
    ends = materialize(of.groupBy("class").agg(F.min("fp").alias("b"), F.min_by("size", "fp").alias("size2"), F.max("fp").alias("last")).filter("b <> last").drop("last"), "print-ends")
    return of.join(ends, "class").filter("fp <> b").select(F.col("fp").alias("a"), "b", "size", "size2")


def linked(least: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(fp, root) for the distinct sets of docs (fp, size, keys, print, least: their least doc_id): root is the least fp reachable over links. Rows only for those that are not their own root."""
    part, whole = ALIKE
    near = whole * F.least("size", "size2") >= part * F.greatest("size", "size2")
    keyed = least.select("fp", "size", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.min_by("size", "fp").alias("low_size"), F.max_by("size", "fp").alias("high_size")).filter("low <> high")
    ends = ends.select("key", F.inline(F.array(F.struct(F.col("low").alias("b"), F.col("low_size").alias("size2")), F.struct(F.col("high").alias("b"), F.col("high_size").alias("size2")))))
    # keys are many times as many as sets, which plans don't see: no side of their joins is to be broadcast
    stars = keyed.join(dealt(ends), "key").filter(near & (F.col("fp") != F.col("b"))).select(F.col("fp").alias("a"), "b")
    stars = materialize(fingerprint_pairs(least).filter(near).select("a", "b").unionAll(stars).distinct(), "stars")
    first = components(_confirmed(stars, least, docs, width).select(F.col("a").alias("u"), F.col("b").alias("v")))
    tied = materialize(least.join(first.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "size", "keys", F.coalesce("v", "fp").alias("root")), "tied")
    keyed = tied.select("fp", "size", "root", F.explode("keys").alias("key"))
    open_keys = keyed.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v")).filter("u <> v").select("key")
    rows = materialize(keyed.join(dealt(open_keys), "key", "left_semi"), "unsettled")
    roots = rows.select("key", "root").distinct()
    apart = roots.withColumnRenamed("root", "u").join(dealt(roots.withColumnRenamed("root", "v")), "key").filter("u < v")
    # sets of one component are never met; pairs that were judged with a star go too
    met = apart.join(dealt(rows.withColumnsRenamed({"root": "u", "fp": "x"})), ["key", "u"]).join(dealt(rows.withColumnsRenamed({"root": "v", "fp": "y", "size": "size2"})), ["key", "v"]).filter(near)
    more = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "u", "v").distinct()
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(more.join(known, ["a", "b"], "left_anti"), "more")
    second = components(_confirmed(more, least, docs, width).select("u", "v"))
    return tied.join(second.withColumnRenamed("u", "root"), "root", "left").select("fp", F.coalesce("v", "root").alias("root")).filter("fp <> root")


def near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Classes of docs (doc_id, text) over links of a similarity of ALIKE or more: doc_id, component_id (the least doc_id of the class).

    One row per row of docs. Null and empty texts, and texts of white space, are one class. A null doc_id is never a
    component_id unless nothing else is in the class. An empty table gives no rows. Other columns are ignored.
    """
    found = materialize(texts(docs).mapInArrow(partial(_keyed, width), "doc_id long, fp long, size long, keys array<long>, print long"), "min-hashes")
    least = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("print").alias("print")), "distinct-sets")
    root = materialize(least.join(linked(least, docs, width), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    part = root.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(root.join(part, "root").select("fp", "component_id"), "classes")
    return found.select("doc_id", "fp").join(classes, "fp").select("doc_id", "component_id")
