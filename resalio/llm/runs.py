"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, of at least TIMES * q and LEAST words, that no neighbouring word
extends. At a scale of t words every place has the hash of its next t words, but for places whose next t words have a
period of t / 3 or less. A place is chosen if the least hash among it and the t places after it is its own or the last
one's: what is chosen depends on the 2 t words from there alone, so a run chooses the same places in each of its
periods, and at least one of any t places in a row, unless these are highly periodic. Chosen places with equal
contexts of 2 t words propose their distance as a period; at scale t a run with a period from 1.5 t to under 3 t is
always proposed. Scales are 4, 8, 16, ... words; runs with periods of up to 8 words, which chosen places leave out
(they are the highly periodic regions of LEAST words), are found by themselves, as stretches of words that equal the
word a period on. Proposals are compared word by word and extended both ways, so hashes decide nothing in the end.

Documents are judged by themselves, without a shuffle; a task puts those of a batch one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import small, table, texts, unused

#: Least words of a run, and least number of its periods; the smallest scale, and the largest period that is found without chosen places.
LEAST, TIMES, SCALE, SMALL = 24, 3, 4, 8
#: Words that are put together at most (a longer document is alone).
TOGETHER = 100_000
NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads them, always below NONE for what is hashed here."""
    x = x.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.minimum(x, NONE - np.uint64(1))


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xD6E8FEB86659FD93)))


def _equal_stretches(codes: np.ndarray, p: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of stretches with period p in which `least` words in a row or more equal the word p on."""
    differ = np.flatnonzero(codes[:-p] != codes[p:])
    edges = np.concatenate([[-1], differ, [max(0, len(codes) - p)]])
    k = np.flatnonzero(np.diff(edges) > least)
    return edges[k] + 1, edges[k + 1] + p


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Leading entries that are equal."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 4 * step
    return n


def _primitive(codes: np.ndarray, start: int, q: int) -> bool:
    """Whether q, a period of 2 q words from start at least, is their smallest one."""
    rest, d = q, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            p = q // d
            if np.array_equal(codes[start : start + q], codes[start + p : start + p + q]):
                return False
            while rest % d == 0:
                rest //= d
        d += 1
    return True


def _synchronising(ids: np.ndarray, tau: int) -> np.ndarray:
    """Places whose least id among themselves and the tau places after is their own or the last one's."""
    low, width = ids, 1
    while width < tau:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[:-1], low[1:])
    return np.flatnonzero((low < NONE) & ((low == ids[:-tau]) | (low == ids[tau:])))


def _proposals(codes: np.ndarray, hashes: np.ndarray, half: np.ndarray, regions: np.ndarray, tau: int) -> np.ndarray:
    """(period, place) that equal contexts of chosen places propose, ordered, with each period from 1.5 tau to 3 tau."""
    ids = hashes
    dense = regions[(regions[:, 2] <= tau // 3) & (regions[:, 1] - regions[:, 0] >= tau)]
    dense = dense[dense[:, 0] < len(ids)]
    if len(dense):
        steps = np.zeros(len(ids) + 1, np.int64)
        np.add.at(steps, dense[:, 0], 1)
        np.add.at(steps, np.minimum(dense[:, 1] - tau + 1, len(ids)), -1)
        ids = np.where(np.cumsum(steps[:-1]) > 0, NONE, hashes)
    at = _synchronising(ids, tau)
    context = _join(hashes[at], hashes[at + tau])
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    found, k = [np.empty((0, 2), np.int64)], 1
    while True:
        apart = at[k:] - at[:-k]
        near = np.flatnonzero((context[k:] == context[:-k]) & (apart < 3 * tau))
        if not len(near):
            break
        near = near[2 * apart[near] >= 3 * tau]
        found.append(np.column_stack([apart[near], at[near]]))
        k += 1
    found = np.concatenate(found)
    # two periods of words that equal the word a period on reach half a scale beyond the context on one side
    q, i = found[:, 0], found[:, 1]
    last, side = len(half) - 1, tau // 2
    before, after = np.maximum(i - side, 0), np.minimum(i + 2 * tau, last)
    good = (half[before] == half[np.minimum(before + q, last)]) | (half[after] == half[np.minimum(after + q, last)])
    found = np.unique(found[good], axis=0) if good.any() else found[:0]
    return found


def find_runs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, end, period) of every run in documents put one after another, ordered by start, then period.

    codes: a number for each word, equal for equal words, and one that occurs once after each document; ends: the
    places after those, of the longest document first.
    """
    sizes = np.diff(ends, prepend=0) - 1
    regions, runs = [], []
    for p in range(1, SMALL + 1):
        if len(codes) > p:
            start, end = _equal_stretches(codes, p, (TIMES - 1) * p)
            regions.append(np.column_stack([start, end, np.full(len(start), p)]))
            runs += [(s, e, p) for s, e in zip(start.tolist(), end.tolist()) if e - s >= max(LEAST, TIMES * p) and _primitive(codes, s, p)]
    known = np.concatenate(regions) if regions else np.empty((0, 3), np.int64)
    half = hashes = _mix(codes.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < SCALE:
        half, hashes, width = hashes, _join(hashes[:-width], hashes[width:]), 2 * width
    tau = SCALE
    while True:
        here = int(np.searchsorted(-sizes, -max(LEAST, -(-TIMES * 3 * tau // 2)), "right"))  # documents that a run of this scale fits in
        if not here:
            break
        n = int(ends[here - 1])
        codes, hashes, half = codes[:n], hashes[: n - tau + 1], half[: n - tau // 2 + 1]
        new, last_q, last_end = [], 0, 0
        for q, i in _proposals(codes, hashes, half, known, tau).tolist():
            if q == last_q and i < last_end:
                continue
            start = i - _agree(codes[:i][::-1], codes[: i + q][::-1])
            last_q, last_end = q, i + _agree(codes[i:], codes[i + q :])
            if last_end - start >= (TIMES - 1) * q:
                new.append((start, last_end + q, q))
                if q > SMALL and last_end + q - start >= LEAST and _primitive(codes, start, q):
                    runs.append(new[-1])
        if new:
            known = np.concatenate([known, np.array(new, np.int64)])
        half, hashes, tau = hashes, _join(hashes[:-tau], hashes[tau:]), 2 * tau
    out = np.array(runs, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _together(rows: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """(runs as start, length, period; words that are kept) of each document's words."""
    order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
    known: dict[bytes, int] = {}
    codes = np.empty(sum(map(len, rows)) + len(rows), np.int64)
    starts, at = np.empty(len(rows) + 1, np.int64), 0
    for j, k in enumerate(order):
        starts[j] = at
        codes[at : at + len(rows[k])] = [known.setdefault(w, len(known)) for w in rows[k]]
        at += len(rows[k]) + 1
        codes[at - 1] = -1 - j
    starts[-1] = at
    found = find_runs(codes, starts[1:])
    owner = np.searchsorted(starts, found[:, 0], "right") - 1
    out: list = [([], rows[k]) for k in range(len(rows))]
    for j in np.unique(owner).tolist():
        k, base = order[j], int(starts[j])
        runs = found[owner == j] - np.array([base, base, 0])
        steps = np.zeros(len(rows[k]) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 1], -1)
        stay = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
        out[k] = [(s, e - s, q) for s, e, q in runs.tolist()], [rows[k][i] for i in stay.tolist()]
    return out


_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
_FOUND = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN)), StructField("text", StringType())])
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("text", pa.string())])


def _groups(texts_: list[str | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for t in texts_:
        words = (t or "").encode().split()
        if group and size + len(words) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        found = []
        for group in _groups(b.column("text").to_pylist()):
            for words, (runs, kept) in zip(group, _together(group)):
                found.append({"n_words": len(words), "runs": [dict(zip(_RUN.names, r)) for r in runs], "text": b" ".join(kept).decode()})
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _ARROW)], [*b.schema.names, "found"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with one more column, `periodic` (underscores follow where docs has it): n_words, the runs (start, length, period, by start, then period) and the text of the words that no run repeats, joined by a space.

    A word is left out if a run holds it after its first period. Null and empty texts have no words, no runs and an
    empty text. Repeated rows and null doc_ids are judged like any others; an empty table gives no rows. Texts of any
    length are judged whole, in memory in proportion to them.
    """
    name = unused(docs, "periodic")
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = plain.mapInArrow(_detect, StructType([*plain.schema.fields, StructField("found", _FOUND)]))
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.col("found").alias(name))


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id, text with one text in ten made periodic from a place on, as its id's crc32 says: h % 10 = 0, g = h / 10, from word a = g % n on repeating 1 + (n - a) / (3 + g % 8) words. Rows with a null doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    some = texts(docs).select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    a = F.pmod("g", n)
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    some = some.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, a).cast("int").alias("a"), F.when(n > 0, p).cast("int").alias("p"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(rewritten(table(spark, sf_dir, "documents"))).select("doc_id", "periodic.*")
    # the greatest exact quotient, of equal ones the first by start, then period
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(_RUN), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words")
    return found.select("doc_id", "n_runs", "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
