"""Substring dedup by levels of windows.

A window of `width` words is gone from a document if the same words also start in a document with a smaller doc_id.
Levels look at runs of `first` words, then of twice as many, and so on up to the window itself. At each level the run
with the least hash stands for the windows that hold it (equal windows have the same one), so only a part of all
places is counted. A run met once ends there. Otherwise the windows it stands for form a neighbourhood: where all
neighbourhoods of a run are equal, all its windows are, and the least doc_id has them first; where they differ, the
first document of each goes on to runs of twice the length, and the others lose its windows. The loop ends when no
windows are left, at the latest with runs as long as the window, whose neighbourhood is the window alone.

Rows carry 64-bit hashes and places; each level counts by partial aggregation and finds its rows again by a join,
whose hot keys Spark can split. Texts are shuffled by doc_id for windows that go on, and for the cut.
A window is known by the hash of its run and that of its words, 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small, table, texts, unused

WIDTH, FIRST = 13, 4
#: Words whose hashes are worked out together, beside a longer document's own.
WORDS = 20_000
#: Odd multipliers: of runs, and of neighbourhoods, so that a window's two hashes are independent.
RUN, NEAR = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """The words of documents in a row and the hashes of ranges of them, each a difference of two sums from the first word on."""

    def __init__(self, texts_: list[list[bytes]], width: int) -> None:
        self.width = width
        sizes = np.fromiter(map(len, texts_), np.int64, len(texts_))
        self.start = np.cumsum(sizes) - sizes
        self.windows = np.maximum(sizes - width + 1, 0)
        words = [w for text in texts_ for w in text]
        hashes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        self.sums, self.back = {}, {}
        for base in (RUN, NEAR):
            self.sums[base] = np.append(np.uint64(0), np.cumsum(h * powers(len(h), base)))
            self.back[base] = powers(len(h), pow(base, -1, 1 << 64))

    def runs(self, length: int) -> np.ndarray:
        """Hashes of all runs of so many words."""
        total = self.sums[RUN][length:] - self.sums[RUN][:-length]
        return mixed(total * self.back[RUN][: len(total)] + np.uint64(length))

    def places(self, spans: list[list[int]] | None) -> np.ndarray:
        """Windows of each document's spans (None: all windows), ascending, each once; none that a document is too short for."""
        if spans is None:
            first, count, text = self.start, self.windows, None
        else:
            flat = np.concatenate([np.asarray(s, np.int64) for s in spans])
            text = np.repeat(np.arange(len(spans)), np.fromiter(map(len, spans), np.int64, len(spans)))
            first, count = flat >> 6, np.minimum((flat & 63) + 1, self.windows[text] - (flat >> 6))
            first, count = (first + self.start[text])[count > 0], count[count > 0]
        out = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return out if spans is None else np.unique(out)

    def anchors(self, length: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs that stand for the windows: hash, place, first window of each and how many follow it."""
        runs = self.runs(length)
        view = np.lib.stride_tricks.sliding_window_view(runs, self.width - length + 1)
        at = view[windows].argmin(axis=1) + windows
        start = np.nonzero(np.append(True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)))[0]
        return runs[at[start]], at[start], windows[start], np.diff(np.append(start, len(at))) - 1

    def neighbourhoods(self, at: np.ndarray, first: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Hashes of all words of the windows that each run stands for, and where it is in them."""
        total = (self.sums[NEAR][first + more + self.width] - self.sums[NEAR][first]) * self.back[NEAR][first]
        return mixed(total ^ mixed(((at - first) * 64 + more).astype(np.uint64)))


def _runs(width: int, length: int, ids: list[int], texts_: list[list[bytes]], spans: list[list[int]]) -> pa.RecordBatch | None:
    w = Windows(texts_, width)
    windows = w.places(spans or None)
    if not len(windows):
        return None
    run, at, first, more = w.anchors(length, windows)
    text = np.searchsorted(w.start, first, "right") - 1
    columns = np.array(ids, np.int64)[text], run.view(np.int64), w.neighbourhoods(at, first, more).view(np.int64), (first - w.start[text]) * 64 + more
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "run", "near", "span"])


def _level(width: int, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a level over documents (doc_id, text, and past the first level the spans of windows that go on), some thousands of words at a time."""
    ids, texts_, spans, held_ = [], [], [], 0
    with np.errstate(over="ignore"):
        for part in small(batches):
            for doc_id, text, *open_ in zip(*(c.to_pylist() for c in part.columns)):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < width:
                    continue
                ids.append(doc_id)
                texts_.append(words)
                spans.extend(open_)
                held_ += len(words)
                if held_ >= WORDS:
                    out = _runs(width, length, ids, texts_, spans)
                    if out:
                        yield out
                    ids, texts_, spans, held_ = [], [], [], 0
        out = _runs(width, length, ids, texts_, spans) if ids else None
        if out:
            yield out


def repeated(docs: DataFrame, width: int = WIDTH, first: int = FIRST) -> DataFrame:
    """(doc_id, spans): per document the runs of windows that start in a smaller document too, as first * 64 + further windows."""
    given = texts(docs).filter("doc_id IS NOT NULL")
    schema = "doc_id long, run long, near long, span long"
    length, texts_, gone = min(first, width), given, []
    while True:
        runs = texts_.mapInArrow(partial(_level, width, length), schema)
        if gone:
            runs = materialize(runs, "runs")
        seen = runs.groupBy("run").agg(F.count("*").alias("times"), F.min("doc_id").alias("first"), F.min("near").alias("a"), F.max("near").alias("b")).filter("times > 1")
        # written first: then both sides of the join are dealt out for it alone, and Spark can split a hot run
        seen = materialize(seen.select("run", "first", (F.col("a") != F.col("b")).alias("apart")), "seen")
        met = materialize(runs.join(seen, "run").filter("apart OR doc_id > first"), "met")
        gone.append(met.filter("NOT apart").select("doc_id", "span"))
        apart = met.filter("apart").select("doc_id", "run", "near", "span")
        least = materialize(apart.groupBy("run", "near").agg(F.min("doc_id").alias("least")), "least")
        settled = materialize(apart.join(least, ["run", "near"]), "neighbourhoods")
        gone.append(settled.filter("doc_id > least").select("doc_id", "span"))
        on = settled.filter("doc_id = least")
        if length == width or on.isEmpty():
            break
        length = min(2 * length, width)
        on = on.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))  # as many as a document has
        texts_ = given.join(on, "doc_id").select("doc_id", "text", "spans")
    return reduce(DataFrame.unionAll, gone).groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def cut(text: str | None, spans, width: int) -> tuple[int, int, str]:
    """Words, words removed, and the words that are left."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    spans = np.asarray(spans, np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, spans >> 6, 1)
    np.add.at(edge, (spans >> 6) + (spans & 63) + width, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "surrogatepass")


def drop_repeated(docs: DataFrame, width: int = WIDTH, name: str = "kept_words") -> DataFrame:
    """docs with a struct column `name` (n_words, n_removed, text: the words left, joined by spaces) beside its own.

    Null and empty texts have no words. Rows that share a doc_id are one document to others; each is cut by the
    windows of all of them. Rows with a null doc_id neither give nor lose windows. An empty table gives no rows.
    width: 2 to 60 words. The result is the last column; where docs has one of its name, underscores follow the name.
    """

    def words(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, s, width) for t, s in zip(text, spans)], columns=["n_words", "n_removed", "text"])

    name = unused(docs, name)
    id_, spans = unused(docs, "id_of_spans"), unused(docs, "spans_of_id")
    found = repeated(docs, width).select(F.col("doc_id").alias(id_), F.col("spans").alias(spans))
    both = docs.join(found, F.col("doc_id") == F.col(id_), "left")
    return both.withColumn(name, F.pandas_udf(words, "n_words long, n_removed long, text string")("text", spans)).drop(id_, spans)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated(texts(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "kept_words.n_words", "kept_words.n_removed", F.sha2(F.col("kept_words.text").cast("binary"), 256).alias("kept_sha256"))
