"""What the corpus operators share: the tables, the shared folder, materialised steps, components."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dealt, materialize, new_folder, open_store

__all__ = ["SPACES", "components", "dealt", "forget", "held", "materialize", "new_folder", "open_store", "put", "small", "table", "texts", "unused", "writing"]

#: ASCII white space; words are what stands between.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, through Spark's own reader (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is an empty one. Other columns, whatever their names, go no further."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Models that a worker keeps, whatever operators its tasks belong to.
MODELS = 1
_models: OrderedDict = OrderedDict()


def held(make: Callable, *args):
    """make(*args), one per worker: what it remembers serves all tasks there until another operator's model is asked for."""
    key = (make, *args)
    if key not in _models:
        forget(MODELS - 1)
        _models[key] = make(*args)
    _models.move_to_end(key)
    return _models[key]


def forget(but: int = 0) -> None:
    """Drop the models of other operators' tasks, as workers outlive stages."""
    while len(_models) > but:
        _models.popitem(last=False)
    pa.default_memory_pool().release_unused()


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it where the table has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: what a task makes of a batch is held at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


@contextmanager
def writing(uri: str) -> Iterator:
    """A file to write, which is there whole or not at all: a retried or speculative task replaces it with the same bytes."""
    fs, path = open_store(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


def put(uri: str, data: bytes) -> None:
    """Write a file at once."""
    with writing(uri) as out:
        out.write(data)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v): one row (u, v) per node that has links but isn't its component's least node; v is that least node.

    Large-star and small-star steps in turn: each links a node's neighbours to the least node near it, so
    depth shrinks by squaring and no node's neighbours are gathered in one place. Every round is written to
    the shared folder. An empty edge table gives no rows; loops, repeats and both directions are allowed.
    """
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:
            return e
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
