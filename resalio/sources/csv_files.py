"""CSV catalogs, however many files (S1): each file is parsed where it is read, by its own separator and encoding."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import open_store

SEPARATORS = [",", ";", "\t", "|"]
ENCODINGS = ["utf-8", "ISO-8859-1"]
#: Records that leave a task at once.
ROWS = 5_000
# Texts that stand for no value.
NO_VALUE = frozenset(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
ROW = "catalog_id string, status string, sep string, encoding string, row_idx int, cells array<string>"


def decoded(content: bytes) -> tuple[str, str]:
    """A file's text without a byte order mark, and its encoding: UTF-8 if all of it is."""
    for encoding in ENCODINGS[:-1]:
        try:
            return content.decode(encoding).removeprefix("﻿"), encoding
        except UnicodeDecodeError:
            continue
    return content.decode(ENCODINGS[-1]), ENCODINGS[-1]


def records(text: str, sep: str) -> Iterator[list[str]]:
    """Records that aren't blank lines; quoted cells may hold separators and line ends."""
    return (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r)


def dialect(text: str) -> str | None:
    """The first separator that gives a header of two columns or more and no record with more cells than the header."""
    for sep in SEPARATORS:
        found = records(text, sep)
        width = len(next(found, []))
        try:
            if width >= 2 and all(len(r) <= width for r in found):
                return sep
        except csv.Error:
            continue
    return None


def named(header: list[str]) -> list[str]:
    """Column names, each once: blank ones by their place, repeated ones numbered."""
    out: list[str] = []
    for k, name in enumerate(header):
        name, n = name or f"Unnamed: {k}", 0
        while (own := f"{name}.{n}" if n else name) in out:
            n += 1
        out.append(own)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(sys.maxsize)
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
    names = ["catalog_id", "status", "sep", "encoding", "row_idx", "cells"]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)
    rows: list[tuple] = []
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            text, encoding = decoded(content.as_buffer().to_pybytes())
            sep = dialect(text)
            if sep is None:
                rows.append((path, "FAILED", None, encoding, None, None))
            for k, cells in enumerate(records(text, sep) if sep else ()):
                width = len(cells) if k == 0 else width
                filled = named(cells) if k == 0 else [None if c in NO_VALUE else c for c in cells] + [None] * (width - len(cells))
                rows.append((path, "OK", sep, encoding, k, filled))
                if len(rows) >= ROWS:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


def read_csv_files(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of CSV files: catalog_id (the file's path), status, sep, encoding, row_idx (0: the header) and cells (as many as the header has, null where there is no value).

    One scan, whatever the number of files and of their headers; a task holds one file at a time. The driver holds the
    files' names, as Spark's readers list them: for hundreds of thousands of files there is read_csv_folders. A file without a dialect, or without a record, is one row: FAILED, without cells. Files
    of no length at all are passed over, as Spark's readers do.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("catalog_id"), "content")
    return files.mapInArrow(_parse, ROW)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for folder in b.column(0).to_pylist():
            fs, path = open_store(folder)
            found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File and i.size and not i.base_name.startswith(("_", "."))]
            yield pa.RecordBatch.from_arrays([pa.array([folder] * len(found), pa.string()), pa.array(found, pa.string())], ["folder", "name"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for folder, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, path = open_store(folder)
            with fs.open_input_stream(f"{path}/{name}", compression=None) as file:
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"], pa.string()), pa.array([file.read()], pa.large_binary())], ["catalog_id", "content"])


def read_csv_folders(folders: DataFrame) -> DataFrame:
    """What read_csv_files gives, of the files in folders (folder: a URI, files without folders below), however many.

    Tasks list the folders, one each, and read the files: no name of a file reaches the driver. As in Spark's readers,
    files of no length and those whose names begin with _ or . are passed over.
    """
    files = folders.select("folder").repartition("folder").mapInArrow(_names, "folder string, name string")
    return files.repartition("folder", "name").mapInArrow(lambda batches: _parse(_contents(batches)), ROW)


def csv_dialects(spark: SparkSession, *paths: str) -> DataFrame:
    """catalog_id, sep, encoding, status (FAILED or OK) and number of records of each file."""
    rows = read_csv_files(spark, *paths)
    return rows.groupBy("catalog_id").agg(*[F.first(c).alias(c) for c in ("sep", "encoding", "status")], F.count_if(F.col("row_idx") > 0).alias("n_rows"))


def csv_records(rows: DataFrame) -> DataFrame:
    """catalog_id, row_idx and each record as a map of column names to cells, from read_csv_files."""
    heads = rows.filter("row_idx = 0").select("catalog_id", F.col("cells").alias("__head"))
    return rows.filter("row_idx > 0").join(heads, "catalog_id").select("catalog_id", "row_idx", F.map_from_arrays("__head", "cells").alias("record"))
