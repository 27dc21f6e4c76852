"""Tables written and changed by key (S7 to S13): results of joins, so that the same functions serve batches and streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .shared import materialize, open_store


def write_products(df: DataFrame, path: str, mode: str = "append") -> None:
    """Products by catalog."""
    df.write.mode(mode).partitionBy("catalog_id").parquet(path)


def _write(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, path = open_store(root)
    for b in batches:
        for folder in (folders := b.column(0).unique()).to_pylist():
            fs.create_dir(f"{path}/{folder}", recursive=True)
        for folder, name, value in zip(*(b.column(k).to_pylist() for k in range(3))):
            part = f"{path}/{folder}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(value.encode())
            fs.move(part, f"{path}/{folder}/{name}")
        yield pa.RecordBatch.from_arrays([folders.cast(pa.string())], ["folder"])


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Texts (folder, name, value) as files of their own below root, whatever their number; folder: the URI of each folder, once.

    Tasks write them, and nothing of them reaches the driver; a task that is tried again replaces them with the same.
    """
    done = files.select("folder", "name", "value").mapInArrow(partial(_write, root), "folder string").distinct()
    return materialize(done.select(F.concat_ws("/", F.lit(root), "folder").alias("folder")), "folders")


def upsert(target: DataFrame, updates: DataFrame, key: str = "product_id") -> DataFrame:
    """Updates in place of the rows that have their keys."""
    return target.join(updates.select(key), key, "left_anti").unionByName(updates)


def replace_children(target: DataFrame, new: DataFrame, key: str = "product_id") -> DataFrame:
    """All children of the keys in new are new's; keys without new children keep theirs."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def parse_metadata(quality: DataFrame) -> DataFrame:
    """catalog_id and its counters, rates and confidence as a JSON record."""
    return quality.select("catalog_id", F.to_json(F.struct(*[c for c in quality.columns if c != "catalog_id"])).alias("parse_metadata"))


def clear_derived(derived: DataFrame, products: DataFrame, catalog_id: str) -> DataFrame:
    """Finance or score rows without those of a catalog's products."""
    return derived.join(products.filter(F.col("catalog_id") == catalog_id).select("product_id"), "product_id", "left_anti")


def backfill_ml_fee(finance: DataFrame) -> DataFrame:
    """Fees of 0 worked out from price and percentage."""
    fee = F.round(F.col("avg_market_price") * F.col("marketplace_fee_pct") / 100, 2)
    return finance.withColumn("ml_fee", F.when(F.col("ml_fee") == 0, fee.cast(finance.schema["ml_fee"].dataType)).otherwise(F.col("ml_fee")))


def migrate_recommendation(c: str = "recommendation") -> Column:
    """Old names of classes as new ones."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in V.OLD_CLASSES.items() for x in kv])[F.col(c)], F.col(c))
