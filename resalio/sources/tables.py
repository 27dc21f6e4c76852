"""Tables that are changed in place, part by part: keyed tables of buckets (S8, S9), and the layout that reports read (Q1, Q4, Q7, Q9, Q15)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, materialize
from .sinks import replace_children, upsert


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet folder whose rows lie by bucket of their key. A change reads and writes the buckets of its own keys only.

    Buckets are partitions, overwritten dynamically: others keep their files. What a change makes is written beside
    the table first, so that a bucket isn't read while it is replaced; a change that stops half way and runs again
    gives the same table. One writer at a time. Rows with a null key are one bucket's.
    """

    spark: SparkSession
    path: str
    key: str = "product_id"
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, mode: str) -> None:
        rows = df.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.path)

    def create(self, df: DataFrame) -> KeyedTable:
        """The table with these rows and no others."""
        self._write(df, "static")
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        rows = self.spark.read.parquet(self.path)
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        return [r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers

    def _change(self, new: DataFrame, how) -> None:
        new = materialize(new, "changes")
        touched = self.touched(new)
        if touched:
            self._write(materialize(how(self.read(touched), new, self.key), "changed"), "dynamic")

    def upsert(self, updates: DataFrame) -> None:
        """Updates in place of the rows that have their keys; updates must hold each key once."""
        self._change(updates, upsert)

    def replace_children(self, new: DataFrame) -> None:
        """All rows of the keys in new are new's."""
        self._change(new, replace_children)

    def delete(self, keys: DataFrame) -> None:
        """The rows of these keys go; a bucket that loses all its rows goes with them."""
        keys = materialize(keys.select(self.key).distinct(), "keys")
        touched = self.touched(keys)
        rest = materialize(self.read(touched).join(keys, self.key, "left_anti").withColumn("bucket", self.bucket()), "rest")
        if touched:
            self._write(rest.drop("bucket"), "dynamic")
            left = {r.bucket for r in rest.select("bucket").distinct().collect()}  # at most `buckets` numbers
            for b in set(touched) - left:
                delete(self.spark, f"{self.path}/bucket={b}")


def save_laid_out(df: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """A table of the session's catalog in the layout of reports: partitions by catalog_id, buckets by product_id, sorted by it.

    A report on one catalog reads that catalog's files; joins of such tables by product need no shuffle. Rows meet in
    as many tasks as there are buckets, and a task writes the files of its bucket.
    """
    rows = df.repartition(buckets, "product_id").sortWithinPartitions("catalog_id", "product_id")
    rows.write.mode("overwrite").partitionBy("catalog_id").bucketBy(buckets, "product_id").sortBy("product_id").saveAsTable(name)
    return df.sparkSession.table(name)
