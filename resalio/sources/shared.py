"""The folder that driver and executors share, steps written to it, and what becomes of them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Folders that the steps of the work at hand have made, where it is to clear them.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with its scheme.

    Where it is unset, a session on this machine alone (tests) gets a new local folder; on a cluster, where each
    executor would write to its own disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file:" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A name in the shared folder that no other run has."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df, for a join that deals out both of its sides by key, whatever size Spark takes them for.

    The sizes that a join is planned by come from files and columns: they tell neither how many rows an explode makes
    nor how well files are compressed. What is taken for small is collected by the driver and broadcast, however large
    it is. Spark still splits hot keys of such a join.
    """
    return df.hint("merge")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a URI of the shared folder (file, hdfs, s3, gs), and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    if re.match(r"\w+://", uri):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def written(spark: SparkSession, folder: str) -> bool:
    """Whether all of a folder was written: Spark's mark is there."""
    path, fs = _path(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work whose steps are of no use after it: what it has written to new folders goes at its end. Nothing lazy may leave it."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for folder in made:
            delete(spark, folder)


def settled(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written and read again; the steps that it has written on its way are cleared."""
    path = new_folder(spark, what)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Run:
    """A run whose stages can be started again: each lies in a folder of its own and is complete or not there.

    A second start with the same folder reads the stages that are complete and makes the others. The folder is one
    run's on one input: who gives it answers for that. Without a folder it is a new one.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or new_folder(spark, "run")

    def stages(self, names: list[str], make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
        """Stages that are made together: read if all are complete, else made; steps on the way are cleared."""
        paths = [f"{self.folder}/{n}" for n in names]
        if not all(written(self.spark, p) for p in paths):
            with scratch(self.spark):
                for df, path in zip(make(), paths):
                    df.write.mode("overwrite").parquet(path)
        return tuple(self.spark.read.parquet(p) for p in paths)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.stages([name], lambda: (make(),))[0]

    def clear(self) -> None:
        """The run is over and its stages aren't needed any more."""
        delete(self.spark, self.folder)
