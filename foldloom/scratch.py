"""Tables written once in the folder that all executors share, to cut lineage and to compute a shared step only once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # by application: the folder of a local session that names none


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets a folder of this machine, until it ends."""
    key = "spark.checkpoint.dir"
    context = spark.sparkContext
    at = spark.conf.get(key, None) or context.getConf().get(key)
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"{key} must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="foldloom-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return _own[context.applicationId]


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/foldloom-{spark.sparkContext.applicationId}{_within[-1] if _within else ''}"


_within: list[str] = []  # folders of the open workspaces


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were cut within it; results must be written or collected before."""
    _within.append(f"{_within[-1] if _within else ''}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, _folder(spark))
        _within.pop()


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has cut. DataFrames that read them can no longer be used."""
    _delete(spark, f"{shared_folder(spark)}/foldloom-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written as Parquet and read again: a lost executor costs at most the tasks of the running step.

    The table stays until the workspace around it ends, or `clear` is called.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pile:
    """Rows gathered over rounds in one table, which each round adds to."""

    def __init__(self, like: DataFrame, name: str):
        self.spark, self.schema, self.path = like.sparkSession, like.schema, f"{_folder(like.sparkSession)}/{name}-{uuid.uuid4().hex}"
        like.limit(0).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.select(self.schema.names).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
