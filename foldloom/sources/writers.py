"""Sinks: tables, texts by key, sequences and JSON records, each written by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """Tab-separated files with a header; columns of decimals with so many places."""
    for c, n in (decimals or {}).items():
        df = df.withColumn(c, F.format_string(f"%.{n}f", F.col(c)))
    df.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def write_lines_by_key(df: DataFrame, path: str, key: str, line: str, order: str) -> None:
    """A folder of text files for each key, its lines in order within each file, and the files in order by name.

    Rows are partitioned by ranges of (key, order), so the lines of a large key are cut in stretches, not mixed.
    """
    rows = df.select(key, order, F.col(line).alias("value")).repartitionByRange(key, order).sortWithinPartitions(key, order)
    rows.drop(order).write.partitionBy(key).mode("overwrite").text(path)


def fasta_record(name: Column, sequence: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(df: DataFrame, path: str, name: str, sequence: str) -> None:
    df.select(fasta_record(F.col(name), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Parquet partitioned by a hash of key, so that a point lookup reads one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("bucket").sortWithinPartitions(key).write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_index(spark, path: str, key: str, values: list, buckets: int = 64) -> DataFrame:
    """The rows of the given values of key."""
    wanted = spark.createDataFrame([(v,) for v in values], f"{key} string").select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b")).distinct()
    return spark.read.parquet(path).where(F.col("bucket").isin([r["b"] for r in wanted.collect()]) & F.col(key).isin(values)).drop("bucket")
