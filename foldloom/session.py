"""The Spark session of tests and benches; on a cluster the caller brings its own."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "foldloom") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")  # files of one row group are read by one task: a shuffle spreads the join
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """spark with this package sent to its executors, for clusters where it isn't installed: Arrow functions need it there."""
    at = tempfile.mkdtemp(prefix="foldloom-package-")
    package = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/foldloom", "zip", package.parent, package.name))
    return spark
