"""Hit tables that arrive as files: statistics kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "family string, n_hits bigint, best_evalue double, best_hit bigint, n_strong bigint"


def _statistics(hits: DataFrame) -> DataFrame:
    best = F.min(F.struct("evalue", "hit_id"))
    rows = hits.where("family is not null and evalue is not null").groupBy("family")
    rows = rows.agg(F.count("*").alias("n_hits"), best.alias("best"), F.count_if(F.col("evalue") < 1e-10).alias("n_strong"))
    return rows.select("family", "n_hits", F.col("best.evalue").alias("best_evalue"), F.col("best.hit_id").alias("best_hit"), "n_strong")


def _merged(state: DataFrame, new: DataFrame) -> DataFrame:
    best = F.min(F.struct("best_evalue", "best_hit"))
    rows = state.unionByName(new).groupBy("family").agg(F.sum("n_hits").alias("n_hits"), best.alias("best"), F.sum("n_strong").alias("n_strong"))
    return rows.select("family", "n_hits", F.col("best.best_evalue").alias("best_evalue"), F.col("best.best_hit").alias("best_hit"), "n_strong")


def current(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The newest state under out, or the newest of a batch before the given one; empty if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(path)] if files.exists(path) else []
    done = [int(p.getName()[6:]) for p in found if p.getName().startswith("batch=") and files.exists(p.suffix("/_SUCCESS"))]
    usable = [b for b in done if before is None or b < before]
    return spark.read.schema(STATE).parquet(f"{out}/batch={max(usable)}") if usable else spark.createDataFrame([], STATE)


def follow_hits(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str) -> None:
    """Takes in all Parquet files of landing that no run has taken yet, and writes the merged state of all so far.

    Each micro-batch writes its own folder, from the state of the batch before; a batch that is run again after a
    failure overwrites its folder and so counts once.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        _merged(current(spark, out, number), _statistics(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(landing)
    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
