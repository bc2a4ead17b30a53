"""I4: a fill that resumes: a stream of a table's files, each batch written once, its progress in the stream's checkpoint."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def fill(spark: SparkSession, source: str, out: str, checkpoint: str, target: str, value: Column, files_a_batch: int = 100, rest: bool = False) -> None:
    """Rewrites the Parquet files of source to out with the column filled. A batch is a folder of its own, overwritten if it runs
    again, and the checkpoint moves on only after it: a run that was cut off goes on with the batch it was in, and one that is done
    does nothing. With rest, the driver pauses after each batch, for a quarter of what it took (I7)."""
    rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        batch.withColumn(target, value).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if rest:
            time.sleep((time.monotonic() - began) * 0.25)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def filled(spark: SparkSession, out: str) -> DataFrame:
    """What fill() wrote."""
    return spark.read.parquet(out).drop("batch")


def progress(spark: SparkSession, out: str) -> DataFrame:
    """(batch, rows) done so far."""
    return spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("rows"))
