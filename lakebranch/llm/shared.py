"""What the operators share: scratch tables in the cluster's shared folder, and Arrow batch limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python hold at most this many bytes (a single longer row makes its own batch).
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of our own is set in local mode, as in tests; a cluster's
    nodes would each have their own, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def removed(*frames: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more, through Hadoop's file system."""
    for df in frames:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def steady(df: DataFrame) -> DataFrame:
    """df where its plan only reads, filters and projects files, so that it gives the same rows in the same order when it is read again; else
    df as a table written once."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in lines if line.strip()}
    return df if nodes <= {"Project", "Filter", "Relation"} and df.inputFiles() else written(df, "rows")


def limit_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch where the setting has its default, so that many very long rows don't meet in one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose column holds about limit bytes."""
    from lakebranch.llm.textops import buffers

    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = at + 1
        while end < n and offsets[min(n, end + 1)] - offsets[at] <= limit:
            end += 1
        yield batch.slice(at, end - at)
        at = end
