"""Rewriting a column in batches by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakebranch import scratch

FIRST, LEAST, MOST, TARGET_MS = 1_000, 100, 50_000, 250


def keyset_page(df: DataFrame, key: str, cursor: object, size: int) -> DataFrame:
    """The next rows after the cursor by key; the filter reaches the scan, and no more than size rows are kept sorted."""
    return (df if cursor is None else df.filter(F.col(key) > F.lit(cursor))).orderBy(key).limit(size)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Adds rank, from 0 by key, without sorting all rows in one task: rows are dealt out by ranges of the key, and written, so that a
    range's first rank, what the ranges before it hold, is of the same rows. The table of ranges has a row for each partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.written(df.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "ranks")
    counts = rows.groupBy("part").agg(F.count("*").alias("held"))
    before = F.broadcast(counts.select("part", (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("before")))
    nth = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return rows.withColumn("nth", nth).join(before, "part").withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")


def percentiles(df: DataFrame, group: str, value: str, shares: list[float], bins: int = 1_024) -> DataFrame:
    """K5: (group, p50, ...): of each group's n sorted values those at places min(n - 1, floor(n * share)), exactly.

    Equal values are counted first. Bins between the least and the greatest value, and the counts of the bins before, tell where a value
    lies, so that no task sorts a whole group. Null values are left out.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v IS NOT NULL")
    low, high = rows.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    width = (high - low) / bins if low is not None and high > low else 1.0
    bin_ = F.floor((F.col("v").cast("double") - (low or 0.0)) / width)
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("k")).withColumn("bin", bin_)
    sums = counts.groupBy("g", "bin").agg(F.sum("k").alias("k"))
    whole = sums.withColumns({"before": F.sum("k").over(W.partitionBy("g").orderBy("bin")) - F.col("k"), "n": F.sum("k").over(W.partitionBy("g"))}).drop("k")
    known = counts.withColumnRenamed("g", "h").withColumnRenamed("bin", "at").join(whole, F.col("h").eqNullSafe(F.col("g")) & (F.col("at") == F.col("bin")))
    upto = F.col("before") + F.sum("k").over(W.partitionBy("g", "bin").orderBy("v"))
    placed = known.select("g", "v", "n", (upto - F.col("k")).alias("first"), upto.alias("end"))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    at = [F.max(F.when((F.col("first") <= place(p)) & (place(p) < F.col("end")), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares]
    return placed.groupBy(F.col("g").alias(group)).agg(*at)


def differs(target: Column, value: Column) -> Column:
    return ~target.eqNullSafe(value)


def batch_stats(df: DataFrame, key: str, target: str, source: Column, size: int = FIRST) -> DataFrame:
    """(batch, low_key, high_key, scanned, updated) of the batches a fill goes through."""
    rows = ranked(df.select(F.col(key).alias("key"), differs(F.col(target), source).alias("moved")), "key")
    return rows.groupBy(F.floor(F.col("rank") / size).alias("batch")).agg(
        F.min("key").alias("low_key"), F.max("key").alias("high_key"), F.count("*").alias("scanned"), F.count_if("moved").alias("updated")
    )


def filled(df: DataFrame, target: str, source: Column) -> DataFrame:
    """The whole table with the column filled: one projection, no shuffle."""
    return df.withColumn(target, source)


def failures(df: DataFrame, key: str, column: str, cast_to: str) -> DataFrame:
    """(key, value) of rows that the cast would fail on."""
    return df.filter(F.col(column).isNotNull() & F.col(column).cast("string").try_cast(cast_to).isNull()).select(F.col(key).alias("key"), F.col(column).alias("value"))


def next_size(size: Column, elapsed_ms: Column, target_ms: int = TARGET_MS) -> Column:
    """Twice as many rows after a batch of less than half the target time, half as many after one of more."""
    return F.when(elapsed_ms < target_ms / 2, F.least(size * 2, F.lit(MOST))).when(elapsed_ms > target_ms, F.greatest(F.floor(size / 2), F.lit(LEAST))).otherwise(size).cast("int")


def sizes(elapsed: Column, first: int = FIRST) -> Column:
    """I6 over a list of batch times: the size after all of them."""
    return F.aggregate(elapsed, F.lit(first), lambda n, ms: next_size(n, ms))


def progress(done: Column, estimated: Column) -> Column:
    """I8"""
    return F.when(F.coalesce(estimated, F.lit(0)) > 0, F.least(F.lit(1.0), done / estimated)).otherwise(0.0)


def backoff_ceiling(attempt: Column) -> Column:
    """Milliseconds that a retry waits at most."""
    return F.least(F.lit(60_000), (100 * F.pow(F.lit(2), F.least(attempt, F.lit(20)))).cast("long"))


def pause(elapsed_ms: Column) -> Column:
    """Milliseconds to rest after a batch: a quarter of what it took."""
    return F.floor(elapsed_ms * 0.25).cast("long")


def truncated(message: Column) -> Column:
    """I18"""
    return F.when(F.length(message) > 2_000, F.concat(F.substring(message, 1, 2_000), F.lit("..."))).otherwise(message)
