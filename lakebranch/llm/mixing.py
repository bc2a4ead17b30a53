"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. A source takes whole passes over its documents, and for the rest of its target those
documents whose hash is below a threshold. The threshold is found without sorting: sizes are summed by source and the hash's
first ten bits; in the bucket where the running sum crosses the rest, and only there, by the next ten bits; and so on until the
bucket holds a single hash, which is taken if that brings the sum nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakebranch.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
HASH_BITS, LEVEL_BITS = 60, 10


def document_hash(id_column: str) -> Column:
    """The first 60 bits of the MD5 of the id as text; that of the empty text for null."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank (from 0, by source in code point order, null last); sources are sorted in parts, never all in one task."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    parts = shared.written(
        sources.repartitionByRange(shared.partitions(spark), order).withColumn("part", F.spark_partition_id()), "sources"
    )
    counts = parts.groupBy("part").agg(F.count("*").alias("held"))
    before = F.broadcast(counts.select("part", (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("before")))  # a row for each partition
    nth = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("nth", nth).join(before, "part").withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source, source_size, target) of sources (key, source, source_size).

    The sources share the sum of all sizes by weight; a target stops at most times its source's size, and the excess goes to
    the others by weight until none is above. Each round is one sum over the sources, and caps at least one more of them.
    """
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    found = shared.written(ranked(totals).withColumn("weight", weight.cast("long")), "weights")
    level, capped = None, -1
    cap = F.col("source_size") * most
    while True:
        over = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        row = found.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free"),
            F.count_if(over).alias("n"),
        ).first()
        if row.n == capped or not row.free or row["all"] is None:
            break
        level, capped = (row["all"] - row.held) / row.free, row.n
    share = F.lit(0.0) if level is None else F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight"))
    return found.select("key", "source", "source_size", share.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, below): of a source's rows (key, h, size), those with h < below have a sum of sizes nearest to its rest.

    wanted: (key, rest) with 0 <= rest <= the source's size. Rows of one hash are taken together.
    """
    open_, done, level, at = wanted.withColumns({"prefix": F.lit(0).cast("long"), "base": F.lit(0).cast("long")}), [], 0, rows
    while level * LEVEL_BITS < HASH_BITS:
        level += 1
        shift = HASH_BITS - level * LEVEL_BITS
        bucket = F.shiftright("h", shift)
        sums = at.groupBy("key", bucket.alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        running = sums.withColumn("upto", F.sum("size").over(W.partitionBy("key").orderBy("bucket")))
        crossed = (
            running.join(open_, "key")
            .withColumn("before", F.col("base") + F.col("upto") - F.col("size"))
            .filter((F.col("size") > 0) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
        )
        crossed = shared.written(crossed.select("key", "rest", "bucket", "before", "size", "low", "high"), f"level{level}")
        nearer = F.col("rest") - F.col("before") >= F.col("size") / 2
        done.append(
            crossed.filter("low = high").select("key", F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias("below"))
        )
        open_ = crossed.filter("low < high").select("key", "rest", F.col("bucket").alias("prefix"), F.col("before").alias("base"))
        if open_.isEmpty():
            break
        inside = at.withColumn("prefix", bucket).join(open_.select("key", "prefix"), ["key", "prefix"]).select("key", "h", "size")
        at = shared.written(inside, f"boundary{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of each row; taken is size times how often the mix takes the row.

    A size is the text's number of words, 0 for null. A null source is a source of its own, ordered last. A null id has a hash
    like any other; rows of one id in one source are taken together. An empty table gives no rows. Other columns of df, also
    ones named as those added here, are left out: the result can be joined back by id.
    """
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    picked = df.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = shared.written(
        picked.select("id", "source", key.alias("key"), size.alias("size"), document_hash("id").alias("h")), "sizes"
    )
    totals = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    shares = targets(totals, weights, most)
    passes = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most)).cast("long")
    shares = shares.withColumn("passes", passes)
    rest = F.when(F.col("passes") >= most, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    shares = shared.written(shares.withColumn("rest", rest), "shares")
    below = thresholds(rows, shares.filter("rest > 0").select("key", "rest"))
    shares = shared.written(shares.join(below, "key", "left").drop("source", "rest"), "thresholds")
    often = F.col("passes") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return rows.join(shares, "key").select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", (F.col("size") * often).alias("taken")
    )
