"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing.

Each stage works on all rows its predecessor kept and returns the columns of documents; the last returns the mix. What a stage
returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakebranch.llm import decontamination, mixing, ngram_join, queries, shared, toxicity


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score under 0.5; the model learns from the labelled documents that are not held out.

    Rows with a null or empty text have score 0 and stay, null ids too; equal texts stay or go together. Without labels of both kinds
    every document scores alike, by the model's bias. Extra columns are kept, whatever they are called.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~queries.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, spans=False).filter("score < 0.5").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by near-duplicate links one row, that of the least doc_id.

    Of repeated rows of that doc_id the first one read stays; a null doc_id comes after all others, so such a row stays only where its
    group has no other, again the first one read. Rows of one doc_id in two groups are apart; rows without words are no copies, and all
    of them stay. Extra columns are kept, whatever they are called; an empty table gives none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = shared.written(rows, "numbered")  # so that a row has the same number in both reads
    key = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("doc_id"), "n")
    groups = ngram_join.similar_groups(rows.select(key.alias("doc_id"), F.col("row.text").alias("text")))
    copies = groups.filter("component_id.n <> doc_id.n").select("doc_id.n")
    return rows.join(copies, "n", "left_anti").select("row.*")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item.

    Rows with a null or empty text stay, as do all where the benchmark is empty; equal texts stay or go together, whatever their ids.
    Extra columns are kept, whatever they are called.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of the sources takes: (doc_id, source, size, source_size, target, taken) of each row.

    A null source is one of its own, a null text has no words; rows of one id in one source, null ids among them, are taken together.
    Extra columns are left out.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
]
#: SQL can express neither the trained model nor the components; a test holds run()'s rows against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.written(docs, name)
    return docs
