"""The queries opN_<name> over the tables of a folder, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakebranch.llm import chat, decontamination, fingerprints, html_extract, lm_score, mixing, ngram_join, shared, token_counts, toxicity, warc

WORDS = r"'[^\x20\x09-\x0D]+'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, folder, "documents"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents"))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scores = lm_score.lm_scores(table(spark, folder, "documents"))
    return scores.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


OP3_SQL = rf"""
WITH lists AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS w3, generate_subscripts(ws, 1) AS i FROM lists),
grams AS (
  SELECT *, lag(w3, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w2, lag(w3, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w1 FROM words),
counts AS (
  SELECT *, count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) AS c3,
         CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY i > 1, w2, w3) - count(*) OVER (PARTITION BY i > 1, doc_id, w2, w3) ELSE 0 END AS c23,
         CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY i > 2, w1, w2, w3) - count(*) OVER (PARTITION BY i > 2, doc_id, w1, w2, w3) ELSE 0 END AS c123
  FROM grams),
before AS (
  SELECT *, lag(c3) OVER (PARTITION BY doc_id ORDER BY i) AS c2, lag(c23) OVER (PARTITION BY doc_id ORDER BY i) AS c12,
         (SELECT count(*) FROM words) - count(*) OVER (PARTITION BY doc_id) AS n FROM counts),
logs AS (
  SELECT doc_id, c3, c123,
         CASE WHEN c123 > 0 THEN ln(c123) - ln(c12)
              WHEN c23 > 0 THEN ln(c23) - ln(c2) + (least(3, i) - 2) * ln({lm_score.ALPHA})
              WHEN c3 > 0 THEN ln(c3) - ln(n) + (least(3, i) - 1) * ln({lm_score.ALPHA})
              ELSE least(3, i) * ln({lm_score.ALPHA}) - ln(n + 1) END AS p
  FROM before),
sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (c123 > 0) AS n_longest, count(*) FILTER (c3 = 0) AS n_unseen, sum(p) AS log_score
  FROM logs GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_longest, 0)::BIGINT AS n_longest, coalesce(n_unseen, 0)::BIGINT AS n_unseen,
       round(coalesce(log_score, 0), 4) AS log_score, round(log_score / n_words, 4) AS mean_log_score
FROM lists l LEFT JOIN sums s USING (doc_id)
"""


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("source")


OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ()
     - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / (sum(weight) OVER (ORDER BY 3.0 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level
  FROM weighed),
shares AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE,
         (SELECT first(level ORDER BY 3.0 * source_size / weight, place) FROM levels WHERE level * weight <= 3 * source_size) * weight) AS target
  FROM levels),
rests AS (
  SELECT *, least(floor(target / greatest(source_size, 1)), 3)::BIGINT AS passes FROM shares),
running AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.passes,
         CASE WHEN r.passes >= 3 THEN 0 ELSE greatest(0, r.target - r.passes * r.source_size) END AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS together
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN rest > 0 AND rest - (upto - together) >= together / 2.0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(table(spark, folder, "pages"), shared.new_path(spark, "warc"))
    return warc.read_archives(archives).withColumnRenamed("id", "page_id").drop("url")


OP5_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
headed AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS head FROM hashed)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM headed
"""


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


CONTROL = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    turns = rows.unionByName(own).withColumn("parts", chat.text_parts(F.coalesce("text", F.lit(""))))
    done = chat.format_chats(turns)
    done = done.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = rf"""
WITH own AS (
  SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')) AS t(conv_id, turn, role, text)),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)),
sized AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + {len(chat.START + chat.SAYS + chat.END)})::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: Documents of more tokens than this are marked.
TOKEN_LIMIT = 512


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    counts = token_counts.token_counts(table(spark, folder, "documents"), path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_ngram_join, op3_lm_score, op4_mixing, op5_warc, op6_toxicity, op7_chat_formatting, op8_token_counts, op9_decontamination, op10_html_extraction)}


def oracle_sql() -> dict[str, str]:
    return {"op3_lm_score": OP3_SQL, "op4_mixing": OP4_SQL, "op5_warc": OP5_SQL, "op7_chat_formatting": OP7_SQL}
