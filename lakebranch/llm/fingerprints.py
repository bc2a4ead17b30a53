"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its runs of up to five words, one ending at each word, weighted by how often they occur. For each
term and each of k samples, r and c are Gamma(2, 1) and b uniform, all read off a hash of term and sample; with
t = floor(ln(weight) / r + b) the term's value is a = c * exp(-r * (t + 1 - b)), and the sample is the (term, t) of the least
a. The samples of two texts agree with a probability equal to their generalised Jaccard similarity, sum(min) / sum(max) of the
weights (Ioffe 2010). A fingerprint is k such samples, 16 bits of each, in hex; an empty text's samples are all zero.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared
from lakebranch.llm.textops import U, column_words, distinct, mix, trailing_ngrams

SAMPLES = 64
WORDS = 5
#: Longer runs without white space count as several words, so that such texts have more than one term.
LONGEST = 24
#: Keys sampled for each partition to cut the rows in runs.
SAMPLE = 32
#: Rows of the (term, sample) matrix worked on at once.
ROWS = 512
_TABLE = (-np.log((np.arange(65536) + 0.5) / 65536)).astype(np.float32)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight), in order of the texts."""
    w = column_words(column, LONGEST)
    return distinct(w.texts, trailing_ngrams(w, WORDS))


def values(term: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """For each term and sample the sampled value's bits above those of its (term, t): the least one is the sample."""
    salt = mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    x = term[:, None] ^ salt[None, :]
    beta = ((x * U(0xD6E8FEB86659FD93)) >> U(40)).astype(np.float32) * np.float32(2**-24)
    parts = mix(x).view(np.uint16).reshape(len(term), k, 4)
    r = _TABLE[parts[:, :, 0]] + _TABLE[parts[:, :, 1]]
    c = _TABLE[parts[:, :, 2]] + _TABLE[parts[:, :, 3]]
    many = np.flatnonzero(weight > 1)
    t = np.zeros((len(many), k), dtype=np.float32)
    if len(many):
        t = np.floor(np.log(weight[many]).astype(np.float32)[:, None] / r[many] + beta[many])
        beta[many] -= t
    beta -= 1
    a = c * np.exp(r * beta)
    name = np.repeat((((term * U(0xC2B2AE3D27D4EB4F)) >> U(48)) % U(65535))[:, None], k, axis=1)
    if len(many):
        name[many] = (name[many] + t.astype(np.int64).astype(U) * U(40503)) % U(65535)
    return (a.view(np.uint32).astype(U) << U(32)) | (name + U(1))


def signatures(owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int = SAMPLES) -> np.ndarray:
    """The k samples of each of n owners; rows (owner, term, weight) are in order of owner."""
    least = np.full((n, k), ~U(0), dtype=U)
    for at in range(0, len(owner), ROWS):
        own = owner[at : at + ROWS]
        lines = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        mins = np.minimum.reduceat(values(term[at : at + ROWS], weight[at : at + ROWS], k), lines, axis=0)
        least[own[lines]] = np.minimum(least[own[lines]], mins)
    return np.where(least == ~U(0), U(0), least & U(0xFFFF)).astype(np.uint16)


def paired_signatures(one: tuple, two: tuple, n: int, k: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Samples of two texts of each owner; the values of what both hold with equal weight are worked out once."""
    owner, term, weight = (np.concatenate([a, b]) for a, b in zip(one, two, strict=True))
    side = np.repeat([1, 2], [len(one[0]), len(two[0])])
    order = np.lexsort((side, weight, term, owner))
    owner, term, weight, side = owner[order], term[order], weight[order], side[order]
    if not len(owner):
        return np.zeros((n, k), np.uint16), np.zeros((n, k), np.uint16)
    same = (owner[1:] == owner[:-1]) & (term[1:] == term[:-1]) & (weight[1:] == weight[:-1])
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    sides = np.add.reduceat(side, new)
    owner, term, weight = owner[new], term[new], weight[new]
    least = [np.full((n, k), ~U(0), dtype=U) for _ in range(2)]
    for at in range(0, len(owner), ROWS):
        got = values(term[at : at + ROWS], weight[at : at + ROWS], k)
        for bit, out in zip((1, 2), least, strict=True):
            rows = np.flatnonzero(sides[at : at + ROWS] & bit)
            if not len(rows):
                continue
            own = owner[at + rows]
            lines = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            mins = np.minimum.reduceat(got[rows], lines, axis=0)
            out[own[lines]] = np.minimum(out[own[lines]], mins)
    return tuple(np.where(x == ~U(0), U(0), x & U(0xFFFF)).astype(np.uint16) for x in least)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples that agree, row by row."""
    return (a == b).mean(axis=1)


def hexed(samples: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in samples.astype(">u2")]


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) of each row's whole text, without a shuffle.

    A null text is empty; repeated rows each give a row; an empty table gives none; other columns are left out.
    """
    shared.limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                got = signatures(*terms(batch.column("text")), batch.num_rows, k)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hexed(got), pa.string())], ["id", "fingerprint"])

    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_column)


def key_of(value: object, hashed: int) -> tuple:
    """A row's place among all, ascending: by id, null first and NaN last, then by the hash of its text."""
    if value is None:
        return (0, 0, hashed)
    return (2, 0, hashed) if value != value else (1, value, hashed)


def cut_keys(keys: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 keys (id, h), in order, that cut all rows in runs of about equal length; from a sample of SAMPLE keys a part."""
    share = min(1.0, SAMPLE * parts / max(1, keys.count()))
    some = sorted(key_of(r.id, r.h) for r in (keys if share == 1 else keys.sample(share, seed=1)).collect())
    return sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []


def with_followers(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """Rows (bucket, extra, id, h, text), dealt out so that a bucket holds a run of rows and, marked extra, the run's follower.

    Rows go from the greatest id down, nulls last, and rows of equal ids by a hash h of their texts. Keys of a bounded sample cut them
    into as many runs of about equal length as there are shuffle partitions; a row's run is found by bisection. The run after the last is
    the first. Only each run's greatest key (one a partition) comes to the driver; a text is shuffled once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cuts = cut_keys(rows.select("id", "h"), shared.partitions(spark))
    sent = spark.sparkContext.broadcast(cuts)  # one key a partition

    def places(batch: pa.RecordBatch) -> list[tuple[int, tuple]]:
        keys = [key_of(*x) for x in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), strict=True)]
        return [(len(sent.value) - bisect.bisect_right(sent.value, k), k) for k in keys]

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[int, tuple[tuple, int]] = {}
            for i, (b, key) in enumerate(places(batch)):
                if b not in best or key > best[b][0]:
                    best[b] = key, i
            taken = batch.take(pa.array([i for _, i in best.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), *taken.columns], ["bucket", "id", "h"])

    heads = rows.select("id", "h").mapInArrow(greatest, f"bucket int, id {kind}, h long").groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("head")).collect()
    heads = sorted((r.bucket, key_of(r.head.id, r.head.h)) for r in heads)
    before = spark.sparkContext.broadcast({key: heads[i - 1][0] for i, (_, key) in enumerate(heads)})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            found = places(batch)
            ahead = [i for i, (_, key) in enumerate(found) if key in before.value]
            ahead = [i for i in ahead if found[i][1] not in done and not done.add(found[i][1])]
            for at, extra, buckets in ((range(len(found)), 0, [b for b, _ in found]), (ahead, 1, [before.value[found[i][1]] for i in ahead])):
                some = batch if not extra else batch.take(pa.array(at, pa.int64()))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([extra] * len(buckets), pa.int32()), *some.columns], ["bucket", "extra", "id", "h", "text"])

    return rows.select("id", "h", "text").mapInArrow(dealt, f"bucket int, extra int, id {kind}, h long, text string"), len(cuts) + 1


def edited_pairs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SAMPLES) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The edited text has the last floor(n / 3) of its n code points replaced by the first as many (or all) of the next document
    in descending order of ids, nulls last; the first follows the last, so a sole document follows itself. A null text is
    empty. Rows of one id are ordered by a hash of their texts, greatest first; each row gives one row. An empty table gives none. Ids
    can be of any type that has an order.
    """
    spark = df.sparkSession
    shared.limit_batches(spark)
    dealt, n = with_followers(df, id_column, text_column)
    kind = dealt.schema["id"].dataType.simpleString()
    rows = dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("id").desc_nulls_last(), F.col("h").desc())

    def work(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all texts but the last, which only follows."""
        n = len(texts) - 1
        cuts = [len(x) // 3 for x in texts[:n]]
        edited = [x[: len(x) - c] + y[:c] for x, y, c in zip(texts, texts[1:], cuts, strict=False)]
        base, other = terms(pa.array(texts, pa.large_string())), terms(pa.array(edited, pa.large_string()))
        own, changed = paired_signatures(base, other, n + 1, k)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(ids[:n]),
                pa.array([len(x) for x in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
                pa.array(hexed(own[:n]), pa.string()),
                pa.array(hexed(changed[:n]), pa.string()),
                pa.array(likeness(own[:n], changed[:n]), pa.float64()),
                pa.array(likeness(own[:n], own[1:]), pa.float64()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        bucket, size = None, 0
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                names = batch.column("id")
                for i, (b, extra, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "text")), strict=True)):
                    if b != bucket:
                        ids, texts, bucket, size = [], [], b, 0
                    ids.append(names.slice(i, 1))
                    texts.append(text)
                    size += len(text)
                    if extra or size > 1 << 21:
                        if len(texts) > 1 and bucket is not None:
                            yield work(ids, texts)
                        ids, texts, size = ids[-1:], texts[-1:], len(text)
                        if extra:
                            bucket = None

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
