"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence's probability s is logistic in hashed word features; a document's is the noisy-or of its
sentences, p = 1 - prod(1 - s). The gradient of the documents' log-likelihood reaches each sentence of a toxic document in
proportion to s * (1 - p) / p, so that training finds the sentences that make it toxic; the model then scores and locates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared
from lakebranch.llm.textops import MARKS, U, buffers, mix, words

BITS = 18
#: Features of a word: the whole and prefixes of so many bytes.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: At most so many labelled documents of each label are learned from, in order of a hash of their id, and so many bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 2048, 64 << 20
#: A feature counts if so many training documents have it, and toxic ones more often by so many standard errors.
MIN_DOCUMENTS, ERRORS = 3, 3.0
BIAS, RATE, BATCH, DECAY, SEED = -6.0, 0.1, 128, 1e-3, 7
#: Passes over the training documents, more of them where they make few batches.
EPOCHS, STEPS = 24, 400
#: A sentence of at least this probability is reported.
OFFENDING = 0.5
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?\n\r"]] = True
SPANS = "array<struct<start:int,end:int,score:double>>"


@dataclass
class Bags:
    """Sentences of a run of texts: text i has sentences first[i]:first[i + 1]; sentence j has features at[j]:at[j + 1]."""

    first: np.ndarray
    at: np.ndarray
    features: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def bags(column: pa.Array) -> Bags:
    """Sentences end at . ! ? or a line's end; those without a word are left out. Features are distinct in a word, not in a sentence."""
    data, offsets = buffers(column)
    w = words(data, offsets, gap=MARKS, heads=PREFIXES)
    stops = np.searchsorted(np.flatnonzero(_STOPS[data]), w.starts)
    text = w.texts
    if not len(text):
        none = np.zeros(0, np.int64)
        return Bags(np.zeros(len(column) + 1, np.int64), np.zeros(1, np.int64), none, none, none)
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (stops[1:] != stops[:-1])])
    lines = np.flatnonzero(new)
    features = np.empty((len(text), 1 + len(PREFIXES)), np.int32)
    features[:, 0] = mix(w.hashes) >> U(64 - BITS)
    for i, n in enumerate(PREFIXES, 1):
        features[:, i] = mix(np.where(w.ends - w.starts > n, w.heads.pop(n) + U(n), w.hashes)) >> U(64 - BITS)
    at = np.append(lines, len(text)) * (1 + len(PREFIXES))
    last = np.append(lines[1:], len(text)) - 1
    return Bags(np.searchsorted(text[lines], np.arange(len(column) + 1)), at, features.ravel(), w.starts[lines], w.ends[last])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """The log of 1 - s of each sentence."""
        if len(b.at) < 2:
            return np.zeros(0)
        z = self.bias + np.add.reduceat(self.weights[b.features], b.at[:-1]).astype(np.float64)
        return -np.logaddexp(0, z)

    def documents(self, b: Bags, logs: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(logs)])
        return np.where(np.diff(b.first) > 0, -np.expm1(np.minimum(0, sums[b.first[1:]] - sums[b.first[:-1]])), 0.0)


@dataclass
class Bag:
    """A labelled document's different sentences: how often each occurs and where its features, numbered from 0, begin and end."""

    label: int
    often: np.ndarray
    at: np.ndarray
    features: np.ndarray


def train(labelled: list[Bag], n: int) -> tuple[np.ndarray, float]:
    """(weights of n features, bias) of documents, by Adam on mini-batches.

    Without documents of both labels all weights stay 0. Each label has half of the weight.
    """
    weights, rng = np.zeros(n), np.random.default_rng(SEED)
    bias = BIAS
    y = np.array([d.label for d in labelled], dtype=float)
    if not len(y) or y.min() == y.max():
        return weights, bias
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    bm = bv = step = 0.0
    for _ in range(max(EPOCHS, STEPS * BATCH // len(labelled))):
        order = rng.permutation(len(labelled))
        for i in range(0, len(order), BATCH):
            picked = [j for j in order[i : i + BATCH] if len(labelled[j].often)]
            if not picked:
                continue
            some = [labelled[j] for j in picked]
            often = np.concatenate([d.often for d in some])
            features = np.concatenate([d.features for d in some])
            document = np.repeat(np.arange(len(some)), [len(d.often) for d in some])
            sentence = np.repeat(np.arange(len(often)), np.concatenate([np.diff(d.at) for d in some]))
            z = bias + np.bincount(sentence, weights[features], len(often))
            clean = np.bincount(document, -np.logaddexp(0, z) * often, len(some))
            p = np.maximum(-np.expm1(clean), 1e-12)
            pull = np.where(y[picked] == 1, np.exp(clean) / p, -1.0) * share[picked]
            g = -pull[document] * np.exp(-np.logaddexp(0, -z)) * often / len(some)
            grad = np.bincount(features, g[sentence], n) + DECAY * weights / len(some)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            bm, bv = 0.9 * bm + 0.1 * g.sum(), 0.999 * bv + 0.001 * g.sum() ** 2
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            weights -= rate * m / (np.sqrt(v) + 1e-8)
            bias -= rate * bm / (np.sqrt(bv) + 1e-8)
    return weights, float(bias)


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, rows: int, size: int) -> DataFrame:
    """(place, y, text) of at most rows documents of each label, of at most size bytes in all, numbered in order of a hash of the id."""
    marks = labels.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    order = [F.xxhash64("id"), F.col("id")]
    of = lambda df: [df.filter(F.col("y") == y).orderBy(*order, *[F.md5("text")][: "text" in df.columns]).limit(rows) for y in (0, 1)]
    few = of(marks)
    few = F.broadcast(few[0].unionByName(few[1]))  # at most 2 * rows rows of two numbers
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(few, "id")
    picked = of(texts)  # again, as ids can be repeated
    picked = shared.written(picked[0].unionByName(picked[1]).withColumn("n", F.monotonically_increasing_id()), "labelled")
    sizes = picked.select("n", F.col("y").cast("int").alias("y"), F.xxhash64("id").alias("o"), F.md5("text").alias("h"), F.octet_length("text").alias("size")).collect()
    left, kept = {0: size, 1: size}, []
    for r in sorted(sizes, key=lambda r: (r.y, r.o, r.h)):
        left[r.y] -= r.size
        if left[r.y] >= 0:
            kept.append((r.n, len(kept)))
    places = docs.sparkSession.createDataFrame(kept, "n long, place int")
    return shared.written(picked.join(F.broadcast(places), "n").select("place", F.col("y").cast("int").alias("y"), "text"), "labelled")


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES
) -> Model:
    """A model of the documents that labels marks, at most rows of each label and size bytes of their texts.

    Which features count is found by an aggregate; then only those of each different sentence, and how often it occurs, come to the
    driver. A document labelled both ways counts as toxic; null labels and ids are passed over; of repeated rows each counts.
    """
    shared.limit_batches(docs.sparkSession)
    texts = sample(docs, labels, id_column, text_column, label_column, rows, size)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                b = bags(batch.column("text"))
                for i, y in enumerate(batch.column("y").to_pylist()):
                    seen[y, np.unique(b.features[b.at[b.first[i]] : b.at[b.first[i + 1]]])] += 1
        found = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(seen[y][found]) for y in (0, 1))], ["feature", "clean", "toxic"])

    n = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(1 << BITS, np.float32), BIAS)
    total = n[0] + n[1]
    sums = texts.select("y", "text").mapInArrow(counted, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    overall = (F.col("clean") + F.col("toxic")) / total
    error = F.sqrt(overall * (1 - overall) * (1 / n[0] + 1 / n[1])) + 1e-12
    known = sums.filter((F.col("clean") + F.col("toxic") >= MIN_DOCUMENTS) & (F.col("toxic") / n[1] - F.col("clean") / n[0] > ERRORS * error))
    known = np.array(sorted(r.feature for r in known.select("feature").collect()), np.int64)  # at most 2 ** BITS
    number = np.full(1 << BITS, -1, np.int32)
    number[known] = np.arange(len(known))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                b = bags(batch.column("text"))
                out = []
                for i in range(batch.num_rows):
                    different: dict[bytes, int] = {}
                    for j in range(b.first[i], b.first[i + 1]):
                        f = number[b.features[b.at[j] : b.at[j + 1]]]
                        key = np.sort(f[f >= 0]).tobytes()
                        different[key] = different.get(key, 0) + 1
                    at = np.cumsum([0, *(len(k) // 4 for k in different)]).astype(np.int32)
                    out.append((np.array(list(different.values()), np.int32).tobytes(), at.tobytes(), b"".join(different)))
                yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("y"), *(pa.array([x[i] for x in out], pa.binary()) for i in range(3))], ["place", "y", "often", "at", "features"])

    got = sorted(texts.mapInArrow(reduced, "place int, y int, often binary, at binary, features binary").collect())
    weights, bias = train([Bag(r.y, *(np.frombuffer(x, np.int32) for x in (r.often, r.at, r.features))) for r in got], len(known))
    shared.removed(texts)
    full = np.zeros(1 << BITS, np.float32)
    full[known] = weights
    return Model(full, bias)


def score(df: DataFrame, model: Model, text_column: str = "text", spans: bool = True) -> DataFrame:
    """(row, score, offending): df's row as a struct, its text's score, and its offending sentences as code point spans.

    Whole texts are scored where they are read. A null or empty text has score 0 and no sentences; spans=False leaves them out.
    Repeated rows each give a row; an empty table gives none.
    """
    spark = df.sparkSession
    shared.limit_batches(spark)
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                b = bags(batch.column("text"))
                logs = sent.value.sentences(b)
                bad: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                if spans:
                    data, offsets = buffers(batch.column("text"))
                    for j in np.flatnonzero(-np.expm1(logs) >= OFFENDING):
                        i = int(np.searchsorted(b.first, j, side="right")) - 1
                        head = data[offsets[i] : b.starts[j]].tobytes().decode("utf-8", "replace")
                        inside = data[b.starts[j] : b.ends[j]].tobytes().decode("utf-8", "replace")
                        bad[i].append({"start": len(head), "end": len(head) + len(inside), "score": float(-np.expm1(logs[j]))})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sent.value.documents(b, logs)), pa.array(bad, kind)], ["row", "score", "offending"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, offending {SPANS}")
