"""Language-model scores by stupid backoff over counts of all documents.

The count tables are partitioned by n-gram hash and joined to the documents' n-grams, both in packed rows: a batch of documents
sends each block the sorted distinct hashes of its n-grams that fall there, with their counts; the block sums counts over all
batches and answers each row with the sums in the same order; the batch's words, sent as ranks, meet the answers and are scored
and summed by document. No row is ever made for a single occurrence, and an n-gram of any frequency is one entry a batch.

A document is scored against the counts of all others (its own are subtracted), so that repeating oneself doesn't count as
fluency. A word after its up to two predecessors has probability c(w1 w2 w3) / c(w1 w2) if that is above 0, else ALPHA times
c(w2 w3) / c(w2), else ALPHA ** 2 times c(w3) / N; a word that no other document has counts as 1 of N + 1, with one ALPHA more.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared
from lakebranch.llm.textops import U, column_words, mix, ngrams

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a batch: more save shuffled bytes, fewer save memory.
TEXT_BYTES = 8 << 20


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0, each in bytes of equal significance, compressed."""
    press, out = zstandard.ZstdCompressor(level=1), [struct.pack("<I", len(arrays))]
    for x in arrays:
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""
        data = press.compress(planes)
        out.append(struct.pack("<cII", x.dtype.char.encode(), len(x), len(data)) + data)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    (n,), at, out, press = struct.unpack_from("<I", data), 4, [], zstandard.ZstdDecompressor()
    for _ in range(n):
        kind, length, size = struct.unpack_from("<cII", data, at)
        at += struct.calcsize("<cII")
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(press.decompress(data[at : at + size]), np.uint8) if length else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, length).T).view(dtype).ravel() if length else np.zeros(0, dtype))
        at += size
    return out


def grams(hashes: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to order the places of the last words of n-grams, and their hashes; none crosses a text's bounds."""
    nth = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero(nth >= n - 1)
        out.append((at, ngrams(hashes, n)[at - n + 1] if len(at) else np.zeros(0, dtype=U)))
    return out


def counted(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs."""
    if weights is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, weights = hashes[order], weights[order]
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[new], np.diff(np.append(new, len(hashes))) if weights is None else np.add.reduceat(weights, new)


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """(for each hash its place among the distinct ones in order, how many there are)."""
    order = np.argsort(hashes)
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, int(np.count_nonzero(new))


def firsts(place: np.ndarray, n: int) -> np.ndarray:
    """Where each of n places occurs, any one occurrence."""
    out = np.empty(n, np.int64)
    out[place] = np.arange(len(place))
    return out


def batch_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, hashes of all words) of a batch, worked out in parts."""
    parts = [column_words(x.column("text")) for x in shared.sliced(batch, "text", 2 << 20)]
    return np.concatenate([w.counts for w in parts]), np.concatenate([w.hashes for w in parts])


def distinct_grams(lengths: np.ndarray, hashes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(lengths)])
    return counted(np.concatenate([h for _, h in grams(hashes, first, order)]))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(name, rows) of batches of bounded text; names tell the partition and the place in it."""
    number = TaskContext.get().partitionId() << 20
    for whole in batches:
        if whole.num_rows:
            for batch in shared.sliced(whole, "text", TEXT_BYTES):
                yield number, batch
                number += 1


def requests(rows: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, batch, data) of rows (id, text): for each block of a batch's distinct n-grams their hashes, in order, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch in numbered(batches):
            known, counts = distinct_grams(*batch_words(batch), order)
            block = ((known >> U(48)) * U(parts)) >> U(16)
            lines = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            ends = np.append(lines[1:], len(block))
            data = [packed(np.diff(known[i:j], prepend=U(0)), counts[i:j].astype(np.uint32)) for i, j in zip(lines, ends, strict=len(lines) > 0)]
            names = np.full(len(data), name, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block[lines].astype(np.int32)), pa.array(names), pa.array(data, pa.binary())], ["block", "batch", "data"])

    return rows.mapInArrow(run, "block int, batch long, data binary")


def batch_rows(rows: DataFrame, kind: str) -> DataFrame:
    """(batch, block, ids, data) of rows (id, text): a row of a batch's ids and words, block -1.

    The rows are read a second time here, in the same batches as in requests(), which scored() makes sure of by the sum of their
    n-grams' hashes; lm_scores() writes rows first that might come in another order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch in numbered(batches):
            lengths, hashes = batch_words(batch)
            vocabulary, at, often = np.unique(hashes, return_inverse=True, return_counts=True)
            by_rank = np.argsort(-often, kind="stable")
            rank = np.empty(len(by_rank), np.uint32)
            rank[by_rank] = np.arange(len(by_rank))
            data = packed(lengths.astype(np.uint32), vocabulary[by_rank], rank[at])
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), ids, pa.array([data], pa.binary())], ["batch", "block", "ids", "data"])

    return rows.mapInArrow(run, f"batch long, block int, ids array<{kind}>, data binary")


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """The rows of asked with counts summed over all batches, then the sum of the hashes counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for block, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(block, []).append((name, data))
        for block in list(held):
            rows = held.pop(block)
            hashes, counts = [], []
            for _, data in rows:
                steps, c = unpacked(data)
                hashes.append(np.cumsum(steps, dtype=U))
                counts.append(c)
            known, sums = counted(np.concatenate(hashes), np.concatenate(counts).astype(np.int64))
            del counts
            for (name, _), mine in zip(rows, hashes, strict=True):
                found = sums[np.searchsorted(known, mine)]
                small = found.astype(np.uint32) if not len(found) or found.max() < 1 << 32 else found.astype(U)
                data = packed(small, np.sum(mine, dtype=U, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["batch", "block", "data"])

    return asked.repartitionById(parts, F.col("block")).mapInArrow(run, "batch long, block int, data binary")


def scored(first: np.ndarray, hashes: np.ndarray, counts: np.ndarray, check: int, order: int, alpha: float) -> dict[str, np.ndarray]:
    """By text: words, the sum of log probabilities but for N, and how many words were scored by each way."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    spans = grams(hashes, first, order)
    whole = np.concatenate([h for _, h in spans])
    place, distinct = grouped(whole)
    if distinct != len(counts) or int(np.sum(whole[firsts(place, distinct)], dtype=U)) != check:
        raise ValueError("the rows came in other batches when they were read again; write them to a table first")
    # an n-gram of one text: equal only where both are, but for one chance in 2 ** 64
    mine, n_mine = grouped(mix(whole ^ (np.concatenate([text[at] for at, _ in spans]).astype(U) + U(1)) * U(0x9E3779B97F4A7C15)))
    rest = counts[place] - np.bincount(mine, minlength=n_mine)[mine]
    others, upto = [], 0  # by length, the count in other texts of the n-gram that ends at each place; 0 where none does
    for at, h in spans:
        full = np.zeros(len(hashes), np.int64)
        full[at] = rest[upto : upto + len(h)]
        upto += len(h)
        others.append(full)
    nth = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    left = np.ones(len(hashes), dtype=bool)
    logs, by_length = np.zeros(len(hashes)), {}
    for k in range(order, 1, -1):
        hit = left & (others[k - 1] > 0)
        at = np.flatnonzero(hit)
        skipped = np.minimum(order, nth[at] + 1) - k
        logs[at] = np.log(others[k - 1][at]) - np.log(others[k - 2][at - 1]) + skipped * math.log(alpha)
        by_length[k], left = hit, left & ~hit
    at = np.flatnonzero(left)
    seen = others[0][at] > 0
    skipped = np.minimum(order, nth[at] + 1) - 1
    logs[at] = np.log(np.maximum(others[0][at], 1)) + (skipped + ~seen) * math.log(alpha)
    sums = lambda x: np.bincount(text, weights=x, minlength=n)
    one, none = np.zeros(len(hashes)), np.zeros(len(hashes))
    one[at[seen]], none[at[~seen]] = 1, 1
    return {"n_words": np.diff(first), "log_sum": sums(logs), "n_single": sums(one), "n_unseen": sums(none), "n_longest": sums(by_length.get(order, one) * 1.0)}


def lm_scores(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """(id, n_words, n_longest, n_unseen, log_score, mean_log_score) of each row's whole text.

    log_score is the sum of the words' natural log probabilities, mean_log_score that by word; n_longest words were scored by the
    longest n-gram, n_unseen are in no other row. A text without words, or a null one, has 0 words, score 0 and a null mean. A row's
    own counts are left out, an equal row's are not. Repeated rows each give a row; an empty table gives none; other columns are
    left out.
    """
    spark = df.sparkSession
    shared.limit_batches(spark)
    parts = min(shared.partitions(spark), 1 << 16)
    rows = shared.steady(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))  # it is read twice
    kind = rows.schema["id"].dataType.simpleString()

    def work(ids: pa.Array, words: bytes, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        lengths, vocabulary, rank = unpacked(words)
        got = [unpacked(data) for _, data in sorted(found)]
        counts = np.concatenate([np.zeros(0, np.int64), *(g[0].astype(np.int64) for g in got)])
        check = sum(int(g[1][0]) for g in got) % 2**64
        first = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        got = scored(first, vocabulary[rank] if len(rank) else np.zeros(0, U), counts, check, order, alpha)
        names = ["n_words", "n_longest", "n_single", "n_unseen"]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(got[x].astype(np.int64)) for x in names), pa.array(got["log_sum"])], ["id", *names, "log_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, words, found = None, None, b"", []
        for batch in batches:
            lists = batch.column("ids")
            for i, (name, block, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("batch", "block", "data")), strict=True)):
                if name != now:
                    if now is not None:
                        yield work(ids, words, found)
                    now, found = name, []
                if block < 0:
                    ids, words = lists[i].values, data
                else:
                    found.append((block, data))
        if now is not None:
            yield work(ids, words, found)

    answered = answers(requests(rows, order, parts), parts).withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    # consecutive places of the golden ratio's multiples: batches are spread evenly, not at random
    to = F.pmod(F.floor((F.shiftright("batch", 20) * 0.6180339887498949 % 1) * parts) + F.col("batch").bitwiseAND((1 << 20) - 1), F.lit(parts)).cast("int")
    met = batch_rows(rows, kind).unionByName(answered).repartitionById(parts, to).sortWithinPartitions("batch")
    schema = f"id {kind}, n_words long, n_longest long, n_single long, n_unseen long, log_sum double"
    sums = shared.written(met.mapInArrow(run, schema), "lm-sums")
    total = sums.agg(F.sum("n_words")).first()[0] or 0
    rest = F.lit(total) - F.col("n_words")
    log_score = F.col("log_sum") - F.when(F.col("n_single") > 0, F.col("n_single") * F.log(rest)).otherwise(0.0) - F.col("n_unseen") * F.log(rest + 1)
    out = sums.withColumn("log_score", log_score).withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
    return out.select(F.col("id").alias(id_column), "n_words", "n_longest", "n_unseen", "log_score", "mean_log_score")
