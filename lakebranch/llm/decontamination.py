"""Benchmark decontamination by spaced seeds.

A seed hashes the words at a mask's ones and ignores those at its zeros, so that it survives substituted words there.

1. The benchmark's seeds make a table (seed, item) and a bit filter of bounded size.
2. One pass over the texts hashes their seeds; a text of which the filter lets one through keeps its words and those seeds.
3. The two seed tables are joined, hot seeds salted, which gives the pairs of text and item that can overlap.
4. Item and text of a pair are laid over each other along each diagonal on which a seed hits, and of all stretches of words that
   agree at IDENTITY or more, substitutions included, that of most agreeing words decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared
from lakebranch.llm.textops import _PLACE, U, Words, column_words, mix, ngrams

#: Ones are compared, zeros ignored; all start and end with a one.
MASKS = ("11111", "1101011", "11001011", "101100101")
#: Items and texts of fewer words than this have no seed but their whole sequence.
SHORT = min(map(len, MASKS))
#: The least number of agreeing words, for shorter items a share of their words; and the least share within the stretch.
LEAST_WORDS, LEAST_SHARE, IDENTITY = 12, 0.7, 0.7
#: Scores of a word that agrees and of one that doesn't, in percent: a stretch's sum is 0 or more just where its share is IDENTITY or more.
AGREES = round(100 * (1 - IDENTITY))
DIFFERS = AGREES - 100
#: The filter has FILTER_BITS bits for each seed, within the powers of two named by FILTER_RANGE (128 KB to 64 MB), in chunks of 2 ** CHUNK bits.
FILTER_BITS, FILTER_RANGE, CHUNK = 32, (20, 29), 20
#: Places of one seed in text and item are matched by convolution where their pairs are so many times the words of both.
DENSE = 16


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place that has a whole mask from it, text bounds aside."""
    m = len(hashes) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    out = np.full(m, len(mask), dtype=U)
    for i, bit in enumerate(mask):
        if bit == "1":
            out += hashes[i : i + m] * _PLACE[i]
    return mix(out)


def text_seeds(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, seed) by mask of all places of a run of texts, then of the whole sequences of short texts."""
    texts, counts = w.texts, w.counts
    for mask in MASKS:
        found = seeds(w.hashes, mask)
        inside = np.flatnonzero(np.arange(len(found)) + len(mask) <= w.first[1:][texts[: len(found)]])
        yield texts[inside], found[inside]
    for n in range(1, SHORT):
        some = np.flatnonzero(counts == n)
        if len(some):
            yield some, ngrams(w.hashes, n)[w.first[some]]


def probes(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a seed in a filter of 2 ** bits bits."""
    return (seed >> U(64 - bits)).astype(np.int64), ((seed * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64)


def passing(filter_: np.ndarray, seed: np.ndarray, bits: int) -> np.ndarray:
    """Places of the seeds that the filter lets through."""
    out = np.arange(len(seed))
    for i in range(2):
        at = probes(seed[out], bits)[i]
        out = out[filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
    return out


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, agreeing words) of the stretch of most agreeing words, and of those the shortest, with a share of IDENTITY or more."""
    run = np.concatenate([[0], np.cumsum(np.where(same, AGREES, DIFFERS))])
    agreed = np.concatenate([[0], np.cumsum(same)])
    # for each end, the first place from which the sum is 0 or more: the first at which the least sum so far is no more than the end's
    begin = np.searchsorted(-np.minimum.accumulate(run), -run)
    got = agreed - agreed[begin]
    ends = np.flatnonzero(got == got.max())
    places = np.append(np.flatnonzero(same), len(same))
    firsts = places[agreed[begin[ends]]]  # a stretch starts at its first agreeing word
    k = int(np.argmin(ends - firsts))
    return int(firsts[k]), int(ends[k]), int(got[ends[k]])


def diagonals(text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Places of the text, in order, at which the item's first word lies where a seed of both hits; they can be under 0.

    A seed that both repeat has as many hits as the product of its places: past DENSE times the words, a convolution of the places finds
    the diagonals instead, in time near linear in the words.
    """
    length = len(text) + len(item)
    hit = np.zeros(length + 1, dtype=bool)
    for mask in MASKS:
        own, theirs = seeds(text, mask), seeds(item, mask)
        order = np.argsort(theirs, kind="stable")
        known, first, often = np.unique(theirs[order], return_index=True, return_counts=True)
        if not len(known) or not len(own):
            continue
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = np.flatnonzero(known[place] == own)
        place = place[at]
        in_text = np.bincount(place, minlength=len(known))
        dense = in_text * often > DENSE * length
        for k in np.flatnonzero(dense):
            size = 1 << int(length).bit_length()
            one, two = np.zeros(size), np.zeros(size)
            one[at[place == k]] = 1
            two[len(item) - order[first[k] : first[k] + often[k]]] = 1
            hit |= np.fft.irfft(np.fft.rfft(one) * np.fft.rfft(two), size)[: length + 1] > 0.5
        at, place = at[~dense[place]], place[~dense[place]]
        n = often[place]
        upto = np.cumsum(n)
        for i in range(0, int(upto[-1]) if len(n) else 0, 1 << 20):  # a bounded number of hits at once
            nth = np.arange(i, min(i + (1 << 20), int(upto[-1])))
            of = np.searchsorted(upto, nth, side="right")
            hit[at[of] - order[first[place[of]] + nth - (upto[of] - n[of])] + len(item)] = True
    return np.flatnonzero(hit) - len(item)


def overlap(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """(first word in the text, words, agreeing words) of the best stretch: most agreeing words, then fewest words, then the first."""
    if len(item) < SHORT:
        return (0, len(item), len(item)) if len(item) and np.array_equal(text, item) else None
    least = min(LEAST_WORDS, int(np.ceil(LEAST_SHARE * len(item))))
    starts = diagonals(text, item)
    low, high = np.maximum(starts, 0), np.minimum(starts + len(item), len(text))
    counts = np.array([np.count_nonzero(text[i:j] == item[i - s : j - s]) for s, i, j in zip(starts.tolist(), low.tolist(), high.tolist(), strict=True)], np.int64)
    best = None  # (-agreeing, words, start)
    for k in np.lexsort((starts, -counts)):
        if counts[k] < least or best and (counts[k] < -best[0] or counts[k] == best[1] and low[k] >= best[2]):
            break
        s, i, j = int(starts[k]), int(low[k]), int(high[k])
        begin, end, agree = stretch(text[i:j] == item[i - s : j - s])
        if agree >= least and (best is None or (-agree, end - begin, i + begin) < best):
            best = (-agree, end - begin, i + begin)
    return best and (best[2], best[1], -best[0])


def as_bytes(w: Words) -> list[bytes]:
    """The word hashes of each text."""
    return [w.hashes[i:j].tobytes() for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]


def benchmark(items: DataFrame, item_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, words), (item, seed) and the filter's chunks of a benchmark, items numbered; written tables."""
    rows = items.select(F.col(item_column).alias("name"), F.col(text_column).alias("text")).filter("text IS NOT NULL")
    kind = rows.schema["name"].dataType.simpleString()

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                w = column_words(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(as_bytes(w), pa.binary())], ["name", "words"]).filter(pa.array(w.counts > 0))

    known = shared.written(rows.mapInArrow(tokenised, f"name {kind}, words binary").withColumn("item", F.monotonically_increasing_id()), "items")

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
                hashes = np.frombuffer(data, U)
                w = Words(np.array([0, len(hashes)]), hashes, hashes, hashes, {})
                found = np.unique(np.concatenate([h for _, h in text_seeds(w)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), pa.array(found.view(np.int64))], ["item", "seed"])

    table = shared.written(known.select("item", "words").mapInArrow(seeded, "item long, seed long"), "seeds")
    bits = min(max(int(FILTER_BITS * table.count()).bit_length(), FILTER_RANGE[0]), FILTER_RANGE[1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(probes(batch.column("seed").to_numpy().view(U), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> CHUNK), pa.array(at & (1 << CHUNK) - 1)], ["chunk", "at"])

    def chunked(group: pa.Table) -> pa.Table:
        one = np.zeros(1 << CHUNK, dtype=np.uint8)
        one[group.column("at").to_numpy()] = 1
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "data": pa.array([np.packbits(one, bitorder="little").tobytes()], pa.binary()), "bits": pa.array([bits])})

    chunks = table.select("seed").mapInArrow(placed, "chunk long, at long").distinct().groupBy("chunk").applyInArrow(chunked, "chunk long, data binary, bits long")
    return known, table, chunks


def spread(large: DataFrame, small: DataFrame, key: str, row: str) -> DataFrame:
    """large joined to small on key. A key of more of large's rows than a partition's share is dealt over all partitions by row.

    There are fewer such keys than partitions, so they are broadcast.
    """
    parts = shared.partitions(large.sparkSession)
    share = max(1, large.count() // parts)
    hot = F.broadcast(large.groupBy(key).count().filter(F.col("count") > share).select(key, F.lit(True).alias("hot")))
    salted = large.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(row), F.lit(parts))).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(small.join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("hot"), [key, "salt"]).drop("salt")


def found(rows: DataFrame, items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """(key, item, start_word, n_words, n_agreeing) of rows (key, text), one for each row and item that overlap."""
    spark = rows.sparkSession
    shared.limit_batches(spark)
    key_kind, item_kind = rows.schema["key"].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    known, table, chunks = benchmark(items, item_column, text_column)
    parts = chunks.collect()  # at most 2 ** (FILTER_RANGE[1] - CHUNK) chunks of 128 KB
    if not parts:
        return spark.createDataFrame([], f"key {key_kind}, item {item_kind}, start_word int, n_words int, n_agreeing int")
    bits = parts[0].bits
    filter_ = np.zeros(1 << bits - 3, dtype=np.uint8)
    for p in parts:
        filter_[p.chunk << CHUNK - 3 : p.chunk + 1 << CHUNK - 3] = np.frombuffer(p.data, np.uint8)
    sent = spark.sparkContext.broadcast(filter_)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                w = column_words(batch.column("text"))
                got = [(texts[some], h[some]) for texts, h in text_seeds(w) for some in [passing(sent.value, h, bits)]]
                texts, hashes = (np.concatenate([g[i] for g in got]) for i in range(2))
                if not len(texts):
                    continue
                order = np.lexsort((hashes, texts))
                texts, hashes = texts[order], hashes[order]
                new = np.concatenate([[True], (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])])
                texts, hashes = texts[new], hashes[new]
                some, at = np.unique(texts, return_index=True)
                lists = pa.ListArray.from_arrays(np.append(at, len(texts)).astype(np.int32), pa.array(hashes.view(np.int64)))
                data = [w.hashes[w.first[i] : w.first[i + 1]].tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some)), pa.array(data, pa.binary()), lists], ["key", "words", "seeds"])

    hits = rows.mapInArrow(hit, f"key {key_kind}, words binary, seeds array<long>").withColumn("n", F.monotonically_increasing_id())
    hits = shared.written(hits, "hits")
    pairs = shared.written(spread(hits.select("n", F.explode("seeds").alias("seed")), table, "seed", "n").select("n", "item").distinct(), "pairs")
    asked = spread(pairs, known, "item", "n").select("n", F.lit(None).cast(key_kind).alias("key"), "words", F.col("name").alias("item"), F.lit(1).alias("side"))
    own = hits.join(pairs.select("n").distinct(), "n", "left_semi").select("n", "key", "words", F.lit(None).cast(item_kind).alias("item"), F.lit(0).alias("side"))
    met = own.unionByName(asked).repartition(shared.partitions(spark), "n").sortWithinPartitions("n", "side")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = None, np.zeros(0, U)  # of the text that the rows of side 1 that follow ask of
        for batch in batches:
            sides, data = batch.column("side").to_pylist(), batch.column("words")
            out, keys, rows_ = [], [], []
            for i, side in enumerate(sides):
                words = np.frombuffer(data[i].as_py(), U)
                if side == 0:
                    key, text = batch.column("key").slice(i, 1), words
                elif best := overlap(text, words):
                    keys.append(key)
                    rows_.append(i)
                    out.append(best)
            if out:
                values = [pa.array([x[i] for x in out], pa.int32()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), batch.column("item").take(pa.array(rows_)), *values], ["key", "item", "start_word", "n_words", "n_agreeing"])

    out = shared.written(met.mapInArrow(verified, f"key {key_kind}, item {item_kind}, start_word int, n_words int, n_agreeing int"), "overlaps")
    shared.removed(known, table, hits, pairs)
    return out


def overlaps(df: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """(id, item, start_word, n_words, n_agreeing) for each row and benchmark item that share a stretch of words.

    An item of fewer than SHORT words has no seed; it overlaps only with texts of just the same words, so that a word or two found
    anywhere flag nothing. Null and empty texts and items share nothing; repeated rows and repeated items each give their rows, null ids
    too; an empty benchmark or table gives none. Other columns are left out. Ids can be of any type.
    """
    rows = df.select(F.struct(F.col(id_column).alias("id")).alias("key"), F.col(text_column).alias("text"))
    got = found(rows, items, item_column, "text")
    return got.select(F.col("key.id").alias(id_column), F.col("item").alias(item_column), "start_word", "n_words", "n_agreeing")


def clean(df: DataFrame, items: DataFrame, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The rows of df, all columns, that share no stretch with any item.

    Texts are told apart by their MD5, so that equal texts are decided alike. Rows with a null or empty text
    stay, as do all where the benchmark is empty; repeated rows stay or go together.
    """
    row = F.struct(*[df[f"`{c}`"] for c in df.columns])
    rows = df.select(row.alias("row"), F.col(text_column).alias("text"))
    got = found(rows.select(F.unhex(F.md5("text")).alias("key"), "text"), items, item_column, "text")
    bad = got.select("key").distinct()  # 16 bytes a text: Spark broadcasts them where they are few, and splits the shuffled copies of one text
    return rows.select("row", F.unhex(F.md5("text")).alias("key")).join(bad, "key", "left_anti").select("row.*")
