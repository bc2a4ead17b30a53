"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A text is cut into pre-tokens by the vocabulary's pattern. Most occurrences are of few pre-tokens: their token counts come from a
broadcast table of at most TABLE entries; the others are encoded by the library and kept in the worker's bounded cache. Counts
are the library's own either way; the table changes the time they take, not the result.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared

#: Entries of the broadcast table, each of at most LONG characters: a few MB at any input size.
TABLE, LONG = 1 << 16, 32
#: The table's pre-tokens are counted in so many rows of each partition on average, spread over all rows, and each partition gives so many.
SAMPLE_ROWS, SAMPLE_KEPT = 64, 1 << 13
#: Pre-tokens that a worker keeps; when full, the cache starts anew.
CACHE = 1 << 18
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counts:
    """Counts tokens of texts with a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in self.library.get_added_tokens_decoder().values())
        kind = type(self.library.pre_tokenizer).__name__
        #: Else the library does it all.
        self.known = plain and self.library.normalizer is None and self.library.post_processor is None and kind == "ByteLevel" and not self.library.pre_tokenizer.add_prefix_space
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.find = regex.compile(PATTERN).findall
        #: Letters and digits newer than the library's character tables may be classed otherwise there.
        self.newer = regex.compile(r"[\p{L}\p{N}--[" + self._old() + "]]", regex.V1).search
        self.frequent, self.cache = frequent or {}, {}

    @staticmethod
    @cache
    def _old() -> str:
        """Ranges of the characters that are assigned in Python's own, older tables."""
        import sys
        import unicodedata

        out, start = [], None
        for c in range(sys.maxunicode + 2):
            old = c <= sys.maxunicode and unicodedata.category(chr(c)) not in ("Cn", "Cs")
            if old and start is None:
                start = c
            elif not old and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    def by_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def count(self, text: str) -> int:
        if not self.known:
            return self.by_library(text)
        pieces, n = [text], 0
        if self.special and (found := self.special.findall(text)):
            pieces, n = self.special.split(text), len(found)
        for piece in pieces:
            found = self.find(piece)
            got = list(map(self.frequent.get, found))
            if None in got:
                rest = [t for t, v in zip(found, got, strict=True) if v is None]
                n += sum(v for v in got if v is not None)
                missed = [t for t in dict.fromkeys(rest) if t not in self.cache]
                if missed:
                    if any(map(self.newer, missed)):
                        return self.by_library(text)
                    if len(self.cache) + len(missed) > CACHE:
                        self.cache.clear()
                        missed = list(dict.fromkeys(rest))
                    for t, e in zip(missed, self.library.encode_batch_fast(missed, add_special_tokens=False), strict=True):
                        self.cache[t] = len(e)
                n += sum(map(self.cache.__getitem__, rest))
            else:
                n += sum(got)
        return n


_OPEN: dict[tuple, Counts] = {}


def counter(path: str, key: int = 0, frequent: dict[str, int] | None = None) -> Counts:
    """A worker opens a vocabulary once for each table."""
    if (path, key) not in _OPEN:
        _OPEN.clear()
        _OPEN[path, key] = Counts(path, frequent)
    return _OPEN[path, key]


def frequent_table(texts: DataFrame, path: str) -> dict[str, int]:
    """Token counts of at most TABLE frequent pre-tokens of rows (text), from a sample spread over all rows, of SAMPLE_ROWS a partition on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = counter(path), Counter()
        if not c.known:
            return
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(t for t in c.find(text) if len(t) <= LONG)
        kept = [(t, n) for t, n in seen.most_common(SAMPLE_KEPT) if n > 1 and not c.newer(t)]
        yield pa.RecordBatch.from_pylist([{"t": t, "n": n} for t, n in kept], pa.schema([("t", pa.string()), ("n", pa.int64())]))

    apart = max(1, texts.count() // (SAMPLE_ROWS * max(1, texts.rdd.getNumPartitions())))
    some = texts.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(apart)) == 0)
    top = some.mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(TABLE)
    found = [row.t for row in top.select("t").collect()]
    c = Counts(path)
    special = c.special.search if c.special else lambda t: None
    found = [t for t in found if not special(t)]
    return dict(zip(found, map(len, c.library.encode_batch_fast(found, add_special_tokens=False)), strict=True)) if found else {}


def token_counts(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row's whole text, as the vocabulary file at path counts it.

    path must be readable on every executor. No begin, end or other added tokens, no truncation; the strings of special tokens in
    a text are read as the library does by default. A null text is empty and has 0 of either; repeated rows each give a row;
    an empty table gives none; other columns are left out.
    """
    spark = df.sparkSession
    shared.limit_batches(spark)
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    table = spark.sparkContext.broadcast(frequent_table(rows.select("text"), path))
    key = id(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, key, table.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = pa.array([c.count(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), counts], ["id", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    both = rows.select(F.struct("id", F.octet_length("text").cast("long").alias("n_bytes")).alias("id"), "text")
    out = both.mapInArrow(run, f"id struct<id:{kind},n_bytes:bigint>, n_tokens long")
    return out.select(F.col("id.id").alias(id_column), "id.n_bytes", "n_tokens")
