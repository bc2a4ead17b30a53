"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Columns (n-grams) are dealt into blocks by hash; a document's entries for a block travel as one packed row. Rows of equal n-gram
   sets are one class from the start. A block drops columns held by a single class and gives each other entry its column's count.
2. A class can only have partners if at least need(n) of its n entries are in such columns, need(n) = ceil(t * n) for a least
   similarity t: by this bound most classes leave. The others' entries are put in one order, rarest columns first.
3. Two partners share a column among each one's first n - need(n) + 1 entries, so only those enter the product; and where they
   first meet, what each one has from there on must be enough. A star round first matches each column's classes with the one whose
   entries are the most widely held, which joins groups of near copies without all of their pairs; columns whose classes are joined
   by then leave. What remains is multiplied out: overlaps are summed by pair, and pairs are discarded whose overlap so far plus
   what can follow the last shared entry is below the bound.
4. Overlaps of the pairs left are counted over all entries, and exact links form the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakebranch.llm import components, shared
from lakebranch.llm.textops import U, column_words, distinct, mix, shingles

WORDS, PERCENT = 5, 75
#: Bytes of text whose entries are packed together: fewer take less memory, more make fewer rows.
BLOCK_BYTES = 8 << 20


def entries(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram) of the distinct n-grams of each text, in order, then each text's number of them and its class."""
    owner, hashed, _ = distinct(*shingles(column_words(column), n))
    sizes = np.bincount(owner, minlength=len(column))
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(mix(hashed ^ U(0x5851F42D4C957F2D)), dtype=U)])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return owner, hashed, sizes, mix((sums[upto[1:]] - sums[upto[:-1]]) + sizes.astype(U))


def memberships(rows: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, class) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, "text"):
                *_, sizes, classes = entries(batch.column("text"), n)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(classes.view(np.int64))], ["id", "n_shingles", "class"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, class long")


def blocks(rows: DataFrame, n: int, parts: int) -> DataFrame:
    """(block, packed) of rows (id, text): for each class of a batch, its entries in the block."""

    def packed(classes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, hashed: np.ndarray) -> bytes:
        own, counts = np.unique(owner, return_counts=True)
        low = hashed & U(0xFFFFFFFF)
        return b"".join(
            x.tobytes()
            for x in (
                np.array([len(own), len(hashed)], np.uint32), classes[own], sizes[own].astype(np.uint32), counts.astype(np.uint32),
                low.astype(np.uint32), ((hashed >> U(32)) & U(0xFFFF)).astype(np.uint16),
            )
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in (part for batch in batches for part in shared.sliced(batch, "text", BLOCK_BYTES)):
            got = [entries(b.column("text"), n) for b in shared.sliced(whole, "text")]
            base = np.cumsum([0, *(len(g[2]) for g in got)])
            owner = np.concatenate([g[0] + at for g, at in zip(got, base, strict=False)])
            hashed, sizes, classes = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
            del got
            first = np.zeros(len(classes), dtype=bool)
            first[np.unique(classes, return_index=True)[1]] = True
            keep = first[owner]
            owner, hashed = owner[keep], hashed[keep]
            block = ((hashed >> U(48)) * U(parts)) >> U(16)
            order = np.argsort(block.astype(np.uint16), kind="stable")
            owner, hashed, block = owner[order], hashed[order], block[order]
            lines = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            ends = [*lines[1:], len(block)]
            out = [packed(classes, sizes, owner[i:j], hashed[i:j]) for i, j in zip(lines, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[lines].astype(np.int32) if len(block) else [], pa.int32()), pa.array(out, pa.binary())], ["block", "packed"])

    return rows.mapInArrow(run, "block int, packed binary")


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, sizes, entry counts, low 48 bits of the entries' hashes)."""
    k, m = np.frombuffer(data, np.uint32, 2).tolist()
    classes = np.frombuffer(data, U, k, 8)
    sizes, counts = np.frombuffer(data, np.uint32, 2 * k, 8 + 8 * k).reshape(2, k)
    low = np.frombuffer(data, np.uint32, m, 8 + 16 * k).astype(U)
    return classes, sizes, counts, low | (np.frombuffer(data, np.uint16, m, 8 + 16 * k + 4 * m).astype(U) << U(32))


def shared_entries(packed: DataFrame, parts: int) -> DataFrame:
    """(bucket, block, packed): each class's entries of the block in columns of two classes or more, by the bucket of the class."""

    def work(block: int, rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(x) for x in rows]
        names, node = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        size = np.zeros(len(names), np.uint32)
        size[node] = np.concatenate([g[1] for g in got])
        holder = np.repeat(node.astype(np.uint32), np.concatenate([g[2] for g in got]))
        column = np.concatenate([g[3] for g in got])
        del got
        order = np.argsort(column)
        column, holder = column[order], holder[order]
        again = np.zeros(len(column) + 1, dtype=bool)
        again[1:-1] = column[1:] == column[:-1]
        many = again[1:] | again[:-1]
        column, holder = column[many], holder[many]
        del order, again, many, node
        order = np.lexsort((holder, column))
        column, holder = column[order], holder[order]
        if not len(column):
            return
        new = np.concatenate([[True], (column[1:] != column[:-1]) | (holder[1:] != holder[:-1])])
        column, holder = column[new], holder[new]  # a class that came from several batches counts once
        lines = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        count = np.diff(np.append(lines, len(column)))
        held = np.repeat(count, count)
        column, holder, held = column[held > 1], holder[held > 1], held[held > 1]
        if not len(column):
            return
        bucket = (names % U(parts)).astype(np.int32)
        order = np.lexsort((holder, bucket[holder]))
        column, holder, held = column[order], holder[order], held[order]
        own, at, counts = np.unique(holder + (bucket[holder].astype(np.int64) << 32), return_index=True, return_counts=True)
        owner, to = holder[at], bucket[holder[at]]
        ends = np.append(at, len(holder))
        lines = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        out = []
        for i, j in zip(lines, np.append(lines[1:], len(to)), strict=True):
            mine, some = slice(ends[i], ends[j]), owner[i:j]
            ids = column[mine]
            arrays = (
                np.array([j - i, len(ids)], np.uint32), names[some], size[some], counts[i:j].astype(np.uint32), held[mine].astype(np.uint32),
                (ids & U(0xFFFFFFFF)).astype(np.uint32), (ids >> U(32)).astype(np.uint16),
            )
            out.append(b"".join(x.tobytes() for x in arrays))
        n = len(out)
        yield pa.RecordBatch.from_arrays([pa.array(to[lines]), pa.array(np.full(n, block, np.int32)), pa.array(out, pa.binary())], ["bucket", "block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.setdefault(block, []).append(data)
        for block in list(rows):
            yield from work(block, rows.pop(block))

    dealt = packed.repartitionById(parts, F.col("block"))
    return dealt.mapInArrow(run, "bucket int, block int, packed binary")


def likely(found: DataFrame, parts: int, percent: int) -> DataFrame:
    """(class, n, mass, columns) of classes with enough shared entries for a partner: columns are ordered by how many hold them, mass is
    the mean of that over all n."""

    def work(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts_: list[list[np.ndarray]] = [[], [], [], []]
        for block, data in rows:
            k, m = np.frombuffer(data, np.uint32, 2).tolist()
            classes = np.frombuffer(data, U, k, 8)
            n, counts = np.frombuffer(data, np.uint32, 2 * k, 8 + 8 * k).reshape(2, k)
            held, low = np.frombuffer(data, np.uint32, 2 * m, 8 + 16 * k).reshape(2, m)
            high = np.frombuffer(data, np.uint16, m, 8 + 16 * k + 8 * m)
            ids = U(block) << U(48) | high.astype(U) << U(32) | low.astype(U)
            for x, y in zip(parts_, (np.repeat(classes, counts), np.repeat(n, counts), held, ids), strict=True):
                x.append(y)
        owner, n, held, ids = (np.concatenate(x) for x in parts_)
        names, at, inverse, counts = np.unique(owner, return_index=True, return_inverse=True, return_counts=True)
        sizes = n[at].astype(np.int64)
        keep = counts >= -(-sizes * percent // 100)
        inside = keep[inverse]
        inverse, held, ids = inverse[inside], held[inside], ids[inside]
        order = np.lexsort((ids, held, inverse))
        held, ids = held[order], ids[order]
        names, sizes, counts = names[keep], sizes[keep], counts[keep]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
        mass = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(sizes, 1)
        for i in range(0, len(names), 1024):
            some = slice(i, i + 1024)
            o = offsets[i : i + 1025]
            lists = pa.ListArray.from_arrays((o - o[0]).astype(np.int32), pa.array(ids[o[0] : o[-1]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names[some].view(np.int64)), pa.array(sizes[some]), pa.array(mass[some]), lists], ["class", "n", "mass", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for bucket, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault(bucket, []).append((block, data))
        for bucket in list(rows):
            yield from work(rows.pop(bucket))

    return found.repartitionById(parts, F.col("bucket")).mapInArrow(run, "class long, n long, mass double, columns array<long>")


def need(n: Column, percent: int) -> Column:
    """The least overlap of a set of n with any partner."""
    return F.ceil(n * percent / 100).cast("long")


def linked(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return overlap * (100 + percent) >= percent * (n + m)


def exact_links(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b) that link, by overlaps over all entries of rows (class, n, columns)."""
    one, two = (rows.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("columns").alias(f"columns_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    overlap = F.size(F.array_intersect("columns_a", "columns_b"))
    return both.filter(linked(overlap, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two entries of one column can be the first that a linked pair shares: all further ones come after both."""
    n_a, n_b, nth_a, nth_b = (F.col(f"{c}_{x}") for c in ("n", "nth") for x in (a, b))
    return linked(F.least(n_a - nth_a, n_b - nth_b), n_a, n_b, percent)


def links(rows: DataFrame, percent: int) -> DataFrame:
    """(class, root) of rows (class, n, mass, columns in order), root being the least class of its component."""
    ahead = F.size("columns") - need(F.col("n"), percent) + 1
    first = F.posexplode(F.slice("columns", 1, ahead.cast("int"))).alias("nth", "column")
    alone = F.col("n") - F.size("columns")  # entries in no other class come before all others
    prefixes = rows.select("class", "n", "mass", alone.alias("alone"), first).withColumn("nth", (F.col("nth") + F.col("alone")).cast("int")).drop("alone")
    prefixes = shared.written(prefixes, "prefixes")
    held = prefixes.groupBy("column").agg(F.count("*").alias("k"), F.max_by(F.struct("class", "n", "nth"), F.struct("mass", "class")).alias("star"))
    held = shared.written(held.filter("k > 1").select("column", *[F.col(f"star.{c}").alias(f"{c}_star") for c in ("class", "n", "nth")]), "stars")
    named = prefixes.select("column", *[F.col(c).alias(f"{c}_own") for c in ("class", "n", "nth")])
    met = named.join(held, (named["column"] == held["column"]) & (F.col("class_own") != F.col("class_star")) & may_link("own", "star", percent))
    pairs = met.select(F.least("class_own", "class_star").alias("a"), F.greatest("class_own", "class_star").alias("b")).distinct()
    edges = shared.written(exact_links(pairs, rows, percent), "edges")
    roots = components.roots(edges, rows.select("class"))
    joined = shared.written(prefixes.drop("mass").join(roots, "class"), "rooted")
    by_root = joined.groupBy("column", "root").agg(F.count("*").alias("k"))
    most = by_root.groupBy("column").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("column", "main")
    at = shared.written(joined.join(most, "column"), "apart")
    # a pair of two roots has a class outside the column's main root; pairs of one root are joined by now
    one, two = (at.select("column", "main", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "nth", "root")]) for x in "ab")
    met = one.filter(F.col("root_a") != F.col("main")).drop("main").join(
        two,
        (one["column"] == two["column"]) & (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == two["main"]) | (F.col("class_a") < F.col("class_b"))) & may_link("a", "b", percent),
    )
    low = F.col("class_a") < F.col("class_b")
    sorted_pair = [F.when(low, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for c in ("class", "n", "nth") for x, y in ("ab", "ba")]
    sums = met.select(*sorted_pair).groupBy("class_a", "class_b").agg(F.count("*").alias("overlap"), *[F.max(c).alias(c) for c in ("nth_a", "nth_b", "n_a", "n_b")])
    reach = F.col("overlap") + F.least(F.col("n_a") - 1 - F.col("nth_a"), F.col("n_b") - 1 - F.col("nth_b"))
    pairs = sums.filter(linked(reach, F.col("n_a"), F.col("n_b"), percent)).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    more = shared.written(exact_links(pairs, rows, percent), "edges")
    shared.removed(prefixes, held, joined, at)
    if more.isEmpty():
        return roots
    return components.roots(edges.unionByName(more), rows.select("class"))


def similar_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of each row; component_id is the least id reachable by links, the row's own included.

    A row's set holds its distinct shingles of so many words (A-Z lower-cased); with fewer words, its whole sequence as one. Two
    rows link when 100 * intersection >= percent * union. A row without words or text has an empty set and no links. Repeated
    rows each give a row; null ids are passed over when the least is sought, and a row whose component has no id has null. An
    empty table gives no rows; other columns are left out. N-grams are told apart by 64 bits of hash and sets by 64 bits, so that two
    different sets may be taken for one only from some 10 ** 9 different sets on.
    """
    spark = df.sparkSession
    shared.limit_batches(spark)
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    members = shared.written(memberships(rows, words), "members")
    parts = min(shared.partitions(spark), 1 << 16)
    near = shared.written(likely(shared_entries(blocks(rows, words, parts), parts), parts, percent), "near")
    roots = links(near, percent)
    shared.removed(near)
    classes = members.filter("n_shingles > 0").groupBy("class").agg(F.min("id").alias("least")).join(roots, "class", "left")
    classes = shared.written(classes.withColumn("root", F.coalesce("root", "class")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("class", "component_id")
    full = members.filter("n_shingles > 0").join(named, "class").select("id", "n_shingles", "component_id")
    empty = members.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("id", id_column)
