"""Fingerprints of constraints and indexes, and the content hash of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakebranch.snapshot import Snapshot


def listed(items: Column) -> Column:
    """Items in brackets, parted by a comma and a space."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def optional(prefix: str, text: Column) -> Column:
    return F.when(text.isNull(), "").otherwise(F.concat(F.lit(prefix), text))


def constraint_fingerprint(row: Column | None = None) -> Column:
    """A4: what a constraint does, apart from its name and id."""
    c = (lambda n: F.col(n)) if row is None else (lambda n: row[n])
    ref = c("ref")
    target = F.concat(ref["table_id"], listed(ref["column_ids"]), F.lit(":"), ref["on_delete"], F.lit(":"), ref["on_update"])
    return F.concat(c("kind"), F.lit("|"), listed(c("column_ids")), optional("|ref=", target), optional("|expr=", c("expression")))


def index_fingerprint(row: Column | None = None) -> Column:
    """A5: what an index does, its columns in order."""
    c = (lambda n: F.col(n)) if row is None else (lambda n: row[n])
    parts = F.transform(c("columns"), lambda x: F.concat_ws(":", x["column_id"], x["direction"], x["nulls"]))
    return F.concat_ws("|", c("method"), c("is_unique").cast("string"), F.array_join(parts, ","), F.coalesce(c("predicate"), F.lit("")))


def hash_lines(s: Snapshot, by_name: bool = True) -> DataFrame:
    """(table_name, rank, name, line): the canonical text of a snapshot, line by line.

    by_name writes foreign keys with the names of what they refer to, so that a hash depends on no id at all (X3); without it they
    are written as ids of the columns alone.
    """
    names = s.columns.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("column_id", "name"))).alias("names"))
    owner = s.tables.select("table_id", F.col("name").alias("table_name")).join(names, "table_id", "left")
    named = lambda ids, names: F.transform(ids, lambda i: F.coalesce(F.element_at(names, i), F.concat(F.lit("?"), i)))
    tables = owner.select("table_name", F.lit(0).alias("rank"), F.lit("").alias("name"), F.concat(F.lit("T:"), "table_name").alias("line"))
    columns = s.typed_columns().join(owner, "table_id")
    fields = ["name", "type_sql", F.when(F.col("nullable"), "NULL").otherwise("NOT NULL"), F.coalesce("default_expr", F.lit("-")), F.coalesce("identity", F.lit("-"))]
    columns = columns.select("table_name", F.lit(1).alias("rank"), "name", F.concat(F.lit("  C:"), F.concat_ws("|", *fields)).alias("line"))
    target = owner.select(F.col("table_id").alias("ref_id"), F.col("table_name").alias("ref_table"), F.col("names").alias("ref_names"))
    keys = s.constraints.join(owner, "table_id").join(target, F.col("ref.table_id") == F.col("ref_id"), "left")
    ends = F.concat(F.lit(":"), F.col("ref.on_delete"), F.lit(":"), F.col("ref.on_update"))
    ref = F.concat(F.coalesce("ref_table", F.lit("?")), listed(named(F.col("ref.column_ids"), F.col("ref_names"))), ends) if by_name else F.concat(listed(F.col("ref.column_ids")), ends)
    key_text = F.concat(F.col("kind"), F.lit("|"), listed(F.array_sort(named(F.col("column_ids"), F.col("names")))), F.when(F.col("ref").isNull(), "").otherwise(F.concat(F.lit("|ref="), ref)), optional("|expr=", F.col("expression")))
    keys = keys.select("table_name", F.lit(2).alias("rank"), "name", F.concat(F.lit("  K:"), "name", F.lit("|"), key_text).alias("line"))
    part = lambda x: F.concat(F.coalesce(F.element_at("names", x["column_id"]), F.concat(F.lit("?"), x["column_id"])), F.lit(":"), x["direction"], F.lit(":"), x["nulls"], F.lit(","))
    index_text = F.concat_ws("|", "name", "method", F.col("is_unique").cast("string"), F.array_join(F.transform("columns", part), ""), F.coalesce("predicate", F.lit("")))
    indexes = s.indexes.join(owner, "table_id").select("table_name", F.lit(3).alias("rank"), "name", F.concat(F.lit("  I:"), index_text).alias("line"))
    other = s.unmanaged.select(F.lit("\U0010ffff").alias("table_name"), F.lit(4).alias("rank"), F.concat_ws("\0", "kind", "name").alias("name"), F.concat_ws(":", F.lit("U"), "kind", "name").alias("line"))
    out = tables
    for more in (columns, keys, indexes, other):
        out = out.unionByName(more)
    return out


def snapshot_hash(s: Snapshot, by_name: bool = True) -> DataFrame:
    """(hash), the SHA-256 of the canonical text. Names are in code point order; a snapshot is a few KB, so one row holds it."""
    lines = F.array_sort(F.collect_list(F.struct("table_name", "rank", "name", "line")))
    text = F.concat(F.lit("v1\n"), F.array_join(F.transform(lines, lambda r: F.concat(r["line"], F.lit("\n"))), ""))
    return hash_lines(s, by_name).agg(F.sha2(text, 256).alias("hash"))
