"""The difference of two snapshots, matched by stable id: one full outer join for each kind of object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakebranch.functions.hashing import constraint_fingerprint, index_fingerprint
from lakebranch.snapshot import Snapshot

DESTRUCTIVE = ("TABLE_DROPPED", "COLUMN_DROPPED", "COLUMN_TYPE_CHANGED")
_CHANGE = "struct<kind:string,from_value:string,to_value:string>"


def change(kind: str, before: Column | None = None, after: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if before is None else before).alias("from_value"), (none if after is None else after).alias("to_value"))


def sided(df: DataFrame, side: str, *keys: str) -> DataFrame:
    """The row as one struct, beside its keys."""
    return df.select(*keys, F.struct("*").alias(side))


def tables(a: Snapshot, b: Snapshot) -> DataFrame:
    """(table_id, before, after): names on either side."""
    return a.tables.select("table_id", F.col("name").alias("before")).join(b.tables.select("table_id", F.col("name").alias("after")), "table_id", "full_outer")


def _found(rows: DataFrame, kinds: list[Column], id_column: str, table_name: Column, name: Column) -> DataFrame:
    """A row for each change that applies; ord keeps their order within an object."""
    listed = F.filter(F.array(*kinds), lambda c: c.isNotNull())
    return rows.select(table_name.alias("table_name"), name.alias("object_name"), F.col(id_column).alias("object_id"), F.posexplode(listed).alias("ord", "c")).select(
        F.col("c.kind").alias("kind"), "table_name", "object_name", "object_id", "c.from_value", "c.to_value", "ord"
    )


def diff_tables(a: Snapshot, b: Snapshot) -> DataFrame:
    before, after = F.col("before"), F.col("after")
    kinds = [
        F.when(before.isNull(), change("TABLE_ADDED")),
        F.when(after.isNull(), change("TABLE_DROPPED")),
        F.when(before != after, change("TABLE_RENAMED", before, after)),
    ]
    name = F.coalesce(after, before)
    return _found(tables(a, b), kinds, "table_id", name, name)


def _kept(a: Snapshot, b: Snapshot) -> DataFrame:
    """(table_id, table_name) of tables on both sides, by their new name."""
    return tables(a, b).filter("before IS NOT NULL AND after IS NOT NULL").select("table_id", F.col("after").alias("table_name"))


def diff_columns(a: Snapshot, b: Snapshot) -> DataFrame:
    rows = sided(a.typed_columns(), "o", "table_id", "column_id").join(sided(b.typed_columns(), "n", "table_id", "column_id"), ["table_id", "column_id"], "full_outer")
    rows = rows.join(F.broadcast(_kept(a, b)), "table_id")
    o, n = F.col("o"), F.col("n")
    both = o.isNotNull() & n.isNotNull()
    shown = lambda c: F.when(c["nullable"], "nullable").otherwise("NOT NULL")
    kinds = [
        F.when(o.isNull(), change("COLUMN_ADDED", None, n["type_sql"])),
        F.when(n.isNull(), change("COLUMN_DROPPED", o["type_sql"])),
        F.when(both & (o["name"] != n["name"]), change("COLUMN_RENAMED", o["name"], n["name"])),
        F.when(both & (o["type_sql"] != n["type_sql"]), change("COLUMN_TYPE_CHANGED", o["type_sql"], n["type_sql"])),
        F.when(both & (o["nullable"] != n["nullable"]), change("COLUMN_NULLABILITY_CHANGED", shown(o), shown(n))),
        F.when(both & ~o["default_expr"].eqNullSafe(n["default_expr"]), change("COLUMN_DEFAULT_CHANGED", o["default_expr"], n["default_expr"])),
    ]
    return _found(rows, kinds, "column_id", F.col("table_name"), F.coalesce(n["name"], o["name"]))


def _fingerprinted(a: Snapshot, b: Snapshot, kind: str) -> DataFrame:
    relation, key, print_ = ("indexes", "index_id", index_fingerprint) if kind == "INDEX" else ("constraints", "constraint_id", constraint_fingerprint)
    one, two = (getattr(s, relation).withColumn("print", print_()) for s in (a, b))
    rows = sided(one, "o", "table_id", key).join(sided(two, "n", "table_id", key), ["table_id", key], "full_outer")
    o, n = F.col("o"), F.col("n")
    if kind == "INDEX":
        rows = rows.filter(~F.coalesce(o["constraint_backed"], F.lit(False)) & ~F.coalesce(n["constraint_backed"], F.lit(False)))
    both = o.isNotNull() & n.isNotNull()
    kinds = [
        F.when(o.isNull(), change(f"{kind}_ADDED")),
        F.when(n.isNull(), change(f"{kind}_DROPPED")),
        F.when(both & ((o["print"] != n["print"]) | (o["name"] != n["name"])), change(f"{kind}_CHANGED", o["name"], n["name"])),
    ]
    out = _found(rows.join(F.broadcast(_kept(a, b)), "table_id"), kinds, key, F.col("table_name"), F.coalesce(n["name"], o["name"]))
    if kind == "INDEX":  # of a new table indexes are told, columns and constraints are not
        new = tables(a, b).filter("before IS NULL").select("table_id", F.col("after").alias("table_name"))
        fresh = b.indexes.filter("NOT constraint_backed").join(new, "table_id").withColumnRenamed("name", "index_name")
        out = out.unionByName(_found(fresh, [change("INDEX_ADDED")], "index_id", F.col("table_name"), F.col("index_name")))
    return out


def diff_indexes(a: Snapshot, b: Snapshot) -> DataFrame:
    return _fingerprinted(a, b, "INDEX")


def diff_constraints(a: Snapshot, b: Snapshot) -> DataFrame:
    return _fingerprinted(a, b, "CONSTRAINT")


def describe() -> Column:
    """A sentence for each kind of change."""
    kind, name, before, after = (F.col(c) for c in ("kind", "object_name", "from_value", "to_value"))
    noun, verb = F.lower(F.element_at(F.split(kind, "_"), 1)), F.initcap(F.element_at(F.split(kind, "_"), 2))
    return (
        F.when(kind == "TABLE_RENAMED", F.concat_ws(" ", F.lit("Renamed table"), before, F.lit("to"), after))
        .when(kind == "COLUMN_RENAMED", F.concat_ws(" ", F.lit("Renamed"), before, F.lit("to"), after))
        .when(kind == "COLUMN_TYPE_CHANGED", F.concat_ws(" ", F.lit("Changed"), name, F.lit("from"), before, F.lit("to"), after))
        .when(kind == "COLUMN_NULLABILITY_CHANGED", F.concat_ws(" ", name, F.lit("is now"), after))
        .when(kind == "COLUMN_DEFAULT_CHANGED", F.concat_ws(" ", F.lit("Default for"), name, F.lit("is now"), F.coalesce(after, F.lit("none"))))
        .otherwise(F.concat_ws(" ", verb, noun, name))
    )


def diff(a: Snapshot, b: Snapshot) -> DataFrame:
    """All changes from a to b, with destructive (D12) and description (D13, D16); section and ord order them within a table."""
    out = None
    for section, rows in enumerate((diff_tables(a, b), diff_columns(a, b), diff_indexes(a, b), diff_constraints(a, b))):
        rows = rows.withColumn("section", F.lit(section))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns({"destructive": F.col("kind").isin(*DESTRUCTIVE), "description": describe()})


def is_empty(a: Snapshot, b: Snapshot) -> bool:
    """D14"""
    return diff(a, b).isEmpty()
