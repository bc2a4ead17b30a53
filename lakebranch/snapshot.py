"""A schema snapshot as five small DataFrames keyed by stable ids."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakebranch.functions.types import TYPE, type_sql

TABLES = "table_id string, name string"
COLUMNS = f"table_id string, column_id string, name string, position int, type {TYPE}, nullable boolean, default_expr string, identity string"
REF = "struct<table_id:string,column_ids:array<string>,on_delete:string,on_update:string>"
CONSTRAINTS = f"table_id string, constraint_id string, name string, kind string, column_ids array<string>, ref {REF}, expression string"
INDEXES = (
    "table_id string, index_id string, name string, method string, is_unique boolean, "
    "columns array<struct<column_id:string,direction:string,nulls:string>>, predicate string, constraint_backed boolean"
)
UNMANAGED = "kind string, name string, reason string"
COMMITS = (
    "commit_id string, project_id string, branch_id string, parent_id string, second_parent_id string, snapshot_id string, message string, author string, "
    "seq bigint, created_at timestamp"
)
BRANCHES = (
    "branch_id string, project_id string, name string, storage_name string, head_commit_id string, parent_branch_id string, base_commit_id string, "
    "status string, created_by string, created_at timestamp, merged_at timestamp, storage_dropped boolean"
)
_KINDS = {"tables": TABLES, "columns": COLUMNS, "constraints": CONSTRAINTS, "indexes": INDEXES, "unmanaged": UNMANAGED}


def local_frame(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """A small DataFrame of tuples that the optimiser knows as a local relation: no task reads it, and joins broadcast it."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(kind)
    plain = [dict(zip(kinds.names, r if isinstance(r, (tuple, list)) else (r,), strict=True)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(plain, schema=kinds), kind)


def localised(df: DataFrame) -> DataFrame:
    """A few rows of metadata as a local relation, their plan cut off: what follows isn't optimised together with what made them."""
    return local_frame(df.sparkSession, [tuple(r.asDict(recursive=True).values()) for r in df.collect()], df.schema)


@dataclass(frozen=True)
class Snapshot:
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    indexes: DataFrame
    unmanaged: DataFrame

    @staticmethod
    def of(spark: SparkSession, **rows: list) -> Snapshot:
        """From rows of each relation, missing ones empty."""
        return Snapshot(**{name: local_frame(spark, rows.get(name, []), schema) for name, schema in _KINDS.items()})

    def rows(self) -> dict[str, list[dict[str, Any]]]:
        """All rows on the driver: a snapshot is a few KB."""
        return {name: [r.asDict(recursive=True) for r in getattr(self, name).collect()] for name in _KINDS}

    def with_(self, **changes: DataFrame) -> Snapshot:
        """A copy with some relations replaced."""
        return replace(self, **changes)

    def typed_columns(self) -> DataFrame:
        return self.columns.withColumn("type_sql", type_sql(F.col("type")))

    def local(self) -> Snapshot:
        """The same as local relations, its plan cut off."""
        found = self.rows()
        return Snapshot.of(self.tables.sparkSession, **{name: [tuple(r.values()) for r in found[name]] for name in _KINDS})

    def partially_managed(self) -> bool:
        """A12"""
        return not self.unmanaged.isEmpty()

    def object_count(self) -> DataFrame:
        """(object_count) of tables, columns, constraints and indexes."""
        parts = [getattr(self, n).select(F.lit(1).alias("x")) for n in ("tables", "columns", "constraints", "indexes")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.agg(F.count("*").alias("object_count"))

    def table_named(self, name: str) -> DataFrame:
        """A10"""
        return self.tables.filter(F.col("name") == name)

    def view(self) -> DataFrame:
        """A row for each column, by table and position, with its key flag and the names of indexes that hold it."""
        keys = self.constraints.filter("kind = 'PRIMARY_KEY'").select("table_id", F.explode("column_ids").alias("column_id")).distinct().withColumn("is_key", F.lit(True))
        held = self.indexes.select("table_id", F.col("name").alias("index"), F.explode("columns.column_id").alias("column_id"))
        held = held.groupBy("table_id", "column_id").agg(F.array_join(F.array_sort(F.collect_list("index")), ",").alias("indexes"))
        rows = self.typed_columns().join(self.tables.select("table_id", F.col("name").alias("table_name")), "table_id")
        rows = rows.join(keys, ["table_id", "column_id"], "left").join(held, ["table_id", "column_id"], "left")
        return rows.select(
            "table_name", "name", "position", "type_sql", "nullable", F.coalesce("is_key", F.lit(False)).alias("is_key"), F.coalesce("indexes", F.lit("")).alias("indexes")
        ).orderBy("table_name", "position")

    def search(self, text: str) -> DataFrame:
        """K4: all columns of tables whose name holds the text, else columns whose name or type does."""
        q = text.strip().lower()
        rows = self.view()
        inside = lambda c: F.lower(c).contains(q)
        return rows.filter(inside("table_name") | inside("name") | inside("type_sql")) if q else rows
