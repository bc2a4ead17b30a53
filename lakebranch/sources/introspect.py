"""A snapshot of a folder of Parquet tables. Parquet knows columns only; keys, indexes, defaults and the rest are in a sidecar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakebranch.functions.identifiers import stable_id
from lakebranch.functions.types import SPARK_TYPES, TYPE, canonical_default, parse_type
from lakebranch.snapshot import Snapshot, local_frame

# A catalog's codes of foreign key actions and of identity columns.
ACTIONS = {"c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT", "r": "RESTRICT", "a": "NO ACTION"}
IDENTITIES = {"a": "ALWAYS", "d": "BY DEFAULT"}
#: Object kinds that are noted, not managed.
UNMANAGED = {"v": "VIEW", "m": "MATERIALIZED VIEW", "p": "PARTITIONED TABLE", "f": "FOREIGN TABLE", "t": "TRIGGER", "e": "ENUM"}


def scan_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """B1: the tables of a folder, by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in sorted(names)}


def scan_columns(spark: SparkSession, tables: dict[str, DataFrame], sidecar: dict | None = None) -> DataFrame:
    """B2: (table_name, name, position, type, nullable, default_expr, identity); the sidecar has defaults, not-null and identity codes."""
    more = sidecar or {}
    rows = []
    for table, df in tables.items():
        for i, f in enumerate(df.schema.fields, 1):
            own = more.get(f"{table}.{f.name}", {})
            kind = f.dataType.simpleString()
            kind = f"numeric({kind[8:-1]})" if kind.startswith("decimal(") else SPARK_TYPES.get(kind, kind)
            kind = SPARK_TYPES.get(kind[6:-1], kind[6:-1]) + "[]" if kind.startswith("array<") else kind
            rows.append((table, f.name, i, own.get("type", kind), not own.get("not_null", False), own.get("default"), IDENTITIES.get(own.get("identity"))))
    raw = local_frame(spark, rows, "table_name string, name string, position int, raw string, nullable boolean, raw_default string, identity string")
    typed = raw.withColumn("type", parse_type(F.col("raw")).cast(TYPE))
    return typed.withColumn("default_expr", canonical_default(F.col("raw_default"), F.col("type"))).drop("raw", "raw_default")


def carried(new: DataFrame, previous: DataFrame | None, names: list[str], key: str, minted: Column) -> DataFrame:
    """The object's id in the previous snapshot where one has the same names, else a new one."""
    if previous is None:
        return new.withColumn(key, minted)
    old = previous.select(*names, F.col(key).alias("old_id")).dropDuplicates(names)
    return new.withColumn("minted", minted).join(old, names, "left").withColumn(key, F.coalesce("old_id", "minted")).drop("minted", "old_id")


def introspect(spark: SparkSession, tables: dict[str, DataFrame], sidecar: dict | None = None, previous: Snapshot | None = None) -> Snapshot:
    """A snapshot with the previous one's ids where names agree.

    sidecar: columns {table.column: {type, not_null, default, identity}}, constraints [{table, name, kind, columns, ref_table,
    ref_columns, on_delete, on_update, expression}] with columns by position and actions by code, indexes [{table, name, method,
    unique, columns, options, predicate, constraint_backed}] with option bits 1 DESC and 2 NULLS FIRST, objects [{kind, name}].
    Positions that no column has are passed over; an index over expressions (position 0) is left out.
    """
    side = sidecar or {}
    names = local_frame(spark, [(t,) for t in tables], "name string")
    made = carried(names, previous and previous.tables, ["name"], "table_id", stable_id("table", F.col("name")))
    found = made.select("table_id", "name")
    owner = found.select("table_id", F.col("name").alias("table_name"))
    columns = scan_columns(spark, tables, side.get("columns")).join(F.broadcast(owner), "table_name")
    columns = carried(columns, previous and previous.columns, ["table_id", "name"], "column_id", stable_id("column", F.col("table_name"), F.col("name")))
    by_position = columns.groupBy("table_name").agg(F.map_from_entries(F.collect_list(F.struct("position", "column_id"))).alias("ids"))
    ids_of = lambda positions, ids: F.filter(F.transform(positions, lambda p: F.element_at(ids, p)), lambda x: x.isNotNull())

    keys = local_frame(spark, 
        [(k["table"], k["name"], k["kind"], k.get("columns", []), k.get("ref_table"), k.get("ref_columns", []), k.get("on_delete", "a"), k.get("on_update", "a"), k.get("expression")) for k in side.get("constraints", [])],
        "table_name string, name string, kind string, positions array<int>, ref_table string, ref_positions array<int>, d string, u string, expression string",
    )
    action = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in ACTIONS.items() for x in p]), c)
    target = owner.join(by_position, "table_name").select(F.col("table_name").alias("ref_table"), F.col("table_id").alias("ref_id"), F.col("ids").alias("ref_ids"))
    keys = keys.join(owner, "table_name").join(by_position, "table_name").join(target, "ref_table", "left")
    ref = F.struct(F.col("ref_id").alias("table_id"), ids_of(F.col("ref_positions"), F.col("ref_ids")).alias("column_ids"), action(F.col("d")).alias("on_delete"), action(F.col("u")).alias("on_update"))
    keys = keys.withColumns({"column_ids": ids_of(F.col("positions"), F.col("ids")), "ref": F.when(F.col("kind") == "FOREIGN_KEY", ref)})
    keys = carried(keys, previous and previous.constraints, ["table_id", "name"], "constraint_id", stable_id("constraint", F.col("table_name"), F.col("name")))

    indexes = local_frame(spark, 
        [(i["table"], i["name"], i.get("method", "btree"), i.get("unique", False), i["columns"], i.get("options", [0] * len(i["columns"])), i.get("predicate"), i.get("constraint_backed", False)) for i in side.get("indexes", [])],
        "table_name string, name string, method string, is_unique boolean, positions array<int>, options array<int>, predicate string, constraint_backed boolean",
    ).filter(~F.array_contains("positions", 0))
    indexes = indexes.join(owner, "table_name").join(by_position, "table_name")
    part = lambda x: F.struct(
        F.element_at("ids", x["positions"]).alias("column_id"), F.when(x["options"].bitwiseAND(1) != 0, "DESC").otherwise("ASC").alias("direction"),
        F.when(x["options"].bitwiseAND(2) != 0, "FIRST").otherwise("LAST").alias("nulls"),
    )
    indexes = indexes.withColumn("columns", F.filter(F.transform(F.arrays_zip("positions", "options"), part), lambda x: x["column_id"].isNotNull()))
    indexes = carried(indexes, previous and previous.indexes, ["table_id", "name"], "index_id", stable_id("index", F.col("table_name"), F.col("name")))
    other = [(UNMANAGED[o["kind"]], o["name"], f"{UNMANAGED[o['kind']].lower()}s are not managed") for o in side.get("objects", []) if o["kind"] in UNMANAGED and not o["name"].startswith("__sv_")]
    return Snapshot(
        found,
        columns.select("table_id", "column_id", "name", "position", "type", "nullable", "default_expr", "identity"),
        keys.select("table_id", "constraint_id", "name", "kind", "column_ids", "ref", "expression"),
        indexes.select("table_id", "index_id", "name", "method", "is_unique", "columns", "predicate", "constraint_backed"),
        local_frame(spark, sorted(other), "kind string, name string, reason string"),
    )


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows), exact: Parquet footers answer a count without reading a column."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def table_bytes(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table_name, bytes, pretty) of the files, by Hadoop's file system."""
    rows = []
    for n in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet")
        size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        rows.append((n, size))
    size = F.col("bytes")
    pretty = F.when(size < 10 * 1024, F.concat(size.cast("string"), F.lit(" bytes"))).when(size < 10 * 1024**2, F.concat(F.round(size / 1024).cast("long").cast("string"), F.lit(" kB"))).otherwise(F.concat(F.round(size / 1024**2).cast("long").cast("string"), F.lit(" MB")))
    return local_frame(spark, rows, "table_name string, bytes long").withColumn("pretty", pretty)


def schema_exists(spark: SparkSession, name: str) -> bool:
    """B10"""
    return spark.catalog.databaseExists(name)
