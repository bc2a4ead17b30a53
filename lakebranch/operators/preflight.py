"""A plan held against the real rows, in one pass over each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakebranch.snapshot import Snapshot, local_frame

# Text that a boolean is read from.
TRUE = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
FALSE = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")
#: Digits before the point that a number without a precision may have; and what a number looks like.
_WHOLE = 131_072
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,9})?\s*$"
_SPARK = {"real": "float", "double precision": "double", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp"}
_BOUNDS = {"smallint": 15, "integer": 31, "bigint": 63}
_UUID = r"^\{?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\}?$"


def castable(value: Column, type_sql: str, via_text: bool = True, check_length: bool = False) -> Column:
    """Whether a value that isn't null becomes the type. via_text: by way of its text, so that 1.5 is no integer; else directly, so that
    numbers round. A longer text fits varchar(n), which cuts it, unless check_length. Unknown types take any text."""
    base, _, rest = type_sql.partition("(")
    args = [int(x) for x in rest.rstrip(")").split(",")] if rest else []
    text = value.cast("string")
    if base in _BOUNDS:
        top = 1 << _BOUNDS[base]
        number = text.try_cast("decimal(38,0)") if via_text else F.round(text.try_cast("decimal(38,10)"), 0)
        shaped = text.rlike(r"^\s*[+-]?[0-9]+\s*$") if via_text else F.lit(True)
        return F.coalesce(shaped & number.between(-top, top - 1), F.lit(False))
    if base == "numeric":
        nan = F.lower(F.trim(text)) == "nan"
        if args and args[0] <= 38:
            return text.try_cast(f"decimal({args[0]},{args[1] if len(args) > 1 else 0})").isNotNull() | nan
        # wider than a decimal can be: by the places of its digits
        whole = F.length(F.ltrim(F.regexp_extract(F.trim(text), r"^[+-]?([0-9]*)", 1), F.lit("0")))
        power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)\s*$", 1).try_cast("int"), F.lit(0))
        most = args[0] - (args[1] if len(args) > 1 else 0) if args else _WHOLE
        return (text.rlike(_NUMBER) & (whole + power <= most)) | nan | (F.lit(not args) & F.lower(F.trim(text)).isin("infinity", "-infinity", "inf", "-inf"))
    if base == "boolean":
        return F.lower(F.trim(text)).isin(*TRUE, *FALSE)
    if base in _SPARK:
        return text.try_cast(_SPARK[base]).isNotNull()
    if base == "uuid":
        return text.rlike(_UUID)
    if base in ("json", "jsonb"):
        return F.try_parse_json(text).isNotNull()
    if base in ("varchar", "char") and args and check_length:
        return F.length(text) <= args[0]
    return F.lit(True)


def candidates(target: Snapshot, merged: Snapshot, row_counts: DataFrame) -> DataFrame:
    """(table_name, column_name, check, to_type, has_default) of tables with rows in both snapshots: types that change, and columns
    that must no longer be NULL."""
    old = target.typed_columns().select("table_id", "column_id", F.struct("*").alias("o")).join(target.tables.select("table_id", F.col("name").alias("table_name")), "table_id")
    rows = old.join(merged.typed_columns().select("table_id", "column_id", F.struct("*").alias("n")), ["table_id", "column_id"]).join(row_counts, "table_name").filter("rows > 0")
    checks = F.array(F.when(F.col("o.type_sql") != F.col("n.type_sql"), "CAST"), F.when(F.col("o.nullable") & ~F.col("n.nullable"), "NOT_NULL"))
    rows = rows.select("table_name", F.col("o.name").alias("column_name"), F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("check"), F.col("n.type_sql").alias("to_type"), F.col("n.default_expr").isNotNull().alias("has_default"))
    return rows


def failing(df: DataFrame, checks: list[tuple[str, str, str]], via_text: bool = True) -> DataFrame:
    """(column_name, check, failing) for checks (column, CAST or NOT_NULL, type) of one table, in one pass over its columns."""
    counts = []
    for i, (column, check, to_type) in enumerate(checks):
        c = df[f"`{column}`"]
        bad = c.isNull() if check == "NOT_NULL" else c.isNotNull() & ~castable(c, to_type, via_text)
        counts.append(F.count_if(bad).alias(f"n{i}"))
    one = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check"), F.lit(t).alias("to_type"), F.col(f"n{i}").alias("failing")) for i, (c, k, t) in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def preflight(tables: dict[str, DataFrame], target: Snapshot, merged: Snapshot, row_counts: DataFrame, via_text: bool = True) -> DataFrame:
    """G1-G3 over all tables: (table_name, column_name, check, to_type, failing, has_default)."""
    wanted = candidates(target, merged, row_counts).orderBy("table_name", "column_name", "check").collect()
    out = None
    for table in sorted({r.table_name for r in wanted}):
        mine = [r for r in wanted if r.table_name == table]
        found = failing(tables[table], [(r.column_name, r.check, r.to_type) for r in mine], via_text)
        has = F.create_map(*[F.lit(x) for pair in {r.column_name: r.has_default for r in mine}.items() for x in pair])
        found = found.select(F.lit(table).alias("table_name"), "column_name", "check", "to_type", "failing", F.element_at(has, F.col("column_name")).alias("has_default"))
        out = found if out is None else out.unionByName(found)
    schema = "table_name string, column_name string, check string, to_type string, failing long, has_default boolean"
    return out if out is not None else local_frame(row_counts.sparkSession, [], schema)


def blockers(found: DataFrame) -> DataFrame:
    """(message) of what would stop the migration."""
    n = F.format_number("failing", 0)
    s = F.when(F.col("failing") == 1, "").otherwise("s")
    where = F.concat_ws(".", "table_name", "column_name")
    cast = F.concat(n, F.lit(" row"), s, F.lit(" of "), where, F.lit(" can't be read as "), F.col("to_type"), F.lit("."))
    null = F.concat(n, F.lit(" row"), s, F.lit(" of "), where, F.lit(" hold NULL, and the column has no default to fill them by."))
    text = F.when(F.col("check") == "CAST", cast).when(~F.col("has_default"), null)
    return found.filter("failing > 0").select(text.alias("message")).filter("message IS NOT NULL")


def orphans(child: DataFrame, parent: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(orphans): rows of child whose key isn't NULL and that no row of parent has. The parent side is its distinct keys."""
    left = child.select(*[F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(keys)]).dropna()
    right = parent.select(*[F.col(p).alias(f"k{i}") for i, (_, p) in enumerate(keys)])
    return left.join(right, [f"k{i}" for i in range(len(keys))], "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
