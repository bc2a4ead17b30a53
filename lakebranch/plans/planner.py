"""A migration plan as a DataFrame of steps.

A plan is a function of two snapshots and row counts. What a change comes to is a small table of rules, by kind of change and by the
way that the table's size and keys leave open: changes joined to rules are the steps, whose texts are the rules' with the change's
names put in. Phases are numbered, and seq counts through them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakebranch.functions.identifiers import machinery, quote
from lakebranch.functions.types import parse_type
from lakebranch.operators.diff import diff
from lakebranch.plans import classify, render
from lakebranch.plans.render import joined
from lakebranch.snapshot import Snapshot, local_frame, localised

#: Tables of at least so many rows are migrated online.
THRESHOLD = 100_000


@dataclass(frozen=True)
class Plan:
    steps: DataFrame
    warnings: DataFrame

    def mode(self) -> DataFrame:
        """(mode); ONLINE if a step fills, validates, or can't run in a transaction."""
        online = F.coalesce(F.bool_or(F.col("kind").isin("BACKFILL", "INDEX_CONCURRENT", "VALIDATE") | ~F.col("transactional")), F.lit(False))
        return self.steps.agg(F.when(online, "ONLINE").otherwise("ATOMIC").alias("mode"))

    def points_of_no_return(self) -> DataFrame:
        """F22"""
        return self.steps.filter("point_of_no_return")

    def expensive(self) -> DataFrame:
        return self.steps.filter("verdict <> 'INSTANT'")

    def is_empty(self) -> bool:
        return self.steps.isEmpty()


def rows_text(n: Column) -> Column:
    """999, 1,000, 1.0M."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1_000, F.format_number(n, 0)).otherwise(n.cast("string"))


def key_columns(s: Snapshot) -> DataFrame:
    """(table_id, key): the name of a table's single-column primary key."""
    keys = s.constraints.filter("kind = 'PRIMARY_KEY' AND size(column_ids) = 1").select("table_id", F.element_at("column_ids", 1).alias("column_id"))
    return keys.join(s.columns, ["table_id", "column_id"]).groupBy("table_id").agg(F.min("name").alias("key"))


#: Verdict, lock, and what the lock blocks, by the name that rules use; "added" and "typed" are the change's own class.
_CLASSES = {
    "instant": ("INSTANT", "ACCESS_EXCLUSIVE", "READS_AND_WRITES"),
    "scan": ("SCAN", "SHARE_UPDATE_EXCLUSIVE", "NOTHING"),
    "check": ("SCAN", "ACCESS_EXCLUSIVE", "READS_AND_WRITES"),
    "build": ("SCAN", "SHARE", "WRITES"),
    "function": ("INSTANT", "NONE", "NOTHING"),
    "trigger": ("INSTANT", "SHARE_ROW_EXCLUSIVE", "WRITES"),
}
_RULE = "phase int, of_kind string, of_way string, needs string, ord int, step string, class string, final boolean, op_group string, text array<string>, sql array<string>, fill array<string>"


def _proven(kind: str, target: str, quoted: str, check: str, ord_: int, needs: str = "strict") -> list[tuple]:
    """rules that make a column NOT NULL by way of a check that is validated without a lock."""
    return [
        (7, kind, "online", needs, ord_, "DDL", "instant", False, "dotted", f"Add an unvalidated check that {{{target}}} is not NULL", f"{{alter}} ADD CONSTRAINT {{{check}}} CHECK ({{{quoted}}} IS NOT NULL) NOT VALID", None),
        (7, kind, "online", needs, ord_ + 1, "VALIDATE", "scan", False, "dotted", "Validate the check, blocking nothing", f"{{alter}} VALIDATE CONSTRAINT {{{check}}}", None),
        (7, kind, "online", needs, ord_ + 2, "DDL", "instant", False, "dotted", f"Mark {{{target}}} NOT NULL, proven by the check", f"{{alter}} ALTER COLUMN {{{quoted}}} SET NOT NULL;\n{{alter}} DROP CONSTRAINT {{{check}}}", None),
    ]


def _in_phase(phase: int, rules: list[tuple]) -> list[tuple]:
    return [(phase, *r[1:]) for r in rules]


_FILL_NULLS = ("BACKFILL", "scan", False, "dotted", "Fill NULLs of {name} in batches", None, ("name", "default"))
_DROP_INDEX = ("drop", "", 0, "DDL", "instant", False, "old_object", "Drop index {old_object}", "DROP INDEX {old_index}", None)
#: Phase, kind of change and way to go; what the change needs for the step ("": nothing; strict: a column that isn't nullable; filled: that, with a
#: default and a key to fill by); place; the step, its class, whether there is no way back, what groups it; description, statement and fill.
#: Words in braces are variables of the change. The statements.
RULES = [
    (0, "INDEX_DROPPED", *_DROP_INDEX),
    (1, "COLUMN_DROPPED", "drop", "", 0, "DDL", "instant", True, "table", "Drop column {dotted}", "ALTER TABLE {gone} DROP COLUMN {column}", None),
    (2, "TABLE_DROPPED", "drop", "", 0, "DDL", "instant", True, "table", "Drop table {name}", "DROP TABLE {named}", None),
    (3, "TABLE_ADDED", "add", "", 0, "DDL", "instant", False, "table", "Create table {name}", "{create}", None),
    (4, "TABLE_RENAMED", "rename", "", 0, "DDL", "instant", False, "table", "Rename table {before} to {after}", "ALTER TABLE {old_here} RENAME TO {after_quoted}", None),
    (5, "COLUMN_RENAMED", "rename", "", 0, "DDL", "instant", False, "table", "Rename {table}.{before} to {after}", "{alter} RENAME COLUMN {before_quoted} TO {after_quoted}", None),
    (6, "COLUMN_ADDED", "direct", "", 0, "DDL", "added", False, "table", "Add column {dotted} {type}", "{alter} ADD COLUMN {clause}", None),
    (6, "COLUMN_ADDED", "keyless", "", 0, "DDL", "added", False, "dotted", "Add column {dotted}, rewriting the table", "{alter} ADD COLUMN {clause}", None),
    (6, "COLUMN_ADDED", "online", "", 0, "DDL", "instant", False, "dotted", "Add {dotted}, nullable", "{alter} ADD COLUMN {column} {type}", None),
    (6, "COLUMN_ADDED", "online", "", 1, "DDL", "instant", False, "dotted", "Set the default of future rows", "{alter} ALTER COLUMN {column} SET DEFAULT {default}", None),
    (6, "COLUMN_ADDED", "online", "", 2, "BACKFILL", "scan", False, "dotted", "Fill {name} of {n} rows in batches", None, ("name", "default")),
    (6, "COLUMN_ADDED", "online", "filled", 3, *_FILL_NULLS),
    *_in_phase(6, _proven("COLUMN_ADDED", "name", "column", "check", 4)),
    (7, "COLUMN_TYPE_CHANGED", "direct", "", 0, "DDL", "typed", None, "table", "Change {dotted} from {before} to {after}", "{alter} ALTER COLUMN {column} TYPE {after} USING {cast}", None),
    (7, "COLUMN_TYPE_CHANGED", "keyless", "", 0, "DDL", "typed", True, "dotted", "Change {dotted} to {after}, rewriting the table", "{alter} ALTER COLUMN {column} TYPE {after}", None),
    (7, "COLUMN_TYPE_CHANGED", "online", "", 0, "DDL", "instant", False, "dotted", "Add a shadow column of type {after}", "{alter} ADD COLUMN {shadow_quoted} {after}", None),
    (7, "COLUMN_TYPE_CHANGED", "online", "", 1, "DDL", "function", False, "dotted", "Create the sync function", "CREATE OR REPLACE FUNCTION {function}() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN NEW.{shadow_quoted} := NEW.{cast}; RETURN NEW; END $$", None),
    (7, "COLUMN_TYPE_CHANGED", "online", "", 2, "DDL", "trigger", False, "dotted", "Attach the sync trigger", "CREATE TRIGGER {trigger} BEFORE INSERT OR UPDATE OF {column} ON {here} FOR EACH ROW EXECUTE FUNCTION {function}()", None),
    (7, "COLUMN_TYPE_CHANGED", "online", "", 3, "BACKFILL", "scan", False, "dotted", "Convert {n} rows in batches", None, ("shadow", "cast")),
    *_proven("COLUMN_TYPE_CHANGED", "shadow", "shadow_quoted", "shadow_check", 4),
    (7, "COLUMN_TYPE_CHANGED", "online", "", 7, "DDL", "instant", True, "dotted", "Swap the shadow column in; there is no way back", "DROP TRIGGER {trigger} ON {here};\n{alter} DROP COLUMN {column};\n{alter} RENAME COLUMN {shadow_quoted} TO {column};\nDROP FUNCTION IF EXISTS {function}()", None),
    (7, "COLUMN_TYPE_CHANGED", "online", "", 8, "ANALYZE", "scan", False, "dotted", "Refresh statistics of {table}", "ANALYZE {here}", None),
    (7, "COLUMN_NULLABILITY_CHANGED", "drop", "", 0, "DDL", "instant", False, "table", "Allow NULL in {dotted}", "{alter} ALTER COLUMN {column} DROP NOT NULL", None),
    (7, "COLUMN_NULLABILITY_CHANGED", "direct", "", 0, "DDL", "check", False, "table", "Require {dotted} not to be NULL", "{alter} ALTER COLUMN {column} SET NOT NULL", None),
    (7, "COLUMN_NULLABILITY_CHANGED", "online", "filled", 0, *_FILL_NULLS),
    *_proven("COLUMN_NULLABILITY_CHANGED", "name", "column", "check", 1),
    (7, "COLUMN_DEFAULT_CHANGED", "drop", "", 0, "DDL", "instant", False, "table", "Remove the default of {dotted}", "{alter} ALTER COLUMN {column} DROP DEFAULT", None),
    (7, "COLUMN_DEFAULT_CHANGED", "direct", "", 0, "DDL", "instant", False, "table", "Set the default of {dotted} to {after} for future rows", "{alter} ALTER COLUMN {column} SET DEFAULT {after}", None),
    (8, "INDEX_ADDED", "direct", "", 0, "DDL", "build", False, "table", "Create index {name}", "{index}", None),
    (8, "INDEX_ADDED", "online", "", 0, "INDEX_CONCURRENT", "scan", False, "table", "Build index {name} over {n} rows without blocking writes", "{index_online}", None),
]
#: Left out where plan() is strict.
LOOSE_RULES = [
    (0, "INDEX_CHANGED", *_DROP_INDEX),
    *[(0, f"CONSTRAINT_{x}", "drop", "", 0, "DDL", "instant", False, "table", "Drop constraint {old_object}", "ALTER TABLE {gone} DROP CONSTRAINT {old_object_quoted}", None) for x in ("DROPPED", "CHANGED")],
    (8, "INDEX_CHANGED", "direct", "", 0, "DDL", "build", False, "table", "Create index {name}", "{index}", None),
    (8, "INDEX_CHANGED", "online", "", 0, "INDEX_CONCURRENT", "scan", False, "table", "Build index {name} over {n} rows without blocking writes", "{index_online}", None),
    *[(9, f"CONSTRAINT_{x}", "key", "", 0, "DDL", "check", False, "table", "Add constraint {name}", "{alter} ADD CONSTRAINT {column} {body}", None) for x in ("ADDED", "CHANGED")],
    *[(10, f"CONSTRAINT_{x}", "reference", "", 0, "DDL", "instant", False, "table", "Add foreign key {reference_name}", "{reference}", None) for x in ("ADDED", "CHANGED")],
    (10, "TABLE_ADDED", "reference", "", 0, "DDL", "instant", False, "table", "Add foreign key {reference_name}", "{reference}", None),
]


def parts(template: str | None) -> list[str] | None:
    """Text and variables by turns."""
    return None if template is None else re.split(r"\{(\w+)\}", template)


def filled_in(template: Column, values: Column) -> Column:
    """A template's text with the variables' values; null where one of them is null."""
    shown = F.transform(template, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.element_at(values, x)))
    return F.when(~F.exists(shown, lambda x: x.isNull()), F.array_join(shown, ""))


def plan(target: Snapshot, merged: Snapshot, row_counts: DataFrame, schema: str = "main", threshold: int = THRESHOLD, strict: bool = False) -> Plan:
    """F8: steps from target to merged; row_counts: (table_name, rows) of the target, by its own table names.

    Unless strict, constraints are dropped, added and changed too, foreign keys of new tables are made, changed indexes are made anew,
    and counts and drops are looked up under the target's table names.
    """
    old = target.tables.select("table_id", F.col("name").alias("old_table"))
    counts = old.join(row_counts.select(F.col("table_name").alias("old_table"), F.col("rows").cast("long").alias("rows")), "old_table", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    ids = target.tables.unionByName(merged.tables).select("table_id").distinct()
    of_column = target.columns.select("column_id", "table_id").unionByName(merged.columns.select("column_id", "table_id")).distinct()
    changes = diff(target, merged).drop("destructive", "description", "ord", "section")
    col = merged.typed_columns().select("column_id", F.struct("*").alias("col"))
    alias = of_column.withColumnRenamed("column_id", "object_id").unionByName(ids.withColumn("object_id", F.col("table_id")))
    for s in (target, merged):
        alias = alias.unionByName(s.indexes.select(F.col("index_id").alias("object_id"), "table_id")).unionByName(s.constraints.select(F.col("constraint_id").alias("object_id"), "table_id"))
    rows = changes.join(alias.distinct(), "object_id", "left").join(counts, "table_id", "left").join(key_columns(merged), "table_id", "left").join(col, F.col("object_id") == F.col("column_id"), "left")
    rows = rows.withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("old_table", F.coalesce("old_table", "table_name"))
    added, typed = classify.add_column(F.col("col.default_expr"), strict), classify.change_type(parse_type(F.col("from_value")), parse_type(F.col("to_value")))
    big = F.col("rows") >= threshold
    kind, table, name, before, after, key, c = (F.col(x) for x in ("kind", "table_name", "object_name", "from_value", "to_value", "key", "col"))
    loose = F.lit(not strict)
    for made, column in ((render.create_tables(merged, schema).select(F.col("table_id").alias("made_for"), F.col("sql").alias("create")), "create"), *[(render.create_indexes(merged, schema, F.lit(x)).select(F.col("index_id").alias("made_for"), F.col("sql").alias(n)), n) for x, n in ((False, "index"), (True, "index_online"))]):
        rows = rows.join(made, F.col("object_id") == F.col("made_for"), "left").drop("made_for")
    foreign = render.foreign_keys(merged, schema).select(F.col("name").alias("reference_name"), F.col("sql").alias("reference"), "constraint_id", F.col("table_id").alias("of_table"))
    rows = rows.join(foreign, (F.col("object_id") == F.col("constraint_id")) | ((kind == "TABLE_ADDED") & (F.col("object_id") == F.col("of_table"))), "left").drop("constraint_id", "of_table")
    others = merged.constraints.filter("kind <> 'FOREIGN_KEY'").join(render.names_by_table(merged).select("table_id", "names"), "table_id")
    body = F.when(F.col("kind") == "CHECK", joined("CHECK (", render.bare(F.col("expression")), ")")).otherwise(joined(F.replace("kind", F.lit("_"), F.lit(" ")), " (", render.column_list(F.col("column_ids"), F.col("names")), ")"))
    rows = rows.join(others.select(F.col("constraint_id").alias("key_id"), body.alias("body"), F.lit(True).alias("is_key")), F.col("object_id") == F.col("key_id"), "left")
    # from here on expressions on local relations, which the optimiser works out without a job
    rows = localised(localised(rows).withColumns({"was": F.when(kind == "COLUMN_TYPE_CHANGED", parse_type(before)), "becomes": F.when(kind == "COLUMN_TYPE_CHANGED", parse_type(after))}))
    added, typed = classify.add_column(c["default_expr"], strict), classify.change_type(F.col("was"), F.col("becomes"))
    rows = rows.withColumn("own", F.when(kind == "COLUMN_ADDED", added).when(kind == "COLUMN_TYPE_CHANGED", typed))
    rewritten = F.col("own")["verdict"] == "REWRITE"
    here, named = render.qualify(schema, table), render.qualify(schema, name)
    old_object, column = F.coalesce(before, name), quote(name)
    m = machinery(name, table)
    cast = joined(column, "::", after)
    values = {
        "table": table, "name": name, "dotted": F.concat_ws(".", table, name), "here": here, "alter": joined("ALTER TABLE ", here), "named": named,
        "gone": here if strict else render.qualify(schema, F.col("old_table")), "column": column, "before": before, "after": after, "before_quoted": quote(before), "after_quoted": quote(after),
        "old_here": render.qualify(schema, before), "old_object": old_object, "old_object_quoted": quote(old_object), "old_index": render.qualify(schema, old_object), "n": rows_text(F.col("rows")),
        "type": c["type_sql"], "default": c["default_expr"], "clause": F.when(c.isNotNull(), render.column_clause(lambda x: c[x])), "shadow": m["shadow"], "shadow_quoted": quote(m["shadow"]), "trigger": quote(m["trigger"]),
        "function": render.qualify(schema, m["function"]), "check": quote(m["not_null"]), "shadow_check": quote(machinery(m["shadow"])["not_null"]), "cast": cast, "key": key,
        **{x: F.col(x) for x in ("create", "index", "index_online", "reference", "reference_name", "body")},
    }
    way = (
        F.when(kind.isin("COLUMN_ADDED", "COLUMN_TYPE_CHANGED"), F.when(rewritten & big, F.when(key.isNull(), "keyless").otherwise("online")).otherwise("direct"))
        .when(kind == "COLUMN_NULLABILITY_CHANGED", F.when(after == "nullable", "drop").when(big, "online").otherwise("direct"))
        .when(kind == "COLUMN_DEFAULT_CHANGED", F.when(after.isNull(), "drop").otherwise("direct"))
        .when(kind.endswith("RENAMED"), "rename")
    )
    ways = F.array_compact(F.array(
        way, F.when(kind.endswith("DROPPED") | kind.isin("INDEX_CHANGED", "CONSTRAINT_CHANGED"), "drop"), F.when(kind == "TABLE_ADDED", "add"), F.when(F.col("index").isNotNull(), F.when(big, "online").otherwise("direct")),
        F.when(F.col("is_key"), "key"), F.when(F.col("reference_name").isNotNull() & loose, "reference"),
    ))
    rows = localised(rows.select(
        "kind", table, "object_id", F.coalesce(c["position"], F.lit(0)).alias("position"), "rows", "own", "reference_name", ways.alias("ways"), (~F.coalesce(c["nullable"], F.lit(True))).alias("required"),
        (c["default_expr"].isNotNull() & key.isNotNull()).alias("fillable"), F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]).alias("values"), (rewritten & big & key.isNull()).alias("keyless"), (rewritten & big).alias("long"),
    ))
    chosen = RULES if strict else RULES + LOOSE_RULES
    rules = local_frame(target.tables.sparkSession, [(*r[:9], parts(r[9]), parts(r[10]), list(r[11]) if r[11] else None) for r in chosen], _RULE)
    met = rows.join(F.broadcast(rules), (F.col("of_kind") == F.col("kind")) & F.array_contains("ways", F.col("of_way")))
    met = met.filter((F.col("needs") == "") | (F.col("required") & ((F.col("needs") == "strict") | F.col("fillable"))))
    classes = F.create_map(*[x for n, v in _CLASSES.items() for x in (F.lit(n), F.struct(*[F.lit(y).alias(f) for f, y in zip(("verdict", "lock", "blocks"), v, strict=True)]))])
    cls = F.coalesce(F.element_at(classes, F.col("class")), F.struct(*[F.col(f"own.{f}") for f in ("verdict", "lock", "blocks")]))
    get = lambda x: F.element_at("values", x)
    fill = F.when(F.col("fill").isNotNull(), F.struct(table.alias("table_name"), get(F.lit("key")).alias("key"), get(F.element_at("fill", 1)).alias("target"), get(F.element_at("fill", 2)).alias("source")))
    place = F.struct("phase", "table_name", "position", "object_id", F.when(F.col("of_way") == "reference", F.concat(F.lit("FK "), F.coalesce("reference_name", F.lit("")))).otherwise(kind), "ord")
    seq = F.row_number().over(W.orderBy(place)) - 1  # a plan has tens of steps
    steps = met.select(
        seq.alias("seq"), get(F.col("op_group")).alias("op_group"), F.col("step").alias("kind"), filled_in(F.col("text"), F.col("values")).alias("description"), filled_in(F.col("sql"), F.col("values")).alias("sql"),
        cls["verdict"].alias("verdict"), cls["lock"].alias("lock"), cls["blocks"].alias("blocks"), (F.col("step") != "INDEX_CONCURRENT").alias("transactional"), F.coalesce("final", cls["verdict"] == "REWRITE").alias("point_of_no_return"), fill.alias("backfill"),
    ).orderBy("seq")
    n, dotted = get(F.lit("n")), get(F.lit("dotted"))
    text = (
        F.when((F.col("rows") > 0) & (kind == "COLUMN_DROPPED"), joined("The values of ", dotted, " in ", n, " rows are lost for good."))
        .when((F.col("rows") > 0) & (kind == "TABLE_DROPPED"), joined("Table ", get(F.lit("name")), " goes, and its ", n, " rows with it."))
        .when(F.col("keyless"), joined("Table ", table, " has no single-column primary key: ", get(F.lit("name")), " can't be changed in batches, and the table is rewritten."))
        .when((kind == "COLUMN_TYPE_CHANGED") & F.col("long"), joined("Retyping ", dotted, " rewrites ", n, " rows and needs disk for the new column."))
    )
    return Plan(steps, rows.select(text.alias("warning")).filter("warning IS NOT NULL"))
