"""Statements that make tables, foreign keys and indexes; all as Column expressions over snapshot relations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from lakebranch.functions.identifiers import quote
from lakebranch.functions.types import type_sql
from lakebranch.snapshot import Snapshot, local_frame


def qualify(schema: str, name: Column) -> Column:
    return F.concat(quote(F.lit(schema)), F.lit("."), quote(name))


def joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def column_clause(c=F.col) -> Column:
    """A column in CREATE TABLE or ADD COLUMN."""
    made = F.when(c("identity").isNotNull(), joined(" GENERATED ", c("identity"), " AS IDENTITY")).when(c("default_expr").isNotNull(), joined(" DEFAULT ", c("default_expr"))).otherwise("")
    return F.concat(quote(c("name")), F.lit(" "), type_sql(c("type")), made, F.when(c("nullable"), "").otherwise(" NOT NULL"))


def names_by_table(s: Snapshot) -> DataFrame:
    """(table_id, table_name, names): each table's map of column ids to names."""
    names = s.columns.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("column_id", "name"))).alias("names"))
    return s.tables.select("table_id", F.col("name").alias("table_name")).join(names, "table_id", "left")


def column_list(ids: Column, names: Column) -> Column:
    """Quoted names, null where an id is unknown."""
    return F.when(F.forall(ids, lambda i: F.element_at(names, i).isNotNull()), F.array_join(F.transform(ids, lambda i: quote(F.element_at(names, i))), ", "))


def create_tables(s: Snapshot, schema: str) -> DataFrame:
    """(table_id, table_name, sql); columns by position, then keys and checks by name; foreign keys come later."""
    owner = names_by_table(s)
    columns = s.columns.select("table_id", F.struct(F.lit(0).alias("k"), F.format_string("%010d", "position").alias("o"), column_clause().alias("sql")).alias("x"))
    keys = s.constraints.join(owner, "table_id").filter("kind <> 'FOREIGN_KEY' AND (kind <> 'CHECK' OR expression IS NOT NULL)")
    expression = F.trim("expression")
    body = (
        F.when(F.col("kind") == "PRIMARY_KEY", joined("PRIMARY KEY (", column_list(F.col("column_ids"), F.col("names")), ")"))
        .when(F.col("kind") == "UNIQUE", joined("UNIQUE (", column_list(F.col("column_ids"), F.col("names")), ")"))
        .otherwise(joined("CHECK ", F.when(expression.startswith("("), expression).otherwise(joined("(", expression, ")"))))
    )
    keys = keys.select("table_id", F.struct(F.lit(1).alias("k"), F.col("name").alias("o"), joined("CONSTRAINT ", quote(F.col("name")), " ", body).alias("sql")).alias("x"))
    parts = columns.unionByName(keys).groupBy("table_id").agg(F.array_sort(F.collect_list("x")).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("    "), p["sql"])), ",\n")
    return owner.join(parts, "table_id").select("table_id", "table_name", joined("CREATE TABLE ", qualify(schema, F.col("table_name")), " (\n", body, "\n)").alias("sql"))


def foreign_keys(s: Snapshot, schema: str) -> DataFrame:
    """(table_id, table_name, name, sql); a key to a table that isn't there gives a null statement."""
    owner = names_by_table(s)
    target = owner.select(F.col("table_id").alias("ref_id"), F.col("table_name").alias("ref_name"), F.col("names").alias("ref_names"))
    rows = s.constraints.filter("kind = 'FOREIGN_KEY'").join(owner, "table_id").join(target, F.col("ref.table_id") == F.col("ref_id"), "left")
    action = lambda word, c: F.when(F.coalesce(c, F.lit("NO ACTION")) == "NO ACTION", "").otherwise(joined(f" ON {word} ", c))
    sql = joined(
        "ALTER TABLE ", qualify(schema, F.col("table_name")), " ADD CONSTRAINT ", quote(F.col("name")), " FOREIGN KEY (", column_list(F.col("column_ids"), F.col("names")),
        ") REFERENCES ", qualify(schema, F.col("ref_name")), " (", column_list(F.col("ref.column_ids"), F.col("ref_names")), ")",
        action("DELETE", F.col("ref.on_delete")), action("UPDATE", F.col("ref.on_update")),
    )
    return rows.select("table_id", "table_name", "constraint_id", "name", sql.alias("sql"))


def bare(expression: Column) -> Column:
    """A predicate without a pair of parentheses around all of it."""
    e = F.trim(expression)
    inner = F.substr(e, F.lit(2), F.length(e) - 2)
    step = lambda a, ch: F.struct(
        (a["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)).alias("depth"),
        F.least(a["low"], a["depth"] + F.when(ch == ")", -1).otherwise(0)).alias("low"),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    low = F.aggregate(F.split(inner, ""), start, step, lambda a: a["low"])
    return F.when(e.startswith("(") & e.endswith(")") & (F.length(e) > 1) & (low >= 0), F.trim(inner)).otherwise(e)


def create_indexes(s: Snapshot, schema: str, concurrently: Column | None = None) -> DataFrame:
    """(table_id, table_name, index_id, name, sql) of indexes that no constraint brings along."""
    rows = s.indexes.filter("NOT constraint_backed").join(names_by_table(s), "table_id")
    part = lambda x: F.concat(quote(F.element_at("names", x["column_id"])), F.lit(" "), x["direction"], F.lit(" NULLS "), x["nulls"])
    known = F.forall("columns", lambda x: F.element_at("names", x["column_id"]).isNotNull())
    sql = joined(
        "CREATE ", F.when(F.col("is_unique"), "UNIQUE ").otherwise(""), "INDEX ", F.lit("") if concurrently is None else F.when(concurrently, "CONCURRENTLY ").otherwise(""),
        quote(F.col("name")), " ON ", qualify(schema, F.col("table_name")), " USING ", F.col("method"), " (", F.array_join(F.transform("columns", part), ", "), ")",
        F.when(F.col("predicate").isNull(), "").otherwise(joined(" WHERE ", bare(F.col("predicate")))),
    )
    return rows.select("table_id", "table_name", "index_id", "name", F.when(known, sql).alias("sql"))


def table_order(s: Snapshot) -> list[str]:
    """table ids, parents first. Sweeps go through what is left by name and place each table whose parents are placed, within
    the same sweep too; tables in a cycle come last by name; references to oneself don't count. Runs on the driver: tens of tables."""
    left = [(r.table_id, r.name) for r in s.tables.orderBy("name").collect()]
    refs = s.constraints.filter("kind = 'FOREIGN_KEY'").select("table_id", F.col("ref.table_id").alias("parent")).collect()
    needs: dict[str, set[str]] = {t: set() for t, _ in left}
    for r in refs:
        if r.parent and r.parent != r.table_id and r.table_id in needs:
            needs[r.table_id].add(r.parent)
    out: list[str] = []
    while left:
        waiting = []
        for t, name in left:
            if needs[t] <= set(out):
                out.append(t)
            else:
                waiting.append((t, name))
        if len(waiting) == len(left):
            return out + [t for t, _ in left]
        left = waiting
    return out


def materialise(s: Snapshot, schema: str) -> DataFrame:
    """(phase, ord, name, sql): tables, then foreign keys, then indexes, each in table order."""
    place = local_frame(s.tables.sparkSession, list(enumerate(table_order(s))), "place int, table_id string")
    parts = [create_tables(s, schema).withColumn("name", F.col("table_name")), foreign_keys(s, schema), create_indexes(s, schema)]
    out = None
    for phase, rows in enumerate(parts):
        rows = rows.join(place, "table_id").select(F.lit(phase).alias("phase"), F.struct("place", "name").alias("ord"), "name", "sql")
        out = rows if out is None else out.unionByName(rows)
    return out


def statements(script: str) -> list[str]:
    """A script's statements, parted by a semicolon at a line's end."""
    return [x.strip() for x in re.split(r";\s*\n", script) if x.strip()]
