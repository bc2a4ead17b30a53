"""Three-way merge of snapshots by stable id.

Tables are decided first (from a side, merged, or gone), then the columns, constraints and indexes of merged tables. All
comparisons are null-safe. strict keeps two known defects of the rules: drops and changes of constraints and indexes on their side
are then lost, and only column attributes can be resolved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakebranch.functions.hashing import constraint_fingerprint, index_fingerprint
from lakebranch.functions.types import parse_type, type_sql
from lakebranch.snapshot import Snapshot, localised

CONFLICT = (
    "type string, severity string, object_kind string, stable_id string, table_name string, object_name string, attribute string, "
    "base string, ours string, theirs string, question string"
)
_FIELDS = [x.split()[0] for x in CONFLICT.split(", ")]


@dataclass(frozen=True)
class Merge:
    merged: Snapshot
    conflicts: DataFrame

    def unresolved(self) -> DataFrame:
        """Conflicts that a person must decide."""
        return self.conflicts.filter("severity <> 'AUTO'")

    def is_clean(self) -> bool:
        return self.unresolved().isEmpty()

    def has_destructive(self) -> bool:
        return not self.conflicts.filter("severity = 'DESTRUCTIVE'").isEmpty()


def picked(b: Column, o: Column, t: Column) -> Column:
    """E5: the side that changed; ours where both did, differently."""
    return F.when(o.eqNullSafe(t), o).when(b.eqNullSafe(o), t).when(b.eqNullSafe(t), o).otherwise(o)


def disputed(b: Column, o: Column, t: Column) -> Column:
    return ~o.eqNullSafe(t) & ~b.eqNullSafe(o) & ~b.eqNullSafe(t)


def changed(a: Column, b: Column) -> Column:
    """E15 for columns, as structs of typed_columns()."""
    return ~(a["name"].eqNullSafe(b["name"]) & a["type_sql"].eqNullSafe(b["type_sql"]) & a["nullable"].eqNullSafe(b["nullable"]) & a["default_expr"].eqNullSafe(b["default_expr"]))


def conflict(kind: str, severity: str, what: str, key: Column, table: Column, name: Column, attribute: str | None, sides: list[Column], question: Column) -> Column:
    values = [F.lit(kind), F.lit(severity), F.lit(what), key, table, name, F.lit(attribute).cast("string"), *[s.cast("string") for s in sides], question]
    return F.struct(*[v.alias(n) for v, n in zip(values, _FIELDS, strict=True)])


def _three(relation: str, keys: list[str], base: Snapshot, ours: Snapshot, theirs: Snapshot, prepare=lambda df: df) -> DataFrame:
    """(keys, b, o, t): the rows of three snapshots side by side."""
    out = None
    for side, s in (("b", base), ("o", ours), ("t", theirs)):
        rows = prepare(s.typed_columns() if relation == "columns" else getattr(s, relation))
        rows = rows.select(*keys, F.struct("*").alias(side))
        out = rows if out is None else out.join(rows, keys, "full_outer")
    return out


def _exploded(rows: DataFrame, kinds: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.filter(F.array(*kinds), lambda c: c.isNotNull())).alias("c")).select("c.*")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def table_decisions(base: Snapshot, ours: Snapshot, theirs: Snapshot) -> DataFrame:
    """(table_id, b, o, t, touched_o, touched_t, decision); decision is ours, theirs, merge or drop."""
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    rows = _three("tables", ["table_id"], base, ours, theirs)
    cols = _three("columns", ["table_id", "column_id"], base, ours, theirs)
    moved = lambda x: F.max(b.isNull() != x.isNull()) | F.max(F.coalesce(changed(b, x), F.lit(False)))
    moves = cols.groupBy("table_id").agg(moved(o).alias("cols_o"), moved(t).alias("cols_t"))
    rows = rows.join(moves, "table_id", "left")
    for side in "ot":
        rows = rows.withColumn(f"touched_{side}", F.coalesce(~b["name"].eqNullSafe(F.col(side)["name"]) | F.col(f"cols_{side}"), F.lit(False)))
    decision = (
        F.when(b.isNull(), F.when(t.isNull(), "ours").when(o.isNull(), "theirs").otherwise("merge"))
        .when(o.isNull() & t.isNull(), "drop")
        .when(o.isNull(), F.when(F.col("touched_t"), "theirs").otherwise("drop"))
        .when(t.isNull(), "drop")
        .otherwise("merge")
    )
    return rows.withColumn("decision", decision).drop("cols_o", "cols_t")


def merge_tables(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, conflicts)"""
    b, o, t = (F.col(c)["name"] for c in "bot")
    key = F.col("table_id")
    name = F.when(F.col("decision") == "ours", o).when(F.col("decision") == "theirs", t).otherwise(F.when(b.isNull(), o).otherwise(picked(b, o, t)))
    kept = decisions.filter("decision <> 'drop'").select("table_id", name.alias("name"))
    gone = lambda mine, other, sides, text: F.when(b.isNotNull() & mine.isNull() & other, conflict("TABLE_MODIFIED_AND_DROPPED", "DESTRUCTIVE", "TABLE", key, b, b, None, [b, *sides], text))
    found = _exploded(decisions, [
        gone(o, t.isNotNull() & F.col("touched_t"), [F.lit("dropped"), F.lit("modified")], _text("Table '", b, "' is gone in the target but edited here: keep the edits, or let it go?")),
        gone(t, o.isNotNull() & F.col("touched_o"), [F.lit("modified"), F.lit("dropped")], _text("Table '", b, "' is gone here but edited in the target: let it go, or take the target's?")),
        F.when((F.col("decision") == "merge") & b.isNotNull() & disputed(b, o, t), conflict("BOTH_RENAMED", "SAFE", "TABLE", key, b, b, "name", [b, o, t], _text("Both sides call table '", b, "' by another name: choose one."))),
    ])
    return kept, found


def merge_columns(base: Snapshot, ours: Snapshot, theirs: Snapshot, merging: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, conflicts) of the tables (table_id, table_name) that are merged."""
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    rows = _three("columns", ["table_id", "column_id"], base, ours, theirs).join(merging, "table_id")
    in_all = b.isNotNull() & o.isNotNull() & t.isNotNull()
    keep = (
        F.when(b.isNull(), F.when(o.isNotNull(), "o").otherwise("t"))
        .when(o.isNull() & t.isNull(), F.lit(None))
        .when(o.isNull(), F.when(changed(b, t), "t"))
        .when(t.isNull(), F.when(changed(b, o), "o"))
        .otherwise("both")
    )
    value = lambda n: F.when(F.col("keep") == "t", t[n]).when(F.col("keep") == "o", o[n]).otherwise(picked(b[n], o[n], t[n]))
    ours_first = lambda n: F.when(F.col("keep") == "t", t[n]).otherwise(o[n])
    rows = rows.withColumn("keep", keep)
    kept = rows.filter("keep IS NOT NULL").select(
        "table_id", "column_id", value("name").alias("name"), ours_first("position").alias("position"), value("type").alias("type"),
        value("nullable").alias("nullable"), value("default_expr").alias("default_expr"), ours_first("identity").alias("identity"),
    )
    key, table = F.col("column_id"), F.col("table_name")
    shown = lambda c: F.concat(c["name"], F.lit(" "), c["type_sql"], F.when(c["nullable"], "").otherwise(" NOT NULL"))
    none = lambda c: F.when(c["nullable"], "nullable").otherwise("NOT NULL")
    name = b["name"]
    found = _exploded(rows, [
        F.when(b.isNotNull() & o.isNull() & t.isNotNull() & changed(b, t), conflict("MODIFIED_AND_DROPPED", "DESTRUCTIVE", "COLUMN", key, table, name, None, [shown(b), F.lit("dropped"), shown(t)], _text("Column '", name, "' is gone in the target but edited here: bring it back, or give up its values?"))),
        F.when(b.isNotNull() & t.isNull() & o.isNotNull() & changed(b, o), conflict("MODIFIED_AND_DROPPED", "DESTRUCTIVE", "COLUMN", key, table, name, None, [shown(b), shown(o), F.lit("dropped")], _text("Column '", name, "' is gone here but edited in the target: leave it there, or give up its values?"))),
        F.when(in_all & disputed(b["name"], o["name"], t["name"]), conflict("BOTH_RENAMED", "SAFE", "COLUMN", key, table, name, "name", [b["name"], o["name"], t["name"]], _text("Both sides call column '", name, "' by another name: choose one."))),
        F.when(in_all & disputed(b["type_sql"], o["type_sql"], t["type_sql"]), conflict("BOTH_MODIFIED", "STRUCTURAL", "COLUMN", key, table, o["name"], "type", [b["type_sql"], o["type_sql"], t["type_sql"]], _text("Both sides give column '", o["name"], "' another type: choose one, or a third that holds all values."))),
        F.when(in_all & disputed(b["nullable"], o["nullable"], t["nullable"]), conflict("BOTH_MODIFIED", "STRUCTURAL", "COLUMN", key, table, o["name"], "nullable", [none(b), none(o), none(t)], _text("May '", o["name"], "' be NULL? The sides disagree."))),
        F.when(in_all & disputed(b["default_expr"], o["default_expr"], t["default_expr"]), conflict("BOTH_MODIFIED", "SAFE", "COLUMN", key, table, o["name"], "default", [b["default_expr"], o["default_expr"], t["default_expr"]], _text("Both sides give column '", o["name"], "' another default: choose one."))),
    ])
    return kept, found


def merge_parts(base: Snapshot, ours: Snapshot, theirs: Snapshot, merging: DataFrame, kind: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(constraints or indexes, conflicts) of merged tables; kind is CONSTRAINT or INDEX."""
    relation, key, print_ = ("indexes", "index_id", index_fingerprint) if kind == "INDEX" else ("constraints", "constraint_id", constraint_fingerprint)
    fields = getattr(ours, relation).columns
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    rows = _three(relation, ["table_id", key], base, ours, theirs, lambda df: df.withColumn("print", print_())).join(merging, "table_id")
    same = lambda x, y: x["print"].eqNullSafe(y["print"]) & x["name"].eqNullSafe(y["name"])
    if strict:
        mine = rows.filter(o.isNotNull()).select("table_id", "table_name", o.alias("x"))
    else:  # a drop or change on their side holds where ours left the object as it was
        lost = b.isNotNull() & t.isNull() & same(b, o)
        kept = F.when(b.isNotNull() & t.isNotNull() & same(b, o), t).otherwise(o)
        mine = rows.filter(o.isNotNull() & ~F.coalesce(lost, F.lit(False))).select("table_id", "table_name", kept.alias("x"))
    new = rows.filter(b.isNull() & o.isNull()).select("table_id", "table_name", key, t.alias("x"))
    first = lambda by: F.row_number().over(W.partitionBy("table_id", by).orderBy(key)) == 1
    held = mine.groupBy("table_id", F.col("x.print").alias("print")).agg(F.min("x.name").alias("twin"))
    new = new.withColumn("print", F.col("x.print")).join(held, ["table_id", "print"], "left")
    new = new.withColumn("twin", F.coalesce("twin", F.when(~first("print"), F.min("x.name").over(W.partitionBy("table_id", "print")))))
    if kind == "INDEX":
        named = mine.select("table_id", F.col("x.name").alias("name"), F.lit(True).alias("clash")).distinct()
        new = new.withColumn("name", F.col("x.name")).join(named, ["table_id", "name"], "left")
        new = new.withColumn("clash", F.coalesce("clash", F.lit(False)) & F.col("twin").isNull())
    else:
        new = new.withColumn("clash", F.lit(False))
    name, table = F.col("x.name"), F.col("table_name")
    found = _exploded(new, [
        F.when(F.col("twin").isNotNull(), conflict("DUPLICATE_INTENT", "AUTO", kind, F.col(key), table, name, None, [F.lit(None), F.col("twin"), name], _text("Both sides added the same " + kind.lower() + "; '", F.col("twin"), "' stays."))),
        F.when(F.col("clash"), conflict("INDEX_NAME_COLLISION", "STRUCTURAL", kind, F.col(key), table, name, "name", [F.lit(None), name, name], _text("Both sides made a different index '", name, "'. Rename one."))),
    ])
    added = new.filter("twin IS NULL AND NOT clash").select("x")
    return mine.select("x").unionByName(added).select(*[F.col(f"x.{f}").alias(f) for f in fields]), found


def name_collisions(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables, and columns of a table, that would share a name; n of them give n - 1 conflicts."""
    nth = lambda keys, order: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    t = tables.withColumn("nth", nth(["name"], ["table_id"])).filter("nth > 1")
    name = F.col("name")
    one = t.select(conflict("ADD_ADD_NAME_COLLISION", "STRUCTURAL", "TABLE", F.col("table_id"), name, name, "name", [F.lit(None), name, name], _text("Two tables would be called '", name, "'. Rename one.")).alias("c"))
    c = columns.withColumn("nth", nth(["table_id", "name"], ["position", "column_id"])).filter("nth > 1").join(tables.select("table_id", F.col("name").alias("table_name")), "table_id")
    two = c.select(conflict("ADD_ADD_NAME_COLLISION", "STRUCTURAL", "COLUMN", F.col("column_id"), F.col("table_name"), name, "name", [F.lit(None), name, name], _text("'", F.col("table_name"), "' would have two columns '", name, "'. Rename one.")).alias("c"))
    return one.unionByName(two).select("c.*")


def merge(base: Snapshot, ours: Snapshot, theirs: Snapshot, strict: bool = False) -> Merge:
    """The merged snapshot, ours wherever sides disagree, and all conflicts; a few KB, so that each part is worked out once and cut off."""
    decisions = localised(table_decisions(base, ours, theirs))
    tables, conflicts = merge_tables(decisions)
    merging = localised(decisions.filter("decision = 'merge'").select("table_id", F.col("o.name").alias("table_name")))
    columns, more = merge_columns(base, ours, theirs, merging)
    conflicts = conflicts.unionByName(more)
    taken = {side: decisions.filter(F.col("decision") == side).select("table_id") for side in ("ours", "theirs")}
    whole = lambda relation: getattr(ours, relation).join(taken["ours"], "table_id", "left_semi").unionByName(getattr(theirs, relation).join(taken["theirs"], "table_id", "left_semi"))
    parts = {}
    for relation, kind in (("constraints", "CONSTRAINT"), ("indexes", "INDEX")):
        rows, more = merge_parts(base, ours, theirs, merging, kind, strict)
        conflicts = conflicts.unionByName(more)
        parts[relation] = localised(rows.unionByName(whole(relation)))
    tables, columns = localised(tables), localised(columns.unionByName(whole("columns")))
    if not strict:  # what holds a column that is gone goes with it
        alive = columns.groupBy("table_id").agg(F.collect_set("column_id").alias("alive"))
        left = lambda ids: F.size(F.array_except(ids, F.coalesce("alive", F.array().cast("array<string>")))) == 0
        parts["constraints"] = parts["constraints"].join(alive, "table_id", "left").filter(left(F.col("column_ids"))).drop("alive")
        parts["indexes"] = parts["indexes"].join(alive, "table_id", "left").filter(left(F.col("columns.column_id"))).drop("alive")
    conflicts = localised(conflicts.unionByName(name_collisions(tables, columns)))
    return Merge(Snapshot(tables, columns, parts["constraints"], parts["indexes"], ours.unmanaged), conflicts)


def answered(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts with their choice (null: open); a resolution's key is stable_id:attribute, or stable_id alone."""
    by_key = resolutions.select("key", "choice").dropDuplicates(["key"])
    full = by_key.select(F.col("key").alias("k1"), F.col("choice").alias("c1"))
    short = by_key.select(F.col("key").alias("k2"), F.col("choice").alias("c2"))
    rows = conflicts.join(full, F.concat_ws(":", "stable_id", "attribute") == F.col("k1"), "left").join(short, F.col("stable_id") == F.col("k2"), "left")
    return rows.withColumn("choice", F.coalesce("c1", "c2")).drop("k1", "k2", "c1", "c2")


def resolved(m: Merge, theirs: Snapshot, resolutions: DataFrame, strict: bool = False, ours: Snapshot | None = None) -> Snapshot:
    """THEIRS takes their value of the attribute, where both they and the merge have the column; other choices keep ours.

    Unless strict, every conflict can be settled: THEIRS also takes their table name, and either side's drop of a column or table can be
    taken, or their change kept instead. Of two tables or columns that would share a name THEIRS keeps the one that the conflict names and
    OURS the others; of two indexes THEIRS takes theirs in place of ours. What holds a column that is gone goes with it.
    """
    chosen = answered(m.conflicts, resolutions).filter("choice IN ('OURS', 'THEIRS')")
    by_them = chosen.filter("choice = 'THEIRS'")
    marks = by_them.filter("object_kind = 'COLUMN' AND type <> 'ADD_ADD_NAME_COLLISION'").groupBy(F.col("stable_id").alias("column_id")).agg(F.collect_set(F.coalesce("attribute", F.lit("*"))).alias("take"))
    their = theirs.columns.select("column_id", F.struct("*").alias("t"))
    rows = m.merged.columns.join(F.broadcast(marks), "column_id", "left").join(their, "column_id", "left")
    takes = lambda a: F.coalesce(F.array_contains("take", a) & F.col("t").isNotNull(), F.lit(False))
    value = lambda n, a: F.when(takes(a), F.col("t")[n]).otherwise(F.col(n)).alias(n)
    columns = rows.select("table_id", "column_id", value("name", "name"), "position", value("type", "type"), value("nullable", "nullable"), value("default_expr", "default"), "identity")
    if strict:
        return m.merged.with_(columns=columns)
    side = F.when(F.col("choice") == "THEIRS", F.col("theirs")).otherwise(F.col("ours"))
    lost = chosen.filter((F.col("type").endswith("MODIFIED_AND_DROPPED")) & (side == "dropped")).select("object_kind", F.col("stable_id").alias("id"))
    names = by_them.filter("object_kind = 'TABLE' AND type = 'BOTH_RENAMED'").select(F.col("stable_id").alias("table_id"), F.col("theirs").alias("new_name"))
    tables = m.merged.tables.join(names, "table_id", "left").select("table_id", F.coalesce("new_name", "name").alias("name"))
    # of what shares a name: the object that a conflict names, or all others
    clash = chosen.filter("type = 'ADD_ADD_NAME_COLLISION'").select("object_kind", F.col("stable_id").alias("id"), "choice", "table_name", "object_name")
    own = clash.filter("choice = 'OURS'").select("object_kind", "id")
    here = columns.join(tables.select("table_id", F.col("name").alias("table_name")), "table_id").select("column_id", "table_name", F.col("name").alias("object_name"))
    kept = clash.filter("choice = 'THEIRS'")
    rivals = here.join(kept.filter("object_kind = 'COLUMN'"), ["table_name", "object_name"]).filter("column_id <> id").select("object_kind", F.col("column_id").alias("id"))
    rivals = rivals.unionByName(tables.join(kept.filter("object_kind = 'TABLE'"), F.col("name") == F.col("object_name")).filter("table_id <> id").select("object_kind", F.col("table_id").alias("id")))
    lost = localised(lost.unionByName(own).unionByName(rivals).distinct())
    of = lambda kind: lost.filter(F.col("object_kind") == kind).select("id")
    # tables that the target changed and the branch dropped come back where that is the choice
    back = chosen.filter("type = 'TABLE_MODIFIED_AND_DROPPED' AND choice = 'OURS' AND theirs = 'dropped'").select(F.col("stable_id").alias("table_id"))
    relations = {"tables": tables, "columns": columns, "constraints": m.merged.constraints, "indexes": m.merged.indexes}
    for name, rows in relations.items():
        if ours is not None:
            there = rows.select("table_id").distinct()
            rows = rows.unionByName(getattr(ours, name).join(back, "table_id", "left_semi").join(there, "table_id", "left_anti").select(rows.columns))
        relations[name] = rows.join(of("TABLE"), F.col("table_id") == F.col("id"), "left_anti")
    relations["columns"] = relations["columns"].join(of("COLUMN"), F.col("column_id") == F.col("id"), "left_anti")
    taken = by_them.filter("type = 'INDEX_NAME_COLLISION'").select(F.col("stable_id").alias("index_id"))
    new = theirs.indexes.join(taken, "index_id", "left_semi").select(relations["indexes"].columns)
    old = relations["indexes"].join(new.select("table_id", "name"), ["table_id", "name"], "left_anti").select(new.columns)
    relations["indexes"] = old.unionByName(new)
    alive = relations["columns"].groupBy("table_id").agg(F.collect_set("column_id").alias("alive"))
    for name, ids in (("constraints", F.col("column_ids")), ("indexes", F.col("columns.column_id"))):
        gone = F.size(F.array_except(ids, F.coalesce("alive", F.array().cast("array<string>")))) > 0
        relations[name] = relations[name].join(alive, "table_id", "left").filter(~gone).drop("alive")
    return m.merged.with_(**relations)


def can_apply(conflicts: DataFrame, resolutions: DataFrame, n_blockers: int, n_steps: int) -> bool:
    """Everything answered, nothing blocking, something to do."""
    open_ = answered(conflicts.filter("severity <> 'AUTO'"), resolutions).filter("choice IS NULL")
    return n_blockers == 0 and n_steps > 0 and open_.isEmpty()


def parsed(text: Column) -> Column:
    """A type's canonical spelling, for resolutions that give one."""
    return type_sql(parse_type(text))
