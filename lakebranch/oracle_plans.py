"""DuckDB SQL for keys, indexes, content hashes, merges of both, plans and rendered statements, written anew from VALUES of the fixtures."""

from __future__ import annotations

from lakebranch import fixtures as X
from lakebranch import queries as Q
from lakebranch.oracle import _ANCESTORS, DIFF_COLUMNS, MERGE_COLUMNS, MERGE_CONFLICTS, _SIDES, _pick, lit, sample_ctes, snapshot, statements_of, values

_ACTION = {"c": "CASCADE", "a": "NO ACTION"}
_KEY = ["constraint_id", "table_id", "table_name", "name", "kind", "place", "column_id", "column_name", "ref_table_id", "ref_table", "ref_column_id", "ref_column", "on_delete", "on_update", "expression"]
_INDEX = ["index_id", "table_id", "table_name", "name", "method", "is_unique", "place", "column_id", "column_name", "direction", "nulls", "predicate", "backed"]


def parts(edits: list[dict]) -> tuple[list[dict], list[dict]]:
    """Rows of constraints and of indexes, one for each of their columns, after edits, by plain rules of their own."""
    names = {t: [c for c, _ in columns] for t, columns in X.COLUMNS.items()}
    keys, indexes = [], []
    for k in X.sidecar()["constraints"]:
        t, r = k["table"], k.get("ref_table")
        for i, p in enumerate(k["columns"]):
            c = names[t][p - 1]
            ref = (X.tid(r), r, X.cid(r, names[r][k["ref_columns"][i] - 1]), names[r][k["ref_columns"][i] - 1], _ACTION[k["on_delete"]], "NO ACTION") if r else (None,) * 6
            keys.append(dict(zip(_KEY, (X.sid("con", t, k["name"]), X.tid(t), t, k["name"], k["kind"], i, X.cid(t, c), c, *ref, k.get("expression")), strict=True)))
    for x in X.INDEXES:
        for i, p in enumerate(x["columns"]):
            if p:
                t, bits = x["table"], x.get("options", [0] * 9)[i]
                indexes.append(dict(zip(_INDEX, (X.sid("idx", t, x["name"]), X.tid(t), t, x["name"], "btree", x.get("unique", False), i, X.cid(t, names[t][p - 1]), names[t][p - 1], "DESC" if bits & 1 else "ASC", "FIRST" if bits & 2 else "LAST", x.get("predicate"), x.get("constraint_backed", False)), strict=True)))
    named = {r["column_id"]: (r["table_id"], r["table_name"], r["name"]) for e in (X.OURS, X.THEIRS, edits) for r in X.edited_rows(X.base_rows(), e)}
    now = {r["column_id"]: r["name"] for r in X.edited_rows(X.base_rows(), edits)}
    for e in edits:
        if e["op"] == "CREATE_TABLE":
            keys += [dict.fromkeys(_KEY) | {"constraint_id": e["key_id"], "table_id": e["id"], "table_name": e["name"], "name": f"{e['name']}_pkey", "kind": "PRIMARY_KEY", "place": 0, "column_id": c["id"]} for c in e["columns"] if c.get("primary_key")]
        elif e["op"] == "ADD_INDEX":
            indexes += [dict(zip(_INDEX, (e["id"], e["table_id"], named[c][1], e["name"], "btree", False, i, c, None, "ASC", "LAST", None, False), strict=True)) for i, c in enumerate(e["column_ids"])]
        elif e["op"] == "DROP_INDEX":
            indexes = [x for x in indexes if x["index_id"] != e["index_id"]]
        elif e["op"] == "DROP_TABLE":
            keys, indexes = ([x for x in rows if x["table_id"] != e["table_id"]] for rows in (keys, indexes))
    lost = [{x[n] for x in rows if x["column_id"] not in now} for rows, n in ((keys, "constraint_id"), (indexes, "index_id"))]
    keys, indexes = [x for x in keys if x["constraint_id"] not in lost[0]], [x for x in indexes if x["index_id"] not in lost[1]]
    for x in [*keys, *indexes]:
        x["column_name"] = now[x["column_id"]]
    for x in keys:
        x["ref_column"] = now.get(x["ref_column_id"])
    return keys, indexes


def keys_cte(name: str, edits: list[dict] = ()) -> str:
    rows, _ = parts(list(edits))
    return values(name, ", ".join(_KEY), [[r[f] for f in _KEY] for r in rows])


def indexes_cte(name: str, edits: list[dict] = ()) -> str:
    _, rows = parts(list(edits))
    return values(name, ", ".join(_INDEX), [[r[f] for f in _INDEX] for r in rows])


def ident(e: str) -> str:
    return f"'\"' || replace({e}, '\"', '\"\"') || '\"'"


_OUTER = "first(ref_table_id) AS ref_table_id, first(ref_table) AS ref_table, string_agg(ref_column_id, ', ' ORDER BY place) AS ref_ids, string_agg(ref_column, ', ' ORDER BY ref_column) AS ref_names, first(on_delete) AS on_delete, first(on_update) AS on_update, first(expression) AS expression"


def key_objects(name: str, of: str) -> str:
    """A CTE of one row a constraint, with its fingerprint."""
    return f"""{name} AS (SELECT *, kind || '|[' || ids || ']' || CASE WHEN ref_table_id IS NULL THEN '' ELSE '|ref=' || ref_table_id || '[' || ref_ids || ']:' || on_delete || ':' || on_update END || coalesce('|expr=' || expression, '') AS print FROM (
  SELECT constraint_id, table_id, table_name, name, kind, string_agg(column_id, ', ' ORDER BY place) AS ids, list(column_id) AS id_list, string_agg(column_name, ', ' ORDER BY column_name) AS sorted_names, string_agg(column_name, ',' ORDER BY place) AS names,
    string_agg({ident("column_name")}, ', ' ORDER BY place) AS quoted, string_agg({ident("ref_column")}, ', ' ORDER BY place) AS ref_quoted, {_OUTER} FROM {of} GROUP BY constraint_id, table_id, table_name, name, kind))"""


def index_objects(name: str, of: str) -> str:
    return f"""{name} AS (SELECT *, method || '|' || is_unique::VARCHAR || '|' || ids || '|' || coalesce(predicate, '') AS print FROM (
  SELECT index_id, table_id, table_name, name, method, is_unique, backed, predicate, list(column_id) AS id_list, string_agg(column_id || ':' || direction || ':' || nulls, ',' ORDER BY place) AS ids, string_agg(column_name || ':' || direction || ':' || nulls, ',' ORDER BY place) AS names,
    string_agg({ident("column_name")} || ' ' || direction || ' NULLS ' || nulls, ', ' ORDER BY place) AS quoted FROM {of} GROUP BY index_id, table_id, table_name, name, method, is_unique, backed, predicate))"""


def objects(side: str, edits: list[dict] = ()) -> str:
    """CTEs k_side and i_side: constraints and indexes after edits."""
    return ", ".join([keys_cte(f"kr_{side}", edits), key_objects(f"k_{side}", f"kr_{side}"), indexes_cte(f"ir_{side}", edits), index_objects(f"i_{side}", f"ir_{side}")])


_UNMANAGED = {"v": "VIEW", "t": "TRIGGER", "e": "ENUM"}


def hash_sql(side: str, edits: list[dict] = ()) -> str:
    """CTEs that end in h_side(hash), the content hash after edits."""
    other = ", ".join(f"('U:{_UNMANAGED[o['kind']]}:{o['name']}', '{_UNMANAGED[o['kind']]}' || chr(0) || '{o['name']}')" for o in X.OBJECTS if not o["name"].startswith("__sv_"))
    return f"""{snapshot(f"s_{side}", edits)}, {objects(side, edits)}, l_{side} AS (
  SELECT DISTINCT table_name AS t, 0 AS r, '' AS n, 'T:' || table_name AS line FROM s_{side}
  UNION ALL SELECT table_name, 1, name, '  C:' || name || '|' || type_sql || '|' || CASE WHEN nullable THEN 'NULL' ELSE 'NOT NULL' END || '|' || coalesce(default_expr, '-') || '|' || coalesce(identity, '-') FROM s_{side}
  UNION ALL SELECT table_name, 2, name, '  K:' || name || '|' || kind || '|[' || sorted_names || ']' || CASE WHEN ref_table IS NULL THEN '' ELSE '|ref=' || ref_table || '[' || ref_names || ']:' || on_delete || ':' || on_update END || coalesce('|expr=' || expression, '') FROM k_{side}
  UNION ALL SELECT table_name, 3, name, '  I:' || name || '|' || method || '|' || is_unique::VARCHAR || '|' || replace(names, ',', ',') || ',|' || coalesce(predicate, '') FROM i_{side}
  UNION ALL SELECT chr(1114111), 4, n, line FROM (VALUES {other}) u(line, n)),
h_{side} AS (SELECT sha256('v1' || chr(10) || string_agg(line || chr(10), '' ORDER BY t, r, n, line)) AS hash FROM l_{side})"""


def create_tables(name: str, columns: str, keys: str) -> str:
    """A CTE (table_id, table_name, sql) of CREATE TABLE statements."""
    return f"""{name} AS (SELECT table_id, table_name, 'CREATE TABLE "main".' || {ident("table_name")} || ' (' || chr(10) || string_agg('    ' || part, ',' || chr(10) ORDER BY r, p, n) || chr(10) || ')' AS sql FROM (
  SELECT table_id, table_name, 0 AS r, position AS p, '' AS n, {ident("name")} || ' ' || type_sql || CASE WHEN identity IS NOT NULL THEN ' GENERATED ' || identity || ' AS IDENTITY' ELSE coalesce(' DEFAULT ' || default_expr, '') END || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END AS part FROM {columns}
  UNION ALL SELECT table_id, table_name, 1, 0, name, 'CONSTRAINT ' || {ident("name")} || ' ' || CASE WHEN kind = 'CHECK' THEN 'CHECK (' || expression || ')' ELSE replace(kind, '_', ' ') || ' (' || quoted || ')' END FROM {keys} WHERE kind <> 'FOREIGN_KEY') GROUP BY table_id, table_name)"""


_INDEX_SQL = f"'INDEX ' || how || {ident('name')} || ' ON \"main\".' || {ident('table_name')} || ' USING ' || method || ' (' || quoted || ')' || CASE WHEN predicate IS NULL THEN '' WHEN predicate LIKE '((%))' THEN ' WHERE ' || predicate[2:-2] ELSE ' WHERE ' || predicate END"


def index_sql(how: str) -> str:
    return "'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || " + _INDEX_SQL.replace("how", f"'{how}'")


FOREIGN_KEYS = f"""SELECT name, 'ALTER TABLE "main".' || {ident("table_name")} || ' ADD CONSTRAINT ' || {ident("name")} || ' FOREIGN KEY (' || quoted || ') REFERENCES "main".' || {ident("ref_table")} || ' (' || ref_quoted || ')'
  || CASE WHEN on_delete = 'NO ACTION' THEN '' ELSE ' ON DELETE ' || on_delete END AS sql FROM k_b WHERE kind = 'FOREIGN_KEY'"""


def diff_parts(kind: str, a: str, b: str) -> str:
    """Changes of indexes or constraints by id; a new table's indexes are told, its constraints are not; dropped tables' aren't."""
    k, key = ("i", "index_id") if kind == "INDEX" else ("k", "constraint_id")
    backed = " AND NOT coalesce(x.backed, FALSE) AND NOT coalesce(y.backed, FALSE)" if kind == "INDEX" else ""
    new = "TRUE" if kind == "INDEX" else f"y.table_id IN (SELECT table_id FROM t_{a})"
    return f"""SELECT CASE WHEN x.{key} IS NULL THEN '{kind}_ADDED' WHEN y.{key} IS NULL THEN '{kind}_DROPPED' ELSE '{kind}_CHANGED' END AS kind, coalesce(tb.name, ta.name) AS table_name, coalesce(y.name, x.name) AS object_name, coalesce(y.{key}, x.{key}) AS object_id,
  CASE WHEN x.{key} IS NOT NULL AND y.{key} IS NOT NULL THEN x.name END AS from_value, CASE WHEN x.{key} IS NOT NULL AND y.{key} IS NOT NULL THEN y.name END AS to_value
FROM {k}_{a} x FULL JOIN {k}_{b} y ON x.{key} = y.{key} LEFT JOIN t_{a} ta ON ta.table_id = coalesce(x.table_id, y.table_id) LEFT JOIN t_{b} tb ON tb.table_id = coalesce(x.table_id, y.table_id)
WHERE (x.{key} IS NULL OR y.{key} IS NULL OR x.print <> y.print OR x.name <> y.name) AND (x.{key} IS NOT NULL OR {new}) AND tb.table_id IS NOT NULL{backed}"""


def diff_ctes(edits: list[dict], a: str = "a", b: str = "b") -> str:
    """CTEs of both sides and d: every change from the base to what edits make of it, with destructive and description."""
    columns = DIFF_COLUMNS[DIFF_COLUMNS.index("\nj AS (") + 1 :]
    j, rest = columns.split("\nSELECT", 1)
    return f"""{snapshot(a)}, {snapshot(b, edits)}, {objects(a)}, {objects(b, edits)}, t_{a} AS (SELECT DISTINCT table_id, table_name AS name FROM {a}), t_{b} AS (SELECT DISTINCT table_id, table_name AS name FROM {b}), {j},
changes AS ({DIFF_TABLES.format(a=a, b=b)} UNION ALL SELECT{rest} UNION ALL {diff_parts("INDEX", a, b)} UNION ALL {diff_parts("CONSTRAINT", a, b)}),
d AS (SELECT *, kind IN ('TABLE_DROPPED', 'COLUMN_DROPPED', 'COLUMN_TYPE_CHANGED') AS destructive, {_DESCRIBE} AS description FROM changes)"""


DIFF_TABLES = """SELECT CASE WHEN x.table_id IS NULL THEN 'TABLE_ADDED' WHEN y.table_id IS NULL THEN 'TABLE_DROPPED' ELSE 'TABLE_RENAMED' END AS kind, coalesce(y.name, x.name) AS table_name, coalesce(y.name, x.name) AS object_name, coalesce(x.table_id, y.table_id) AS object_id,
  CASE WHEN x.name <> y.name THEN x.name END AS from_value, CASE WHEN x.name <> y.name THEN y.name END AS to_value FROM t_{a} x FULL JOIN t_{b} y ON x.table_id = y.table_id WHERE x.name IS DISTINCT FROM y.name"""
_DESCRIBE = """CASE kind WHEN 'TABLE_RENAMED' THEN 'Renamed table ' || from_value || ' to ' || to_value WHEN 'COLUMN_RENAMED' THEN 'Renamed ' || from_value || ' to ' || to_value
 WHEN 'COLUMN_TYPE_CHANGED' THEN 'Changed ' || object_name || ' from ' || from_value || ' to ' || to_value WHEN 'COLUMN_NULLABILITY_CHANGED' THEN object_name || ' is now ' || to_value
 WHEN 'COLUMN_DEFAULT_CHANGED' THEN 'Default for ' || object_name || ' is now ' || coalesce(to_value, 'none')
 ELSE upper(split_part(kind, '_', 2)[1]) || lower(split_part(kind, '_', 2)[2:]) || ' ' || lower(split_part(kind, '_', 1)) || ' ' || object_name END"""


def _classes() -> str:
    """(verdict, lock, blocks) of changes d other than added or retyped columns."""
    scan = "kind = 'COLUMN_NULLABILITY_CHANGED' AND to_value = 'NOT NULL'"
    return f"CASE WHEN {scan} OR kind = 'INDEX_ADDED' THEN 'SCAN' ELSE 'INSTANT' END AS verdict, CASE WHEN kind = 'INDEX_ADDED' THEN 'SHARE' ELSE 'ACCESS_EXCLUSIVE' END AS lock, CASE WHEN kind = 'INDEX_ADDED' THEN 'WRITES' ELSE 'READS_AND_WRITES' END AS blocks"


VOLATILE = "regexp_matches(lower({}), '(^|[^a-z0-9_])(random|clock_timestamp|gen_random_uuid|uuid_generate_v4|nextval|timeofday)\\(')"
_X, _N, _Q = ("ACCESS_EXCLUSIVE", "READS_AND_WRITES"), ("NONE", "NOTHING"), ("SHARE_UPDATE_EXCLUSIVE", "NOTHING")


def _step(place: str, group: str, kind: str, verdict: str, lock: tuple[str, str], sql: str, where: str, final: str = "FALSE", transactional: str = "TRUE") -> str:
    """A SELECT of one step for the changes that where holds for; place: phase and place within the change."""
    return f"SELECT {place}, table_name, position, object_id, change, {group} AS op_group, {kind} AS kind, {verdict} AS verdict, '{lock[0]}' AS lock, '{lock[1]}' AS blocks, {transactional} AS transactional, {final} AS point_of_no_return, {sql} AS sql FROM r WHERE {where}"


def plan_ctes(edits: list[dict], threshold: int) -> str:
    """CTEs that end in steps, the plan from the base to what edits make of it, and warnings."""
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n FROM {t}" for t in X.COLUMNS)
    q, dot, alter = ident("object_name"), "table_name || '.' || object_name", "'ALTER TABLE \"main\".' || " + ident("table_name")
    shadow, sync, function = (f"'\"__sv_' || {x} || '__{s}\"'" for x, s in (("object_name", "new"), ("object_name", "sync"), ("table_name || '_' || object_name", "sync")))
    here = "'\"main\".' || " + ident("table_name")
    clause = f"{q} || ' ' || type_sql || coalesce(' DEFAULT ' || default_expr, '') || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END"
    steps = [
        _step("0 AS phase, 0 AS sub", "object_name", "'DDL'", "'INSTANT'", _X, f"'DROP INDEX \"main\".' || {q}", "change = 'INDEX_DROPPED'"),
        _step("0, 0", "table_name", "'DDL'", "'INSTANT'", _X, f"{alter} || ' DROP CONSTRAINT ' || {q}", "change = 'CONSTRAINT_DROPPED'"),
        _step("1, 0", "table_name", "'DDL'", "'INSTANT'", _X, f"{alter} || ' DROP COLUMN ' || {q}", "change = 'COLUMN_DROPPED'", "TRUE"),
        _step("2, 0", "table_name", "'DDL'", "'INSTANT'", _X, f"'DROP TABLE \"main\".' || {q}", "change = 'TABLE_DROPPED'", "TRUE"),
        _step("3, 0", "table_name", "'DDL'", "'INSTANT'", _X, "made", "change = 'TABLE_ADDED'"),
        _step("5, 0", "table_name", "'DDL'", "'INSTANT'", _X, f"{alter} || ' RENAME COLUMN ' || {ident('from_value')} || ' TO ' || {ident('to_value')}", "change = 'COLUMN_RENAMED'"),
    ]
    online = "change = 'COLUMN_ADDED' AND rewrites AND big AND key IS NOT NULL"
    steps += [
        _step("6, 0", f"CASE WHEN rewrites AND big THEN {dot} ELSE table_name END", "'DDL'", "CASE WHEN rewrites THEN 'REWRITE' ELSE 'INSTANT' END", _X, f"{alter} || ' ADD COLUMN ' || {clause}", "change = 'COLUMN_ADDED' AND NOT (rewrites AND big AND key IS NOT NULL)"),
        _step("6, 0", dot, "'DDL'", "'INSTANT'", _X, f"{alter} || ' ADD COLUMN ' || {q} || ' ' || type_sql", online),
        _step("6, 1", dot, "'DDL'", "'INSTANT'", _X, f"{alter} || ' ALTER COLUMN ' || {q} || ' SET DEFAULT ' || default_expr", online),
        _step("6, 2", dot, "'BACKFILL'", "'SCAN'", _Q, "NULL", online),
        _step("6, 3", dot, "'BACKFILL'", "'SCAN'", _Q, "NULL", f"{online} AND NOT nullable"),
    ]
    retype = "change = 'COLUMN_TYPE_CHANGED' AND rewrites AND big AND key IS NOT NULL"
    required = "change = 'COLUMN_NULLABILITY_CHANGED' AND to_value = 'NOT NULL'"
    for phase, sub, where, target in ((6, 4, f"{online} AND NOT nullable", "object_name"), (7, 4, f"{retype} AND NOT nullable", "'__sv_' || object_name || '__new'"), (7, 1, f"{required} AND big", "object_name")):
        check, column = f"'\"__sv_' || {target} || '__nn\"'", ident(target)
        steps += [
            _step(f"{phase}, {sub}", dot, "'DDL'", "'INSTANT'", _X, f"{alter} || ' ADD CONSTRAINT ' || {check} || ' CHECK (' || {column} || ' IS NOT NULL) NOT VALID'", where),
            _step(f"{phase}, {sub + 1}", dot, "'VALIDATE'", "'SCAN'", _Q, f"{alter} || ' VALIDATE CONSTRAINT ' || {check}", where),
            _step(f"{phase}, {sub + 2}", dot, "'DDL'", "'INSTANT'", _X, f"{alter} || ' ALTER COLUMN ' || {column} || ' SET NOT NULL;' || chr(10) || {alter} || ' DROP CONSTRAINT ' || {check}", where),
        ]
    swap = f"'DROP TRIGGER ' || {sync} || ' ON ' || {here} || ';' || chr(10) || {alter} || ' DROP COLUMN ' || {q} || ';' || chr(10) || {alter} || ' RENAME COLUMN ' || {shadow} || ' TO ' || {q} || ';' || chr(10) || 'DROP FUNCTION IF EXISTS \"main\".' || {function} || '()'"
    typed = f"{alter} || ' ALTER COLUMN ' || {q} || ' TYPE ' || to_value"
    steps += [
        _step("7, 0", "table_name", "'DDL'", "CASE WHEN rewrites THEN 'REWRITE' ELSE 'INSTANT' END", _X, f"{typed} || ' USING ' || {q} || '::' || to_value", "change = 'COLUMN_TYPE_CHANGED' AND NOT (rewrites AND big)", "rewrites"),
        _step("7, 0", dot, "'DDL'", "'REWRITE'", _X, typed, "change = 'COLUMN_TYPE_CHANGED' AND rewrites AND big AND key IS NULL", "TRUE"),
        _step("7, 0", dot, "'DDL'", "'INSTANT'", _X, f"{alter} || ' ADD COLUMN ' || {shadow} || ' ' || to_value", retype),
        _step("7, 1", dot, "'DDL'", "'INSTANT'", _N, f"'CREATE OR REPLACE FUNCTION \"main\".' || {function} || '() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN NEW.' || {shadow} || ' := NEW.' || {q} || '::' || to_value || '; RETURN NEW; END $$'", retype),
        _step("7, 2", dot, "'DDL'", "'INSTANT'", ("SHARE_ROW_EXCLUSIVE", "WRITES"), f"'CREATE TRIGGER ' || {sync} || ' BEFORE INSERT OR UPDATE OF ' || {q} || ' ON ' || {here} || ' FOR EACH ROW EXECUTE FUNCTION \"main\".' || {function} || '()'", retype),
        _step("7, 3", dot, "'BACKFILL'", "'SCAN'", _Q, "NULL", retype),
        _step("7, 7", dot, "'DDL'", "'INSTANT'", _X, swap, retype, "TRUE"),
        _step("7, 8", dot, "'ANALYZE'", "'SCAN'", _Q, f"'ANALYZE ' || {here}", retype),
        _step("7, 0", "table_name", "'DDL'", "'INSTANT'", _X, f"{alter} || ' ALTER COLUMN ' || {q} || ' DROP NOT NULL'", "change = 'COLUMN_NULLABILITY_CHANGED' AND to_value = 'nullable'"),
        _step("7, 0", "table_name", "'DDL'", "'SCAN'", _X, f"{alter} || ' ALTER COLUMN ' || {q} || ' SET NOT NULL'", f"{required} AND NOT big"),
        _step("7, 0", dot, "'BACKFILL'", "'SCAN'", _Q, "NULL", f"{required} AND big AND default_expr IS NOT NULL AND key IS NOT NULL"),
        _step("7, 0", "table_name", "'DDL'", "'INSTANT'", _X, f"{alter} || ' ALTER COLUMN ' || {q} || CASE WHEN to_value IS NULL THEN ' DROP DEFAULT' ELSE ' SET DEFAULT ' || to_value END", "change = 'COLUMN_DEFAULT_CHANGED'"),
        _step("8, 0", "table_name", "'DDL'", "'SCAN'", ("SHARE", "WRITES"), "index_sql", "change = 'INDEX_ADDED' AND NOT big"),
        _step("8, 0", "table_name", "'INDEX_CONCURRENT'", "'SCAN'", _Q, "online_sql", "change = 'INDEX_ADDED' AND big", transactional="FALSE"),
    ]
    instant = "(regexp_matches(from_value, '^(varchar|char)') AND to_value = 'text') OR from_value = to_value"
    n = "CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0) ELSE format('{:,}', n) END"
    return f"""{diff_ctes(edits)}, {create_tables("made_b", "b", "k_b")}, counts AS ({counts}),
r AS (SELECT d.kind AS change, d.table_name, d.object_name, d.object_id, d.from_value, d.to_value, coalesce(c.position, 0) AS position, c.type_sql, c.nullable, c.default_expr, coalesce(counts.n, 0) AS n, coalesce(counts.n, 0) >= {threshold} AS big,
  pk.names AS key, made_b.sql AS made, {index_sql("").replace("is_unique", "i.is_unique").replace("replace(name", "replace(i.name").replace("replace(table_name", "replace(i.table_name").replace("|| quoted", "|| i.quoted")} AS index_sql, {index_sql("CONCURRENTLY ").replace("is_unique", "i.is_unique").replace("replace(name", "replace(i.name").replace("replace(table_name", "replace(i.table_name").replace("|| quoted", "|| i.quoted")} AS online_sql,
  CASE d.kind WHEN 'COLUMN_ADDED' THEN coalesce({VOLATILE.format("c.default_expr")}, FALSE) WHEN 'COLUMN_TYPE_CHANGED' THEN NOT ({instant}) ELSE FALSE END AS rewrites
  FROM d LEFT JOIN b c ON c.column_id = d.object_id LEFT JOIN counts ON counts.table_name = d.table_name LEFT JOIN (SELECT table_name, names FROM k_b WHERE kind = 'PRIMARY_KEY' AND len(id_list) = 1) pk ON pk.table_name = d.table_name
  LEFT JOIN made_b ON made_b.table_id = d.object_id LEFT JOIN i_b i ON i.index_id = d.object_id),
steps AS (SELECT (row_number() OVER (ORDER BY phase, table_name, position, object_id, change, sub) - 1)::INT AS seq, op_group, kind, verdict, lock, blocks, transactional, point_of_no_return, sql FROM ({" UNION ALL ".join(steps)})),
warnings AS (SELECT CASE WHEN change = 'COLUMN_DROPPED' AND n > 0 THEN 'The values of ' || {dot} || ' in ' || {n} || ' rows are lost for good.' WHEN change = 'TABLE_DROPPED' AND n > 0 THEN 'Table ' || object_name || ' goes, and its ' || {n} || ' rows with it.'
  WHEN rewrites AND big AND key IS NULL THEN 'Table ' || table_name || ' has no single-column primary key: ' || object_name || ' can''t be changed in batches, and the table is rewritten.'
  WHEN change = 'COLUMN_TYPE_CHANGED' AND rewrites AND big THEN 'Retyping ' || {dot} || ' rewrites ' || {n} || ' rows and needs disk for the new column.' END AS warning FROM r)"""


def merged_parts(kind: str) -> str:
    """The merge's indexes or constraints: ours as the branch left them, theirs that are new and neither twins nor namesakes, without those of lost columns."""
    k, key = ("i", "index_id") if kind == "INDEX" else ("k", "constraint_id")
    clash = f" AND NOT (x.table_id IN (SELECT table_id FROM o) AND x.name IN (SELECT name FROM {k}_o m WHERE m.table_id = x.table_id))" if kind == "INDEX" else ""
    return f"""WITH {_SIDES}, {objects("b")}, {objects("o", X.OURS)}, {objects("t", X.THEIRS)}, kept AS ({MERGE_COLUMNS[MERGE_COLUMNS.index(", ids AS") + 2 :].replace("ids AS (", "SELECT * FROM (WITH ids AS (", 1)})),
p AS (SELECT o.{key}, o.name, o.id_list FROM {k}_o o LEFT JOIN {k}_b b USING ({key}) LEFT JOIN {k}_t t ON t.{key} = o.{key} WHERE NOT (b.{key} IS NOT NULL AND t.{key} IS NULL AND b.print = o.print AND b.name = o.name)
  UNION ALL SELECT x.{key}, x.name, x.id_list FROM {k}_t x WHERE x.{key} NOT IN (SELECT {key} FROM {k}_b) AND x.{key} NOT IN (SELECT {key} FROM {k}_o) AND NOT EXISTS (SELECT 1 FROM {k}_o m WHERE m.table_id = x.table_id AND m.print = x.print){clash})
SELECT {key}, name FROM p WHERE len(list_filter(id_list, c -> c NOT IN (SELECT column_id FROM kept))) = 0""".replace("len(list_filter(id_list, c -> c NOT IN (SELECT column_id FROM kept))) = 0", "list_has_all((SELECT list(column_id) FROM kept), id_list)")


def after_indexes(edits: list[dict]) -> str:
    return f"WITH {indexes_cte('ir', edits)}, {index_objects('i', 'ir')} SELECT name, method, is_unique, {lit(statements_of(edits))} AS statements FROM i"


def resolved_columns() -> str:
    """MERGE_COLUMNS with the branch's value where a resolution says so."""
    takes = {}
    for key, choice in Q.RESOLUTIONS:
        stable, _, attribute = key.partition(":")
        if choice == "THEIRS" and stable.startswith("col_") and stable != "col_their_status":
            takes.setdefault({"type": "type_sql", "": "name"}[attribute], []).append(stable)
    body, lost = MERGE_COLUMNS, [X.cid("part", "p_size"), "col_ours_status"]  # a drop that is kept, and the other of two columns of one name
    for field, ids in takes.items():
        body = body.replace(f"ELSE {_pick(field)} END AS {field}", f"WHEN ids.column_id IN ({', '.join(map(lit, ids))}) THEN t.{field} ELSE {_pick(field)} END AS {field}")
    return f"SELECT column_id, name, type_sql, default_expr FROM ({body}) WHERE column_id NOT IN ({', '.join(map(lit, lost))})"


def can_apply() -> str:
    keys = [k for k, _ in Q.RESOLUTIONS[:3]]
    answered = f"coalesce(stable_id || ':' || attribute, stable_id) IN ({', '.join(map(lit, keys))}) OR stable_id IN ({', '.join(map(lit, keys))})"
    every = "TRUE"
    rows = [(n, which, b, s) for n, (which, b, s) in enumerate(Q.APPLY_CASES)]
    body = " UNION ALL ".join(f"SELECT {n}::INT AS n, count(*) FILTER (NOT ({ {'none': 'FALSE', 'some': answered, 'all': every}[which] })) AS open, {b}::INT AS blockers, {s}::INT AS steps FROM c" for n, which, b, s in rows)
    return f"WITH c AS ({MERGE_CONFLICTS}) SELECT n, open, open = 0 AND blockers = 0 AND steps > 0 AS can_apply FROM ({body})"


def oracle_sql() -> dict[str, str]:
    three = f"{objects('a')}"
    theirs = diff_ctes(X.THEIRS)
    fields = "kind, table_name, object_name, object_id, from_value, to_value"
    plan = plan_ctes(X.THEIRS, 10_000)
    group = "SELECT kind, verdict, lock, blocks, point_of_no_return FROM steps WHERE op_group = "
    settled = f"SELECT count(*) FROM i_b x WHERE x.index_id NOT IN (SELECT index_id FROM i_a) AND EXISTS (SELECT 1 FROM i_o m WHERE m.index_id NOT IN (SELECT index_id FROM i_a) AND m.print = x.print AND m.table_id = x.table_id)"
    unit = lambda salt: f"(('0x' || substr(md5(i::VARCHAR || ':{salt}'), 1, 13))::BIGINT / 4503599627370496.0)"
    url = "regexp_extract(url, '^postgres(?:ql)?://(?:([^@/]*)@)?([^/:]+)(?::([0-9]+))?(/[^?]*)?(?:[?](.*))?$', {})"
    return {
        "introspect_constraints": f"WITH {three} SELECT table_name, name, kind, names AS columns, ref_table, on_delete, expression FROM k_a",
        "introspect_indexes": f"WITH {three} SELECT table_name, name, method, is_unique, names AS columns, predicate, backed AS constraint_backed FROM i_a",
        "constraint_fingerprint": f"WITH {three} SELECT name, print AS fingerprint FROM k_a",
        "index_fingerprint": f"WITH {three} SELECT name, print AS fingerprint FROM i_a",
        "snapshot_hash": f"WITH {hash_sql('a')} SELECT hash FROM h_a",
        "drift_check": f"WITH {hash_sql('a')}, {hash_sql('b', X.DRIFT)} SELECT 'same' AS live, (SELECT hash FROM h_a) <> (SELECT hash FROM h_a) AS drifted UNION ALL SELECT 'edited', (SELECT hash FROM h_a) <> (SELECT hash FROM h_b)",
        "snapshot_dedupe": f"WITH {hash_sql('a')}, {hash_sql('b', X.OURS)}, new AS (SELECT hash FROM h_a UNION ALL SELECT hash FROM h_b) SELECT count(*) AS stored FROM new WHERE hash NOT IN (SELECT hash FROM h_a)",
        "schema_view": f"WITH {snapshot('s')}, {keys_cte('kr')}, {indexes_cte('ir')} SELECT s.table_name, s.name, s.position::INT AS position, s.type_sql, s.nullable, EXISTS (SELECT 1 FROM kr WHERE kr.column_id = s.column_id AND kind = 'PRIMARY_KEY') AS is_key, coalesce((SELECT string_agg(ir.name, ',' ORDER BY ir.name) FROM ir WHERE ir.column_id = s.column_id), '') AS indexes FROM s",
        "database_url_parse": f"WITH {values('v', 'url', [[u] for u in Q.URLS])}, p AS (SELECT url, {url.format(1)} AS u, {url.format(2)} AS h, {url.format(3)} AS port, {url.format(4)} AS path, {url.format(5)} AS query FROM v) SELECT url, CASE WHEN h <> '' THEN 'jdbc:postgresql://' || h || ':' || CASE port WHEN '' THEN '5432' ELSE port END || path || CASE WHEN regexp_matches(query, '(^|&)sslmode=') THEN '?sslmode=' || regexp_extract(query, 'sslmode=([^&]*)', 1) ELSE '' END END AS jdbc_url, CASE WHEN u <> '' THEN url_decode(split_part(u, ':', 1)) END AS username, CASE WHEN contains(u, ':') THEN url_decode(u[instr(u, ':') + 1:]) END AS password FROM p",
        "diff_tables": f"WITH {snapshot('a')}, {snapshot('b', X.RESHAPE)}, t_a AS (SELECT DISTINCT table_id, table_name AS name FROM a), t_b AS (SELECT DISTINCT table_id, CASE table_name WHEN '{X.RENAMED_TABLE[0]}' THEN '{X.RENAMED_TABLE[1]}' ELSE table_name END AS name FROM b) {DIFF_TABLES.format(a='a', b='b')}",
        "diff_constraints": f"WITH {snapshot('a')}, {snapshot('b', X.RESHAPE)}, {objects('a')}, {objects('c', X.RESHAPE)}, t_a AS (SELECT DISTINCT table_id, table_name AS name FROM a), t_b AS (SELECT DISTINCT table_id, CASE table_name WHEN '{X.RENAMED_TABLE[0]}' THEN '{X.RENAMED_TABLE[1]}' ELSE table_name END AS name FROM b), k_b AS (SELECT constraint_id, table_id, CASE name WHEN '{X.RENAMED_KEY[0]}' THEN '{X.RENAMED_KEY[1]}' ELSE name END AS name, CASE name WHEN '{X.RECHECKED[0]}' THEN replace(print, '{X.RECHECKED[1]}', '{X.RECHECKED[2]}') ELSE print END AS print FROM k_c WHERE name <> '{X.LOST_KEY}' UNION ALL SELECT '{X.NEW_KEY[0]}', '{X.tid('supplier')}', '{X.NEW_KEY[1]}', '') {diff_parts('CONSTRAINT', 'a', 'b')}",
        "diff_indexes": f"WITH {theirs} SELECT {fields} FROM d WHERE kind LIKE 'INDEX%'",
        "diff_describe": f"WITH {theirs} SELECT object_id, kind, description, destructive FROM d",
        "diff_empty": f"WITH {diff_ctes([])}, e AS (SELECT count(*) AS n FROM d) SELECT n = 0 AS is_empty FROM e",
        "branch_diff": f"WITH {diff_ctes(X.OURS)} SELECT kind, count(*) AS changes, (SELECT count(*) FROM d) > 0 AS drifted FROM d GROUP BY kind",
        "merge_changed_tables": f"""WITH {snapshot('s')}, b AS (SELECT DISTINCT table_id, table_name AS name FROM s), o AS (SELECT table_id, CASE name WHEN '{X.RENAMED_TABLE[0]}' THEN '{X.RENAMED_TABLE[1]}' ELSE name END AS name FROM b WHERE table_id NOT IN ({', '.join(lit(e['table_id']) for e in X.RESHAPE)})),
n AS ({values('v', 'old, new', list(X.THEIR_NAMES.items())).replace('v(old, new) AS (', 'SELECT * FROM (', 1)} v(old, new)), t AS (SELECT b.table_id, coalesce(n.new, b.name) AS name FROM b LEFT JOIN n ON b.name = n.old)
SELECT b.table_id, CASE WHEN o.name IS NULL AND t.name = b.name THEN NULL WHEN o.name IS NULL THEN t.name WHEN o.name = b.name THEN t.name ELSE o.name END AS name,
  CASE WHEN o.name IS NULL AND t.name <> b.name THEN 'TABLE_MODIFIED_AND_DROPPED' WHEN o.name <> b.name AND t.name <> b.name AND o.name <> t.name THEN 'BOTH_RENAMED' END AS conflict,
  CASE WHEN o.name IS NULL AND t.name <> b.name THEN 'DESTRUCTIVE' WHEN o.name <> b.name AND t.name <> b.name AND o.name <> t.name THEN 'SAFE' END AS severity
FROM b LEFT JOIN o USING (table_id) LEFT JOIN t ON t.table_id = b.table_id""",
        "merge_indexes": merged_parts("INDEX"),
        "merge_constraints": merged_parts("CONSTRAINT"),
        "merge_resolved": resolved_columns(),
        "merge_resolved_indexes": f"SELECT CASE index_id WHEN 'idx_ours_clash' THEN 'idx_their_clash' ELSE index_id END AS index_id, name FROM ({merged_parts('INDEX')})",
        "merge_can_apply": can_apply(),
        "run_plan": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice::DECIMAL(12,2) AS p_retailprice, 7::INT AS grade FROM part",
        "run_steps": f"WITH {plan_ctes(Q.RUN_EDITS, 100_000)} SELECT seq, kind, 'SUCCEEDED' AS status, 'SUCCEEDED' AS run_status, (SELECT CASE WHEN bool_or(kind IN ('BACKFILL', 'INDEX_CONCURRENT', 'VALIDATE') OR NOT transactional) THEN 'ONLINE' ELSE 'ATOMIC' END FROM steps) AS mode FROM steps",
        "branch_lifecycle": f"WITH {sample_ctes()}, m(n, event, live, n_rows) AS (VALUES (0, 'import', 'main:ACTIVE', 1), (1, 'create', 'main:ACTIVE,one:ACTIVE', 2), (6, 'name taken', 'main:ACTIVE,one:ACTIVE', 2), (7, 'delete', 'main:ACTIVE', 2), (8, 'create again', 'main:ACTIVE,one:ACTIVE', 3)) SELECT n::INT AS n, event, live, n_rows::BIGINT AS n_rows FROM m UNION ALL "
        + " UNION ALL ".join(f"SELECT {i}, 'rows of {t}', 'shop', (SELECT count(*) FROM {t}_s)" for i, t in enumerate(("region", "nation", "customer", "supplier"), 2)),
        "drift_refresh": f"WITH {hash_sql('a')}, {hash_sql('b', X.DRIFT)}, e AS (SELECT (SELECT hash FROM h_a) <> (SELECT hash FROM h_b) AS differs) SELECT * FROM (SELECT 'as recorded' AS event, FALSE AS answer, 'ACTIVE' AS status, 0::INT AS commits UNION ALL SELECT 'edited', differs, CASE WHEN differs THEN 'DRIFTED' ELSE 'ACTIVE' END, 0 FROM e UNION ALL SELECT 'refresh', differs, 'ACTIVE', 1 FROM e UNION ALL SELECT 'refresh again', NOT differs, 'ACTIVE', 1 FROM e)",
        "snapshot_roundtrip": f"WITH {hash_sql('a')} SELECT hash, (SELECT count(*) FROM s_a) AS columns FROM h_a",
        "base_fallback": f"{_ANCESTORS}, {values('f', 'a, b, fallback', Q.FALLBACKS)} SELECT f.a, f.b, f.fallback, 's_' || coalesce((SELECT max_by(x.commit_id, c.seq) FROM a x JOIN a y ON x.commit_id = y.commit_id JOIN c ON c.commit_id = x.commit_id WHERE x.head = f.a AND y.head = f.b), f.fallback) AS snapshot_id FROM f",
        "classify_change": f"WITH {theirs} SELECT object_id, kind, {_classes()} FROM d WHERE kind NOT IN ('COLUMN_ADDED', 'COLUMN_TYPE_CHANGED')",
        "plan_steps": f"WITH {plan} SELECT * FROM steps",
        "plan_drops": f"WITH {plan_ctes(X.OURS, 1_000)} SELECT * FROM steps",
        "plan_mode": f"WITH {plan} SELECT CASE WHEN bool_or(kind IN ('BACKFILL', 'INDEX_CONCURRENT', 'VALIDATE') OR NOT transactional) THEN 'ONLINE' ELSE 'ATOMIC' END AS mode FROM steps",
        "plan_warnings": f"WITH {plan} SELECT warning FROM warnings WHERE warning IS NOT NULL",
        "plan_online_retype": f"WITH {plan} {group}'orders.o_totalprice'",
        "plan_online_add": f"WITH {plan} {group}'orders.public_id'",
        "plan_online_not_null": f"WITH {plan} {group}'orders.o_custkey'",
        "merge_preview": f"WITH {plan}, {objects('o', X.OURS)}, c AS ({MERGE_CONFLICTS}) SELECT 'settled' AS part, ({settled}) AS n UNION ALL SELECT 'open', count(*) FROM c UNION ALL SELECT 'step', count(*) FROM steps UNION ALL SELECT 'final', count(*) FILTER (point_of_no_return) FROM steps",
        "render_create_table": f"WITH {snapshot('a')}, {three}, {create_tables('m', 'a', 'k_a')} SELECT table_name, sql FROM m",
        "render_foreign_key": f"WITH {objects('b')} {FOREIGN_KEYS}",
        "render_index": f"WITH {three} SELECT name, {index_sql('')} AS sql FROM i_a WHERE NOT backed",
        "materialise_script": f"WITH {snapshot('a')}, {objects('b')}, {create_tables('m', 'a', 'k_b')} SELECT 0 AS phase, table_name AS name, sql FROM m UNION ALL SELECT 1, name, sql FROM ({FOREIGN_KEYS}) UNION ALL SELECT 2, name, {index_sql('')} FROM i_b WHERE NOT backed",
        "op_add_index": after_indexes(X.OURS[6:8]),
        "op_drop_index": after_indexes(X.THEIRS[10:11]),
        "demo_products": f"SELECT i AS id, 'SKU-' || lpad(i::VARCHAR, 8, '0') AS sku, 'Product ' || i AS name, round_even({unit('price')} * 50000, 0)::INT AS price_cents FROM range(1, 201) t(i)",
        "demo_orders": f"SELECT (['pending', 'paid', 'shipped', 'delivered', 'cancelled'])[round_even({unit('status')} * 4, 0)::INT + 1] AS status, count(*) AS orders, count(*) FILTER ({unit('notes')} < 0.7) AS noted, sum(round_even({unit('customer')} * 999, 0)::BIGINT + 1)::BIGINT AS customers, sum(round_even({unit('amount')} * 500000, 0)::BIGINT)::BIGINT AS amount FROM range(1, 20001) t(i) GROUP BY 1",
        "classify_default": f"WITH {values('v', 'n, text', [(i, t) for i, t in enumerate(Q.DEFAULT_TEXTS)])} SELECT n::INT AS n, CASE WHEN {VOLATILE.format('text')} THEN 'REWRITE' ELSE 'INSTANT' END AS verdict FROM v",
    }
