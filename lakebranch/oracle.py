"""DuckDB SQL for the engine's queries. Snapshots are VALUES of the fixtures' plain rows; the operators are written anew in SQL."""

from __future__ import annotations

from lakebranch import fixtures as X
from lakebranch import queries as Q
from lakebranch.functions import types
from lakebranch.functions.identifiers import RESERVED


def lit(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list) -> str:
    """A CTE of literal rows."""
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


_FIELDS = ["table_id", "table_name", "column_id", "name", "position", "type_sql", "nullable", "default_expr", "identity"]


def snapshot(name: str, edits: list[dict] = ()) -> str:
    rows = X.edited_rows(X.base_rows(), list(edits))
    return values(name, ", ".join(_FIELDS), [[r[f] for f in _FIELDS] for r in rows])


def statements_of(which: list[dict]) -> str:
    """The statements, spelled out by hand for the fixtures' edits."""
    name = {r["column_id"]: r["name"] for r in X.edited_rows(X.base_rows(), X.THEIRS)} | {r["column_id"]: r["name"] for r in X.base_rows()}
    table = {r["table_id"]: r["table_name"] for r in X.base_rows()} | {"tbl_coupon": "coupon"}
    indexes = {X.sid("idx", "orders", "orders_customer_idx"): "orders_customer_idx"}
    defaults = {r["column_id"]: r["default_expr"] for r in X.base_rows()}
    out = []
    for e in which:
        here = f'"main"."{table[e["table_id"]]}"' if "table_id" in e else ""
        column = f'"{name.get(e.get("column_id"))}"'
        spelled = "" if e.get("default_expr") is None else f" DEFAULT {e['default_expr']}"
        if e["op"] == "RENAME_COLUMN":
            out.append(f'ALTER TABLE {here} RENAME COLUMN {column} TO "{e["new_name"]}"')
        elif e["op"] == "DROP_COLUMN":
            out.append(f"ALTER TABLE {here} DROP COLUMN {column}")
        elif e["op"] == "CHANGE_COLUMN_TYPE":
            out.append(f"ALTER TABLE {here} ALTER COLUMN {column} TYPE {e['new_type']} USING {column}::{e['new_type']}")
            assert defaults[e["column_id"]] is None
        elif e["op"] == "SET_COLUMN_NULLABLE":
            out.append(f"ALTER TABLE {here} ALTER COLUMN {column} SET NOT NULL")
        elif e["op"] == "SET_COLUMN_DEFAULT":
            out.append(f"ALTER TABLE {here} ALTER COLUMN {column} SET DEFAULT {e['default_expr']}")
        elif e["op"] == "ADD_COLUMN":
            out.append(f'ALTER TABLE {here} ADD COLUMN "{e["name"]}" {e["type"]}{spelled}{"" if e["nullable"] else " NOT NULL"}')
        elif e["op"] == "ADD_INDEX":
            held = name.get(e["column_ids"][0], "code")
            out.append(f'CREATE INDEX "{e["name"]}" ON {here} USING btree ("{held}" ASC NULLS LAST)')
        elif e["op"] == "DROP_INDEX":
            out.append(f'DROP INDEX "main"."{indexes[e["index_id"]]}"')
        elif e["op"] == "CREATE_TABLE":
            out.append('CREATE TABLE "main"."coupon" (\n    "id" bigint NOT NULL,\n    "code" varchar(16) DEFAULT \'x\' NOT NULL,\n    CONSTRAINT "coupon_pkey" PRIMARY KEY ("id")\n)')
        elif e["op"] == "DROP_TABLE":
            out.append(f"DROP TABLE {here}")
    return "\n".join(out)


def op_sql(which: list[dict]) -> str:
    return f"WITH {snapshot('s', which)} SELECT column_id, name, position::INT AS position, type_sql, nullable, default_expr, {lit(statements_of(which))} AS statements FROM s"


DIFF_COLUMNS = f"""WITH {snapshot("a")}, {snapshot("b", X.THEIRS)},
j AS (SELECT coalesce(b.table_name, a.table_name) AS table_name, coalesce(b.name, a.name) AS object_name, coalesce(b.column_id, a.column_id) AS object_id, a.column_id AS ai, b.column_id AS bi,
  a.name AS an, b.name AS bn, a.type_sql AS a_type, b.type_sql AS b_type, a.nullable AS av, b.nullable AS bv, a.default_expr AS ad, b.default_expr AS bd
  FROM a FULL JOIN b ON a.column_id = b.column_id WHERE coalesce(b.table_id, a.table_id) IN (SELECT table_id FROM a) AND coalesce(b.table_id, a.table_id) IN (SELECT table_id FROM b))
SELECT 'COLUMN_ADDED' AS kind, table_name, object_name, object_id, NULL::VARCHAR AS from_value, b_type AS to_value FROM j WHERE ai IS NULL
UNION ALL SELECT 'COLUMN_DROPPED', table_name, object_name, object_id, a_type, NULL FROM j WHERE bi IS NULL
UNION ALL SELECT 'COLUMN_RENAMED', table_name, object_name, object_id, an, bn FROM j WHERE an <> bn
UNION ALL SELECT 'COLUMN_TYPE_CHANGED', table_name, object_name, object_id, a_type, b_type FROM j WHERE a_type <> b_type
UNION ALL SELECT 'COLUMN_NULLABILITY_CHANGED', table_name, object_name, object_id, CASE WHEN av THEN 'nullable' ELSE 'NOT NULL' END, CASE WHEN bv THEN 'nullable' ELSE 'NOT NULL' END FROM j WHERE av <> bv
UNION ALL SELECT 'COLUMN_DEFAULT_CHANGED', table_name, object_name, object_id, ad, bd FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND ad IS DISTINCT FROM bd"""

_SIDES = f"{snapshot('b')}, {snapshot('o', X.OURS)}, {snapshot('t', X.THEIRS)}"


def _pick(f: str) -> str:
    return f"CASE WHEN o.{f} IS NOT DISTINCT FROM t.{f} THEN o.{f} WHEN b.{f} IS NOT DISTINCT FROM o.{f} THEN t.{f} ELSE o.{f} END"


def _touched(x: str) -> str:
    return " OR ".join(f"b.{f} IS DISTINCT FROM {x}.{f}" for f in ("name", "type_sql", "nullable", "default_expr"))


MERGE_COLUMNS = f"""WITH {_SIDES}, ids AS (SELECT column_id FROM b UNION SELECT column_id FROM o UNION SELECT column_id FROM t),
m AS (SELECT ids.column_id, b.column_id AS bi, o.column_id AS oi, t.column_id AS ti, ({_touched("o")}) AS co, ({_touched("t")}) AS ct,
  {", ".join(f"CASE WHEN b.column_id IS NULL THEN coalesce(o.{f}, t.{f}) WHEN o.column_id IS NULL THEN t.{f} WHEN t.column_id IS NULL THEN o.{f} ELSE {_pick(f)} END AS {f}" for f in ("name", "type_sql", "nullable", "default_expr"))}
  FROM ids LEFT JOIN b USING (column_id) LEFT JOIN o ON ids.column_id = o.column_id LEFT JOIN t ON ids.column_id = t.column_id)
SELECT column_id, name, type_sql, nullable, default_expr FROM m WHERE bi IS NULL OR (oi IS NOT NULL AND ti IS NOT NULL) OR (oi IS NULL AND ti IS NOT NULL AND ct) OR (ti IS NULL AND oi IS NOT NULL AND co)"""


def _dispute(attribute: str, f: str, kind: str, severity: str) -> str:
    return f"""SELECT '{kind}' AS type, '{severity}' AS severity, 'COLUMN' AS object_kind, b.column_id AS stable_id, '{attribute}' AS attribute FROM b JOIN o USING (column_id) JOIN t ON t.column_id = b.column_id
WHERE o.{f} IS DISTINCT FROM t.{f} AND b.{f} IS DISTINCT FROM o.{f} AND b.{f} IS DISTINCT FROM t.{f}"""


MERGE_CONFLICTS = f"""WITH {_SIDES}
{_dispute("name", "name", "BOTH_RENAMED", "SAFE")} UNION ALL {_dispute("type", "type_sql", "BOTH_MODIFIED", "STRUCTURAL")} UNION ALL {_dispute("default", "default_expr", "BOTH_MODIFIED", "SAFE")}
UNION ALL SELECT 'MODIFIED_AND_DROPPED', 'DESTRUCTIVE', 'COLUMN', b.column_id, NULL FROM b JOIN t USING (column_id) LEFT JOIN o ON o.column_id = b.column_id WHERE o.column_id IS NULL AND ({_touched("t")})
UNION ALL SELECT 'ADD_ADD_NAME_COLLISION', 'STRUCTURAL', 'COLUMN', 'col_their_status', 'name'
UNION ALL SELECT 'INDEX_NAME_COLLISION', 'STRUCTURAL', 'INDEX', 'idx_their_clash', 'name'"""

_ALIASES = {s: canonical for canonical, all_ in types.SPELLINGS.items() for s in all_}
_BASE = lambda e: f"coalesce(map_extract({{MAP}}, {e})[1], {e})".replace("{MAP}", "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in _ALIASES.items()) + "}")
_PARSED = f"""raws AS (SELECT raw, regexp_replace(lower(trim(raw)), '\\s+', ' ', 'g') AS s FROM v),
p AS (SELECT raw, s, regexp_extract(s, '\\((\\d+)', 1) AS one, regexp_extract(s, ',\\s*(\\d+)\\)', 1) AS two, trim(regexp_replace(s, '\\([^)]*\\)', '')) AS bare FROM raws),
q AS (SELECT *, CASE WHEN s LIKE '%[]' THEN s ELSE {_BASE("regexp_replace(bare, '\\s+', ' ', 'g')")} END AS base FROM p),
r AS (SELECT raw, base, CASE WHEN one <> '' AND base IN ('varchar', 'char') THEN one::INT END AS length, CASE WHEN one <> '' AND base NOT IN ('varchar', 'char') THEN one::INT END AS precision, CASE WHEN two <> '' THEN two::INT END AS scale FROM q)"""
_TYPED = f"WITH {values('v', 'raw', [[t] for t in Q.TYPES])}, {_PARSED} "


def _orphans() -> str:
    parts = []
    for child, place, parent in X.REFERENCES:
        c, p = X.COLUMNS[child][place - 1][0], X.COLUMNS[parent][0][0]
        parts.append(f"SELECT '{child}' AS child, '{parent}' AS parent, count(*)::BIGINT AS orphans FROM {child} LEFT JOIN {parent} ON {c} = {p} AND {p} % 7 <> 0 WHERE {c} IS NOT NULL AND {p} IS NULL")
    return " UNION ALL ".join(parts)


def sample_ctes() -> str:
    return (
        "region_s AS (SELECT * FROM region ORDER BY r_regionkey LIMIT 100), nation_s AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region_s) ORDER BY n_nationkey LIMIT 100), "
        "customer_s AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation_s) ORDER BY c_custkey LIMIT 100), supplier_s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation_s) ORDER BY s_suppkey LIMIT 100), "
        "part_s AS (SELECT * FROM part ORDER BY p_partkey LIMIT 100), orders_s AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer_s) ORDER BY o_orderkey LIMIT 100), "
        "lineitem_s AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders_s) AND l_partkey IN (SELECT p_partkey FROM part_s) AND l_suppkey IN (SELECT s_suppkey FROM supplier_s) ORDER BY ALL LIMIT 100)"
    )


def _samples() -> dict[str, str]:
    return {f"branch_sample_{n}": f"WITH {sample_ctes()} SELECT * FROM {n}_s" for n in ("customer", "supplier", "orders", "lineitem")}


_MIXED = "CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority ELSE o_custkey::VARCHAR END"
_INTEGER = r"'\s*[+-]?[0-9]+\s*'"


def _bad(column: str, to_type: str, name: str, test: str) -> str:
    return f"SELECT '{name}' AS column_name, '{to_type}' AS to_type, count(*) FILTER (({column}) IS NOT NULL AND NOT ({test}))::BIGINT AS failing FROM orders"


UNCASTABLE = " UNION ALL ".join([
    _bad(_MIXED, "integer", "mixed", f"regexp_full_match({_MIXED}, {_INTEGER})"),
    _bad("o_orderpriority", "integer", "o_orderpriority", f"regexp_full_match(o_orderpriority, {_INTEGER})"),
    _bad("o_custkey", "smallint", "o_custkey", "o_custkey BETWEEN -32768 AND 32767"),
    _bad("o_orderkey", "numeric(5,0)", "o_orderkey", "abs(o_orderkey) < 100000"),
    _bad("o_orderstatus", "boolean", "o_orderstatus", "lower(o_orderstatus) IN ('t', 'true', 'y', 'yes', 'on', '1', 'f', 'false', 'n', 'no', 'off', '0')"),
    _bad("o_orderpriority", "varchar(3)", "o_orderpriority", "TRUE"),
])

_COMMITS = values("c", "commit_id, parent_id, second_parent_id, seq", Q.COMMITS)
_ANCESTORS = f"WITH RECURSIVE {_COMMITS}, e AS (SELECT commit_id, parent_id AS p FROM c WHERE parent_id IS NOT NULL UNION ALL SELECT commit_id, second_parent_id FROM c WHERE second_parent_id IS NOT NULL), a AS (SELECT commit_id AS head, commit_id FROM c UNION SELECT a.head, e.p FROM a JOIN e ON a.commit_id = e.commit_id)"
_BRANCH = values("br", "branch_id, name, status, created, head_commit_id, parent_branch_id", Q.BRANCHES)
_NAMES = values("v", "n, name", [(i, n) for i, n in enumerate(Q.NAMES)])


def oracle_sql() -> dict[str, str]:
    base, ours, theirs = snapshot("s"), snapshot("s", X.OURS), snapshot("s", X.THEIRS)
    quoted = "CASE WHEN name <> '' THEN '\"' || replace(name, '\"', '\"\"') || '\"' END"
    cents = "round(o_totalprice * 100)::BIGINT"
    at = lambda p: f"list_sort(list(o_totalprice))[least(count(*), floor(count(*) * {p})::BIGINT + 1)] AS p{int(p * 100)}"
    out = {
        "type_canonicalize": _TYPED + "SELECT raw, base, length, precision, scale FROM r",
        "type_render": _TYPED + "SELECT raw, CASE WHEN length IS NOT NULL THEN base || '(' || length || ')' WHEN scale IS NOT NULL THEN base || '(' || precision || ',' || scale || ')' WHEN precision IS NOT NULL THEN base || '(' || precision || ')' ELSE base END AS type_sql FROM r",
        "default_canonicalize": "SELECT * FROM (VALUES (0, '''pending'''), (1, '''42''::integer'), (2, 'now()'), (3, 'now()'), (4, NULL), (5, NULL), (6, NULL), (7, '''x'''), (8, 'CURRENT_USER'), (9, '0.5')) t(n, canonical)",
        "introspect_tables": f"WITH {base} SELECT DISTINCT table_id, table_name AS name FROM s",
        "introspect_columns": f"WITH {base} SELECT table_name, column_id, name, position::INT AS position, type_sql, nullable, default_expr, identity FROM s",
        "introspect_unmanaged": "SELECT * FROM (VALUES ('VIEW', 'revenue'), ('TRIGGER', 'audit'), ('ENUM', 'status')) t(kind, name)",
        "object_count": f"WITH {base} SELECT (count(*) + count(DISTINCT table_id) + {len(X.sidecar()['constraints']) + 4})::BIGINT AS object_count FROM s",
        "schema_search": f"WITH {base} SELECT table_name, name, type_sql FROM s WHERE contains(lower(table_name), 'price') OR contains(lower(name), 'price') OR contains(lower(type_sql), 'price')",
        "table_stats": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS rows FROM {t}" for t in X.COLUMNS),
        "identity_carry_forward": f"WITH {base}, o AS (SELECT table_name, name, column_id FROM (WITH {ours} SELECT * FROM s)) SELECT s.table_name, s.name, s.column_id, o.column_id IS NOT NULL AS carried FROM s LEFT JOIN o ON s.table_name = o.table_name AND s.name = o.name",
        "identifier_validation": f"WITH {_NAMES} SELECT n::INT AS n, CASE WHEN name IS NULL OR trim(name) = '' THEN 'empty' WHEN strlen(name) > 63 THEN 'too long' WHEN NOT regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_$]*') THEN 'bad character' WHEN starts_with(lower(name), '__sv_') THEN 'reserved prefix' WHEN lower(name) IN ({', '.join(map(lit, RESERVED))}) THEN 'reserved word' END AS problem FROM v",
        "identifier_quote": f"WITH {_NAMES} SELECT n::INT AS n, {quoted} AS quoted, '__sv_' || name || '__new' AS shadow, '__sv_' || name || '__sync' AS trigger, '__sv_' || name || '__nn' AS not_null, '__sv_t' || coalesce('_' || name, '') || '__sync' AS function FROM v",
        "diff_columns": DIFF_COLUMNS,
        "diff_destructive": f"WITH {snapshot('a')}, {snapshot('b', X.OURS)} SELECT CASE WHEN b.column_id IS NULL THEN 'COLUMN_DROPPED' ELSE 'COLUMN_TYPE_CHANGED' END AS kind, a.table_name, coalesce(b.name, a.name) AS object_name, a.column_id AS object_id, a.type_sql AS from_value, b.type_sql AS to_value FROM a LEFT JOIN b USING (column_id) WHERE b.column_id IS NULL OR a.type_sql <> b.type_sql",
        "commit_ancestors": _ANCESTORS + " SELECT commit_id FROM a WHERE head = 'c6'",
        "merge_base": _ANCESTORS + ", pairs(a, b) AS (VALUES ('c6', 'c7'), ('c4', 'c5'), ('c6', 'c6'), ('c2', 'c3'), ('c6', 'd2')) SELECT p.a, p.b, max_by(x.commit_id, c.seq) AS commit_id FROM pairs p JOIN a x ON x.head = p.a JOIN a y ON y.head = p.b AND x.commit_id = y.commit_id JOIN c ON c.commit_id = x.commit_id GROUP BY p.a, p.b",
        "merge_attribute": "WITH v(x) AS (VALUES (NULL), ('x'), ('y')), k AS (SELECT b.x AS b, o.x AS o, t.x AS t FROM v b, v o, v t) SELECT b, o, t, CASE WHEN o IS NOT DISTINCT FROM t THEN o WHEN b IS NOT DISTINCT FROM o THEN t ELSE o END AS value, o IS DISTINCT FROM t AND b IS DISTINCT FROM o AND b IS DISTINCT FROM t AS conflict FROM k",
        "merge_columns": MERGE_COLUMNS,
        "merge_tables": f"WITH {theirs} SELECT DISTINCT table_id, table_name AS name FROM s",
        "merge_conflicts": MERGE_CONFLICTS,
        "merge_name_collisions": "SELECT 'col_their_status' AS stable_id, 'orders' AS table_name, 'status' AS object_name",
        "merge_target": f"WITH {_BRANCH}, x(branch_id, explicit) AS (VALUES ('b2', 'b4'), ('b2', NULL), ('b3', NULL), ('b1', NULL)) SELECT branch_id, coalesce(explicit, parent_branch_id, 'b1') AS target FROM x JOIN br USING (branch_id)",
        "classify_type_change": f"WITH {values('v', 'i, a, b', [(i, *p) for i, p in enumerate(Q.TYPE_CHANGES)])} SELECT a, b, CASE WHEN i IN (0, 1, 2, 3, 4, 13, 14) THEN 'INSTANT' ELSE 'REWRITE' END AS verdict FROM v",
        "plan_key_column": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {lit(c[0][0] if t in X.KEYS else None)})" for t, c in X.COLUMNS.items()) + ") t(name, key)",
        "table_topo_order": "SELECT * FROM (VALUES (0, 'part'), (1, 'region'), (2, 'nation'), (3, 'supplier'), (4, 'customer'), (5, 'events'), (6, 'orders'), (7, 'lineitem')) t(place, name)",
        "statement_split": "SELECT * FROM (VALUES (0, 'A'), (1, 'B ''x;y'''), (2, 'C')) t(n, statement)",
        "preflight_uncastable": UNCASTABLE,
        "preflight_nulls": "SELECT 'status' AS column_name, count(*) FILTER (o_orderstatus = 'P' OR o_orderstatus IS NULL)::BIGINT AS failing FROM orders UNION ALL SELECT 'o_custkey', count(*) FILTER (o_custkey IS NULL) FROM orders",
        "preflight_candidates": "SELECT * FROM (VALUES ('orders', 'o_totalprice', 'CAST', 'numeric(14,2)', FALSE), ('customer', 'c_acctbal', 'CAST', 'numeric(12,2)', FALSE), ('orders', 'o_custkey', 'NOT_NULL', 'bigint', FALSE)) t(table_name, column_name, \"check\", to_type, has_default)",
        "preflight_blockers": "SELECT format('{:,}', n) || ' row' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' of orders.o_custkey hold NULL, and the column has no default to fill them by.' AS message FROM (SELECT count(*) AS n FROM orders WHERE o_custkey = 1) WHERE n > 0",
        "orphan_check": _orphans(),
        "identity_next_value": "SELECT coalesce(max(o_orderkey), 0) + 1 AS next_value FROM orders",
        "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 250",
        "backfill_batch_stats": f"WITH r AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch, CASE WHEN o_orderkey % 3 <> 0 THEN {cents} END IS DISTINCT FROM {cents} AS moved FROM orders) SELECT batch::BIGINT AS batch, min(k) AS low_key, max(k) AS high_key, count(*)::BIGINT AS scanned, count(*) FILTER (moved)::BIGINT AS updated FROM r GROUP BY batch",
        "backfill_result": "SELECT o_orderkey, o_totalprice::DECIMAL(14,2) AS o_totalprice FROM orders",
        "backfill_failures": f"SELECT o_orderkey AS key, {_MIXED} AS value FROM orders WHERE NOT regexp_full_match({_MIXED}, {_INTEGER})",
        "batch_adaptation": "SELECT s::INT AS size, e::INT AS elapsed, (CASE WHEN e < 125 THEN least(s * 2, 50000) WHEN e > 250 THEN greatest(s // 2, 100) ELSE s END)::INT AS next, floor(e * 0.25)::BIGINT AS pause FROM (VALUES (100), (150), (1000), (30000), (50000)) a(s), (VALUES (10), (125), (200), (250), (251), (900)) b(e)",
        "backfill_progress": "SELECT * FROM (VALUES (0, 0, 0.0::DOUBLE), (5, 10, 0.5), (20, 10, 1.0), (3, NULL, 0.0)) t(done, estimated, share)",
        "backoff_ceiling": "SELECT i AS attempt, least(60000, 100 * (1::BIGINT << least(i, 20)))::BIGINT AS ms FROM range(25) t(i)",
        "list_branches": f"WITH {_BRANCH} SELECT branch_id, name, status FROM br WHERE status <> 'ABANDONED'",
        "commit_history": f"WITH {_COMMITS}, {values('l', 'commit_id, ordinal, op', Q.OPLOG)}, g AS (SELECT commit_id, string_agg(op, ',' ORDER BY ordinal) AS ops, count(*) AS n FROM l GROUP BY commit_id) SELECT commit_id, seq::BIGINT AS seq, coalesce(ops, '') AS ops, CASE WHEN n = 1 THEN ops ELSE coalesce(n, 0) || ' schema changes' END AS message FROM c LEFT JOIN g USING (commit_id)",
        "commit_next_seq": f"WITH {_COMMITS} SELECT (coalesce(max(seq), 0) + 1)::BIGINT AS seq FROM c",
        "head_snapshot": f"WITH {_BRANCH} SELECT branch_id, 's_' || head_commit_id AS snapshot_id FROM br",
        "run_status": "SELECT * FROM (VALUES (0, 'DDL', 'SUCCEEDED', NULL::INT, NULL::DOUBLE), (1, 'BACKFILL', 'RUNNING', NULL, 0.4), (2, 'VALIDATE', 'FAILED', 2003, NULL)) t(seq, kind, status, error_length, share)",
        "latency_percentiles": f"SELECT o_orderpriority, {at(0.5)}, {at(0.95)}, {at(0.99)} FROM orders GROUP BY o_orderpriority",
        "demo_customers": "SELECT i AS id, 'customer' || i || '@example.com' AS email, 'Customer ' || i AS full_name FROM range(1, 5001) t(i)",
        "edit_to_ops": "SELECT * FROM (VALUES (0, 'RENAME_COLUMN'), (1, 'SET_COLUMN_NULLABLE')) t(n, op)",
        "op_sequence": op_sql(X.THEIRS),
        "op_rename_column": op_sql(X.OURS[:1]), "op_change_type": op_sql(X.OURS[1:2]), "op_drop_column": op_sql(X.OURS[2:4]), "op_set_default": op_sql(X.OURS[8:9]),
        "op_add_column": op_sql(X.THEIRS[4:7]), "op_set_nullable": op_sql(X.THEIRS[11:12]), "op_create_table": op_sql(X.THEIRS[14:15]),
        "op_drop_table": f"WITH {base} SELECT column_id, name, position::INT AS position, type_sql, nullable, default_expr, 'DROP TABLE \"main\".\"events\"' AS statements FROM s WHERE table_name <> 'events'",
    }
    from lakebranch import oracle_plans

    return out | _samples() | oracle_plans.oracle_sql()
