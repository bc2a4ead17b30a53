"""Keys, indexes and edits of the sample tables, for queries and tests: what Parquet can't say of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakebranch.operators import ops
from lakebranch.snapshot import Snapshot
from lakebranch.sources import introspect

#: table: (column, type in canonical spelling), in order.
COLUMNS = {
    "region": [("r_regionkey", "integer"), ("r_name", "text")],
    "nation": [("n_nationkey", "integer"), ("n_name", "text"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "bigint"), ("c_name", "text"), ("c_nationkey", "integer"), ("c_acctbal", "double precision"), ("c_mktsegment", "text")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "text"), ("s_nationkey", "integer"), ("s_acctbal", "double precision")],
    "part": [("p_partkey", "bigint"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "integer"), ("p_retailprice", "double precision")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "text"), ("o_totalprice", "double precision"), ("o_orderdate", "timestamp"), ("o_orderpriority", "text")],
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "integer"), ("l_quantity", "double precision"), ("l_extendedprice", "double precision"),
        ("l_discount", "double precision"), ("l_tax", "double precision"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "timestamp"),
    ],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "text"), ("value", "double precision"), ("props", "text")],
}
KEYS = {"region": 1, "nation": 1, "customer": 1, "supplier": 1, "part": 1, "orders": 1, "events": 1}
#: (table, column position, parent): foreign keys to the parent's key.
REFERENCES = [("nation", 3, "region"), ("customer", 3, "nation"), ("supplier", 3, "nation"), ("orders", 2, "customer"), ("lineitem", 1, "orders"), ("lineitem", 2, "part"), ("lineitem", 3, "supplier"), ("events", 3, "customer")]
#: table.column: what is known beyond its Parquet type.
MORE = {
    **{f"{t}.{COLUMNS[t][0][0]}": {"not_null": True} for t in KEYS},
    "orders.o_orderkey": {"not_null": True, "identity": "d", "default": "nextval('orders_seq'::regclass)"},
    "orders.o_orderstatus": {"default": "'P'::text"},
    "orders.o_orderdate": {"default": "CURRENT_TIMESTAMP"},
    "part.p_brand": {"type": "character varying(25)", "default": "'none'::character varying"},
    "supplier.s_name": {"type": "varchar(50)"},
}
INDEXES = [
    {"table": "orders", "name": "orders_customer_idx", "columns": [2]},
    {"table": "orders", "name": "orders_recent_idx", "columns": [5, 1], "options": [3, 0], "predicate": "((o_orderstatus = 'O'::text))"},
    {"table": "part", "name": "part_brand_idx", "columns": [3], "unique": False},
    {"table": "customer", "name": "customer_pkey", "columns": [1], "unique": True, "constraint_backed": True},
    {"table": "part", "name": "part_expr_idx", "columns": [0]},
]
OBJECTS = [{"kind": "v", "name": "revenue"}, {"kind": "t", "name": "__sv_part_sync"}, {"kind": "t", "name": "audit"}, {"kind": "e", "name": "status"}]


def sidecar() -> dict:
    keys = [{"table": t, "name": f"{t}_pkey", "kind": "PRIMARY_KEY", "columns": [p]} for t, p in KEYS.items()]
    keys += [{"table": t, "name": f"{t}_{r}_fkey", "kind": "FOREIGN_KEY", "columns": [p], "ref_table": r, "ref_columns": [1], "on_delete": "c" if t == "lineitem" else "a"} for t, p, r in REFERENCES]
    keys += [{"table": "part", "name": "part_size_check", "kind": "CHECK", "columns": [5], "expression": "p_size > 0"}, {"table": "nation", "name": "nation_name_key", "kind": "UNIQUE", "columns": [2, 3]}]
    return {"columns": MORE, "constraints": keys, "indexes": INDEXES, "objects": OBJECTS}


def sid(kind: str, *parts: str) -> str:
    return f"{kind}_{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:16]}"


def tid(table: str) -> str:
    return sid("tbl", table)


def cid(table: str, column: str) -> str:
    return sid("col", table, column)


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return introspect.scan_tables(spark, folder, list(COLUMNS))


def base(spark: SparkSession, folder: str) -> Snapshot:
    return introspect.introspect(spark, tables(spark, folder), sidecar()).local()


def _of(table: str, column: str) -> dict:
    return {"table_id": tid(table), "column_id": cid(table, column)}


#: Edits of the target since the base.
OURS = [
    {"op": "RENAME_COLUMN", **_of("orders", "o_totalprice"), "new_name": "total_amount"},
    {"op": "CHANGE_COLUMN_TYPE", **_of("customer", "c_acctbal"), "new_type": "numeric(14,2)"},
    {"op": "DROP_COLUMN", **_of("lineitem", "l_tax")},
    {"op": "DROP_COLUMN", **_of("part", "p_size")},
    {"op": "RENAME_COLUMN", **_of("supplier", "s_name"), "new_name": "supplier_name"},
    {"op": "ADD_COLUMN", "table_id": tid("orders"), "id": "col_ours_status", "name": "status", "type": "varchar(20)", "nullable": True},
    {"op": "ADD_INDEX", "table_id": tid("part"), "id": "idx_ours_type", "name": "part_type_idx", "column_ids": [cid("part", "p_type")]},
    {"op": "ADD_INDEX", "table_id": tid("orders"), "id": "idx_ours_clash", "name": "orders_clash_idx", "column_ids": [cid("orders", "o_orderdate")]},
    {"op": "SET_COLUMN_DEFAULT", **_of("events", "value"), "default_expr": "0"},
]
#: Edits of the branch to merge since the base.
THEIRS = [
    {"op": "CHANGE_COLUMN_TYPE", **_of("orders", "o_totalprice"), "new_type": "numeric(14,2)"},
    {"op": "CHANGE_COLUMN_TYPE", **_of("customer", "c_acctbal"), "new_type": "numeric(12,2)"},
    {"op": "RENAME_COLUMN", **_of("part", "p_size"), "new_name": "size"},
    {"op": "RENAME_COLUMN", **_of("supplier", "s_name"), "new_name": "company"},
    {"op": "ADD_COLUMN", "table_id": tid("orders"), "id": "col_their_status", "name": "status", "type": "integer", "nullable": True},
    {"op": "ADD_COLUMN", "table_id": tid("lineitem"), "id": "col_their_token", "name": "token", "type": "uuid", "nullable": False, "default_expr": "gen_random_uuid()"},
    {"op": "ADD_COLUMN", "table_id": tid("orders"), "id": "col_their_key", "name": "public_id", "type": "uuid", "nullable": False, "default_expr": "gen_random_uuid()"},
    {"op": "ADD_INDEX", "table_id": tid("part"), "id": "idx_their_type", "name": "idx_part_type", "column_ids": [cid("part", "p_type")]},
    {"op": "ADD_INDEX", "table_id": tid("orders"), "id": "idx_their_clash", "name": "orders_clash_idx", "column_ids": [cid("orders", "o_orderpriority")]},
    {"op": "ADD_INDEX", "table_id": tid("lineitem"), "id": "idx_their_ship", "name": "lineitem_ship_idx", "column_ids": [cid("lineitem", "l_shipdate")]},
    {"op": "DROP_INDEX", "table_id": tid("orders"), "index_id": sid("idx", "orders", "orders_customer_idx")},
    {"op": "SET_COLUMN_NULLABLE", **_of("orders", "o_custkey"), "nullable": False},
    {"op": "SET_COLUMN_DEFAULT", **_of("events", "value"), "default_expr": "1"},
    {"op": "DROP_COLUMN", **_of("events", "props")},
    {"op": "CREATE_TABLE", "id": "tbl_coupon", "key_id": "con_coupon", "name": "coupon", "columns": [{"id": "col_coupon_id", "name": "id", "type": "bigint", "primary_key": True}, {"id": "col_coupon_code", "name": "code", "type": "varchar(16)", "nullable": False, "default_expr": "'x'"}]},
    {"op": "ADD_INDEX", "table_id": "tbl_coupon", "id": "idx_coupon", "name": "coupon_code_idx", "column_ids": ["col_coupon_code"]},
]


#: What a live schema differs in from what is recorded.
DRIFT = [{"op": "ADD_COLUMN", "table_id": tid("nation"), "id": "col_drift", "name": "added_by_hand", "type": "text", "nullable": True}, {"op": "SET_COLUMN_NULLABLE", **_of("part", "p_name"), "nullable": False}]
#: Changes that no operation makes: a renamed table, and a dropped one beside it; a lost, a new, a renamed and a changed constraint.
RESHAPE = [{"op": "DROP_TABLE", "table_id": tid("events")}]
RENAMED_TABLE = ("region", "area")
RENAMED_KEY = ("nation_region_fkey", "nation_area_fkey")
RECHECKED = ("part_size_check", "p_size > 0", "p_size >= 0")
LOST_KEY = "nation_name_key"
NEW_KEY = ("con_new_supplier", "supplier_name_key")


def reshaped(spark: SparkSession, folder: str) -> tuple[Snapshot, Snapshot]:
    """The base and what the changes above make of it."""
    b = base(spark, folder)
    rows = ops.apply_all(b, RESHAPE)[0].rows()
    for t in rows["tables"]:
        t["name"] = RENAMED_TABLE[1] if t["name"] == RENAMED_TABLE[0] else t["name"]
    rows["constraints"] = [k for k in rows["constraints"] if k["name"] != LOST_KEY]
    for k in rows["constraints"]:
        k["name"] = RENAMED_KEY[1] if k["name"] == RENAMED_KEY[0] else k["name"]
        k["expression"] = RECHECKED[2] if k["name"] == RECHECKED[0] else k["expression"]
    rows["constraints"].append({"table_id": tid("supplier"), "constraint_id": NEW_KEY[0], "name": NEW_KEY[1], "kind": "UNIQUE", "column_ids": [cid("supplier", "s_name")], "ref": None, "expression": None})
    return b, Snapshot.of(spark, **{n: [tuple(r.values()) for r in found] for n, found in rows.items()})


#: Names that the branch gives to tables, one of which the target renames and another drops.
THEIR_NAMES = {"region": "zone", "supplier": "vendor", "events": "log"}


def table_sides(spark: SparkSession, folder: str) -> tuple[Snapshot, Snapshot, Snapshot]:
    """The base, a target with a dropped and a renamed table, and a branch that renames those and a third."""
    b, o = reshaped(spark, folder)
    rows = b.rows()
    for t in rows["tables"]:
        t["name"] = THEIR_NAMES.get(t["name"], t["name"])
    return b, o, Snapshot.of(spark, **{n: [tuple(r.values()) for r in found] for n, found in rows.items()})


def ours(spark: SparkSession, folder: str) -> Snapshot:
    return ops.apply_all(base(spark, folder), OURS)[0]


def pair(spark: SparkSession, folder: str, edits: list[dict]) -> tuple[Snapshot, Snapshot]:
    """The base and what edits make of it."""
    b = base(spark, folder)
    return b, ops.apply_all(b, edits)[0]


def three(spark: SparkSession, folder: str) -> tuple[Snapshot, Snapshot, Snapshot]:
    """The base, the target and the branch."""
    b = base(spark, folder)
    return b, ops.apply_all(b, OURS)[0], ops.apply_all(b, THEIRS)[0]


def base_rows() -> list[dict]:
    """The base's columns, as plain rows, told from the constants above."""
    spelled = {"character varying(25)": "varchar(25)"}
    defaults = {"orders.o_orderkey": None, "orders.o_orderstatus": "'P'", "orders.o_orderdate": "now()", "part.p_brand": "'none'"}
    out = []
    for t, columns in COLUMNS.items():
        for i, (c, kind) in enumerate(columns, 1):
            more = MORE.get(f"{t}.{c}", {})
            kind = spelled.get(more.get("type", kind), more.get("type", kind))
            out.append({"table_id": tid(t), "table_name": t, "column_id": cid(t, c), "name": c, "position": i, "type_sql": kind, "nullable": not more.get("not_null", False), "default_expr": defaults.get(f"{t}.{c}"), "identity": "BY DEFAULT" if more.get("identity") == "d" else None})
    return out


def edited_rows(rows: list[dict], edits: list[dict]) -> list[dict]:
    """The rows after edits, by plain rules of their own: what oracles compare with."""
    rows = [dict(r) for r in rows]
    for e in edits:
        mine = [r for r in rows if r["column_id"] == e.get("column_id")]
        if e["op"] == "DROP_TABLE":
            rows = [r for r in rows if r["table_id"] != e["table_id"]]
        elif e["op"] == "DROP_COLUMN":
            rows = [r for r in rows if r["column_id"] != e["column_id"]]
        elif e["op"] == "RENAME_COLUMN":
            mine[0]["name"] = e["new_name"]
        elif e["op"] == "CHANGE_COLUMN_TYPE":
            mine[0]["type_sql"] = e["new_type"]
        elif e["op"] == "SET_COLUMN_NULLABLE":
            mine[0]["nullable"] = e["nullable"]
        elif e["op"] == "SET_COLUMN_DEFAULT":
            mine[0]["default_expr"] = e["default_expr"]
        elif e["op"] == "ADD_COLUMN":
            there = [r for r in rows if r["table_id"] == e["table_id"]]
            rows.append({"table_id": e["table_id"], "table_name": there[0]["table_name"], "column_id": e["id"], "name": e["name"], "position": max(r["position"] for r in there) + 1, "type_sql": e["type"], "nullable": e["nullable"], "default_expr": e.get("default_expr"), "identity": None})
        elif e["op"] == "CREATE_TABLE":
            rows += [{"table_id": e["id"], "table_name": e["name"], "column_id": c["id"], "name": c["name"], "position": i, "type_sql": c["type"], "nullable": not c.get("primary_key") and c.get("nullable", True), "default_expr": c.get("default_expr"), "identity": None} for i, c in enumerate(e["columns"], 1)]
    return rows


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return introspect.table_stats(tables(spark, folder))


def mixed_text() -> object:
    """A text column of which every tenth value is no number."""
    return F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
