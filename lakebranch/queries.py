"""A query for each operator of the engine, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakebranch import fixtures as X, scratch
from lakebranch.functions import hashing, identifiers, types
from lakebranch.operators import backfill, dag, diff, merge, ops, preflight, sample
from lakebranch.plans import classify, planner, render
from lakebranch.snapshot import local_frame, localised
from lakebranch.sources import demo, introspect, url
from lakebranch.store import Conflict, Store

TYPES = [
    "character varying(32)", "character varying", "timestamp with time zone", "timestamp without time zone", "time with time zone", "time without time zone", "integer", "bigint",
    "text", "int2", "int4", "int8", "bool", "float4", "float8", "bpchar(10)", "serial", "bigserial", "smallserial", "numeric(14,2)", "numeric(10)", "numeric", "decimal(5,3)",
    "  CHARACTER  VARYING(50)  ", "INTEGER", "timestamp(3) with time zone", "my_enum_status", "public.citext", "integer[]", "text[]",
]
DEFAULTS = [
    ("'pending'::character varying", "varchar(32)"), ("'42'::integer", "varchar(32)"), ("CURRENT_TIMESTAMP", "timestamptz"), ("now()", "timestamptz"), ("nextval('main.orders_id_seq'::regclass)", "bigint"), (None, "text"),
    ("  ", "text"), ("'x'::text", "text"), ("current_user", "text"), ("0.5::numeric(4,2)", "numeric(10,2)"),
]
TYPE_CHANGES = [
    ("varchar(50)", "varchar(100)"), ("varchar(50)", "text"), ("varchar(50)", "varchar"), ("numeric(10,2)", "numeric(14,2)"), ("timestamp(3)", "timestamp(6)"), ("varchar(100)", "varchar(50)"), ("text", "varchar(50)"),
    ("numeric(14,2)", "numeric(10,2)"), ("numeric(14,2)", "numeric(14,4)"), ("integer", "bigint"), ("integer", "numeric(14,2)"), ("text", "integer"), ("numeric", "numeric(10,2)"), ("char(4)", "text"), ("uuid", "uuid"),
]
URLS = [
    "postgres://user:p%40ss+1@db.example.com/app?sslmode=require&x=1", "postgresql://u:a:b@h:6000/x", "jdbc:postgresql://h/x", "postgres://h/db", "mysql://u:p@h/db", "postgres://only@host.example:1/p%20q", "postgresql://a%3Ab:c%2Fd@10.0.0.1/z?x=1",
]
DEFAULT_TEXTS = [None, "0", "pending", "now()", "CURRENT_TIMESTAMP", "transaction_timestamp()", "random()", "gen_random_uuid()", "clock_timestamp()", "nextval('s')", "my_random(1)", "1 + RANDOM()", "timeofday()", "'random'", "uuid_generate_v4()", "lower(random()::text)"]
#: Which conflicts are answered, how many rows of the target block the merge, and how many steps there are to do.
APPLY_CASES = [("none", 0, 9), ("some", 0, 9), ("all", 0, 9), ("all", 2, 9), ("all", 0, 0), ("none", 1, 0)]
RESOLUTIONS = [(X.cid("customer", "c_acctbal") + ":type", "THEIRS"), (X.cid("supplier", "s_name"), "THEIRS"), (X.cid("events", "value"), "OURS"), (X.cid("part", "p_size"), "OURS"), ("col_their_status", "THEIRS"), ("idx_their_clash", "THEIRS")]
NAMES = ["orders", "Order", "_x$1", "1abc", "with space", "", None, "a" * 63, "a" * 64, "__sv_x", "__SV_y", "select", "GROUP", "naïve", "é" * 32, 'say "hi"']
#: The base commit's children: two branches that merge into each other twice.
COMMITS = [
    ("c1", None, None, 1), ("c2", "c1", None, 2), ("c3", "c1", None, 3), ("c4", "c2", "c3", 4), ("c5", "c3", "c2", 5), ("c6", "c4", None, 6), ("c7", "c5", "c4", 7), ("d1", None, None, 8), ("d2", "d1", None, 9),
]
BRANCHES = [("b1", "main", "ACTIVE", 1, "c6", None), ("b2", "feature", "ACTIVE", 3, "c7", "b1"), ("b3", "old", "ABANDONED", 2, "c3", "b1"), ("b4", "alpha", "MERGED", 2, "c5", "b2")]
FALLBACKS = [("c6", "c7", "c1"), ("c6", "d2", "c3"), ("c6", "d2", None), ("d2", "d1", "c1")]
OPLOG = [("c2", 1, "ADD_COLUMN"), ("c2", 0, "RENAME_COLUMN"), ("c3", 0, "DROP_INDEX"), ("c6", 0, "ADD_INDEX"), ("c6", 1, "ADD_INDEX"), ("c6", 2, "DROP_COLUMN")]


def commits(spark: SparkSession) -> DataFrame:
    rows = local_frame(spark, COMMITS, "commit_id string, parent_id string, second_parent_id string, seq long")
    return rows.withColumn("snapshot_id", F.concat(F.lit("s_"), "commit_id"))


def type_canonicalize(spark, d):
    rows = local_frame(spark, [(t,) for t in TYPES], "raw string")
    return rows.withColumn("t", types.parse_type(F.col("raw"))).select("raw", "t.base", "t.length", "t.precision", "t.scale")


def type_render(spark, d):
    rows = local_frame(spark, [(t,) for t in TYPES], "raw string")
    return rows.select("raw", types.type_sql(types.parse_type(F.col("raw"))).alias("type_sql"))


def default_canonicalize(spark, d):
    rows = local_frame(spark, [(i, *r) for i, r in enumerate(DEFAULTS)], "n int, raw string, column_type string")
    return rows.select("n", types.canonical_default(F.col("raw"), types.parse_type(F.col("column_type"))).alias("canonical"))


def introspect_tables(spark, d):
    return X.base(spark, d).tables


def introspect_columns(spark, d):
    s = X.base(spark, d)
    return s.typed_columns().join(s.tables.select("table_id", F.col("name").alias("table_name")), "table_id").select("table_name", "column_id", "name", "position", "type_sql", "nullable", "default_expr", "identity")


def introspect_constraints(spark, d):
    s = X.base(spark, d)
    names = render.names_by_table(s)
    held = F.array_join(F.transform("column_ids", lambda i: F.element_at("names", i)), ",")
    target = s.tables.select(F.col("table_id").alias("r"), F.col("name").alias("ref_table"))
    return s.constraints.join(names, "table_id").join(target, F.col("ref.table_id") == F.col("r"), "left").select("table_name", "name", "kind", held.alias("columns"), "ref_table", F.col("ref.on_delete").alias("on_delete"), "expression")


def introspect_indexes(spark, d):
    s = X.base(spark, d)
    part = lambda x: F.concat_ws(":", F.element_at("names", x["column_id"]), x["direction"], x["nulls"])
    return s.indexes.join(render.names_by_table(s), "table_id").select("table_name", "name", "method", "is_unique", F.array_join(F.transform("columns", part), ",").alias("columns"), "predicate", "constraint_backed")


def introspect_unmanaged(spark, d):
    return X.base(spark, d).unmanaged.select("kind", "name")


def identity_carry_forward(spark, d):
    """A second introspection keeps the ids that the first one's edits left."""
    before = X.ours(spark, d)
    now = introspect.introspect(spark, X.tables(spark, d), X.sidecar(), before)
    old = before.columns.select("table_id", "name", F.lit(True).alias("known"))
    rows = now.columns.join(now.tables.select("table_id", F.col("name").alias("table_name")), "table_id").join(old, ["table_id", "name"], "left")
    return rows.select("table_name", "name", "column_id", F.coalesce("known", F.lit(False)).alias("carried"))


def snapshot_hash(spark, d):
    return hashing.snapshot_hash(X.base(spark, d))


def constraint_fingerprint(spark, d):
    return X.base(spark, d).constraints.select("name", hashing.constraint_fingerprint().alias("fingerprint"))


def index_fingerprint(spark, d):
    return X.base(spark, d).indexes.select("name", hashing.index_fingerprint().alias("fingerprint"))


def object_count(spark, d):
    return X.base(spark, d).object_count()


def schema_view(spark, d):
    return X.base(spark, d).view()


def schema_search(spark, d):
    return X.base(spark, d).search("price").select("table_name", "name", "type_sql")


def table_stats(spark, d):
    return X.row_counts(spark, d)


def database_url_parse(spark, d):
    rows = local_frame(spark, [(u,) for u in URLS], "url string")
    return rows.withColumn("p", url.parse_database_url(F.col("url"))).select("url", "p.jdbc_url", "p.username", "p.password")


def identifier_validation(spark, d):
    rows = local_frame(spark, list(enumerate(NAMES)), "n int, name string")
    return rows.select("n", identifiers.problem(F.col("name")).alias("problem"))


def identifier_quote(spark, d):
    rows = local_frame(spark, list(enumerate(NAMES)), "n int, name string")
    m = identifiers.machinery(F.col("name"), F.lit("t"))
    return rows.select("n", identifiers.quote(F.col("name")).alias("quoted"), *[c.alias(k) for k, c in m.items()])


def _op(which: list[dict], start: Callable = X.base):
    def run(spark, d):
        s, sql = ops.apply_all(start(spark, d), which)
        rows = s.typed_columns().select("column_id", "name", "position", "type_sql", "nullable", "default_expr")
        return rows.withColumn("statements", F.lit("\n".join(sql)))

    return run


_O, _T = X.OURS, X.THEIRS


def op_sequence(spark, d):
    return _op(_T)(spark, d)


def op_drop_table(spark, d):
    return _op([{"op": "DROP_TABLE", "table_id": X.tid("events")}])(spark, d)


def _indexes_after(which: list[dict]):
    def run(spark, d):
        s, sql = ops.apply_all(X.base(spark, d), which)
        return s.indexes.select("name", "method", "is_unique").withColumn("statements", F.lit("\n".join(sql)))

    return run


_FIELDS = ["kind", "table_name", "object_name", "object_id", "from_value", "to_value"]


def diff_columns(spark, d):
    return diff.diff_columns(*X.pair(spark, d, X.THEIRS)).select(_FIELDS)


def diff_tables(spark, d):
    return diff.diff_tables(*X.reshaped(spark, d)).select(_FIELDS)


def diff_indexes(spark, d):
    return diff.diff_indexes(*X.pair(spark, d, X.THEIRS)).select(_FIELDS)


def diff_constraints(spark, d):
    return diff.diff_constraints(*X.reshaped(spark, d)).select(_FIELDS)


def diff_destructive(spark, d):
    return diff.diff(*X.pair(spark, d, X.OURS)).filter("destructive").select(_FIELDS)


def diff_describe(spark, d):
    return diff.diff(*X.pair(spark, d, X.THEIRS)).select("object_id", "kind", "description", "destructive")


def diff_empty(spark, d):
    s = X.base(spark, d)
    return diff.diff(s, s).agg((F.count("*") == 0).alias("is_empty"))


def branch_diff(spark, d):
    """What a branch changed since it was made, and whether its live schema drifted from what is recorded."""
    first, head = X.pair(spark, d, X.OURS)
    live = introspect.introspect(spark, X.tables(spark, d), X.sidecar())
    drifted = hashing.snapshot_hash(head).first() != hashing.snapshot_hash(live).first()
    return diff.diff(first, head).groupBy("kind").agg(F.count("*").alias("changes")).withColumn("drifted", F.lit(drifted))


def drift_check(spark, d):
    """H8: against a live schema that is as recorded, and against one that was edited by hand."""
    recorded = X.base(spark, d)
    out, old = None, hashing.snapshot_hash(recorded).first().hash
    for name, live in (("same", introspect.introspect(spark, X.tables(spark, d), X.sidecar())), ("edited", ops.apply_all(recorded, X.DRIFT)[0])):
        one = hashing.snapshot_hash(live).select(F.lit(name).alias("live"), (F.col("hash") != old).alias("drifted"))
        out = one if out is None else out.unionByName(one)
    return out


def commit_ancestors(spark, d):
    return dag.ancestors(commits(spark), "c6")


def merge_base(spark, d):
    pairs = [("c6", "c7"), ("c4", "c5"), ("c6", "c6"), ("c2", "c3"), ("c6", "d2")]
    out = None
    for a, b in pairs:
        one = dag.merge_base(commits(spark), a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "commit_id")
        out = one if out is None else out.unionByName(one)
    return out


def merge_attribute(spark, d):
    values = [None, "x", "y"]
    rows = local_frame(spark, [(b, o, t) for b in values for o in values for t in values], "b string, o string, t string")
    cols = [F.col(c) for c in "bot"]
    return rows.select("b", "o", "t", merge.picked(*cols).alias("value"), merge.disputed(*cols).alias("conflict"))


def _merged(spark, d) -> merge.Merge:
    return merge.merge(*X.three(spark, d))


def merge_columns(spark, d):
    return _merged(spark, d).merged.typed_columns().select("column_id", "name", "type_sql", "nullable", "default_expr")


def merge_tables(spark, d):
    return _merged(spark, d).merged.tables


def merge_changed_tables(spark, d):
    """Tables that both sides rename, one renames, or one drops and the other renames, with what a person must decide."""
    m = merge.merge(*X.table_sides(spark, d))
    kinds = m.conflicts.filter("object_kind = 'TABLE'").select(F.col("stable_id").alias("table_id"), F.col("type").alias("conflict"), "severity")
    return m.merged.tables.join(kinds, "table_id", "full_outer").select("table_id", "name", "conflict", "severity")


def merge_indexes(spark, d):
    return _merged(spark, d).merged.indexes.select("index_id", "name")


def merge_constraints(spark, d):
    return _merged(spark, d).merged.constraints.select("constraint_id", "name")


def merge_conflicts(spark, d):
    return _merged(spark, d).unresolved().select("type", "severity", "object_kind", "stable_id", "attribute")


def merge_name_collisions(spark, d):
    m = _merged(spark, d)
    return m.conflicts.filter("type = 'ADD_ADD_NAME_COLLISION'").select("stable_id", "table_name", "object_name")


def _resolutions(spark) -> DataFrame:
    return local_frame(spark, RESOLUTIONS, "key string, choice string")


def merge_resolved(spark, d):
    sides = X.three(spark, d)
    s = merge.resolved(merge.merge(*sides), sides[2], _resolutions(spark))
    return s.typed_columns().select("column_id", "name", "type_sql", "default_expr")


def merge_resolved_indexes(spark, d):
    sides = X.three(spark, d)
    return merge.resolved(merge.merge(*sides), sides[2], _resolutions(spark)).indexes.select("index_id", "name")


def merge_can_apply(spark, d):
    """In each of APPLY_CASES, how many conflicts are open and whether the merge can be applied."""
    conflicts = localised(_merged(spark, d).conflicts)
    everything = local_frame(spark, [(r.stable_id, "OURS") for r in conflicts.collect()], "key string, choice string")
    answers, out = {"none": everything.limit(0), "some": local_frame(spark, RESOLUTIONS[:3], "key string, choice string"), "all": everything}, []
    for n, (which, blockers, steps) in enumerate(APPLY_CASES):
        open_ = merge.answered(conflicts.filter("severity <> 'AUTO'"), answers[which]).filter("choice IS NULL").count()
        out.append((n, open_, merge.can_apply(conflicts, answers[which], blockers, steps)))
    return local_frame(spark, out, "n int, open long, can_apply boolean")


def merge_target(spark, d):
    """The explicit target, else the parent branch, else main."""
    rows = local_frame(spark, [("b2", "b4"), ("b2", None), ("b3", None), ("b1", None)], "branch_id string, explicit string")
    known = _branches(spark).select("branch_id", "parent_branch_id")
    return rows.join(known, "branch_id").select("branch_id", F.coalesce("explicit", "parent_branch_id", F.lit("b1")).alias("target"))


def classify_default(spark, d):
    rows = local_frame(spark, list(enumerate(DEFAULT_TEXTS)), "n int, text string")
    return rows.select("n", classify.add_column(F.col("text"))["verdict"].alias("verdict"))


def classify_type_change(spark, d):
    rows = local_frame(spark, TYPE_CHANGES, "a string, b string")
    return rows.select("a", "b", classify.change_type(types.parse_type(F.col("a")), types.parse_type(F.col("b")))["verdict"].alias("verdict"))


def classify_change(spark, d):
    rows = diff.diff(*X.pair(spark, d, X.THEIRS)).filter("kind NOT IN ('COLUMN_ADDED', 'COLUMN_TYPE_CHANGED')")
    return rows.select("object_id", "kind", classify.change(F.col("kind"), F.col("to_value")).alias("c")).select("object_id", "kind", "c.verdict", "c.lock", "c.blocks")


def _plan(spark, d, threshold: int = 10_000) -> planner.Plan:
    return planner.plan(*X.pair(spark, d, X.THEIRS), X.row_counts(spark, d), "main", threshold)


def plan_steps(spark, d):
    return _plan(spark, d).steps.select("seq", "op_group", "kind", "verdict", "lock", "blocks", "transactional", "point_of_no_return", "sql")


_STEP = ["seq", "op_group", "kind", "verdict", "lock", "blocks", "transactional", "point_of_no_return", "sql"]


def plan_drops(spark, d):
    """The plan of the target's own edits, with dropped columns and a constraint that goes with one."""
    return planner.plan(*X.pair(spark, d, X.OURS), X.row_counts(spark, d), "main", 1_000).steps.select(_STEP)


def plan_mode(spark, d):
    return _plan(spark, d).mode()


def plan_warnings(spark, d):
    return _plan(spark, d).warnings


def plan_key_column(spark, d):
    s = X.base(spark, d)
    return s.tables.join(planner.key_columns(s), "table_id", "left").select("name", "key")


def _group(prefix: str):
    def run(spark, d):
        return _plan(spark, d).steps.filter(F.col("op_group") == prefix).select("kind", "verdict", "lock", "blocks", "point_of_no_return")

    return run


def render_create_table(spark, d):
    return render.create_tables(X.base(spark, d), "main").select("table_name", "sql")


def render_foreign_key(spark, d):
    return render.foreign_keys(X.base(spark, d), "main").select("name", "sql")


def render_index(spark, d):
    return render.create_indexes(X.base(spark, d), "main").select("name", "sql")


def table_topo_order(spark, d):
    s = X.base(spark, d)
    place = local_frame(spark, list(enumerate(render.table_order(s))), "place int, table_id string")
    return place.join(s.tables, "table_id").select("place", "name")


def materialise_script(spark, d):
    return render.materialise(X.base(spark, d), "main").select("phase", "name", "sql")


def statement_split(spark, d):
    return local_frame(spark, [(i, x) for i, x in enumerate(render.statements("A;\nB 'x;y';\n  C"))], "n int, statement string")


def merge_preview(spark, d):
    """how many conflicts are settled or open, and what the plan comes to."""
    m = _merged(spark, d)
    p = _plan(spark, d)
    rows = m.conflicts.select(F.when(F.col("severity") == "AUTO", "settled").otherwise("open").alias("part"))
    rows = rows.unionByName(p.steps.select(F.lit("step").alias("part"))).unionByName(p.points_of_no_return().select(F.lit("final").alias("part")))
    return rows.groupBy("part").agg(F.count("*").alias("n"))


def preflight_candidates(spark, d):
    return preflight.candidates(*X.pair(spark, d, X.THEIRS), X.row_counts(spark, d))


def preflight_uncastable(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("mixed", X.mixed_text())
    checks = [("mixed", "CAST", "integer"), ("o_orderpriority", "CAST", "integer"), ("o_custkey", "CAST", "smallint"), ("o_orderkey", "CAST", "numeric(5,0)"), ("o_orderstatus", "CAST", "boolean"), ("o_orderpriority", "CAST", "varchar(3)")]
    return preflight.failing(rows, checks).select("column_name", "to_type", "failing")


def preflight_nulls(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return preflight.failing(rows, [("status", "NOT_NULL", "text"), ("o_custkey", "NOT_NULL", "bigint")]).select("column_name", "failing")


def preflight_blockers(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumn("o_custkey", F.nullif("o_custkey", F.lit(1)))
    tables = X.tables(spark, d) | {"orders": orders}
    found = preflight.preflight(tables, *X.pair(spark, d, X.THEIRS), X.row_counts(spark, d))
    return preflight.blockers(found)


def orphan_check(spark, d):
    t = X.tables(spark, d)
    out = None
    for child, position, parent in X.REFERENCES:
        keys = [(X.COLUMNS[child][position - 1][0], X.COLUMNS[parent][0][0])]
        known = t[parent].filter(F.col(keys[0][1]) % 7 != 0)  # so that some rows are orphans
        one = preflight.orphans(t[child], known, keys).select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "orphans")
        out = one if out is None else out.unionByName(one)
    return out


def _sampled(name: str, limit: int = 100):
    def run(spark, d):
        t = X.tables(spark, d)
        refs = [(c, [X.COLUMNS[c][p - 1][0]], r, [X.COLUMNS[r][0][0]]) for c, p, r in X.REFERENCES]
        order = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
        keys = {n: [X.COLUMNS[n][p - 1][0]] for n, p in X.KEYS.items()} | {"lineitem": [c for c, _ in X.COLUMNS["lineitem"]]}
        return sample.sample(t, order, keys, refs, limit)[name]

    return run


def identity_next_value(spark, d):
    return sample.next_identity(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey")


def keyset_page(spark, d):
    return backfill.keyset_page(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 250)


_CENTS = lambda: F.round(F.col("o_totalprice") * 100).cast("long")


def backfill_batch_stats(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("cents", F.when(F.col("o_orderkey") % 3 != 0, _CENTS()))
    return backfill.batch_stats(rows, "o_orderkey", "cents", _CENTS(), 1_000)


def backfill_result(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    return backfill.filled(rows, "o_totalprice", F.col("o_totalprice").cast("decimal(14,2)"))


def backfill_failures(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("mixed", X.mixed_text())
    return backfill.failures(rows, "o_orderkey", "mixed", "int")


def batch_adaptation(spark, d):
    rows = local_frame(spark, [(n, ms) for n in (100, 150, 1_000, 30_000, 50_000) for ms in (10, 125, 200, 250, 251, 900)], "size int, elapsed int")
    return rows.select("size", "elapsed", backfill.next_size(F.col("size"), F.col("elapsed")).alias("next"), backfill.pause(F.col("elapsed")).alias("pause"))


def backfill_progress(spark, d):
    rows = local_frame(spark, [(0, 0), (5, 10), (20, 10), (3, None)], "done int, estimated int")
    return rows.select("done", "estimated", backfill.progress(F.col("done"), F.col("estimated")).alias("share"))


def backoff_ceiling(spark, d):
    return spark.range(25).select(F.col("id").alias("attempt"), backfill.backoff_ceiling(F.col("id")).alias("ms"))


def _branches(spark) -> DataFrame:
    return local_frame(spark, BRANCHES, "branch_id string, name string, status string, created int, head_commit_id string, parent_branch_id string")


def list_branches(spark, d):
    """J4"""
    rows = _branches(spark).filter("status <> 'ABANDONED'")
    return rows.orderBy((F.col("name") == "main").desc(), "created").select("branch_id", "name", "status")


def commit_history(spark, d):
    """Commits with their operations in order."""
    log = local_frame(spark, OPLOG, "commit_id string, ordinal int, op string")
    done = log.groupBy("commit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "op"))), lambda x: x["op"]), ",").alias("ops"), F.count_distinct("op").alias("kinds"), F.count("*").alias("n"))
    rows = commits(spark).join(done, "commit_id", "left")
    text = F.when(F.col("n") == 1, F.col("ops")).otherwise(F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" schema changes")))
    return rows.select("commit_id", "seq", F.coalesce("ops", F.lit("")).alias("ops"), text.alias("message")).orderBy(F.desc("seq"))


def commit_next_seq(spark, d):
    """J6"""
    return commits(spark).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))


def head_snapshot(spark, d):
    """J8"""
    return _branches(spark).join(commits(spark), F.col("head_commit_id") == F.col("commit_id")).select("branch_id", "snapshot_id")


def snapshot_dedupe(spark, d):
    """Snapshots to store, those left out that are stored already."""
    old, edited = X.pair(spark, d, X.OURS)
    stored = hashing.snapshot_hash(old)
    new = stored.unionByName(hashing.snapshot_hash(edited))
    return new.join(stored, "hash", "left_anti").agg(F.count("*").alias("stored"))


def run_status(spark, d):
    """A run's steps with how far their fills are."""
    steps = local_frame(spark, [(0, "DDL", "SUCCEEDED", None), (1, "BACKFILL", "RUNNING", None), (2, "VALIDATE", "FAILED", "x" * 2_100)], "seq int, kind string, status string, error string")
    cursor = local_frame(spark, [(1, 400, 1_000)], "seq int, done int, estimated int")
    rows = steps.join(cursor, "seq", "left")
    return rows.select("seq", "kind", "status", F.length(backfill.truncated(F.col("error"))).alias("error_length"), F.when(F.col("done").isNotNull(), backfill.progress(F.col("done"), F.col("estimated"))).alias("share"))


#: What a branch changes for run_plan: a retype of stored values, a default, NOT NULL, a column and an index.
RUN_EDITS = [
    {"op": "CHANGE_COLUMN_TYPE", **X._of("part", "p_retailprice"), "new_type": "numeric(12,2)"}, {"op": "ADD_COLUMN", "table_id": X.tid("part"), "id": "col_run_grade", "name": "grade", "type": "integer", "nullable": False, "default_expr": "7"},
    {"op": "SET_COLUMN_NULLABLE", **X._of("part", "p_type"), "nullable": False}, {"op": "ADD_INDEX", "table_id": X.tid("part"), "id": "idx_run_type", "name": "part_run_idx", "column_ids": [X.cid("part", "p_type")]},
]


def _shop(spark, d, names: list[str]) -> tuple[Store, str]:
    store = Store(spark, scratch.folder(spark, "store"))
    tables = X.tables(spark, d)
    return store, store.import_project("shop", {n: tables[n] for n in names}, X.base(spark, d))


def _merged_shop(spark, d) -> tuple[Store, str]:
    store, main = _shop(spark, d, ["part"])
    branch = store.create_branch(main, "prices")
    store.apply(branch, RUN_EDITS)
    store.merge(branch, main)
    return store, main


def run_plan(spark, d):
    """A table of the target after a branch was merged into it."""
    store, main = _merged_shop(spark, d)
    return store.table(main, "part")


def run_steps(spark, d):
    """The steps of that merge's run."""
    store, _ = _merged_shop(spark, d)
    (run,) = store.state()["runs"].values()
    return local_frame(spark, [(s["seq"], s["kind"], s["status"], run["status"], run["mode"]) for s in run["steps"]], "seq int, kind string, status string, run_status string, mode string")


def branch_lifecycle(spark, d):
    """A project's branches as they are made, edited, deleted and made again; rows of a branch's sampled tables."""
    names = ["region", "nation", "customer", "supplier"]
    store, main = _shop(spark, d, names)
    out = []

    def note(what: str) -> None:
        out.append((len(out), what, ",".join(f"{b['name']}:{b['status']}" for b in store.list_branches()), store.health()["branches"]))

    note("import")
    one = store.create_branch(main, "one", 100)
    note("create")
    store.apply(one, [{"op": "DROP_COLUMN", **X._of("customer", "c_mktsegment")}])
    out += [(len(out) + i, f"rows of {n}", store.list_projects()[0]["name"], store.table(one, n).count()) for i, n in enumerate(names)]
    try:
        store.create_branch(main, "one")
    except Conflict:
        note("name taken")
    store.delete_branch(one)
    note("delete")
    store.create_branch(main, "one")
    note("create again")
    return local_frame(spark, out, "n int, event string, live string, n_rows long")


def drift_refresh(spark, d):
    """H8, H9: a branch's status and number of commits as its live schema is edited by hand and recorded."""
    store, main = _shop(spark, d, ["region"])
    branch, out = store.create_branch(main, "live"), []
    live = ops.apply_all(X.base(spark, d), X.DRIFT)[0]

    def note(what: str, answer: bool) -> None:
        out.append((what, answer, store.state()["branches"][branch]["status"], len(store.history(branch))))

    note("as recorded", store.drifted(branch, X.base(spark, d)))
    note("edited", store.drifted(branch, live))
    note("refresh", store.refresh(branch, live))
    note("refresh again", store.refresh(branch, live))
    return local_frame(spark, out, "event string, answer boolean, status string, commits int")


def snapshot_roundtrip(spark, d):
    """The content hash and columns of a snapshot that was stored and loaded."""
    store, main = _shop(spark, d, ["region"])
    loaded = store.head(main)
    return hashing.snapshot_hash(loaded).withColumn("columns", F.lit(loaded.columns.count()).cast("long"))


def base_fallback(spark, d):
    """The snapshot that a merge starts from: the common ancestor's, else that of the branch's first commit, else none."""
    rows = [(a, b, f, dag.base_snapshot(commits(spark), a, b, f)) for a, b, f in FALLBACKS]
    return local_frame(spark, rows, "a string, b string, fallback string, snapshot_id string")


def latency_percentiles(spark, d):
    """K5: the value at place min(n - 1, floor(n * p)) of the sorted prices, by priority."""
    return backfill.percentiles(spark.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", "o_totalprice", [0.5, 0.95, 0.99])


def demo_customers(spark, d):
    return demo.customers(spark, demo.n_customers(100_000)).select("id", "email", "full_name")


def demo_products(spark, d):
    return demo.products(spark).select("id", "sku", "name", "price_cents")


def demo_orders(spark, d):
    return demo.orders(spark, 20_000).groupBy("status").agg(F.count("*").alias("orders"), F.count("notes").alias("noted"), F.sum("customer_id").alias("customers"), F.sum(F.col("amount").cast("long")).alias("amount"))


def edit_to_ops(spark, d):
    before = {"column_id": "c", "name": "a", "type": "text", "nullable": True, "default_expr": None}
    found = ops.edit_to_ops("t", before, before | {"name": "b", "nullable": False})
    return local_frame(spark, [(i, o["op"]) for i, o in enumerate(found)], "n int, op string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        type_canonicalize, type_render, default_canonicalize, introspect_tables, introspect_columns, introspect_constraints, introspect_indexes, introspect_unmanaged, identity_carry_forward, snapshot_hash,
        constraint_fingerprint, index_fingerprint, object_count, schema_view, schema_search, table_stats, database_url_parse, identifier_validation, identifier_quote, op_sequence, op_drop_table, diff_columns,
        diff_tables, diff_indexes, diff_constraints, diff_destructive, diff_describe, diff_empty, branch_diff, drift_check, commit_ancestors, merge_base, merge_attribute, merge_columns, merge_tables, merge_changed_tables, merge_indexes,
        merge_constraints, merge_conflicts, merge_name_collisions, merge_resolved, merge_resolved_indexes, merge_can_apply, merge_target, classify_default, classify_type_change, classify_change, plan_steps, plan_drops, plan_mode, plan_warnings,
        plan_key_column, render_create_table, render_foreign_key, render_index, table_topo_order, materialise_script, statement_split, merge_preview, preflight_candidates, preflight_uncastable, preflight_nulls,
        preflight_blockers, orphan_check, identity_next_value, keyset_page, backfill_batch_stats, backfill_result, backfill_failures, batch_adaptation, backfill_progress, backoff_ceiling, list_branches,
        commit_history, commit_next_seq, head_snapshot, snapshot_dedupe, run_status, run_plan, run_steps, branch_lifecycle, drift_refresh, snapshot_roundtrip, base_fallback, latency_percentiles, demo_customers, demo_products, demo_orders, edit_to_ops,
    ]
    out = {f.__name__: f for f in named}
    out |= {"op_rename_column": _op(_O[:1]), "op_change_type": _op(_O[1:2]), "op_drop_column": _op(_O[2:4]), "op_add_column": _op(_T[4:7]), "op_set_nullable": _op(_T[11:12]), "op_set_default": _op(_O[8:9]), "op_create_table": _op(_T[14:15])}
    out |= {"op_add_index": _indexes_after(_O[6:8]), "op_drop_index": _indexes_after(_T[10:11])}
    out |= {f"branch_sample_{n}": _sampled(n) for n in ("customer", "supplier", "orders", "lineitem")}
    out |= {"plan_online_retype": _group("orders.o_totalprice"), "plan_online_add": _group("orders.public_id"), "plan_online_not_null": _group("orders.o_custkey")}
    return out
