"""The engine's operators on golden rows, and its queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lakebranch import fixtures as X
from lakebranch import oracle, queries
from lakebranch.functions import hashing, identifiers, types
from lakebranch.operators import backfill, dag, diff, merge, ops, preflight, sample
from lakebranch.plans import planner, render
from lakebranch.snapshot import Snapshot, local_frame
from lakebranch.sources import introspect

CHEAP = "type_canonicalize type_render default_canonicalize identifier_validation identifier_quote merge_attribute classify_default classify_type_change preflight_uncastable preflight_nulls orphan_check branch_sample_orders identity_next_value keyset_page backfill_batch_stats backfill_result backfill_failures batch_adaptation backoff_ceiling commit_history latency_percentiles table_stats".split()


def plain(rows, names):
    return sorted(repr([None if r[n] is None else float(r[n]) if isinstance(r[n], (int, float)) and not isinstance(r[n], bool) else str(r[n]) for n in names]) for r in rows)


@pytest.mark.parametrize("name", CHEAP)
def test_query_agrees_with_sql(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = [r.asDict() for r in queries.queries()[name](spark, folder).collect()]
    rel = con.sql(oracle.oracle_sql()[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert plain(got, sorted(rel.columns)) == plain(want, sorted(rel.columns))


@pytest.fixture(scope="module")
def sides(spark, folder):
    return X.three(spark, folder)


def kinds(m):
    return sorted((r.type, r.stable_id) for r in m.conflicts.collect())


def test_hash_is_blind_to_ids_and_positions(spark, sides):
    base = sides[0]
    other = base.with_(columns=base.columns.withColumn("position", F.col("position") + 7))
    assert hashing.snapshot_hash(base).first() == hashing.snapshot_hash(other).first()
    assert hashing.snapshot_hash(base).first() != hashing.snapshot_hash(sides[1]).first()


def test_diff_composes_and_is_empty_on_itself(spark, sides):
    base = sides[0]
    of = {"table_id": X.tid("orders"), "column_id": X.cid("orders", "o_totalprice")}
    edited, sql = ops.apply_all(base, [{"op": "RENAME_COLUMN", **of, "new_name": "total"}, {"op": "CHANGE_COLUMN_TYPE", **of, "new_type": "decimal(14,2)"}])
    assert sorted(r.kind for r in diff.diff(base, edited).collect()) == ["COLUMN_RENAMED", "COLUMN_TYPE_CHANGED"]
    assert sql[1].endswith('TYPE numeric(14,2) USING "total"::numeric(14,2)')
    assert diff.is_empty(base, base)


def test_merge_algebra(spark, sides):
    base, ours, theirs = sides
    h = lambda s: hashing.snapshot_hash(s).first().hash
    assert h(merge.merge(base, ours, base).merged) == h(ours)
    assert h(merge.merge(base, base, theirs).merged) == h(theirs)
    assert h(merge.merge(base, ours, ours).merged) == h(ours)
    one, two = merge.merge(base, ours, theirs), merge.merge(base, theirs, ours)
    disputed = lambda m: {k for k in kinds(m) if k[0] in ("BOTH_RENAMED", "BOTH_MODIFIED", "MODIFIED_AND_DROPPED")}
    assert disputed(one) == disputed(two) and one.has_destructive() and not one.is_clean()
    assert ("DUPLICATE_INTENT", "idx_their_type") in kinds(one) and ("INDEX_NAME_COLLISION", "idx_their_clash") in kinds(one)
    assert all(r.question for r in one.conflicts.collect())


def test_strict_merge_keeps_a_dropped_index(spark, sides):
    dropped = X.sid("idx", "orders", "orders_customer_idx")
    has = lambda strict: not merge.merge(*sides, strict=strict).merged.indexes.filter(F.col("index_id") == dropped).isEmpty()
    assert has(True) and not has(False)


def test_operations_refuse_what_they_must(spark, sides):
    base = sides[0]
    for op, error in (
        ({"op": "DROP_TABLE", "table_id": X.tid("customer")}, ops.InvalidOperation),
        ({"op": "ADD_COLUMN", "table_id": X.tid("orders"), "name": "select", "type": "text"}, identifiers.InvalidIdentifier),
        ({"op": "ADD_COLUMN", "table_id": X.tid("orders"), "name": "o_custkey", "type": "text"}, ops.InvalidOperation),
        ({"op": "DROP_INDEX", "table_id": X.tid("customer"), "index_id": X.sid("idx", "customer", "customer_pkey")}, ops.InvalidOperation),
        ({"op": "CREATE_TABLE", "name": "t", "columns": []}, ops.InvalidOperation),
    ):
        with pytest.raises(error):
            ops.apply_all(base, [op])


def test_online_retype_takes_nine_steps(spark, sides):
    base = sides[0]
    required, _ = ops.apply_all(base, [{"op": "SET_COLUMN_NULLABLE", "table_id": X.tid("orders"), "column_id": X.cid("orders", "o_totalprice"), "nullable": False}])
    after, _ = ops.apply_all(required, [{"op": "CHANGE_COLUMN_TYPE", "table_id": X.tid("orders"), "column_id": X.cid("orders", "o_totalprice"), "new_type": "numeric(14,2)"}])
    counts = local_frame(spark, [("orders", 200_000)], "table_name string, rows long")
    p = planner.plan(required, after, counts)
    steps = p.steps.collect()
    assert [s.kind for s in steps] == ["DDL", "DDL", "DDL", "BACKFILL", "DDL", "VALIDATE", "DDL", "DDL", "ANALYZE"]
    assert p.mode().first().mode == "ONLINE" and [s.seq for s in steps if s.point_of_no_return] == [7]
    assert planner.plan(required, after, local_frame(spark, [("orders", 500)], "table_name string, rows long")).mode().first().mode == "ATOMIC"


def test_merge_base_of_a_criss_cross(spark):
    c = queries.commits(spark)
    assert dag.merge_base(c, "c6", "c7").first().commit_id == "c4"
    assert dag.merge_base(c, "c6", "d1").isEmpty()
    assert dag.base_snapshot(c, "c6", "d1", "c2") == "s_c2"


def test_order_and_rendering(spark, sides):
    assert render.statements("A;\nB") == ["A", "B"]
    bare = spark.range(1).select(render.bare(F.lit("((a) or (b))")).alias("x"), render.bare(F.lit("(a) or (b)")).alias("y")).first()
    assert tuple(bare) == ("(a) or (b)", "(a) or (b)")
    names = {r.table_id: r.name for r in sides[0].tables.collect()}
    assert [names[t] for t in render.table_order(sides[0])] == ["part", "region", "nation", "supplier", "customer", "events", "orders", "lineitem"]


def test_castable_modes(spark):
    rows = local_frame(spark, [("1.5",), (" 7 ",), ("x",), (None,)], "v string")
    count = lambda kind, **k: preflight.failing(rows, [("v", "CAST", kind)], **k).first().failing
    assert count("integer") == 2 and count("integer", via_text=False) == 1 and count("varchar(1)") == 0 and count("numeric(3,1)") == 1


def test_ranked_needs_no_global_sort(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r["rank"] for r in backfill.ranked(rows, "k").collect())


def test_types_and_ids(spark):
    t = spark.range(1).select(types.type_sql(types.parse_type(F.lit("Timestamp (3) with time zone"))).alias("t")).first().t
    assert t == "timestamptz(3)" and len(identifiers.mint("table")) == 20
    assert len({identifiers.mint("column") for _ in range(100)}) == 100 and identifiers.mint("table", 1) < identifiers.mint("table", 2)


def test_catalog_and_files(spark, folder):
    assert introspect.schema_exists(spark, "default") and not introspect.schema_exists(spark, "nowhere")
    sizes = {r.table_name: (r.bytes, r.pretty) for r in introspect.table_bytes(spark, folder, ["region", "lineitem"]).collect()}
    assert all(n == os.path.getsize(f"{folder}/{t}.parquet") for t, (n, _) in sizes.items())
    assert sizes["region"][1].endswith(("bytes", "kB")) and sizes["lineitem"][1].endswith(("kB", "MB"))


def test_samples_of_no_rows(spark, folder):
    t = {n: df for n, df in X.tables(spark, folder).items() if n in ("region", "nation")}
    for limit in (0, -1):
        got = sample.sample(t, ["region", "nation"], {}, [("nation", ["n_regionkey"], "region", ["r_regionkey"])], limit)
        assert all(df.count() == 0 and df.columns == t[n].columns for n, df in got.items())


def test_script_makes_parents_first(spark, sides):
    rows = sorted(render.materialise(sides[0], "main").collect(), key=lambda r: (r.phase, r.ord))
    made = [r.name for r in rows if r.phase == 0]
    assert made == ["part", "region", "nation", "supplier", "customer", "events", "orders", "lineitem"] and [r.phase for r in rows] == sorted(r.phase for r in rows)


def test_percentiles_by_brute_force(spark):
    rows = [("a", float(i * 7 % 13)) for i in range(40)] + [("b", 5.0)] * 9 + [(None, float(i)) for i in range(3)] + [("c", None)]
    got = {r.g: (r.p50, r.p99) for r in backfill.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.5, 0.99], 8).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == tuple(v[min(len(v) - 1, int(len(v) * p))] for p in (0.5, 0.99))
    assert set(got) == {"a", "b", None} and backfill.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0


def test_castable_numbers_and_booleans(spark):
    values = ["1e25", "12345678901234567890123", "tr", "fal", "of", "o", "1e200000", "NaN", "infinity", "-.5", "1.", "."]
    rows = local_frame(spark, [(v,) for v in values], "v string")
    fine = lambda kind: {r.v for r in rows.filter(preflight.castable(F.col("v"), kind)).collect()}
    assert fine("numeric") == {"1e25", "12345678901234567890123", "NaN", "infinity", "-.5", "1."}
    assert fine("numeric(50,2)") == {"1e25", "12345678901234567890123", "NaN", "-.5", "1."} and fine("numeric(40,30)") == {"NaN", "-.5", "1."}
    assert fine("boolean") == {"tr", "fal", "of"}


def edited(s, spark, change):
    rows = s.rows()
    change(rows)
    return Snapshot.of(spark, **{n: [tuple(r.values()) for r in found] for n, found in rows.items()})


def test_tables_of_a_merge_can_be_settled(spark, folder, sides):
    base = sides[0]
    region, part, events = X.tid("region"), X.tid("part"), X.tid("events")

    def rename(name):
        return lambda rows: [t.update(name=name) for t in rows["tables"] if t["table_id"] == region]

    ours = edited(ops.apply_all(base, [{"op": "DROP_TABLE", "table_id": events}, {"op": "RENAME_COLUMN", "table_id": part, "column_id": X.cid("part", "p_name"), "new_name": "label"}])[0], spark, rename("area"))
    drop = {"tables": "table_id", "columns": "table_id", "constraints": "table_id", "indexes": "table_id"}
    theirs = ops.apply_all(base, [{"op": "RENAME_COLUMN", "table_id": events, "column_id": X.cid("events", "ts"), "new_name": "at"}])[0]
    theirs = edited(theirs, spark, lambda rows: (rename("zone")(rows), [rows.update({n: [r for r in rows[n] if r[k] != part]}) for n, k in drop.items()], rows.update(constraints=[k for k in rows["constraints"] if not (k["ref"] and k["ref"]["table_id"] == part)])))
    m = merge.merge(base, ours, theirs)
    found = {(r.type, r.stable_id) for r in m.unresolved().collect()}
    assert {("TABLE_MODIFIED_AND_DROPPED", events), ("TABLE_MODIFIED_AND_DROPPED", part), ("BOTH_RENAMED", region)} <= found
    for choice, there, name in (("OURS", {"part"}, "area"), ("THEIRS", {"events"}, "zone")):
        keys = local_frame(spark, [(i, choice) for _, i in found], "key string, choice string")
        s = merge.resolved(m, theirs, keys, ours=ours).local()
        names = {t.name for t in s.tables.collect()}
        assert names & {"part", "events", "area", "zone", "region"} == there | {name}
        owners = {t.table_id for t in s.tables.collect()}
        assert all({r.table_id for r in getattr(s, n).collect()} <= owners for n in ("columns", "constraints", "indexes"))
        assert merge.can_apply(m.conflicts, keys, 0, 1)
