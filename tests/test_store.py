"""Branches, commits, merges and resumable fills in files."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakebranch import fixtures as X
from lakebranch.operators import ops
from lakebranch.snapshot import local_frame
from lakebranch.store import Conflict, Store
from lakebranch.streaming import resumable


@pytest.fixture(scope="module")
def shop(spark, folder, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    return store, store.import_project("shop", X.tables(spark, folder), X.base(spark, folder))


def test_branch_edit_merge(spark, shop):
    store, main = shop
    rows = store.table(main, "orders").count()
    branch = store.create_branch(main, "feature")
    with pytest.raises(Conflict):
        store.create_branch(main, "feature")
    of = {"table_id": X.tid("orders"), "column_id": X.cid("orders", "o_totalprice")}
    add = {"op": "ADD_COLUMN", "table_id": X.tid("orders"), "name": "currency", "type": "varchar(3)", "nullable": False, "default_expr": "'USD'"}
    store.apply(branch, [{"op": "RENAME_COLUMN", **of, "new_name": "amount"}, add])
    with pytest.raises(ops.InvalidOperation):
        store.apply(main, [add])
    mine = store.table(branch, "orders")
    assert "amount" in mine.columns and mine.filter("currency = 'USD'").count() == rows
    assert "o_totalprice" in store.table(main, "orders").columns
    store.merge(branch, main)
    assert {"amount", "currency"} <= set(store.table(main, "orders").columns) and store.table(main, "orders").count() == rows
    assert [h["seq"] for h in store.history(main)] == [3, 1] and store.history(main)[0]["second_parent_id"] is not None
    assert [b["name"] for b in store.list_branches()][0] == "main"


def test_sampled_branch_keeps_foreign_keys(spark, shop):
    store, main = shop
    branch = store.create_branch(main, "small", rows=50)
    orders, customers = store.table(branch, "orders"), store.table(branch, "customer")
    assert customers.count() == 50 and 0 < orders.count() <= 50
    assert orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti").count() == 0
    store.delete_branch(branch)
    assert "small" not in [b["name"] for b in store.list_branches()]
    with pytest.raises(ops.InvalidOperation):
        store.delete_branch(main)


def test_open_conflicts_stop_a_merge(spark, shop, folder):
    store, main = shop
    one, two = store.create_branch(main, "one"), store.create_branch(main, "two")
    of = {"op": "RENAME_COLUMN", "table_id": X.tid("part"), "column_id": X.cid("part", "p_name")}
    store.apply(one, [of | {"new_name": "title"}])
    store.apply(two, [of | {"new_name": "label"}])
    store.merge(one, main)
    with pytest.raises(ops.InvalidOperation):
        store.merge(two, main)
    store.merge(two, main, local_frame(spark, [(X.cid("part", "p_name"), "THEIRS")], "key string, choice string"))
    assert "label" in store.table(main, "part").columns
    live = X.base(spark, folder)
    assert store.drifted(main, live) and store.refresh(main, live) and not store.refresh(main, live)


def test_merge_runs_its_plan(spark, folder, tmp_path):
    tables = X.tables(spark, folder)
    few = tables["part"].limit(20)
    even = F.col("p_partkey") % 2 == 0
    part = few.withColumns({"p_name": F.when(even, F.col("p_partkey").cast("string")).otherwise("n/a"), "p_brand": F.when(even, "B" * 9), "p_type": F.lit("7")}).cache()
    store = Store(spark, f"file://{tmp_path}")
    main = store.import_project("parts", tables | {"part": part, "orders": tables["orders"].limit(30), "lineitem": tables["lineitem"].limit(1)}, X.base(spark, folder))
    of = lambda column: {"table_id": X.tid("part"), "column_id": X.cid("part", column)}
    before = store.history(main)

    bad = store.create_branch(main, "bad")
    store.apply(bad, [{"op": "CHANGE_COLUMN_TYPE", **of("p_name"), "new_type": "integer"}, {"op": "SET_COLUMN_DEFAULT", **of("p_brand"), "default_expr": None}, {"op": "SET_COLUMN_NULLABLE", **of("p_brand"), "nullable": False}])
    blockers = store.prepare(bad, main)["blockers"]
    assert len(blockers) == 2 and any("p_name can't be read as integer" in b for b in blockers) and any("p_brand hold NULL" in b for b in blockers)
    with pytest.raises(ops.InvalidOperation, match="p_name can't be read as integer"):
        store.merge(bad, main)
    none = store.create_branch(main, "none")
    store.apply(none, [{"op": "ADD_COLUMN", "table_id": X.tid("part"), "name": "must", "type": "text", "nullable": False, "default_expr": None}])
    with pytest.raises(Exception, match="must not be NULL"):
        store.merge(none, main)
    assert store.history(main) == before and Counter(store.table(main, "part").collect()) == Counter(part.collect())

    good = store.create_branch(main, "good")
    edits = [{"op": "CHANGE_COLUMN_TYPE", **of("p_type"), "new_type": "integer"}, {"op": "CHANGE_COLUMN_TYPE", **of("p_brand"), "new_type": "varchar(3)"}, {"op": "SET_COLUMN_DEFAULT", **of("p_brand"), "default_expr": "'new'"}]
    store.apply(good, [*edits, {"op": "SET_COLUMN_NULLABLE", **of("p_brand"), "nullable": False}, {"op": "ADD_COLUMN", "table_id": X.tid("part"), "name": "token", "type": "uuid", "nullable": False, "default_expr": "gen_random_uuid()"}])
    store.merge(good, main)
    rows = store.table(main, "part").collect()
    assert Counter((r.p_partkey, r.p_brand, r.p_type) for r in rows) == Counter((r.p_partkey, "BBB" if r.p_partkey % 2 == 0 else "new", 7) for r in part.collect())
    assert len({r.token for r in rows}) == 20 and Counter(rows) == Counter(store.table(main, "part").collect())
    path, _ = store.state()["branches"][main]["data"][X.tid("part")]
    written = spark.read.parquet(path)
    assert dict(written.dtypes)[X.cid("part", "p_type")] == "int" and written.filter(F.col(X.cid("part", "p_brand")).isNull()).count() == 0
    assert sorted(r["status"] for r in store.state()["runs"].values()) == ["FAILED", "SUCCEEDED"]


def test_fill_resumes(spark, folder, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_totalprice")
    rows.repartition(3).write.parquet(source)
    value = F.round("o_totalprice").cast("long")
    resumable.fill(spark, source, out, checkpoint, "cents", value, 1)
    resumable.fill(spark, source, out, checkpoint, "cents", value, 1)
    assert resumable.filled(spark, out).count() == rows.count() and resumable.progress(spark, out).count() == 3
