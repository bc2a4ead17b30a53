"""Projects, branches, commits and table versions in a folder.

A manifest is a numbered JSON file that is never changed. A change reads the newest one, and creates the next; creating fails if
another writer was first, and the change is then tried again on what that writer left, so a branch's head never moves past one that
the caller hasn't seen. That needs a file system that refuses to rename onto a file that is there, as HDFS does; on local disks the
file is linked to its name instead. Snapshots are files of their own, called after their content; a manifest holds their names. Data are immutable Parquet versions whose columns are called by their stable ids: a rename, a drop or a new
default is a change of the manifest alone, and a reader gives columns the names, types and defaults that the branch's head has.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakebranch.functions.hashing import snapshot_hash
from lakebranch.operators import backfill, dag, merge, ops, preflight, sample
from lakebranch.plans import classify, planner, render
from lakebranch.snapshot import Snapshot, local_frame, localised

ATTEMPTS = 25
#: The states of a branch, of a run and of a run's steps.
STATUSES = ("CREATING", "ACTIVE", "DRIFTED", "MERGED", "ABANDONED")
RUN_STATUSES = ("RUNNING", "SUCCEEDED", "FAILED")
STEP_STATUSES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED", "SKIPPED")
_SPARK = {"smallint": "smallint", "integer": "int", "bigint": "bigint", "real": "float", "double precision": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary"}


# Functions of defaults that Spark calls otherwise.
_CALLS = {"gen_random_uuid()": "uuid()", "uuid_generate_v4()": "uuid()", "clock_timestamp()": "now()"}


class Conflict(RuntimeError):
    """Another writer was first, or the head isn't what the caller saw."""


def status(value: str, domain: tuple[str, ...] = STATUSES) -> str:
    """The value, which must be one of the domain's."""
    if value not in domain:
        raise ValueError(f"{value!r} is none of {', '.join(domain)}")
    return value


def spark_type(sql: str) -> str:
    base, _, rest = sql.partition("(")
    return f"decimal({rest[:-1]})" if base == "numeric" and rest else "decimal(38,18)" if base == "numeric" else _SPARK.get(base, "string")


def default(expression: str | None) -> Column:
    return F.lit(None) if expression is None else F.expr(_CALLS.get(expression.strip().lower(), expression))


def converted(value: Column, type_sql: str) -> Column:
    """The value by way of its text, as preflight.castable judges it; NULL where it can't be converted."""
    base, _, rest = type_sql.partition("(")
    text = value.cast("string")
    if base == "boolean":
        word = F.lower(F.trim(text))
        return F.when(word.isin(*preflight.TRUE), True).when(word.isin(*preflight.FALSE), False)
    if base in ("varchar", "char") and rest:
        return F.substring(text, 1, int(rest[:-1]))
    return text.try_cast(spark_type(type_sql))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def state(self) -> dict:
        """The newest manifest."""
        folder = self.path(f"{self.root}/manifests")
        found = self.files.listStatus(folder) if self.files.exists(folder) else []
        names = sorted(f.getPath().getName() for f in found if f.getPath().getName().endswith(".json"))
        if not names:
            return {"version": 0, "projects": {}, "branches": {}, "commits": {}, "runs": {}}
        return self._read(f"manifests/{names[-1]}")

    def _read(self, name: str) -> dict:
        stream = self.files.open(self.path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _create(self, name: str, content: dict) -> bool:
        """Writes a file whole under a name that no file has yet; False where one has."""
        done, draft = (self.path(f"{self.root}/{n}") for n in (name, f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"))
        stream = self.files.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if self.files.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), done.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self.files.delete(draft, False)
        if not self.files.exists(done) and self.files.rename(draft, done):
            return True
        self.files.delete(draft, False)
        return False

    def change(self, edit: Callable[[dict], object]) -> object:
        """Applies edit to the newest manifest and writes the next, again if another writer was first."""
        for _ in range(ATTEMPTS):
            state = self.state()
            out = edit(state)
            state["version"] += 1
            for b in state["branches"].values():
                status(b["status"])
            if self._create(f"manifests/{state['version']:012d}.json", state):
                return out
        raise Conflict(f"{ATTEMPTS} other writers were first")

    # snapshots and commits

    def _save(self, state: dict, s: Snapshot) -> str:
        """The id of the snapshot, stored once for equal content and equal ids."""
        rows = s.rows()
        ids = sorted([*(t["table_id"] for t in rows["tables"]), *(c["column_id"] for c in rows["columns"])])
        key = f"{snapshot_hash(s).first().hash[:32]}-{uuid.uuid5(uuid.NAMESPACE_OID, ','.join(ids)).hex[:8]}"
        if not self.files.exists(self.path(f"{self.root}/snapshots/{key}.json")):
            self._create(f"snapshots/{key}.json", rows)
        return key

    def snapshot(self, key: str | None, state: dict | None = None) -> Snapshot:
        """J2; an empty one for None."""
        rows = self._read(f"snapshots/{key}.json") if key else {}
        return Snapshot.of(self.spark, **{n: [tuple(r.values()) for r in found] for n, found in rows.items()})

    def _commit(self, state: dict, branch: str, s: Snapshot, message: str, author: str, second: str | None = None, log: list[dict] = ()) -> str:
        """Seq counts in the project, and the branch's head moves."""
        b = state["branches"][branch]
        mine = [c for c in state["commits"].values() if c["project_id"] == b["project_id"]]
        key = uuid.uuid4().hex
        state["commits"][key] = {
            "commit_id": key, "project_id": b["project_id"], "branch_id": branch, "parent_id": b["head_commit_id"], "second_parent_id": second, "snapshot_id": self._save(state, s),
            "message": message, "author": author, "seq": max((c["seq"] for c in mine), default=0) + 1, "created_at": time.time(), "ops": list(log),
        }
        b["head_commit_id"] = key
        return key

    def commits(self, state: dict | None = None) -> DataFrame:
        names = "commit_id project_id branch_id parent_id second_parent_id snapshot_id message author".split()
        rows = [(*(c[n] for n in names), c["seq"]) for c in (state or self.state())["commits"].values()]
        return local_frame(self.spark, rows, ", ".join(f"{n} string" for n in names) + ", seq long")

    def history(self, branch: str) -> list[dict]:
        """The branch's commits, newest first, with their operations."""
        return sorted((c for c in self.state()["commits"].values() if c["branch_id"] == branch), key=lambda c: -c["seq"])

    def head(self, branch: str, state: dict | None = None) -> Snapshot:
        """J8"""
        state = state or self.state()
        return self.snapshot(state["commits"][state["branches"][branch]["head_commit_id"]]["snapshot_id"], state)

    # projects and branches

    def list_projects(self) -> list[dict]:
        """By name."""
        return sorted(self.state()["projects"].values(), key=lambda p: p["name"])

    def find_project(self, name: str) -> dict | None:
        """J3"""
        return next((p for p in self.list_projects() if p["name"] == name), None)

    def health(self) -> dict:
        """The manifest's number and how many branches there are."""
        state = self.state()
        return {"version": state["version"], "branches": len(state["branches"])}

    def import_project(self, name: str, tables: dict[str, DataFrame], s: Snapshot) -> str:
        """H6: a project with branch main, a first commit, and each table written under its columns' ids; gives the branch's id."""
        branch, data = uuid.uuid4().hex, self._write(tables, s)

        def edit(state: dict) -> str:
            project = uuid.uuid4().hex
            state["projects"][project] = {"project_id": project, "name": name}
            state["branches"][branch] = {"branch_id": branch, "project_id": project, "name": "main", "head_commit_id": None, "parent_branch_id": None, "base_commit_id": None, "status": "ACTIVE", "created_at": time.time(), "data": data}
            self._commit(state, branch, s, "Import", "import")
            return branch

        return self.change(edit)

    def _write(self, tables: dict[str, DataFrame], s: Snapshot) -> dict:
        """A new version of each table; {table_id: [path, {column_id: stored type}]}."""
        names = {t.name: t.table_id for t in s.tables.collect()}
        columns = s.typed_columns().collect()
        out = {}
        for name, df in tables.items():
            mine = [c for c in columns if c.table_id == names[name]]
            path = f"{self.root}/data/{names[name]}/{uuid.uuid4().hex}"
            df.select(*[F.col(c.name).alias(c.column_id) for c in mine]).write.parquet(path)
            out[names[name]] = [path, [c.column_id for c in mine]]
        return out

    def create_branch(self, parent: str, name: str, rows: int = 0) -> str:
        """H1, H5: a branch at the parent's head. Its tables are the parent's versions; with rows, samples in which foreign keys hold."""
        from lakebranch.functions.identifiers import check_name

        check_name("branch", name)
        state = self.state()
        s, data = self.head(parent, state), state["branches"][parent]["data"]
        if rows > 0:
            found = s.rows()
            table = {t["table_id"]: t["name"] for t in found["tables"]}
            named = {c["column_id"]: c["name"] for c in found["columns"]}
            refs = [(table[k["table_id"]], [named[c] for c in k["column_ids"]], table[k["ref"]["table_id"]], [named[c] for c in k["ref"]["column_ids"]]) for k in found["constraints"] if k["kind"] == "FOREIGN_KEY"]
            keys = {table[k["table_id"]]: [named[c] for c in k["column_ids"]] for k in found["constraints"] if k["kind"] == "PRIMARY_KEY"}
            order = [table[t] for t in render.table_order(s)]
            data = self._write(sample.sample({n: self.table(parent, n) for n in order}, order, keys, refs, rows), s)

        def edit(state: dict) -> str:
            p = state["branches"][parent]
            if any(b["name"] == name and b["status"] != "ABANDONED" and b["project_id"] == p["project_id"] for b in state["branches"].values()):
                raise Conflict(f"there is a branch called {name}")
            key = uuid.uuid4().hex
            state["branches"][key] = {"branch_id": key, "project_id": p["project_id"], "name": name, "head_commit_id": p["head_commit_id"], "parent_branch_id": parent, "base_commit_id": p["head_commit_id"], "status": "ACTIVE", "created_at": time.time(), "data": data}
            return key

        return self.change(edit)

    def delete_branch(self, branch: str) -> None:
        """H7: main stays; a branch with commits leaves a tombstone, and its name is free."""

        def edit(state: dict) -> None:
            if state["branches"][branch]["name"] == "main":
                raise ops.InvalidOperation("main can't be deleted")
            if any(c["branch_id"] == branch for c in state["commits"].values()):
                state["branches"][branch] |= {"status": "ABANDONED", "data": {}}
            else:
                del state["branches"][branch]

        self.change(edit)

    def list_branches(self) -> list[dict]:
        """Main first, then by age."""
        live = [b for b in self.state()["branches"].values() if b["status"] != "ABANDONED"]
        return sorted(live, key=lambda b: (b["name"] != "main", b["created_at"]))

    def table(self, branch: str, name: str) -> DataFrame:
        """A table as the branch's head has it. A column that came after the data were written gives its default for all rows."""
        state = self.state()
        s = self.head(branch, state)
        table_id = s.table_named(name).first().table_id
        path, stored = state["branches"][branch]["data"].get(table_id, [None, []])
        columns = s.typed_columns().filter(F.col("table_id") == table_id).orderBy("position").collect()
        schema = ", ".join(f"`{c.name}` {spark_type(c.type_sql)}" for c in columns)
        if path is None:
            return self.spark.createDataFrame([], schema)
        value = lambda c: F.col(c.column_id) if c.column_id in stored else default(c.default_expr)
        return self.spark.read.parquet(path).select(*[value(c).try_cast(spark_type(c.type_sql)).alias(c.name) for c in columns])

    # operations, drift, merge

    def apply(self, branch: str, operations: list[dict], author: str = "user", message: str | None = None) -> str:
        """Operations on a live branch as one commit."""

        def edit(state: dict) -> str:
            b = state["branches"][branch]
            if b["name"] == "main" or b["status"] != "ACTIVE":
                raise ops.InvalidOperation("only an active branch other than main can be edited")
            s, statements = ops.apply_all(self.head(branch, state), operations)
            b["data"] = b["data"] | self._with_volatile(branch, state, s)
            kinds = {o["op"] for o in operations}
            text = message or (operations[0]["op"] if len(kinds) == 1 and len(operations) == 1 else f"{len(operations)} schema changes")
            return self._commit(state, branch, s, text, author, log=[{"ordinal": i, "op": o["op"], "payload": o} for i, o in enumerate(operations)])

        return self.change(edit)

    def _with_volatile(self, branch: str, state: dict, s: Snapshot) -> dict:
        """new versions of tables that hold rows and get columns whose default differs by row, which must be worked out once."""
        before = self.head(branch, state)
        known = {c.column_id for c in before.columns.collect()}
        fresh = [c for c in s.columns.withColumn("volatile", classify.is_volatile(F.col("default_expr"))).collect() if c.volatile and c.column_id not in known]
        names, old = ({t.table_id: t.name for t in x.tables.collect()} for x in (s, before))
        out: dict = {}
        for t in {c.table_id for c in fresh} & set(state["branches"][branch]["data"]) & set(old):
            columns = s.typed_columns().filter(F.col("table_id") == t).orderBy("position").collect()
            had = {c.column_id: c.name for c in before.columns.collect()}
            rows = self.table(branch, old[t])
            values = [(F.col(f"`{had[c.column_id]}`") if c.column_id in had else default(c.default_expr)).try_cast(spark_type(c.type_sql)).alias(c.name) for c in columns]
            out |= self._write({names[t]: rows.select(*values)}, s)
        return out

    def drifted(self, branch: str, live: Snapshot) -> bool:
        """H8: whether the live schema differs from what is recorded; the branch's status follows."""
        differs = snapshot_hash(live).first() != snapshot_hash(self.head(branch)).first()
        self.change(lambda state: state["branches"][branch].update(status="DRIFTED" if differs else "ACTIVE"))
        return differs

    def refresh(self, branch: str, live: Snapshot, author: str = "user") -> bool:
        """H9: records the live schema as a commit unless it is what is recorded."""
        if not self.drifted(branch, live):
            return False
        self.change(lambda state: (self._commit(state, branch, live, "Refresh", author), state["branches"][branch].update(status="ACTIVE")))
        return True

    def prepare(self, source: str, target: str, resolutions: DataFrame | None = None, threshold: int = planner.THRESHOLD) -> dict:
        """Base, merge, plan and row counts of merging source into target, and the target's head they hold for."""
        state = self.state()
        heads = [state["branches"][b]["head_commit_id"] for b in (target, source)]
        base = self.snapshot(dag.base_snapshot(self.commits(state), *heads, state["branches"][source]["base_commit_id"]), state)
        ours, theirs = self.head(target, state), self.head(source, state)
        m = merge.merge(base, ours, theirs)
        m = merge.Merge(m.merged.local(), m.conflicts)
        keys = resolutions if resolutions is not None else local_frame(self.spark, [], "key string, choice string")
        final = merge.resolved(m, theirs, keys, ours=ours).local()
        tables = {t.name: self.table(target, t.name) for t in ours.tables.collect()}
        counts = local_frame(self.spark, [(n, df.count()) for n, df in tables.items()], "table_name string, rows long")
        plan = planner.plan(ours, final, counts, threshold=threshold)
        blockers = [r.message for r in preflight.blockers(preflight.preflight(tables, ours, final, counts)).collect()]
        return {"merge": m, "ours": ours, "final": final, "plan": planner.Plan(localised(plan.steps), localised(plan.warnings)), "blockers": blockers, "resolutions": keys, "head": heads[0], "source_head": heads[1]}

    def _migrated(self, target: str, ours: Snapshot, final: Snapshot) -> tuple[dict[str, DataFrame], set[str]]:
        """The target's tables as the merge leaves them, by table id, and the ids of columns whose stored values it changes: retyped
        ones, ones that must no longer be NULL, which their default fills, and new ones whose default differs by row or that have none
        but must not be NULL. Other changes are the manifest's alone. A value that can't be converted or filled stops the write."""
        old = {c.column_id: c for c in ours.typed_columns().collect()}
        names = {t.table_id: t.name for t in ours.tables.collect()}
        columns = final.typed_columns().withColumn("volatile", classify.is_volatile(F.col("default_expr"))).orderBy("position").collect()
        out, changed = {}, set()
        for t in final.tables.collect():
            mine = [c for c in columns if c.table_id == t.table_id]
            if t.table_id not in names:
                out[t.table_id] = self.spark.createDataFrame([], ", ".join(f"`{c.name}` {spark_type(c.type_sql)}" for c in mine))
                continue
            rows, values = self.table(target, names[t.table_id]), []
            for c in mine:
                was, where = old.get(c.column_id), f"{t.name}.{c.name}"
                value = default(c.default_expr).cast(spark_type(c.type_sql)) if was is None else rows[f"`{was.name}`"]
                if was is not None and was.type_sql != c.type_sql:
                    new = converted(value, c.type_sql)
                    value = F.when(value.isNotNull() & new.isNull(), F.raise_error(F.lit(f"{where} can't become {c.type_sql}"))).otherwise(new)
                    changed.add(c.column_id)
                if not c.nullable and (was is None or was.nullable):
                    value = F.coalesce(value, default(c.default_expr).cast(spark_type(c.type_sql)), F.raise_error(F.lit(f"{where} must not be NULL")))
                    if was is not None or c.default_expr is None:
                        changed.add(c.column_id)
                if was is None and c.volatile:
                    changed.add(c.column_id)
                values.append(value.alias(c.name))
            out[t.table_id] = rows.select(*values)
        return out, changed

    def _broken(self, tables: dict[str, DataFrame], changed: set[str], ours: Snapshot, final: Snapshot, only: str | None = None) -> list[str]:
        """Validation, of one table or all: keys, checks and unique indexes that are new, or hold changed columns, and that rows break."""
        before, after = ours.rows(), final.rows()
        named = {c["column_id"]: c["name"] for c in after["columns"]}
        was = {c["column_id"]: c["name"] for c in before["columns"]}
        known = [*before["constraints"], *before["indexes"]]
        out = []
        for k in [*after["constraints"], *(i for i in after["indexes"] if i["is_unique"])]:
            ids = k["column_ids"] if "kind" in k else [c["column_id"] for c in k["columns"]]
            if (k in known and not changed.intersection(ids)) or k["table_id"] not in tables or only not in (None, k["table_id"]):
                continue
            rows, keys = tables[k["table_id"]], [named[i] for i in ids]
            kind = k.get("kind", "UNIQUE")
            if kind == "FOREIGN_KEY":
                bad = preflight.orphans(rows, tables[k["ref"]["table_id"]], list(zip(keys, [named[i] for i in k["ref"]["column_ids"]], strict=True))).first().orphans
            else:
                # checks and predicates may call columns as they were called before the merge
                mine = [c["column_id"] for c in after["columns"] if c["table_id"] == k["table_id"]]
                rows = rows.withColumns({was[i]: F.col(f"`{named[i]}`") for i in mine if i in was and was[i] not in rows.columns})
                if kind == "CHECK":
                    bad = rows.filter(~F.expr(k["expression"])).count()
                else:
                    rows = rows.filter(k["predicate"]) if k.get("predicate") else rows
                    bad = sum(rows.filter(F.col(f"`{c}`").isNull()).count() for c in keys) if kind == "PRIMARY_KEY" else 0
                    bad += rows.select(*[F.col(f"`{c}`") for c in keys]).dropna().groupBy(*[F.col(f"`{c}`") for c in keys]).count().filter("count > 1").count()
            if bad:
                out.append(f"{k['name']} would be broken: {bad} row(s) or key(s)")
        return out

    def merge(self, source: str, target: str, resolutions: DataFrame | None = None, author: str = "user") -> str:
        """Merges, or raises where conflicts are open, rows block the merge or the target's head has moved; gives the new commit.
        All or nothing: versions of changed tables are written first, then one manifest moves the head and points at them."""
        p = self.prepare(source, target, resolutions)
        if not merge.can_apply(p["merge"].conflicts, p["resolutions"], len(p["blockers"]), p["plan"].steps.count()):
            raise ops.InvalidOperation(" ".join(p["blockers"]) or "conflicts are open, or there is nothing to do")
        steps = [{"seq": r.seq, "op_group": r.op_group, "kind": r.kind, "verdict": r.verdict, "status": "PENDING", "error": None} for r in p["plan"].steps.collect()]
        run = {"run_id": uuid.uuid4().hex, "mode": p["plan"].mode().first().mode, "status": "RUNNING", "steps": steps}
        self.change(lambda state: state["runs"].update({run["run_id"]: run}))
        data: dict = {}
        try:
            self._execute(run, p, target, data)
            run["rewrites"] = sorted(data)

            def edit(state: dict) -> str:
                if state["branches"][target]["head_commit_id"] != p["head"]:
                    raise Conflict("the target's head has moved")
                key = self._commit(state, target, p["final"], f"Merge {state['branches'][source]['name']}", author, p["source_head"])
                state["branches"][target]["data"] |= data
                state["branches"][source]["status"] = "MERGED"
                state["runs"][run["run_id"]] = run | {"status": status("SUCCEEDED", RUN_STATUSES), "commit_id": key}
                return key

            return self.change(edit)
        except Exception as e:
            for path, _ in data.values():
                self.files.delete(self.path(path), True)
            failed = run | {"status": status("FAILED", RUN_STATUSES), "error": self._short(e)}
            self.change(lambda state: state["runs"].update({run["run_id"]: failed}))
            raise

    def _short(self, e: Exception) -> str:
        return local_frame(self.spark, [(str(e),)], "error string").select(backfill.truncated(F.col("error")).alias("error")).first().error

    def _execute(self, run: dict, p: dict, target: str, data: dict) -> None:
        """The run's steps in order. The first of a table whose stored values change writes its new version; steps that
        validate, and indexes, hold the new rows against the table's keys; what is left is the manifest's alone. A step that fails leaves those after it
        skipped, and stops the run."""
        final = p["final"]
        tables, changed = self._migrated(target, p["ours"], final)
        stored = self.state()["branches"][target]["data"]
        moved = {c.table_id for c in final.columns.collect() if c.column_id in changed}
        ids, old = ({t.name: t.table_id for t in s.tables.collect()} for s in (final, p["ours"]))

        def write(table: str | None) -> None:
            if table in moved and table in stored and table not in data:
                name = next(n for n, t in ids.items() if t == table)
                data.update(self._write({name: tables[table]}, final))
                tables[table] = self.spark.read.parquet(data[table][0]).toDF(*tables[table].columns)

        def checked(table: str | None) -> None:
            write(table)
            broken = self._broken(tables, changed, p["ours"], final, table)
            if broken:
                raise ops.InvalidOperation(" ".join(broken))

        does = {"BACKFILL": write, "VALIDATE": checked, "INDEX_CONCURRENT": checked, "ANALYZE": lambda table: None}
        for i, step in enumerate(run["steps"]):
            name = step["op_group"].split(".")[0]
            table = ids.get(name, old.get(name))
            step["status"] = status("RUNNING", STEP_STATUSES)
            try:
                does.get(step["kind"], checked if step["verdict"] == "SCAN" else write if step["verdict"] == "REWRITE" else lambda table: None)(table)
                step["status"] = status("SUCCEEDED", STEP_STATUSES)
            except Exception as e:
                step |= {"status": status("FAILED", STEP_STATUSES), "error": self._short(e)}
                for later in run["steps"][i + 1 :]:
                    later["status"] = status("SKIPPED", STEP_STATUSES)
                raise
        for table in moved:  # those that no step has written, as columns that must not be NULL on a table of no size
            write(table)
        broken = self._broken(tables, changed, p["ours"], final)
        if broken:
            raise ops.InvalidOperation(" ".join(broken))

    def run(self, run_id: str) -> dict:
        """J11"""
        return self.state()["runs"][run_id]
