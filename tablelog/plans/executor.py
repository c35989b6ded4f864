"""Runs definition and modification statements over one transaction.

Table rows are stored under column ids, so renames and drops never touch data.
Reads inside statements see what the transaction has staged.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelog.functions.values import VALUE_TYPE, spark_type
from tablelog.operators import changes as algebra
from tablelog.operators import dml, integrity
from tablelog.plans import statements as S
from tablelog.plans.catalog import expression_columns, rename_in_expression
from tablelog.plans.dialect import UnsupportedSql, bound, names, to_spark, unqualified, views_read
from tablelog.sources.tables import pinned


#: A store has one chain of versions, so all its ids come from one device.
DEVICE = 1


class UnknownTable(Exception):
    """No such table."""


def column_type(declared: str, strict: bool) -> str:
    kind = spark_type(declared, strict)
    return "string" if kind == VALUE_TYPE else kind  # numeric affinity: kept as text that reads as its number


class Definition:
    """A table's definition as the manifest keeps it."""

    def __init__(self, body: dict):
        self.body = body

    @staticmethod
    def of(create: S.CreateTable) -> Definition:
        body = asdict(create)
        for c in body["columns"]:
            c["id"] = f"c{uuid.uuid4().hex}"
        names = [c["name"].lower() for c in body["columns"]]
        if len(set(names)) != len(names):
            raise UnsupportedSql("duplicate column name")
        out = Definition(body)
        for key in (body["primary"], *body["uniques"], *body["references"]):
            key["columns"] = [out.column(c)["name"] for c in key["columns"]]
        return out

    @property
    def columns(self) -> list[dict]:
        return self.body["columns"]

    @property
    def names(self) -> list[str]:
        return [c["name"] for c in self.columns]

    @property
    def key(self) -> list[str]:
        return self.body["primary"]["columns"]

    def column(self, name: str) -> dict:
        for c in self.columns:
            if c["name"].lower() == name.lower():
                return c
        raise UnsupportedSql(f"no such column: {name}")

    def keys(self) -> list[tuple[list[str], str]]:
        return [(k["columns"], k["conflict"]) for k in (self.body["primary"], *self.body["uniques"])]

    def type_of(self, column: dict) -> str:
        return column_type(column["declared"], self.body["strict"])

    def schema(self) -> str:
        return ", ".join(f"`{c['name']}` {self.type_of(c)}" for c in self.columns)

    def project(self, stored: DataFrame) -> DataFrame:
        have = set(stored.columns)
        return stored.select(*((F.col(c["id"]) if c["id"] in have else F.expr(to_spark(c["default"])) if c["default"] else F.lit(None)).cast(self.type_of(c)).alias(c["name"]) for c in self.columns))

    def store(self, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(c["name"]).alias(c["id"]) for c in self.columns))


class Executor:
    """Statements over the tables of one transaction (tablelog.plans.connection.Transaction)."""

    def __init__(self, spark: SparkSession, txn, args: list | dict | None = None):
        self.spark, self.txn, self.args = spark, txn, args

    # --- catalog
    def definition(self, table: str) -> Definition:
        found = self.catalog(table)
        if found is None:
            raise UnknownTable(table)
        return found

    def catalog(self, table: str) -> Definition | None:
        text = self.txn.entry(f"table:{table.lower()}")
        return Definition(json.loads(text)) if text else None

    def define(self, table: str, definition: Definition | None) -> None:
        self.txn.set_entry(f"table:{table.lower()}", json.dumps(definition.body, sort_keys=True) if definition else None)

    def defined(self) -> list[str]:
        return [k[6:] for k, v in self.txn.entries().items() if k.startswith("table:") and v]

    def rows(self, table: str) -> DataFrame:
        return self.definition(table).project(self.txn.table(table.lower()))

    def sql(self, text: str) -> DataFrame:
        return self._session(text).sql(to_spark(text))

    def views(self) -> dict[str, str]:
        return {k[5:]: v for k, v in self.txn.entries().items() if k.startswith("view:") and v}

    def _session(self, text: str) -> SparkSession:
        """A session of its own with every table of the transaction, and the views that `text` reads."""
        from tablelog.sources.tables import moved_to

        session = self.spark.newSession()
        for name in self.defined():
            moved_to(session, self.rows(name)).createOrReplaceTempView(name)
        views = self.views()
        for name in views_read(text, views):
            session.sql(to_spark(views[name])).createOrReplaceTempView(name)
        return session

    # --- statements
    def run(self, sql: str) -> DataFrame | None:
        """Executes a statement; rows only for RETURNING. One that fails stages nothing."""
        staged, catalog = dict(self.txn.staged), dict(self.txn.catalog)
        try:
            return self._run(S.parse(bound(sql, self.args)))
        except Exception:
            self.txn.staged, self.txn.catalog = staged, catalog
            raise

    def _run(self, s) -> DataFrame | None:
        if isinstance(s, S.CreateTable):
            self.create(s)
        elif isinstance(s, S.Drop):
            self.drop(s)
        elif isinstance(s, S.Alter):
            self.alter(s)
        elif isinstance(s, S.CreateIndex):
            self.create_index(s)
        elif isinstance(s, S.CreateView):
            self.sql(s.body)
            self.txn.set_entry(f"view:{s.name}", s.body)
        elif isinstance(s, S.SetUserVersion):
            self.txn.set_entry("user_version", s.value)
        elif isinstance(s, S.Insert):
            return self.insert(s)
        else:
            return self.modify(s)
        return None

    def create(self, s: S.CreateTable) -> None:
        if self.catalog(s.name):
            if s.if_not_exists:
                return
            raise UnsupportedSql(f"table {s.name} exists")
        d = Definition.of(s)
        for r in d.body["references"]:
            if r["parent"].lower() == s.name.lower():
                raise UnsupportedSql("a table may not reference itself")
            parent = self.definition(r["parent"])
            r["parent_columns"] = [parent.column(c)["name"] for c in r["parent_columns"] or parent.key]
            if len(r["parent_columns"]) != len(r["columns"]) or sorted(r["parent_columns"]) not in [sorted(k) for k, _ in parent.keys()]:
                raise UnsupportedSql("a reference needs a unique key of its parent")
        self.define(s.name, d)
        self.txn.put(s.name.lower(), d.store(self.spark.createDataFrame([], d.schema())))

    def drop(self, s: S.Drop) -> None:
        if s.kind == "view":
            if self.txn.entry(f"view:{s.name}") is None and not s.if_exists:
                raise UnknownTable(s.name)
            self.txn.set_entry(f"view:{s.name}", None)
            return
        if s.kind == "index":
            for name in self.defined():
                d = self.definition(name)
                kept = [i for i in d.body.get("indexes", []) if i["name"].lower() != s.name.lower()]
                uniques = [u for u in d.body["uniques"] if (u["name"] or "").lower() != s.name.lower()]
                if len(kept) != len(d.body.get("indexes", [])) or len(uniques) != len(d.body["uniques"]):
                    d.body["indexes"], d.body["uniques"] = kept, uniques
                    self.define(name, d)
                    return
            if not s.if_exists:
                raise UnknownTable(s.name)
            return
        if self.catalog(s.name) is None:
            if s.if_exists:
                return
            raise UnknownTable(s.name)
        if any(r["parent"].lower() == s.name.lower() for n in self.defined() for r in self.definition(n).body["references"]):
            raise UnsupportedSql(f"table {s.name} is referenced")
        if any(s.name.lower() in {x.lower() for x in expression_columns(v)} for k, v in self.txn.entries().items() if k.startswith("view:") and v):
            raise UnsupportedSql(f"table {s.name} is used by a view")
        self.define(s.name, None)
        self.txn.drop(s.name.lower())

    def create_index(self, s: S.CreateIndex) -> None:
        d = self.definition(s.table)
        columns = [d.column(c)["name"] for c in s.columns]
        if any(i["name"].lower() == s.name.lower() for i in d.body.get("indexes", [])):
            if s.if_not_exists:
                return
            raise UnsupportedSql(f"index {s.name} exists")
        if s.unique:
            if integrity.unique_violations(self.rows(s.table), columns).limit(1).count():
                raise integrity.ConstraintError(f"UNIQUE constraint failed: {', '.join(columns)}")
            d.body["uniques"].append({"columns": columns, "conflict": "abort", "name": s.name})
        else:
            d.body.setdefault("indexes", []).append({"name": s.name, "columns": columns})
        self.define(s.table, d)

    def alter(self, s: S.Alter) -> None:
        """Changes a definition; refused where a view that reads the table would no longer be valid."""
        views = self.views()
        mine = [v for v in views if s.name.lower() in names(views[v]) or any(s.name.lower() in names(views[w]) for w in views_read(views[v], views))]
        self._alter(s)
        for v in mine:
            try:
                self.sql(views[v])
            except AnalysisException as e:
                raise UnsupportedSql(f"view {v} reads what {s.action} changes in {s.name}") from e

    def _alter(self, s: S.Alter) -> None:
        d = self.definition(s.name)
        if s.action == "rename":
            if s.new.lower() == s.name.lower() or self.catalog(s.new):
                raise UnsupportedSql(f"table {s.new} exists")
            rows = self.txn.table(s.name.lower())
            for n in self.defined():
                other = self.definition(n)
                for r in other.body["references"]:
                    if r["parent"].lower() == s.name.lower():
                        r["parent"] = s.new
                        self.define(n, other)
            self.define(s.name, None)
            self.txn.drop(s.name.lower())
            d.body["name"] = s.new
            self.define(s.new, d)
            self.txn.put(s.new.lower(), rows)
            return
        if s.action == "rename_column":
            c = d.column(s.old)
            if any(x["name"].lower() == s.new.lower() for x in d.columns if x is not c):
                raise UnsupportedSql(f"duplicate column name: {s.new}")
            old = c["name"]
            c["name"] = s.new
            for k in (d.body["primary"], *d.body["uniques"], *d.body["references"], *d.body.get("indexes", [])):
                k["columns"] = [s.new if x == old else x for x in k["columns"]]
            d.body["checks"] = [[n, rename_in_expression(e, old, s.new)] for n, e in d.body["checks"]]
            for n in self.defined():
                other = self.definition(n)
                for r in other.body["references"]:
                    if r["parent"].lower() == s.name.lower():
                        r["parent_columns"] = [s.new if x == old else x for x in r["parent_columns"]]
                        self.define(n, other)
        elif s.action == "add":
            if any(x["name"].lower() == s.column.name.lower() for x in d.columns):
                raise UnsupportedSql(f"duplicate column name: {s.column.name}")
            if s.column.not_null and s.column.default is None:
                raise UnsupportedSql("a NOT NULL column needs a default")
            d.columns.append(asdict(s.column) | {"id": f"c{uuid.uuid4().hex}"})
            d.body["checks"] += [list(c) for c in s.checks]
        elif s.action == "drop":
            c = d.column(s.old)
            used = {x.lower() for k in (d.body["primary"], *d.body["uniques"], *d.body["references"], *d.body.get("indexes", [])) for x in k["columns"]} | {x.lower() for _, e in d.body["checks"] for x in expression_columns(e)}
            if c["name"].lower() in used:
                raise UnsupportedSql(f"column {s.old} is in use")
            d.columns.remove(c)
        else:
            before = json.dumps(d.body)
            for part in ("uniques", "references"):
                d.body[part] = [k for k in d.body[part] if (k["name"] or "").lower() != s.old.lower()]
            d.body["checks"] = [c for c in d.body["checks"] if (c[0] or "").lower() != s.old.lower()]
            if json.dumps(d.body) == before:
                raise UnsupportedSql(f"no such constraint: {s.old}")
        self.define(s.name, d)

    # --- rows
    def insert(self, s: S.Insert) -> DataFrame | None:
        d = self.definition(s.table)
        given = [d.column(c)["name"] for c in s.columns] or d.names
        if s.body is None:
            given, rows = [], self.spark.range(1).select(F.lit(0).alias("ordinal"))
        else:
            rows = self.sql(f"{s.prefix} {s.body}")
            if len(rows.columns) != len(given):
                raise UnsupportedSql(f"{len(given)} values are expected for {len(rows.columns)} columns")
            rows = rows.toDF(*given).withColumn("ordinal", F.monotonically_increasing_id())
        defaults = {c["name"]: F.expr(to_spark(c["default"])) for c in d.columns if c["default"]}
        table = self.rows(s.table)
        rows = self._numbered(d, pinned(dml.with_defaults(rows, table, defaults)))
        for c in d.columns:
            policy = s.policy or c["not_null_conflict"]
            if c["not_null"] or c["name"] in d.key:
                if policy == "replace" and c["name"] in defaults:
                    rows = rows.withColumn(c["name"], F.coalesce(c["name"], defaults[c["name"]].cast(d.type_of(c))))
                elif policy == "ignore":
                    rows = rows.where(F.col(c["name"]).isNotNull())
        self.check(d, rows, ignore=s.policy == "ignore")
        if s.policy == "ignore":
            for _, e in d.body["checks"]:
                rows = rows.where(F.coalesce(F.expr(to_spark(e)), F.lit(True)))
        done = self._upserted(d, table, rows, s.upserts, s.alias or s.table) if s.upserts else self._inserted(d, table, rows, s.policy)
        return self.finish(s.table, d, done, s.returning)

    def _numbered(self, d: Definition, rows: DataFrame) -> DataFrame:
        """Rows whose INTEGER PRIMARY KEY is missing get ids; each statement takes slots of its own.

        Slots are counted in the catalog, so writers that took the same ones
        can't both commit.
        """
        if len(d.key) != 1 or not d.body.get("rowid", True) or d.column(d.key[0])["declared"] != "INTEGER":
            return rows
        missing = rows.where(F.col(d.key[0]).isNull()).count()
        if not missing:
            return rows
        slot = int(self.txn.entry("rowid_slot") or 0)
        self.txn.set_entry("rowid_slot", slot + 1 + (missing - 1) // dml.IDS_PER_SLOT)
        return pinned(dml.allocate_rowids(rows, d.key[0], DEVICE, slot, "ordinal"))

    def _inserted(self, d: Definition, table: DataFrame, rows: DataFrame, policy: str | None) -> DataFrame:
        keys = [(k, policy or p) for k, p in d.keys()]
        kinds = {p for _, p in keys}
        if len(kinds) == 1:
            return dml.insert(table, rows, [k for k, _ in keys], kinds.pop())
        for k, p in keys:
            if p == "ignore":
                rows = rows.join(table.where(integrity.all_set(k)).select(*k).distinct(), k, "left_anti").select(rows.columns)
                rows = dml.first_wins(rows, [k], "ordinal")
        rows = pinned(rows)
        strict = [k for k, p in keys if p == "abort"]
        replace = [k for k, p in keys if p == "replace"]
        if not replace:
            return dml.insert(table, rows, [k for k, _ in keys])
        done = pinned(dml.insert(table, rows, replace, "replace"))
        after = algebra.apply(table, done, d.key)
        for k in strict:
            if integrity.unique_violations(after, k).limit(1).count():
                raise integrity.ConstraintError(f"UNIQUE constraint failed: {', '.join(k)}")
        return done

    def _upserted(self, d: Definition, table: DataFrame, rows: DataFrame, clauses: list[S.Upsert], owner: str) -> DataFrame:
        """Clauses in turn: each takes the candidates that meet its target; the rest go on. `owner` may qualify the current row's columns."""
        done, left = None, rows
        for u in clauses:
            targets = [[d.column(c)["name"] for c in u.target]] if u.target else [k for k, _ in d.keys()]
            if any(sorted(t) not in [sorted(k) for k, _ in d.keys()] for t in targets):
                raise UnsupportedSql("ON CONFLICT needs a unique key")
            for t in targets:
                seen = left.where(integrity.all_set(t)).groupBy(*t).agg(F.min("ordinal").alias("_first"))
                held = table.where(integrity.all_set(t)).select(*t, F.lit(True).alias("_held")).distinct()
                marked = left.join(seen, t, "left").join(held, t, "left")
                hit = pinned(marked.where(F.col("_held") | (F.col("_first") < F.col("ordinal"))).select(rows.columns))
                if u.sets is not None:
                    touched = hit.select(*t).distinct()
                    mine = left.join(touched, t, "left_semi").select(rows.columns)
                    sets = {d.column(c)["name"]: to_spark(unqualified(e, owner)) for c, e in u.sets.items()}
                    new = dml.upsert(table, pinned(mine), t, sets, to_spark(unqualified(u.where, owner)) if u.where else None)
                    done = new if done is None else done.unionByName(new)
                    left = pinned(left.join(touched, t, "left_anti").select(rows.columns))
                else:
                    left = pinned(left.join(hit.select("ordinal"), "ordinal", "left_anti").select(rows.columns))
        fresh = dml.insert(table, left, [k for k, _ in d.keys()])
        done = fresh if done is None else done.unionByName(fresh)
        after = algebra.apply(table, pinned(done), d.key)
        for k, _ in d.keys():
            if integrity.unique_violations(after, k).limit(1).count():
                raise integrity.ConstraintError(f"UNIQUE constraint failed: {', '.join(k)}")
        return done

    def modify(self, s: S.Modify) -> DataFrame | None:
        d = self.definition(s.table)
        image = lambda of: "named_struct(" + ", ".join(f"'{c}', {of(c)}" for c in d.names) + ")"
        own = lambda c: f"`{s.alias}`.`{c}`"
        before = image(own)
        if s.sets is None:
            after = "NULL"
        else:
            sets = {d.column(c)["name"]: e for c, e in s.sets.items()}
            after = image(lambda c: f"CAST({sets[c]} AS {d.type_of(d.column(c))})" if c in sets else own(c))
        text = f"{s.prefix} SELECT {before} AS before, {after} AS after FROM `{s.table}` AS `{s.alias}`"
        if s.source:
            text += f", {s.source}"
        if s.where:
            text += f" WHERE {s.where}"
        if s.order:
            text += f" ORDER BY {s.order}"
        if s.limit:
            text += f" LIMIT {s.limit}"
        done = self.sql(text)
        if s.sets is None:
            done = done.select("before", F.col("after").cast(done.schema["before"].dataType))
        else:
            done = done.where(~F.col("before").eqNullSafe(F.col("after")))
        if s.source:
            done = done.select("*", *(F.col(f"before.{k}").alias(f"_{n}") for n, k in enumerate(d.key))).dropDuplicates([f"_{n}" for n, _ in enumerate(d.key)]).select("before", "after")
        done = pinned(done)
        if s.sets is not None:
            self.check(d, done.select("after.*"), False)
            done = self._settled(d, self.rows(s.table), done, s.policy)
        return self.finish(s.table, d, done, s.returning)

    def _settled(self, d: Definition, table: DataFrame, done: DataFrame, policy: str | None) -> DataFrame:
        """Updates after their new values met the unique keys."""
        for k, own in d.keys():
            rule = policy or own
            after = algebra.apply(table, done, d.key)
            clash = integrity.unique_violations(after, k).select(*k)
            if not clash.limit(1).count():
                continue
            if rule == "abort":
                raise integrity.ConstraintError(f"UNIQUE constraint failed: {', '.join(k)}")
            hit = done.select("*", *(F.col(f"after.{c}").alias(c) for c in k)).join(clash, k, "left_semi").select("before", "after")
            if rule == "ignore":
                done = pinned(done.exceptAll(hit))
            else:
                kept = pinned(hit.select("*", *(F.col(f"after.{c}").alias(f"_{c}") for c in k)).dropDuplicates([f"_{c}" for c in k]).select("before", "after"))
                lost = hit.exceptAll(kept).select("before", F.lit(None).cast(hit.schema["after"].dataType).alias("after"))
                touched = done.select(*(F.col(f"before.{c}").alias(c) for c in d.key))
                victims = table.join(touched, d.key, "left_anti").join(kept.select(*(F.col(f"after.{c}").alias(c) for c in k)), k, "left_semi").select(F.struct(*d.names).alias("before")).select("before", F.lit(None).cast(hit.schema["after"].dataType).alias("after"))
                done = pinned(done.exceptAll(hit).unionByName(kept).unionByName(lost).unionByName(victims))
        return done

    def check(self, d: Definition, rows: DataFrame, ignore: bool) -> None:
        if ignore:
            return
        needed = [c["name"] for c in d.columns if c["not_null"] or c["name"] in d.key]
        if needed and integrity.not_null_violations(rows, needed).limit(1).count():
            raise integrity.ConstraintError(f"NOT NULL constraint failed: {', '.join(needed)}")
        for name, e in d.body["checks"]:
            if integrity.check_violations(rows, to_spark(e)).limit(1).count():
                raise integrity.ConstraintError(f"CHECK constraint failed: {name or e}")

    def finish(self, table: str, d: Definition, done: DataFrame, returning: str | None) -> DataFrame | None:
        """Stage a table's changes, follow references, and give what RETURNING asks for."""
        done = pinned(done)
        self._stage(table, d, done)
        if returning is None:
            return None
        items = d.names if returning.strip() == "*" else [to_spark(x) for x in S.Parser.split(returning)]
        return dml.returning(done, *[f"`{x}`" if x in d.names else x for x in items])

    def _stage(self, table: str, d: Definition, done: DataFrame) -> None:
        old = self.rows(table)
        new = pinned(algebra.apply(old, done, d.key))
        self.txn.put(table.lower(), d.store(new))
        changed = done.where("after IS NOT NULL").select("after.*")  # rows that stay have had their parents
        for r in d.body["references"]:
            if integrity.orphans(changed, r["columns"], self.rows(r["parent"]), r["parent_columns"]).limit(1).count():
                raise integrity.ConstraintError(f"FOREIGN KEY constraint failed: {table}")
        for child in self.defined():
            cd = self.definition(child)
            for r in cd.body["references"]:
                if r["parent"].lower() == table.lower():
                    self._follow(child, cd, r, d, done)

    def _follow(self, child: str, cd: Definition, r: dict, d: Definition, done: DataFrame) -> None:
        """What a reference does about parent rows that left or moved."""
        key = r["parent_columns"]
        moved = done.where("before IS NOT NULL").select(*(F.col(f"before.{p}").alias(c) for p, c in zip(key, r["columns"])), *(F.col(f"after.{p}").alias(f"_new_{c}") for p, c in zip(key, r["columns"])), F.col("after").isNull().alias("_gone"))
        still = self.rows(r["parent"]).select(*(F.col(p).alias(c) for p, c in zip(key, r["columns"]))).distinct()
        moved = moved.where(integrity.all_set(r["columns"])).join(still, r["columns"], "left_anti")
        rows = self.rows(child)
        hit = pinned(rows.join(moved, r["columns"]).select(F.struct(*(F.col(c) for c in cd.names)).alias("before"), "_gone", *(f"_new_{c}" for c in r["columns"])))
        if not hit.limit(1).count():
            return

        def changed(action: str, which: DataFrame) -> DataFrame:
            if action in ("no_action", "restrict"):
                if which.limit(1).count():
                    raise integrity.ConstraintError(f"FOREIGN KEY constraint failed: {child}")
                return which.select("before", F.col("before").alias("after"))
            kind = hit.schema["before"].dataType
            if action == "cascade":
                image = F.struct(*((F.col(f"_new_{c}") if c in r["columns"] else F.col(f"before.{c}")).alias(c) for c in cd.names))
                return which.select("before", F.when(~F.col("_gone"), image).cast(kind).alias("after"))
            default = {c: (F.expr(to_spark(cd.column(c)["default"])) if action == "set_default" and cd.column(c)["default"] else F.lit(None)) for c in r["columns"]}
            image = F.struct(*((default[c].cast(cd.type_of(cd.column(c))) if c in default else F.col(f"before.{c}")).alias(c) for c in cd.names))
            return which.select("before", image.cast(kind).alias("after"))

        new = pinned(changed(r["on_delete"], hit.where("_gone")).unionByName(changed(r["on_update"], hit.where("NOT _gone"))))
        self.check(cd, new.where("after IS NOT NULL").select("after.*"), False)
        self._stage(child, cd, new)
