"""The user's handle: read statements, views, transactions and introspection over a table store."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelog.operators import changes as algebra
from tablelog.plans.dialect import UnsupportedSql, bound, classify, names, split_statements, to_spark, views_read
from tablelog.plans.statements import plain
from tablelog.sources.tables import TableStore, VersionConflict

RESERVED = "__tablelog__"


class ModeError(Exception):
    """execute() got a statement with rows, or query() one without."""


class Transaction:
    """Staged changes over one pinned version; reads see what was staged."""

    def __init__(self, store: TableStore, version: int):
        self.store, self.version = store, version
        self.staged: dict[str, DataFrame | None] = {}
        self.catalog: dict = {}
        self.read_tables: set[str] = set()

    def table(self, name: str) -> DataFrame:
        self.read_tables.add(name)
        staged = self.staged.get(name)
        return staged if staged is not None else self.store.read(name, self.version)

    def put(self, name: str, df: DataFrame) -> None:
        self.staged[name] = df

    def drop(self, name: str) -> None:
        self.staged[name] = None

    def entry(self, key: str):
        return self.entries().get(key)

    def entries(self) -> dict:
        return self.store.manifest(self.version)["catalog"] | self.catalog

    def set_entry(self, key: str, value) -> None:
        self.catalog[key] = value

    def execute(self, sql: str, args: list | dict | None = None) -> DataFrame | None:
        """A definition or modification statement; rows only for RETURNING."""
        from tablelog.plans.executor import Executor

        if classify(sql) == "read":
            raise ModeError("execute() takes statements that write")
        return Executor(self.store.spark, self, args).run(sql)

    def change(self, name: str, changes: DataFrame, keys: list[str]) -> None:
        """Apply changes to a table's staged image."""
        self.put(name, algebra.apply(self.table(name), changes, keys))


class Connection:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, TableStore(spark, root)
        self._pool: ThreadPoolExecutor | None = None

    def query(self, sql: str, args: list | dict | None = None, version: int | None = None) -> DataFrame:
        """A read statement over one pinned version; lazily evaluated."""
        kind = classify(sql)
        asked = re.fullmatch(r"(?is)\s*pragma\s+(\w+)\s*(?:\(\s*(.+?)\s*\))?\s*;?\s*", sql)
        if kind == "pragma" and asked:
            return self.pragma(asked[1].lower(), plain(asked[2]) if asked[2] else None, version)
        if kind != "read":
            raise ModeError("query() takes statements that return rows")
        words = names(sql)
        if any(w.startswith(RESERVED) for w in words):
            raise UnsupportedSql("reserved tables can't be read")
        sql = to_spark(bound(sql, args))
        version = self.store.version() if version is None else version
        session = self.spark.newSession()
        from tablelog.plans.executor import Definition

        manifest = self.store.manifest(version)
        views = {k[5:]: v for k, v in manifest["catalog"].items() if k.startswith("view:") and v}
        read = views_read(sql, views)
        for v in read:
            words |= names(views[v])
        for name, path in manifest["tables"].items():
            if name.lower() in words:
                rows, defined = session.read.parquet(path), manifest["catalog"].get(f"table:{name}")
                (Definition(json.loads(defined)).project(rows) if defined else rows).createOrReplaceTempView(name)
        for v in read:
            session.sql(to_spark(views[v])).createOrReplaceTempView(v)
        return session.sql(sql)

    def execute(self, sql: str, args: list | dict | None = None) -> DataFrame | None:
        """One writing statement as its own transaction; rows only for RETURNING."""
        return self.update(lambda t: t.execute(sql, args))

    def pragma(self, name: str, table: str | None = None, version: int | None = None) -> DataFrame:
        """table_info, table_xinfo, index_list, foreign_key_list of a table, index_info, index_xinfo of an index, or user_version.

        An unknown table or index has no rows.
        """
        from tablelog.plans.executor import Definition

        catalog = self.store.manifest(version)["catalog"]
        if name == "user_version":
            return self.spark.createDataFrame([(int(catalog.get("user_version") or 0),)], "user_version int")
        if table is None:
            raise UnsupportedSql(f"PRAGMA {name} needs a name")
        if name in ("index_info", "index_xinfo"):
            rows = []
            for body in (json.loads(v) for k, v in catalog.items() if k.startswith("table:") and v):
                held = Definition(body)
                for index in (*body["uniques"], *body.get("indexes", [])):
                    if (index["name"] or "").lower() == table.lower():
                        rows = [(n, held.names.index(c), c, 0, "BINARY", 1) for n, c in enumerate(index["columns"])]
            if name == "index_info":
                return self.spark.createDataFrame([r[:3] for r in rows], "seqno int, cid int, name string")
            return self.spark.createDataFrame(rows, "seqno int, cid int, name string, `desc` int, coll string, `key` int")
        text = catalog.get(f"table:{table.lower()}")
        d = Definition(json.loads(text) if text else {"columns": [], "primary": {"columns": []}, "uniques": [], "references": []})
        if name in ("table_info", "table_xinfo"):
            info = self.spark.createDataFrame([(n, c["name"], c["declared"], int(c["not_null"]), c["default"], d.key.index(c["name"]) + 1 if c["name"] in d.key else 0) for n, c in enumerate(d.columns)], "cid int, name string, type string, `notnull` int, dflt_value string, pk int")
            return info.withColumn("hidden", F.lit(0)) if name == "table_xinfo" else info
        if name == "index_list":
            rows = [(u["name"] or f"unique_{n}", 1) for n, u in enumerate(d.body["uniques"])] + [(i["name"], 0) for i in d.body.get("indexes", [])]
            return self.spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "seq int, name string, `unique` int")
        if name == "foreign_key_list":
            return self.spark.createDataFrame([(n, k, r["parent"], c, p, r["on_update"], r["on_delete"]) for n, r in enumerate(d.body["references"]) for k, (c, p) in enumerate(zip(r["columns"], r["parent_columns"]))], "id int, seq int, `table` string, `from` string, `to` string, on_update string, on_delete string")
        raise UnsupportedSql(f"PRAGMA {name} isn't supported")

    def create_view(self, name: str, body: str) -> None:
        if classify(body) != "read" or "?" in body:
            raise UnsupportedSql("a view is a SELECT without parameters")
        self.store.commit(self.store.version(), {}, {f"view:{name}": body})

    @contextmanager
    def view(self) -> Iterator[Callable[[str], DataFrame]]:
        """Reads of one pinned version."""
        version = self.store.version()
        yield lambda sql, args=None: self.query(sql, args, version)

    def update(self, work: Callable[[Transaction], object], retries: int = 0) -> object:
        """Run `work` over a pinned version and commit what it staged; an error commits nothing.

        If another writer came first, the work runs again, at most `retries` times.
        """
        while True:
            txn = Transaction(self.store, self.store.version())
            result = work(txn)
            try:
                if txn.staged or txn.catalog:
                    self.store.commit(txn.version, txn.staged, txn.catalog)
                return result
            except VersionConflict:
                if not retries:
                    raise
                retries -= 1

    def script(self, text: str) -> Iterator[tuple[str, DataFrame | Exception | None]]:
        """Every statement of a script with its rows, its error, or None where it gives no rows; errors don't end the script."""
        for sql in split_statements(text):
            try:
                kind = classify(sql)
                reads = kind == "read" or (kind == "pragma" and "=" not in sql)
                yield sql, self.query(sql) if reads else self.execute(sql)
            except Exception as e:  # the script goes on, the caller sees the error
                yield sql, e

    def _async(self, f: Callable, *args) -> Future:
        self._pool = self._pool or ThreadPoolExecutor(4)
        return self._pool.submit(f, *args)

    def query_async(self, sql: str, args=None) -> Future:
        return self._async(lambda: self.query(sql, args).collect())

    def update_async(self, work: Callable[[Transaction], object]) -> Future:
        return self._async(self.update, work)


def format_table(df: DataFrame, most: int = 1000) -> str:
    """An aligned text table of the first `most` rows; null is NULL, binary is X'hex'.

    The last line counts the rows, or says that there are more than it shows.
    """
    found = df.limit(most + 1).collect()
    rows = [[_cell(v) for v in r] for r in found[:most]]
    count = f"the first {most} rows, there are more" if len(found) > most else f"{len(rows)} row{'s' * (len(rows) != 1)}"
    widths = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(df.columns)]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in widths), *map(line, rows), count])


def _cell(v) -> str:
    if v is None:
        return "NULL"
    return f"X'{bytes(v).hex().upper()}'" if isinstance(v, (bytes, bytearray)) else str(v)
