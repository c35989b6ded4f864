"""Schemas by stable identity: names are bindings, ids are what rows belong to."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelog.functions.values import AFFINITY, affinity_of, spark_type

MAX_INDEX_COLUMNS = 251


class SchemaError(Exception):
    """A definition or its change was refused."""


@dataclass(frozen=True)
class Column:
    name: str
    declared: str
    not_null: bool = False
    default: str | None = None
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    retired: bool = False


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    strict: bool = False
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    indexes: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def __post_init__(self):
        names = [c.name.lower() for c in self.live]
        if len(set(names)) != len(names):
            raise SchemaError("duplicate column name")
        if not self.primary_key:
            raise SchemaError("a table needs a primary key")
        for key in (self.primary_key, *self.uniques):
            if len(key) > MAX_INDEX_COLUMNS:
                raise SchemaError("too many index columns")
            for c in key:
                self.column(c)
        if any(not c.declared for c in self.columns):
            raise SchemaError("every column must declare a type")

    @property
    def live(self) -> list[Column]:
        return [c for c in self.columns if not c.retired]

    def column(self, name: str) -> Column:
        """By name, without regard to ASCII case."""
        for c in self.live:
            if c.name.lower() == name.lower():
                return c
        raise SchemaError(f"no such column: {name}")

    def revision(self) -> str:
        """A fingerprint of the content."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def rename(self, name: str) -> Table:
        if name.lower() == self.name.lower():
            raise SchemaError("the name must change")
        return replace(self, name=name)

    def rename_column(self, old: str, new: str) -> Table:
        at = self.column(old)
        if any(c.name.lower() == new.lower() for c in self.live):
            raise SchemaError(f"duplicate column name: {new}")
        swap = lambda names: tuple(new if n.lower() == old.lower() else n for n in names)
        return replace(self, columns=tuple(replace(c, name=new) if c is at else c for c in self.columns), primary_key=swap(self.primary_key), uniques=tuple(map(swap, self.uniques)), checks=tuple(rename_in_expression(e, old, new) for e in self.checks), indexes=tuple((n, swap(cs)) for n, cs in self.indexes))

    def add_column(self, column: Column) -> Table:
        if column.not_null and column.default is None:
            raise SchemaError("a NOT NULL column needs a default")
        return replace(self, columns=(*self.columns, column))

    def drop_column(self, name: str) -> Table:
        at = self.column(name)
        used = {c.lower() for key in (self.primary_key, *self.uniques, *(cs for _, cs in self.indexes)) for c in key} | {n.lower() for e in self.checks for n in expression_columns(e)}
        if at.name.lower() in used:
            raise SchemaError(f"column {name} is in use")
        return replace(self, columns=tuple(replace(c, retired=True) if c is at else c for c in self.columns))

    def needs_new_contract(self, added: Column, check: str | None = None, references: bool = False) -> bool:
        """Whether writers of the old schema could break the new one."""
        return (added.not_null and added.default is None) or check is not None or references

    def project(self, stored: DataFrame) -> DataFrame:
        """Rows whose columns are named by id, as this schema sees them: bound names, defaults for what is missing, retired columns gone."""
        have = set(stored.columns)
        out = []
        for c in self.live:
            kind = spark_type(c.declared, self.strict)
            source = F.col(c.id) if c.id in have else F.expr(c.default) if c.default is not None else F.lit(None)
            out.append(source.cast(kind).alias(c.name))
        return stored.select(*out)

    def store(self, rows: DataFrame) -> DataFrame:
        """Rows with their columns named by id, as they are written."""
        return rows.select(*(F.col(c.name).alias(c.id) for c in self.live))

    def info(self, spark: SparkSession) -> DataFrame:
        """table_info: cid, name, type, notnull, dflt_value, pk."""
        key = [k.lower() for k in self.primary_key]
        rows = [(n, c.name, c.declared, int(c.not_null), c.default, key.index(c.name.lower()) + 1 if c.name.lower() in key else 0) for n, c in enumerate(self.live)]
        return spark.createDataFrame(rows, "cid int, name string, type string, `notnull` int, dflt_value string, pk int")

    def index_list(self, spark: SparkSession) -> DataFrame:
        rows = [(n, f"unique_{n}", 1, "u") for n, _ in enumerate(self.uniques)] + [(len(self.uniques) + n, name, 0, "c") for n, (name, _) in enumerate(self.indexes)]
        return spark.createDataFrame(rows, "seq int, name string, `unique` int, origin string")

    def affinities(self) -> dict[str, str]:
        return {c.name: affinity_of(c.declared, self.strict) for c in self.live}


_WORD = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[^\]]*\]|[A-Za-z_]\w*(?=\s*\()|[A-Za-z_]\w*"
#: Words of expressions that never name a column.
KEYWORDS = frozenset("and or not is null in between like glob case when then else end cast as collate exists true false escape distinct current_date current_time current_timestamp integer text real blob numeric binary nocase rtrim".split())


def expression_columns(expression: str) -> set[str]:
    """Names that a schema expression reads."""
    import re

    out = set()
    for m in re.finditer(_WORD, expression):
        word, rest = m[0], expression[m.end() :].lstrip()
        if word.startswith("'") or rest.startswith("(") or word.lower() in KEYWORDS:
            continue
        out.add(word.strip('"`[]'))
    return out


def rename_in_expression(expression: str, old: str, new: str) -> str:
    import re

    def swap(m) -> str:
        word, rest = m[0], expression[m.end() :].lstrip()
        plain = word.strip('"`[]')
        return new if not word.startswith("'") and not rest.startswith("(") and plain.lower() == old.lower() else word

    return re.sub(_WORD, swap, expression)


def column_order(edges: dict[str, str | None]) -> list[str]:
    """Ids in linear order from each one's predecessor; siblings in id order, a branch before its siblings' branches."""
    children: dict[str | None, list[str]] = {}
    for node, before in edges.items():
        children.setdefault(before, []).append(node)
    out, stack = [], sorted(children.get(None, []), reverse=True)
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(sorted(children.get(node, []), reverse=True))
    return out


__all__ = ["AFFINITY", "Column", "SchemaError", "Table", "column_order", "expression_columns", "rename_in_expression"]
