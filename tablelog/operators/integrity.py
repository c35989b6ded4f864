"""Constraints as queries: each returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class ConstraintError(Exception):
    """A statement was refused; the message names the constraint."""


def all_set(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def unique_violations(table: DataFrame, columns: list[str]) -> DataFrame:
    """Values held more than once; a null in any column never collides."""
    return table.where(all_set(columns)).groupBy(*columns).agg(F.count("*").alias("holders")).where("holders > 1")


def check_violations(table: DataFrame, expression: str) -> DataFrame:
    """A check fails only where it is false, not where it is null."""
    return table.where(F.coalesce(F.expr(expression), F.lit(True)) == F.lit(False))


def not_null_violations(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.where(~all_set(columns))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows without parent; a null in any column asks for none."""
    keys = parent.select(*(F.col(p).alias(c) for p, c in zip(parent_columns, columns))).distinct()
    return child.where(all_set(columns)).join(keys, columns, "left_anti")


class Reference:
    """A foreign key with its actions: no_action, restrict, cascade, set_null or set_default."""

    def __init__(self, child: str, columns: list[str], parent: str, parent_columns: list[str], on_delete: str = "no_action", on_update: str = "no_action", defaults: dict | None = None):
        if child == parent:
            raise ConstraintError("a table may not reference itself")
        if len(columns) != len(parent_columns) or len(set(columns)) != len(columns):
            raise ConstraintError("reference columns must be distinct and as many as the parent's")
        self.child, self.columns, self.parent, self.parent_columns = child, columns, parent, parent_columns
        self.on_delete, self.on_update, self.defaults = on_delete, on_update, defaults or {}


def delete_cascade(tables: dict[str, DataFrame], references: list[Reference], table: str, doomed: DataFrame, key: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables after deleting `doomed` rows of one, actions followed down the references.

    References form no cycle, so each level is a set of joins; nothing loops
    over rows. `key` tells the doomed rows of the first table; without one, all
    of its columns do. Children are told by the columns that refer.
    """
    names = key or tables[table].columns
    gone = doomed.select(names).distinct()
    rest = tables[table].join(gone, _null_safe(tables[table], gone, names), "left_anti")
    return _delete_followed(tables | {table: rest}, references, table, doomed)


def _delete_followed(tables: dict[str, DataFrame], references: list[Reference], table: str, doomed: DataFrame) -> dict[str, DataFrame]:
    out = dict(tables)
    for ref in (r for r in references if r.parent == table):
        gone = doomed.select(*(F.col(p).alias(c) for p, c in zip(ref.parent_columns, ref.columns))).distinct()
        hit = out[ref.child].join(gone, ref.columns, "left_semi")
        if ref.on_delete == "cascade":
            out = _delete_followed(out | {ref.child: out[ref.child].join(gone, ref.columns, "left_anti")}, references, ref.child, hit)
        elif ref.on_delete in ("set_null", "set_default"):
            marked = out[ref.child].join(gone.withColumn("_gone", F.lit(True)), ref.columns, "left")
            new = {c: (F.lit(ref.defaults[c]) if ref.on_delete == "set_default" and c in ref.defaults else F.lit(None)) for c in ref.columns}
            out[ref.child] = marked.select(*(F.when(F.col("_gone"), new[c].cast(out[ref.child].schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in out[ref.child].columns))
        elif hit.limit(1).count():
            raise ConstraintError(f"{ref.child} still references {table}")
    return out


def update_cascade(tables: dict[str, DataFrame], references: list[Reference], table: str, moved: DataFrame) -> dict[str, DataFrame]:
    """Children after parent keys moved; `moved` has old_<column> and new_<column> of each moved key."""
    out = dict(tables)
    for ref in (r for r in references if r.parent == table):
        pairs = moved.select(*(F.col(f"old_{p}").alias(c) for p, c in zip(ref.parent_columns, ref.columns)), *(F.col(f"new_{p}").alias(f"_new_{c}") for p, c in zip(ref.parent_columns, ref.columns)), F.lit(True).alias("_hit")).distinct()
        child = out[ref.child]
        if ref.on_update in ("no_action", "restrict"):
            if child.join(pairs, ref.columns, "left_semi").limit(1).count():
                raise ConstraintError(f"{ref.child} still references {table}")
            continue
        new = {c: {"cascade": F.col(f"_new_{c}"), "set_null": F.lit(None), "set_default": F.lit(ref.defaults.get(c))}[ref.on_update] for c in ref.columns}
        out[ref.child] = child.join(pairs, ref.columns, "left").select(*(F.when(F.col("_hit"), new[c].cast(child.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in child.columns))
    return out


def _null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in names))
