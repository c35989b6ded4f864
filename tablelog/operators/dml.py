"""Data modification as functions from a table and a statement to its changes.

Each returns changes (before, after) for tablelog.operators.changes. Statements
that a row engine runs row by row are set operations here: what later rows of
one statement do to earlier ones is settled by their order column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelog.operators.integrity import ConstraintError, all_set


def with_defaults(rows: DataFrame, like: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Candidate rows with every column of the table: given, default or null, in its type."""
    have, defaults = set(rows.columns), defaults or {}
    return rows.select(*((F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in like.schema.fields), *(F.col(c) for c in rows.columns if c not in like.columns))


def _clash(rows: DataFrame, table: DataFrame, unique: list[str], how: str) -> DataFrame:
    """Rows that share a unique value with the table (left_semi), or don't (left_anti)."""
    return rows.join(table.where(all_set(unique)).select(*unique).distinct(), unique, how)


def _image(columns: Sequence[str], prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in columns))


def _inserted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    after = _image(columns)
    return rows.select(F.when(F.lit(False), after).alias("before"), after.alias("after"))


def first_wins(rows: DataFrame, uniques: list[list[str]], order: str) -> DataFrame:
    """Rows that meet no earlier kept row on any unique key.

    With one key that is its first row. With several, a row counts as dropped
    only if the row it meets is itself kept; each round settles every row whose
    earlier rivals are settled.
    """
    if len(uniques) == 1:
        u = uniques[0]
        first = rows.where(all_set(u)).groupBy(*u).agg(F.min(order).alias(order))
        return rows.where(~all_set(u)).unionByName(rows.join(first, [*u, order], "left_semi").select(rows.columns))
    from tablelog.sources.tables import pinned

    open_, kept = rows, rows.limit(0)
    while True:
        leading = open_
        for u in uniques:
            least = open_.where(all_set(u)).groupBy(*u).agg(F.min(order).alias("_least"))
            leading = leading.join(least, u, "left").where(F.col("_least").isNull() | (F.col("_least") == F.col(order))).select(rows.columns)
        leading = pinned(leading)
        kept = pinned(kept.unionByName(leading))
        rest = open_.join(leading.select(order), order, "left_anti")
        for u in uniques:
            rest = _clash(rest, kept, u, "left_anti")
        open_ = pinned(rest.select(rows.columns))
        if not open_.limit(1).count():
            return kept


def insert(table: DataFrame, rows: DataFrame, uniques: list[list[str]], policy: str = "abort", order: str = "ordinal") -> DataFrame:
    """INSERT [OR policy]: abort refuses any collision, ignore drops colliding rows, replace deletes their victims."""
    columns = table.columns
    if policy == "abort":
        for u in uniques:
            twice = rows.where(all_set(u)).groupBy(*u).count().where("count > 1")
            if _clash(rows, table, u, "left_semi").limit(1).count() or twice.limit(1).count():
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(u)}")
        return _inserted(rows, columns)
    if policy == "ignore":
        for u in uniques:
            rows = rows.join(table.where(all_set(u)).select(*u).distinct(), u, "left_anti").select(rows.columns)
        return _inserted(first_wins(rows, uniques, order), columns)
    if policy != "replace":
        raise ConstraintError(f"OR {policy.upper()} isn't supported")
    # every row deletes whatever it meets, so a row lasts unless a later one meets it
    last = rows
    for u in uniques:
        newest = rows.where(all_set(u)).groupBy(*u).agg(F.max(order).alias("_newest"))
        last = last.join(newest, u, "left").where(F.col("_newest").isNull() | (F.col("_newest") == F.col(order))).select(rows.columns)
    victims = [table.join(rows.where(all_set(u)).select(*u).distinct(), u, "left_semi").select(columns) for u in uniques]
    gone = reduce(DataFrame.unionByName, victims).dropDuplicates(uniques[0])
    b = gone.select(*(F.col(c).alias(f"k_{c}") for c in uniques[0]), _image(columns).alias("before"))
    a = last.select(*(F.col(c).alias(f"k_{c}") for c in uniques[0]), _image(columns).alias("after"))
    return b.join(a, [f"k_{c}" for c in uniques[0]], "full").select("before", "after").where(~F.col("before").eqNullSafe(F.col("after")))


def upsert(table: DataFrame, rows: DataFrame, target: list[str], sets: dict[str, str] | None = None, where: str | None = None, order: str = "ordinal") -> DataFrame:
    """INSERT .. ON CONFLICT(target) DO NOTHING, or DO UPDATE SET `sets` [WHERE].

    Expressions see the current row by its column names and the candidate as
    excluded.<column>. Candidates that share a key apply in their order, each
    upon what the one before left: an ordered fold within the key. A key's
    candidates are one statement's rows for one table row.
    """
    columns = table.columns
    if sets is None:
        fresh = _clash(rows, table, target, "left_anti")
        return _inserted(first_wins(fresh.select(rows.columns), [target], order), columns)
    keyed = rows.where(all_set(target)).groupBy(*target).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), _image(columns).alias("v")))).alias("_c"))
    joined = keyed.join(table.select(*target, _image(columns).alias("before")), target, "left")
    kind = table.select(_image(columns).alias("x")).schema["x"].dataType.simpleString()
    fields = ", ".join(f"'{f.name}', CAST({_over_row(sets[f.name], columns) if f.name in sets else f'acc.`{f.name}`'} AS {f.dataType.simpleString()})" for f in table.schema.fields)
    stay = f" WHEN NOT coalesce({_over_row(where, columns)}, false) THEN acc" if where else ""
    fold = f"aggregate(_c, CAST(before AS {kind}), (acc, c) -> CAST(CASE WHEN acc IS NULL THEN c.v{stay} ELSE named_struct({fields}) END AS {kind}))"
    done = joined.select("before", F.expr(fold).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    return done.unionByName(_inserted(rows.where(~all_set(target)), columns))


def _over_row(expression: str, columns: Sequence[str]) -> str:
    """Names of the current row and of excluded, outside string literals, as fields of the fold's variables."""
    names = "|".join(re.escape(c) for c in sorted(columns, key=len, reverse=True))
    pattern = rf"('(?:[^']|'')*')|\bexcluded\s*\.\s*(\w+)|(?<![\w.])({names})\b(?!\s*\()"
    return "(" + re.sub(pattern, lambda m: m[1] or (f"c.v.`{m[2]}`" if m[2] else f"acc.`{m[3]}`"), expression) + ")"


def update(table: DataFrame, sets: dict[str, str], where: str | None = None, source: DataFrame | None = None, on: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """UPDATE .. SET .. [FROM source] [WHERE]; all expressions see the row as it was.

    `source` columns must not share names with the table's. Where several source
    rows match a row (found by `keys`), one of them is used.
    """
    columns = table.columns
    rows = table
    if source is not None:
        rows = table.join(source, F.expr(on), "inner")
    if where is not None:
        rows = rows.where(where)
    if source is not None:
        rows = rows.dropDuplicates(keys)
    after = F.struct(*((F.expr(sets[c]).cast(table.schema[c].dataType) if c in sets else F.col(c)).alias(c) for c in columns))
    return rows.select(_image(columns).alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def delete(table: DataFrame, where: str | None = None) -> DataFrame:
    """DELETE [WHERE]; rows for which the predicate is null stay."""
    rows = table if where is None else table.where(where)
    image = _image(table.columns)
    return rows.select(image.alias("before"), F.when(F.lit(False), image).alias("after"))


def selected(table: DataFrame, where: str | None, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """The rows that a limited write touches; a negative limit is none."""
    rows = table if where is None else table.where(where)
    if order:
        rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit >= 0 else rows


def returning(changes: DataFrame, *expressions: str) -> DataFrame:
    """RETURNING: over after images, or before images of deleted rows."""
    return changes.select(F.coalesce("after", "before").alias("r")).select("r.*").selectExpr(*expressions)


def moves(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Updates that change their key: old_<column> and new_<column>."""
    both = changes.where("before IS NOT NULL AND after IS NOT NULL")
    moved = reduce(lambda a, b: a | b, (~F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}")) for k in keys))
    return both.where(moved).select(*(F.col(f"before.{k}").alias(f"old_{k}") for k in keys), *(F.col(f"after.{k}").alias(f"new_{k}") for k in keys))


#: The low 20 bits of an id count within a slot.
IDS_PER_SLOT = 1 << 20


def allocate_rowids(rows: DataFrame, column: str, device: int, slot: int, order: str) -> DataFrame:
    """Ids for rows without one: 16 bits of device, 27 of slot, 20 of offset in the rows' order.

    Numbers are given per range partition of the order and summed up across
    partitions, so no single task sorts all rows. More rows than a slot has ids
    run on into the next slots.
    """
    missing = rows.where(F.col(column).isNull()).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    from tablelog.sources.tables import pinned

    local = pinned(missing.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() % F.lit(1 << 33)))
    sizes = local.groupBy("_task").agg(F.count("*").alias("n"))
    before = sizes.select("_task", F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    high = (device << 47) | (slot << 20)
    numbered = local.join(before, "_task").withColumn(column, F.lit(high) + F.col("_before") + F.col("_row"))
    return rows.where(F.col(column).isNotNull()).unionByName(numbered.select(rows.columns))
