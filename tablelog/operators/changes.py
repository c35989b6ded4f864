"""Row-change algebra: changes are (key..., before, after) with null for "no row"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes that turn `old` into `new`: one full outer join on the keys."""
    a = old.select(*keys, F.struct(*old.columns).alias("before"))
    b = new.select(*keys, F.struct(*old.columns).alias("after"))
    return a.join(b, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def apply(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: rows whose key changes leave, after images come."""
    touched = changes.where("before IS NOT NULL").select(*(F.col(f"before.{k}").alias(k) for k in keys))
    return table.join(touched, keys, "left_anti").unionByName(changes.where("after IS NOT NULL").select("after.*").select(table.columns))


def verify(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes whose before image isn't what the table holds; none if apply() is safe."""
    held = table.select(*keys, F.struct(*table.columns).alias("held"))
    flat = changes.select("before", "after", *(F.coalesce(F.col(f"before.{k}"), F.col(f"after.{k}")).alias(k) for k in keys))
    return flat.join(held, keys, "left").where(~F.col("before").eqNullSafe(F.col("held"))).select(*keys, "before", "held")


def inverse(changes: DataFrame) -> DataFrame:
    """Changes that undo these."""
    rest = [c for c in changes.columns if c not in ("before", "after")]
    return changes.select(*rest, F.col("after").alias("before"), F.col("before").alias("after"))


def net_effect(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Ordered events (key..., order, before, after) folded to one change a key; those without effect go.

    The first before image and the last after image of a key say it all, so the
    fold is a partial aggregate and never gathers a key's events.
    """
    first = F.min_by(F.struct("before"), F.col(order))["before"]
    last = F.max_by(F.struct("after"), F.col(order))["after"]
    return events.groupBy(*keys).agg(first.alias("before"), last.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def contradictions(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Events whose before image isn't the previous after image of their key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    chained = events.withColumn("previous", F.lag(F.struct("after")).over(w))
    return chained.where("previous IS NOT NULL").where(~F.col("before").eqNullSafe(F.col("previous.after")))


def map_delta(old: DataFrame, new: DataFrame, cell: str, owner: str) -> DataFrame:
    """Ownership cells (cell, owner) to write: set where the owner is new, delete where none is left."""
    both = old.select(cell, F.col(owner).alias("was")).join(new.select(cell, F.col(owner).alias("now")), cell, "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(cell, F.when(F.col("now").isNull(), "delete").otherwise("set").alias("op"), F.col("now").alias(owner))


def prune_deletes(deletes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Point deletes (key) that no range delete (range) of the same batch covers already."""
    from tablelog.functions.keys import ancestors

    up = deletes.select("key", F.explode(ancestors(F.col("key"))).alias("range"))
    hit = up.join(ranges.select("range").distinct(), "range", "left_semi").select("key").distinct()
    return deletes.join(hit, "key", "left_anti")


def mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Audit: rows of either table, counted, that the other lacks."""
    return expected.exceptAll(actual).select("*", F.lit("missing").alias("audit")).unionByName(actual.exceptAll(expected).select("*", F.lit("extra").alias("audit")))
