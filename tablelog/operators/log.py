"""The admission log and what follows from it: visibility, history, heads, floors.

A log row is (admission_seq, op_index, device, ver, op, key, range, value); op is
set, delete or range_delete. A range delete has the prefix it covers in `range`,
the empty array for everything. Rows are ordered by (admission_seq, op_index).

Covering range deletes are found by an equi-join: the distinct keys explode into
their ancestors and meet the latest delete of each prefix. So the cost follows
keys times depth, never keys times deletes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelog.functions.keys import ancestors, covers_key, overlaps

ORDER = ["admission_seq", "op_index"]


def _order() -> Column:
    return F.struct(*ORDER)


def through(log: DataFrame, cut: int | None) -> DataFrame:
    return log if cut is None else log.where(F.col("admission_seq") <= cut)


def _covered(log: DataFrame, keyed: DataFrame, what: Column, name: str) -> DataFrame:
    """`keyed` (one row a key) with the greatest `what` of the range deletes that cover its key, else null.

    The empty prefix covers every key, so it would be one hot key of the join:
    its greatest `what` is a single value and comes as a scalar subquery.
    """
    deletes = log.where("op = 'range_delete'")
    everything = deletes.where(F.size("range") == 0).agg(what.alias(name)).scalar()
    per_prefix = deletes.where(F.size("range") > 0).groupBy(F.col("range").alias("prefix")).agg(what.alias(name))
    up = keyed.select("key", F.explode(ancestors(F.col("key"))).alias("prefix")).where(F.size("prefix") > 0)
    met = up.join(per_prefix, "prefix").groupBy("key").agg(F.max(name).alias(name))
    return keyed.join(met, "key", "left").withColumn(name, F.greatest(F.col(name), everything))


def newest_points(log: DataFrame) -> DataFrame:
    """The newest set or delete of every key."""
    points = log.where("op <> 'range_delete'")
    newest = points.groupBy("key").agg(F.max_by(F.struct("op", "device", "ver", "value"), _order()).alias("p"), F.max(_order()).alias("at"))
    return newest.select("key", "at", "p.*")


def visible(log: DataFrame, cut: int | None = None) -> DataFrame:
    """(key, value, device, ver, admission_seq) of every live key at the cut."""
    log = through(log, cut)
    rows = _covered(log, newest_points(log).where("op = 'set'"), F.max(_order()), "covered")
    return rows.where("covered IS NULL OR at > covered").select("key", "value", "device", "ver", F.col("at.admission_seq").alias("admission_seq"))


def get(log: DataFrame, keys: DataFrame, cut: int | None = None) -> DataFrame:
    """The requested keys with their live value, null where there is none."""
    log = through(log, cut)
    asked = keys.select("key").distinct()
    mine = log.where("op = 'range_delete'").unionByName(log.where("op <> 'range_delete'").join(asked, "key", "left_semi"))
    return asked.join(visible(mine).select("key", "value"), "key", "left")


def under(prefix: list | None, key: Column) -> Column:
    """Whether `key` lies under a literal prefix; each component is a plain comparison that can be pushed down."""
    out = F.lit(True)
    for k, part in enumerate(prefix or []):
        out = out & (F.size(key) > k) & (F.get(key, F.lit(k)) == F.lit(part))
    return out


def list_page(log: DataFrame, prefix: list | None, start_after: list | None, limit: int, cut: int | None = None) -> DataFrame:
    """Live keys under the prefix in key order, after `start_after`; one row more than shown tells `truncated`.

    Hidden records never count against the limit.
    """
    key = F.col("key")
    rows = visible(log.where((F.col("op") == "range_delete") | under(prefix, key)), cut).where(under(prefix, key))
    if start_after is not None:
        rows = rows.where(key > F.array(*(F.lit(x) for x in start_after)))
    page = rows.orderBy("key").limit(limit + 1)
    numbered = page.withColumn("row", F.row_number().over(Window.orderBy("key")))  # limit + 1 rows
    return numbered.withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).where(F.col("row") <= limit).select("key", "value", "ver", "truncated")


def relevant(prefix: list | None) -> Column:
    """Whether a log row matters to readers of a literal prefix."""
    p = F.array(*(F.lit(x) for x in prefix)) if prefix else F.lit([]).cast("array<string>")
    return F.when(F.col("op") == "range_delete", overlaps(p, F.col("range"))).otherwise(covers_key(p, F.col("key")))


def delta(log: DataFrame, prefix: list | None, since: int, cut: int) -> DataFrame:
    """History under a prefix in (since, cut], repeats and tombstones included."""
    return log.where((F.col("admission_seq") > since) & (F.col("admission_seq") <= cut) & relevant(prefix))


def pull(log: DataFrame, after: int, most: int) -> DataFrame:
    """The next `most` batches after a cursor, whole and in order."""
    return log.where((F.col("admission_seq") > after) & (F.col("admission_seq") <= after + most)).orderBy(*ORDER)


def gaps(log: DataFrame) -> DataFrame:
    """Admission numbers that are missing before a present one; an exact log has none."""
    seqs = log.select("admission_seq").distinct()
    wanted = seqs.select((F.col("admission_seq") - 1).alias("admission_seq")).where("admission_seq > 0")
    return wanted.join(seqs, "admission_seq", "left_anti").select(F.col("admission_seq").alias("last_missing"))


def live_counts(log: DataFrame, cut: int | None = None, depth: int | None = None) -> DataFrame:
    """Live keys under every prefix that has any, the empty prefix included; `depth` limits the prefixes' length."""
    up = visible(log, cut).select(F.explode(ancestors(F.col("key"))).alias("prefix"))
    if depth is not None:
        up = up.where(F.size("prefix") <= depth)
    return up.groupBy("prefix").agg(F.count("*").alias("live"))


def heads(log: DataFrame, depth: int) -> DataFrame:
    """Per prefix of that depth the two newest devices: (prefix, device, head, place)."""
    point = log.where("op <> 'range_delete'").where(F.size("key") >= depth).select(F.slice("key", 1, depth).alias("prefix"), "device", "admission_seq")
    spans = log.where("op = 'range_delete'").where(F.size("range") >= depth).select(F.slice("range", 1, depth).alias("prefix"), "device", "admission_seq")
    newest = point.unionByName(spans).groupBy("prefix", "device").agg(F.max("admission_seq").alias("head"))
    w = Window.partitionBy("prefix").orderBy(F.desc("head"), "device")
    return newest.withColumn("place", F.row_number().over(w)).where("place <= 2")


def version_floors(log: DataFrame) -> DataFrame:
    """Per key the greatest version of its own points and of the range deletes that cover it."""
    points = log.where("op <> 'range_delete'").groupBy("key").agg(F.max("ver").alias("own"))
    return _covered(log, points, F.max("ver"), "cover").select("key", F.greatest("own", "cover").alias("floor"))


def foreign_max(log: DataFrame, asserts: DataFrame) -> DataFrame:
    """Range assertions (assert_id, device, prefix, upto) that a later write of another device breaks.

    A write meets an assertion if either covers the other: writes explode into
    ancestors to meet wider assertions, assertions explode to meet wider range
    deletes. Both are pre-aggregated per prefix and device.
    """
    where = F.when(F.col("op") == "range_delete", F.col("range")).otherwise(F.col("key"))
    writes = log.select(where.alias("place"), "device", "admission_seq", (F.col("op") == "range_delete").alias("wide")).groupBy("place", "device", "wide").agg(F.max("admission_seq").alias("seq"))
    below = writes.select(F.explode(ancestors(F.col("place"))).alias("prefix"), "device", "seq").groupBy("prefix", "device").agg(F.max("seq").alias("seq"))
    a = asserts.select("assert_id", F.col("device").alias("mine"), "prefix", "upto")
    inner = a.join(below, "prefix").where("device <> mine").select("assert_id", "seq")
    above = writes.where("wide").select(F.col("place").alias("up"), "device", "seq")
    outer = a.select("assert_id", "mine", F.explode(ancestors(F.col("prefix"))).alias("up")).join(above, "up").where("device <> mine").select("assert_id", "seq")
    newest = inner.unionByName(outer).groupBy("assert_id").agg(F.max("seq").alias("seq"))
    return asserts.join(newest, "assert_id").where("seq > upto").select("assert_id", F.col("seq").alias("foreign_seq"))


def materialized(changes: DataFrame, state: DataFrame) -> DataFrame:
    """A later state from an earlier one and the log since: replay equals materialization."""
    log = state.select("admission_seq", F.lit(0).alias("op_index"), "device", "ver", F.lit("set").alias("op"), "key", F.lit(None).cast(changes.schema["range"].dataType).alias("range"), "value")
    return visible(log.unionByName(changes.select(log.columns)))


def checksum_chain(log: DataFrame) -> DataFrame:
    """Per device the chained digest over its batches: each link hashes the one before with the batch's content."""
    row = F.concat_ws("|", F.col("op"), F.array_join(F.coalesce("key", "range").cast("array<string>"), "/"), F.coalesce(F.col("value").cast("string"), F.lit("")), F.col("ver").cast("string"))
    batch = log.groupBy("device", "admission_seq").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_index", row.alias("row")))), lambda x: x["row"]), ";"), 256).alias("content"))
    chain = F.array_sort(F.collect_list(F.struct("admission_seq", "content")))
    return batch.groupBy("device").agg(F.aggregate(chain, F.lit("0" * 64), lambda acc, x: F.sha2(F.concat(acc, x["content"]), 256)).alias("checksum"), F.count("*").alias("batches"))
