"""Leases, footprints, conflicts and admission checks as joins over prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelog.functions.keys import ancestors, covers_key, overlaps


def _meets(a: DataFrame, b: DataFrame, a_prefix: str, b_prefix: str) -> DataFrame:
    """Pairs whose prefixes overlap: either is the other's ancestor, found by two equi-joins; equal ones only once."""
    a_up = a.withColumn("_up", F.explode(ancestors(F.col(a_prefix))))
    b_up = b.withColumn("_up", F.explode(ancestors(F.col(b_prefix)))).where(F.size("_up") < F.size(b_prefix))
    return a_up.join(b.withColumn("_up", F.col(b_prefix)), "_up").drop("_up").unionByName(a.withColumn("_up", F.col(a_prefix)).join(b_up, "_up").drop("_up"))


def _strongest(leases: DataFrame, now: int) -> DataFrame:
    """Of each prefix and mode the last live lease of the two holders that hold it longest.

    Whoever asks, the longest lease of another holder is one of the two. So a
    request meets at most two leases a prefix and mode, however many there are.
    """
    last = leases.where(F.col("deadline") > now).groupBy("lease_prefix", "lease_mode", "holder").agg(F.max("deadline").alias("deadline"))
    place = F.row_number().over(Window.partitionBy("lease_prefix", "lease_mode").orderBy(F.desc("deadline"), "holder"))
    return last.withColumn("_place", place).where("_place <= 2").drop("_place")


def lease_conflicts(requests: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """(request_id, retry_after): requests that a live lease of another device bars; two reads never bar each other.

    requests: request_id, device, mode, prefix. leases: lease_id, holder, lease_mode, lease_prefix, deadline.
    """
    met = _meets(requests, _strongest(leases, now), "prefix", "lease_prefix").where("device <> holder AND NOT (mode = 'read' AND lease_mode = 'read')")
    return met.groupBy("request_id").agg(F.max("deadline").alias("retry_after"))


def acquire(requests: DataFrame, leases: DataFrame, now: int, ttl: int) -> DataFrame:
    """Leases granted to requests that nothing bars; a device's requests are granted all or none."""
    barred = requests.join(lease_conflicts(requests, leases, now).select("request_id"), "request_id", "left_semi").select("device").distinct()
    return requests.join(barred, "device", "left_anti").select(F.col("request_id").alias("lease_id"), F.col("device").alias("holder"), F.col("mode").alias("lease_mode"), F.col("prefix").alias("lease_prefix"), (F.lit(now) + ttl).alias("deadline"))


def renew(leases: DataFrame, asked: DataFrame, now: int, ttl: int) -> DataFrame:
    """(lease_id, deadline, valid) of asked (lease_id, device): live and own leases get a new deadline."""
    found = asked.join(leases, "lease_id", "left")
    good = (F.col("holder") == F.col("device")) & (F.col("deadline") > now)
    return found.select("lease_id", F.when(good, F.lit(now) + ttl).alias("deadline"), F.coalesce(good, F.lit(False)).alias("valid"))


def release(leases: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Leases that remain: the owner releases its own, expired ones go; asking twice is harmless."""
    gone = asked.select("lease_id", F.col("device").alias("holder"))
    return leases.join(gone, ["lease_id", "holder"], "left_anti").where(F.col("deadline") > now)


def held_by(leases: DataFrame, device, now: int) -> DataFrame:
    return leases.where((F.col("holder") == device) & (F.col("deadline") > now))


def barred_writes(writes: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """Writes (write_id, device, prefix, wide) that a live lease of another device covers; wide writes also meet narrower leases."""
    live = leases.where(F.col("deadline") > now).groupBy("lease_prefix").agg(F.min("holder").alias("first"), F.max("holder").alias("last"))
    met = _meets(writes, live, "prefix", "lease_prefix").where("device <> first OR device <> last")
    return met.where(F.col("wide") | covers_key(F.col("lease_prefix"), F.col("prefix"))).select("write_id").distinct()


def usable(leases: DataFrame, neck: int, now: int, ttl: int) -> DataFrame:
    """Leases a client may rely on: not forgotten, past their barrier, and live by a safety margin."""
    return leases.where(~F.col("forgotten") & (F.lit(neck) > F.col("barrier")) & (F.col("deadline") > now + max(ttl // 1000, 10)))


def antichain(prefixes: DataFrame) -> DataFrame:
    """Prefixes (txn, prefix) that no other prefix of their transaction covers."""
    own = prefixes.distinct()
    up = own.select("txn", "prefix", F.explode(ancestors(F.col("prefix"))).alias("up")).where(F.size("up") < F.size("prefix"))
    covered = up.join(own.select("txn", F.col("prefix").alias("up")), ["txn", "up"], "left_semi").select("txn", "prefix").distinct()
    return own.join(covered, ["txn", "prefix"], "left_anti")


def conflicts(footprints: DataFrame, history: DataFrame, serializable: bool = True) -> DataFrame:
    """Transactions (txn, kind, prefix, frontier) that a later commit of another breaks.

    history: commit_seq, writer, region, wide. Reads count under serializable only.
    A commit meets a prefix at or above its region, a wide one also those below.
    """
    mine = footprints if serializable else footprints.where("kind <> 'read'")
    asked = mine.select("txn", "frontier", F.col("prefix").alias("place"))
    below = asked.select("txn", "frontier", F.explode(ancestors(F.col("place"))).alias("up"), "place").where(F.size("up") < F.size("place")).select("txn", "frontier", F.col("up").alias("place"))
    commits = history.select("commit_seq", "writer", F.explode(ancestors(F.col("region"))).alias("place"))
    spread = history.where("wide").select("commit_seq", "writer", F.col("region").alias("place"))
    return _first_after(asked, commits).unionByName(_first_after(below, spread)).groupBy("txn").agg(F.min("commit_seq").alias("first_conflict"))


def _first_after(asked: DataFrame, commits: DataFrame) -> DataFrame:
    """(txn, commit_seq): the first commit at each place past the frontier that another than the transaction wrote.

    An as-of lookup instead of a join: places are read from the newest commit
    back, so it costs a sort of both sides, never their product. That first
    commit is the next one, or, where the transaction wrote it itself, the next
    one by another writer.
    """
    commits = commits.join(asked.select("place").distinct(), "place", "left_semi").select("place", "commit_seq", "writer").distinct()
    newest = Window.partitionBy("place").orderBy(F.desc("commit_seq"), "writer")
    starts = F.lag("writer").over(newest) != F.col("writer")  # of the next commit, where another wrote it
    known = commits.withColumn("_next", F.lag("commit_seq").over(newest)).withColumn("_turn", F.when(starts, F.col("_next")))
    other = F.last("_turn", ignorenulls=True).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = known.select("place", F.col("commit_seq").alias("_at"), F.lit(0).alias("_asks"), F.struct("commit_seq", "writer", other.alias("other")).alias("_commit"), F.lit(None).cast(asked.schema["txn"].dataType).alias("txn"))
    asks = asked.select("place", F.col("frontier").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast(rows.schema["_commit"].dataType).alias("_commit"), "txn")
    back = Window.partitionBy("place").orderBy(F.desc("_at"), F.desc("_asks"), "_commit.writer").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.unionByName(asks).withColumn("_commit", F.last("_commit", ignorenulls=True).over(back)).where("_asks = 1 AND _commit IS NOT NULL")
    return found.select("txn", F.when(F.col("_commit.writer") != F.col("txn"), F.col("_commit.commit_seq")).otherwise(F.col("_commit.other")).alias("commit_seq")).where("commit_seq IS NOT NULL")


def prune_history(history: DataFrame, oldest_pin: int) -> DataFrame:
    return history.where(F.col("commit_seq") > oldest_pin)


def admission_errors(batches: DataFrame, high_water: DataFrame, floors: DataFrame) -> DataFrame:
    """Reasons to refuse batches: (device, device_seq, reason); none means that all are admitted.

    batches: device, device_seq, key, ver. high_water: device, last_seq. floors: key, floor.
    A replayed batch is no error but is not admitted again.
    """
    heads = batches.groupBy("device").agg(F.min("device_seq").alias("first"), F.count_distinct("device_seq").alias("n"), F.max("device_seq").alias("last")).join(high_water, "device", "left")
    at = F.coalesce("last_seq", F.lit(0))
    holes = heads.where((F.col("first") > at + 1) | (F.col("last") - F.col("first") + 1 != F.col("n"))).select("device", F.col("first").alias("device_seq"), F.lit("sequence gap").alias("reason"))
    stale = batches.join(high_water, "device", "left").where(F.col("device_seq") > at).join(floors, "key").where("ver <= floor").select("device", "device_seq", F.lit("version regression").alias("reason"))
    return holes.unionByName(stale).distinct()


def clipped(scope: Column, region: Column) -> Column:
    """What of a range delete a reader of `scope` must apply; null where they don't overlap."""
    return F.when(overlaps(scope, region), F.when(covers_key(scope, region), region).otherwise(scope))
