"""Replicas: pending work, foreign history, cursors, rebase and rollback.

A replica holds the table as its neck saw it plus its own pending changes.
pending: (txn, ordinal, before, after). foreign: (admission_seq, device, before, after).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from tablelog.operators import changes as algebra


class CursorError(Exception):
    """Cursors out of order, or a log with holes."""


@dataclass(frozen=True)
class Cursors:
    """head <= neck <= tail of a log: trimmed, applied, known."""

    head: int = 0
    neck: int = 0
    tail: int = 0

    def __post_init__(self):
        if not 0 <= self.head <= self.neck <= self.tail:
            raise CursorError(f"cursors out of order: {self.head}, {self.neck}, {self.tail}")

    def append(self, n: int) -> Cursors:
        return replace(self, tail=self.tail + n)

    def applied(self, through: int) -> Cursors:
        return replace(self, neck=through)

    def trim(self, through: int) -> Cursors:
        return replace(self, head=through)


def append_admissions(known: DataFrame, page: DataFrame, cursors: Cursors) -> tuple[DataFrame, Cursors]:
    """The incoming log after a dense page; a page that starts elsewhere or has holes is refused whole."""
    span = page.agg(F.min("admission_seq").alias("a"), F.max("admission_seq").alias("b"), F.count_distinct("admission_seq").alias("n")).first()
    if span["n"] and (span["a"] != cursors.tail + 1 or span["b"] - span["a"] + 1 != span["n"]):
        raise CursorError("the page isn't the next dense part of the log")
    return known.unionByName(page), cursors.append(span["n"])


def folded(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of (before, after) as one net change a key."""
    keyed = rows.select(order, "before", "after", *(F.coalesce(F.col(f"before.{k}"), F.col(f"after.{k}")).alias(k) for k in keys))
    return algebra.net_effect(keyed, keys, order)


def rebase(table: DataFrame, foreign: DataFrame, own_device: int, keys: list[str]) -> DataFrame:
    """The table after foreign transactions in admission order; own ones are in it already."""
    others = foreign.where(F.col("device") != own_device)
    return algebra.apply(table, folded(others, keys, "admission_seq"), keys)


def overlapping(pending: DataFrame, foreign: DataFrame, own_device: int, keys: list[str]) -> DataFrame:
    """Pending transactions that touch a row some foreign transaction touched: they must be refused and repaired."""
    place = lambda df, *rest: df.select(*rest, *(F.coalesce(F.col(f"before.{k}"), F.col(f"after.{k}")).alias(k) for k in keys))
    theirs = place(foreign.where(F.col("device") != own_device)).distinct()
    return place(pending, "txn").join(theirs, keys, "left_semi").select("txn").distinct()


def roll_back(table: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the pending changes: their net effect undone at once."""
    return algebra.apply(table, algebra.inverse(folded(pending, keys, "ordinal")), keys)


def once(submitted: DataFrame, accepted: DataFrame) -> DataFrame:
    """Submissions that weren't accepted yet, by (device, device_seq): retries change nothing."""
    return submitted.dropDuplicates(["device", "device_seq"]).join(accepted.select("device", "device_seq").distinct(), ["device", "device_seq"], "left_anti")


def reconcile(local: DataFrame, remote: DataFrame, key: str = "lease_id") -> DataFrame:
    """What a client must do about its records of leases: adopt unknown ones, forget lost ones."""
    both = local.select(key, F.lit(True).alias("here")).join(remote.select(key, F.lit(True).alias("there")), key, "full")
    return both.select(key, F.when(F.col("here").isNull(), "adopt").when(F.col("there").isNull(), "forget").otherwise("keep").alias("todo"))
