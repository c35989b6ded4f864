"""Window frames beyond ROWS and RANGE, and filtered window aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_groups(df: DataFrame, partition: list[str], order: list[str], name: str = "peer_group") -> DataFrame:
    """Numbers the peer groups; a GROUPS frame is a RANGE frame over this number."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))


def groups_between(partition: list[str], start: int, end: int, name: str = "peer_group"):
    return Window.partitionBy(*partition).orderBy(name).rangeBetween(start, end)


def sum_excluding_current(value: Column, frame) -> Column:
    """EXCLUDE CURRENT ROW for a sum over a frame that holds the row; null if nothing else is in it."""
    others = F.count(value).over(frame) - F.when(value.isNull(), 0).otherwise(1)
    return F.when(others > 0, F.sum(value).over(frame) - F.coalesce(value, F.lit(0)))


def sum_excluding_group(value: Column, frame, peers) -> Column:
    """EXCLUDE GROUP for a sum over a frame that holds all peers."""
    others = F.count(value).over(frame) - F.count(value).over(peers)
    return F.when(others > 0, F.sum(value).over(frame) - F.coalesce(F.sum(value).over(peers), F.lit(0)))


def sum_excluding_ties(value: Column, frame, peers) -> Column:
    """EXCLUDE TIES: peers go, the row itself stays."""
    rest = F.coalesce(F.sum(value).over(frame), F.lit(0)) - F.coalesce(F.sum(value).over(peers), F.lit(0)) + F.coalesce(value, F.lit(0))
    others = F.count(value).over(frame) - F.count(value).over(peers) + F.when(value.isNull(), 0).otherwise(1)
    return F.when(others > 0, rest)


def filtered(aggregate, value: Column, test: Column, window) -> Column:
    """`aggregate(value) FILTER (WHERE test) OVER window`."""
    return aggregate(F.when(test, value)).over(window)
