"""An ordered key-value store as a versioned table sorted by encoded key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelog.functions.keys import encode
from tablelog.sources.tables import TableStore

SCHEMA = "key array<binary>, value binary"


class OrderedStore:
    """get, scan, scan_prefix and atomic apply; files are range-sorted, so scans skip row groups by the flat key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, TableStore(spark, root)
        if "cells" not in self.store.tables():
            self.store.commit(self.store.version(), {"cells": self._flat(spark.createDataFrame([], SCHEMA))})

    @staticmethod
    def _flat(rows: DataFrame) -> DataFrame:
        return rows.select("key", "value", encode(F.col("key")).alias("flat"))

    def cells(self, version: int | None = None) -> DataFrame:
        return self.store.read("cells", version)

    def get(self, key: list[bytes]) -> DataFrame:
        return self.cells().where(F.col("flat") == self._encoded(key)).select("key", "value")

    def scan(self, start: list[bytes] | None, end: list[bytes] | None) -> DataFrame:
        """Cells with start <= key < end, in key order."""
        rows = self.cells()
        if start is not None:
            rows = rows.where(F.col("flat") >= self._encoded(start))
        if end is not None:
            rows = rows.where(F.col("flat") < self._encoded(end))
        return rows.orderBy("flat").select("key", "value")

    def scan_prefix(self, prefix: list[bytes]) -> DataFrame:
        """Cells whose key begins with all components of `prefix`, in key order."""
        return self.cells().where(F.startswith(F.col("flat"), self._encoded(prefix))).orderBy("flat").select("key", "value")

    def _encoded(self, key: list[bytes]) -> Column:
        """The flat key as a literal."""
        return F.lit(b"".join(c.replace(b"\x00", b"\x00\x01") + b"\x00\x00" for c in key))

    def apply(self, batch: DataFrame) -> int:
        """Writes (key, value) rows at once; a null value deletes, the last row of a key counts by `ordinal`. Returns the version."""
        base = self.store.version()
        last = batch.groupBy("key").agg(F.max_by(F.struct("value"), "ordinal")["value"].alias("value"))
        kept = self.cells(base).select("key", "value").join(last.select("key"), "key", "left_anti")
        new = self._flat(kept.unionByName(last.where("value IS NOT NULL")))
        return self.store.commit(base, {"cells": new.repartitionByRange("flat").sortWithinPartitions("flat")})
