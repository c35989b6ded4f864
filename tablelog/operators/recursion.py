"""Recursive queries with set semantics, and ordered group commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelog.operators.coordination import conflicts
from tablelog.sources.tables import pinned


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """WITH RECURSIVE .. UNION: rows reached from the seed, each once; a round extends only what was new."""
    found = pinned(seed.distinct())
    new = found
    while new.limit(1).count():
        new = pinned(step(new).distinct().subtract(found))
        found = pinned(found.unionByName(new))
    return found


def group_commit(proposals: DataFrame, footprints: DataFrame, history: DataFrame, most: int = 32, writes: DataFrame | None = None) -> DataFrame:
    """(txn, place, group, refused): proposals of each space in order, `most` to a group.

    Refused are those that committed history breaks, then, in order, those that
    writes of an earlier accepted proposal of their space break: of their own
    group always, of an earlier group if its commit is past their frontier. The
    groups commit after all history, each that accepts any under the next number.
    A transaction proposed again after it was accepted stays accepted. `writes`
    (txn, region, wide) are what a transaction changes; by default its write
    prefixes. The order of a space is one task's loop; its rows stream, and what
    it holds are the regions accepted.
    """
    if writes is None:
        writes = footprints.where("kind = 'write'").select("txn", F.col("prefix").alias("region"), F.lit(False).alias("wide"))
    broken = conflicts(footprints, history).select("txn", F.lit(True).alias("broken"))
    asserted = footprints.groupBy("txn").agg(F.collect_list(F.struct("prefix", "frontier")).alias("asserted"))
    written = writes.groupBy("txn").agg(F.collect_list(F.struct("region", "wide")).alias("written"))
    last = history.agg(F.coalesce(F.max("commit_seq"), F.lit(0)).cast("long").alias("last"))
    rows = proposals.select("txn", "space", "arrival").join(broken, "txn", "left").join(asserted, "txn", "left").join(written, "txn", "left").crossJoin(F.broadcast(last))
    ordered = rows.repartition("space").sortWithinPartitions("space", "arrival", "txn").select("txn", "space", "broken", "asserted", "written", "last")
    kind = proposals.schema["txn"].dataType.simpleString()

    def validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, place = object(), 0
        for batch in batches:
            places, refusals = [], []
            for r in batch.to_pylist():
                if r["space"] != space:
                    space, place, seq, committed = r["space"], 0, r["last"] + 1, False
                    accepted: set = set()
                    under: dict[tuple, int] = {}  # the newest commit of a region at or below a prefix
                    wide: dict[tuple, int] = {}  # the newest commit of a wide region
                if place % most == 0 and committed:
                    seq, committed = seq + 1, False
                place += 1
                refused = False
                if r["txn"] not in accepted:
                    refused = bool(r["broken"])
                    for a in () if refused else r["asserted"] or ():
                        if a["prefix"] is None:
                            continue
                        prefix = tuple(a["prefix"])
                        newest = max(under.get(prefix, 0), *(wide.get(prefix[:k], 0) for k in range(len(prefix) + 1)))
                        if newest and (newest == seq or a["frontier"] is not None and newest > a["frontier"]):
                            refused = True
                            break
                    if not refused:
                        committed = True
                        accepted.add(r["txn"])
                        for w in r["written"] or ():
                            if w["region"] is None:
                                continue
                            region = tuple(w["region"])
                            for k in range(len(region) + 1):
                                under[region[:k]] = seq
                            if w["wide"]:
                                wide[region] = seq
                places.append(place)
                refusals.append(refused)
            at = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), at, pa.array([(p - 1) // most for p in places], pa.int64()), pa.array(refusals, pa.bool_())], names=["txn", "place", "group", "refused"])

    return ordered.mapInArrow(validate, f"txn {kind}, place int, `group` long, refused boolean")
