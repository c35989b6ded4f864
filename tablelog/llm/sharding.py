"""Shards of nearly equal bytes: minimax contiguous partition.

Rows with equal texts form atomic groups: they share a hash bucket, and buckets
in hash order are the ordered groups whose sizes are partitioned. Their number
is fixed, so the driver holds as many sizes for any input. The smallest
feasible shard capacity is found by binary search, each step checked greedily
over prefix sums. Within it the order is cut towards equal shards: groups over
the mean stand alone where they can, and the others share what is left.

Slots number the rows of a shard without gaps. Every task counts its own rows a
shard while it writes them; only those counts are summed up across tasks, so no
shard is ever gathered in one place.

Defined results: a null text has no bytes (size 1) and equals an empty one; a
null id stays null; repeated rows get a slot each; an empty table gives an
empty one; further columns, whatever their names, are not read. A group larger
than the mean shard makes its shard as large as itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablelog.llm.store import discard, written

BUCKETS = 1 << 18


def feasible(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (where each shard ends) under `capacity`, or None if they don't suffice."""
    at, cuts = 0, []
    last = len(prefix) - 1
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        cuts.append(at)
    return cuts if at == last else None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity under which `shards` contiguous runs hold all sizes, and the runs' ends."""
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low = max(int(sizes.max()) if len(sizes) else 0, -(-int(prefix[-1]) // shards))
    high = int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if feasible(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, feasible(prefix, low, shards) or [len(sizes)] * shards


def even_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The ends of `shards` contiguous runs, none over the smallest capacity and each as near as it can be to the mean of those left."""
    capacity, _ = minimax_cuts(sizes, shards)
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at, last, cuts = 0, len(sizes), []
    for left in range(shards, 1, -1):
        furthest = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        rest = prefix[last] - prefix[at]
        large, mean = np.zeros(0, np.int64), rest / left
        while len(over := np.flatnonzero(sizes[at:] > mean)) > len(large):
            large = over
            mean = (rest - int(sizes[at:][large].sum())) / (left - len(large))
        until = at + int(large[0]) if len(large) else last
        run = int(prefix[until] - prefix[at])
        if not run:
            cut = min(until + 1, last)
        else:
            goal = prefix[at] + run / max(1, round(run / mean))
            cut = int(np.searchsorted(prefix, goal, "right")) - 1
            if cut < until and (cut == at or prefix[cut + 1] - goal < goal - prefix[cut]):
                cut += 1
        cut = min(cut, until if run else last, furthest)
        if feasible(prefix[cut:] - prefix[cut], capacity, left - 1) is None:
            cut = furthest
        cuts.append(cut)
        at = cut
    return [*cuts, last]


def assign(documents: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = written(documents.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket")))
    sums = rows.groupBy("bucket").agg(F.sum("size").alias("size")).toArrow()
    sizes = np.zeros(BUCKETS, np.int64)
    sizes[sums.column("bucket").to_numpy()] = sums.column("size").to_numpy()
    cuts = even_cuts(sizes, shards)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, task = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        ends = np.array(cuts[:-1])
        for batch in batches:
            shard = np.searchsorted(ends, batch.column(3).to_numpy(), "right")
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
            place += used[shard]
            used += count
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard.astype(np.int32)), pa.array(np.full(len(shard), task, np.int32)), pa.array(place)], names=["id", "size", "crc", "shard", "task", "place"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = written(rows.select("id", "size", "crc", "bucket").mapInArrow(number, f"id {kind}, size long, crc long, shard int, task int, place long"))
    discard(rows)
    counts = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = counts.select("shard", "task", (F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    return placed.join(before, ["shard", "task"]).select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.coalesce("before", F.lit(0)) + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
