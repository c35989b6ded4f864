"""Incremental replay: log batches arrive as files, state follows version by version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablelog.operators.log import materialized, visible
from tablelog.sources.tables import TableStore, VersionConflict


def read_log(spark: SparkSession, path: str, like: DataFrame, files_at_once: int = 16) -> DataFrame:
    """The log folder as a stream; `files_at_once` bounds a micro-batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once_per_batch(stream: DataFrame) -> DataFrame:
    """Retried submissions dropped: a device's sequence number counts once."""
    return stream.dropDuplicates(["device", "admission_seq", "op_index"])


def materialize_into(stream: DataFrame, store: TableStore, name: str, checkpoint: str) -> StreamingQuery:
    """Keep `name` the visible state of the log so far.

    Each micro-batch commits one version that also records the batch number, so
    a batch that is run again after a failure changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        while True:
            base = store.version()
            manifest = store.manifest(base)
            if manifest["catalog"].get(f"batch:{name}", -1) >= number:
                return
            state = materialized(batch, store.read(name, base)) if name in manifest["tables"] else visible(batch)
            try:
                store.commit(base, {name: state}, {f"batch:{name}": number})
                return
            except VersionConflict:
                continue

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push(submitted: DataFrame, cursor: int, send: Callable[[list], int], most: int = 256) -> int:
    """Send the next rows after a cursor in order, at most `most` at once; returns the new cursor.

    `send` gets a page of rows and returns the last sequence number it has
    accepted, so a page whose answer was lost can be sent again.
    """
    while True:
        page = submitted.where(submitted["device_seq"] > cursor).orderBy("device_seq").limit(most).collect()
        if not page:
            return cursor
        accepted = send(page)
        if accepted <= cursor:
            return cursor
        cursor = accepted
