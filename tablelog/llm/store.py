"""Tables that cut lineage: written to the folder all executors share, read back.

The folder is the one named by spark.checkpoint.dir; only where that is unset
(local tests) a folder of this machine is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/tablelog-checkpoint"
    return f"{base.rstrip('/')}/tablelog-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: computed once, safe when executors are lost, gone at the end of the application."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    system, p = _file(spark, path)
    system.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._tablelog_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_tablelog_path", None)
        if path:
            system, p = _file(t.sparkSession, path)
            system.delete(p, True)


#: Rows (of two or three short columns) up to which one side of a join is broadcast, and copies of that side beyond it.
BROADCAST_ROWS, COPIES = 1_000_000, 16


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", n: int | None = None) -> DataFrame:
    """Join of `rows` with `keyed`, one row a key and `n` in all, where any share of `rows` may have one key.

    A counted small side is broadcast; of a larger one every key is copied to
    some tasks, among which the rows of a key are dealt.
    """
    if (keyed.count() if n is None else n) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), key, how)
    dealt = rows.withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), F.lit(COPIES)))
    copied = keyed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))))
    return dealt.join(copied, [key, "_copy"], how).drop("_copy")


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of `df`; only used to choose partition counts."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Shuffle partitions that keep each one small at any input size."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(floor, min(1_000_000, size // bytes_each + 1) if size < 1 << 55 else floor)
