"""A bounded sample of labelled rows for the classifiers, never from the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_column: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out, a null id has null."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(c.cast("string")) % 5


def sample_ids(labels: DataFrame, column: str, per_class: int, id_column: str = "doc_id") -> DataFrame:
    """At most `per_class` labelled ids a class, those of the least hashes, so the same at every run.

    Rows without id or label, and those of the held-out fold, are left out; an
    id with unlike labels has the larger one.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(column).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id") != 0)).groupBy("id").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_rows(documents: DataFrame, labels: DataFrame, column: str, per_class: int, most_bytes: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, y) of the sample; the broadcast side holds 2 * per_class ids at most.

    `most_bytes` leaves longer texts out of the sample, so its total size is bounded.
    """
    docs = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    if most_bytes is not None:
        docs = docs.where(F.octet_length("text") <= most_bytes)
    return docs.join(F.broadcast(sample_ids(labels, column, per_class, id_column)), "id")
