"""A corpus pipeline of five stages; each reads what the one before it kept.

Stages that filter return the columns of documents. A null or empty text is no
one's copy, holds no benchmark item and is not toxic; the quality rules reject
it, as they do any text under 20 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelog.llm import decontaminate, jaccard_join, packing, quality_rules, toxicity_mil
from tablelog.llm.queries import tokenizer_path
from tablelog.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; it learns from the stage's own input."""
    model = toxicity_mil.train(docs, _labels(spark, sf_dir))
    return toxicity_mil.keep_clean(docs.select(*COLUMNS), model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base nor the learned decision list rejects."""
    rules = quality_rules.fit_rules(docs, _labels(spark, sf_dir))
    return quality_rules.keep_good(docs.select(*COLUMNS), rules)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the least id.

    Rows with the same id and text are one document; rows that share only the
    id are documents of their own. Texts move only where documents repeat or
    where too many go to be broadcast; rows without id stay as they are.
    """
    document = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    docs = docs.select(*COLUMNS).withColumn("document", document)
    found = jaccard_join.jaccard_components(docs, "document")
    rest = written(found.where("component_id IS NOT NULL AND document <> component_id").select("document").distinct())
    side = F.broadcast(rest) if rest.count() <= jaccard_join.BROADCAST_IDS else rest
    some = docs.where("document IS NOT NULL")
    if some.groupBy("document").count().where("count > 1").limit(1).count():
        docs = some.dropDuplicates(["document"]).unionByName(docs.where("document IS NULL"))
    return docs.join(side, "document", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), _read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token windows."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
