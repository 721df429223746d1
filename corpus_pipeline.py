"""A training corpus from the documents table: five stages, each one operator over all that the stage before kept.

Every stage's result is written as Parquet in the shared folder and read again by the next, so a lost executor
costs no finished stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.llm import bpe, decontam, simhash, substring, toxicity
from docsleuth.llm.common import shared_dir, table, unused, written


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is in ids; rows without an id stay."""
    own = unused(docs, "id")
    return docs.join(ids.withColumnRenamed("doc_id", own), F.col("doc_id") == F.col(own), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in ids; rows without an id stay."""
    own = unused(docs, "id")
    return docs.join(ids.withColumnRenamed("doc_id", own), F.col("doc_id") == F.col(own), "left_anti")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is at least one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.scored(docs, model).where("predicted = 1").select("doc_id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id."""
    found = simhash.near_duplicates(docs)
    return _only(docs, found.where("doc_id = component_id").select("doc_id").distinct())


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each repeated passage in its first document only; n_chars follows the text."""
    kept = substring.deduplicated(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the contract's rule calls contaminated."""
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(decontam.contaminated(found)).select("doc_id"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, with the digests of ids and decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_each_group),
    ("substring", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: The field of the first stage is fitted iteratively, which SQL can't express; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{base}/{k}-{name}")
    return docs
