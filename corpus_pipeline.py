"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

Stages return the columns of ``documents``, the last one token ids. Extra columns are carried
along. Every stage's module says what it makes of null, empty, long and repeated texts; rows
without doc_id are never dropped as duplicates or leaks of others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontam, langid, neardup, pieces, pii
from lexiloom.llm.scratch import Scratch, free_names

#: Ids that are broadcast to take documents out; beyond it the join is shuffled.
BROADCAST_IDS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Null texts and texts without a letter have none and go."""
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its five-word shingles: the one with the smallest doc_id.

    Rows that share a doc_id are kept or go together; of those with equal texts one stays, the
    first by its columns written as JSON.
    """
    scratch = Scratch(spark, "pipeline")
    judged = scratch.save(neardup.near_duplicates(docs, words=5, percent=80).select("doc_id", "kept"))
    gone, again = free_names(docs, "gone", "again")
    out = judged.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    few = out.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(out) if few else out, docs["doc_id"].cast("long") == F.col(gone), "left_anti")
    repeated = judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    if repeated.isEmpty():
        return kept
    several = kept["doc_id"].cast("long") == F.col(again)
    row = F.struct(*[kept[c] for c in docs.columns])
    first = kept.join(repeated, several, "left_semi").groupBy(kept["doc_id"], kept["text"]).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.join(repeated, several, "left_anti").unionByName(first.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars of the new text."""
    return pii.redact_documents(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("tokenization", tokenization),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        before, docs = docs, scratch.save(made)
        scratch.drop(before)
    return docs


#: SQL cannot express the language model's and the tokenizer's stages; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None
