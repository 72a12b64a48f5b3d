"""The registered query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annsearch, decontam, hardneg, htmltext, langid, lexsearch, mixing, neardup, pieces, pii, secrets, sharding, urlblock


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents")).drop("redacted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlblock.judge(_table(spark, sf_dir, "pages"), urlblock.rule_table(spark))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.search(_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_language_id,
        op3_sentencepiece,
        op4_html_extraction,
        op5_pii,
        op6_decontamination,
        op7_minhash_near_dedup,
        op8_sharding,
        op9_url_filter,
        op10_nearest_neighbours,
        op11_hard_negatives,
        op12_lexical_search,
        op13_source_mix,
    )
}
ORACLES: dict[str, str] = {"op6_decontamination": decontam.ORACLE, "op9_url_filter": urlblock.ORACLE, "op11_hard_negatives": hardneg.ORACLE, "op12_lexical_search": lexsearch.ORACLE, "op13_source_mix": mixing.ORACLE}
