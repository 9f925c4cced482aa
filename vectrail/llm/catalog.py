"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import table
from vectrail.llm.sql import SQL


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.html_blocks import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from vectrail.llm.piece_sampling import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.quality import verdicts

    return verdicts(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.topk import quantised, top_k

    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("id % 50 = 0"), rows)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from vectrail.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.pseudo_likelihood import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.negatives import hard_negatives, labelled

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return hard_negatives(rows.where("id % 100 = 0"), rows)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.conversations import damaged, repaired

    rows = table(spark, sf_dir, "conversations")
    return repaired(damaged(rows), rows.select(F.col("conv_id").alias("conv")))


def op13_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectrail.llm.piecewise import neighbours

    return neighbours(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup,
        op2_html_extraction,
        op3_sentencepiece_sampling,
        op4_quality_rules,
        op5_exact_topk,
        op6_warc,
        op7_best_fit_packing,
        op8_masked_pseudo_likelihood,
        op9_histogram_sharding,
        op10_language_id,
        op11_hard_negatives,
        op12_conversation_repair,
        op13_piecewise_fingerprints,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
