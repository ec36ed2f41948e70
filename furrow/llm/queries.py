"""The operators on their whole tables, with production parameters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import (collocations, conversation_repair, decontamination, language_id, licenses, lm_score,
                        near_duplicates, order_minhash, packing, quality_model, quality_rules, token_counts, toxicity)
from furrow.llm.common import table
from furrow.llm.oracles import ORACLES  # noqa: F401
from furrow.session import ship_by_value

DEFAULT_VOCABULARY = "byte_bpe_50k.json"


@functools.lru_cache(1)
def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_VOCABULARY)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary_path(), 1024)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.digest(table(spark, folder, "documents"))


def repository_path() -> F.Column:
    """Documents laid out as files: short texts that name a licence are licence
    files, the shortest of them one directory higher."""
    top = F.concat(F.coalesce("source", F.lit("none")), F.lit("/d"), F.expr("doc_id DIV 1000").cast("string"))
    leaf = F.concat(top, F.lit("/d"), F.expr("doc_id DIV 50").cast("string"))
    names_one = F.lower("text").rlike(licenses.TRIGGER)
    return (F.when(names_one & (F.length("text") < 200), F.concat(top, F.lit("/LICENSE")))
            .when(names_one & (F.length("text") < 400), F.concat(leaf, F.lit("/LICENSE")))
            .otherwise(F.concat(leaf, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licenses.scan(docs.select("doc_id", "text", repository_path().alias("path")))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), vocabulary_path(), 512)


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return lm_score.score_documents(table(spark, folder, "documents"), good)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.predict_documents(table(spark, folder, "documents"))


def op11_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.compare_with_next(table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, folder, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_toxicity, op3_decontamination, op4_quality_rules, op5_license_scan,
    op6_token_counts, op7_minhash_near_dedup, op8_quality_classifier, op9_lm_scoring, op10_language_id,
    op11_order_minhash, op12_collocations, op13_conversation_repair)}

ship_by_value(__name__)
