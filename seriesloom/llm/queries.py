"""One query per operator over the test tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import (
    conversations,
    exact_dedup,
    language,
    licenses,
    line_dedup,
    main_text,
    merkle,
    mixing,
    ngram_join,
    packing,
    personal,
    quality,
    toxicity,
)
from seriesloom.llm.common import id_hash, table


def word_vocabulary() -> str:
    """Where a worker finds the vocabulary that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))
    return scored.select(
        "doc_id",
        (id_hash() % toxicity.FOLDS == toxicity.HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_passages"),
    )


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), word_vocabulary).drop("ids")


def op4_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.predict(docs, language.learn(docs)).select(
        "doc_id", (id_hash() % language.FOLDS == language.HELD).alias("held_out"), "lang_pred", "score"
    )


def op5_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.join(table(spark, d, "documents"))


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_documents(*mixing.mix(table(spark, d, "documents")))


def op7_main_text(spark: SparkSession, d: str) -> DataFrame:
    return main_text.extract(table(spark, d, "pages"))


def op8_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, d, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, d, "documents"))


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.judge(docs, quality.log_ratios(docs, table(spark, d, "labels")))


def op11_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return personal.scan(table(spark, d, "documents"))


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    proven = merkle.manifest(table(spark, d, "documents"), {"presented": merkle.tampered_leaf()})
    return merkle.audit(proven, "presented")


def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "conversations")
    return conversations.report(conversations.Repair(conversations.damaged(given)), given)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_toxicity, op3_packing, op4_language, op5_ngram_join,
        op6_mixing, op7_main_text, op8_line_dedup, op9_exact_dedup, op10_quality,
        op11_personal_data, op12_merkle_manifest, op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op8_line_dedup": line_dedup.oracle(),
    "op9_exact_dedup": exact_dedup.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
}
