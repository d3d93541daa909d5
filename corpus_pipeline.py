"""A corpus pipeline from raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and gives it to the next stage, so a lost executor re-reads files. All
stages but the last return the columns of ``documents``, and any further columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.llm import language, line_dedup, mixing, ngram_join, packing
from seriesloom.llm.common import shielded, small_batches, table
from seriesloom.llm.queries import word_vocabulary
from seriesloom.sources.panels import stage


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(step: Stage) -> Stage:
    """A stage whose texts go between the JVM and Python in batches of bounded bytes, since all stages share the executors."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return step(spark, docs, sf_dir)

    return run_step


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null, empty or without a letter) go."""

    def work(inner: DataFrame) -> DataFrame:
        profiles = language.learn(inner)
        if not profiles:  # no usable label: nothing can be said but whether there is a letter
            return inner.filter(F.col("text").rlike(r"\p{L}"))
        found = language.predict(inner, profiles, keep=inner.columns)
        return found.filter(F.col("lang_pred") != language.UNKNOWN)

    return shielded(docs, work)


@in_small_batches
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; a document of repeated lines only stays with an empty text."""

    def work(inner: DataFrame) -> DataFrame:
        done = line_dedup.deduplicate(inner, keep=inner.columns)
        made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(inner.schema["n_chars"].dataType)}
        return done.select(*[made[c].alias(c) if c in made else F.col(c) for c in inner.columns])

    return shielded(docs, work)


@in_small_batches
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class stays; rows without a doc_id stay.

    Rows that share a doc_id are one document: of them the row whose text comes first stays.
    """

    def work(inner: DataFrame) -> DataFrame:
        classes = ngram_join.join(inner)
        first = classes.filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
        order = Window.partitionBy("doc_id").orderBy("text")
        stay = inner.join(first, "doc_id", "left_semi").withColumn("copy", F.row_number().over(order)).filter("copy = 1")
        return stay.select(*inner.columns).unionByName(inner.filter(F.col("doc_id").isNull()))

    return shielded(docs, work)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts cut and repeated as the mix of sources takes them."""
    return mixing.mixed_texts(docs, mixing.mix(docs)[1])


@in_small_batches
def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences."""
    return packing.pack(docs, word_vocabulary).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

# Learned profiles, permutations and tokenization are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
