"""A corpus from the table ``documents``: stages that each apply one operator of tillcast.llm.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import jaccard, mixing, packing, quality, secrets
from tillcast.llm.queries import (
    MIX_SHARE,
    MOST_REPEATS,
    SEQUENCE_TOKENS,
    SOURCE_WEIGHTS,
    table,
    vocabulary,
)
from tillcast.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs.select(COLUMNS))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id (no id comes last); of rows
    with that id, one. Documents without words are no copies of each other and stay.

    Ids may be null, repeated or shared by different texts, so rows are told apart by a number,
    which is written with them to stay the same."""
    number = F.monotonically_increasing_id().alias("number")
    rows = materialize(docs.select(*COLUMNS, number), "pipeline-rows")
    classes = materialize(
        jaccard.jaccard_classes(rows.select("number", "text"), id="number"), "pipeline-classes"
    )
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "number")
    first = (
        rows.select("doc_id", "number")
        .join(classes, "number")
        .groupBy("component_id")
        .agg(F.min_by("number", place).alias("number"))
    )
    copies = materialize(
        classes.select("number").join(first, "number", "left_anti"), "pipeline-copies"
    )
    return rows.join(copies, "number", "left_anti").select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the new text."""
    clean = secrets.redact(secrets.scan_secrets(docs.select(COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its words taken over its size, rounded."""
    mixed = mixing.mix_sources(docs.select(COLUMNS), SOURCE_WEIGHTS, MIX_SHARE, MOST_REPEATS)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    repeated = mixed.select("row", F.explode(F.array_repeat(F.lit(True), times)).alias("once"))
    return repeated.select(*(F.col("row")[c].alias(c) for c in COLUMNS))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack_documents(docs, vocabulary(), SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_documents),
    ("ngram_jaccard_join", distinct_documents),
    ("secret_scans", without_secrets),
    ("source_mixing", mixed_documents),
    ("best_fit_packing", packed_documents),
]

#: SQL has neither the tokenizer nor the forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
