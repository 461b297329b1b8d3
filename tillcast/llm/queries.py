"""The registered queries of this subpackage: its operators on the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import (
    chat,
    codes,
    jaccard,
    lexical,
    mixing,
    packing,
    ppm,
    quality,
    repeats,
    secrets,
    sharding,
    tokens,
    topk,
)

#: Production parameters.
VOCABULARY = "word_bpe_49k.json"
MOST_TOKENS, SEQUENCE_TOKENS = 2048, 4096
SHARDS = 16
SOURCE_WEIGHTS, MIX_SHARE, MOST_REPEATS = (5.0, 2.0, 1.0), 1.5, 2.0
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    made = chat.format_chats(turns.unionByName(added)).withColumn(
        "turns", chat.read_turns(F.col("formatted"))
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned: Column = chat.loss_text(F.col("segments"))
    return made.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "complete",
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), size=5, percent=75)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), MOST_TOKENS)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), SEQUENCE_TOKENS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"))
    return judged.drop("rejected_by")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    each = found.select("row.doc_id", F.explode_outer("findings").alias("f"))
    return each.filter("f IS NOT NULL").select(
        "doc_id",
        F.col("f.place").cast("bigint").alias("place"),
        F.length("f.text").cast("bigint").alias("length"),
        F.sha2("f.text", 256).alias("finding_sha256"),
        "f.probability",
        "f.is_secret",
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(
        table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, MIX_SHARE, MOST_REPEATS, keep=["doc_id"]
    )
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_records(table(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("row.text", F.lit(""))
    return dealt.select(
        "row.doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(
        table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10
    )


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50).drop("kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_ngram_jaccard_join, op3_token_counts, op4_exact_topk,
        op5_best_fit_packing, op6_quality_rules, op7_lm_scoring, op8_secret_scans,
        op9_source_mixing, op10_sharding, op11_vector_codes, op12_lexical_search, op13_suffix_array_dedup, pipeline,
    )
}
