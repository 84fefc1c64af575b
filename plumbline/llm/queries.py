"""The queries op1_ to op10_ over the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import counting, encoding, language, lines, mixing, quality, scoring, shingles, suffixes, vectors

#: Where vocabulary files are; None: the installed public_tokenizers.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZERS is not None:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), epochs=1.5, most=2.0)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = language.languages(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "narrow")


def op7_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    found = scoring.language_scores(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_classes(documents(spark, sf_dir), words=5, threshold=0.8).drop("mark")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: what is left; removed_spans: `start-end` character offsets into the original text."""
    found = lines.line_dedup(documents(spark, sf_dir).select("doc_id", "text"), unit="sentence", least_words=5)
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "text", "n_units", "n_removed", spans.alias("removed_spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.substring_dedup(documents(spark, sf_dir), length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_embedding_near_dedup, op3_token_counts, op4_bpe_round_trip, op5_quality_rules, op6_language_id, op7_language_model_scores, op8_jaccard_join, op9_line_dedup, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    """Operators 1, 2, 5, 8, 9 and 10 in DuckDB's SQL. The others cannot be written in it; tests hold them against plain versions."""
    from plumbline.llm import oracles

    return {"op1_source_mix": oracles.source_mix(), "op2_embedding_near_dedup": oracles.near_vectors(), "op5_quality_rules": oracles.quality_rules(), "op8_jaccard_join": oracles.jaccard_classes(), "op9_line_dedup": oracles.line_dedup(), "op10_substring_dedup": oracles.substring_dedup()}
