"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_main, media, mixing, negatives, phrases, pieces, pii, quality, secret_scan, simhash, token_counts, warc
from .common import stored, text_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its factor, probability and whether it is sampled."""
    t = text_of()
    keys = [F.coalesce(k, F.lit("(none)")).alias(k) for k in ("source", "lang")]
    key = mixing.draw_key("doc_id", "text").alias("key")
    docs = _table(spark, sf_dir, "documents").select("doc_id", *keys, mixing.topic_of(t).alias("topic"), mixing.words_of(t).alias("n_words"), key)
    out = mixing.sampled(stored(docs, "mixing"), "n_words", key_column="key")
    return out.select(
        "row.doc_id", "row.source", "row.lang", "row.topic", "row.n_words",
        F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), F.col("in_sample").alias("sampled"),
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_stored(media.store_as_audio(_table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judged(docs)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row as anchor; every seventh row has a label that is off by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_rows(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", moved)
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.oracle_sql(), "op6_quality_rules": quality.oracle_sql(), "op11_hard_negatives": negatives.oracle_sql(), "op13_phrases": phrases.oracle_sql()}
