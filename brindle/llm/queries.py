"""The queries of this subpackage, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, language_id, license_scan, near_dup, oracle, packing, quality_pu, quality_rules, recurrent_lm, substring_dedup, warc
from brindle.llm.common import in_fold, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), in_fold(4, 2)
    net = quality_pu.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_pu.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(5, 0)
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_dup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("class_key").alias("class_id"), "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_substring_dedup, op3_recurrent_lm, op4_license_scan, op5_packing, op6_quality_pu, op7_language_id, op8_near_dup, op9_decontamination, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
