"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the documents that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, language_id, near_dup, packing, substring_dedup
from brindle.llm.common import in_fold, table
from brindle.llm.queries import tokenizer_path


#: A document is rejected if the network gives its best language less than this share of the document's bytes.
LANGUAGE_SCORE = 0.4


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go: those without a letter, and those whose best language has a score below LANGUAGE_SCORE.

    What stays has every column as it was, but that a null `lang` becomes the language that was told.
    """
    model = language_id.fit(docs, ~in_fold(5, 0))
    whole = docs.select("doc_id", "text", F.struct("*").alias("whole"))
    told = language_id.predict(whole, model, keep=("whole",)).filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LANGUAGE_SCORE))
    lang = F.coalesce("whole.lang", F.col("lang_pred").cast(docs.schema["lang"].dataType))
    return told.select(*[(lang if c == "lang" else F.col("whole").getField(c)).alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return near_dup.near_dup(docs).filter("kept").select("row.*")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that a window of 20 words repeats from an earlier place goes; the kept words are joined by spaces and counted anew.

    A document that loses nothing keeps its text as it was; one that loses all its words goes.
    """
    cut = substring_dedup.substring_dedup(docs)
    cut = cut.filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a training sequence, with its token ids and their crc32. Null and empty texts are the end id alone; an empty table gives none."""
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))
