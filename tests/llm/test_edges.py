"""Nulls in every column, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontaminate, language_id, license_scan, near_dup, packing, quality_pu, quality_rules, recurrent_lm, stages, substring_dedup, warc
from brindle.llm.common import in_fold

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k % 9973}" for k in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5),
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, " \t\n \x0b\x0c\r ", "fr", "b", 7),
    (None, "a text without an id that stands here alone", None, "b", None),
    (None, None, None, None, None),
    (5, LONG, "de", "c", 1),
    (6, "x" * 100_000, "de", "c", 1),
    (7, "éàü 日本   ß <|endoftext|> <|startoftext|>", "fr", None, 3),
    (8, "123 456 ... !!!", "es", "d", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("key", "row", "part", "kind", "block", "score", "n_words", "id", "ids", "held", "hash", "whole", "labels", "pos", "places", "class_key")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog and runs away"), (1, None), (2, ""), (None, "a text without an id that stands here alone")], "item_id long, text string")


def ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=lambda x: (x is not None, x or 0))


EVERY = ids([{"doc_id": r[0]} for r in ROWS])


def test_quality_rules(docs, empty):
    rows = quality_rules.quality_rules(docs).collect()
    assert ids(rows) == EVERY and quality_rules.quality_rules(empty).count() == 0
    none = [r for r in rows if r["doc_id"] in (2, 3, 4)]
    assert all(r["n_words"] == r["word_chars"] == r["n_symbols"] == r["n_dup_lines"] == r["n_repeat_words"] == 0 and r["base_failed"] and not r["kept"] for r in none)


def test_license_scan(docs, empty):
    rows = license_scan.license_scan(docs).collect()
    assert ids(rows) == EVERY and license_scan.license_scan(empty).count() == 0
    assert all(r["first_word"] is None and r["last_word"] is None and r["labels"] == "" and r["score"] == 0 for r in rows)


def test_packing(docs, empty):
    rows = packing.pack(docs, TOKENIZER, 64).collect()
    assert sum(r["start"] == 0 for r in rows) == len(ROWS) and packing.pack(empty, TOKENIZER).count() == 0
    assert [(r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (2, 3, 4)] == [(1, 1)] * 3
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 5) > 60_000


def test_language_id(docs, empty):
    model = language_id.fit(docs, ~in_fold(5, 0))
    rows = language_id.predict(docs, model).collect()
    assert ids(rows) == EVERY and language_id.predict(empty, model).count() == 0
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in rows if r["doc_id"] in (2, 3, 4, 8))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.fit(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def test_quality_pu(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    net = quality_pu.fit(docs, labels, F.lit(True))
    rows = quality_pu.score(docs, net).collect()
    assert ids(rows) == EVERY and quality_pu.score(empty, net).count() == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality_pu.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in quality_pu.score(docs, None).collect()} == {0.5}


def test_substring_dedup(docs, empty):
    rows = substring_dedup.substring_dedup(docs, 5).collect()
    assert ids([r["row"] for r in rows]) == EVERY and substring_dedup.substring_dedup(empty).count() == 0
    assert all(r["n_words"] == r["n_removed"] == 0 and r["kept_text"] == "" for r in rows if r["row"]["doc_id"] in (2, 3, 4))
    assert [r["n_removed"] for r in rows if r["row"]["doc_id"] == 1] == [0, 0]  # one document that stands twice
    long = next(r for r in rows if r["row"]["doc_id"] == 5)
    assert long["n_words"] == 60_000 and long["kept_text"].split() == [f"w{k}" for k in range(9973)]
    assert long["row"]["key"] == "clash"


def test_near_dup(docs, empty):
    rows = near_dup.near_dup(docs).collect()
    assert ids([r["row"] for r in rows]) == EVERY and near_dup.near_dup(empty).count() == 0
    one = [r for r in rows if r["row"]["doc_id"] == 1]
    assert one[0]["class_key"] == one[1]["class_key"] and sorted(r["kept"] for r in one) == [False, True]
    blank = [r["class_key"] for r in rows if r["row"]["doc_id"] in (2, 3, 4)]
    assert len(set(blank)) == 3


def test_decontaminate(docs, empty, benchmark):
    rows = decontaminate.contamination(docs, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in rows) == [(0, 0), (1, 0), (1, 0)]
    assert decontaminate.contamination(empty, benchmark).count() == 0 and decontaminate.contamination(docs, benchmark.limit(0)).count() == 0


def test_recurrent_lm(docs, empty):
    rows = recurrent_lm.score(docs, fit_docs=4, one_in=2).collect()
    assert ids(rows) == EVERY and recurrent_lm.score(empty).count() == 0
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (2, 3, 4))
    assert next(r["n_tokens"] for r in rows if r["doc_id"] == 5) == 60_001
    assert all(r["score"] <= 1e-6 for r in rows)
    untrained = recurrent_lm.score(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == r["score"] == 0 for r in untrained)


def test_warc(spark):
    rows = [(1, "u", "a"), (None, None, None), (None, "x", ""), (5, "u\nv\tw", "a"), (5, "u", "a"), (7, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    back = warc.round_trip(pages).collect()
    assert len(back) == 6 and warc.round_trip(pages.limit(0)).count() == 0
    assert sorted((r["type"], r["refers_to"]) for r in back if r["page_id"] == 5) == [("revisit", 1)] * 2
    assert next(bytes(r["payload"]) for r in back if r["page_id"] == 7) == ("é" * 100_000).encode()
    assert all(r["payload_bytes"] == 0 and r["type"] == "response" for r in back if r["page_id"] is None)
    assert {r["type"] for r in warc.round_trip(pages, least=2).collect()} == {"response"}


def test_stages_on_edges(spark, docs, empty, tmp_path, benchmark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = (stages.language_id_stage, stages.near_dedup_stage, stages.substring_dedup_stage, stages.decontaminate_stage)
    for stage in steps:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.count() <= len(ROWS)
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert stages.pack_stage(spark, empty, str(tmp_path)).count() == 0
    kept = {r["doc_id"] for r in stages.language_id_stage(spark, docs, str(tmp_path)).collect()}
    assert kept.isdisjoint({2, 3, 4, 8})
    clean = [(r["doc_id"], r["text"]) for r in stages.decontaminate_stage(spark, docs, str(tmp_path)).collect()]
    assert 1 not in {d for d, _ in clean} and sorted(t is None for d, t in clean if d is None) == [True]


def test_digest_of_nothing():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
