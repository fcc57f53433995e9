"""Operators against brute force, exact round trips or held-out accuracy, on small tables."""

import base64
import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import columnar, decontaminate, gru, language_id, license_scan, near_dup, packing, quality_pu, queries, recurrent_lm, stages, substring_dedup, warc
from brindle.llm.common import bounded_sample, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_words_as_the_pattern_has_them():
    texts = [None, "", " a  b\n", "\x1c x\x0b\x0cy\x85z q", "é ü  \t", "one"]
    w = columnar.words(columnar.plain(pa.array(texts)))
    vocabulary = w.distinct.to_pylist()
    for k, t in enumerate(texts):
        assert [vocabulary[c] for c in w.codes[w.bounds[k] : w.bounds[k + 1]]] == WORD.findall(t or "")


def test_slices_keep_rows():
    rng = random.Random(2)
    for _ in range(100):
        batches = [pa.RecordBatch.from_arrays([pa.array([rng.choice([None, "x" * rng.randint(0, 30)]) for _ in range(rng.randint(0, 9))], pa.string())], names=["text"]) for _ in range(rng.randint(0, 6))]
        out = list(columnar.sliced(iter(batches), most=40))
        assert [x for b in batches for x in b.column(0).to_pylist()] == [x for b in out for x in b.column(0).to_pylist()]


def test_bounded_sample_is_the_least_hashes(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    assert [r["h"] for r in bounded_sample(df, 50, "h").collect()] == sorted(r["h"] for r in df.collect())[:50]


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(k, f"http://x/{k}", ["same", "", "other" * 99, None, "é\r\n\r\nContent-Length: 7"][k % 5]) for k in range(40)]
    back = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    first: dict[bytes, int] = {}
    for k, _, html in rows:
        first.setdefault((html or "").encode(), k)
    for k, url, html in rows:
        payload, r = (html or "").encode(), back[k]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), url)
        assert (r["type"], r["refers_to"]) == (("response", None) if first[payload] == k else ("revisit", first[payload]))
        assert r["payload"] is None if r["type"] == "revisit" else bytes(r["payload"]) == payload


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(9)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_monolithic(warc.records(pages), str(tmp_path))
    spans = warc.normalise(spark, [a for a, _ in archives], span=300)
    assert sum(s[3] for s in spans) == sum(n for _, n in archives) == 9 and len(spans) > 1
    for path, _ in archives:
        whole, members = gzip.decompress(open(path, "rb").read()), open(path.replace(".mono", ""), "rb").read()
        at, parts = 0, []
        for line in open(path.replace(".mono.warc.gz", ".cdx")):
            offset, length = map(int, line.split("\t")[:2])
            assert offset == at
            at += length
            parts.append(zlib.decompress(members[offset : offset + length], 31))
        assert at == len(members) and b"".join(parts) == whole


# --- substring dedup ------------------------------------------------------------------------------------------------


def brute_substrings(rows, n):
    words, seen = {d: WORD.findall(t or "") for d, t in rows}, {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            seen.setdefault(tuple(words[d][i : i + n]), (d, i))
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] != (d, i) for j in range(i, i + n)}
        out[d] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("n, batches", [(3, 1), (5, 3), (20, 2)])
def test_substrings(spark, n, batches):
    rng = random.Random(n)
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice("ab" if i % 3 else "abcdefghijk") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    base = [rng.choice("abcdefghijklmnop") for _ in range(100)]
    for i in range(80, 130):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(100)] = rng.choice("xyz")
        rows.append((i, " ".join(copy[rng.randint(0, 30) : rng.randint(60, 100)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(df, n, batches).collect()}
    assert got == brute_substrings(rows, n)


def test_index_grows_and_compacts(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(30))) for i in range(60)]
    index = substring_dedup.Index(spark, str(tmp_path), 4, most_runs=2)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4, 5, index=index).collect()
    assert len(index.runs) <= 2 and index.version == 5
    assert {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == brute_substrings(rows, 4)


def test_index_is_opened_again(spark, tmp_path):
    """Documents that come later, in another session's hands: the runs and their manifest are all that is left of the earlier ones."""
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = substring_dedup.Index(spark, str(tmp_path), 4)
    earlier, later = df.filter("doc_id < 35"), df.filter("doc_id >= 35")
    got = substring_dedup.substring_dedup(earlier, 4, 3, index=first).collect()
    for name in first.runs:
        spark.sql(f"DROP TABLE {name}")
    again = substring_dedup.Index.open(spark, str(tmp_path))
    assert (again.runs, again.version, again.parts) == (first.runs, 3, 4) and len(again.runs) == 1
    got += substring_dedup.substring_dedup(later, 4, 2, index=again, history=earlier).collect()
    assert {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == brute_substrings(rows, 4)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_entries_resolve_alike_in_batches_of_any_size(spark, size):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(6), rng.randrange(3), rng.randrange(20), rng.randrange(4)) for _ in range(150)}) * 2
    entries = [(*r, rng.choice([substring_dedup.FIRST, substring_dedup.MIXED, substring_dedup.AGAIN])) for r in rows]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        got = collections.Counter(tuple(r) for r in substring_dedup.resolve(spark.createDataFrame(entries, f"{substring_dedup.ENTRY}, kind byte"), 2).collect())
    finally:
        spark.conf.set(key, before)
    want = collections.Counter(e for e in entries if e[4] == substring_dedup.AGAIN)
    live = [e for e in entries if e[4] != substring_dedup.AGAIN]
    for fp in {e[0] for e in live}:
        spans = {e[1] for e in live if e[0] == fp}
        for span in spans:
            places = sorted((e[2:4], e[4]) for e in live if e[:2] == (fp, span))
            same = [k for p, k in places if p == places[0][0]]
            firsts = [x for x in got if x[:4] == (fp, span, *places[0][0]) and x[4] != substring_dedup.AGAIN]
            assert len(firsts) == 1 and firsts[0][4] in ([substring_dedup.MIXED] if len(spans) > 1 else same)
            want[firsts[0]] += 1
            want.update((fp, span, *p, substring_dedup.AGAIN) for p, _ in places if p != places[0][0])
    assert got == want


def test_substrings_with_text_ids(spark):
    rows = [("b", "x y z"), ("a", "x y z w"), ("b", "q x y z")]
    got = {(r["row"]["doc_id"], r["row"]["text"]): r["n_removed"] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id string, text string"), 3, 1).collect()}
    assert got[("a", "x y z w")] == 0 and got[("b", "x y z")] == got[("b", "q x y z")] == 3


# --- language model -------------------------------------------------------------------------------------------------


def test_lm_gradients():
    rng = np.random.default_rng(0)
    m = recurrent_lm.ClassLM(np.array([50.0, 40, 30, 20, 10, 5, 5, 3, 2, 1, 1, 8]))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    before, target, h = rng.integers(0, 12, (6, 4)), rng.integers(0, 12, (6, 4)), rng.standard_normal((4, recurrent_lm.HIDDEN)) * 0.1
    grads = m.gradients(before, target, h)[0]
    for k in m.p:
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in m.p[k].shape)
            old, losses = m.p[k][at], []
            for e in (1e-3, -1e-3):
                m.p[k][at] = old + e
                losses.append(m.gradients(before, target, h)[1])
            m.p[k][at] = old
            slope = (losses[0] - losses[1]) / 2e-3
            assert abs(slope - grads[k][at]) <= 1e-4 + 0.02 * abs(slope)


def test_lm_is_a_distribution_and_carries_its_state():
    m = recurrent_lm.ClassLM(np.arange(40, 0, -1.0))
    state = np.random.default_rng(1).standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    assert abs(sum(math.exp(m.output(state, np.array([k]))[0][0]) for k in range(40)) - 1) < 1e-5
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 40, n), 0) for n in (0, 3, 200, 77)]  # longer than a window
    scores = m.score(np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    for d, s in zip(docs, scores, strict=True):
        h, total, last = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0.0, 0
        for t in d:
            h = gru.forward(m._layer(), np.array([[last]]), h)[0][0]
            total, last = total + m.output(h, np.array([t]))[0][0], t
        assert abs(total - s) < 1e-3 * max(1, abs(total))


def test_lm_scores(spark, texts):
    rows = queries.op3_recurrent_lm(spark, SF).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: WORD.findall(t.translate(lower)) + ["\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    c = collections.Counter(t for d, ws in tokens.items() if not held[d] for t in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ws)
        assert abs(base - r["base_score"]) <= 1e-9 * abs(base) + 1e-9
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(t in c for t in ws), n, held[r["doc_id"]])
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better than the base on texts it never saw


def test_lm_learns_from_every_training_token(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for k in range(300)], "doc_id long, text string")
    held = recurrent_lm.in_fold(5, 1, "doc_id")
    rows = docs.select("doc_id", "text", held.alias("held"), F.xxhash64("doc_id").alias("hash"))
    coded = recurrent_lm.blocks(rows)
    known = recurrent_lm.vocabulary(recurrent_lm.counted(coded))
    want = sum(len(r["text"].split()) + 1 for r in rows.filter("not held").collect())
    assert known.tokens == want and recurrent_lm.fit(rows, coded, known, 10).seen == want


def test_lm_is_the_same_however_the_table_is_split(spark):
    docs = table(spark, SF, "documents")
    one, other = ({r["doc_id"]: r["score"] for r in recurrent_lm.score(docs.repartition(n)).collect()} for n in (2, 7))
    assert one.keys() == other.keys() and all(abs(one[d] - other[d]) <= 1e-4 * max(1, abs(one[d])) for d in one)


def test_vocabulary_follows_the_counts(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "VOCABULARY", 5)
    counts = spark.range(400).selectExpr("id as c", "concat('w', id) as word").filter("c > 0")
    assert len(recurrent_lm.vocabulary(counts).words) == 19


# --- license scan ---------------------------------------------------------------------------------------------------


def test_license_join_is_exact():
    rng = random.Random(4)
    words = [f"t{k}" for k in range(12)]
    templates = [(f"l{k}", " ".join(rng.sample(words, rng.randint(1, 8)))) for k in range(10)]
    frequency = {w: rng.randint(0, 5) for w in words}
    for threshold in (0.3, 0.6, 0.9, 1.0):
        matcher = license_scan.Matcher(templates, frequency, threshold)
        for _ in range(200):
            own = set(rng.sample([*words, "z", "y"], rng.randint(0, 9)))
            want = [(lab, len(set(t.split()) & own) / len(t.split())) for lab, t in templates if len(set(t.split()) & own) >= math.ceil(threshold * len(t.split()) - 1e-9)]
            assert sorted(matcher.block(own)) == sorted(want)


def test_license_words_across_lines(spark):
    text = "Foo_MIT\nLicense general  public\n\nlicense Apache-License, Version 2.0. Licensed under the"
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (14, 3, 1, 6, "apache,gpl,mit")


def test_wrapped_notices(spark):
    mit = "x = 1\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)\n#\nmore"
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:"
    parted = "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the following conditions are met"
    thin = "all " + "w " * 40 + "\nrights " + "w " * 40 + "\nreserved"
    line = "a b\nAll rights reserved.\nc"
    two = ["all rights", "reserved"]
    rows = [(k, t) for k, t in enumerate([mit, bsd, parted, thin, line, "\n".join([*two, "", *two])])] + [(6, "all rights"), (7, "reserved")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: [(b["line"], b["label"], b["containment"]) for b in r["blocks"]] for r in license_scan.license_scan(df).collect()}
    reserved = "all-rights-reserved"
    assert got == {0: [(1, "mit", 1.0)], 1: [(0, "bsd", 1.0)], 2: [], 3: [], 4: [(1, reserved, 1.0)], 5: [(0, reserved, 1.0), (3, reserved, 1.0)], 6: [], 7: []}


def test_windows_lose_none():
    rng, words = random.Random(9), "abcdef"
    for _ in range(300):
        template = "".join(rng.sample(words, 4))
        matcher = license_scan.Matcher([("l", " ".join(template))], {}, 0.75)
        ws = [rng.choice("abcdefxyz") for _ in range(rng.randint(0, 30))]
        most = max((len(set(ws[i : i + 8]) & set(template)) for i in range(len(ws))), default=0)
        got = matcher.windows(0, ws)
        assert max((c for _, _, c in got), default=0) == (most / 4 if most >= 3 else 0)
        assert all(b - a < 8 and len(set(ws[a : b + 1]) & set(template)) == 4 * c for a, b, c in got)


# --- packing --------------------------------------------------------------------------------------------------------


def test_folding_changes_no_id():
    path = queries.tokenizer_path()
    t, rng = packing._tokenizer(path), random.Random(1)
    odd = ["don't STOP'S it's,x's 'tis I'VE we'll a.b,c!d", "éa É.x ≠ ≮ a≮", "abc<|endoftext|>def <|STARTOFTEXT|>x", "", "...!!! a1b2,3 İstanbul ΑΣ, ß. x_y z-", "ﬁ.x ½a, Ⅷ.b 日本,語 a日,"]
    odd += ["".join(rng.choice("ab'st,. Éé́<|>!1x\n") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for batch in ([*odd], *([o] for o in odd[:300])):
        for text, ids in zip(batch, packing.text_ids(pa.array(batch, pa.large_string()), path, "<|startoftext|>", 1), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, texts = packing._tokenizer(path), ["", "Don't  STOP\n\n a b", "É x", "<|endoftext|> y"]
    assert packing.by_words(queries.tokenizer_path(), "<|startoftext|>") and not packing.by_words(path, "<|startoftext|>")
    for text, ids in zip(texts, packing.text_ids(pa.array(texts, pa.large_string()), path, "<|startoftext|>", 7), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 7]


def test_packing_has_every_id_once(spark, texts):
    t = packing._tokenizer(queries.tokenizer_path())
    want = {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in texts.items()}
    rows = queries.op5_packing(spark, SF).collect()
    sequences, next_start = collections.defaultdict(list), dict.fromkeys(want, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = want[r["doc_id"]]
        assert r["start"] == next_start[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == packing.crc(own[r["start"] : r["start"] + r["length"]])
        next_start[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(next_start[d] == len(x) for d, x in want.items())
    for s, parts in sequences.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or s == max(sequences)


# --- classifiers ----------------------------------------------------------------------------------------------------


def test_byte_network_gradients():
    rng = np.random.default_rng(3)
    m = language_id.ByteBiGru(["a", "b", "c"])
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    data, label = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    grads = m.gradients(data, label)[0]
    for k in m.p:
        for _ in range(6):
            at = (int(data[rng.integers(7), rng.integers(5)]), int(rng.integers(m.p[k].shape[1]))) if k.endswith("_x") else tuple(rng.integers(0, s) for s in m.p[k].shape)
            old, both = m.p[k][at], []
            for e in (1e-5, -1e-5):
                m.p[k][at] = old + e
                both.append(m.gradients(data, label)[1])
            m.p[k][at] = old
            assert abs((both[0] - both[1]) / 2e-5 - grads[k][at]) <= 1e-6 + 0.001 * abs(grads[k][at])


def brute_language(m, text):
    """The mean of the label probabilities of every byte, byte by byte, in float64."""
    data, labels = text.encode(), len(m.labels)
    squash = lambda x: x / (1 + np.abs(x))

    def walk(p, part):
        n, h, out = language_id.HIDDEN, np.zeros(language_id.HIDDEN), []
        x, hg, hc = (p[k].astype(np.float64) for k in ("x", "hg", "hc"))
        for c in part:
            gates = (1 + squash(x[c, : 2 * n] + h @ hg)) / 2
            h = h + gates[:n] * (squash(x[c, 2 * n :] + (gates[n:] * h) @ hc) - h)
            out.append(h)
        return out

    total = np.zeros(labels)
    for first in range(0, len(data), language_id.SEGMENT):
        last = min(first + language_id.SEGMENT, len(data))
        lo, hi = max(0, first - language_id.CONTEXT), min(len(data), last + language_id.CONTEXT)
        f, b = walk(m._side("f"), data[lo:hi]), walk(m._side("b"), data[lo:hi][::-1])[::-1]
        for t in range(first - lo, last - lo):
            e = np.exp(np.concatenate([f[t], b[t]]) @ m.p["out"] + m.p["bias"])
            total += e / e.sum()
    return total / max(1, len(data))


def test_language_of_whole_documents(spark, texts):
    """The query's rows against the network run byte by byte over whole texts, the longest and the shortest among them."""
    docs = table(spark, SF, "documents")
    m = language_id.fit(docs, ~recurrent_lm.in_fold(5, 0, "doc_id"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, m).collect()}
    by_size = sorted(texts, key=lambda d: (len(texts[d]), d))
    pick = [d for d in by_size if 2 * language_id.SEGMENT < len(texts[d]) < 9000][-2:] + by_size[:20] + [d for d in by_size if 1000 < len(texts[d]) < 1100][:3]
    for d in pick:
        p = brute_language(m, texts[d])
        if any(c.isalpha() for c in texts[d]):
            assert got[d]["lang_pred"] == m.labels[p.argmax()] and abs(got[d]["score"] - p.max()) < 1e-3
        else:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)


def test_language_held_out(spark):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_segments_count_every_byte_once():
    sizes = np.array([0, 1, language_id.SEGMENT, language_id.SEGMENT + 1, 5 * language_id.SEGMENT - 3])
    text, lo, hi, first, last = language_id.segments(sizes)
    for k, n in enumerate(sizes):
        own = text == k
        assert sorted(x for a, b in zip(first[own], last[own], strict=True) for x in range(a, b)) == list(range(n))
        assert all(lo[own] == np.maximum(first[own] - language_id.CONTEXT, 0)) and all(hi[own] == np.minimum(last[own] + language_id.CONTEXT, n))


def test_rare_languages_are_learned(spark):
    """A language that one document in a hundred has is among the labels, and is told."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rare = spark.createDataFrame([(10**6 + k, " ".join(["zzyx qqvor xxkli wwopq"] * 12), "xx") for k in range(8)], "doc_id long, text string, lang string")
    m = language_id.fit(docs.select("doc_id", "text", "lang").union(rare), F.lit(True), label_docs=40)
    assert "xx" in m.labels and {r["lang_pred"] for r in language_id.predict(rare, m).collect()} == {"xx"}


def test_prior_and_quality_from_positives_alone():
    rng = np.random.default_rng(1)
    draw = lambda n, centre: np.concatenate([rng.standard_normal((n, 1)) + centre, rng.standard_normal((n, 3))], 1).astype(np.float32)
    positive, unlabelled = draw(3000, 3), np.concatenate([draw(2100, 3), draw(900, -3)])
    net = quality_pu.fit_samples(positive, rng.permutation(unlabelled), unlabelled, np.repeat([1, 0], [2100, 900]))
    assert abs(net.prior - 0.7) < 0.06
    assert ((net.scores(unlabelled) >= quality_pu.THRESHOLD) == np.repeat([True, False], [2100, 900])).mean() > 0.97


def brute_measures(text):
    """The measures of one text, word by word."""
    ws, kinds = WORD.findall(text), {"upper": "Lu", "lower": "Ll", "digit": "Nd"}
    n, chars = len(ws), sum(map(len, ws))
    of = [unicodedata.category(c) for w in ws for c in w]
    seen = collections.Counter(ws)
    lines = text.split("\n")
    out = [sum(k == kind for k in of) / max(chars, 1) for kind in kinds.values()] + [sum(k[0] not in "LN" for k in of) / max(chars, 1)]
    out += [math.log1p(n) / 10, chars / max(n, 1) / 20, len(seen) / max(n, 1), max(seen.values(), default=0) / max(n, 1), 1 - len(set(lines)) / len(lines), len(lines) / max(n, 1)]
    out += [sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / max(n, 1), sum(len(w) <= 3 for w in ws) / max(n, 1), sum(len(w) >= 15 for w in ws) / max(n, 1)]
    shapes = collections.Counter(quality_pu._shape(w) for w in ws)
    return out + [shapes[k] / max(n, 1) for k in range(quality_pu.SHAPES)]


def test_quality_by_brute_force(spark, texts):
    """The scores of whole texts against the same network over measures taken word by word, layer by layer."""
    docs, train = table(spark, SF, "documents"), ~recurrent_lm.in_fold(4, 2, "doc_id")
    net = quality_pu.fit(docs, table(spark, SF, "labels"), train)
    got = {r["doc_id"]: r for r in quality_pu.score(docs, net).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        x = np.array(brute_measures(t)) if WORD.findall(t) else np.zeros(quality_pu.N_FEATURES)
        h = np.tanh((x - net.mean) / net.scale @ net.p["w1"] + net.p["b1"])
        s = 1 / (1 + math.exp(-(float((h @ net.p["w2"])[0]) + float(net.p["b2"][0]) + net.shift)))
        assert abs(s - got[d]["score"]) < 1e-4 and got[d]["predicted"] == int(got[d]["score"] >= 0.7)
    again = quality_pu.fit(docs.repartition(5), table(spark, SF, "labels"), train)
    assert all(np.allclose(again.p[k], net.p[k], atol=1e-5) for k in net.p)


def test_quality_held_out(spark):
    rows = queries.op6_quality_pu(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.9 * len(rows)


# --- near duplicates ------------------------------------------------------------------------------------------------


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(6)
    sampler = near_dup.Sampler()
    for change in (0, 10, 40):
        agreed, alike = [], []
        for _ in range(60):
            a = [rng.randrange(10**9) for _ in range(300)]
            b = [rng.randrange(10**9) if rng.randrange(400) < change else x for x in a]
            w = columnar.words(pa.array([" ".join(map(str, a)), " ".join(map(str, b))], pa.large_string()))
            text, value, count = near_dup.shingles(w)
            weight = count * (1 + (value % np.uint64(5)).astype(float) / 4)
            s = sampler.samples(text, value, weight, 2)
            agreed.append((s[0] == s[1]).mean())
            pairs = {t: dict(zip(value[text == t].tolist(), weight[text == t].tolist(), strict=True)) for t in (0, 1)}
            both = sum(min(pairs[0].get(v, 0), pairs[1].get(v, 0)) for v in {*pairs[0], *pairs[1]})
            alike.append(both / (sum(pairs[0].values()) + sum(pairs[1].values()) - both))
        assert abs(np.mean(agreed) - np.mean(alike)) < 0.03


def test_near_duplicates(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    got = {r["row"]["doc_id"]: r["class_key"] for r in near_dup.near_dup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    _, value, _ = near_dup.shingles(columnar.words(pa.array(texts, pa.large_string())))
    weights = near_dup.idf(np.bincount(near_dup.counters(value).ravel(), minlength=near_dup.SKETCH * near_dup.COUNTERS), len(texts))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        others = list(range(a + 1, len(texts)))
        if others:
            s = near_dup.similarity(pa.array([texts[a]] * len(others), pa.large_string()), pa.array([texts[b] for b in others], pa.large_string()), weights)
            for b, x in zip(others, s, strict=True):
                if x >= 0.8:
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root))


def test_chains_are_one_class(spark):
    base = [f"w{k}" for k in range(200)]
    rows, text = [], list(base)
    for k in range(30):  # each like the one before, the ends unlike
        text[k * 6] = f"n{k}"
        rows.append((k, " ".join(text)))
    got = near_dup.near_dup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_key"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


# --- decontamination ------------------------------------------------------------------------------------------------


def test_search_finds_all_above_the_threshold():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    index = decontaminate.BlockMaxIndex([(k, " ".join(rng.choice(vocabulary[: 5 + k]) for _ in range(rng.randint(3, 40)))) for k in range(150)])
    for _ in range(100):
        terms = {rng.choice(vocabulary) for _ in range(rng.randint(1, 120))}
        scores = collections.Counter()
        for t in terms & index.postings.keys():
            for k, x in zip(*index.postings[t][:2], strict=True):
                scores[k] += x
        for threshold in (0.1, 0.3, 0.6):
            want = {k: s for k, s in scores.items() if s >= threshold - 1e-9}
            got = dict(index.search(terms, threshold))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def brute_contamination(docs, items, threshold=0.6, question=0.6, answer=0.4):
    """(doc, item) -> (score, start, overlaps), from the definitions alone: BM25 of every item against every passage."""
    word = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    items = [(i, t, word(t)) for i, t in items if word(t)]
    df = collections.Counter(w for _, _, ws in items for w in set(ws))
    n, mean = len(items), sum(len(ws) for _, _, ws in items) / len(items)
    grams = lambda ws, k: {tuple(ws[a : a + k]) for a in range(max(1, len(ws) - k + 1))} if ws else set()
    out = {}
    for i, t, ws in items:
        weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, f in collections.Counter(ws).items()}
        total, step = sum(weight.values()), 1
        while step < len(ws):
            step *= 2
        sentences = [p for p in re.split(r"(?<=[.!?])\s+", t.strip()) if word(p)]
        q, a = (word(" ".join(sentences[:-1])), word(sentences[-1])) if len(sentences) > 1 else (ws[: len(ws) - max(1, len(ws) // 5)], ws[len(ws) - max(1, len(ws) // 5) :])
        q, a = grams(q, 3), grams(a, 3)
        for d, text in docs:
            ds = word(text)
            for start in range(0, len(ds), step):
                part = ds[start : start + 2 * step]
                score = sum(weight.get(w, 0) for w in set(part)) / total
                if score >= threshold - 1e-9:
                    got = [sum(g in grams(part, len(g)) for g in x) / len(x) if x else 1.0 for x in (q, a)]
                    if (got[0] >= question and got[1] >= answer) or (q and got[0] >= 0.9) or got[0] * len(q) + got[1] * len(a) >= question * (len(q) + len(a)) - 1e-9:
                        out[d, i] = max(out.get((d, i), (-1,)), (score, -start, *got))
                if start + 2 * step >= len(ds):
                    break
    return out


def test_contamination_is_all_of_it(spark):
    """Against every item and every passage by brute force; items of common words alone and a very long one among them, in one shard and in many."""
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    common = " ".join(w for w, _ in collections.Counter(w for _, t in bench for w in decontaminate.tokens(t)).most_common(9))
    bench += [(9001, common), (9002, " ".join(t for _, t in bench[:9])), (9003, "Two words."), (9004, None), (9005, "?!")]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 9000]
    docs += [(70001, f"some words before {common} and some after"), (70002, "x " * 300 + (bench[3][1] or "")), (70003, bench[-4][1]), (70004, "two words")]
    want = brute_contamination(docs, [x for x in bench if x[1]])
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for shard_bytes in (1 << 20, 4000):
        got = {(r["doc_id"], r["item_id"]): (r["score"], -r["start"], r["question_overlap"], r["answer_overlap"]) for r in decontaminate.contamination(df, items, shard_bytes=shard_bytes).collect()}
        assert got.keys() == want.keys() and {(70001, 9001), (70002, bench[3][0]), (70003, 9002), (70004, 9003)} <= got.keys()
        assert all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k], strict=True))
        assert {r["doc_id"] for r in decontaminate.clean(df, items, shard_bytes=shard_bytes).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_answers_veto_nothing(spark):
    question = "In the valley of seven rivers the miller counted ninety sacks of barley before the winter storms closed the northern road."
    items = [(0, f"{question} He kept eleven."), (1, "An unrelated riddle about copper lanterns hanging over quiet harbours. They shine dimly tonight.")]
    docs = [(0, items[0][1]), (1, question), (2, f"{question} He kept twelve."), (3, "the miller counted ninety sacks"), (4, items[1][1].split(". ")[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {3, 4}


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, texts):
    """Every stage against what brute force makes of its predecessor's rows."""
    import corpus_pipeline
    from brindle.llm.common import written

    docs = docs0 = table(spark, SF, "documents").withColumn("lang", F.when(F.col("doc_id") % 7 != 3, F.col("lang")))
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        made[name] = (before, docs)
        if name != "pack":
            assert docs.columns == before.columns
    rows = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}
    before, after = map(rows, made["language_id"])
    told = {r["doc_id"]: r for r in language_id.predict(docs0, language_id.fit(docs0, ~recurrent_lm.in_fold(5, 0, "doc_id"))).collect()}
    assert {d for d, r in told.items() if r["lang_pred"] == "und" or r["score"] < stages.LANGUAGE_SCORE} == before.keys() - after.keys()
    assert {d for d, t in before.items() if not any(c.isalpha() for c in t)} <= before.keys() - after.keys()
    langs = {r["doc_id"]: r["lang"] for r in docs0.collect()}
    assert all(r["lang"] == (langs[r["doc_id"]] or told[r["doc_id"]]["lang_pred"]) for r in made["language_id"][1].collect())
    before, after = map(rows, made["near_dedup"])
    assert set(after) <= set(before) and len(set(after.values())) == len(after)
    before, after = map(rows, made["substring_dedup"])
    want = brute_substrings(list(before.items()), 20)
    assert after == {d: t if want[d][1] == 0 else want[d][2] for d, t in before.items() if want[d][1] == 0 or want[d][1] < want[d][0]}
    before, after = map(rows, made["decontaminate"])
    hits = {r["doc_id"] for r in decontaminate.contamination(made["decontaminate"][0], table(spark, SF, "benchmark")).collect()}
    assert set(after) == set(before) - hits
    t = packing._tokenizer(queries.tokenizer_path())
    packed = collections.defaultdict(list)
    for r in sorted(made["pack"][1].collect(), key=lambda r: r["start"]):
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        packed[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert packed == {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in after.items()}
