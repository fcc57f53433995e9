"""License scan: an exact set-similarity join of text blocks with license templates, and phrases word by word.

Blocks are lines, and windows over consecutive lines of a paragraph (up to a line without words), as notices are wrapped. A window
goes from a template's word to another, over at most twice the template's words; it is looked for where its paragraph matches.

A block matches a template when it holds at least `threshold` of the template's distinct words. Pass 1 counts, over
all blocks of the table, how often each template word occurs; that global frequency orders the words, rarest first. Of a
template with n words and need = ceil(threshold * n), any matching block must hold one of its first n - need + 1 words
(prefix filter), have need distinct words (length filter), and, when the first of those words it holds stands at place i,
still be able to reach need with the n - i words from there on (positional filter). What passes is counted exactly, so the join is exact.
Templates are a parameter of a size that does not grow with the data; they travel with the task. The corpus is never shuffled.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. Defined results: a null or empty text
has no word, no place (null first and last), empty labels and score 0; repeated rows are judged each; an empty table gives none;
a block is taken whole however long; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import plain, sliced, words
from brindle.llm.common import long_rows

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices of public licenses by label; a label may have several.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
for _b in range(128):
    if not (48 <= _b <= 57 or 65 <= _b <= 90 or 97 <= _b <= 122 or _b == 10):
        _LOWER[_b] = 32


def normal(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with spaces for all that is no word, line ends kept. The bytes of a batch are mapped at once."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    if data is None or not data.size:
        return texts
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(_LOWER[np.frombuffer(data, np.uint8)])], offset=texts.offset)


def word_list(text: str) -> list[str]:
    return words(normal(pa.array([text], pa.large_string()))).distinct.to_pylist() if text else []


def _lines(texts: pa.Array):
    """Words of all lines; bounds of each text in lines."""
    lists = pc.split_pattern(normal(texts), "\n")
    return words(lists.values), np.asarray(lists.offsets, np.int64)


def _paragraphs(w, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each run of lines with words, none over a text's end."""
    full = np.flatnonzero(w.counts() > 0)
    text = np.searchsorted(lines, full, "right")
    cut = np.flatnonzero((np.diff(full) != 1) | (np.diff(text) != 0))
    return full[np.append(0, cut + 1)] if len(full) else full, full[np.append(cut, len(full) - 1)] if len(full) else full


def template_frequencies(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """word, n: in how many blocks of the whole table each template word stands."""
    vocabulary = sorted({w for _, t in templates for w in word_list(t)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in sliced(batches):
            w, _ = _lines(plain(batch.column(0)))
            known = np.asarray(pc.fill_null(pc.index_in(w.distinct, pa.array(vocabulary, pa.large_string())), -1))[w.codes]
            at = np.flatnonzero(known >= 0)
            pairs = np.unique(w.text_of()[at] * len(vocabulary) + known[at])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary), pa.array(total)], names=["word", "n"])

    return long_rows(docs).select(text).withColumnRenamed(text, "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Matcher:
    """The templates, ordered by global frequency, and the index of their prefixes."""

    def __init__(self, templates, frequency: dict[str, int], threshold: float):
        self.templates = []
        self.prefixes: dict[str, list[int]] = {}
        for label, text in templates:
            tokens = sorted(word_list(text), key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            for w in tokens[: len(tokens) - need + 1]:
                self.prefixes.setdefault(w, []).append(len(self.templates))
            self.templates.append((label, tokens, need))
        self.spans = [2 * len(words(normal(pa.array([t], pa.large_string()))).codes) for _, t in templates]

    def windows(self, k: int, ws: list[str]) -> list[tuple[int, int, float]]:
        """First and last place and containment of the best of each group of overlapping windows that match template k."""
        _, tokens, need = self.templates[k]
        wanted, held, found = set(tokens), Counter(), []
        at = [p for p, w in enumerate(ws) if w in wanted]
        left, best = 0, None
        for p in at:
            held[ws[p]] += 1
            while p - at[left] >= self.spans[k] or held[ws[at[left]]] > 1:
                if (w := ws[at[left]]) and held[w] == 1:
                    del held[w]
                else:
                    held[w] -= 1
                left += 1
            if best and at[left] > best[1]:
                found.append(best)
                best = None
            if len(held) >= need and (not best or len(held) > best[2]):
                best = (at[left], p, len(held))
        return [(a, b, n / len(tokens)) for a, b, n in [*found, *([best] if best else [])]]

    def block(self, own: set[str]) -> list[tuple[str, float]]:
        """Labels and containments of the templates that a block with these distinct words matches."""
        return [(self.templates[k][0], c) for k, c in self.matches(own)]

    def matches(self, own: set[str]) -> list[tuple[int, float]]:
        """Templates (by their number) that a block with these distinct words matches, and their containments."""
        found = []
        for k in sorted({k for w in own & self.prefixes.keys() for k in self.prefixes[w]}):
            _, tokens, need = self.templates[k]
            if len(own) < need:
                continue
            first = next(i for i, w in enumerate(tokens) if w in own)
            if len(tokens) - first < need:
                continue
            got = sum(w in own for w in tokens)
            if got >= need:
                found.append((k, got / len(tokens)))
        return found


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    score is 1 where a phrase stands, else the best containment of a matching template, else 0. blocks lists the
    matches: line (from 0; the first, of a window), label, containment.
    """
    frequency = {r["word"]: r["n"] for r in template_frequencies(docs, templates, text).collect()}  # as many rows as templates have words
    matcher = Matcher(templates, frequency, threshold)
    phrase_words = [(p.split(" "), label) for p, label in phrases.items()]
    kinds = (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))
    block = T.StructType([T.StructField("line", T.LongType()), T.StructField("label", T.StringType()), T.StructField("containment", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(*x) for x in kinds], T.StructField("blocks", T.ArrayType(block))])
    arrow_block = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = pa.array(list(matcher.prefixes), pa.large_string())
        for batch in sliced(batches):
            w, lines = _lines(plain(batch.column(1)))
            bounds = w.bounds[lines]  # of documents in words
            n = len(bounds) - 1
            code = {x: i for i, x in enumerate(w.distinct.to_pylist()) if x in parts}
            base: list[dict] = [{} for _ in range(n)]
            for ws, label in phrase_words:
                if not all(x in code for x in ws):
                    continue
                hit = np.flatnonzero(w.codes == code[ws[0]])
                for j, x in enumerate(ws[1:], 1):
                    hit = hit[hit + j < len(w.codes)]
                    hit = hit[w.codes[hit + j] == code[x]]
                doc = np.searchsorted(bounds, hit, "right") - 1
                for at, d in zip(hit, doc, strict=True):
                    if at + len(ws) <= bounds[d + 1]:
                        base[d].setdefault(int(at - bounds[d]), []).append(label)
            rare = np.asarray(pc.is_in(w.distinct, prefix))
            found: list[list] = [[] for _ in range(n)]
            single: set[tuple[int, int]] = set()
            at = np.flatnonzero(rare[w.codes])
            for line in np.unique(np.searchsorted(w.bounds, at, "right") - 1):
                own = set(w.distinct.take(pa.array(np.unique(w.codes[w.bounds[line] : w.bounds[line + 1]]))).to_pylist())
                if hits := matcher.matches(own):
                    d = int(np.searchsorted(lines, line, "right") - 1)
                    found[d] += [{"line": int(line - lines[d]), "label": matcher.templates[k][0], "containment": c} for k, c in hits]
                    single |= {(int(line), k) for k, _ in hits}
            first, last = _paragraphs(w, lines)
            own_paragraph = np.unique(np.searchsorted(first, np.searchsorted(w.bounds, at, "right") - 1, "right") - 1)
            for a, b in zip(first[own_paragraph], last[own_paragraph], strict=True):
                if a == b:
                    continue
                ws = w.distinct.take(pa.array(w.codes[w.bounds[a] : w.bounds[b + 1]])).to_pylist()
                d = int(np.searchsorted(lines, a, "right") - 1)
                for k, _ in matcher.matches(set(ws)):
                    for p, q, c in matcher.windows(k, ws):
                        x, y = (int(np.searchsorted(w.bounds, w.bounds[a] + i, "right") - 1) for i in (p, q))
                        if x < y and not any((line, k) in single for line in range(x, y + 1)):
                            found[d].append({"line": x - int(lines[d]), "label": matcher.templates[k][0], "containment": c})
            for fs in found:
                fs.sort(key=lambda f: f["line"])
            own_labels = [sorted({x for v in b.values() for x in v}) for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds)),
                    pa.array([sum(map(len, b.values())) for b in base], pa.int64()),
                    pa.array([min(b, default=None) for b in base], pa.int64()),
                    pa.array([max(b, default=None) for b in base], pa.int64()),
                    pa.array([",".join(x) for x in own_labels], pa.string()),
                    pa.array([",".join(sorted({*x, *(f["label"] for f in fs)})) for x, fs in zip(own_labels, found, strict=True)], pa.string()),
                    pa.array([1.0 if b else max((f["containment"] for f in fs), default=0.0) for b, fs in zip(base, found, strict=True)], pa.float64()),
                    pa.array(found, arrow_block),
                ],
                names=schema.names,
            )

    parts = {x for ws, _ in phrase_words for x in ws}
    return long_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
