"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk with an estimated class prior.

Trusted positives are rows labelled 1; unlabelled are web texts taken without a look at their label. A small network
minimises prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)); where the second term falls below zero its
gradient is turned, so that it is not fitted further. The prior is the smallest ratio of the two samples' tails over a first
classifier's score (what share of the unlabelled could be positive at most).

Inputs are measures of a whole text alone, worked out from word codes: shares of character kinds, repetition, lengths, and
shares of hashed word shapes. Fitting takes at most `fit_rows` rows of each sample (smallest hash of the id; a documented bound).
Scores are moved so that the threshold that tells the labelled rows of the fit folds apart best lies at 0.7: there, and only there, rows
labelled 0 are used, so the ranking is learned from positives and unlabelled rows alone, the place of the threshold is not.

Defined results: an empty or null text has all measures 0 and gets a score like any other; repeated rows are scored each;
an empty table gives none; without positives every score is 0.5. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import plain, sliced, words
from brindle.llm.common import bounded_sample, id_text, long_rows
from brindle.llm.gru import Adam, glorot, sigmoid

SHAPES = 96
HIDDEN = 16
THRESHOLD = 0.7
_KINDS = ((r"\p{Lu}", "upper"), (r"\p{Ll}", "lower"), (r"\p{Nd}", "digit"), (r"[^\p{L}\p{N}]", "other"))
N_FEATURES = len(_KINDS) + 9 + SHAPES


def _shape(word: str) -> int:
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() else "x", word)
    return xxhash.xxh32_intdigest(re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "9", s))[:16]) % SHAPES


def features(texts: pa.Array) -> np.ndarray:
    """One row of N_FEATURES measures for each whole text."""
    w = words(texts)
    n, text, counts = w.n_texts, w.text_of(), w.counts()
    if not len(w.distinct):
        return np.zeros((n, N_FEATURES), np.float32)
    per = lambda values: np.bincount(text, values[w.codes], n)  # noqa: E731  summed over a text's words
    size = np.asarray(pc.utf8_length(w.distinct), np.float64)
    chars, some = per(size), np.maximum(counts, 1)
    out = [per(np.asarray(pc.count_substring_regex(w.distinct, k), np.float64)) / np.maximum(chars, 1) for k, _ in _KINDS]
    pairs, seen = np.unique(text * len(w.distinct) + w.codes, return_counts=True)
    own = pairs // len(w.distinct)
    most = np.zeros(n)
    np.maximum.at(most, own, seen)
    lists = pc.split_pattern(texts, "\n")
    lines = lists.values.dictionary_encode()
    line_text = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
    line_pairs = np.unique(line_text * np.int64(len(lines.dictionary) + 1) + np.asarray(lines.indices))
    n_lines = np.bincount(line_text, minlength=n)
    runs = text[1:] * 1
    same = (w.codes[1:] == w.codes[:-1]) & (text[1:] == text[:-1])
    out += [
        np.log1p(counts) / 10,
        chars / some / 20,
        np.bincount(own, minlength=n) / some,  # distinct words
        most / some,
        1 - np.bincount(line_pairs // (len(lines.dictionary) + 1), minlength=n) / np.maximum(n_lines, 1),  # repeated lines
        n_lines / some,
        np.bincount(runs, same, n) / some,  # a word after itself
        per((size <= 3).astype(float)) / some,
        per((size >= 15).astype(float)) / some,
    ]
    shape = np.fromiter(map(_shape, w.distinct.to_pylist()), np.int64, len(w.distinct))
    hashed = np.bincount(text * SHAPES + shape[w.codes], minlength=n * SHAPES).reshape(n, SHAPES) / some[:, None]
    return np.concatenate([np.stack(out, 1), hashed], 1).astype(np.float32)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, at most: the least ratio of the tails of both score samples.

    Tails hold at least a tenth of the positives, and the ratio's upper confidence bound is taken, so noise in thin tails
    doesn't pull the estimate down.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


@dataclass
class Net:
    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    shift: float = 0.0
    prior: float = 0.5

    def _forward(self, x: np.ndarray):
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        return x, h, h @ self.p["w2"] + self.p["b2"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2][:, 0] if len(x) else np.zeros(0, np.float32)

    def gradients(self, x: np.ndarray, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        x, h, _ = self._forward(x)
        d = dlogit[:, None].astype(np.float32)
        dh = d @ self.p["w2"].T * (1 - h * h)
        return {"w1": x.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": d.sum(0)}

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip(self.logits(x).astype(np.float64) + self.shift, -30, 30))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _train(net: Net, pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, rng: np.random.Generator, batch: int = 512, rate: float = 0.005) -> Net:
    """prior None: plain positive against unlabelled; else the non-negative risk with logistic loss."""
    adam = Adam(net.p, rate)
    for k in range(steps):
        x = np.concatenate([pos[rng.integers(len(pos), size=batch)], unl[rng.integers(len(unl), size=batch)]])
        g = net.logits(x)
        yes = sigmoid(g)  # derivative of softplus(g), the loss as a negative; that as a positive is yes - 1
        if prior is None:
            d = np.concatenate([(yes - 1)[:batch], yes[batch:]]) / (2 * batch)
        else:
            negative = _softplus(g[batch:]).mean() - prior * _softplus(g[:batch]).mean()
            if negative >= 0:
                d = np.concatenate([prior * (yes - 1)[:batch] - prior * yes[:batch], yes[batch:]]) / batch
            else:
                d = np.concatenate([prior * yes[:batch], -yes[batch:]]) / batch
        adam.update(net.gradients(x, d), 1 - 0.9 * k / steps)
    return net


def _new(x: np.ndarray, seed: int) -> Net:
    rng = np.random.default_rng(seed)
    return Net({"w1": glorot(rng, x.shape[1], HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": glorot(rng, HIDDEN, 1), "b2": np.zeros(1, np.float32)}, x.mean(0), x.std(0) + np.float32(1e-3))


def fit_samples(pos: np.ndarray, unl: np.ndarray, labelled: np.ndarray, quality: np.ndarray, steps: int = 1200, seed: int = 5) -> Net:
    """pos, unl: measures of both samples; labelled, quality: rows that only place the threshold."""
    rng = np.random.default_rng(seed)
    first = _train(_new(unl, seed), pos[::2], unl[::2], None, steps // 2, rng)
    prior = class_prior(first.logits(pos[1::2]), first.logits(unl[1::2]))
    net = _train(_new(unl, seed + 1), pos, unl, prior, steps, rng)
    net.prior = prior
    g = net.logits(labelled)
    if len(np.unique(quality)) == 2:
        order = np.sort(g)
        cuts = np.concatenate([(order[1:] + order[:-1]) / 2, [order[0] - 1]])
        cuts = cuts[np.linspace(0, len(cuts) - 1, min(len(cuts), 400)).astype(int)]
        good, bad = g[quality == 1], g[quality == 0]
        best = max(cuts, key=lambda c: (good >= c).mean() + (bad < c).mean())
        net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - best)
    return net


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `x`, the measures of the column text."""
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = features(plain(batch.column(0)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=schema.names)

    return long_rows(docs).select("text", *keep).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = 4000, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Net | None:
    """Learns from rows of the condition `train` (over the id) alone; None without positives.

    Samples are drawn from ids; only their rows' texts are read, and measured where they lie.
    """
    ids = docs.filter(train & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_text(id_col), F.lit(1)).alias("h"))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    marked = ids.join(known, ids["id"] == known["label_id"]).select("id", "y", "h")
    samples = [(bounded_sample(marked.filter(f"y = {y}"), fit_rows, "h"), kind) for y, kind in ((1, 1), (0, 0))]
    samples.append((bounded_sample(ids, fit_rows, "h"), -1))
    chosen = [s.select("id", F.lit(kind).alias("kind")).distinct() for s, kind in samples]
    chosen = chosen[0].union(chosen[1]).union(chosen[2])  # at most 3 * fit_rows rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = measured(rows.select("text", "kind", F.xxhash64("id", "text").alias("h")), ["kind", "h"])
    rows = rows.orderBy("h", "kind").limit(4 * fit_rows).collect()  # ids that repeat could give more; then the least hashes of id and text
    by = {k: np.array([r["x"] for r in rows if r["kind"] == k], np.float32).reshape(-1, N_FEATURES) for k in (1, 0, -1)}
    by = {k: x[np.lexsort(x.T)] for k, x in by.items()}  # whatever order they came in
    if not len(by[1]) or not len(by[-1]):
        return None
    shuffled = {k: np.random.default_rng(2).permutation(x) for k, x in by.items()}
    return fit_samples(shuffled[1], shuffled[-1], np.concatenate([by[1], by[0]]), np.repeat([1, 0], [len(by[1]), len(by[0])]))


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted for every whole text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s = np.full(batch.num_rows, 0.5) if net is None else net.scores(features(plain(batch.column(1)))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=schema.names)

    return long_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
