"""A gated recurrent language model with a class-factored softmax, and the unigram base that it is held against.

Words are runs without ASCII white space after lower-casing A-Z; every document has one end token after its words.

Blocks. Documents are dealt by a hash of id and text to shards of about BLOCK_BYTES of text and sorted by it. A shard is a block; one
of more than four times that size is cut into several. So a block, and all that is learned from it, is the same however the table is
split into files and tasks. A map step codes each block and writes it with its words and their counts in training documents.

Counting. The blocks' counts are summed by word, first within each task. The most frequent words, VOCABULARY or the square root of
the distinct ones if more, go to all tasks with their counts. Only the other words (each at most 1 / VOCABULARY of all tokens) are
joined with their counts and brought back to the blocks that have them. The blocks themselves are bucketed and never move.

Model. The vocabulary's words have ids by rank, all others share one; a word of those then has its unigram
probability among them, so the model is a distribution over all texts, with the base's half count for unseen words.
Ids are cut into classes of equal mass of square-rooted frequency: p(word) = p(class | state) p(word | class, state). The
network is first fitted on the driver on at most `fit_docs` documents. From there every block goes on by itself over all its training
documents (`one_in` > 1 takes those whose hash falls in one of so many parts), and the blocks' parameters are averaged by tokens
seen. Both use backpropagation through time truncated to a window.

Scoring. All documents of a block advance together; a window's states are kept, its output layer is worked out at once, and the
state is carried into the next window, so a document of any length gets its complete log-likelihood.

Defined results: a null or empty text has the end token alone; repeated rows are scored each and counted each; without training
tokens the model gives the base (each token probability 1); an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import copy
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import give_back, keep_memory, plain, sliced, words
from brindle.llm.common import bounded_sample, id_text, in_fold, long_rows, new_path, written
from brindle.llm.gru import Adam, Reader, backward, forward, glorot, new_layer

#: The end token; no word can be white space.
END = "\n"
VOCABULARY = 2047
HIDDEN = 16
WINDOW = 16
LANES = 128
#: Of a block, which is longer than the driver's sample.
BLOCK_LANES = 512
BLOCK_BYTES = 4 << 20
#: Text bytes of a task that reads blocks back, about.
TASK_BYTES = 64 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(texts: pa.Array) -> pa.Array:
    """A-Z in lower case."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None or not data.size:
        return texts
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(_LOWER[np.frombuffer(data, np.uint8)])], offset=texts.offset)


class ClassLM:
    """Ids 0 .. n - 1 by frequency (0 is the end token), n is every other word."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        """counts: of each id, the last of all other words."""
        rng, n = np.random.default_rng(seed), len(counts)
        self.n, self.seen = n, 0
        mass = np.cumsum(np.sqrt(counts + 1.0))
        classes = max(1, int(np.sqrt(n)))
        self.cls = np.minimum((mass / mass[-1] * classes * (1 - 1e-9)).astype(np.int64), classes - 1)
        self.cls = np.unique(self.cls, return_inverse=True)[1]  # no empty class
        self.start = np.searchsorted(self.cls, np.arange(self.cls[-1] + 2))
        by_class = np.bincount(self.cls, counts + 0.5)
        self.p = new_layer(rng, n, HIDDEN) | {
            "wc": glorot(rng, HIDDEN, len(by_class)) * np.float32(0.1),
            "bc": np.log(by_class / by_class.sum()).astype(np.float32),
            "wo": (rng.standard_normal((n, HIDDEN)) * 0.02).astype(np.float32),
            "bo": np.log((counts + 0.5) / by_class[self.cls]).astype(np.float32),
        }

    def _layer(self) -> dict[str, np.ndarray]:
        return {k: self.p[k] for k in ("x", "hg", "hc")}

    @staticmethod
    def _softmax(logits: np.ndarray, target: np.ndarray, bounded: bool) -> np.ndarray:
        """The logarithm of each target's probability; the logits become exponentials over their sums. bounded: none can overflow."""
        if not bounded:
            logits -= logits.max(1, keepdims=True)
        own = logits[np.arange(len(target)), target]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        logits *= (1 / total)[:, None]
        return own - np.log(total)

    def output(self, states: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """log p(target | state) of each row; with grads also what minus their sum has for a gradient at the states."""
        cls, w, b = self.cls[target], self.p["wo"], self.p["bo"]
        order = np.argsort(cls.astype(np.uint16) if len(self.start) < 1 << 16 else cls, kind="stable")
        states, target, cls = states[order], target[order], cls[order]
        # A state's parts are below 1, so a logit is at most its bias and its weights' magnitudes.
        bounded = max((np.abs(self.p["wc"]).sum(0) + np.abs(self.p["bc"])).max(), (np.abs(w).sum(1) + np.abs(b)).max()) < 40
        prob = states @ self.p["wc"]
        prob += self.p["bc"]
        logp, dstates = self._softmax(prob, cls, bounded), None
        if grads is not None:
            prob[np.arange(len(cls)), cls] -= 1
            grads["wc"] += states.T @ prob
            grads["bc"] += prob.sum(0)
            dstates = prob @ self.p["wc"].T
        cuts = np.searchsorted(cls, np.arange(len(self.start)))
        for c in np.flatnonzero(np.diff(cuts)):
            rows, own = slice(cuts[c], cuts[c + 1]), slice(self.start[c], self.start[c + 1])
            if own.stop - own.start == 1:
                continue
            h, t = states[rows], target[rows] - own.start
            prob = h @ w[own].T
            prob += b[own]
            logp[rows] += self._softmax(prob, t, bounded)
            if grads is not None:
                prob[np.arange(len(t)), t] -= 1
                grads["wo"][own] += prob.T @ h
                grads["bo"][own] += prob.sum(0)
                dstates[rows] += prob @ w[own]
        back = np.empty_like(logp)
        back[order] = logp
        if grads is not None:
            given = np.empty_like(dstates)
            given[order] = dstates
            dstates = given
        return back, dstates

    def gradients(self, before: np.ndarray, target: np.ndarray, h: np.ndarray):
        """Of the mean loss of a window (steps, lanes) from the state h; the loss and the last state. A lane starts anew after an end token."""
        states, kept = forward(self._layer(), before, h, (before != 0).astype(h.dtype))
        grads = {k: np.zeros_like(self.p[k]) for k in ("wc", "bc", "wo", "bo")}
        logp, dstates = self.output(states.reshape(-1, HIDDEN), target.ravel(), grads)
        grads |= backward(self._layer(), kept, dstates.reshape(states.shape))
        size = np.float32(before.size)
        return {k: g / size for k, g in grads.items()}, -float(logp.mean()), states[-1]

    @staticmethod
    def lanes(stream: np.ndarray, most: int) -> tuple[int, int]:
        """How many lanes, and the tokens of each."""
        lanes = max(1, min(most, len(stream) // (2 * WINDOW)))
        return lanes, (len(stream) - 1) // lanes

    def train(self, stream: np.ndarray, adam: Adam, scale=lambda done: 1.0, most: int = LANES) -> float:
        """One pass over a stream of ids with end tokens between documents, in lanes side by side; the mean loss."""
        lanes, length = self.lanes(stream, most)
        if length < 1:
            return 0.0
        target = stream[1 : 1 + lanes * length].reshape(lanes, length).T
        before = stream[: lanes * length].reshape(lanes, length).T
        h, total = np.zeros((lanes, HIDDEN), np.float32), 0.0
        for a in range(0, length, WINDOW):
            grads, loss, h = self.gradients(before[a : a + WINDOW], target[a : a + WINDOW], h)
            adam.update(grads, scale(a / length))
            total += loss * len(before[a : a + WINDOW])
        return total / length

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The natural logarithm of each document's probability; document k has ids[bounds[k]:bounds[k + 1]], its end token the last."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        size, first = size[order], bounds[:-1][order]
        out, h, layer = np.zeros(len(size)), np.zeros((len(size), HIDDEN), np.float32), Reader(self._layer(), len(size))
        live, t, window = len(size), 0, 4 * WINDOW
        while live:
            states, targets, rows = [], [], []
            for _ in range(window):
                live = int(np.searchsorted(-size, -t, "left"))  # of that many documents there is a token t
                if not live:
                    break
                before = ids[first[:live] + t - 1] if t else np.zeros(live, np.int64)
                states.append(np.empty((live, HIDDEN), np.float32))
                layer.step(before, h[:live], states[-1])
                h = states[-1]
                targets.append(ids[first[:live] + t])
                rows.append(np.arange(live))
                t += 1
            if states:
                logp, _ = self.output(np.concatenate(states), np.concatenate(targets))
                out += np.bincount(np.concatenate(rows), logp, len(size))
        back = np.empty(len(size))
        back[order] = out
        return back


@dataclass
class Counts:
    """Training tokens, distinct ones, and the most frequent words with their counts."""

    tokens: int
    distinct: int
    words: list[str]
    counts: list[int]

    def ids(self, distinct: pa.Array) -> np.ndarray:
        """The id of each word."""
        return np.asarray(pc.fill_null(pc.index_in(distinct.cast(pa.large_string()), pa.array(self.words, pa.large_string())), len(self.words)), np.int64)

    def rest(self) -> tuple[int, int]:
        """Training tokens and distinct words that share the last id."""
        return self.tokens - sum(self.counts), self.distinct - len(self.words)


BLOCKS = "block long, ids array<string>, held array<boolean>, hashes array<long>, bounds binary, codes binary, words array<string>, trained array<long>"


def _sharded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Shard, number in it, and rows of each block; rows come sorted by the shard in `column`."""

    def pieces():
        for batch in batches:
            shard = np.asarray(batch.column(column))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist() if len(shard) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(shard[a]), batch.slice(a, b - a)

    for shard, own in groupby(pieces(), lambda x: x[0]):
        for number, rows in enumerate(sliced((x for _, x in own), most=4 * BLOCK_BYTES)):
            yield shard, number, rows


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, held, hash -> one row for each block of documents, bucketed by block."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // BLOCK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, number, batch in _sharded(batches, 4):
            w = words(lower(plain(batch.column(1))))
            n, end = w.n_texts, len(w.distinct)
            bounds = w.bounds + np.arange(n + 1)
            codes = np.full(bounds[-1], end, "<i4")
            codes[np.arange(len(w.codes)) + w.text_of()] = w.codes
            held = np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            trained = np.bincount(codes, np.repeat(~held, np.diff(bounds)), end + 1).astype(np.int64)
            spelled = pa.concat_arrays([w.distinct.cast(pa.string()), pa.array([END])])
            one = lambda x, t: pa.array([x], t)
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [one(-(shard << 24) - number if number else shard, pa.int64()), lists(batch.column(0)), lists(pa.array(held)), lists(batch.column(3)), one(bounds.astype("<i4").tobytes(), pa.binary()), one(codes.tobytes(), pa.binary()), lists(spelled), lists(pa.array(trained))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [x.split()[0] for x in BLOCKS.split(", ")]
    name = f"brindle_blocks_{uuid.uuid4().hex}"
    dealt = long_rows(docs).select(F.col("doc_id").cast("string").alias("id"), "text", "held", "hash", F.pmod("hash", F.lit(shards)).alias("shard"))
    coded = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "hash", "id").mapInArrow(run, BLOCKS)
    coded.write.bucketBy(parts, "block").option("path", new_path(spark, "blocks")).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def counted(coded: DataFrame) -> DataFrame:
    """word, c: how often each word of a training document stands in them."""
    rows = coded.select(F.explode(F.arrays_zip("words", "trained")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.trained").alias("n"))
    return written(rows.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counted")


def vocabulary(counts: DataFrame, size: int | None = None) -> Counts:
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = max(VOCABULARY, math.isqrt(distinct)) if size is None else size
    top = counts.orderBy(F.when(F.col("word") == END, 0).otherwise(1), F.desc("c"), "word").limit(size).collect()  # `size` rows
    return Counts(tokens, distinct, [r["word"] for r in top], [r["c"] for r in top])


def others(coded: DataFrame, counts: DataFrame, known: Counts) -> DataFrame:
    """of_block, code, c of the known words that are not in the vocabulary."""
    common = F.broadcast(coded.sparkSession.createDataFrame([(w,) for w in known.words], "word string"))  # as many as vocabulary() collects
    rows = coded.select(F.col("block").alias("of_block"), F.posexplode("words").alias("code", "word")).join(common, "word", "left_anti")
    return rows.join(counts.hint("merge"), "word").select("of_block", "code", "c")


def fit(docs: DataFrame, coded: DataFrame, counts: Counts, fit_docs: int = 800, one_in: int = 1) -> ClassLM | None:
    """docs: doc_id, text, held, hash. None without training tokens."""
    if not counts.tokens:
        return None
    model = ClassLM(np.array([*counts.counts, counts.rest()[0]], np.float64))
    seed = bounded_sample(docs.filter("not held"), fit_docs, "hash").collect()
    w = words(lower(plain(pa.array([r["text"] for r in seed], pa.large_string()))))
    ids = counts.ids(w.distinct)[w.codes] if len(w.codes) else np.empty(0, np.int64)
    stream = np.concatenate([[0], np.insert(ids, w.bounds[1:], 0)]).astype(np.int64)
    adam = Adam(model.p, 0.01)
    for epoch in range(2):
        model.train(stream, adam, lambda done, e=epoch: 1 - 0.45 * (e + done))
    shared = coded.sparkSession.sparkContext.broadcast((model, counts))
    names = list(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every block goes on from the common model; the sum of the task's blocks' parameters, times the tokens they saw."""
        from pyspark import TaskContext

        keep_memory()
        (common, known), total, seen = shared.value, 0.0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("bounds", "codes", "words", "held", "hashes")}
                bounds, codes = (np.frombuffer(row[c].as_buffer(), "<i4") for c in ("bounds", "codes"))
                held, hashes = (row[c].values.to_numpy(zero_copy_only=False) for c in ("held", "hashes"))
                pick = np.flatnonzero(~held & (hashes % one_in == 0))
                ids = known.ids(row["words"].values)
                stream = np.concatenate([[0], *(ids[codes[bounds[k] : bounds[k + 1]]] for k in pick)]).astype(np.int64)
                own, tokens = copy.deepcopy(common), len(stream) - 1
                adam = Adam(own.p, 0.002)
                while len(stream) > 1:  # what doesn't fill the lanes goes on in fewer
                    lanes, length = own.lanes(stream, BLOCK_LANES)
                    own.train(stream, adam, most=BLOCK_LANES)
                    stream = stream[lanes * length :]
                total = total + np.concatenate([own.p[k].ravel() for k in names]).astype("<f8") * tokens
                seen += tokens
        give_back()
        if not seen:
            return
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part % 256], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["lane", "part", "total", "seen"])

    schema = "lane int, part int, total binary, seen long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by lane; one sum of each."""
        at, total, seen = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["lane"] != at and at is not None:
                    yield pa.RecordBatch.from_pylist([{"lane": at, "part": at, "total": total.tobytes(), "seen": seen}], schema=arrow)
                    total, seen = None, 0
                own = np.frombuffer(row["total"], "<f8")
                at, total, seen = row["lane"], own if total is None else total + own, seen + row["seen"]
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"lane": at, "part": at, "total": total.tobytes(), "seen": seen}], schema=arrow)

    arrow = pa.schema([("lane", pa.int32()), ("part", pa.int32()), ("total", pa.binary()), ("seen", pa.int64())])
    sums = coded.select("bounds", "codes", "words", "held", "hashes").mapInArrow(run, schema)
    for lanes in (256, 8):
        sums = sums.withColumn("lane", F.col("lane") % lanes).repartition(F.col("lane")).sortWithinPartitions("lane", "part").mapInArrow(add, schema)
    last = sums.collect()  # at most 8 rows of the model's fixed size
    model.seen = seen = sum(r["seen"] for r in last)
    if seen:
        mean = sum(np.frombuffer(r["total"], "<f8") for r in sorted(last, key=lambda r: r["lane"])) / seen
        cuts = np.cumsum([model.p[k].size for k in names])[:-1]
        model.p = {k: x.reshape(model.p[k].shape).astype(np.float32) for k, x in zip(names, np.split(mean, cuts), strict=True)}
    return model


def score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text: str = "text", fit_docs: int = 800, one_in: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both base-10 logarithms) of every document."""
    held_out = in_fold(5, 1, id_col) if held_out is None else held_out
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held"), F.xxhash64(id_text(id_col), F.col(text)).alias("hash"))
    coded = blocks(rows)
    counts = counted(coded)
    known = vocabulary(counts)
    model = fit(rows, coded, known, fit_docs, one_in)
    shared = docs.sparkSession.sparkContext.broadcast((model, known))
    kinds = (("id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block, and the counts of its words outside the vocabulary."""
        keep_memory()
        model, known = shared.value
        row = {c: left.column(c)[0] for c in ("ids", "held", "bounds", "codes", "words")}
        bounds, codes = np.frombuffer(row["bounds"].as_buffer(), "<i4").astype(np.int64), np.frombuffer(row["codes"].as_buffer(), "<i4")
        ids = known.ids(row["words"].values)
        c = np.append(np.array(known.counts, np.float64), 0.0)[ids]
        c[np.asarray(right.column("code"))] = np.asarray(right.column("c"))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        per = lambda values: np.bincount(doc, values[codes], len(bounds) - 1)
        base = per(np.log10((c + 0.5) / (known.tokens + 0.5 * (known.distinct + 1))))
        total = base
        if model is not None:
            tokens, distinct = known.rest()
            spelled = np.where(ids == len(known.words), np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))), 0.0)
            total = model.score(ids[codes], bounds) / np.log(10) + per(spelled)
        n = len(bounds) - 1
        give_back()
        columns = (row["ids"].values, row["held"].values, np.diff(bounds), per((c > 0).astype(float)).astype(np.int64), np.full(n, known.tokens), base, total)
        return pa.table({k: pa.array(x, t) for (k, t), x in zip(kinds, columns, strict=True)})

    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    left = coded.select("block", "ids", "held", "bounds", "codes", "words").groupBy("block")
    scored = left.cogroup(others(coded, counts, known).groupBy("of_block")).applyInArrow(run, schema)
    return scored.select(F.col("id").cast(id_type).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
