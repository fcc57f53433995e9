"""Language identification by a bidirectional gated recurrent network over the bytes of whole documents, in NumPy.

Every byte of a text's UTF-8 gets label probabilities, from the state of a layer that has read up to it and of one that has read
back to it; a document's are the mean over all its bytes. Words, spaces and marks are read alike and the state runs through them.
So that long texts are read side by side, each is cut into segments of SEGMENT bytes, and every segment is read with the CONTEXT
bytes before and after it, which only prepare the states: a text up to a segment long is read in one piece, and in a longer
one each byte has at least CONTEXT bytes (or the text's end) behind the states at it. A result depends on the text alone.

The network is fitted by backpropagation through time on the driver. Its labels are all that the training rows have. Of each
label at most `label_docs` documents (those with the smallest hash of the id; a documented bound) give PIECES windows of
FIT_WINDOW bytes, at places dealt over the whole text, cut where the rows lie: what reaches the driver is bounded by the number of labels.

Defined results: a null text, or one without a letter, is `und` with score 0; ties go to the first label in sorted order;
repeated rows are scored each; an empty table gives an empty one; without any labelled document everything is `und`.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import keep_memory, plain, sliced
from brindle.llm.common import id_text, long_rows
from brindle.llm.gru import Adam, Reader, backward, forward, glorot, new_layer

SEGMENT = 1024
CONTEXT = 64
HIDDEN = 12
LANES = 1024  # segments that are read side by side
FIT_WINDOW = 64
PIECES = 8
SPACE = 32
UND = "und"


def segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all segments: the text, the bounds of what is read in it, the bounds of what counts."""
    pieces = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), pieces)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    last = np.minimum(first + SEGMENT, sizes[text])
    return text, np.maximum(first - CONTEXT, 0), np.minimum(last + CONTEXT, sizes[text]), first, last


class ByteBiGru:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        f, b = new_layer(rng, 256, HIDDEN), new_layer(rng, 256, HIDDEN)
        self.p = {**{"f_" + k: v for k, v in f.items()}, **{"b_" + k: v for k, v in b.items()}, "out": glorot(rng, 2 * HIDDEN, len(labels)), "bias": np.zeros(len(labels), np.float32)}

    def _side(self, side: str) -> dict[str, np.ndarray]:
        return {k: self.p[f"{side}_{k}"] for k in ("x", "hg", "hc")}

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean loss over all positions of windows (steps, lanes), and that loss."""
        (steps, lanes), n = data.shape, HIDDEN
        zero = np.zeros((lanes, n), self.p["bias"].dtype)
        f, kept_f = forward(self._side("f"), data, zero)
        b, kept_b = forward(self._side("b"), data[::-1], zero)
        states = np.concatenate([f, b[::-1]], 2)
        logits = states @ self.p["out"] + self.p["bias"]
        prob = np.exp(logits - logits.max(-1, keepdims=True))
        prob /= prob.sum(-1, keepdims=True)
        loss = -float(np.log(np.maximum(prob[:, np.arange(lanes), label], 1e-30)).mean())
        prob[:, np.arange(lanes), label] -= 1
        prob /= prob.dtype.type(steps * lanes)
        grads = {"out": np.tensordot(states, prob, ([0, 1], [0, 1])), "bias": prob.sum((0, 1))}
        dstates = prob @ self.p["out"].T
        for side, kept, d in (("f", kept_f, dstates[:, :, :n]), ("b", kept_b, dstates[::-1, :, n:])):
            grads |= {f"{side}_{k}": v for k, v in backward(self._side(side), kept, d).items()}
        return grads, loss

    def fit(self, data: np.ndarray, label: np.ndarray, steps: int = 200, batch: int = 384, rate: float = 0.03, seed: int = 11) -> ByteBiGru:
        """data: windows (n, FIT_WINDOW) of bytes. Every label is drawn alike."""
        rng = np.random.default_rng(seed)
        adam = Adam(self.p, rate)
        own = [np.flatnonzero(label == k) for k in range(len(self.labels))]
        for k in range(steps):
            drawn = rng.integers(0, len(own), batch)
            rows = np.array([own[d][rng.integers(len(own[d]))] for d in drawn])
            adam.update(self.gradients(np.ascontiguousarray(data[rows].T).astype(np.intp), label[rows])[0], 1 - 0.95 * k / steps)
        return self

    def sums(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Label probabilities of the bytes [first, last) of each lane, summed; lane k is data[start[k]:start[k] + size[k]], sizes fall."""
        steps, lanes, k = int(size[0]), len(size), len(self.labels)
        live = np.searchsorted(-size, -np.arange(steps), "left")  # lanes that have a byte t
        ahead, out = np.empty((steps, lanes, k), np.float32), np.zeros((lanes, k), np.float32)
        h, after, e, total = *(np.zeros((lanes, HIDDEN), np.float32) for _ in range(2)), *(np.empty((lanes, k), np.float32) for _ in range(2))
        layer, weights = Reader(self._side("f"), lanes), np.ascontiguousarray(self.p["out"][:HIDDEN])
        for t in range(steps):
            n = live[t]
            layer.step(data[start[:n] + t], h[:n], after[:n])
            np.matmul(after[:n], weights, out=ahead[t, :n])
            h, after = after, h
        h[:] = 0
        layer, weights, ones = Reader(self._side("b"), lanes), np.ascontiguousarray(self.p["out"][HIDDEN:]), np.ones((k, k), np.float32)
        bias = np.tile(self.p["bias"], (lanes, 1))
        all_from, all_to = first.max(), last.min()
        for t in reversed(range(steps)):  # lanes join where they end
            n = live[t]
            layer.step(data[start[:n] + t], h[:n], h[:n])
            p, s = e[:n], total[:n]
            np.matmul(h[:n], weights, out=p)
            p += ahead[t, :n]
            p += bias[:n]
            np.exp(p, out=p)  # |state| < 1, so logits are as bounded as the weights
            np.matmul(p, ones, out=s)
            p /= s
            if not all_from <= t < all_to:
                p *= ((t >= first[:n]) & (t < last[:n]))[:, None]
            out[:n] += p
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Label probabilities of each text, as plain() gives them (rows of zeros for empty ones)."""
        _, offsets, data = texts.buffers()
        out = np.zeros((len(texts), len(self.labels)))
        if not len(texts) or data is None or not data.size:
            return out
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)
        sizes = np.diff(bounds)
        text, lo, hi, first, last = segments(sizes)
        order = np.argsort(lo - hi, kind="stable")
        for a in range(0, len(order), LANES):
            own = order[a : a + LANES]
            t = text[own]
            np.add.at(out, t, self.sums(data, bounds[t] + lo[own], hi[own] - lo[own], first[own] - lo[own], last[own] - lo[own]))
        return out / np.maximum(sizes, 1)[:, None]


def fit_windows(texts: list[str], seeds: np.ndarray) -> np.ndarray:
    """PIECES windows of each text: one from each of as many equal parts of it; a shorter text with spaces after it."""
    rows = []
    for text, seed in zip(texts, seeds.tolist(), strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        rng = np.random.default_rng(seed & 0xFFFFFFFF)
        room = len(data) - FIT_WINDOW
        if room <= 0:
            rows.append(np.pad(data, (0, -room), constant_values=SPACE)[None])
            continue
        at = ((np.arange(PIECES) + rng.random(PIECES)) / PIECES * room).astype(np.int64)
        rows.append(data[np.unique(at)[:, None] + np.arange(FIT_WINDOW)])
    return np.concatenate(rows) if rows else np.empty((0, FIT_WINDOW), np.uint8)


def fit(docs: DataFrame, train: Column, label_docs: int = 600, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> ByteBiGru | None:
    """Learns from the rows of the condition `train` with text and label, at most label_docs of each label; None if there is none."""
    rows = docs.filter(train & F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(id_text(id_col)).alias("h"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row for each label
    if not counts:
        return None
    labels = sorted(counts)
    # A hash limit of each label that about one and a half times as many rows stay under, so that no task sends more than its share.
    limit = {k: (1 << 63) - 1 if n <= 2 * label_docs else int(-(1 << 63) + (1 << 64) * 1.5 * label_docs / n) for k, n in counts.items()}
    under = F.create_map(*[F.lit(x) for k in labels for x in (k, limit[k])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, seeds = plain(batch.column(0)).to_pylist(), np.asarray(batch.column(2))
            own = [fit_windows([t], seeds[k : k + 1]).tobytes() for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.binary())], names=["label", "h", "windows"])

    drawn = long_rows(rows.filter(F.col("h") <= under[F.col("label")])).mapInArrow(cut, "label string, h long, windows binary")
    found: dict[str, list] = {k: [] for k in labels}
    for r in drawn.collect():  # at most about twice label_docs rows of each label, of PIECES windows each
        found[r["label"]].append((r["h"], bytes(r["windows"])))
    data = [np.frombuffer(b"".join(w for _, w in sorted(found[k])[:label_docs]), np.uint8).reshape(-1, FIT_WINDOW) for k in labels]
    return ByteBiGru(labels).fit(np.concatenate(data), np.repeat(np.arange(len(labels)), [len(x) for x in data]))


def predict(docs: DataFrame, model: ByteBiGru | None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, and the columns named in keep."""
    extra = [T.StructField(k, docs.schema[k].dataType) for k in keep]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *extra])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size for each label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        model = shared.value
        for batch in sliced(batches):
            texts = plain(batch.column(1))
            has = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
            name, score = np.full(len(has), UND, object), np.zeros(len(has))
            if model is not None and has.any():
                prob = model.texts(pc.if_else(pa.array(has), texts, ""))
                name = np.where(has, np.array(model.labels, object)[prob.argmax(1)], UND)
                score = np.where(has, prob.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), *batch.columns[2:]], names=schema.names)

    return long_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *keep).mapInArrow(run, schema)
