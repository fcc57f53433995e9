"""Benchmark decontamination: a BM25 inverted index of test items, asked with every passage of the corpus by block-max WAND.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. An item's postings weigh its terms by BM25,
divided by the item's score against itself, so a passage scores 0 to 1 and one threshold serves items of all lengths. Document
frequencies, the number of items and their mean length are those of the whole benchmark, counted before anything is cut into shards.
Items are of one class if their numbers of words round up to the same power of two, 2^c. Passages for a class are windows of 2 * 2^c
words, 2^c apart, so any item that stands in a text stands whole in one of them, and no other item has a say in how a text is cut.

A passage is first bounded from above: common terms can give an item at most its own share of them, so rare terms must
give the rest of the threshold. (Terms of items that are mostly made of common ones count as rare, the rarest first, until at most
MOSTLY of the item's score is left to common ones.) Sums of the rare terms' largest weights, and then of what they give each item, are taken for
all passages of a batch at once and leave few. Those run block-max WAND, which retrieves every item at or above the threshold and
leaps over blocks of postings. Each hit is then verified: the shares of
the question's and of the answer's word runs that stand in the passage. An item's answer is its last sentence (of a
single one the last fifth), its question the rest. Both parts reaching their shares accept it, and so do `question` of the runs
of the whole item or ALONE of the question's: a short answer that is missing or changed vetoes nothing.

The indexes of a shard of items of at most `shard_bytes` travel with the task; a larger benchmark is taken in several shards, each
asked with the whole corpus, one after the other with its hits written and its indexes taken from the executors before the next. There is no cap
on items, passages or hits, and every row is the same however many shards there are.

Defined results: null or empty texts and items have no hit; repeated rows give repeated hits; equal items all hit; an empty
table on either side gives none. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import plain, sliced, spread, words
from brindle.llm.common import long_rows, written
from brindle.llm.license_scan import normal

K1, B = 1.2, 0.75
BLOCK = 16
#: A term is common if more than this share of the items has it.
COMMON = 0.05
#: What common terms may give an item at most.
MOSTLY = 0.3
RUN = 3
#: A question of which so many runs stand in a passage is found, whatever there is of the answer.
ALONE = 0.9


def tokens(text: str | None) -> list[str]:
    w = words(normal(pa.array([text or ""], pa.large_string())))
    return [x.as_py() for x in w.distinct.take(pa.array(w.codes))]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of both parts."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if tokens(p)]
    if len(parts) > 1:
        return tokens(" ".join(parts[:-1])), tokens(parts[-1])
    ws = tokens(text)
    cut = len(ws) - max(1, len(ws) // 5)
    return ws[:cut], ws[cut:]


def runs(ws: list[str], n: int) -> set[tuple[str, ...]]:
    """All runs of n words; of fewer words, the one run of all."""
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


@dataclass
class Statistics:
    """Of a whole benchmark: how many items have words, their mean number, and how many items have each word (of those that are asked for)."""

    n: int
    mean: float
    df: dict[str, int]

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Statistics:
        own = [ws for _, t in items if (ws := tokens(t))]
        return Statistics(len(own), sum(map(len, own)) / max(1, len(own)), Counter(w for ws in own for w in set(ws)))


def length_class(n_words: int) -> int:
    return max(0, n_words - 1).bit_length()


class BlockMaxIndex:
    """Postings in blocks with their largest weights. Weights of an item's terms sum to 1."""

    def __init__(self, items: list[tuple[int, str]], of: Statistics | None = None):
        of = of or Statistics.of(items)
        self.items = [(i, t, tokens(t)) for i, t in items]
        self.items = [x for x in self.items if x[2]]
        self.stride = 1 << max((length_class(len(ws)) for _, _, ws in self.items), default=0)
        self.parts = [tuple(runs(p, RUN) for p in question_answer(t)) for _, t, _ in self.items]
        lists: dict[str, list[tuple[int, float]]] = {}
        weights, rare = [], set()
        for k, (_, _, ws) in enumerate(self.items):
            own = {w: math.log(1 + (of.n - of.df[w] + 0.5) / (of.df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / of.mean)) for w, f in Counter(ws).items()}
            total = sum(own.values())
            weights.append({w: x / total for w, x in own.items()})
            left = 1.0
            for w in sorted(own, key=lambda w: (of.df[w], w)):
                if of.df[w] > max(1, COMMON * of.n) and left <= MOSTLY:
                    break
                rare.add(w)
                left -= weights[-1][w]
            for w, x in weights[-1].items():
                lists.setdefault(w, []).append((k, x))
        self.common = np.array([sum(x for w, x in own.items() if w not in rare) for own in weights])
        self.rare = sorted(rare)
        self.rare_max = np.array([max(x for _, x in lists[w]) for w in self.rare])
        self.rare_bounds = np.cumsum([0, *(len(lists[w]) for w in self.rare)])
        self.rare_items = np.array([k for w in self.rare for k, _ in lists[w]], np.int64)
        self.rare_weights = np.array([x for w in self.rare for _, x in lists[w]])
        self.postings = {w: ([k for k, _ in p], [x for _, x in p], max(x for _, x in p), [max(x for _, x in p[a : a + BLOCK]) for a in range(0, len(p), BLOCK)]) for w, p in lists.items()}

    def possible(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> np.ndarray:
        """Which passages [lo, hi) can have an item at the threshold; term has the number of each word's rare term, or -1.

        First by the rare terms' largest weights, then by what they give each single item.
        """
        floor = threshold - self.common - 1e-6
        if not len(floor) or not len(lo):
            return np.empty(0, np.int64)
        if floor.min() <= 0:
            return np.arange(len(lo))
        value = np.append(self.rare_max, 0.0)[term]
        total = np.concatenate([[0.0], np.cumsum(value)])
        first = np.flatnonzero(total[hi] - total[lo] >= floor.min())
        at = np.flatnonzero(term >= 0)
        a, b = np.searchsorted(at, lo[first]), np.searchsorted(at, hi[first])
        pairs = np.unique(np.repeat(np.arange(len(first)), b - a) * len(self.rare) + term[at[spread(a, b - a)]])
        passage, own = pairs // len(self.rare), pairs % len(self.rare)
        count = np.diff(self.rare_bounds)[own]
        posting = spread(self.rare_bounds[own], count)
        cells, where = np.unique(np.repeat(passage, count) * len(self.items) + self.rare_items[posting], return_inverse=True)
        score = np.bincount(where, self.rare_weights[posting], len(cells))
        return first[np.unique(cells[score >= floor[cells % len(self.items)]] // len(self.items))]

    def search(self, terms: set[str], threshold: float) -> list[tuple[int, float]]:
        """All items (by their number) whose score reaches the threshold."""
        end, slack = len(self.items), 1e-9
        cursors = [[p[0][0], 0, p] for w in terms if (p := self.postings.get(w))]  # item, place, posting
        found = []

        def seek(c: list, item: int) -> None:
            ks, block = c[2][0], c[1] // BLOCK
            while (block + 1) * BLOCK <= len(ks) and ks[(block + 1) * BLOCK - 1] < item:  # whole blocks, by their last items
                block += 1
            at = bisect_left(ks, item, max(c[1], block * BLOCK), min(len(ks), (block + 1) * BLOCK))
            c[0], c[1] = ks[at] if at < len(ks) else end, at

        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2][2]
                if bound >= threshold - slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound, until = 0.0, end
            for c in cursors[: pivot + 1]:
                ks, at = c[2][0], c[1]
                block = at // BLOCK
                while (block + 1) * BLOCK <= len(ks) and ks[(block + 1) * BLOCK - 1] < item:  # the block that could hold the item
                    block += 1
                if block * BLOCK < len(ks):
                    block_bound += c[2][3][block]
                    until = min(until, ks[min((block + 1) * BLOCK, len(ks)) - 1] + 1)
            if block_bound >= threshold - slack:
                if cursors[0][0] == item:
                    score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold - slack:
                        found.append((item, score))
                    for c in cursors[: pivot + 1]:
                        seek(c, item + 1)
                else:
                    for c in cursors[:pivot]:
                        if c[0] < item:
                            seek(c, item)
            else:
                if pivot + 1 < len(cursors):
                    until = min(until, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    seek(c, max(until, item + 1))

    def overlap(self, k: int, ws: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's runs that stand in the passage."""
        out = []
        for part in self.parts[k]:
            if not part:
                out.append(1.0)
                continue
            sizes = {len(r) for r in part}
            own = set().union(*(runs(ws, n) for n in sizes))
            out.append(len(part & own) / len(part))
        return out[0], out[1]

    def accepts(self, k: int, q: float, a: float, question: float, answer: float) -> bool:
        """Whether overlaps q and a verify an item."""
        of_q, of_a = map(len, self.parts[k])
        return (q >= question and a >= answer) or (of_q > 0 and q >= max(ALONE, question)) or q * of_q + a * of_a >= question * (of_q + of_a) - 1e-9


def _found(indexes: list[BlockMaxIndex], texts: pa.Array, threshold: float, question: float, answer: float) -> dict[tuple[int, int, int], tuple]:
    """(text, index, item) -> (score, -start, question overlap, answer overlap) of the best verified passage."""
    w = words(normal(texts))
    n = w.counts()
    rows: dict[tuple[int, int, int], tuple] = {}
    for number, index in enumerate(indexes):
        rare, stride = pa.array(index.rare, pa.large_string()), index.stride
        term = np.asarray(pc.fill_null(pc.index_in(w.distinct, rare), -1), np.int64)[w.codes]
        passages = np.where(n > 0, 1 + np.maximum(0, -(-(n - 2 * stride) // stride)), 0)
        text = np.repeat(np.arange(len(n)), passages)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)) * stride
        lo = w.bounds[text] + start
        hi = np.minimum(lo + 2 * stride, w.bounds[text + 1])
        for p in index.possible(term, lo, hi, threshold):
            ws = w.distinct.take(pa.array(w.codes[lo[p] : hi[p]])).to_pylist()
            for k, score in index.search(set(ws), threshold):
                q, a = index.overlap(k, ws)
                if index.accepts(k, q, a, question, answer):
                    at = (int(text[p]), number, k)
                    rows[at] = max(rows.get(at, (-1.0,)), (score, -int(start[p]), q, a))
    return rows


def _shards(benchmark: DataFrame, shard_bytes: int, item_id: str, item_text: str) -> Iterator[tuple[list[BlockMaxIndex], bool]]:
    """Indexes of about shard_bytes of items each, one for each length class, one shard at a time; whether it is the only one."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's words once, and an empty word with the number of its words."""
        for batch in sliced(batches):
            w = words(normal(plain(batch.column(0))))
            pairs = np.unique(w.text_of() * max(1, len(w.distinct)) + w.codes) % max(1, len(w.distinct))
            n = w.counts()[w.counts() > 0]
            both = pa.concat_arrays([w.distinct.take(pa.array(pairs, pa.int64())), pa.array([""] * len(n), pa.large_string())]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([both, pa.array(np.append(np.ones(len(pairs), np.int64), n), pa.int64())], names=["word", "n"])

    if shards > 1:
        items = written(items, "items")
        counted = written(items.select("text").mapInArrow(distinct, "word string, n long").groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("words")), "frequencies")
        whole = counted.filter("word = ''").first()
    for s in range(shards):
        own = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s).orderBy("item_id", "text").collect()]  # about shard_bytes
        of = Statistics.of(own)
        if shards > 1:
            asked = benchmark.sparkSession.createDataFrame([(w,) for w in of.df], "word string")
            df = {r["word"]: r["df"] for r in counted.join(asked, "word").select("word", "df").collect()}  # the words of this shard
            of = Statistics(whole["df"] if whole else 0, whole["words"] / whole["df"] if whole else 0.0, df)
        classes: dict[int, list] = {}
        for x in own:
            if ws := tokens(x[1]):
                classes.setdefault(length_class(len(ws)), []).append(x)
        yield [BlockMaxIndex(classes[c], of) for c in sorted(classes)], shards == 1


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.4, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start (of the best passage, in words), score, question_overlap, answer_overlap: one row per document and item."""
    from pyspark.sql.pandas.types import to_arrow_type

    passages = long_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    item_type = benchmark.schema[item_id].dataType
    fields = (("item_id", item_type), ("start", T.LongType()), ("score", T.DoubleType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType()))
    schema, item_arrow = T.StructType([passages.schema["doc_id"], *[T.StructField(*f) for f in fields]]), to_arrow_type(item_type)

    def hits(indexes: list[BlockMaxIndex], only: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                rows = _found(shared.value, plain(batch.column(1)), threshold, question, answer)
                ids = sorted(rows)
                best = [rows[x] for x in ids]
                item = pa.array([shared.value[i].items[k][0] for _, i, k in ids]).cast(item_arrow) if ids else pa.array([], item_arrow)
                scores = (pa.array([x[c] for x in best], pa.float64()) for c in (0, 2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([t for t, _, _ in ids], pa.int64())), item, pa.array([-x[1] for x in best], pa.int64()), *scores], names=schema.names)

        found = passages.mapInArrow(run, schema)
        if not only:
            found = written(found, "hits")
            shared.unpersist()
        return found

    return reduce(DataFrame.union, [hits(*x) for x in _shards(benchmark, shard_bytes, item_id, item_text)])


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.4, shard_bytes: int = 16 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in whose text no item is found, whole; a filter where the rows lie, whatever their ids."""

    def without(rows: DataFrame, shard: tuple[list[BlockMaxIndex], bool]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(shard[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                dirty = {t for t, _, _ in _found(shared.value, plain(batch.column(0)), threshold, question, answer)}
                yield batch.filter(pa.array([t not in dirty for t in range(batch.num_rows)], pa.bool_()))

        left = rows.mapInArrow(run, rows.schema)
        if not shard[1]:
            left = written(left, "clean")
            shared.unpersist()
        return left

    whole = long_rows(docs).select(F.col(text).alias("text"), F.struct("*").alias("whole"))
    return reduce(without, _shards(benchmark, shard_bytes, item_id, item_text), whole).select("whole.*")
