"""Exact substring deduplication over a log-structured index of window fingerprints.

A window is `n` consecutive words. Every window has a fingerprint: the least hash of its K-word runs. Consecutive windows
of a document with one fingerprint form a span, which is one entry: fingerprint, an independent hash of all the span's
words (the verification: both are 64 bits), document and place. Equal windows have equal fingerprints, so only entries with a common
fingerprint are ever compared; where also the span's hash is equal, every window of the span stands earlier too. Where one
fingerprint has different spans (the edges of a copied passage), the windows of one representative of each span are compared
one by one in the same way.

The index is log-structured. Documents come in batches in the order of their keys. Each batch's first entries are written
as one immutable run, bucketed and sorted by fingerprint; a new batch's run is merge-joined with each older run without
moving either. When there are more than `most_runs`, runs are compacted into one, by merge joins that move nothing either. A manifest, written
anew with every change, names the runs, so an index can be opened again and go on with later documents.

A third of all documents may hold one passage: entries are resolved within each map step first, so a hot fingerprint is
shuffled at most once per step, not once per document, and nothing is ever listed by fingerprint.

Defined results: a null or empty text has no words; a text shorter than a window loses nothing; ids that are null or repeated
are ordered by (id, text hash), nulls first, and fully repeated rows count as one document and get one result each; an empty table
gives none. Columns of other names are carried in one struct and never clash.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import Words, mix, plain, rolling, run_starts, sliced, words
from brindle.llm.common import join_hot, keyed, long_rows, new_path, written

#: Words of a run whose least hash is a window's fingerprint.
K = 6
#: Windows of a span at most; a place is start * SPAN + number of windows.
SPAN = 64
ENTRY = "fp long, span long, key long, pos long"
FIRST, MIXED, AGAIN = 0, 1, 2  # the first of its span; that, where the fingerprint has several spans; a later one


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Hashes:
    """Two independent hashes of the words of a batch, and of any range of them."""

    def __init__(self, w: Words):
        raw = w.distinct.cast(pa.large_binary()).to_pylist()
        self.a = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))[w.codes]
        b = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))[w.codes]
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(b), x, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * power(base)[:-1])])
        self.back = power(inverse)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words start .. end - 1, independent of `a`."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def spans(w: Words, n: int) -> tuple[np.ndarray, ...]:
    """Fingerprint, hash, place in the batch and number of windows of each span, and whether a window may stand in it twice."""
    starts = run_starts(w.bounds, n)
    none = np.empty(0, np.int64)
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none.astype(bool)
    k = min(K, n)
    h = Hashes(w)
    runs = rolling(h.a, k)
    least = sliding_min(runs, n - k + 1)
    most = np.full(len(runs) + n - k, 0, np.uint64)  # a run is picked if it is the least of some window around it
    most[n - k : n - k + len(least)] = least
    picked = np.flatnonzero(runs == ~sliding_min(~most, n - k + 1)[: len(runs)])
    order = np.lexsort((picked, runs[picked]))
    near = (np.diff(runs[picked][order]) == 0) & (np.diff(picked[order]) <= SPAN + n)
    twice = np.unique(runs[picked][order][1:][near])
    least = least[starts]
    text = np.repeat(np.arange(w.n_texts), np.maximum(w.counts() - n + 1, 0))
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    since = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    first = np.flatnonzero(since % (SPAN - 1) == 0)
    count = np.diff(np.append(first, len(starts)))
    lo = starts[first]
    return least[first], h.ranges(lo, lo + count + n - 1), lo, count, np.isin(least[first], twice)


def _grouped(fp, span, key, pos, kind):
    """The rows in order of the first four; whether a row is the first of its span, and whether it is that first row again."""
    order = np.lexsort((pos, key, span, fp))
    fp, span, key, pos, kind = fp[order], span[order], key[order], pos[order], kind[order]
    new = np.ones(len(order), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (span[1:] != span[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.empty(0, np.int64)
    return fp, span, key, pos, kind, new, (key == key[lead]) & (pos == pos[lead])


def _entries(fp, span, key, pos, kind) -> pa.RecordBatch:
    """Entries of one step: first ones, and those that stand earlier in this very step, at once as AGAIN."""
    fp, span, key, pos, kind, new, same = _grouped(fp, span, key, pos, kind)
    keep = new | ~same
    fp, span, key, pos, kind, again = fp[keep], span[keep], key[keep], pos[keep], kind[keep], ~new[keep]
    fp = np.where(again, mix(key.view(np.uint64) + pos.view(np.uint64)).view(np.int64), fp)  # they need no common place any more
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, span, key, pos)] + [pa.array(np.where(again, AGAIN, kind).astype(np.int8))], names=["fp", "span", "key", "pos", "kind"])


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """key, text -> entries of all spans; later ones of a step have kind AGAIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            w = words(plain(batch.column(1)))
            fp, span, lo, count, twice = spans(w, n)
            text = np.searchsorted(w.bounds, lo, "right") - 1
            key = np.asarray(batch.column(0))[text]
            yield _entries(fp.view(np.int64), span.view(np.int64), key, (lo - w.bounds[text]) * SPAN + count, np.where(twice, MIXED, FIRST))

    return long_rows(docs).select("key", "text").mapInArrow(run, f"{ENTRY}, kind byte")


def windows_of(docs: DataFrame, n: int) -> DataFrame:
    """key, text, places -> an entry for each window of the spans at these places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            w = words(plain(batch.column(1)))
            h = Hashes(w)
            lists = batch.column(2)
            pos, size = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths(), np.int64)
            text = np.repeat(np.repeat(np.arange(len(size)), size), pos % SPAN)
            first = np.repeat(np.cumsum(pos % SPAN) - pos % SPAN, pos % SPAN)
            start = np.repeat(pos // SPAN, pos % SPAN) + np.arange(len(first)) - first
            at = w.bounds[text] + start
            a = rolling(h.a, n, 3)[at] if len(at) else np.empty(0, np.uint64)
            yield _entries(a.view(np.int64), h.ranges(at, at + n).view(np.int64), np.asarray(batch.column(0))[text], start * SPAN + 1, np.zeros(len(at), np.int64))

    return docs.select("key", "text", "places").mapInArrow(run, f"{ENTRY}, kind byte")


def resolve(entries: DataFrame, parts: int) -> DataFrame:
    """Sorts entries by fingerprint and marks each FIRST, MIXED or AGAIN. Holds one batch and one entry: what a fingerprint's first span is to be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int64()] * 4, pa.int8())
        made = lambda columns: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["fp", "span", "key", "pos", "kind"])
        before, several_before, held = None, False, None  # the last span's first entry; whether its fingerprint has several; its first entry, as long as it has one
        for batch in batches:
            again = np.asarray(batch.column(4)) == AGAIN
            if again.any():
                yield batch.filter(pa.array(again))
                batch = batch.filter(pa.array(~again))
            if not batch.num_rows:
                continue
            columns = [np.asarray(c) for c in batch.columns]
            if before is not None:
                columns = [np.append(np.array([x], y.dtype), y) for x, y in zip((*before, FIRST), columns, strict=True)]
            fp, span, key, pos, kind = columns
            group, new = np.ones(len(fp), bool), np.ones(len(fp), bool)
            group[1:] = fp[1:] != fp[:-1]
            new[1:] = group[1:] | (span[1:] != span[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
            keep = new | (key != key[lead]) | (pos != pos[lead])
            number = np.cumsum(group) - 1
            several = np.bincount(number, new) > 1
            several[0] |= several_before
            kind = np.where(new, np.where(several[number], MIXED, kind), AGAIN)
            if before is not None:
                keep[0] = False
            if held is not None and (several[0] or len(several) > 1):
                yield made([[x] for x in (*held[:4], MIXED if several[0] else held[4])])
                held = None
            if not several[-1] and held is None:
                first = int(np.searchsorted(number, number[-1]))
                held, keep[first] = tuple(int(x[first]) for x in (fp, span, key, pos, kind)), False
            yield made([x[keep] for x in (fp, span, key, pos, kind)])
            before, several_before = tuple(int(x) for x in (fp[-1], span[-1], key[lead[-1]], pos[lead[-1]])), bool(several[-1])
        if held is not None:
            yield made([[x] for x in held])

    return entries.repartition(parts, "fp").sortWithinPartitions("fp", "span", "key", "pos").mapInArrow(run, f"{ENTRY}, kind byte")


@contextmanager
def merge_joins(spark: SparkSession):
    """Joins of bucketed runs use their order: a bucket on the first key serves a join on several."""
    names = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.join.preferSortMergeJoin": "true"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Index:
    """Immutable runs, oldest first; each a table of first entries bucketed and sorted by fingerprint, named by the folder's newest manifest."""

    spark: SparkSession
    folder: str
    parts: int
    most_runs: int = 1
    runs: list[str] = field(default_factory=list)
    version: int = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The index that the folder's newest manifest names, in this session or another than the one that wrote it."""
        newest = spark.read.schema("value string, version int").option("wholetext", True).text(f"{folder}/manifest").orderBy(F.desc("version")).first()
        found = json.loads(newest["value"])
        index = cls(spark, folder, found["parts"], found["most_runs"], found["runs"], newest["version"])
        for name in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, span BIGINT, key BIGINT, pos BIGINT, kind TINYINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp, span) INTO {index.parts} BUCKETS LOCATION '{folder}/{name}'")
        return index

    def save(self) -> None:
        self.version += 1
        text = json.dumps({"parts": self.parts, "most_runs": self.most_runs, "runs": self.runs})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/version={self.version}")

    def _write(self, entries: DataFrame) -> str:
        name = f"brindle_run_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.parts, "fp").sortBy("fp", "span").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def _first(self, name: str) -> DataFrame:
        return self.spark.table(name).filter(F.col("kind") < AGAIN).drop("kind")

    def add(self, docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """Appends a batch (key, text); gives (key, pos) of its spans that stand earlier, and of representatives to compare by window."""
        name = self._write(resolve(fingerprints(docs, n), self.parts))
        table, run = self.spark.table(name), self._first(name)
        again, mixed = [table.filter(F.col("kind") == AGAIN).select("key", "pos")], [table.filter(F.col("kind") == MIXED).select("key", "pos")]
        with merge_joins(self.spark):
            for old in map(self._first, self.runs):
                again.append(written(run.join(old.select("fp", "span").hint("merge"), ["fp", "span"], "left_semi").select("key", "pos"), "again"))
                both = written(run.join(old.select("fp").distinct().hint("merge"), "fp", "left_semi").union(old.join(run.select("fp").distinct().hint("merge"), "fp", "left_semi")), "both")
                several = both.groupBy("fp").agg(F.min("span").alias("a"), F.max("span").alias("b"), F.count("*").alias("n")).filter("a < b").select("fp", "n")
                mixed.append(join_hot(both, several, "fp", both.count()).select("key", "pos"))
        self.runs.append(name)
        if len(self.runs) > self.most_runs:
            self.compact()
        self.save()
        return reduce(DataFrame.union, again), reduce(DataFrame.union, mixed)

    def compact(self) -> None:
        """All runs in one: the earliest entry of each span. Runs are merged where they lie, bucket by bucket; the older ones' files stay for who reads them."""
        every = self._first(self.runs[0])
        for name in self.runs[1:]:
            new = self._first(name).select("fp", "span", F.struct("key", "pos").alias("new"))
            old = every.select("fp", "span", F.struct("key", "pos").alias("old"))
            every = old.join(new.hint("merge"), ["fp", "span"], "full_outer").select("fp", "span", F.coalesce("old", "new").alias("first")).select("fp", "span", "first.*")  # an older run's documents are earlier
        with merge_joins(self.spark):
            self.runs = [self._write(every.withColumn("kind", F.lit(FIRST).cast("byte")))]


def _cut(docs: DataFrame, n: int, text: str) -> DataFrame:
    """row, places -> row, n_words, n_removed, kept_text."""
    schema = T.StructType([docs.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (pa.RecordBatch.from_arrays([*b.columns, pc.struct_field(b.column(0), text)], names=["row", "places", "text"]) for b in batches)
        for batch in sliced(with_text):
            w = words(plain(batch.column(2)))
            lists = batch.column(1)
            pos, size = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths().fill_null(0), np.int64)
            at = np.repeat(w.bounds[:-1], size) + pos // SPAN
            edge = np.zeros(len(w.codes) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + pos % SPAN + n - 1, -1)
            kept = np.cumsum(edge[:-1]) == 0
            before = np.concatenate([[0], np.cumsum(kept)])[w.bounds]
            spelled = pa.LargeListArray.from_arrays(pa.array(before, pa.int64()), w.distinct.take(pa.array(w.codes[kept])))
            joined = pc.binary_join(spelled, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts()), pa.array(w.counts() - np.diff(before)), joined], names=schema.names)

    return long_rows(docs).select("row", "places").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, n: int = 20, batches: int = 2, parts: int | None = None, index: Index | None = None, id_col: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """row (all columns of docs), n_words, n_removed, kept_text: words covered by a window that starts earlier are removed.

    The documents are added to the index in `batches` ranges of their keys, the smallest first. With an index that has documents
    already, `history` (with the same two columns) gives those; docs' ids are whole numbers, each once, above all of theirs.
    """
    spark = docs.sparkSession
    index = index or Index(spark, new_path(spark, "index"), parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, unique = keyed(docs, id_col, text)
    if history is not None and not unique:
        raise ValueError("documents that are added to an index need ids that are whole numbers, each once")
    cuts = rows.select("key").approxQuantile("key", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(c) for c in cuts or []})
    ranges = [(a, b) for a, b in zip([None, *edges], [*edges, None], strict=True)]
    known = None if history is None else history.select(F.col(id_col).cast("long").alias("key"), F.col(text).alias("text"))
    removed = []
    for low, high in ranges:
        batch = rows
        if low is not None:
            batch = batch.filter(F.col("key") > low)
        if high is not None:
            batch = batch.filter(F.col("key") <= high)
        again, mixed = index.add(batch.select("key", "text"), n)
        places = mixed.distinct().groupBy("key").agg(F.collect_list("pos").alias("places"))  # of one document
        seen = rows if high is None else rows.filter(F.col("key") <= high)
        texts = seen.select("key", "text") if unique else seen.select("key", "text").distinct()
        compared = windows_of((texts if known is None else known.union(texts)).join(places, "key"), n)
        single = written(resolve(compared, index.parts).filter(F.col("kind") == AGAIN).select("key", "pos"), "single")
        removed += [again, single]
    places = reduce(DataFrame.union, removed).groupBy("key").agg(F.collect_list("pos").alias("places"))  # bounded by the windows of one document
    return _cut(rows.select("key", "row").join(places, "key", "left"), n, text)
