"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Shingles are runs of five words; a text with fewer has one, of all its words. A shingle's weight in a text is its count
times 1 + DAMP * idf, with idf = ln(N / df) / ln(RARE) between 0 (in every text) and 1 (in one of RARE texts, or fewer). So it is the
same function of a shingle's share of the texts at every size. A share down to 1 / RARE is what the sketch tells well: two rows of
COUNTERS hashed counters, each less its mean load, of which the smaller counts. A counter's mean load is the mean number of a text's
shingles / COUNTERS of all texts, again at every size. DAMP is below 1 so that near copies in groups that hold much of a table, whose
common shingles are frequent and whose own ones rare, keep a weighted similarity near the plain one.

Texts with the same words are one class and only its least document goes on. Each class draws BANDS * ROWS samples; those
that agree in a band meet in a bucket. No bucket is ever paired out: every member is compared with the bucket's least, links
make components, and only where a bucket still holds several components are members compared, in blocks, those of the bucket's largest
component with the others alone. Before texts are read, AGREE of the samples must agree, which a pair of similarity 0.8 misses with
a chance of 1.2e-7 (and all its bands with one of 6e-4).
All candidates are verified on whole texts. No partner or candidate is ever capped. Joins that move texts or samples are
merge joins at every size, so what a small table shows holds for a large one; keys that may hold much of a table are joined by join_hot.

Defined results: texts without a word are classes of their own; ids that are null or repeated are ordered by (id, text
hash), and fully repeated rows share a class; an empty table gives none; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import Words, mix, plain, rolling, run_starts, sliced, words
from brindle.llm.common import join_hot, keyed, long_rows, written
from brindle.llm.components import components
from brindle.llm.substring_dedup import Hashes

SHINGLE = 5
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
DAMP = 0.3
RARE = 256
COUNTERS = 1 << 18
SKETCH = 2  # rows of counters
PARTS = 64  # that the sketch is sent in
LEVELS_A_LOG = 8  # sampling weights are rounded to this part of a natural logarithm; verification takes them as they are
LEVELS = 14 * LEVELS_A_LOG
AGREE = 28  # of SAMPLES, at least, for two texts to be compared
BLOCK = 512
VERIFIED = 20_000  # candidates of a task


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, shingle hash, count: the distinct shingles of every text, ordered by both."""
    h = w.hashes()[w.codes] if len(w.distinct) else np.empty(0, np.uint64)
    starts = run_starts(w.bounds, SHINGLE)
    text = np.repeat(np.arange(w.n_texts), np.maximum(w.counts() - SHINGLE + 1, 0))
    value = rolling(h, SHINGLE)[starts] if len(starts) else np.empty(0, np.uint64)
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < SHINGLE))
    if len(short):
        alone = np.array([mix(np.array([sum(int(x) * (2 * j + 3) ** 5 for j, x in enumerate(h[w.bounds[t] : w.bounds[t + 1]])) % (1 << 64)], np.uint64))[0] for t in short], np.uint64)
        text, value = np.concatenate([text, short]), np.concatenate([value, alone])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return text[first], value[first], np.diff(np.append(first, len(text)))


def identities(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of all words of each text."""
    h = Hashes(w)
    a, b = w.bounds[:-1], w.bounds[1:]
    once = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.a))])
    placed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.a) * np.arange(1, len(h.a) + 1, dtype=np.uint64))])
    return h.ranges(a, b), mix(placed[b] - placed[a] - a.astype(np.uint64) * (once[b] - once[a]))  # places count from the text's start


def counters(value: np.ndarray) -> np.ndarray:
    """The counter of each shingle in each row of the sketch: (SKETCH, n)."""
    return np.stack([((value >> np.uint64(64 - 18 * (k + 1))).astype(np.int64) & (COUNTERS - 1)) + k * COUNTERS for k in range(SKETCH)])


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch over all rows, and how many rows have a shingle."""
    size = SKETCH * COUNTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros(size, np.int64), 0
        for batch in sliced(batches):
            text, value, _ = shingles(words(plain(batch.column(0))))
            for own in counters(value):
                total += np.bincount(own, minlength=size)
            n += len(np.unique(text))
        own = [x.astype("<i8").tobytes() for x in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId() % 256] * PARTS, pa.int32()), pa.array(own, pa.binary()), pa.array([n] + [0] * (PARTS - 1), pa.int64())], names=["part", "lane", "counts", "n"])

    schema = "part int, lane int, counts binary, n long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (part, lane); one sum of each."""
        at, total, n = None, None, 0
        out = []
        for batch in batches:
            for part, lane, counts, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, lane) != at:
                    if at is not None:
                        out.append((*at, total.tobytes(), n))
                    at, total, n = (part, lane), np.zeros(size // PARTS, np.int64), 0
                total += np.frombuffer(counts, "<i8")
                n += own
        if at is not None:
            out.append((*at, total.tobytes(), n))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["part", "lane", "counts", "n"])

    sums = long_rows(rows).select("text").mapInArrow(count, schema)
    for keys in (["part", "lane"], ["part"]):
        lane = F.col("lane") if len(keys) == 2 else F.lit(0)
        sums = sums.withColumn("lane", lane).repartition(*[F.col(k) for k in keys]).sortWithinPartitions("part", "lane").mapInArrow(add, schema)
    total, n, own = np.zeros(size, np.int64), 0, size // PARTS
    for r in sums.collect():  # PARTS rows of a fixed size
        total[r["part"] * own : (r["part"] + 1) * own] += np.frombuffer(r["counts"], "<i8")
        n += r["n"]
    return total, n


def idf(total: np.ndarray, n: int) -> np.ndarray:
    """The weight that each counter gives a shingle."""
    rows = total.reshape(SKETCH, COUNTERS)
    df = rows - (rows.sum(1, keepdims=True) - rows) / (COUNTERS - 1)
    return (1 + DAMP * np.log(max(n, 1) / np.clip(df, max(n / RARE, 1), max(n, 1))) / np.log(RARE)).ravel()


def weights(value: np.ndarray, count: np.ndarray, table: np.ndarray) -> np.ndarray:
    return count * table[counters(value)].max(0)


class Sampler:
    """Consistent weighted samples: for each, the element with the least ln a = ln c - r (t - beta) - r, t = floor(ln w / r + beta).

    r, c are Gamma(2, 1) and beta uniform, all by the element's hash: r and beta one of 64 * 64 pairs of quantiles, c one of
    65,536 quantiles. So r (t - beta) + r is a table by weight level. A sample is named by the element and t.
    """

    def __init__(self):
        grid = np.linspace(0, 40, 400_001)
        cdf = 1 - np.exp(-grid) * (1 + grid)
        gamma = lambda k: np.interp((np.arange(k) + 0.5) / k, cdf, grid)
        r, beta = np.repeat(gamma(64), 64), np.tile((np.arange(64) + 0.5) / 64, 64)
        level = np.arange(LEVELS)[:, None] / LEVELS_A_LOG
        t = np.floor(level / r + beta)
        scale = 1 << 22
        self.low = (-(r * (t - beta) + r) * scale).astype(np.int64).ravel()
        self.c = (np.log(gamma(65_536)) * scale).astype(np.int64) + (1 << 30)
        self.t = (mix(t.astype(np.int64).view(np.uint64).ravel()) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rng = np.random.default_rng(20)
        self.odd = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, text: np.ndarray, value: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
        """(n_texts, SAMPLES) names as uint32; texts without shingles have zeros."""
        out = np.zeros((n_texts, SAMPLES), np.uint32)
        level = np.clip(np.rint(np.log(np.maximum(weight, 1)) * LEVELS_A_LOG), 0, LEVELS - 1).astype(np.int64) << 12
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        a = 0
        while a < len(starts):  # whole texts, about 32,768 shingles at once, so that arrays stay in cache
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + 32_768)))
            lo, hi = starts[a], starts[b] if b < len(starts) else len(text)
            x, lv, cut, who = value[lo:hi], level[lo:hi], starts[a:b] - lo, text[starts[a:b]]
            for k in range(SAMPLES):
                z = x * self.odd[k]
                z ^= z >> np.uint64(29)
                z *= np.uint64(0xBF58476D1CE4E5B9)
                s = z.view(np.int64)
                at = ((s >> 52) & 0xFFF) + lv
                key = ((self.c[(s >> 36) & 0xFFFF] + self.low[at]) << 32) | ((s & 0xFFFFFFFF) ^ self.t[at])
                out[who, k] = np.minimum.reduceat(key, cut).astype(np.uint32)
            a = b
        return out


def signatures(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """key, h1, h2, n_words, samples (SAMPLES integers), buckets (a hash for each band) of every text."""
    table = rows.sparkSession.sparkContext.broadcast(table)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in sliced(batches):
            w = words(plain(batch.column(1)))
            text, value, count = shingles(w)
            own = sampler.samples(text, value, weights(value, count, table.value), w.n_texts)
            band = mix(np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], w.n_texts, 0))
            for j in range(ROWS):
                band = mix(band ^ (own[:, j::ROWS].astype(np.uint64) + np.uint64(j)))
            h1, h2 = identities(w)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(w.n_texts + 1, dtype=np.int32) * k), pa.array(x.ravel())) for k, x in ((SAMPLES, own.view(np.int32)), (BANDS, band.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(w.counts()), *lists], names=["key", "h1", "h2", "n_words", "samples", "buckets"])

    return long_rows(rows).select("key", "text").mapInArrow(run, "key long, h1 long, h2 long, n_words long, samples array<int>, buckets array<long>")


def similarity(a: pa.Array, b: pa.Array, table: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of a[i] and b[i]."""
    n = len(a)
    w = words(pa.concat_arrays([a, b]))
    text, value, count = shingles(w)
    weight = weights(value, count, table)
    pair = text % n
    order = np.lexsort((value, pair))
    pair, value, weight = pair[order], value[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]))
    common = np.bincount(pair[both], np.minimum(weight[both], weight[both + 1]), n)
    total = np.bincount(pair, weight, n) - common
    return np.where(total > 0, common / np.maximum(total, 1e-300), 0.0)


def verified(pairs: DataFrame, texts: DataFrame, table: np.ndarray, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs at or above the threshold."""
    table = pairs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text_a", 4 << 20):
            for one in sliced(iter([batch]), "text_b", 4 << 20):
                s = similarity(plain(one.column(2)), plain(one.column(3)), table.value)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array(s)], names=["a", "b", "similarity"]).filter(pa.array(s >= threshold))

    with_a = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    with_b = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _met(members: DataFrame, signed: DataFrame, total: int) -> DataFrame:
    """Members (bucket, band, key, component), at most `total`, with their samples, dealt to blocks of about BLOCK; blocks meet in groups (bucket, x, y).

    Members of a bucket's largest component are linked already and have blocks of their own, behind the others'. Blocks of others meet
    each other and those; those never meet. So a bucket of n members, all but m in one component, sends about n * m / BLOCK rows twice.
    """
    parts = members.groupBy("bucket", "component").count()
    sizes = parts.groupBy("bucket").agg(F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("bucket", "n", F.col("most.component").alias("largest"), blocks(F.col("n") - F.col("most.count")).alias("some"), blocks(F.col("most.count")).alias("rest"))
    dealt = join_hot(members, sizes, "bucket", total).withColumn("linked", F.col("component") == F.col("largest"))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("linked"), F.col("some") + place("rest")).otherwise(place("some")))
    last = F.when(F.col("linked"), F.col("some") - 1).otherwise(F.col("some") + F.col("rest") - 1)
    meet = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    meet = meet.join(signed.select("key", "samples").hint("merge"), "key")
    return meet.select("bucket", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "component", "samples")


def _agreeing(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a group, each with those of other components whose samples agree with its own.

    Every pair comes once, in the first band that it shares, however many buckets it meets in.
    """
    key, component, own = (np.asarray(group.column(c).combine_chunks()) for c in ("key", "component", "own"))
    samples = np.asarray(group.column("samples").combine_chunks().flatten()).reshape(-1, SAMPLES)
    band = group.column("band")[0].as_py()
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    right = np.flatnonzero(own == y)
    for i in np.flatnonzero(own == x):
        j = right[component[right] != component[i]]
        j = j[key[j] > key[i]] if x == y else j
        same = samples[j] == samples[i]
        enough = same.sum(1) >= AGREE
        j, same = j[enough], same[enough]
        j = j[same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band] if len(j) else j
        if len(j):
            yield i, j


def _agree(group: pa.Table) -> pa.Table:
    """The rows of a group that agree with one of another component."""
    has = np.zeros(len(group), bool)
    for i, j in _agreeing(group):
        has[i] = has[j] = True
    return group.filter(pa.array(has))


def packed(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """key, values (ordered shingle hashes), weights of every text."""
    table = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            text, value, count = shingles(words(plain(batch.column(1))))
            weight = weights(value, count, table.value)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            both = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (value, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in both)], names=["key", "values", "weights"])

    return texts.select("key", "text").mapInArrow(run, "key long, values binary, weights binary")


def _verifier(threshold: float):
    def verify(group: pa.Table) -> pa.Table:
        """Links at or above the threshold between rows that agree; a pair that others of the group already link is left out."""
        key, component = (np.asarray(group.column(c).combine_chunks()) for c in ("key", "component"))
        value, weight = ([np.frombuffer(x, t) for x in group.column(c).to_pylist()] for c, t in (("values", np.uint64), ("weights", np.float64)))
        size = np.array([len(v) for v in value])
        start = np.cumsum(size) - size
        distinct, place = np.unique(np.concatenate(value), return_inverse=True)
        weight_of, total = np.concatenate(weight), np.array([w.sum() for w in weight])
        root = {int(c): int(c) for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found, dense = [], np.zeros(len(distinct))
        for i, partners in _agreeing(group):
            own = slice(start[i], start[i] + size[i])
            dense[place[own]] = weight_of[own]
            at = np.repeat(start[partners] - (np.cumsum(size[partners]) - size[partners]), size[partners]) + np.arange(size[partners].sum())
            common = np.add.reduceat(np.minimum(dense[place[at]], weight_of[at]), np.cumsum(size[partners]) - size[partners])
            dense[place[own]] = 0
            for j in partners[common >= threshold * (total[i] + total[partners] - common)]:
                a, b = find(int(component[i])), find(int(component[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(key[i]), int(key[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return verify


def cross_links(members: DataFrame, signed: DataFrame, texts: DataFrame, table: np.ndarray, threshold: float, most: int) -> DataFrame:
    """a, b: links between members of one bucket and different components, enough to join all components that any link joins."""
    kinds = "bucket long, band int, x int, y int, own int, key long, component long, samples array<int>"
    agreed = written(_met(members, signed, most).groupBy("bucket", "x", "y").applyInArrow(_agree, kinds), "agreed", most, VERIFIED)
    own = packed(texts.join(agreed.select("key").distinct(), "key", "left_semi"), table)
    return agreed.join(own, "key").groupBy("bucket", "x", "y").applyInArrow(_verifier(threshold), "a long, b long").distinct()


def near_classes(rows: DataFrame, threshold: float = 0.8, repeated: bool = False) -> DataFrame:
    """key, class_key (least key of the component) for rows (key, text, ...), one row for each key; keys that repeat have one text."""
    table = idf(*document_frequencies(rows))
    signed = written(signatures(rows, table), "signatures").dropDuplicates(["key"]) if repeated else written(signatures(rows, table), "signatures")
    full = signed.filter("n_words > 0").select("key", F.struct("h1", "h2").alias("h"))
    n_docs = signed.count()
    lead = written(full.groupBy("h").agg(F.min("key").alias("lead"), F.count("*").alias("n")), "lead", n_docs)
    member = join_hot(full, lead, "h", n_docs).select("key", "lead")
    leads = signed.join(lead.select(F.col("lead").alias("key")).hint("merge"), "key", "left_semi")
    placed = written(leads.select("key", F.posexplode("buckets").alias("band", "bucket")), "placed", BANDS * n_docs)
    least = placed.groupBy("bucket").agg(F.min("key").alias("b"), F.count("*").alias("n")).filter("n > 1")
    shared = written(join_hot(placed, least, "bucket", BANDS * n_docs), "buckets", BANDS * n_docs)
    n_shared = shared.count()
    candidates = written(rows.select("key", "text").join(shared.select("key").distinct().hint("merge"), "key", "left_semi"), "candidates", n_docs, 5_000)
    candidates = candidates.dropDuplicates(["key"]) if repeated else candidates
    pairs = shared.filter("key != b").select(F.col("key").alias("a"), "b").distinct()
    for k in "ab":
        pairs = pairs.join(signed.select(F.col("key").alias(k), F.col("samples").alias(f"samples_{k}")).hint("merge"), k)
    agree = F.size(F.filter(F.zip_with("samples_a", "samples_b", lambda x, y: x == y), lambda same: same))
    pairs = pairs.filter(agree >= AGREE).select("a", "b")
    links = written(verified(pairs, candidates, table, threshold), "links", n_shared, VERIFIED)
    found = components(links)
    # Buckets that still hold several components.
    labelled = shared.select("bucket", "band", "key").join(found.select(F.col("id").alias("key"), "component"), "key", "left")
    labelled = written(labelled.select("bucket", "band", "key", F.coalesce("component", "key").alias("component")), "labelled", n_shared)
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x < y").select("bucket", "n")
    members = written(join_hot(labelled, mixed, "bucket", BANDS * n_docs), "members", n_shared)
    more = written(cross_links(members, signed, candidates, table, threshold, n_shared), "links", n_shared, VERIFIED)
    if more.limit(1).collect():
        found = components(links.select("a", "b").union(more))
    of_lead = member.join(found.select(F.col("id").alias("lead"), "component"), "lead", "left").select("key", F.coalesce("component", "lead").alias("class_key"))
    return of_lead.union(signed.filter("n_words = 0").select("key", "key"))


def near_dup(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """row (all columns of docs), class_key, kept: whether this is the document of its class that stays (one row of each)."""
    rows, unique = keyed(docs, id_col, text)
    if not unique:
        rows = written(rows, "rows")
    classes = near_classes(rows, threshold, not unique)
    joined = rows.select("key", "row").join(classes.hint("merge"), "key")
    if unique:
        return joined.select("row", "class_key", (F.col("key") == F.col("class_key")).alias("kept"))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))  # rows of one key are alike
    return joined.select("row", "class_key", ((F.col("key") == F.col("class_key")) & (first == 1)).alias("kept"))
