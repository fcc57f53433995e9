"""Concatenate and cut: all documents' tokens end to end, cut into windows of one length.

Any tokenizer file will do; texts are split into words and their ids kept only where by_words() finds that no id can change by it.
Pass 1 tokenises each document once and writes its ids with the number of ids before it in its partition. The totals of
the partitions (one row each) give, by a prefix sum, the global offset of every partition. Pass 2 adds the two, so every
document knows its global offset without any shuffle or order, and cuts its ids at multiples of the window: each piece is a
boundary record. Only the last sequence can be shorter than the window.

Defined results: a null or empty text has the end id alone; repeated rows are packed each; an empty table gives no piece; a
text longer than a window is cut into as many pieces as it needs. Only `id_col` and `text` are read, so other columns
may have any name. Which document follows which is not defined, apart from being one gapless order.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.columnar import plain, sliced, spread, words
from brindle.llm.common import long_rows, written

#: Distinct words that are tokenised as one text, split by a special token.
GLUED = 256
#: Words whose ids a worker keeps; about 50 MB.
KNOWN = 250_000


#: How a tokenizer must prepare texts for the short cuts of text_ids to change no id.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: A broadcast row for each input split; beyond so many, they are joined by a shuffle.
SPLITS = 1_000_000


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def by_words(path: str, glue: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space, splits as SPLIT does, and knows `glue` as a special token."""
    whole = json.loads(_tokenizer(path).to_str())
    first, split = whole["normalizer"] or {}, ((whole["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    drops = split.get("invert") is True and split.get("behavior") == "Removed" and split.get("pattern") == {"Regex": SPLIT}
    return [x["type"] for x in first.get("normalizers", [])] == NORMALIZERS and drops and any(x["content"] == glue and x["special"] for x in whole["added_tokens"])


def _encoded(distinct: list[str], path: str, glue: str) -> list[bytes]:
    """The ids of each word as unsigned 32-bit numbers.

    Words are tokenised many at a time with a special token between them, which splits any text exactly there.
    """
    t = _tokenizer(path)
    mark = t.token_to_id(glue)
    out: list[bytes] = []
    for a in range(0, len(distinct), GLUED):
        own = distinct[a : a + GLUED]
        text = glue.join(own)
        if text.count(glue) != len(own) - 1:  # the special token stands within a word
            out += [np.asarray(e.ids, np.uint32).tobytes() for e in t.encode_batch(own, add_special_tokens=False)]
            continue
        ids = np.asarray(t.encode(text, add_special_tokens=False).ids, np.uint32)
        edges = np.concatenate([[-1], np.flatnonzero(ids == mark), [len(ids)]])
        raw = ids.tobytes()
        out += [raw[4 * (x + 1) : 4 * y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return out


_known: dict[tuple[str, str], dict[str, bytes]] = {}


def word_ids(distinct: list[str], path: str, glue: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every word, end to end, and their bounds.

    This tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. A worker
    keeps the ids of the first KNOWN words that it meets; frequent ones are among them.
    """
    known = _known.setdefault((path, glue), {})
    new = [w for w in distinct if w not in known]
    fresh = dict(zip(new, _encoded(new, path, glue), strict=True))
    for w, ids in fresh.items():
        if len(known) >= KNOWN:
            break
        if len(w) <= 64:
            known[w] = ids
    own = [known.get(w) if w in known else fresh[w] for w in distinct]
    counts = np.fromiter(map(len, own), np.int64, len(own)) // 4
    return np.frombuffer(b"".join(own), np.uint32), np.concatenate([[0], np.cumsum(counts)])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = True


def folded(texts: pa.Array) -> pa.Array:
    """The same texts for this tokenizer, with fewer distinct words: A-Z in lower case, a space between a letter and an ASCII mark.

    The tokenizer lower-cases, always ends a piece after a run of letters, and drops white space, so no id changes. Only a
    special token's own text could be torn; a batch with its first two characters is left as it is.
    """
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None or not data.size:
        return texts
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    if b"<|" in raw.tobytes():
        return texts
    raw = _FOLD[raw]
    gap = np.flatnonzero(_LETTER[raw[:-1]] & _MARK[raw[1:]]) + 1
    moved = bounds - bounds[0]
    moved = moved + np.searchsorted(gap, moved, "left")
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(moved), pa.py_buffer(np.insert(raw, gap, 32))])


def text_ids(texts: pa.Array, path: str, glue: str, end_id: int) -> list[bytes]:
    """The ids of each text and the end id, as little-endian unsigned 32-bit numbers. A tokenizer that is not by_words takes texts whole."""
    if not by_words(path, glue):
        return [np.asarray([*e.ids, end_id], "<u4").tobytes() for e in _tokenizer(path).encode_batch(texts.to_pylist(), add_special_tokens=False)]
    w = words(folded(texts))
    flat, bounds = word_ids(w.distinct.to_pylist(), path, glue)
    counts = np.diff(bounds)[w.codes]
    ids = flat[spread(bounds[:-1][w.codes], counts)].astype("<u4")
    before = np.concatenate([[0], np.cumsum(counts)])[w.bounds]
    end = np.uint32(end_id).astype("<u4").tobytes()
    return [ids[a:b].tobytes() + end for a, b in zip(before[:-1], before[1:], strict=True)]


def tokenised(docs: DataFrame, path: str, glue: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """part, before (ids before it in the part), n_ids, ids of every document."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in sliced(batches, most=6 << 20):
            ids = text_ids(plain(batch.column(1)), path, glue, end_id)
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(total + np.cumsum(n) - n), pa.array(ids, pa.binary())], names=schema.names)
            total += int(n.sum())

    return long_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, glue: str = "<|startoftext|>", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ids = written(tokenised(docs, path, glue, end_id, id_col, text), "tokens")
    totals = ids.groupBy("part").agg(F.max(F.col("before") + (F.length("ids") / 4).cast("long")).alias("n"))
    # One row for each partition of pass 1: 16 bytes for each input split, so small beside the input at any size.
    bases, base = [], 0
    for part, n in sorted(tuple(r) for r in totals.collect()):
        bases.append((part, base))
        base += n
    few = len(bases) <= SPLITS
    bases = spark.createDataFrame(bases, "part int, base long")
    id_type = ids.schema["doc_id"].dataType
    kinds = (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(*x) for x in kinds]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "ids", 4 << 20):
            all_ids = batch.column(1).to_pylist()
            n = np.fromiter((len(x) // 4 for x in all_ids), np.int64, len(all_ids))
            first = np.asarray(batch.column(2))
            pieces = (first + n - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = spread(first // window, pieces)
            a = np.maximum(seq * window, first[row])
            b = np.minimum((seq + 1) * window, (first + n)[row])
            start = a - first[row]
            own = [all_ids[r][4 * s : 4 * e] for r, s, e in zip(row, start, start + b - a, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(b - a), pa.array(own, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(a - seq * window)], names=schema.names)

    placed = ids.join(F.broadcast(bases) if few else bases.hint("merge"), "part").select("doc_id", "ids", (F.col("base") + F.col("before")).alias("first"))
    return placed.mapInArrow(cut, schema)


def with_crc(pieces: DataFrame) -> DataFrame:
    """ids_crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
