"""Words of a whole Arrow batch as integer codes, so that Python never loops over single words.

A word is a longest run without ASCII white space (``[^\\x20\\x09-\\x0D]+``). A batch of texts becomes one array of codes
into the batch's distinct words, and the bounds of each text in it; all later work is NumPy over those arrays.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are worked on at once; a longer single text makes a batch of its own.
BATCH_BYTES = 8 << 20
#: What a row counts for besides its text, so that many empty texts make several batches.
ROW_BYTES = 16


@dataclass
class Words:
    codes: np.ndarray  # int32, one for each word of all texts
    bounds: np.ndarray  # int64, text k has codes[bounds[k]:bounds[k + 1]]
    distinct: pa.Array  # the words that codes point to

    @property
    def n_texts(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(self.n_texts), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each distinct word."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.distinct))


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One large_string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def words(texts: pa.Array) -> Words:
    """The words of each text; texts as plain() gives them."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.values, np.asarray(lists.offsets)
    full = np.asarray(pc.binary_length(flat)) > 0  # white space at either end leaves empty strings
    before = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=before[1:])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(np.asarray(coded.indices), before[offsets], coded.dictionary)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text: what one step holds in memory is bounded by that or one row.

    Small batches are joined, since many words at once have fewer distinct ones among them.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), np.int64) + ROW_BYTES
        start = 0
        for k in np.flatnonzero(np.diff((size + np.cumsum(sizes)) // most, prepend=size // most)).tolist():
            held.append(batch.slice(start, k + 1 - start))
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, start = [], k + 1
        if start < len(sizes):
            held.append(batch.slice(start))
        size = (size + int(sizes.sum())) % most
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]
        held = []
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, next to others on the same executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def keep_memory() -> None:
    """Has this process keep arrays of up to some MB when they are freed, for tasks that make the same ones over and over: fresh pages cost more than the work on them."""
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        for option, size in ((-3, 8 << 20), (-1, 64 << 20)):  # its thresholds for pages of their own, and for giving back the heap's end
            ctypes.CDLL(None).mallopt(option, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit values (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of n consecutive values; run i starts at value i. Runs across texts are included."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    state, out, last = seed, np.zeros(len(values) - n + 1, np.uint64), len(values) - n + 1
    for j in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out += values[j : j + last] * np.uint64(state | 1)
    return mix(out)


def run_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of n words starts that stays within its text."""
    counts = np.diff(bounds)
    room = np.maximum(counts - n + 1, 0)
    return np.repeat(bounds[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k] .. starts[k] + counts[k] - 1 for all k in turn."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())
