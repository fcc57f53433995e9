"""Matrix-Market files: coordinate and array formats; real, integer, complex and pattern values; all symmetries."""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from brindle.core import Matrix
from brindle.errors import FileNotFound, IoError
from brindle.functions import scalar as S
from brindle.plans.lineage import numbered

#: Lines at the start of a file among which header and sizes are looked for.
HEAD = 10_000
#: Places of an array that a task writes one after another, places of a piece of text, bytes of text parsed at once, and of a packed part that a task may hold.
RANGE, PIECE, PARSED, PART = 1 << 22, 1 << 16, 1 << 24, 64 << 20


@dataclass(frozen=True)
class Header:
    """What the banner and the size line say; `line` is the place of the size line."""

    format: str
    field: str
    symmetry: str
    nrows: int
    ncols: int
    entries: int
    line: Row


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, value): lines of a text file, or of a folder of parts in the order of their names; `line` (file, start, id) follows their order."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFound(path) from e
        raise
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return lines.select(at.alias("line"), F.trim("value").alias("value"))


def first_lines(spark: SparkSession, path: str, n: int) -> list:
    """The first lines; only the first block of the first file is read."""
    read_text(spark, path)
    files = sorted(spark.read.text(path).inputFiles())
    return read_text(spark, files[0]).filter("line.start = 0").limit(n).collect() if files else []


def after(line) -> Column:
    """Whether a line stands behind `line`."""
    return F.col("line") > F.struct(F.lit(line["file"]).alias("file"), F.lit(line["start"]).cast("long").alias("start"), F.lit(line["id"]).cast("long").alias("id"))


def behind(spark: SparkSession, path: str, line) -> DataFrame:
    """Lines behind `line` of first_lines(). Ids count within one scan, where Spark orders files by size: so the first file is scanned by itself, as first_lines() does."""
    first, *others = sorted(spark.read.text(path).inputFiles())
    lines = read_text(spark, first).filter(after(line))
    return lines.unionByName(read_text(spark, others)) if others else lines


def header(spark: SparkSession, path: str) -> Header:
    head = first_lines(spark, path, HEAD)
    if not head or not head[0]["value"].lower().startswith("%%matrixmarket matrix"):
        raise IoError(f"{path} has no Matrix-Market banner")
    words = head[0]["value"].lower().split()
    if len(words) != 5 or words[2] not in ("coordinate", "array") or words[3] not in ("real", "integer", "complex", "pattern", "double") or words[4] not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise IoError(f"{path}: banner {head[0]['value']!r}")
    sizes = next((r for r in head[1:] if r["value"] and not r["value"].startswith("%")), None)
    if sizes is None:
        raise IoError(f"{path} has no size line")
    n = [int(x) for x in sizes["value"].split()]
    return Header(words[2], words[3], words[4], n[0], n[1], n[2] if words[2] == "coordinate" else n[0] * n[1], sizes["line"])


def mirrored(cells: DataFrame, symmetry: str, kind: str) -> DataFrame:
    """Stored cells and, off the diagonal, their mirror images."""
    if symmetry == "general":
        return cells
    v = F.col("v")
    if symmetry == "skew-symmetric":
        image = S.c_scale(v, F.lit(-1.0)) if kind == "complex" else -v
    elif symmetry == "hermitian" and kind == "complex":
        image = S.conj(v)
    else:
        image = v
    return cells.unionByName(cells.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), image.alias("v")))


def _numbers(lines: Iterator[bytes]) -> Iterator[pa.Array]:
    """The lines of a text that hold values, some million bytes at once; neither comments nor blank ones."""
    rest = b""
    for data in lines:
        data = rest + data
        at = data.rfind(b"\n") + 1
        rest, data = data[at:], data[:at]
        if data:
            yield _values(data)
    if rest:
        yield _values(rest)


def _values(data: bytes) -> pa.Array:
    if not data.strip():
        return pa.array([], pa.string())
    options = csv.ParseOptions(delimiter="\x01", quote_char=False), csv.ReadOptions(column_names=["v"], block_size=len(data) + 1, use_threads=False)
    t = csv.read_csv(io.BytesIO(data), parse_options=options[0], read_options=options[1], convert_options=csv.ConvertOptions(column_types={"v": pa.string()}, strings_can_be_null=False, check_utf8=False))
    v = pc.utf8_trim_whitespace(t.column("v").combine_chunks())
    return v.filter(pc.and_(pc.not_equal(v, ""), pc.invert(pc.starts_with(v, "%"))))


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The text of a gzip file of any number of members, piece by piece."""
    while data:
        one = zlib.decompressobj(31)
        while not one.eof:
            out = one.decompress(data, PARSED)
            data = one.unconsumed_tail if not one.eof else one.unused_data
            if out:
                yield out
            elif not one.eof:
                raise IoError("a packed part ends too early")


def _packed_parts(spark: SparkSession, path: str) -> list[str] | None:
    """The parts of a file in their order, if all are packed and small enough for a task; such parts are never split."""
    parts = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    return sorted(r["path"] for r in parts) if parts and all(r["path"].endswith(".gz") and r["length"] <= PART for r in parts) else None


def _packed_array(spark: SparkSession, path: str, parts: list[str], zeros: bool) -> DataFrame:
    """(k, v): the values of an array of real numbers in packed parts. Parts are counted, then numbered each from where it begins: no line is sorted or sent."""
    data = spark.read.format("binaryFile").load(path).select("path", "content")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[pa.Array]]]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield path, _numbers(_unpacked(content.as_py()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, values in texts(batches):
            yield pa.record_batch({"path": [path], "n": pa.array([sum(len(v) for v in values)], pa.int64())})

    sizes = {r["path"]: r["n"] for r in data.mapInArrow(count, "path string, n long").collect()}
    starts, at = {}, -1  # the size line stands before the values
    for part in parts:
        starts[part], at = at, at + sizes[part]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, values in texts(batches):
            k = starts[path]
            for v in values:
                if k < 0 and len(v):
                    v, k = v[1:], 0
                try:
                    x = pc.cast(v, pa.float64())
                except pa.ArrowInvalid:  # more than a number in some line
                    x = pc.cast(pc.list_element(pc.utf8_split_whitespace(v), 0), pa.float64())
                x = x.to_numpy(zero_copy_only=False)
                at = np.arange(len(x)) if zeros else np.flatnonzero(x)
                for a in range(0, len(at), PIECE):
                    own = at[a : a + PIECE]
                    yield pa.record_batch({"k": own + k, "v": x[own]})
                k += len(x)

    return data.mapInArrow(places, "k long, v double")


def read_matrix_market(spark: SparkSession, path: str, pattern_value: float = 0.0, keep: Callable[[Column, Column], Column] | None = None, zeros: bool = True) -> Matrix:
    """A matrix from a file. Pattern entries get pattern_value. keep(i, j) decides which stored entries are taken. zeros: whether those of an array are."""
    h = header(spark, path)
    kind = "complex" if h.field == "complex" else "real"
    body = behind(spark, path, h.line).filter((F.col("value") != "") & ~F.col("value").startswith("%"))
    part = F.split("value", r"\s+")
    number = lambda k: part[k].cast("double")
    if h.format == "coordinate":
        v = S.complex_(number(2), number(3)) if kind == "complex" else F.lit(float(pattern_value)) if h.field == "pattern" else number(2)
        cells = body.select((part[0].cast("long") - 1).alias("i"), (part[1].cast("long") - 1).alias("j"), v.alias("v"))
    elif kind == "real" and (parts := _packed_parts(spark, path)):
        cells = _array_places(_packed_array(spark, path, parts, zeros), h)
    else:
        v = S.complex_(number(0), number(1)) if kind == "complex" else number(0)
        values = numbered(body.select("line", v.alias("v")), F.col("line")).select("k", "v")
        cells = _array_places(values, h)
        if not zeros and kind == "real":
            cells = cells.filter("v <> 0")
    if keep is not None:
        cells = cells.filter(keep(F.col("i"), F.col("j")))
    return Matrix(mirrored(cells, h.symmetry, kind), h.nrows, h.ncols, kind)


def _array_places(values: DataFrame, h: Header) -> DataFrame:
    """Places of values given column by column; symmetric files give the lower triangle, skew ones without the diagonal."""
    k, n = F.col("k"), h.nrows
    if h.symmetry == "general":
        return values.select((k % n).alias("i"), F.floor(k / n).cast("long").alias("j"), "v")
    skip = 1 if h.symmetry == "skew-symmetric" else 0
    starts = [(c, c * n - c * (c - 1) // 2 - c * skip) for c in range(h.ncols)]  # where each column begins
    col = values.sparkSession.createDataFrame([(c, s, s + n - c - skip) for c, s in starts], "j long, lo long, hi long")
    at = values.join(F.broadcast(col), (k >= F.col("lo")) & (k < F.col("hi")))
    return at.select((k - F.col("lo") + F.col("j") + skip).alias("i"), "j", "v")


def write_matrix_market(A: Matrix, path: str, dense: bool = False) -> None:
    """As a general file: coordinates by rows, or an array column by column. A folder of text parts, which are the file one after another; those of an array are packed (gzip).

    Parts are ranges of places, the header at the head of the first, so no task sees a whole matrix.
    """
    field = "complex" if A.kind == "complex" else "real"
    v = F.concat_ws(" ", S.real("v").cast("string"), S.imag("v").cast("string")) if A.kind == "complex" else F.col("v").cast("string")
    if dense:
        head = [f"%%MatrixMarket matrix array {field} general", f"{A.nrows} {A.ncols}"]
        _array_text(A, v, head).write.mode("overwrite").option("compression", "gzip").text(path)
        return
    lines = A.df.select((F.col("i") * A.ncols + F.col("j")).alias("k"), F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), v).alias("value"))
    head = [f"%%MatrixMarket matrix coordinate {field} general", f"{A.nrows} {A.ncols} {A.df.count()}"]
    first = A.spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "k long, value string")
    first.union(lines).orderBy("k").select("value").write.mode("overwrite").text(path)


def _array_text(A: Matrix, text: Column, head: list[str]) -> DataFrame:
    """(value): all lines of an array, pieces of many lines each. Only places with an entry are shuffled, to the task of their range; tasks are ranges in rising order."""
    n, total, zero = A.nrows, A.nrows * A.ncols, "0 0" if A.kind == "complex" else "0.0"
    ranges = max(1, -(-total // RANGE))
    tasks = min(ranges, 4096)
    k = F.col("j") * n + F.col("i")
    cells = A.df.select("i", "j", F.coalesce(text, F.lit(zero)).alias("t")).filter(f"i >= 0 AND i < {n} AND j >= 0 AND j < {A.ncols}")
    cells = cells.select(F.floor(k / RANGE).cast("long").alias("s"), k.cast("long").alias("k"), "t")
    every = A.spark.range(ranges).select(F.col("id").alias("s"), F.lit(-1).cast("long").alias("k"), F.lit(None).cast("string").alias("t"))  # a range without an entry is written too
    dealt = cells.unionByName(every).repartitionById(tasks, F.floor(F.col("s") * tasks / ranges).cast("int")).sortWithinPartitions("s", "k")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size, at, end = [], 0, None, 0

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal piece, size
            if size > least:
                yield pa.record_batch({"value": ["\n".join(piece)]})
                piece, size = [], 0

        def zeros(until: int) -> Iterator[pa.RecordBatch]:
            nonlocal at, size
            while at < until:
                m = min(until - at, PIECE)
                piece.append((zero + "\n") * (m - 1) + zero)
                at, size = at + m, size + m
                yield from full(PIECE)

        for b in batches:
            for s, k, t in zip(*(b.column(c).to_pylist() for c in "skt"), strict=True):
                if k < 0:  # begins a range
                    if at is not None:
                        yield from zeros(end)
                    at, end = s * RANGE, min((s + 1) * RANGE, total)
                    if s == 0:
                        piece, size = list(head), len(head)
                    continue
                yield from zeros(k)
                piece.append(t)
                at, size = at + 1, size + 1
                yield from full(PIECE)
        if at is not None:
            yield from zeros(end)
        yield from full(0)

    return dealt.mapInArrow(lines, "value string")


class MatrixFile:
    """A file that is read or written by assignment."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, **options) -> Matrix:
        return read_matrix_market(self.spark, self.path, **options)

    def write(self, A: Matrix, dense: bool = False) -> None:
        write_matrix_market(A, self.path, dense)
