"""WARC archives: a writer, a normaliser of monolithic gzip, and a reader by offset.

A monolithic archive is one gzip stream over all records, so nothing in it can be read without inflating all before it.
The normaliser inflates each such file once, as a stream, writes every record as a gzip member of its own, and a sidecar
index (``.cdx``: offset, length, type, record id, target) beside it. The reader then seeks to single members.

Files live in a folder that driver and executors share, under any address that Arrow's file systems open. Tasks write to a
name of their attempt and move the file when it is whole, so a task that runs again, elsewhere, gives the same file.

Defined results: a null payload is empty; a null target is left out; null ids are written as an empty id and read as null;
rows with the same id and payload are written each and are of one type; an empty table gives no archive and no row. Payloads
of any length are written whole; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import join_hot, new_path

#: Fixed values of the format.
VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID = "urn:page:"
READ = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str):
    return fs.FileSystem.from_uri(path)


class Whole:
    """A file that gets its name only once it is whole."""

    def __init__(self, path: str):
        from pyspark import TaskContext

        self.fs, self.path = _open(path)
        context = TaskContext.get()
        self.own = f"{self.path}.{context.taskAttemptId() if context else 0}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.file, self.at = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.path)


def record(kind: str, page_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record, not compressed. A revisit has the response's HTTP header and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{ID}{page_id}>", "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if kind == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the block of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of inflated bytes; holds one record and one chunk at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None and (end := held.find(b"\r\n\r\n")) >= 0:
                need = end + 4 + int(re.search(rb"\r\nContent-Length: *(\d+)", bytes(held[:end]))[1]) + 4
            if need is None or len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"the archive ends within a record, with {len(held)} bytes left")


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, in bounded parts."""
    z = zlib.decompressobj(31)
    while data := file.read(READ):
        while data:
            yield z.decompress(data, 4 * READ)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


def _gzip(level: int):
    return zlib.compressobj(level, zlib.DEFLATED, 31)


def records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, refers_to: which rows revisit another page, the smallest id with an equal payload.

    Only ids and digests are grouped and joined by payload, those of payloads that many pages share where they lie (join_hot); payloads
    move once, by id and digest, so a payload that many pages share makes no large group of texts.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1(F.encode("html", "utf-8")))
    slim = rows.filter(F.octet_length("html") >= least).groupBy("page_id", "key").count().drop("count")
    first = slim.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = join_hot(slim, first, "key", pages.count()).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    again = again.select(F.col("page_id").alias("again_id"), F.col("key").alias("again_key"), "refers_to")
    hint = rows.hint("merge")
    return hint.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("key") == F.col("again_key")), "left").select("page_id", "url", "html", "refers_to")


def write_monolithic(rows: DataFrame, folder: str, roll: int = 1 << 30, date: str = "2025-01-01T00:00:00Z", level: int = 4) -> list[tuple]:
    """Writes the rows of records(); gives (archive, n_records) of each. A file of more than `roll` inflated bytes is followed by another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, z, n, size, number = TaskContext.get().partitionId(), None, None, 0, 0, 0

        def end():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["archive", "n_records"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, z, n, size = f"{folder}/part-{part:06d}-{number:04d}.mono.warc.gz", _gzip(level), 0, 0
                    out = Whole(path)
                data = record("response" if refers_to is None else "revisit", page_id or "", url, html.encode(), refers_to, date)
                out.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= roll:
                    yield end()
                    out, number = None, number + 1
        if out is not None:
            yield end()

    ordered = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")}).sortWithinPartitions("page_id", "url")
    return [tuple(r) for r in ordered.mapInArrow(run, "archive string, n_records long").collect()]


def _dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A task for each row."""
    return spark.createDataFrame(rows, schema).coalesce(1).repartition(max(1, len(rows)))


SPANS = "archive string, cdx_offset long, cdx_length long, n_records long"


def normalise(spark: SparkSession, archives: list[str], level: int = 6, span: int = 16 << 20) -> list[tuple]:
    """Rewrites each monolithic archive with a member for each record and a sidecar index, beside it and without `.mono`.

    Gives spans: (archive, offset and length in the sidecar, records), one for each `span` bytes of members. That is a row
    for many megabytes of data, so the driver can hold them all; the index itself stays in the sidecars.
    """

    def one(path: str) -> Iterator[tuple]:
        goal = path.replace(".mono.warc.gz", ".warc.gz")
        source, at = _open(path)
        out, sidecar, first, since, n = Whole(goal), Whole(goal.removesuffix(".warc.gz") + ".cdx"), 0, 0, 0
        with source.open_input_stream(at, compression=None) as file:
            for data in split_records(inflated(file)):
                fields, _ = parse(data[: data.index(b"\r\n\r\n") + 4])
                z = _gzip(level)
                member = z.compress(data) + z.flush()
                row = (out.at, len(member), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Target-URI") or "")
                sidecar.write("\t".join(map(str, row)).encode() + b"\n")
                out.write(member)
                n += 1
                if out.at - since >= span:
                    yield goal, first, sidecar.at - first, n
                    first, since, n = sidecar.at, out.at, 0
        if n:
            yield goal, first, sidecar.at - first, n
        out.close()
        sidecar.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = list(one(path))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k in range(4)], names=names)

    names = [x.split()[0] for x in SPANS.split(", ")]
    return [tuple(r) for r in _dealt(spark, [(x,) for x in sorted(archives)], "archive string").mapInArrow(run, SPANS).collect()]


def read(spark: SparkSession, spans: list[tuple]) -> DataFrame:
    """page_id (text), type, url, payload (null for a revisit), payload_bytes, payload_digest, refers_to (text), from single members.

    A response whose payload doesn't have the digest that its header states is an error.
    """
    schema = "page_id string, type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    names = [x.split()[0] for x in schema.split(", ")]
    bare = lambda x: x[len(ID) + 1 : -1] or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, cdx_offset, cdx_length, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                source, at = _open(archive)
                sidecar = source.open_input_file(at.removesuffix(".warc.gz") + ".cdx").read_at(cdx_length, cdx_offset)
                file, rows, held = source.open_input_file(at), [], 0
                for line in sidecar.split(b"\n")[:-1]:
                    offset, length = map(int, line.split(b"\t", 2)[:2])
                    fields, block = parse(zlib.decompress(file.read_at(length, offset), 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if response and digest(payload) != stated:
                        raise ValueError(f"{archive} at {offset}: the payload doesn't have its digest")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    rows.append((bare(fields["WARC-Record-ID"]), fields["WARC-Type"], fields.get("WARC-Target-URI"), payload if response else None, size, stated, None if response else bare(fields["WARC-Refers-To"])))
                    held += len(payload)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
                        rows, held = [], 0
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    return _dealt(spark, spans, SPANS).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages, normalises the archives and reads them back by their index."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    archives = write_monolithic(records(pages, least, id_col, url, html), folder)
    back = read(spark, normalise(spark, [x for x, _ in archives]))
    kind = pages.schema[id_col].dataType
    return back.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
