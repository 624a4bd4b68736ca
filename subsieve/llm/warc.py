"""Web archives as .warc.zst files: a dictionary in a leading skippable frame, and a Zstandard frame for each record.

The dictionary is built from a bounded sample of the records. Every task writes its own files to a folder that all
executors share, under names that no other attempt has, and returns them as rows; only files that the rows of finished
tasks name are read, so an attempt that was lost leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest, materialize, scratch, small_batches, table

DICTIONARY_BYTES = 64 << 10
SAMPLE, SAMPLE_BYTES = 1000, 8 << 10  # records that the dictionary is built from, at most, and characters of each
ROLL = 32 << 20  # compressed bytes from which a task begins another file
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # of records whose table has no date
_MAGIC = 0x184D2A5D  # of the skippable frame with the dictionary
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_URL = "urn:subsieve:no-url"
_OUT_ROWS = 2000


def roles(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: null for a response, the response's page_id for a revisit.

    Of the rows with equal payloads (null html: empty) the one with the largest page_id is the response. Rows with that
    page_id that are repeated are responses each; a null page_id is never the largest; if all are null, all are responses.
    """
    d = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    again = d.groupBy("sha").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    d = d.join(materialize(again, "again"), "sha", "left")  # written, so that the join can split the pages of a hot payload
    return d.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:subsieve:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id, url, html: str, refers_to) -> bytes:
    """One record with its HTTP header; a revisit has the header alone."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or _NO_URL
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(rows: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from records of the `sample` (page_id, url) whose hash is lowest; empty if they are too few to build one.

    The ids are chosen alone; then of each the record with the least text, its first SAMPLE_BYTES, comes to the driver:
    8 MB at most, whatever the table's size.
    """
    ids = lowest(rows.select("page_id", "url"), sample).toDF("i", "u")
    text = F.substring("html", 1, SAMPLE_BYTES)
    some = rows.join(F.broadcast(ids), F.col("page_id").eqNullSafe(F.col("i")) & F.col("url").eqNullSafe(F.col("u")))  # `sample` rows
    some = some.groupBy("page_id", "url").agg(F.min(text).alias("html")).orderBy("page_id", "url")
    try:
        return zstandard.train_dictionary(size, [record(*r, None) for r in some.collect()]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(rows: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write each row (page_id, url, html, refers_to) as a record; returns (path, records, bytes), a row for each file."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        name, out, records, written = "", None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [written]}, schema=schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, records, written = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}")
                    if dictionary:
                        written += out.write(struct.pack("<II", _MAGIC, len(dictionary)) + dictionary)
                written += out.write(pack.compress(record(*row)))
                records += 1
                if written >= ROLL:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    files = rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return materialize(files, "archives")


def records_of(f):
    """(headers, block) of each record of an open .warc.zst file."""
    head, known = f.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == _MAGIC:
        known = zstandard.ZstdCompressionDict(f.read(struct.unpack("<II", head)[1]))
        head = b""
    source = _After(head, f)
    stream = zstandard.ZstdDecompressor(dict_data=known).stream_reader(source, read_across_frames=True)
    data = b""
    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = stream.read(1 << 16)
            if not more:
                if data:
                    raise ValueError("a cut record")
                return
            data += more
        headers = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
        size, data = int(headers["Content-Length"]), data[end + 4 :]
        parts, have = [data], len(data)
        while have < size + 4:
            more = stream.read(1 << 16)
            if not more:
                raise ValueError("a cut record")
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        yield headers, data[:size]
        data = data[size + 4 :]


class _After:
    """A file whose first bytes were already read."""

    def __init__(self, first: bytes, f):
        self.first, self.f = first, f

    def read(self, n: int) -> bytes:
        out, self.first = self.first, b""
        return out or self.f.read(n)


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of each record."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(path):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{base}/{path}") as f:
            for headers, block in records_of(f):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, url = headers["WARC-Type"], headers["WARC-Target-URI"]
                size, digest = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (size, digest) != (len(payload), _digest(payload)):
                    raise ValueError(f"a damaged record in {path}")
                yield _page_id(headers["WARC-Record-ID"]), None if url == _NO_URL else url, payload if kind == "response" else None, size, digest, kind, _page_id(headers["WARC-Refers-To"]) if kind == "revisit" else None

    def run(batches):
        held, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row[2] or b"")
                    if len(held) >= _OUT_ROWS or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    n = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(max(n, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) to archives in `folder` (a new one in the shared folder) and read them back.

    Null url: none; null page_id: kept as null. Repeated rows: a record each. Empty table: no files, no rows.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    small_batches(pages.sparkSession)
    rows = roles(pages)
    plain = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return read_archives(write_archives(rows, folder, build_dictionary(plain)), folder)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS largest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(sha, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM m
"""
