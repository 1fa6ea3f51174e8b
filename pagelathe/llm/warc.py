"""WARC archives written and read as a chunked record table.

Payloads travel as rows (record, chunk_no) both ways, so that neither side holds more than one chunk of a record
at a time beside the row it comes from. The writer feeds the chunks of a record, in order, to one gzip member, as the
standard asks, and checks their running SHA-256 against the digest in the record's head. A reader's row has one
chunk, the payload's bytes so far and the SHA-256 of them, so that the last row has the digest of the whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import files
from pagelathe.llm.common import as_long, shared_folder, table, written

CHUNK = 1 << 16
#: Payloads below so many bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: An archive is closed beyond so many bytes and another begun.
ARCHIVE_BYTES = 1 << 30

CHUNK_SCHEMA = (
    "archive string, record_no long, record_id string, record_type string, page_id long, target_uri string,"
    " refers_to long, chunk_no long, is_last boolean, chunk binary, bytes_so_far long, sha256_so_far string,"
    " stated_bytes long, stated_sha256 string"
)
_KINDS = [
    ("archive", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
    ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("is_last", pa.bool_()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha256_so_far", pa.string()),
    ("stated_bytes", pa.int64()), ("stated_sha256", pa.string()),
]


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to, refers_url) of each row of (page_id, url, html, ...).

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest page_id are responses and
    the others revisit that id; where all page_ids of a payload are null, all are responses. A null html is
    empty, a null url has no target. Only digests that occur twice are joined back, from a table of their own, so
    that adaptive execution sends it to all or splits the rows of a page that stands very often.
    """
    rows = pages.select(
        as_long("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    repeated = (
        rows.where(F.octet_length("html") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(written(repeated, "warc-repeated"), F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "html", "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
        F.when(revisits, F.col("first_url")).alias("refers_url"),
    )


def payload_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each of plan_records: its head's columns, payload_bytes, chunk_no, n_chunks and chunk.

    The rows of a record follow each other in one partition. A revisit, like an empty payload, has one, without bytes.
    """
    payload = F.encode("html", "UTF-8")
    whole = F.octet_length("html")
    sent = F.when(F.col("record_type") == "response", F.greatest(F.lit(1), F.ceil(whole / chunk).cast("int"))).otherwise(1)
    heads = ["page_id", "url", "digest", "record_type", "refers_to", "refers_url"]
    cut = records.select(*heads, whole.cast("long").alias("payload_bytes"), payload.alias("_payload"), sent.alias("n_chunks"))
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    part = F.when(F.col("record_type") == "response", F.substring("_payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return each.select(*heads, "payload_bytes", "chunk_no", "n_chunks", part.alias("chunk"))


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


class _Archive:
    """An archive under way: records are begun, fed chunk by chunk, and ended."""

    def __init__(self, path: str) -> None:
        self.path, self.out, self.size, self.records = path, files.create(path), 0, 0

    def record_id(self, number: int) -> str:
        """Of an archive, whose name no other has, and a number in it: no two records are named alike."""
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}#{number}')}>"

    def begin(self, page_id: int | None, url: str | None, digest: str, kind: str, refers_to: int | None, refers_url: str | None, payload_bytes: int) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
        body = payload_bytes if kind == "response" else 0
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {self.record_id(self.records)}", "WARC-Date: 1970-01-01T00:00:00Z"]
        head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
        head += [] if url is None else [f"WARC-Target-URI: {_line(url)}"]
        if kind == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"X-Refers-To-Page-Id: {refers_to}"]
            head += [] if refers_url is None else [f"WARC-Refers-To-Target-URI: {_line(refers_url)}"]
        head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}"]
        self.pack, self.left, self.so_far, self.stated = zlib.compressobj(1, zlib.DEFLATED, 31), body, hashlib.sha256(), digest if body else None
        self._put("\r\n".join(head).encode() + b"\r\n\r\n" + http)

    def _put(self, piece: bytes) -> None:
        if data := self.pack.compress(piece):
            self.size += self.out.write(data)

    def feed(self, chunk: bytes) -> None:
        self.so_far.update(chunk)
        self.left -= len(chunk)
        self._put(chunk)

    def end(self) -> None:
        if self.left or (self.stated and self.so_far.hexdigest() != self.stated):
            raise ValueError(f"{self.path}: the chunks of record {self.records} are not its payload")
        self._put(b"\r\n\r\n")
        self.size += self.out.write(self.pack.flush())
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"archive": [self.path], "records": pa.array([self.records], pa.int64())})


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """A record for each row of pages; returns the manifest (archive, records). Each task writes archives of its own."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Archive | None = None
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(10)), strict=True):
                *head, size, chunk_no, n_chunks, chunk = (x.as_py() for x in row)
                if not chunk_no:
                    if out is not None and out.size >= ARCHIVE_BYTES:
                        yield out.close()
                        out = None
                    out = out or _Archive(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    out.begin(*head, size)
                out.feed(chunk)
                if chunk_no == n_chunks - 1:
                    out.end()
        if out is not None:
            yield out.close()

    return written(payload_chunks(plan_records(pages)).mapInArrow(write, "archive string, records long"), "warc-manifest")


class _Inflated:
    """The bytes of concatenated gzip members, without holding a member."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.raw, self.held, self.ended = source, b"", bytearray(), False
        self.unpack = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            raw = self.unpack.unconsumed_tail or self.raw or self.source.read(CHUNK)
            self.raw = b""
            if not raw:
                return False
            if data := self.unpack.decompress(raw, CHUNK):
                self.held += data
                return True

    def line(self) -> bytes:
        while (k := self.held.find(b"\n")) < 0:
            if not self._more():
                k = len(self.held) - 1
                break
        out = bytes(self.held[: k + 1])
        del self.held[: k + 1]
        return out

    def take(self, most: int) -> bytes:
        if not self.held:
            self._more()
        out = bytes(self.held[:most])
        del self.held[: len(out)]
        return out


def _header(source: _Inflated) -> tuple[dict[str, str], int]:
    fields, size = {}, 0
    while line := source.line():
        size += len(line)
        if not line.strip():
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, size


def read_chunks(source: BinaryIO, archive: str = "", chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA. A record without payload has one row, with an empty chunk.

    A response whose bytes are not those that its head states, by number or digest, is an error.
    """
    stream, record_no = _Inflated(source), 0
    while line := stream.line():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"{archive}: no record begins at {line[:40]!r}")
            continue
        fields, _ = _header(stream)
        left = int(fields.get("content-length", 0))
        if "application/http" in fields.get("content-type", ""):
            left -= _header(stream)[1]
        number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
        digest = fields.get("warc-payload-digest")
        lead = (archive, record_no, fields.get("warc-record-id"), fields.get("warc-type"), number("x-page-id"), fields.get("warc-target-uri"), number("x-refers-to-page-id"))
        stated = (number("x-payload-length"), digest and digest.rpartition(":")[2])
        so_far, chunk_no, seen = hashlib.sha256(), 0, 0
        while True:
            parts, need = [], min(chunk, left)
            while need and (data := stream.take(need)):
                parts.append(data)
                need -= len(data)
            if need:
                raise ValueError(f"{archive}: record {record_no} ends early")
            data = b"".join(parts)
            so_far.update(data)
            seen, left = seen + len(data), left - len(data)
            digest_now = so_far.copy().hexdigest()
            if not left and lead[3] == "response" and (stated[0] not in (None, seen) or stated[1] not in (None, digest_now)):
                raise ValueError(f"{archive}: record {record_no} is not the payload that its head states")
            yield *lead, chunk_no, not left, data, seen, digest_now, *stated
            chunk_no += 1
            if not left:
                break
        record_no += 1


def chunk_table(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The chunked record table of the archives of a manifest; without payload, chunks are read and digested but null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_stream(path) as source:
                    out: list[tuple] = []
                    held = 0
                    for row in read_chunks(source, path):
                        out.append(row if with_payload else (*row[:9], None, *row[10:]))
                        held += 500 + len(row[9]) * with_payload
                        if held >= 4_000_000:
                            yield _rows(out)
                            out, held = [], 0
                    if out:
                        yield _rows(out)

    count = max(1, manifest.count())
    return manifest.select("archive").repartition(count).mapInArrow(read, CHUNK_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _KINDS, strict=True)], [n for n, _ in _KINDS])


def read_records(manifest: DataFrame) -> DataFrame:
    """One row a record, from its last chunk's row. A revisit has no payload: its size and digest are those stated;
    it was written because a response has the same digest. A response's are those of the bytes read, which the
    reader has compared with those stated."""
    ends = chunk_table(manifest, with_payload=False).where("is_last")
    whole = F.col("record_type") == "response"
    return ends.select(
        "page_id",
        F.when(whole, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("sha256_so_far")).otherwise(F.col("stated_sha256")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(table(spark, sf_dir, "pages")))


OP3_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
