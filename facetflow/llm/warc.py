"""Operator 7: WARC archives with revisit records.

write_pages() writes a response record a page. resolve() reads the headers of
archives, shuffles them by payload digest, joins each record to the one that
stays the response, and writes new archives with fresh headers: revisit records
there refer to that response and hold no payload. read_records() gives the
records of archives with their digests computed anew.

Payloads never meet by digest. Headers do: digests are aggregated before they
are shuffled, and the headers of a popular payload are dealt over salts. What
comes of it is, for each archive, the list of its revisits by place; archives,
as they are, compressed, are joined with these lists and written anew, each by
one task.

Archives are ordinary gzip-compressed WARC/1.1 files, written by Spark's own
writer to the shared folder: a record is a row, and the two line ends behind
each record are the row separator. A file holds at most `records_a_file`
records, since a task that reads holds one compressed file, which must stay
below 2 GB.

Null html is an empty payload. Of equal payloads of at least `min_payload`
bytes, the record with the largest page_id is the response and the others
revisit it; smaller payloads are all responses. Rows that repeat both page_id
and payload are all responses where that page_id is the largest. A null page_id
is less than any other. An empty table gives an empty result; other columns are
ignored, but for url.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, hold, picked, release, salted_join, shared_dir, slices, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS_A_FILE = 2000
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    """The same page and payload always have the same record id, so tasks that run again write the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{sha}')}>"


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c >= " ")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers: tuple | None = None) -> str:
    """Header and block, without the two line ends that close a record. refers: page and url of the response that a revisit refers to."""
    kind = [f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers:
        kind += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers[0], sha)}", f"WARC-Refers-To-Target-URI: {_clean(refers[1])}", f"X-Refers-To-Page-ID: {refers[0]}"]
    block = HEAD + (b"" if refers else payload)
    kind += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n" + "\r\n".join(kind) + "\r\n\r\n" + block.decode()


def parse(archive: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC stream."""
    buffer, start = b"", 0

    def more() -> bool:
        nonlocal buffer, start
        chunk = next(archive, None)
        buffer, start = buffer[start:] + (chunk or b""), 0
        return chunk is not None

    while True:
        while (at := buffer.find(b"\r\n\r\n", start)) < 0:
            if not more():
                return
        fields = dict([line.split(": ", 1) for line in buffer[start:at].decode().split("\r\n")[1:]])
        head, size = at + 4 - start, int(fields["Content-Length"])
        while len(buffer) < start + head + size + 4:
            if not more():
                raise ValueError("archive ends within a record")
        yield fields, buffer[start + head : start + head + size]
        start += head + size + 4


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    unzip = zlib.decompressobj(31)
    for k in range(0, len(data), step):
        chunk = unzip.decompress(data[k : k + step])
        while unzip.eof and unzip.unused_data:
            rest, unzip = unzip.unused_data, zlib.decompressobj(31)
            chunk += unzip.decompress(rest)
        yield chunk


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def _records(data: bytes, check: bool = True) -> Iterator[tuple[int | None, str, bytes, int, str, str, int | None]]:
    """page_id, url, payload, its size and digest, type, refers_to of each record; of responses, size and digest are those of the payload that was read, checked against the header, unless that was done before."""
    for fields, block in parse(inflate(data)):
        kind, page, sha = fields["WARC-Type"], fields["X-Page-ID"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        payload, size = block.split(b"\r\n\r\n", 1)[1], int(fields["X-Payload-Length"])
        if check and kind == "response" and (digest(payload) != sha or len(payload) != size):
            raise ValueError(f"digest of page {page} does not match its payload")
        yield _number(page), fields["WARC-Target-URI"], payload, size, sha, kind, _number(fields.get("X-Refers-To-Page-ID"))


def _in_batches(rows: Iterable[tuple], names: list[str], kinds: list, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > 8 << 20 or len(held) >= 10_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives."""
    kinds, names = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()], [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = ((p, u, x if payloads and k == "response" else None, n, d, k, r) for p, u, x, n, d, k, r in _records(content.as_py()))
                yield from _in_batches(rows, names, kinds, lambda r: len(r[2] or b""))

    return _archives(spark, path).select("content").mapInArrow(run, RECORD)


def _write(records: DataFrame, path: str, records_a_file: int) -> None:
    """Texts of records -> gzip-compressed WARC files in path; at the speed of level 1, which takes a third of the time of the usual one."""
    records.write.option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def write_pages(pages: DataFrame, path: str, records_a_file: int = RECORDS_A_FILE) -> None:
    """pages(page_id, url, html) -> archives of responses."""
    rows = picked(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            yield pa.record_batch([pa.array([record(p, u, x, digest(x)) for p, u, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.string())], names=["value"])

    _write(rows.mapInArrow(run, "value string"), path, records_a_file)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """path and place of each record, with what its header says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = ((file, k, p, u, n, d) for k, (p, u, _, n, d, _, _) in enumerate(_records(content.as_py())))
                yield from _in_batches(rows, ["path", "place", "page_id", "url", "payload_bytes", "payload_digest"], [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()], lambda r: 100)

    return _archives(spark, path).mapInArrow(run, "path string, place int, page_id long, url string, payload_bytes long, payload_digest string")


def resolve(spark: SparkSession, source: str, target: str, min_payload: int = 0, records_a_file: int = RECORDS_A_FILE) -> None:
    """Archives in source -> deduplicated archives in target."""
    headers = hold(_headers(spark, source))
    able = headers.where(F.col("payload_bytes") >= min_payload)
    # Copies of one payload are aggregated before the shuffle; only digests that occur more than once go on.
    originals = able.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("original"), F.count("*").alias("c")).where("c > 1")
    joined = salted_join(able.select("payload_digest", "path", "place", "page_id"), originals, ["payload_digest"], headers.count())
    revisits = joined.where("not page_id <=> original.page_id").groupBy("path").agg(F.collect_list(F.struct("place", F.col("original.page_id").alias("page_id"), F.col("original.url").alias("url"))).alias("revisits"))
    lists = hold(revisits)  # at most records_a_file in each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, found in zip(batch.column("content"), batch.column("revisits").to_pylist(), strict=True):
                refers = {r["place"]: (r["page_id"], r["url"]) for r in found or []}
                rows = ((record(p, u, x, d, refers.get(k)),) for k, (p, u, x, _, d, _, _) in enumerate(_records(content.as_py(), check=False)))
                yield from _in_batches(rows, ["value"], [pa.string()], lambda r: len(r[0]))

    _write(_archives(spark, source).join(lists, "path", "left").select("content", "revisits").mapInArrow(run, "value string"), target, records_a_file)
    release(headers, lists)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), f"{folder}/raw")
    resolve(spark, f"{folder}/raw", f"{folder}/resolved")
    delete(spark, f"{folder}/raw")
    return read_records(spark, f"{folder}/resolved", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 by four digits for each five of the hexadecimal form.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest FROM d),
m AS (SELECT h, max(page_id) AS original FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM b JOIN m ON b.h = m.h"""
