"""WARC archives: records with an index written first, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_folder, pieces_of, read_table, written

ARCHIVE_BYTES = 64 << 20
GAP = 256 << 10
READ_BYTES = 8 << 20
_DATE = "2020-01-01T00:00:00Z"
_INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str, offset: int) -> str:
    """An id from the place of a record, so that rows that repeat a page, or have no page_id, have ids of their own."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{name} {offset}'.encode()).digest())}>"


def _header(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def info_record(name: str) -> bytes:
    """The record that opens an archive; the index leaves it out."""
    block = b"software: citegrid\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, 0)}", f"WARC-Date: {_DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(identity: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries headers alone and names the page and address of the response it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {identity}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_header(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_header(first_url or '')}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page: {first}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> dict:
    """Of one gzip member: the headers, the payload and what is checked against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return {"page_id": int(headers["X-Page"]) if "X-Page" in headers else None, "payload_bytes": n, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": int(headers["X-Refers-To-Page"]) if "X-Refers-To-Page" in headers else None, "payload": payload}


def _writer(folder: str):
    """Each attempt of a task writes archives under names of its own; the index names those of the one that counts."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at, rows = None, "", 0, []
        for batch in pieces_of(batches, 128):
            for page, url, html, first, first_url, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "first_url", "revisit")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    opening = gzipped(info_record(name))
                    out.write(opening)
                    at = len(opening)
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = sha1_base32(payload)
                data = gzipped(record(record_id(name, at), page, url, payload, digest, first, first_url, revisit))
                out.write(data)
                rows.append((name, at, len(data), url, digest, page))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    yield _rows(rows, _INDEX)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield _rows(rows, _INDEX)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) -> archives in folder; returns their index: file, offset, length, url, digest, page_id.

    Of records with equal payloads of at least least_bytes bytes the smallest page_id is the
    response and the others revisit it. Null html is an empty payload; a null url an empty one.
    Rows that repeat both payload and page_id of the response are responses too, each a record
    with an id of its own; a null page_id comes last. A page is one record however long.
    Further columns are ignored; no rows give no archive.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digested = pages.withColumn("sha", F.sha1("html"))
    firsts = digested.select("sha", "page_id", "url").groupBy("sha").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).filter("n > 1")
    repeats = digested.join(firsts, "sha", "left").select("page_id", "url", "html", "first", "first_url", F.coalesce((F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"))
    return written(repeats.mapInArrow(_writer(folder), _INDEX), "index")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(folder: str, payloads: bool):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        held, name = [], None

        def fetch():
            """Reads held ranges of one file, neighbours together."""
            with store.open_input_file(f"{root}/{name}") as f:
                f.seek(held[0][0])
                data = f.read(held[-1][0] + held[-1][1] - held[0][0])
            got = [parse(data[o - held[0][0] : o - held[0][0] + n]) for o, n in held]
            yield _rows([tuple(x.values())[: 6 if payloads else 5] for x in got], _READ + ", payload binary" * payloads)

        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if held and (file != name or offset - sum(held[-1]) > GAP or offset + length - held[0][0] > READ_BYTES):
                    yield from fetch()
                    held = []
                name = file
                held.append((offset, length))
        if held:
            yield from fetch()

    return run


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records that the rows of an index name, their byte ranges sorted and joined to long reads.

    A row that repeats gives its record again; an empty index gives none; a record longer than
    READ_BYTES is one read. A record that does not fit its digest raises.
    """
    # a file and its stretch of READ_BYTES is one unit, so that a large archive is read by several tasks
    unit = F.floor(F.col("offset") / READ_BYTES)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = index.select("file", "offset", "length", unit.alias("unit")).repartition(parts, "file", "unit").sortWithinPartitions("file", "offset")
    return ranges.select("file", "offset", "length").mapInArrow(_reader(folder, payloads), _READ + ", payload binary" * payloads)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{own_folder(spark)}/warc"
    return read_records(write_archives(read_table(spark, sf_dir, "pages"), folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       translate(""" + " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {i}, 5) AS BIGINT), 32), 4, '0')" for i in range(1, 41, 5)) + """,
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""
