"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id, then by the payload's digest and the url. Within a range, each record is compressed on its own, and a
new file begins when the open one would pass roll_bytes. Headers and digests are made anew from the payload, with ids and the date as
functions of the record's content and a parameter, so equal input in equal ranges gives equal bytes. Files are written under temporary
names; after all are there they are renamed, and a manifest written last makes the archive valid.

Of equal payloads of min_revisit_bytes or more, the one of the largest page_id is a response and the others revisit it; rows that share
the largest page_id are all responses. Null html is empty. Rows without a page_id sort first, and are responses only if
no row with one has their payload. Record ids are unique also where rows share page_id, url and html. A url that is no plain URI is
written escaped, and as it was in a header of its own; a null url is about:blank there. A payload of any length is one record, held in memory
once; records of a page with very many rows are dealt by digest and url. Other columns are not read. An empty table gives an archive without
files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, tune
from .raw_files import commit, read_raw, write_raw

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quillrank:page")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MAX_RANGES = 20_000
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str, url, copy: int) -> str:
    """digest: hexadecimal SHA-1 of the payload. copy: 0, 1 ... of records that are equal in all of these."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, json.dumps([page_id, digest, url, copy]))}>"


def target_uri(url) -> str:
    return "about:blank" if url is None else urllib.parse.quote(url, safe=":/?#[]@!$&()*+,;=%~'")


def record(page_id, url, payload: bytes, date: str, copy: int = 0, refers_to=None, refers_url=None) -> bytes:
    """refers_to, refers_url: page_id and url of the response with the same payload, for a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    kind, digest, uri = "revisit" if refers_to is not None else "response", hashlib.sha1(payload).hexdigest(), target_uri(url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest, url, copy)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if uri != url:
        lines.append(f"X-Page-URL: {json.dumps(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, refers_url, 0)}", f"WARC-Refers-To-Target-URI: {target_uri(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp, and an empty one after it where it would not end in a zero byte."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    if out[-1]:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += c.flush()
    return out


def _packer(roll_bytes: int, date: str):
    def run(batches):
        part, roll, used, seq = TaskContext.get().partitionId(), 0, 0, 0
        at, copy, to, to_url = None, 0, None, None
        for b in batches:
            files, seqs, values = [], [], []
            for page_id, digest, url, kind, html, refers_to, refers_url in zip(*(c.to_pylist() for c in b.columns)):
                if not kind:  # what holds for the records that follow, of this page_id, digest and url
                    at, copy, to, to_url = (page_id, digest, url), 0, refers_to, refers_url
                    continue
                if at != (page_id, digest, url):
                    raise ValueError(f"no role for page {page_id}")
                out = member(record(page_id, url, html.encode("utf-8", "surrogatepass"), date, copy, to, to_url))
                copy += 1
                if used and used + len(out) > roll_bytes:
                    roll, used = roll + 1, 0
                used += len(out)
                files.append(f"{part:06d}-{roll:05d}")
                seqs.append(seq)
                values.append(out[:-1])
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(seqs, pa.int64()), pa.array(values, pa.binary())], ["file", "seq", "value"])

    return run


def write_warc(pages: DataFrame, path: str, roll_bytes: int = 8 << 20, range_bytes: int = 64 << 20, min_revisit_bytes: int = 0, date: str = DATE) -> list[str]:
    """Write pages (page_id, url, html) to path; the names of the files. roll_bytes: of a file, compressed; range_bytes: of html in a sorted
    range, about, but never more than MAX_RANGES ranges."""
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = rows.select("page_id", "digest", "url", F.octet_length("html").alias("n")).distinct()
    last = keys.filter("page_id is not null").groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"))
    revisits = (F.col("n") >= min_revisit_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    found = keys.join(last, "digest", "left").withColumn("to", F.when(revisits, F.col("last")))
    roles = found.select("page_id", "digest", "url", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("html"), F.col("to.page_id").alias("refers_to"), F.col("to.url").alias("refers_url"))
    both = roles.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    size = rows.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    order = ["page_id", "digest", "url"]
    dealt = both.repartitionByRange(min(MAX_RANGES, max(1, -(-size // range_bytes))), *order).sortWithinPartitions(*order, "kind")
    tmp = f"{path}/_tmp"
    write_raw(dealt.mapInArrow(_packer(roll_bytes, date), "file string, seq long, value binary"), tmp, ["seq"])
    return commit(spark, tmp, path, ".warc.gz", {"format": "WARC/1.1"})


def records(data) -> list[tuple[dict, bytes]]:
    """(headers, block) of each record of a gzipped archive."""
    at, data = 0, memoryview(data)
    while at < len(data):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(data):
            parts.append(d.decompress(data[at : at + (1 << 20)]))
            at += (1 << 20)
        at = min(at, len(data)) - len(d.unused_data)
        if not d.eof:
            raise ValueError("a gzip member is cut off")
        raw = b"".join(parts)
        if not raw:
            continue
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
        block = rest[: int(headers["content-length"])]
        if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"record {headers['warc-record-id']} is damaged")
        yield headers, block


def _reader(with_payload: bool):
    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for h, block in records(content.as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.lower().partition(b"content-length: ")[2].split(b"\r\n")[0])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and (n != len(payload) or base32_sha1(payload) != digest):
                        raise ValueError(f"payload of {h['warc-record-id']} is damaged")
                    to = h.get("x-refers-to-page-id")
                    page = h.get("x-page-id")
                    rows.append((page and int(page), n, digest, h["warc-type"], to and int(to), json.loads(h["x-page-url"]) if "x-page-url" in h else h["warc-target-uri"], file, payload if with_payload and to is None else None))
                    if len(rows) == 200:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files in path's manifest; digests are verified. A revisit has no payload of its own."""
    return read_raw(spark, path).mapInArrow(_reader(with_payload), PAGE)


def round_trip(pages: DataFrame) -> DataFrame:
    path = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path).drop("payload", "url", "file")
