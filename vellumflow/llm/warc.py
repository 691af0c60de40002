"""Operator 7, WARC: a writer, and a splittable reader of gzip members.

The reader deals out byte ranges of the archives. A task scans its range for gzip's magic bytes, takes a
candidate for a member only if it decodes to a WARC header and a block of the length named there, and owns
the records that start inside its range, though they may end beyond. After a record it goes on where the
member ended, so bytes inside members are looked at only at the beginning of a range.

Files are written and read by Arrow's file systems, in the folder that executors share. A task writes to
a name of its own attempt and renames it when complete, so a repeated task replaces its file whole."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

#: Bytes of an archive that a task scans.
SPLIT = 32 << 20
#: Bytes that are read, and fed to the decoder, at once.
READ, FEED = 1 << 20, 1 << 16
MAGIC = b"\x1f\x8b\x08"
URN = "urn:vellumflow:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def roles(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload: str = "html") -> DataFrame:
    """(id, sha1, top): of equal payloads of ``least_bytes`` or more, top is the largest id; else null."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = written(pages.select(F.col(id_col).alias("id"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("n")).distinct(), "digests")
    top = rows.filter(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("top"))
    return rows.join(top, "sha1", "left").select("id", "sha1", "top")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + c.flush()


def record(page, url, html, sha1, top) -> bytes:
    """One page as a response, or as a revisit of page ``top`` with the HTTP headers alone."""
    body = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    revisit = top is not None and top != page
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{'' if page is None else quote(str(page), safe='')}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)))
    headers += [("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(sha1))), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{quote(str(top), safe='')}>")]
    return member(headers, http if revisit else http + body)


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload: str = "html") -> str:
    """Write one record for each row to archives in ``path`` (a new folder in the shared one, if None); the path.

    A null payload counts as empty. Rows that repeat the largest id of equal payloads are responses all;
    a null id is the smallest. An empty table writes no archive."""
    path = path or new_path(pages.sparkSession, "warc")
    role = roles(pages, least_bytes, id_col, payload).withColumnRenamed("id", "role_id")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"))
    rows = rows.join(role.withColumnRenamed("sha1", "role_sha1"), F.col("id").eqNullSafe(F.col("role_id")) & (F.col("sha1") == F.col("role_sha1"))).select("id", "url", "html", "sha1", "top")

    def run(batches):
        store, folder = fs.FileSystem.from_uri(path)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n, out = posixpath.join(folder, f".{name}-{uuid.uuid4().hex}"), 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                    out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                out.write(record(*row))
                n += 1
        if out is not None:
            out.close()
            store.move(draft, posixpath.join(folder, name))
        yield pa.record_batch([pa.array([n], pa.int64())], ["records"])

    rows.mapInArrow(run, "records bigint").agg(F.sum("records")).first()
    return path


class Bytes:
    """Reads of an open file, by blocks that are kept while they are near."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(max(n, min(READ, self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place from ``at`` and before ``end`` where ``what`` begins, or -1."""
        while at < end:
            part = self.read(at, min(READ, end - at + len(what) - 1))
            if (k := part.find(what)) >= 0:
                return at + k
            at += max(1, len(part) - len(what) + 1)
        return -1


def decode(source: Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record whose member starts at ``at``; None if there is none."""
    d, out, pos = zlib.decompressobj(31), bytearray(), at
    while not d.eof:
        part = source.read(pos, FEED)
        if not part:
            return None
        try:
            out += d.decompress(part)
        except zlib.error:
            return None
        pos += len(part)
        if len(out) >= 7 and not out.startswith(b"WARC/1."):
            return None
    head, mark, rest = bytes(out).partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return None
    headers = {}
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    n = headers.get("content-length", "")
    if not n.isdigit() or len(rest) != int(n) + 4:
        return None
    return headers, rest[: int(n)], pos - len(d.unused_data)


def records(source: Bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    while (start := source.find(MAGIC, start, end)) >= 0:
        if (found := decode(source, start)) is None:
            start += 1
        else:
            headers, block, after = found
            yield start, headers, block
            start = after


def ranges(spark: SparkSession, path: str, split: int = SPLIT) -> list[tuple[str, int, int]]:
    """Byte ranges of the archives in a folder, or of one archive."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        return []
    found = [(s.getPath().toString(), s.getLen()) for s in store.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"]
    return [(name, k, min(k + split, n)) for name, n in sorted(found) for k in range(0, n, split)]


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, offset, headers, http, payload): every record, warcinfo and others too.

    headers are those of the record, names in lower case; http and payload are the two parts of an
    application/http block, of other blocks payload is all. No archives give an empty table."""
    parts = ranges(spark, path, split)

    def run(batches):
        for b in batches:
            for name, start, end in zip(*(c.to_pylist() for c in b.columns)):
                uri = name if "://" in name or not name.startswith("file:") else "file://" + name[5:]
                store, at = fs.FileSystem.from_uri(uri)
                with store.open_input_file(at) as file:
                    rows = []
                    for offset, headers, block in records(Bytes(file), start, end):
                        is_http = headers.get("content-type", "").startswith("application/http")
                        http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
                        rows.append((name, offset, list(headers.items()), http.decode(errors="replace"), payload))
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                    yield batch(rows)

    kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "offset", "headers", "http", "payload"])

    dealt = spark.createDataFrame(parts, "file string, start bigint, end bigint").repartition(max(1, len(parts)))
    return dealt.mapInArrow(run, "file string, offset bigint, headers map<string,string>, http string, payload binary")


def sha1_base32(payloads) -> list[str]:
    return [base32(hashlib.sha1(x).digest()) for x in payloads]


def pages_of(found: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of the page records that ``read`` found.

    Ids come back as ``id_type``: what does not fit it, and an empty one, is null. A response whose payload does not have the digest that its header names raises an error."""
    h = F.col("headers")
    named = F.regexp_extract(h["warc-payload-digest"], r"^sha1:(.*)$", 1)
    revisit = h["warc-type"] == "revisit"
    length = F.regexp_extract("http", r"(?im)^content-length:\s*(\d+)", 1)

    @F.pandas_udf("string")
    def digest(payloads):
        import pandas as pd

        return pd.Series(sha1_base32(payloads))

    checked = F.when(revisit | (digest("payload") == named), named).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in "), "file", F.lit(" at "), F.col("offset").cast("string"))))
    page = lambda c: F.nullif(F.url_decode(F.regexp_extract(c, rf"^<{URN}(.*)>$", 1)), F.lit("")).try_cast(id_type)
    return found.filter(h["warc-type"].isin("response", "revisit")).select(
        page(h["warc-record-id"]).alias("id"),
        F.when(revisit, length.try_cast("bigint")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        checked.alias("payload_digest"),
        h["warc-type"].alias("record_type"),
        page(h["warc-refers-to"]).alias("refers_to"),
    )
