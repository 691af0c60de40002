import base64
import gzip
import hashlib

import pytest

from vellumflow.llm import queries, warc

PAGES = "page_id bigint, url string, html string"


def page_rows():
    rows = [(i, f"http://x/{i}", f"<p>{i}é" * (i * 40)) for i in range(30)]
    rows += [(100, "http://y\r\nbad: 1", "same"), (101, None, "same"), (102, "u", "same"), (103, "u", None), (104, "u", ""), (None, "u", "same"), (None, "u", "alone"), (105, "u", "WARC/1.1\r\n\r\n" * 50), (106, "u", "big " * 300_000)]
    return rows + [rows[3], rows[3]]


def parts(rows, least=0):
    """Each row with its payload and the response that it refers to, if any."""
    body = [(r[2] or "").encode() for r in rows]
    top: dict = {}
    for r, b in zip(rows, body):
        if len(b) >= least and r[0] is not None:
            top[b] = max(r[0], top.get(b, -1))
    return [(r[0], b, None if top.get(b) in (None, r[0]) else top[b]) for r, b in zip(rows, body)]


def expected(rows, least=0):
    return sorted(((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if t is None else "revisit", t) for i, b, t in parts(rows, least)), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = page_rows()
    path = warc.write(spark.createDataFrame(rows, PAGES), least_bytes=least)
    for split in (700, 1 << 25):
        got = warc.pages_of(warc.read(spark, path, split)).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows, least)
    payloads = sorted(bytes(r.payload) for r in warc.read(spark, path).filter("headers['warc-type'] = 'response'").collect())
    assert payloads == sorted(b for _, b, t in parts(rows, least) if t is None)


def test_ids_of_another_type(spark):
    pages = spark.createDataFrame([("a/1", "u", "same"), ("b 2", "u", "same"), (None, "u", "x")], "page_id string, url string, html string")
    got = warc.pages_of(warc.read(spark, warc.write(pages)), "string").collect()
    assert sorted(((r.id, r.record_type, r.refers_to) for r in got), key=str) == [("a/1", "revisit", "b 2"), ("b 2", "response", None), (None, "response", None)]


def test_members_are_gzip(spark):
    path = warc.write(spark.createDataFrame(page_rows()[:3], PAGES))
    name = warc.ranges(spark, path)[0][0].removeprefix("file:").replace("//", "/", 1)
    assert gzip.open(name).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_false_magic_and_truncation(tmp_path):
    from pyarrow import fs

    good = warc.member([("WARC-Type", "response")], b"x" * 100)
    data = b"junk" + warc.MAGIC + b"noise" + good + warc.MAGIC + gzip.compress(b"not a record") + good[:-12]
    (tmp_path / "a").write_bytes(data)
    source = warc.Bytes(fs.LocalFileSystem().open_input_file(str(tmp_path / "a")))
    assert [o for o, _, _ in warc.records(source, 0, len(data))] == [12]
    assert [o for o, _, _ in warc.records(source, 12, 13)] == [12] and not list(warc.records(source, 13, len(data)))


def test_empty(spark):
    path = warc.write(spark.createDataFrame([], PAGES))
    assert warc.read(spark, path).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    got = queries.op7_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
