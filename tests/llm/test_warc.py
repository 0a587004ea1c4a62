"""Archives written and read back, by Spark and by hand."""

import gzip
import hashlib
import json
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import warc as W
from cladeframe.session import scratch_path

LONG = "<p>straße ☃ </p>" * 100
PAGES = [
    (1, "http://a.example/", LONG), (2, "http://b.example/x\r\nX-Evil: 1", LONG), (3, None, LONG), (4, "http://c.example/ ", "short"),
    (5, "http://d.example/", "short"), (6, "http://e.example/", None), (7, "", ""), (None, "http://f.example/", LONG), (3, "http://g.example/", LONG),
    (8, "http://h.example/", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" * 40), (9, "http://i.example/ü", "y" * 3_000_000),
    (10, None, "z" * 1000), (11, None, "z" * 1000), (12, None, "z" * 999), (13, None, "z" * 999), (None, None, "n" * 2000), (None, None, "n" * 2000),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "mine", 7) for p in PAGES], "page_id bigint, url string, html string, type string, salt int")


def brute(rows):
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == raw and j is not None]
        again = len(raw) >= 1000 and same and i != max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


def written(spark, rows, **options):
    path = scratch_path(spark, "warc-test")
    W.write(rows, path, **options)
    return path


def test_pages_come_back(spark, pages):
    path = written(spark, W.page_records(pages).repartition(3), fileBytes="1000")
    got = W.read_pages(spark, path)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == brute(PAGES)
    texts = {(r.page_id, r.uri): bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()}
    assert texts[8, "http://h.example/"] == PAGES[9][2] and texts[9, "http://i.example/ü"] == PAGES[10][2]
    assert {r.uri for r in got.collect()} >= {"http://b.example/x%0D%0AX-Evil: 1", "http://c.example/%20", None}
    # appended records are read, too
    W.write(W.page_records(pages.where("page_id = 4")), path)
    assert W.read_pages(spark, path).where("page_id = 4").count() == 2


def test_joined_by_shuffle(spark, pages):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = pages.where("page_id = 1").drop("page_id").crossJoin(spark.range(500).select(F.col("id").alias("page_id")))
        rows = [(r.page_id, r.url, r.html) for r in many.collect()]
        got = W.page_records(many).select("page_id", "payload_bytes", "payload_digest", "type", "page_refers_to")
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark, pages):
    path = written(spark, W.page_records(pages.limit(0)))
    assert W.read_pages(spark, path).count() == 0


def test_files_without_manifest_do_not_count(spark, pages):
    path = written(spark, W.page_records(pages))
    with open(path.removeprefix("file:") + "/part-left-over.warc.gz", "wb") as f:
        f.write(b"\x1f\x8b half a member of a lost task")
    assert W.read_pages(spark, path).count() == len(PAGES)


def test_predicates_in_the_source(spark, pages):
    path = written(spark, W.page_records(pages))
    schema = "type string, page_id bigint, uri string, payload_digest string, payload_bytes bigint"
    cases = {
        "type = 'revisit'": [("type", "=", "revisit")], "page_id > 5 AND type != 'revisit'": [("page_id", ">", 5), ("type", "!=", "revisit")],
        "uri LIKE 'http://a%'": [("uri", "starts", "http://a")], "uri IS NULL": [("uri", "null", True)], "page_id IS NOT NULL": [("page_id", "null", False)],
        "page_id IN (1, 2, 99)": [("page_id", "in", [1, 2, 99])], "payload_bytes <= 1000": [("payload_bytes", "<=", 1000)],
        "uri LIKE '%example/' AND page_id < 5": [("uri", "ends", "example/"), ("page_id", "<", 5)], "uri LIKE '%.ex%'": [("uri", "contains", ".ex")],
    }
    whole = W.read(spark, path, schema).persist()
    for sql, where in cases.items():
        assert sorted(map(str, W.read(spark, path, schema, where).collect())) == sorted(map(str, whole.where(sql).collect())), sql
    whole.unpersist()
    # filters on one DataFrame don't see each other
    one = W.read(spark, path, schema)
    assert one.where("type = 'revisit'").unionAll(one.where("type != 'revisit'")).count() == one.count() == len(PAGES)
    with pytest.raises(Exception, match="no predicate"):
        W.read(spark, path, schema, [("payload", "=", "x")]).count()


def test_unwanted_payloads_are_not_inflated(spark, tmp_path, monkeypatch):
    system = W.fs.LocalFileSystem()
    rows = [{"type": "response" if i % 10 else "revisit", "record_id": f"<{i}>", "payload": bytes([65 + i % 26]) * 3_000_000, "payload_bytes": 5} for i in range(20)]
    path = str(tmp_path / "x.warc.gz")
    with open(path, "wb") as f:
        f.writelines(W.member(W.record(r)) for r in rows)
    seen = []
    more = W._Member.more

    def counted(self, *a):
        before = len(self.data)
        ok = more(self, *a)
        seen.append(len(self.data) - before)
        return ok

    monkeypatch.setattr(W._Member, "more", counted)
    found = list(W.records(system, path, ["type", "record_id", "payload"], lambda r: r["record_id"] == "<7>"))
    assert [len(r["payload"]) for r in found] == [3_000_000]
    whole, seen[:] = sum(seen), []
    assert len(list(W.records(system, path, ["type", "record_id"], lambda r: True))) == 20
    assert len(seen) == 20  # one step a record, its first piece
    assert whole < 3_100_000 + sum(seen)


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(spark, packed):
    """Plain or gzip records without lengths, other record types, folded lines, odd digests, more line ends between records."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\nX-Note: a\r\n  b\r\n\r\nhello\r\n\r\n"
    body = b"HTTP/1.0 200 OK\r\ncontent-length: 99\r\n\r\n" + b"bin\x00\xff\r\n\r\nary"
    response = (
        b"WARC/1.0\r\nwarc-type: response\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: md5:abc\r\nContent-Length: %d\r\n\r\n"
        % len(body)
    ) + body + b"\r\n\r\n"
    empty = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\nPage-ID: many\r\n\r\n\r\n\r\n"
    path = scratch_path(spark, "warc-other")
    folder = path.removeprefix("file:")
    import os

    os.makedirs(folder)
    pieces = [info, response, empty]
    data = b"".join(map(gzip.compress, pieces)) if packed else info + b"\r\n" + response + empty
    with open(f"{folder}/other.warc{'.gz' if packed else ''}", "wb") as f:
        f.write(data)
    rows = {r.type: r for r in W.read(spark, path, "type string, x_note string, payload_digest string, page_id bigint, payload_bytes bigint, payload binary").collect()}
    assert bytes(rows["response"].payload) == b"bin\x00\xff\r\n\r\nary" and rows["response"].payload_bytes == 12
    assert rows["response"].payload_digest == "md5:abc" and rows["warcinfo"].x_note == "a b"
    assert bytes(rows["warcinfo"].payload) == b"hello" and rows["metadata"].payload_bytes == 0 and rows["metadata"].page_id is None


def test_broken_files_are_named(tmp_path):
    system = W.fs.LocalFileSystem()
    whole = W.member(W.record({"type": "response", "payload": b"x" * 100}))
    for name, data in {"cut": whole[:-30], "no": gzip.compress(b"not a record\r\n\r\n")}.items():
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(whole + data)
        with pytest.raises(ValueError, match=f"{name}.warc.gz, byte {len(whole)}"):
            list(W.records(system, str(path), ["payload"], lambda r: True))


def test_files_are_dealt_by_size_and_type(spark, pages):
    path = written(spark, W.page_records(pages).coalesce(1), fileBytes="300")
    reader = W.WarcReader({"path": path, "splitBytes": "2000"}, W.T.StructType.fromDDL("type string"))
    files = reader.files()
    assert len(files) > 3 and sum(sum(t.values()) for _, _, t in files) == len(PAGES)
    assert sorted(p for s in reader.partitions() for p in s.files) == sorted(p for p, _, _ in files)
    assert 1 < len(reader.partitions()) < len(files)
    reader.predicates = [("type", "=", "revisit")]
    kept = {p for s in reader.partitions() for p in s.files}
    assert kept == {p for p, _, t in files if "revisit" in t} and len(kept) < len(files)


def test_members_are_plain_gzip():
    data = W.record({"type": "response", "payload": b"abc", "record_id": "<urn:x>", "payload_digest": hashlib.sha1(b"abc").hexdigest()})
    packed = W.member(data)
    assert gzip.decompress(packed) == data and zlib.decompress(packed, 31) == data
    assert W.sha1_hex(W.sha1_field(hashlib.sha1(b"abc").hexdigest())) == hashlib.sha1(b"abc").hexdigest()
    assert json.dumps(W.head_of(data)[0]) and uuid.uuid4()
