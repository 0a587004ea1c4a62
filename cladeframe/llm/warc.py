"""WARC archives as a Spark data source, read and written by record.

Writing: every record is a gzip member of its own whose header says how long it is (extra field ``sl``). Tasks write files
of bounded size straight to their place; only a manifest, written once all tasks are done, makes them part of the archive. A task that
is run twice leaves files that no manifest names, and readers pass over them.

Reading: the files are dealt to partitions by size. Predicates on the record type and on other header fields are worked out in the
source: files whose manifest has no record of a wanted type are not opened, and of each record only the header is inflated before the
predicates are looked at. The rest of a record that isn't wanted, or whose payload isn't among the asked columns, is passed over by
the member's length without being read or decoded. Files without lengths or manifest (other writers') are read as well, plain ``.warc`` and
``.warc.gz``; there the rest of a record has to be inflated, but isn't kept.

Columns are header fields: ``type, record_id, date, uri, payload_digest, refers_to, profile, content_type`` are the standard ones, any other
column is the field of that name (``page_id``: ``Page-ID``). ``payload`` and ``payload_bytes`` are the body of the HTTP message, or the
whole block where the record has none. A ``revisit`` keeps the HTTP header only, whose length is that of the full payload.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_BYTES = 64 << 20  # a file is closed once it is this long, so it is one reading task
BATCH_BYTES = 8 << 20  # rows of this size go to Spark together
READ_BYTES = 1 << 20
HEAD_BYTES = 1 << 20  # a record's header is shorter
LEVEL = 6
MANIFEST = "_manifest-"

FIELDS = {
    "type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "profile": "WARC-Profile", "content_type": "Content-Type",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"


def field_name(column: str) -> str:
    return FIELDS.get(column, column.replace("_", "-"))


def field_value(value: str) -> str:
    """A value that stays on its line: control characters and blanks at the ends are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", value)


def sha1_field(hexadecimal: str) -> str:
    """The standard's form of a SHA-1 digest."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def sha1_hex(value: str) -> str:
    """Bare lower-case hex of a digest field; other kinds of digest stay as they are."""
    kind, _, digits = value.partition(":")
    if kind.lower() != "sha1" or len(digits) != 32:
        return value
    return base64.b32decode(digits.upper()).hex()


# --- records -----------------------------------------------------------------------


def record(columns: dict) -> bytes:
    """One record. Columns that are NULL are left out."""
    kind, payload = columns["type"], columns.get("payload") or b""
    head = {field_name(c): str(v) for c, v in columns.items() if v is not None and c not in ("payload", "payload_bytes", "payload_digest")}
    if columns.get("payload_digest"):
        head["WARC-Payload-Digest"] = sha1_field(columns["payload_digest"])
    block = payload
    if kind in ("response", "revisit"):
        size = columns.get("payload_bytes") if kind == "revisit" else len(payload)
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        block = http if kind == "revisit" else http + payload
        head["Content-Type"] = HTTP
    if kind == "revisit":
        head.setdefault("WARC-Profile", REVISIT)
    lines = ["WARC/1.1", *(f"{k}: {field_value(v)}" for k, v in head.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that says its own length, unless that takes more than 32 bits."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def head_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (names in lower case) and where the block starts; None where the header goes on."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()  # a folded line
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            fields.setdefault(last, value.strip())
    return fields, end + 4


def http_head(fields: dict[str, str], block: bytes, whole: bool) -> tuple[int, int | None] | None:
    """Length of the HTTP header at the start of a block and the body's length it names; None where ``block`` ends too early."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return 0, None
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return (len(block), None) if whole else None
    named = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[:end])
    return end + 4, int(named[1]) if named else None


class _File:
    """A file read in larger pieces at given places."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def get(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``at``."""
        if at < self.at or at + size > self.at + len(self.held):
            self.held = self.file.read_at(min(max(size, READ_BYTES), max(0, self.size - at)), at)
            self.at = at
        return self.held[at - self.at : at - self.at + size]


class _Member:
    """What a record starts at, inflated only as far as it is asked for."""

    def __init__(self, file: _File, at: int):
        self.file, self.start, self.at = file, at, at
        self.data = b""
        self.done = False
        self.packed = file.get(at, 2) == b"\x1f\x8b"
        self.length = None
        if self.packed:
            self.inflater = zlib.decompressobj(31)
            first = file.get(at, 12)
            if len(first) == 12 and first[3] & 4:
                extra = file.get(at + 12, struct.unpack("<H", first[10:])[0])
                while len(extra) >= 4:
                    size = struct.unpack("<H", extra[2:4])[0]
                    if extra[:2] == b"sl" and size >= 4:
                        self.length = struct.unpack("<I", extra[4:8])[0]
                    extra = extra[4 + size :]

    def more(self, size: int = 1 << 14) -> bool:
        """Read on; False at the end."""
        raw = b"" if self.done else self.file.get(self.at, size)
        if not raw:
            self.done = True
            return False
        self.at += len(raw)
        if not self.packed:
            self.data += raw
            return True
        self.data += self.inflater.decompress(raw)
        if self.inflater.eof:
            self.at -= len(self.inflater.unused_data)
            self.done = True
        return True

    def upto(self, size: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < size:
            self.data = b""
            if not self.more(min(max(1 << 14, size - have), READ_BYTES)):
                break
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        return self.data

    def next(self, size: int) -> int:
        """Where the next record starts, given the length of this one without the two line ends that close it."""
        if not self.packed:
            return self.start + size + 4
        if self.length:
            return self.start + self.length
        while not self.done:
            self.data = b""
            if not self.more(READ_BYTES):
                raise ValueError("a record ends early")
        return self.at


def records(system: fs.FileSystem, path: str, columns: list[str], wanted) -> Iterator[dict]:
    """Records of a file as dictionaries of ``columns`` that pass ``wanted``, which sees all but the payload."""
    file = _File(system, path)
    at = 0
    while at < file.size:
        start = at
        try:
            m = _Member(file, at)
            while (found := head_of(m.data)) is None:
                if len(m.data) > HEAD_BYTES or not m.more():
                    raise ValueError("no end of a header")
            fields, begin = found
            size = int(fields["content-length"])
            end = begin + size
            row = {c: fields.get(field_name(c).lower()) for c in columns if c not in ("payload", "payload_bytes")}
            if row.get("payload_digest"):
                row["payload_digest"] = sha1_hex(row["payload_digest"])
            http = (0, None)
            if "payload" in columns or "payload_bytes" in columns:
                while (http := http_head(fields, m.data[begin:end], len(m.data) >= end)) is None:
                    if not m.more():
                        raise ValueError("a record ends early")
                row["payload_bytes"] = http[1] if fields.get("warc-type") == "revisit" and http[1] is not None else size - http[0]
            if wanted(row):
                if "payload" in columns:
                    data = m.upto(end)
                    if len(data) < end:
                        raise ValueError("a record ends early")
                    row["payload"] = data[begin + http[0] : end]
                yield row
            at = m.next(end)
            # between plain records there may be more line ends
            while not m.packed and file.get(at, 1) in (b"\r", b"\n"):
                at += 1
        except (ValueError, KeyError, zlib.error) as e:
            raise ValueError(f"{path}, byte {start}: {e}") from e


# --- predicates --------------------------------------------------------------------


def typed(value: str | None, kind: T.DataType):
    """A header value as a column's type; what doesn't fit is NULL."""
    if value is None or isinstance(kind, T.StringType):
        return value
    try:
        return int(value)
    except ValueError:
        return None


#: What a predicate may ask of a header field that is there.
TESTS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b), "ends": lambda a, b: a.endswith(b),
    "contains": lambda a, b: b in a,
}


def holds(predicate: tuple, row: dict) -> bool:
    """Whether a row meets ``(column, test, value)``; only ``null`` (value true or false) is met by a missing field, as in SQL."""
    column, test, value = predicate
    if test == "null":
        return (row[column] is None) == value
    return row[column] is not None and TESTS[test](row[column], value)


# --- data source -------------------------------------------------------------------


class _Split(D.InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path = options["path"]
        self.schema = schema
        self.split_bytes = int(options.get("splitBytes", FILE_BYTES))
        self.predicates = [tuple(p) for p in json.loads(options.get("where", "[]"))]
        known = {f.name for f in schema.fields} - {"payload"}
        for column, test, _ in self.predicates:
            if column not in known or test not in (*TESTS, "null"):
                raise ValueError(f"no predicate {test} on {column}; columns: {sorted(known)}")

    def files(self) -> list[tuple[str, int, dict | None]]:
        """Files of the archive: path, bytes and records by type, where a manifest has them."""
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [(root, info.size, None)]
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        manifests = [i.path for i in found if i.base_name.startswith(MANIFEST)]
        if manifests:
            out = []
            for m in manifests:
                with system.open_input_stream(m) as f:
                    out += [json.loads(line) for line in f.read().splitlines()]
            return [(f"{root.rstrip('/')}/{x['file']}", x["bytes"], x["types"]) for x in out]
        return [(i.path, i.size, None) for i in found if re.search(r"\.warc(\.gz)?$", i.base_name)]

    def partitions(self) -> list[_Split]:
        by_type = [p for p in self.predicates if p[0] == "type"]
        splits: list[_Split] = []
        room = 0
        for path, size, types in sorted(self.files(), key=lambda x: (-x[1], x[0])):
            if types is not None and not any(all(holds(p, {"type": t}) for p in by_type) for t in types):
                continue
            if size > room or not splits:
                splits.append(_Split([]))
                room = self.split_bytes
            splits[-1].files.append(path)
            room -= size
        return splits or [_Split([])]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.schema)
        columns = [f.name for f in self.schema.fields]
        kinds = {f.name: f.dataType for f in self.schema.fields if f.name not in ("payload", "payload_bytes")}

        def wanted(row: dict) -> bool:
            for c, kind in kinds.items():
                row[c] = typed(row[c], kind)
            return all(holds(p, row) for p in self.predicates)

        rows, size = [], 0
        for path in partition.files:
            for row in records(system, path, columns, wanted):
                rows.append(row)
                size += 256 + len(row.get("payload", b""))
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Written(D.WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("archives are appended to; write to a new folder instead")
        self.path = options["path"]
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        done: list[dict] = []
        out = None
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        done.append({"file": f"part-{uuid.uuid4().hex}.warc.gz", "bytes": 0, "types": Counter()})
                        out = system.open_output_stream(f"{root.rstrip('/')}/{done[-1]['file']}", compression=None)
                    data = member(record(row))
                    out.write(data)
                    done[-1]["bytes"] += len(data)
                    done[-1]["types"][row["type"]] += 1
                    if done[-1]["bytes"] >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        lines = [json.dumps(f) for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{root.rstrip('/')}/{MANIFEST}{uuid.uuid4().hex}", compression=None) as f:
            f.write("".join(f"{line}\n" for line in lines).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{root.rstrip('/')}/{f['file']}")


class WarcSource(D.DataSource):
    """Format ``warc``; options ``path``, ``where`` (predicates as JSON), ``splitBytes`` and ``fileBytes``.

    Predicates are options of the reader and not taken from the query plan (``pushFilters``): Spark 4.1 keeps what was pushed with the
    loaded source, so two filters on one DataFrame, or a query without any after one with, would see each other's.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "type string, record_id string, date string, uri string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, schema: str, where: list[tuple] = (), **options: str) -> DataFrame:
    """Records with the given columns that meet all predicates ``(column, test, value)`` (see ``TESTS`` and ``holds``).

    Leave ``payload`` out where it isn't needed, it is not decoded then. Further filters on the DataFrame are Spark's own.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).options(where=json.dumps(list(where)), **options).load(path)


def write(rows: DataFrame, path: str, **options: str) -> None:
    """Append records to an archive; see ``record`` for the columns."""
    rows.sparkSession.dataSource.register(WarcSource)
    rows.write.format("warc").options(**options).mode("append").save(path)


# --- pages -------------------------------------------------------------------------

SALTS = 16


def record_id(of: Column) -> Column:
    """A name-based URN of a page."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(of.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def page_records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", least: int = 1000) -> DataFrame:
    """A record for each row of ``pages(page_id, url, html)``: the page itself, or a reference to the same payload.

    The payload is ``html`` in UTF-8 (NULL: empty). Of equal payloads of at least ``least`` bytes that of the largest ``page_id`` is the
    ``response``, the others are ``revisit`` records without payload; shorter ones are all responses. Repeated rows of the largest id are
    all responses (of the same record id); a NULL id is smaller than any other, and where all are NULL, all are responses. A
    NULL url has no URI field. An empty table gives none; other columns are not looked at.

    Payloads are told apart by SHA-256; the largest id of each is counted before it is joined, and only for payloads that occur
    more than once. Spark broadcasts that table where its measured size is small; else rows of one payload are spread over ``SALTS`` keys.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload")).withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "same": F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))),
        }
    )
    last = (
        rows.where("same IS NOT NULL").groupBy("same")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .select(F.col("same").alias("of"), "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALTS)).cast("int"))
    joined = salted.join(last, (F.col("same") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("type"),
        record_id(F.col("page_id")).alias("record_id"),
        F.lit(date).alias("date"),
        "uri",
        F.sha1("payload").alias("payload_digest"),
        F.when(again, record_id(F.col("last"))).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
        "page_id",
        F.when(again, F.col("last")).alias("page_refers_to"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an archive of ``page_records``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload``.

    Length and digest of a response are worked out from its payload, those of a revisit are its header's; revisits are read by header alone.
    """
    fields = "type string, page_id bigint, uri string, payload_digest string, payload_bytes bigint, page_refers_to bigint"
    whole = read(spark, path, f"{fields}, payload binary", [("type", "=", "response")]).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    )
    again = read(spark, path, fields, [("type", "=", "revisit")]).withColumn("payload", F.lit(None).cast("binary"))
    return whole.unionByName(again).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("page_refers_to").alias("refers_to"), "uri", "payload",
    )
