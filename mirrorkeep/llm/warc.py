"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

A column of the schema is a header field: ``record_type`` is WARC-Type, the others in ``FIELDS`` likewise, and any further
column is the field of its own name with hyphens for underscores (``page_id``: Page-Id), as text or as a number. ``headers`` is a map of all
fields, ``payload`` the content, without the HTTP header where the record has one. So the schema given to the reader says what is read.

Reading plans partitions of whole files. Filters on header fields go down to the reader. It parses the header of a record
first; a record that a filter rejects, or whose payload no column asks for, is passed over: by a seek where the file is plain, or where its
gzip member tells its length; other gzip members have to be inflated to find their end, in small pieces.

Writing makes a gzip member of each record (or none, ``compression=none``), cuts files at ``file_bytes``, and
moves the files of the tasks that counted into place when all are done. Lost or repeated tasks leave nothing.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, IntegerType, LongType, MapType, StringType, StructType

from mirrorkeep.common import materialize, shared_dir
from mirrorkeep.operators.skew import lookup, numbered

# Fixed values of the format: version, fields, types and the profile of a revisit.
VERSION = "WARC/1.1"
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
# The subfield of a gzip header that holds the member's length, packed and unpacked.
LENGTHS = b"sl"

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, headers map<string,string>, payload binary"
# Bytes of files in a partition, of records in a file, and of payload in a batch.
PARTITION_BYTES = 64 << 20
FILE_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000
BUFFER = 1 << 20
# A header that is longer than this is none.
MAX_HEADER = 1 << 20
# Payloads from this size on are archived once.
REVISIT_FROM = 100


def field_name(column: str) -> str:
    return FIELDS.get(column, column.replace("_", "-")).lower()


class Plain:
    """Bytes of an uncompressed archive."""

    def __init__(self, file: pa.NativeFile):
        self.size = file.size()
        self.buffered = io.BufferedReader(file, BUFFER)

    def at_end(self) -> bool:
        return not self.buffered.peek(1)

    def line(self) -> bytes:
        return self.buffered.readline(MAX_HEADER)

    def read(self, n: int) -> bytes:
        return self.buffered.read(n)

    def skip(self, n: int) -> None:
        if self.buffered.tell() + n > self.size:
            raise EOFError("the archive ends within a record")
        self.buffered.seek(n, io.SEEK_CUR)


class Inflated:
    """Bytes of a gzipped archive, one member after the other."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = io.BufferedReader(file, BUFFER), file.size()
        self.ready = b""
        self.inflate = None

    def member(self) -> bool:
        """Begin the next member, if there is one."""
        self.start = self.file.tell()
        head = self.file.read(12)
        if not head:
            return False
        self.end, self.length = None, None
        if head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {self.start}")
        if len(head) == 12 and head[3] & 4:
            extra = self.file.read(struct.unpack("<H", head[10:])[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == LENGTHS and n == 8:
                    packed, self.length = struct.unpack("<II", extra[4:12])
                    self.end = self.start + packed
                extra = extra[4 + n :]
        self.file.seek(self.start)
        self.inflate, self.given = zlib.decompressobj(31), 0
        return True

    def more(self) -> bool:
        """Inflate some more; false at the end of the file."""
        while self.inflate or self.member():
            piece = self.inflate.unconsumed_tail or self.file.read(16_384)
            if not piece:
                raise EOFError("the archive ends within a gzip member")
            out = self.inflate.decompress(piece, BUFFER)
            if self.inflate.eof:
                self.file.seek(self.file.tell() - len(self.inflate.unused_data))
                self.inflate = None
            self.given += len(out)
            self.ready += out
            if out:
                return True
        return False

    def at_end(self) -> bool:
        return not self.ready and not self.more()

    def line(self) -> bytes:
        while (at := self.ready.find(b"\n")) < 0 and len(self.ready) < MAX_HEADER and self.more():
            pass
        return self.read(at + 1 if at >= 0 else len(self.ready))

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if not self.ready and not self.more():
                raise EOFError("the archive ends within a record")
            parts.append(self.ready[:left])
            self.ready = self.ready[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        # The member ends with the record and its two empty lines.
        if self.inflate and self.end and self.end <= self.size and self.given - len(self.ready) + n + 4 == self.length:
            self.file.seek(self.end)
            self.inflate, self.ready = None, b"\r\n\r\n"
            return
        while n:
            if not self.ready and not self.more():
                raise EOFError("the archive ends within a record")
            step = min(n, len(self.ready))
            self.ready, n = self.ready[step:], n - step


def parse_header(stream: Plain | Inflated) -> dict[str, str] | None:
    """The fields of the next record by lower-case name; none at the end of the archive."""
    first = b""
    while not first.strip():
        if stream.at_end():
            return None
        first = stream.line()
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
    fields: dict[str, str] = {}
    name = ""
    while line := stream.line():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return fields
        if text[0] in " \t" and name:
            fields[name] = f"{fields[name]} {text.strip()}".strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    raise EOFError("the archive ends within a header")


def records(stream: Plain | Inflated, wanted: Callable[[dict[str, str]], bool], payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Fields of every wanted record, with its payload if asked for."""
    while (fields := parse_header(stream)) is not None:
        length = int(fields["content-length"])
        if not wanted(fields):
            stream.skip(length)
        elif not payload:
            stream.skip(length)
            yield fields, None
        else:
            block = stream.read(length)
            if len(block) < length:
                raise EOFError("the archive ends within a record")
            if fields.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            yield fields, block


# What a pushed filter asks of a field's value.
TESTS: dict[type[Filter], Callable[[str, object], bool]] = {
    EqualTo: lambda x, v: x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


def number(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def test_of(wish: Filter, columns: dict[str, str]) -> tuple[str, str, bool, type[Filter], object] | None:
    """Field, its type, is it turned round, kind and value of a filter that the reader can apply; none for others."""
    turned = isinstance(wish, Not)
    inner = wish.child if turned else wish
    if len(getattr(inner, "attribute", ())) != 1 or (column := inner.attribute[0]) not in columns:
        return None
    if type(inner) in (IsNull, IsNotNull):
        return field_name(column), columns[column], turned, type(inner), None
    value = getattr(inner, "value", None)
    # Comparisons of text go by code points in Python and by bytes in Spark, which is the same order but for surrogates.
    if type(inner) not in TESTS or value is None or (isinstance(value, (list, tuple)) and None in value):
        return None
    return field_name(column), columns[column], turned, type(inner), tuple(value) if isinstance(value, (list, tuple)) else value


class Part(InputPartition):
    """Files of one task."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.schema = schema
        self.tests: list[tuple[str, str, bool, type[Filter], object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        columns = {f.name: "number" if isinstance(f.dataType, (IntegerType, LongType)) else "text" for f in self.schema if f.name not in ("payload", "headers")}
        for wish in filters:
            if (test := test_of(wish, columns)) is None:
                yield wish
            else:
                self.tests.append(test)

    def partitions(self) -> list[Part]:
        files, root = pafs.FileSystem.from_uri(self.path)
        found = files.get_file_info(root)
        infos = [found] if found.is_file else files.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = (i for i in infos if i.is_file and not any(p[0] in "._" for p in i.path.removeprefix(root).split("/") if p))
        sized = sorted(((i.path, i.size) for i in hidden if i.path.endswith((".warc", ".warc.gz"))), key=lambda x: -x[1])
        parts: list[list[str]] = []
        room = 0
        for path, size in sized:
            if not parts or room < size:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append(path)
            room -= size
        # A table without files has one part without any.
        return [Part(p) for p in parts or [[]]]

    def wanted(self, fields: dict[str, str]) -> bool:
        for name, kind, turned, test, value in self.tests:
            x = number(fields.get(name)) if kind == "number" else fields.get(name)
            if test in (IsNull, IsNotNull):
                holds = (x is None) == (test is IsNull)
            elif x is None and test is not EqualNullSafe:
                # Neither true nor false, and so is its negation.
                return False
            else:
                holds = x is not None and TESTS[test](x, value)
            if holds == turned:
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        columns = [(f.name, f.dataType) for f in self.schema]
        payload = any(n == "payload" for n, _ in columns)
        kinds = {BinaryType: pa.binary(), MapType: pa.map_(pa.string(), pa.string()), LongType: pa.int64(), IntegerType: pa.int32(), StringType: pa.string()}
        arrow = pa.schema([(n, kinds[type(t)]) for n, t in columns])

        def value(name: str, kind: object, fields: dict[str, str], block: bytes | None) -> object:
            if name == "payload":
                return block
            if name == "headers":
                return list(fields.items())
            x = fields.get(field_name(name))
            return number(x) if isinstance(kind, (LongType, IntegerType)) else x

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

        for path in partition.value:
            with files.open_input_file(path) as file:
                magic = file.read(2)
                file.seek(0)
                stream = Inflated(file) if magic == b"\x1f\x8b" else Plain(file)
                rows: list[tuple] = []
                held = 0
                for fields, block in records(stream, self.wanted, payload):
                    rows.append(tuple(value(n, t, fields, block) for n, t in columns))
                    held += len(block or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


def record(fields: dict[str, str], block: bytes) -> bytes:
    """The bytes of a record. Line ends within a value are percent-encoded, as they would end the field."""
    lines = [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in fields.items()]
    head = "\r\n".join([VERSION, *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def packed(data: bytes, level: int) -> bytes:
    """A gzip member whose header tells its lengths."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    # Lengths that do not fit are left out, and the reader inflates.
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = LENGTHS + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


class Written(WriterCommitMessage):
    """Names of the files of one task."""

    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.level = {"none": None, "gzip": int(options.get("level", "1"))}[options.get("compression", "gzip")]
        self.job = uuid.uuid4().hex
        self.names = [f.name for f in schema]

    def place(self) -> tuple[pafs.FileSystem, str, str]:
        files, root = pafs.FileSystem.from_uri(self.path)
        return files, root, posixpath.join(root, f"_temporary-{self.job}")

    def block(self, row: dict[str, object]) -> tuple[dict[str, str], bytes]:
        fields = {FIELDS.get(k, "-".join(p.capitalize() for p in k.split("_"))): str(v) for k, v in row.items() if k not in ("payload", "headers") and v is not None}
        fields.update((k, v) for k, v in row.get("headers") or [] if v is not None)
        fields.setdefault("WARC-Type", "resource")
        fields.setdefault("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")
        fields.setdefault("WARC-Date", datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        payload = row.get("payload") or b""
        if fields["WARC-Type"] == "revisit":
            fields.setdefault("WARC-Profile", PROFILE)
        if fields["WARC-Type"] in ("response", "revisit"):
            fields.setdefault("Content-Type", HTTP)
            if fields["Content-Type"].startswith("application/http"):
                size = fields.get("Payload-Bytes", len(payload))
                payload = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
        return fields, payload

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, temporary = self.place()
        ending = ".warc" if self.level is None else ".warc.gz"
        names: list[str] = []
        out, filled = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or filled >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.create_dir(temporary, recursive=True)
                        names.append(f"part-{uuid.uuid4().hex}{ending}")
                        out, filled = files.open_output_stream(posixpath.join(temporary, names[-1]), compression=None), 0
                        filled += self.put(out, {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
                                                 "WARC-Filename": names[-1], "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    filled += self.put(out, *self.block(row))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def put(self, out: pa.NativeFile, fields: dict[str, str], block: bytes) -> int:
        data = record(fields, block)
        data = data if self.level is None else packed(data, self.level)
        out.write(data)
        return len(data)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, temporary = self.place()
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for info in files.get_file_info(pafs.FileSelector(root)):
                if info.is_file and info.path.endswith((".warc", ".warc.gz")):
                    files.delete_file(info.path)
        for message in messages:
            for name in message.names if message else ():
                files.move(posixpath.join(temporary, name), posixpath.join(root, name))
        self.clear(files, temporary)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, temporary = self.place()
        self.clear(files, temporary)

    def clear(self, files: pafs.FileSystem, temporary: str) -> None:
        if files.get_file_info(temporary).type == pafs.FileType.Directory:
            files.delete_dir(temporary)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_records(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The records of the archives below a path; the columns named are the header fields and payloads that are read.

    Load anew for each set of filters: a loaded table keeps those pushed to it last, also for a question without any.
    """
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def with_record_types(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, first (page_id of the response, for revisits).

    Digests and sizes are written down apart from the payloads; the first page of each repeated digest is found on these, and looked up
    by the pages, a digest of many pages in pieces. Of rows that share the smallest page_id too, one is the response.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    slim = materialize(rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest"), "payload-digests")
    smallest = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "copies")).alias("head")
    heads = slim.groupBy("payload_digest", "page_id").agg(F.count("*").alias("copies"))
    heads = heads.groupBy("payload_digest").agg(smallest, F.sum("copies").alias("total")).where("total > 1")
    heads = materialize(heads.select("payload_digest", F.col("head.page_id").alias("first"), F.col("head.copies").alias("copies"), "total"), "payload-heads")
    found = lookup(rows, heads, ["payload_digest"], weigh=slim)
    is_head = F.col("total").isNull() | F.col("first").eqNullSafe(F.col("page_id"))
    found = found.withColumn("is_head", is_head)
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "first"]
    plain = found.where("not is_head or copies is null or copies = 1").withColumn("record_type", F.when(F.col("is_head"), "response").otherwise("revisit"))
    if not heads.where("copies > 1").isEmpty():
        tied = numbered(found.where("is_head and copies > 1"), ["payload_digest"], ["url"], "nth")
        plain = plain.unionByName(tied.withColumn("record_type", F.when(F.col("nth") == 1, "response").otherwise("revisit")).drop("nth"))
    return plain.withColumn("first", F.when(F.col("record_type") == "revisit", F.col("first"))).select(columns)


def digest_id(digest: str) -> Column:
    """The id of the one response with a repeated payload."""
    parts = [F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def archive(pages: DataFrame, path: str, least: int = REVISIT_FROM, **options: str) -> None:
    """Write a record of every page: page_id, url, html (null: empty).

    Of pages with equal payloads of at least ``least`` bytes that with the smallest page_id, nulls last, is the response and the
    others are revisits of it, without the payload. A null url or page_id is a field that the record lacks. Rows may repeat; an empty
    table makes no file; further columns are not read.
    """
    register(pages.sparkSession)
    typed = with_record_types(pages, least)
    revisit = F.col("record_type") == "revisit"
    big = F.col("payload_bytes") >= least
    out = typed.select(
        "record_type",
        F.when(~revisit & big, digest_id("payload_digest")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, digest_id("payload_digest")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        "page_id",
        "payload_bytes",
        F.col("first").alias("refers_to_page"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").options(**options).mode("append").save(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page archived below a path.

    Size and digest of a response are those of the payload read; those of a revisit are in its header, and its payload is the
    one it refers to, so no payload is read for it.
    """
    responses = read_records(spark, path, "page_id long, record_type string, payload binary").where("record_type = 'response'")
    responses = responses.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = read_records(spark, path, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_page long").where("record_type = 'revisit'")
    revisits = revisits.select("page_id", "payload_bytes", F.expr("substring_index(payload_digest, ':', -1)").alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"))
    return responses.unionByName(revisits)


def round_trip(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Archive the pages below the shared folder and read the archives back: see ``archive`` and ``restore``."""
    path = shared_dir(pages.sparkSession, "warc")
    archive(pages, path, least)
    return restore(pages.sparkSession, path)
