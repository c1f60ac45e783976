"""WARC archives as a PySpark Python data source, and a writer that stores equal payloads once.

Read: ``spark.read.format("warc").load(folder)``, .warc and .warc.gz files of any writer. The driver plans one partition per group of
files; filters on record_type and on the header columns (IsNull, =, IN, comparisons) are pushed down: a record's headers are inflated
first, and a record that they rule out is stepped over without inflating its payload (where the gzip member's extra field ``sl`` or, in
plain files, the headers tell its length; else it is inflated piece by piece and dropped). ``option("payload", "false")`` reads headers
only, ``"verify"`` checks payloads against their digests without returning them. The payload is the HTTP body of responses and the
whole block of records that hold no HTTP message; revisits have none. A payload whose SHA-1 or SHA-256 differs from the one that its
record names is an error; other or no digests are not checked, and payload_digest is then as the record has it, or null.

Write: ``df.write.format("warc").mode("append").save(folder)``: each task writes files of its own under a name of the attempt, each
beginning with a warcinfo record; the commit renames those of the attempts that count; a lost executor's files never become visible.

Paths may be in any store pyarrow knows (file, hdfs, s3, gs). Null texts are empty payloads. Pages without rows make no file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import scratch, store, table, tune

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"
COLUMNS = ["record_id", "record_type", "target_uri", "page_id", "payload_bytes", "payload_digest", "refers_to", "payload"]
PARTITION_BYTES, FILE_BYTES, HEAD = 64 << 20, 256 << 20, 4096
EPOCH = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, uri, payload: bytes, kind: str, refers_to, length: int, sha1: str) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    heads = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"), ("WARC-Date", EPOCH), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(length))]
    if uri is not None:
        heads.append(("WARC-Target-URI", "".join(uri.split())))
    if kind == "revisit":
        heads += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    heads.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n").encode() + block + b"\r\n\r\n"


def about(name: str) -> bytes:
    """The warcinfo record of a file."""
    block = b"software: tracelane\r\nformat: WARC File Format 1.1\r\n"
    heads = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", EPOCH), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its compressed and plain lengths in the extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return struct.pack("<BBBBIBB", 31, 139, 8, 4, 0, 0, 255) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_heads(data: bytes) -> tuple[dict, int] | None:
    """Header fields (lower-case names) and where the block begins; None while the end of the headers isn't there."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def columns_of(fields: dict) -> dict:
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "page_id": page_of(fields.get("warc-record-id")),
        "payload_bytes": int(fields["x-payload-length"]) if "x-payload-length" in fields else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "http": "http" in fields.get("content-type", "application/http"), "refers_to": page_of(fields.get("warc-refers-to")),
    }


def gzip_head(stream) -> int | None:
    """Reads a gzip member's header: the member's length, 0 if it doesn't tell; None at the end of the file."""
    head = stream.read(10)
    if len(head) < 10:
        return None
    if head[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    total, flags = 0, head[3]
    if flags & 4:
        extra, at = stream.read(struct.unpack("<H", stream.read(2))[0]), 0
        while at + 4 <= len(extra):
            size = struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if extra[at : at + 2] == b"sl" and size == 8:
                total = struct.unpack("<I", extra[at + 4 : at + 8])[0]
            at += 4 + size
    for flag in (8, 16):  # a name, a comment
        while flags & flag and stream.read(1) not in (b"\0", b""):
            pass
    if flags & 2:
        stream.read(2)
    return total


class Source:
    """The bytes of one record after another, of a gzip member each or of a plain file."""

    def __init__(self, stream, zipped: bool):
        self.stream, self.zipped = stream, zipped

    def heads(self) -> tuple[dict, bytes] | None:
        """Header fields of the record that begins here, and what was read of its block; None at the end."""
        self.start, plain = self.stream.tell(), b""
        if self.zipped:
            self.total = gzip_head(self.stream)
            if self.total is None:
                return None
            self.inflate = zlib.decompressobj(-15)
        while True:
            raw = self.stream.read(HEAD)
            plain += self.inflate.decompress(raw) if self.zipped else raw
            if not self.zipped and not plain.strip(b"\r\n"):
                if not raw:
                    return None
                continue
            skipped = len(plain) - len(plain.lstrip(b"\r\n"))
            found = parse_heads(plain[skipped:])
            if found:
                self.begin = self.start + skipped + found[1]  # of the block, in a plain file
                return found[0], plain[skipped + found[1] :]
            if not raw:
                raise ValueError("a record ends within its headers")

    def block(self, length: int, held: bytes, wanted: bool) -> bytes:
        """The block (empty unless wanted); moves to the next record."""
        if not self.zipped:
            if wanted and len(held) < length:
                held += self.stream.read(length - len(held))
            self.stream.seek(self.begin + length)
            if wanted and len(held) < length:
                raise ValueError("a record's end is missing")
            return held[:length] if wanted else b""
        if self.total and not wanted:
            self.stream.seek(self.start + self.total)
            return b""
        parts = [held]
        while not self.inflate.eof:
            raw = self.stream.read(1 << 16)
            if not raw:
                raise ValueError("a record's end is missing")
            part = self.inflate.decompress(raw)
            if wanted:
                parts.append(part)
        self.stream.seek(self.stream.tell() - len(self.inflate.unused_data) + 8)
        return b"".join(parts)[:length] if wanted else b""


def records(stream, want, zipped: bool = True):
    """Records of a stream whose header columns pass `want` ("payload", "head" or ""): (columns, block or None)."""
    source = Source(stream, zipped)
    while (found := source.heads()) is not None:
        fields, held = found
        columns = columns_of(fields)
        wanted = want(columns)
        block = source.block(int(fields.get("content-length", 0)), held, wanted == "payload")
        if wanted:
            yield columns, block if wanted == "payload" else None


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def differs(payload: bytes, named: str | None) -> bool:
    """Whether a payload has another digest than the one named: SHA-1 or SHA-256 in base32 or hexadecimal; others are not checked."""
    kind, _, value = (named or "").rpartition(":")
    make = {"": hashlib.sha1, "sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256}.get(kind.lower())
    if make is None or not value:
        return False
    own = make(payload)
    return value.rstrip("=").upper() != base64.b32encode(own.digest()).decode().rstrip("=") and value.lower() != own.hexdigest()


@dataclass
class Files(InputPartition):
    paths: tuple


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.rules = options["path"], options.get("payload", "true").lower(), []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", (None,))
            ours = isinstance(f, (EqualTo, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(name) == 1 and name[0] in COLUMNS[:-1]
            if ours:
                self.rules.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, at = store(self.path)
        found = sorted((i.path, i.size) for i in files.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and i.path.endswith((".warc.gz", ".warc")) and "/_" not in i.path[len(at.rstrip("/")) :])
        groups, size = [[]], 0
        for path, n in found:
            if groups[-1] and size + n > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(tuple(g)) for g in groups if g] or [Files(())]

    def keeps(self, columns: dict) -> bool:
        for f in self.rules:
            v = columns[f.attribute[0]]
            if isinstance(f, IsNull):
                ok = v is None
            elif isinstance(f, IsNotNull):
                ok = v is not None
            elif v is None:
                ok = False
            elif isinstance(f, In):
                ok = v in f.value
            else:
                x = f.value
                ok = v == x if isinstance(f, EqualTo) else v > x if isinstance(f, GreaterThan) else v >= x if isinstance(f, GreaterThanOrEqual) else v < x if isinstance(f, LessThan) else v <= x
            if not ok:
                return False
        return True

    def read(self, partition):
        files, _ = store(self.path)
        want = lambda c: ("payload" if self.payload != "false" and c["record_type"] != "revisit" else "head") if self.keeps(c) else ""
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c in ("page_id", "payload_bytes", "refers_to") else pa.string()) for c in COLUMNS])
        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as stream:
                zipped = stream.read(2) == b"\x1f\x8b"
                stream.seek(0)
                for columns, block in records(stream, want, zipped):
                    if block is not None:
                        payload = payload_of(block) if columns["http"] and columns["record_type"] in ("response", "request") else block
                        if differs(payload, columns["payload_digest"]):
                            raise ValueError(f"payload digest differs in {path}: {columns['record_id']}")
                        columns = columns | {"payload": payload if self.payload != "verify" else None, "payload_bytes": len(payload)}
                        size += len(payload)
                    rows.append({c: columns.get(c) for c in COLUMNS})
                    if len(rows) >= 1000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    files: tuple


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator):
        files, at = store(self.path)
        folder, done, out, size = f"{at}/_attempts/{self.job}", [], None, 0
        files.create_dir(folder, recursive=True)
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "target_uri", "payload", "record_type", "refers_to", "payload_digest")]
            for page_id, uri, payload, kind, refers_to, sha1 in zip(*columns, strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = files.open_output_stream(f"{folder}/{name}", compression=None), 0
                    done.append(name)
                    out.write(member(about(name)))
                payload = payload or b""
                data = member(record(page_id, uri, payload, kind, refers_to, len(payload), sha1 or digest(payload)))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(done))

    def commit(self, messages):
        from pyarrow import fs

        files, at = store(self.path)
        old = [i.path for i in files.get_file_info(fs.FileSelector(at, recursive=False)) if i.is_file] if self.overwrite else []
        for m in messages:
            for name in m.files if m else ():
                files.move(f"{at}/_attempts/{self.job}/{name}", f"{at}/{name}")
        for path in old:
            files.delete_file(path)
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        files, at = store(self.path)
        if files.get_file_info(f"{at}/_attempts/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{at}/_attempts/{self.job}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def sha1_base32(data):
    """Column: base32 of the SHA-1, from the hexadecimal digits (40 of them are 32 groups of 5 bits)."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexa = F.sha1(data)
    halves = [F.lpad(F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*halves)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", alphabet)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, target_uri, payload, payload_digest, record_type, refers_to. Of equal payloads the smallest page_id is the response (rows
    that repeat this id are responses too); pages without an id come after all others, and are responses only among themselves.

    Copies are found on digests and ids alone; payloads then meet their plan by id, so that a payload of many pages is no task's own."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", sha1_base32(F.col("payload")))
    facts = rows.groupBy("page_id", "payload_digest").agg(F.count("*").alias("n"))
    again = facts.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1").select(F.col("payload_digest").alias("_digest"), "first")
    told = facts.join(again, F.col("payload_digest") == F.col("_digest")).select(F.col("page_id").alias("_page"), "_digest", "first")
    joined = rows.join(told, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "target_uri", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    """Writes the archives of all pages to a new folder in the shared one and reads the pages' records back: payloads are checked, other records
    are stepped over by the pushed filter."""
    tune(spark)
    register(spark)
    folder = scratch(spark, "warc")
    plan_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").option("payload", "verify").load(folder).where(F.col("record_type").isin("response", "revisit"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH h AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS x FROM pages),
n AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, x,
        array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda i:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 10 * g, 10))::BIGINT >> (35 - 5 * i)) & 31)::INTEGER, 1)), '')), '') AS payload_digest FROM h),
f AS (SELECT x, min(page_id) AS first FROM n GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM n JOIN f USING (x)
"""
