"""WARC archives as a PySpark Python data source.

Writing: a record for each row, in files of bounded size, each given its name when it is whole. A record is a gzip
member of its own, whose extra field ``sl`` has its compressed and its plain length (option compression: none writes
plain records). Reading: one partition for each file; predicates over columns that come from headers are taken over
from Spark; a record's headers are parsed first, from the first bytes of its member, and the rest is skipped by a seek,
neither read nor inflated, if a predicate drops the record or no column asks for its payload. Files of other writers,
without ``sl``, are read in sequence.

``deduplicated`` makes the rows: of records with equal payloads the one with the largest id is a response, and the
others are revisits of it, which carry the payload's digest and length but not the payload.

Defined results: a null payload is an empty one; a null id is smaller than any other, and its record carries none; rows
repeating both the largest id and its payload are responses alike; a null URL is left out; CR and LF in a header value
become blanks; an empty table writes no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..session import shared_dir, ship
from .common import skewed_left_join
from .token_files import Store

SCHEMA = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: The format's version line and the profile of a revisit with an identical payload.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ROLL_MB = 128


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(row: dict) -> bytes:
    clean = lambda s: " ".join(s.replace("\r", "\n").split("\n"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"") if row["record_type"] == "response" else http
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"])), ("WARC-Date", DATE)]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", clean(row["target_uri"])))
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
    if row["page_id"] is not None:
        head.append(("X-Page-ID", str(row["page_id"])))
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["payload_digest"])), ("X-Refers-To-Page", str(row["refers_to"]))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """``record`` as a gzip member with the extra field ``sl``: lengths of the member and of the record (modulo 2^32)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = len(record) & 0xFFFFFFFF
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 10 + 2 + 12 + 8, size)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), size)


class Members:
    """Records of a file of such members: a file-like view of one record at a time, inflated as far as it is read."""

    HEAD = 10 + 2 + 12

    def __init__(self, raw):
        self.raw, self.start = raw, 0

    def next(self) -> "io.BufferedReader | None":
        """The next record, or None at the end."""
        self.raw.seek(self.start)
        head = self.raw.read(self.HEAD)
        if not head:
            return None
        total = struct.unpack("<I", head[16:20])[0]
        self.left = total - self.HEAD - 8
        self.inflate = zlib.decompressobj(-15)
        self.start += total
        return io.BufferedReader(_Inflated(self), 4096)


class _Inflated(io.RawIOBase):
    def __init__(self, of: Members):
        self.of = of

    def readable(self):
        return True

    def readinto(self, buffer):
        of = self.of
        while True:
            data = of.inflate.decompress(of.inflate.unconsumed_tail, len(buffer)) if of.inflate.unconsumed_tail else b""
            if not data and of.left:
                chunk = of.raw.read(min(of.left, 2048))
                of.left -= len(chunk)
                data = of.inflate.decompress(chunk, len(buffer))
            if data or not (of.left or of.inflate.unconsumed_tail):
                buffer[: len(data)] = data
                return len(data)


def has_lengths(raw) -> bool:
    head = raw.read(16)
    raw.seek(0)
    return len(head) == 16 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"sl" + struct.pack("<H", 8)


def header_values(headers: dict[str, str]) -> dict:
    """The columns that a record's headers give."""
    number = lambda s: int(s) if s is not None else None
    digest = headers.get("warc-payload-digest")
    return {"page_id": number(headers.get("x-page-id")), "target_uri": headers.get("warc-target-uri"), "record_type": headers.get("warc-type"), "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": number(headers.get("x-refers-to-page"))}


_TESTS = {
    EqualTo: lambda a, b: a is not None and a == b,
    EqualNullSafe: lambda a, b: a == b,
    GreaterThan: lambda a, b: a is not None and a > b,
    GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b,
    LessThanOrEqual: lambda a, b: a is not None and a <= b,
    In: lambda a, b: a is not None and a in b,
}
HEADER_COLUMNS = ("page_id", "target_uri", "record_type", "payload_digest", "refers_to")


class WarcFile(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.columns, self.filters = options["path"], columns, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADER_COLUMNS and type(f) in (*_TESTS, IsNull, IsNotNull):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        return [WarcFile(n) for n in Store(self.folder).names() if n.endswith((".warc", ".warc.gz")) and not n.startswith("_")]

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            v = row[f.attribute[0]]
            ok = v is None if isinstance(f, IsNull) else v is not None if isinstance(f, IsNotNull) else _TESTS[type(f)](v, f.value)
            if not ok:
                return False
        return True

    def read(self, partition):
        if not isinstance(partition, WarcFile):  # an archive without files
            return
        decode, http = "payload" in self.columns, "payload_bytes" in self.columns
        with Store(self.folder).open(partition.value) as raw:
            rows, held = [], 0
            for f in self.records(raw):
                row = self.record(f, partition.value, decode, http)
                if row is None:
                    continue
                rows.append(row)
                held += len(row.get("payload") or b"")
                if len(rows) == 1000 or held > 16 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def records(raw):
        """A stream at the start of each record. One stream stands for all records of a plain file."""
        if has_lengths(raw):
            members = Members(raw)
            while (f := members.next()) is not None:
                yield f
            return
        magic = raw.read(2)
        raw.seek(0)
        f = gzip.GzipFile(fileobj=raw) if magic == b"\x1f\x8b" else raw
        while line := f.readline():
            if line.strip():
                f.seek(-len(line), 1)
                yield f

    def record(self, f, name: str, decode: bool, http: bool) -> dict | None:
        line = f.readline()
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record starts with {line[:40]!r}")
        headers = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        left, row = int(headers["content-length"]), header_values(headers)
        wanted = self.wanted(row)
        if wanted and (decode or http):
            # The block's own header gives the payload's length; what follows is read only if it is asked for.
            while left > 0 and (line := f.readline()):
                left -= len(line)
                k, _, v = line.decode("latin-1").partition(":")
                if k.strip().lower() == "content-length":
                    row["payload_bytes"] = int(v)
                if not line.strip():
                    break
            if decode and row["record_type"] == "response":
                row["payload"] = f.read(left)
                left = 0
        if f.seekable():
            f.seek(left, 1)
        return row if wanted else None

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"target_uri": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.int64())) for c in self.columns], names=self.columns)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.roll = options["path"], int(options.get("rollMb", ROLL_MB)) << 20
        self.packed = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        store, tag = Store(self.folder), uuid.uuid4().hex

        def rows():
            for b in iterator:
                for at in range(0, b.num_rows, 256):
                    yield from b.slice(at, 256).to_pylist()

        source, number, names = rows(), 0, []
        ahead = next(source, None)
        while ahead is not None:
            def fill(f):
                nonlocal ahead
                size = 0
                while ahead is not None and size < self.roll:
                    record = record_bytes(ahead)
                    size += f.write(member(record) if self.packed else record)
                    ahead = next(source, None)

            names.append(f"part-{tag}-{number:05d}.warc" + ".gz" * self.packed)
            store.put("_" + names[-1], fill)  # it gets its name at the commit, so a task that ran twice leaves one copy
            number += 1
        return Written(names)

    def commit(self, messages):
        store = Store(self.folder)
        for m in messages:
            for n in m.names if m else ():
                store.rename("_" + n, n)

    def abort(self, messages):
        pass


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(columns of SCHEMA).load(folder)`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def deduplicated(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A row of SCHEMA for each page. Only digests that more than one page has are joined back, hot ones apart."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    met = skewed_left_join(rows, groups, "digest", "n", ["last"], F.coalesce(F.col("page_id"), F.xxhash64("target_uri")))
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return met.select(
        "page_id", "target_uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "payload_bytes",
        "digest", F.when(revisit, F.col("last")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as an archive."""
    register(pages.sparkSession)
    Store(folder)
    rows = deduplicated(pages, min_bytes).withColumn("payload_digest", base32_column(F.col("digest"))).drop("digest")
    rows.write.format("warc").mode("append").save(folder)


def base32_column(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 20 bytes are 32 groups of five bits."""
    bits = [F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, (F.shiftright(b, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for b in bits for j in range(8)])


def read_warc(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).load(folder)


def warc_query(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a scratch archive and return a row for each record read back. A response's length and digest
    are taken from the payload that was read; a revisit has none, and its own headers give them."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    write_warc(pages, folder)
    back = read_warc(spark, folder)
    whole = F.col("payload").isNotNull()
    return back.select(
        "page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, base32_column(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha1(x) AS h, max(page_id) OVER (PARTITION BY x) AS last FROM p),
q AS (SELECT *, [CAST('0x' || substr(h, 1 + 10 * i, 10) AS BIGINT) FOR i IN range(0, 4)] AS parts FROM d)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((parts[1 + k // 8] >> (35 - 5 * (k % 8))) & 31 AS INTEGER), 1) FOR k IN range(0, 32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM q
"""
