"""WARC archives as a Spark data source.

`spark.read.format("warc")` plans partitions of whole files of a folder by their sizes and
takes filters on `record_type`, `record_id`, `target_uri`, `refers_to` and `page_id` down to
the reader. A record's headers are parsed first; a record that the filters refuse is passed
over without decoding its payload: every record is a gzip member of its own whose
`sl` extra field (the skip lengths of the WARC standard's annex) tells where the next begins. Members
without that field are inflated to their end. Without the `payload` option
(`option("payload", "false")`) no accepted payload is decoded either.

`df.write.format("warc").save(folder)` writes rows of WRITE_SCHEMA. Every task writes a new
file of its own name into a staging folder. The commit removes what failed attempts left there
and publishes the folder by one move, so neither a lost executor nor a lost driver leaves a
part of an archive behind that a reader would see. With `overwrite`, the commit removes the
folder's older archives before that move. Readers pass over names that begin with _ or a dot.

Folders are named by any URI that pyarrow's file systems know.

Defined results: null html is an empty payload; equal payloads of at least `min_revisit`
bytes are one response (smallest page_id; nulls last) and revisits of it; a record's id comes
from page_id and payload, so a page_id with several payloads has a record of each; rows that
repeat a page_id and payload share one record type; an empty table writes no record and reads back
empty; further columns are ignored. Null urls get an empty target.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import fresh_path, materialise, table

READ_SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to string, payload_digest string, payload_length long, payload binary"
WRITE_SCHEMA = "page_id long, url string, payload binary, payload_digest string, refers_to long"
MIN_REVISIT = 100
#: Digests that several pages share, at most, that are broadcast: 40 bytes each.
SHARED_ROWS = 200_000
#: Bytes of archives that one task reads, if they are several files.
TASK_BYTES = 64 << 20
FILTERED = ("record_type", "record_id", "target_uri", "refers_to", "page_id")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record_name(page_id: int | None, digest: str) -> str:
    """The id of a page's record of one payload; urn:uuid as the standard wants, the same in every run."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


# -- records ------------------------------------------------------------------


def member(block: bytes) -> bytes:
    """A gzip member with the skip-length field: its own length and that of its content."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    told = (total, len(block)) if max(total, len(block)) < 1 << 32 else (0, 0)
    extra = b"sl" + struct.pack("<HII", 8, *told)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def line(text: str | None) -> str:
    """A header value on one line."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id, digest)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_name(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return member(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")


def headers(raw: bytes) -> dict[str, str]:
    found = {}
    for row in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = row.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def header_row(found: dict[str, str]) -> dict:
    page = found.get("x-page-id")
    return {
        "record_id": found.get("warc-record-id"),
        "record_type": found.get("warc-type"),
        "target_uri": found.get("warc-target-uri"),
        "page_id": int(page) if page and page.lstrip("-").isdigit() else None,
        "refers_to": found.get("warc-refers-to"),
        "payload_digest": (found.get("warc-payload-digest") or "").rpartition(":")[2] or None,
    }


class Archive:
    """Records of a file, one at a time; bytes are read forward and dropped behind."""

    def __init__(self, stream: pa.NativeFile, chunk: int = 1 << 20) -> None:
        self.stream, self.chunk, self.held, self.at = stream, chunk, b"", 0

    def need(self, n: int) -> bool:
        if len(self.held) - self.at < n:
            self.held = self.held[self.at :] + self.stream.read(max(self.chunk, n - (len(self.held) - self.at)))
            self.at = 0
        return len(self.held) - self.at >= n

    def inflated(self, inflate, most: int = 0) -> bytes:
        """More of the member's content; most: bytes at most, 0 for all that the next bytes hold."""
        feed = inflate.unconsumed_tail
        if not feed:
            if not self.need(1):
                raise ValueError("archive ends inside a record")
            feed = self.held[self.at : self.at + (1 << 16)]
            self.at += len(feed)
        return inflate.decompress(feed, most)

    def records(self, wanted, payloads: bool = True) -> Iterator[tuple[dict, bytes | None]]:
        """wanted: says from a header row whether the record is to be returned."""
        while self.need(20):
            if self.held[self.at : self.at + 2] != b"\x1f\x8b":
                raise ValueError("not a gzip member")
            length = 0
            if self.held[self.at + 3] & 4 and self.held[self.at + 12 : self.at + 14] == b"sl":
                length = struct.unpack("<I", self.held[self.at + 16 : self.at + 20])[0]
            self.need(length)
            begin, inflate, block = self.at, zlib.decompressobj(31), b""
            while b"\r\n\r\n" not in block:
                if inflate.eof:
                    raise ValueError("a record without headers")
                block += self.inflated(inflate, 1024)
            raw, _, rest = block.partition(b"\r\n\r\n")
            found = headers(raw)
            row = header_row(found)
            take = wanted(row)
            if length and not (take and payloads):
                self.at = begin + length
            else:
                parts = [rest]
                while not inflate.eof:
                    parts.append(self.inflated(inflate))
                self.at -= len(inflate.unused_data)
                rest = b"".join(parts) if take else b""
            if take:
                yield row, rest[: int(found.get("content-length", len(rest)))].partition(b"\r\n\r\n")[2] if payloads else None


# -- the data source ----------------------------------------------------------


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payloads: bool) -> None:
        self.folder, self.payloads, self.tests = folder, payloads, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in FILTERED and isinstance(f, EqualTo | EqualNullSafe):
                self.tests.append((name, (f.value,)))
            elif name in FILTERED and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, top = filesystem(self.folder)
        found = [x for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(".warc.gz")]
        out, names, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if any(part[:1] in "._" for part in x.path.removeprefix(top).strip("/").split("/")):
                continue
            if names and size + x.size > TASK_BYTES:
                out.append(Files(tuple(names)))
                names, size = [], 0
            names.append(x.path)
            size += x.size
        return [*out, Files(tuple(names))]

    def wanted(self, row: dict) -> bool:
        return all(row[name] in values and (row[name] is not None or None in values) for name, values in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.folder)
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])
        rows, held = [], 0
        for name in partition.names:
            with store.open_input_stream(name, compression=None) as stream:
                for row, payload in Archive(stream).records(self.wanted, self.payloads):
                    rows.append(row | {"payload": payload, "payload_length": None if payload is None else len(payload)})
                    held += len(payload or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool = False) -> None:
        self.folder, self.overwrite, self.name = folder, overwrite, uuid.uuid4().hex
        self.staging = posixpath.join(folder, f"_staging-{self.name}")

    def write(self, rows: Iterator) -> Written:
        store, top = filesystem(self.staging)
        store.create_dir(top, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(posixpath.join(top, name), compression=None) as out:
            for r in rows:
                out.write(record(r.page_id, r.url, bytes(r.payload or b""), r.payload_digest, r.refers_to))
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        """One move publishes the staging folder; a driver lost before it leaves nothing that is read."""
        store, top = filesystem(self.folder)
        _, staging = filesystem(self.staging)
        store.create_dir(top, recursive=True)
        old = store.get_file_info(fs.FileSelector(top)) if self.overwrite else []
        kept = {m.name for m in messages if m is not None and m.records}
        if store.get_file_info(staging).type == fs.FileType.Directory:
            for x in store.get_file_info(fs.FileSelector(staging)):
                if posixpath.basename(x.path) not in kept:
                    store.delete_file(x.path)
        for x in old:
            if posixpath.basename(x.path)[:1] not in "._":
                (store.delete_dir if x.type == fs.FileType.Directory else store.delete_file)(x.path)
        if kept:
            store.move(staging, posixpath.join(top, f"archive-{self.name}"))
        else:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, staging = filesystem(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class WarcSource(DataSource):
    """Options: path (folder); payload (true: decode payloads)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


# -- operators ------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and turn on the session's filter push-down into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """WRITE_SCHEMA rows of `pages` (page_id, url, html): which are responses, what revisits refer to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    shared = (
        rows.where(F.length("payload") >= min_revisit).groupBy(F.unhex("payload_digest").alias("d"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null").drop("n")
    )
    shared = materialise(shared, "warc-shared")
    # Few digests go to the payloads; beyond SHARED_ROWS, payloads are shuffled to their digests.
    few = shared.limit(SHARED_ROWS + 1).count() <= SHARED_ROWS
    joined = rows.join(F.broadcast(shared) if few else shared, F.unhex("payload_digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> None:
    register(pages.sparkSession)
    plan_records(pages, min_revisit).write.format("warc").mode("append").save(folder)


def read_archive(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with length and digest of its full payload, as measured on the bytes read.

    A revisit takes them from the response it refers to, joined by record id; payloads are
    measured where they are read and aren't shuffled.
    """
    responses = read_archive(spark, folder).where("record_type = 'response'").select("record_id", "page_id", "record_type", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    responses = materialise(responses, "warc-responses")
    revisits = read_archive(spark, folder, payload=False).where("record_type = 'revisit'").select("record_id", "page_id", "record_type", F.col("refers_to").alias("target"))
    own = responses.groupBy(F.col("record_id").alias("target")).agg(F.min(F.struct(F.col("page_id").alias("first_page"), "payload_bytes", "payload_digest")).alias("r")).select("target", "r.*")
    found = revisits.join(own, "target").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first_page").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return resolve(spark, folder)


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
