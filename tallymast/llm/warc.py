"""WARC archives as a Spark data source: ``df.write.format("warc")`` and ``spark.read.format("warc")``.

Every record is one gzip member, so an archive can be entered at any record's offset.  A task of the writer
fills archives of about ``archiveBytes`` compressed bytes one after another; the names of the archives of
tasks that succeeded are committed as one manifest file, so those of failed or repeated attempts are never
read.  A task of the reader streams whole archives (packed to about ``partitionBytes``): it inflates a chunk
at a time, frames records by their content length and takes the digests of block and payload as bytes go by.
Payloads are held in memory one record at a time, and only if they are asked for.

Layout of the written rows (reader's rows have more): record_id, target_uri, record_type (``response`` or
``revisit``), refers_to, payload (binary), payload_bytes and payload_digest (of the full payload, needed of a
revisit only, which has none).  A record's block is an HTTP head that states the full payload's length and,
unless it is a revisit, the payload.

Null payloads are empty ones.  White space and control characters of ids and addresses are percent-encoded;
null ones have no header and are read as null.  A record whose digests do not hold has ``verified`` false.
What breaks framing gives a row with ``error``: reading goes on with the next member if the break lies
inside one, and the archive ends there if the compressed stream is damaged or ends too early.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 1 << 18
#: The longest head of a record; a longer one is an error, not a reason to fill memory.
MOST_HEAD = 1 << 20
#: Rows and bytes of one Arrow batch of the reader.
ROWS, BYTES = 1_000, 1 << 24
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "record_id string, target_uri string, record_type string, refers_to string, payload binary, payload_bytes bigint, payload_digest string"
READ = "archive string, offset bigint, record_id string, target_uri string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, verified boolean, error string, payload binary"
COLUMNS = [c.split()[0] for c in READ.split(", ")]
KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def where(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it: a URI (file, hdfs, s3, gs) or a local path."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


# -- writing ------------------------------------------------------------------------------------------


def token(value: str) -> str:
    """A header value without white space and control characters."""
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict, date: str) -> Iterator[bytes]:
    """The bytes of one record."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    digest = row["payload_digest"] if revisit else base32_sha1(hashlib.sha1(payload))
    size = row["payload_bytes"] if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END
    block = hashlib.sha1(http)
    block.update(payload)
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {date}"]
    for name, value, form in (("WARC-Record-ID", row["record_id"], "<{}>"), ("WARC-Target-URI", row["target_uri"], "{}"), ("WARC-Refers-To", row["refers_to"], "<{}>")):
        if value is not None:
            head.append(f"{name}: {form.format(token(value))}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    yield "\r\n".join(head).encode() + END + http
    yield payload
    yield END


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, archive_bytes: int, level: int):
        self.folder, self.overwrite, self.archive_bytes, self.level = folder, overwrite, archive_bytes, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = where(self.folder)
        system.create_dir(folder, recursive=True)
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        names, out = [], None
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    # no compression by the file's name: members are compressed here
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                pieces = [member.compress(piece) for piece in record(row, date)]
                data = b"".join([*pieces, member.flush()])
                out.write(data)
                size += len(data)
                if size >= self.archive_bytes:
                    out = out.close()
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, folder = where(self.folder)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for path in manifests(system, folder):
                system.delete_file(path)
        names = [n for m in messages if m is not None for n in m.archives]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        system, folder = where(self.folder)
        for name in [n for m in messages if m is not None for n in m.archives]:
            system.delete_file(f"{folder}/{name}")


# -- reading ------------------------------------------------------------------------------------------


class Broken(Exception):
    """A record that cannot be framed."""


class Members:
    """The gzip members of a stream, inflated a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.at, self.start, self.inflater = stream, b"", 0, 0, None

    def open(self) -> bool:
        """Goes to the next member; false at the end of the stream."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.start, self.out, self.inflater = self.at, bytearray(), zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> bool:
        """Inflates up to a chunk more into ``out``; false once the member has ended."""
        if self.inflater.eof:
            return False
        self.raw = self.raw or self.stream.read(CHUNK)
        if not self.raw:
            raise EOFError("the archive ends inside a member")
        before = len(self.raw)
        self.out += self.inflater.decompress(self.raw, CHUNK)
        self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        self.at += before - len(self.raw)
        return True

    def head(self, most: int = MOST_HEAD) -> bytes:
        """Bytes up to an empty line, which is taken too."""
        seen = 0
        while (at := self.out.find(END, max(0, seen - 3))) < 0:
            seen = len(self.out)
            if seen > most or not self.more():
                raise Broken("no end of a head")
        got = bytes(self.out[:at])
        del self.out[: at + len(END)]
        return got

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces."""
        while size:
            if not self.out and not self.more():
                raise Broken("the record is shorter than its content length")
            piece = bytes(self.out[:size])
            del self.out[: len(piece)]
            size -= len(piece)
            yield piece

    def skip(self) -> int:
        """Takes the rest of the member and returns its size."""
        size = 0
        while True:
            size += len(self.out)
            self.out.clear()
            if not self.more():
                return size


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def number(text: str | None) -> int:
    if text is None or not re.fullmatch("[0-9]{1,18}", text):
        raise Broken("no content length")
    return int(text)


def one(members: Members, payload: bool) -> dict:
    """The record of the member that was opened."""
    head = members.head()
    if not head.startswith(b"WARC/1."):
        raise Broken("no WARC version")
    named = fields(head)
    left, block, own = number(named.get("content-length")), hashlib.sha1(), hashlib.sha1()
    http, size, stated = named.get("content-type", "").startswith("application/http"), 0, None
    if http:
        inner = members.head(min(left, MOST_HEAD))
        block.update(inner + END)
        left -= len(inner) + len(END)
        if left < 0:
            raise Broken("the HTTP head is longer than the record")
        stated = fields(inner).get("content-length")
    kept = []
    for piece in members.take(left):
        block.update(piece)
        own.update(piece)
        size += len(piece)
        if payload:
            kept.append(piece)
    if b"".join(members.take(len(END))) != END:
        raise Broken("no end of the record")
    if members.skip():
        raise Broken("more than one record in a member")
    digest, revisit = named.get("warc-payload-digest", "").removeprefix("sha1:"), named.get("warc-type") == "revisit"
    holds = named.get("warc-block-digest", f"sha1:{base32_sha1(block)}") == f"sha1:{base32_sha1(block)}"
    if not revisit:
        holds &= digest in ("", base32_sha1(own)) and (stated is None or number(stated) == size)
        digest = base32_sha1(own)
    inside = lambda name: named[name].strip("<>") if name in named else None
    return {
        "offset": members.start, "record_id": inside("warc-record-id"), "target_uri": named.get("warc-target-uri"), "record_type": named.get("warc-type"),
        "refers_to": inside("warc-refers-to"), "payload_bytes": number(stated) if revisit and stated is not None else size, "payload_digest": digest or None,
        "verified": holds, "payload": b"".join(kept) if payload and not revisit else None,
    }


def records(stream, payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order, without its name."""
    members = Members(stream)
    try:
        while members.open():
            try:
                yield one(members, payload)
            except Broken as broken:
                yield {"offset": members.start, "error": str(broken)}
                members.skip()
    except (zlib.error, EOFError) as broken:
        yield {"offset": members.start, "error": str(broken)}


def manifests(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [f.path for f in found if f.base_name.startswith("_manifest-")]


class Reader(DataSourceReader):
    def __init__(self, folder: str, payload: bool, partition_bytes: int):
        self.folder, self.payload, self.partition_bytes = folder, payload, partition_bytes

    def partitions(self) -> list[InputPartition]:
        """Archives in packs of about ``partition_bytes``: those of the manifests, or all in a folder without."""
        system, folder = where(self.folder)
        committed = manifests(system, folder)
        names = set()
        for path in committed:
            with system.open_input_stream(path) as stream:
                names.update(json.loads(stream.read()))
        found = system.get_file_info(fs.FileSelector(folder))
        archives = [f for f in found if f.base_name.endswith(".warc.gz") and (not committed or f.base_name in names)]
        packs, size = [[]], 0
        for f in sorted(archives, key=lambda f: (-f.size, f.path)):
            if packs[-1] and size + f.size > self.partition_bytes:
                packs.append([])
                size = 0
            packs[-1].append(f.path)
            size += f.size
        return [InputPartition(pack) for pack in packs]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = where(self.folder)
        schema = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in READ.split(", ")])
        rows, size = [], 0
        for path in partition.value:
            with system.open_input_stream(path, compression=None) as stream:
                for row in records(stream, self.payload):
                    rows.append({"archive": path, **row})
                    size += len(row.get("payload") or b"")
                    if len(rows) == ROWS or size > BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


class Warc(DataSource):
    """Options: ``payload`` (read payloads too, false by default), ``partitionBytes`` (16 MB of archives a
    task of the reader, a larger archive being a task of its own), ``archiveBytes`` (64 MB), ``level`` (of compression, 6)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "false") == "true", int(self.options.get("partitionBytes", 1 << 24)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("archiveBytes", 1 << 26)), int(self.options.get("level", 6)))


# -- pages --------------------------------------------------------------------------------------------


def base32(hex_digest) -> F.Column:
    """Base 32 of a SHA-1 in hexadecimal: five hexadecimal digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows for the archives from ``pages`` (page_id, url, html): of equal payloads of at least
    ``least_bytes`` bytes the one with the largest page_id is the response, the others revisit it.

    Rows that repeat the largest id and the payload are responses too, and so are equal payloads that all
    have null ids; a null id is smaller than any other.  Only digests that occur twice or more are joined,
    and adaptive execution splits the rows of a frequent one.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("sha").alias("same"))
    again = again.agg(F.max("page_id").alias("first_id"), F.count("*").alias("times")).where("times > 1").drop("times")
    joined = keyed.join(again, (F.col("sha") == F.col("same")) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return joined.select(
        name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, name(F.col("first_id"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", base32(F.col("sha")).alias("payload_digest"),
    )


def write_archives(rows: DataFrame, folder: str, **options: str) -> None:
    rows.sparkSession.dataSource.register(Warc)
    rows.write.format("warc").mode("append").options(**options).save(folder)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(Warc)
    return spark.read.format("warc").options(**options).load(folder)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified, error of archived pages."""
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long").alias(c)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "verified", "error")
