"""WARC archives as a PySpark data source, read and written.

Reading: ``spark.read.format("warc").load(folder)``. Each partition is a group of whole
files of about ``split_bytes``. Predicates on ``record_type`` and on the header columns are
pushed down: a record's headers are inflated first, and where they fail a predicate, or
where the payload isn't asked for (option ``payload`` = false), the rest of the record is
skipped by the length in its gzip header (extra field ``sl``) without being inflated.
Archives of other writers lack that field; their unwanted payloads are inflated piece by
piece and dropped.

Writing: ``df.write.format("warc").mode("append").save(folder)``. Every record is one gzip
member; a task starts a new file after ``file_bytes``. Tasks write under pending names; the
commit gives the files of the successful attempts their final names, so lost executors
leave nothing that is read.

Paths go through pyarrow's file systems, so a folder may be on a disk or in a store that
driver and executors share.

Defined results: null html is an empty payload; null url leaves the header out; null ids
come back as null; rows with equal payloads of at least ``least`` bytes are linked whether
or not other columns differ, and of rows that share the largest page_id each stays a
response; an empty table gives no archive and no rows; extra columns are not read.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from parcelforge.llm.common import BROADCAST_BYTES, table
from parcelforge.session import materialize, shared_dir

#: Parts that the rows of one digest are dealt over where the repeated digests are too many to broadcast.
SALTS = 32
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary"
#: Header of each column that predicates can be pushed to.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
_PIECE = 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bare(value: str | None) -> str | None:
    """A header's value without angle brackets and the name of the digest."""
    return None if value is None else value.removeprefix("<").removesuffix(">").removeprefix("sha1:")


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with its own lengths in the extra field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = len(_GZIP) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record))
    return _GZIP + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, digest: str, http_length: int, payload: bytes, refers_to: str | None) -> bytes:
    """The bytes of a response or revisit; a revisit keeps the HTTP header, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {http_length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


class _Member:
    """A gzip member that is inflated only as far as it is asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.skip = file, at, None
        self.inflate = zlib.decompressobj(31)
        file.seek(at)
        self.first = file.read(_PIECE)
        if len(self.first) >= 12 and self.first[:3] == b"\x1f\x8b\x08" and self.first[3] & 4:
            size = struct.unpack("<H", self.first[10:12])[0]
            extra = self.first[12 : 12 + size]
            if extra[:4] == b"sl\x08\x00":
                self.skip = struct.unpack("<I", extra[4:8])[0]
        self.out = b""
        self.fed = 0

    def more(self, most: int = 0) -> bool:
        """Inflate another piece; False at the member's end."""
        if self.inflate.eof:
            return False
        if self.inflate.unconsumed_tail:
            self.out += self.inflate.decompress(self.inflate.unconsumed_tail, most)
            return True
        data = self.first if self.fed == 0 else self.file.read(_PIECE)
        if not data:
            raise OSError("the archive ends inside a record")
        self.fed += len(data)
        self.out += self.inflate.decompress(data, most)
        return True

    def until(self, mark: bytes, start: int) -> int:
        """Position after ``mark``, inflating no further than needed."""
        while (found := self.out.find(mark, start)) < 0:
            if not self.more(2048):
                raise OSError("a record has no end of headers")
        return found + len(mark)

    def upto(self, size: int) -> None:
        while len(self.out) < size and self.more():
            pass

    def end(self) -> int:
        """Where the next member begins: by the stored length, else by inflating and dropping the rest."""
        if self.skip:
            return self.at + self.skip
        while not self.inflate.eof:
            self.out = b""
            self.more(1 << 20)
        return self.at + self.fed - len(self.inflate.unused_data)


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_file(system: fs.FileSystem, path: str, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of one archive whose headers satisfy ``wanted``."""
    with system.open_input_file(path) as file:
        at, size = 0, file.size()
        while at < size:
            own = _Member(file, at)
            body = own.until(b"\r\n\r\n", 0)
            head = _headers(own.out[:body])
            values = {k: _bare(head.get(h)) for k, h in HEADERS.items()}
            if wanted(values):
                length = int(head.get("content-length", "0"))
                http_length, start = None, body
                if head.get("content-type", "").startswith("application/http"):
                    start = own.until(b"\r\n\r\n", body)
                    http = _headers(own.out[body:start])
                    http_length = int(http["content-length"]) if "content-length" in http else None
                data = None
                if payload:
                    own.upto(body + length)
                    data = own.out[start : body + length]
                yield (values["record_type"], values["record_id"], values["target_uri"], values["refers_to"], values["payload_digest"], http_length, data)
            at = own.end()


class _Wanted:
    """The pushed predicates, all of which a record must satisfy."""

    def __init__(self, filters: list[Filter]):
        self.filters = filters

    def __call__(self, values: dict[str, str | None]) -> bool:
        for f in self.filters:
            value = values[f.attribute[0]]
            ok = (
                value is not None if isinstance(f, IsNotNull)
                else value == f.value if isinstance(f, EqualTo)
                else value in f.value if isinstance(f, In)
                else value is not None and value.startswith(f.value)
            )
            if not ok:
                return False
        return True


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | IsNotNull | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        out, size = [], self.split_bytes
        for info in sorted((i for i in found if i.is_file and i.path.endswith(".warc.gz")), key=lambda i: i.path):
            if size + info.size > self.split_bytes and size:
                out.append([])
                size = 0
            out[-1].append(info.path)
            size += info.size
        return [_Files(p) for p in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _open(self.path)
        wanted = _Wanted(self.pushed)
        for path in partition.paths:
            yield from read_file(system, path, wanted, self.payload)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Takes rows of SCHEMA; ``http_length`` is the full payload's size, ``payload`` null for a revisit."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        files.append((posixpath.join(folder, f"_pending-{name}"[:-8] + ".part"), posixpath.join(folder, name)))
                        out, size = system.open_output_stream(files[-1][0]), 0
                    data = member(record(row["record_type"], row["record_id"], row["target_uri"], row["payload_digest"], row["http_length"], row["payload"] or b"", row["refers_to"]))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for pending, final in message.files if message else []:
                system.move(pending, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for pending, _ in message.files if message else []:
                system.delete_file(pending)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Rows of SCHEMA for the writer: of equal payloads of at least ``least`` bytes, the largest page_id carries it.

    Payloads stay where they were read: only digests are counted, and the repeated ones come
    back by broadcast if they are few enough. Beyond that the larger payloads are joined by
    shuffle, dealt over ``SALTS`` parts for each digest. Smaller ones never enter a join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"http_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = F.col("http_length") >= least
    # only digests that occur twice or more come into the join; counts are summed before the shuffle
    twice = rows.filter(large).groupBy("payload_digest", "http_length").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = materialize(twice, "repeated-payloads")
    if twice.count() * 100 <= BROADCAST_BYTES:  # a digest of 40 letters and two numbers a row
        linked = rows.join(F.broadcast(twice), ["payload_digest", "http_length"], "left")
    else:
        salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        linked = rows.filter(large).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "http_length", "salt"], "left").drop("salt")
        linked = linked.unionByName(rows.filter(~large).withColumn("keeper", F.lit(None).cast("long")))
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return linked.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("page_id")).alias("record_id"), "target_uri",
        F.when(again, urn(F.col("keeper"))).alias("refers_to"), "payload_digest", "http_length", F.when(~again, F.col("payload")).alias("payload"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    read = spark.read.format("warc")
    # responses are inflated and their payloads measured; of revisits only the headers are
    responses = read.load(folder).filter("record_type = 'response'").select("record_type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    revisits = read.option("payload", "false").load(folder).filter("record_type = 'revisit'").select("record_type", "record_id", "refers_to", F.col("http_length").alias("payload_bytes"), "payload_digest")
    both = responses.unionByName(revisits)
    return both.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


#: The same rows from the pages alone.
OP9_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
q as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as payload_digest from p),
k as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as keeper from q)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id <> keeper then keeper end as refers_to
from k
"""
