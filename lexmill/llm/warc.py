"""WARC archives: a record-per-member writer and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import cut, hint_if_small, new_table, shuffle_partitions

#: An archive is closed beyond so many compressed bytes; a piece of it is closed behind the record that fills PIECE bytes.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 20
#: Longest head of a record that the reader takes.
HEAD_LIMIT = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_BREAKS = re.compile(r"[\r\n]+")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """One WARC record: head fields by lower-case name, and its block."""

    head: dict[str, str]
    block: bytes


def write_record(head: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member; line breaks in a field's value, which would end it, become blanks."""
    lines = "".join(f"{k}: {_BREAKS.sub(' ', str(v))}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


class WarcReader:
    """Read records one after the other from pieces of a compressed archive.

    A member is inflated piece by piece; the head ends at the first empty line,
    the block has exactly the bytes that Content-Length names, and a record's
    block and payload digests are held against what was read.  Memory is bounded
    by one record.  Truncated, overlong or damaged records raise ValueError.
    """

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.pieces = iter(pieces)
        self.rest = b""

    def _member(self) -> Iterator[bytes]:
        """The inflated parts of the next gzip member; nothing at the end of the archive."""
        unpack, begun = zlib.decompressobj(31), False
        while not unpack.eof:
            if not self.rest:
                self.rest = next(self.pieces, b"")
                if not self.rest:
                    if begun:
                        raise ValueError("the archive ends within a member")
                    return
                continue
            begun = True
            try:
                part = unpack.decompress(self.rest, PIECE)
            except zlib.error as e:
                raise ValueError(f"damaged member: {e}") from e
            self.rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if part:
                yield part

    def __iter__(self) -> Iterator[Record]:
        while True:
            parts, buffer = self._member(), bytearray()
            while (end := buffer.find(b"\r\n\r\n")) < 0:
                part = next(parts, None)
                if part is None:
                    if buffer:
                        raise ValueError("a record's head does not end")
                    return
                buffer += part
                if len(buffer) > HEAD_LIMIT + PIECE and buffer.find(b"\r\n\r\n") < 0:
                    raise ValueError("a record's head is too long")
            version, *lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = {k.strip().lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines)}
            length = int(head.get("content-length", "-1"))
            if length < 0:
                raise ValueError("a record without Content-Length")
            del buffer[: end + 4]
            for part in parts:
                buffer += part
                if len(buffer) > length + 4:
                    raise ValueError("a record is longer than its Content-Length")
            if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
                raise ValueError("a record's block does not have its Content-Length")
            block = bytes(buffer[:length])
            for name, data in (("warc-block-digest", block), ("warc-payload-digest", _payload(head, block))):
                want = head.get(name, "").strip().removeprefix("sha1:")
                if want and data is not None and want != payload_digest(data):
                    raise ValueError(f"{name} does not hold")
            yield Record(head, block)


def _payload(head: dict[str, str], block: bytes) -> bytes | None:
    """The payload that a record holds itself; None for a revisit."""
    if head.get("warc-type") == "revisit":
        return None
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _to_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, refers_to, is_revisit) to pieces of archives, one or more archives for each task."""
    name, piece, buffer, size = uuid.uuid4().hex, 0, bytearray(), 0
    for batch in batches:
        for page, url, html, refers, revisit in zip(*(batch.column(i) for i in range(5))):
            buffer += _page_record(page.as_py(), url.as_py(), html.as_py(), refers.as_py(), revisit.as_py())
            if len(buffer) >= PIECE:
                yield _piece(name, piece, buffer)
                size, piece, buffer = size + len(buffer), piece + 1, bytearray()
            if size >= ARCHIVE_BYTES:
                name, piece, size = uuid.uuid4().hex, 0, 0
    if buffer:
        yield _piece(name, piece, buffer)


def _piece(name: str, number: int, data: bytearray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"archive": [name], "piece": pa.array([number], pa.int64()), "data": pa.array([bytes(data)], pa.binary())})


def _page_record(page: int | None, url: str | None, html: str | None, refers: int | None, revisit: bool) -> bytes:
    """The record of one page: the whole response, or a revisit that names the response and its payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    name = lambda of: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{of}')}>"
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers)), ("X-Refers-To-Page", str(refers))]
    return write_record(head, block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record for each row of ``pages`` to archives under ``path``.

    The payload is ``html`` in UTF-8 (null: empty).  Among records whose payloads
    are equal and at least ``min_bytes`` long, that with the smallest ``page_id``
    is a response and the others revisit it; rows equal in page_id as well are
    told apart, one of them is the response.  A row without page_id is a revisit
    if another row has the payload and an id, otherwise a response.

    An archive is a sequence of gzip members.  As executors share no file system
    but Spark's, its bytes are stored in numbered pieces in a table; ``pieces``
    in order are a ``.warc.gz`` file (see ``export_archive``).  A piece ends with
    a record, so that pieces can be read in any task.  Very long pages are records
    of their own size; an empty table writes no piece; other columns of ``pages``
    are not read.  Hot payloads are grouped by
    digest with pre-aggregation; no group meets in one task.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.when(F.octet_length(html) >= min_bytes, F.sha1(html)))
    narrow = cut(rows.where("digest is not null").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")))
    named = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("n"))
    first = narrow.groupBy("digest").agg(F.min(named).alias("first"), F.sum("n").alias("copies")).where("copies > 1 and first.page_id is not null")
    first = cut(first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.n").alias("first_n")))
    keyed = rows.join(hint_if_small(first, 128), "digest", "left")
    leads = F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    out = lambda df, revisit: df.select("page_id", "url", "html", F.col("first_id").alias("refers_to"), revisit.alias("revisit"))
    if first.where("first_n > 1").limit(1).count():  # pages that repeat their id and payload: one row of each is the response
        twice = leads & (F.col("first_n") > 1)
        nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        marked = out(keyed.where(~twice), F.col("first_id").isNotNull() & ~leads).unionByName(out(keyed.where(twice).withColumn("nth", nth), F.col("nth") > 1))
    else:
        marked = out(keyed, F.col("first_id").isNotNull() & ~leads)
    marked.mapInArrow(_to_archives, "archive string, piece long, data binary").write.option("compression", "none").parquet(path)


RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(record: Record, with_payload: bool) -> dict:
    head, data = record.head, _payload(record.head, record.block)
    whole = lambda k: int(head[k]) if head.get(k) else None
    return {
        "page_id": whole("x-page-id"),
        "url": head.get("warc-target-uri"),
        "payload_bytes": len(data) if data is not None else whole("x-payload-length"),
        "payload_digest": payload_digest(data) if data is not None else head.get("warc-payload-digest", "").removeprefix("sha1:"),
        "record_type": head.get("warc-type"),
        "refers_to": whole("x-refers-to-page"),
        "payload": data if with_payload else None,
    }


def _packed(records: Iterable[Record], with_payload: bool) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in records:
        rows.append(_row(record, with_payload))
        size += 200 + len(record.block) * with_payload
        if size > 8 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Read archives back, each piece sequentially: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit holds no payload; its size and digest are those of the full payload,
    as its head gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0):
                yield from _packed(WarcReader(_slices(piece)), with_payload)

    stored = spark.read.schema("archive string, piece long, data binary").parquet(path)
    return stored.select("data").mapInArrow(run, RECORD_SCHEMA)


def _slices(data: pa.BinaryScalar, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a value, some at a time."""
    view = memoryview(data.as_buffer())
    return (bytes(view[i : i + step]) for i in range(0, len(view), step))


def read_warc_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Read ``.warc.gz`` files: page_id and the other columns of ``read_archives``.

    Spark lists the files; each is read as a stream in its task, some bytes at a
    time, whatever its size.  Stores that Arrow does not know are read by Spark, a
    file at a time, which then takes files below 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inner = pa.fs.FileSystem.from_uri(_arrow_uri(name))
                with store.open_input_stream(inner, compression=None) as stream:
                    yield from _packed(WarcReader(iter(lambda: stream.read(1 << 16), b"")), with_payload)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _packed(WarcReader(_slices(content)), with_payload)

    files = spark.read.format("binaryFile").load(path)
    names = cut(files.select("path"))  # the contents are not read
    first = names.first()
    if first is None or first[0].partition(":")[0] in ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss"):
        return names.repartition(shuffle_partitions(spark)).mapInArrow(run, RECORD_SCHEMA)
    return files.select("content").mapInArrow(run_whole, RECORD_SCHEMA)


def _arrow_uri(name: str) -> str:
    """A file's name as Arrow takes it: Spark writes file:/x and s3a://, and leaves names unquoted."""
    if name.startswith("file:"):
        return "file://" + quote("/" + name.removeprefix("file:").lstrip("/"))
    return name.replace("s3a://", "s3://", 1)


def export_archive(spark: SparkSession, path: str, archive: str) -> Iterator[bytes]:
    """The pieces of one archive, in order, as the bytes of a ``.warc.gz`` file."""
    rows = spark.read.parquet(path).where(F.col("archive") == archive).orderBy("piece").select("data")
    return (bytes(r[0]) for r in rows.toLocalIterator())


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read their heads back."""
    path = new_table(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path).drop("payload", "url")
