"""Operator 1: WARC archives: writing, normalising a monolithic gzip stream, reading by offset.

``write_archives`` puts records into whole-file gzip streams, as careless crawlers do.
``normalise`` inflates each such stream once, rewrites every record as a gzip member of
its own and writes a sidecar offset index beside it.  ``read_records`` fetches records by
that index.  Archives are rolled at ``ROLL_BYTES``, and every step streams: a task holds
one record at most.

Files are written through pyarrow's filesystems into the shared folder, under names that
hold the task attempt; only what a successful attempt reports is read later, so a lost
executor leaves at worst an unused file.

Cases: null or empty html is a record with an empty payload (always a response); null url
is ``urn:page:<id>``; a row without page_id is a response named ``urn:page:None``; equal rows
are records of their own; other columns are not read.  A payload that doesn't match its digest
when it is read back is an error.  The shared folder must be one that pyarrow's filesystems
know (a path, or file, hdfs, s3 or s3a, gs, abfs or abfss).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, saved

#: Bytes of records after which a writer begins the next archive.
ROLL_BYTES = 16 << 20
#: Compressed bytes of records that a task reads back, about.
READ_BYTES = 64 << 20
#: Payloads from this size on are stored once; later equal ones become revisit records.
MIN_REVISIT = 100
CHUNK = 1 << 20
LEVEL = 4
_DATE = "2024-01-01T00:00:00Z"


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.0 record: a response, or a revisit that keeps the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    url = re.sub(r"[\r\n]+", " ", url) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


class Inflated:
    """A gzip stream (of one member or many) read forwards, inflated once, with a bounded buffer."""

    def __init__(self, source):
        self.source, self.buffer, self.inflater, self.rest, self.over = source, bytearray(), zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while not self.over:
            raw = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not raw:
                self.over = True
                break
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            out = self.inflater.decompress(raw, CHUNK)
            self.rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """All up to and with mark; b"" at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return b""
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


class Counted:
    """A sink that knows how far it is."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)


def normalise_stream(source, sink) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Rewrites records as members; gives offset, length and header fields of each."""
    stream, out = Inflated(source), Counted(sink)
    while head := stream.until(b"\r\n\r\n"):
        head = head.lstrip(b"\r\n")
        got, began, pack = fields_of(head), out.at, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out.write(pack.compress(head))
        for part in stream.take(int(got["content-length"])):
            out.write(pack.compress(part))
        for part in stream.take(4):
            out.write(pack.compress(part))
        out.write(pack.flush())
        yield began, out.at - began, got


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to.  Revisits are found by digests alone; payloads are shuffled only if the revisits are too many to be broadcast."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keys = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).where("_last > refers_to").drop("_last")
    again = saved(keys.join(firsts, "digest").where("page_id > refers_to").distinct(), "revisits")
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(records: DataFrame, where: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Monolithic .warc.gz files under where; one row (archive, records, bytes) for each."""
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        files, base = _files(where)
        task, done, sink, n, size = TaskContext.get(), [], None, 0, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                if sink is None:
                    files.create_dir(base)
                    name = f"crawl-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz"
                    sink, pack, n, size = files.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                raw = record(*(x.as_py() for x in row))
                sink.write(pack.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= roll:
                    sink.write(pack.flush())
                    sink.close()
                    done.append((f"{where}/{name}", n, size))
                    sink = None
        if sink is not None:
            sink.write(pack.flush())
            sink.close()
            done.append((f"{where}/{name}", n, size))
        yield _table(done, schema)

    return saved(records.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def normalise(archives: DataFrame, where: str) -> DataFrame:
    """Every archive rewritten under where, one member a record, with a sidecar .cdx; the same index as rows."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string())])

    def run(batches):
        files, base = _files(where)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files.create_dir(base)
                name, rows = f"{archive.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}.warc.gz", []
                with files.open_input_stream(_files(archive)[1], compression=None) as source, files.open_output_stream(f"{base}/{name}", compression=None) as sink:
                    with files.open_output_stream(f"{base}/{name}.cdx", compression=None) as index:
                        for offset, length, got in normalise_stream(source, sink):
                            rows.append((f"{where}/{name}", offset, length, got["warc-record-id"], got["warc-type"], got["warc-target-uri"]))
                            index.write("\t".join(map(str, rows[-1][1:])).encode() + b"\n")
                            if len(rows) == 4096:
                                yield _table(rows, schema)
                                rows = []
                yield _table(rows, schema)

    many = max(1, archives.count())
    return saved(archives.select("archive").repartition(min(many, 100_000), "archive").mapInArrow(run, "archive string, offset long, length long, record_id string, type string, uri string"), "cdx")


def read_records(index: DataFrame) -> DataFrame:
    """Each record by its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, whole (its payload matches its digest)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("whole", pa.bool_())])
    number = re.compile(r"urn:page:(-?\d+)")

    def run(batches):
        at, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != at:
                    files, path = _files(archive)
                    at, source = archive, files.open_input_file(path)
                raw = zlib.decompress(source.read_at(length, offset), 31)
                head, _, block = raw.partition(b"\r\n\r\n")
                got = fields_of(head)
                http, _, payload = block[: int(got["content-length"])].partition(b"\r\n\r\n")
                kind, refers, digest = got["warc-type"], got.get("warc-refers-to"), got["warc-payload-digest"].partition(":")[2]
                size = int(fields_of(http)["content-length"])
                whole = kind == "revisit" or (len(payload) == size and hashlib.sha256(payload).hexdigest() == digest)
                if not whole:
                    raise ValueError(f"{archive}, offset {offset}: the payload isn't what its digest says")
                page = number.search(got["warc-record-id"])
                rows.append((int(page[1]) if page else None, size, digest, kind, int(number.search(refers)[1]) if refers else None, whole))
            yield _table(rows, schema)

    size = index.agg(F.sum("length")).first()[0] or 0
    many = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    read = index.select("archive", "offset", "length").repartition(many, "archive", F.shiftright("offset", 22)).sortWithinPartitions("archive", "offset")
    return read.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """pages written to WARC, normalised, and read back by offset."""
    spark = pages.sparkSession
    bounded_batches(spark)
    archives = write_archives(with_revisits(pages), new_path(spark, "warc-raw"))
    return read_records(normalise(archives, new_path(spark, "warc")))
