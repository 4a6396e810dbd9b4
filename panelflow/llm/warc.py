"""WARC archives of pages, written and read as streams of chunk rows.

A page's payload becomes (record, chunk number, chunk) rows of bounded size beside its scan. A
writer task appends the chunks to the open record of its archive, one gzip member per record, and
carries the SHA-1 along; a reader task parses its archives front to back in pieces of bounded
size, digest by digest. Neither holds a payload as a whole, and no payload is shuffled: the first
pass writes every record as a response and returns a narrow row of where it stands.

Of records with equal payloads of at least `least_bytes` that with the largest page id is a
response and the others are revisits that refer to it. The narrow rows are joined with the
repeated digests (very frequent ones by broadcast, see common.joined), and a second pass copies
each archive front to back: members of responses as they are, revisits as new members.

Archives are written to the shared folder through pyarrow's file systems, under names that hold
the task attempt; the rows of the attempts that Spark accepted name the ones to read, so a
repeated task does no harm.

Cases: a null html is an empty payload, a null url no target header; a page id that repeats with
an equal payload is a response each time it has the group's largest id; a null page id is never
a group's largest, refers like any other, and is a response if its group has no id at all; an
empty table gives no archive and no row; other columns aren't looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.common import joined, shared_dir, tasks_for, written

CHUNK_BYTES = 64 << 10
COPY_BYTES = 1 << 20
ARCHIVE_BYTES = 512 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Where a record's member stands in an archive of the first pass.
PLACES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
PLACES_DDL = "page_id long, url string, bytes long, digest string, path string, at long, length long"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def headers(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The record's and the HTTP message's header blocks."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}", "", ""]
    return "\r\n".join(lines).encode() + http


def chunk_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, bytes, digest, chunk_no, chunks, chunk): a record's rows follow each other."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(CHUNK_BYTES))).cast("int")
    rows = rows.withColumn("chunks", chunks).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    return rows.select("page_id", "url", "bytes", "digest", "chunk_no", "chunks", F.substring("payload", F.col("chunk_no") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("chunk"))


def member(head: bytes) -> bytes:
    """A gzip member of a record without a payload."""
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress(head) + out.compress(b"\r\n\r\n") + out.flush()


class Archive:
    """An archive that a task writes: one gzip member per record."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.path, self.out, self.size, self.records = path, files.open_output_stream(path, compression=None), 0, 0

    def begin(self, head: bytes) -> None:
        self.zip, self.digest, self.records = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), self.records + 1
        self.put(self.zip.compress(head))

    def add(self, chunk: bytes) -> None:
        self.digest.update(chunk)
        self.put(self.zip.compress(chunk))

    def end(self) -> str:
        self.put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
        return self.digest.hexdigest()

    def put(self, piece: bytes) -> None:
        self.out.write(piece)
        self.size += len(piece)


def write_responses(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every record of the chunk table as a response: the rows of PLACES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        context, number, archive, done = TaskContext.get(), 0, None, []
        for batch in batches:
            chunk_no, chunks, chunk = batch.column("chunk_no").to_pylist(), batch.column("chunks").to_pylist(), batch.column("chunk")
            for i, no in enumerate(chunk_no):
                if no == 0:
                    page, url, size, digest = (batch.column(c)[i].as_py() for c in ("page_id", "url", "bytes", "digest"))
                    if archive is None or archive.size > archive_bytes:
                        if archive is not None:
                            archive.out.close()
                        archive = Archive(files, f"{base}/spool-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.gz")
                        number += 1
                    began = archive.size
                    archive.begin(headers(page, url, size, digest, None, False, date))
                archive.add(chunk[i].as_py())
                if no == chunks[i] - 1:
                    if archive.end() != digest:
                        raise ValueError(f"page {page}: its chunks' digest isn't the payload's")
                    done.append((page, url, size, digest, archive.path, began, archive.size - began))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(PLACES)], schema=PLACES)
            done = []
        if archive is not None:
            archive.out.close()

    return chunks.mapInArrow(run, PLACES_DDL)


def decided(places: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """places with `first`, the page that a record's payload is stored for, where several have it."""
    groups = places.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1 and first is not null").drop("n"), folder, "groups")
    return joined(places, groups, "digest", folder, "digests").withColumn("first", F.when(F.col("bytes") >= least_bytes, F.col("first")))


def write_archives(places: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(path, records, bytes) of the archives, one for each of the first pass, with the revisits that decided() names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        context, source, out, done = TaskContext.get(), None, None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "bytes", "digest", "path", "at", "length", "first")), strict=True)
            for page, url, size, digest, path, at, length, first in rows:
                if source is None or path != source[0]:
                    if source is not None:
                        source[1].close()
                        out.out.close()
                    source = path, files.open_input_file(path)
                    out = Archive(files, f"{base}/pages-{path.rpartition('/spool-')[2].removesuffix('.warc.gz')}-{context.taskAttemptId()}.warc.gz")
                    done.append(out)
                out.records += 1
                if first is not None and page != first:
                    out.put(member(headers(page, url, size, digest, first, True, date)))
                    continue
                source[1].seek(at)
                while length:
                    piece = source[1].read(min(length, COPY_BYTES))
                    if not piece:
                        raise ValueError("an archive ends within a record")
                    out.put(piece)
                    length -= len(piece)
        if source is not None:
            source[1].close()
            out.out.close()
        yield pa.RecordBatch.from_arrays([pa.array([a.path for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()), pa.array([a.size for a in done], pa.int64())], names=["path", "records", "bytes"])

    rows = places.repartition(tasks_for(places.sparkSession), "path").sortWithinPartitions("path", "at")
    return rows.mapInArrow(run, "path string, records long, bytes long")


def records(stream) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """(page id, payload bytes, payload digest, record type, refers to) of each record, front to back."""
    data = io.BufferedReader(gzip.GzipFile(fileobj=stream), 256 << 10)

    def block() -> dict[str, str]:
        found = {}
        while (line := data.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            found[name.lower()] = value
        return found

    while data.readline():
        head = block()
        data.readline()
        http = block()
        size = int(http["content-length"])
        stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = head["warc-type"]
        if kind == "response":
            digest, left = hashlib.sha1(), size
            while left:
                piece = data.read(min(left, CHUNK_BYTES))
                if not piece:
                    raise ValueError("an archive ends within a record")
                digest.update(piece)
                left -= len(piece)
            if digest.hexdigest() != stated:
                raise ValueError(f"{head['warc-record-id']}: the payload isn't that of its digest")
        data.read(4)
        yield page_of(head["warc-record-id"]), size, stated, kind, page_of(head.get("warc-refers-to"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the manifest's archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                with files.open_input_stream(path, compression=None) as stream:
                    for record in records(stream):
                        held.append(record)
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), READ, strict=True)], schema=READ)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), READ, strict=True)], schema=READ)

    return manifest.select("path").repartition(tasks_for(manifest.sparkSession)).mapInArrow(run, READ_DDL)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """The records of the pages' archives, as read back."""
    folder = shared_dir(pages.sparkSession)
    places = written(write_responses(chunk_table(pages), folder), folder, "places")
    manifest = written(write_archives(decided(places, folder, least_bytes), folder), folder, "manifest")
    return read_archives(manifest, folder)
