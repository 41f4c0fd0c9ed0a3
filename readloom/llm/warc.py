"""WARC archives written and read as streams: payloads travel in chunks, never as whole records.

A page becomes a record. Of pages with equal payloads (SHA-1, at least ``least`` bytes) the one with the least page_id
is written as a response, the others as revisits that refer to it and hold no payload. Each task writes one archive of
gzip members, one a record, to a folder all executors share, and reports the file it closed. A task that dies leaves a
file that nobody lists; its next attempt writes another.

Reading gives a chunk table: (archive, record number, chunk number, bytes, digest so far). A chunk holds at most ``CHUNK``
bytes; its digest is that of the payload up to its end, so the last chunk of a record carries the whole digest and no
step ever joins chunks. The reader holds one chunk and one header.

The writer gets chunk rows as well: payloads are cut in the JVM, in the task that writes them and without a shuffle, and
a chunk is the largest cell that a worker receives. Everything else about a page (size, digest, role) is known from
columns before its first byte is written.

Nulls: a null html is an empty payload; a null url is written without target; a null page_id is a page of its own
whose record can't be referred to (it is a response only where no other page has its payload, or of nulls alone).
Rows with the same id and payload share their role. An empty table gives no archive; other columns are ignored. Files go through the file systems that pyarrow knows by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import materialize, small_batches

CHUNK = 1 << 16
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_ENTRY = "archive string, records long"
_CHUNKS = (
    "archive string, record long, page_id string, record_type string, refers_to string, stated_bytes long, "
    "stated_digest string, chunk int, last boolean, bytes_so_far long, digest_so_far string, data binary"
)


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex, 160 bits being 32 digits of five."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = []
    for i in range(0, 40, 5):  # five hex digits are four of base 32
        five = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substring(alphabet, F.shiftright(five, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*digits)


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html of each page, with bytes, digest and first (the id its revisit refers to, else null).

    Digests are grouped as small rows; only groups of two or more come back to the pages, by id and digest.
    """
    html = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))}
    )
    small = materialize(known.select("page_id", "bytes", "digest").filter(F.col("bytes") >= least), "page-digests")
    groups = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    revisits = (
        small.join(groups, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("at_id"), F.col("digest").alias("at_digest"), "first")
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("at_id")) & (F.col("digest") == F.col("at_digest"))
    return known.join(revisits, same, "left").drop("at_id", "at_digest")


def _open(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _head(page_id, url, size: int, digest: str, first) -> bytes:
    """Headers of a record and of its HTTP response."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first)}", f"X-Refers-To-Page: {first}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def chunk_rows(known: DataFrame, size: int = CHUNK) -> DataFrame:
    """page_id, url, bytes, digest, first, chunk, last, data: the payload of each page in rows of ``size`` bytes at most.

    A page's rows follow each other, in order; a revisit and an empty payload have one row without bytes. The cuts are
    made on bytes in the JVM, so each costs its own length only.
    """
    html = F.when(F.col("first").isNull(), F.col("html")).otherwise(F.lit("")).cast("binary")
    ready = known.select(
        F.col("page_id").cast("string"), "url", "bytes", base32_of_hex(F.col("digest")).alias("digest"),
        F.col("first").cast("string"), html.alias("payload"),
    )
    parts = F.greatest(F.ceil(F.octet_length("payload") / size).cast("int"), F.lit(1))
    each = ready.withColumn("parts", parts).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select(
        "page_id", "url", "bytes", "digest", "first", "chunk", (F.col("chunk") == F.col("parts") - 1).alias("last"),
        F.substring("payload", F.col("chunk") * size + 1, size).alias("data"),
    )


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of all pages (page_id, url, html) under ``folder``; the list of files written: archive, records."""
    small_batches(pages.sparkSession)

    def write_part(batches):
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name, n, out, packer = f"{uuid.uuid4().hex}.warc.gz", 0, None, None
        for b in batches:
            if out is None:
                out = system.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)
            for row in zip(b.page_id, b.url, b.bytes, b.digest, b["first"], b.chunk, b["last"], b.data, strict=True):
                page_id, url, size, digest, first, chunk, last, data = row
                if chunk == 0:  # one gzip member a record
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(page_id, url, int(size), digest, first)))
                out.write(packer.compress(data))
                if last:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [f"{folder.rstrip('/')}/{name}"], "records": [n]})

    # written once; its rows name the files of the attempts that succeeded
    return materialize(chunk_rows(roles(pages, least)).mapInPandas(write_part, _ENTRY), "archives")


class _Stream:
    """The inflated bytes of an archive, a bounded part at a time."""

    def __init__(self, file):
        self.file, self.held, self.unpacker, self.packed = file, b"", zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Take in another part; false at the end."""
        while True:
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if not self.packed:
                self.packed = self.file.read(CHUNK)
                if not self.packed:
                    return False
            part = self.unpacker.decompress(self.packed, CHUNK)
            self.packed = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if part:
                self.held += part
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the next mark, which is passed; none at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def parts(self, n: int):
        """The next n bytes, in parts of at most CHUNK."""
        while n:
            if not self.held and not self.more():
                raise EOFError("archive ends in a record")
            part, self.held = self.held[: min(n, CHUNK)], self.held[min(n, CHUNK) :]
            n -= len(part)
            yield part


def chunks_of(file, archive: str):
    """Chunk rows of an archive's records, in order; see the columns in ``read_chunks``."""
    stream, record = _Stream(file), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at record {record} of {archive}")
        named = dict(line.decode().split(": ", 1) for line in lines[1:] if b": " in line)
        http = stream.until(b"\r\n\r\n")
        left = int(named["Content-Length"]) - len(http) - 4
        start = (
            archive, record, named.get("X-Page-ID") or None, named["WARC-Type"], named.get("X-Refers-To-Page"),
            int(named["X-Payload-Length"]), named["WARC-Payload-Digest"].removeprefix("sha1:"),
        )
        digest, so_far, chunk = hashlib.sha1(), 0, 0
        if not left:
            yield (*start, 0, True, 0, base64.b32encode(digest.digest()).decode(), b"")
        for part in stream.parts(left):
            digest.update(part)
            so_far += len(part)
            yield (*start, chunk, so_far == left, so_far, base64.b32encode(digest.copy().digest()).decode(), part)
            chunk += 1
        if b"".join(stream.parts(4)) != b"\r\n\r\n":
            raise ValueError(f"record {record} of {archive} doesn't end where it should")
        record += 1


def read_chunks(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk table of the archives listed in ``archives`` (archive): one row a chunk, an empty payload being one chunk.

    Without data the chunks' bytes stay where they are and only their digests are returned.
    """

    def read_part(batches):
        names, rows, held = [c.split()[0] for c in _CHUNKS.split(", ")], [], 0
        for b in batches:
            for archive in b.archive:
                system, path = _open(archive)
                with system.open_input_stream(path, compression=None) as file:
                    for row in chunks_of(file, archive):
                        rows.append(row if with_data else (*row[:-1], None))
                        held += len(row[-1]) if with_data else 0
                        if held > 16 * CHUNK or len(rows) == 4096:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = archives.select("archive")
    # a task for each archive; the list is too small for its bytes to tell the work behind it
    return names.repartition(max(1, names.count())).mapInPandas(read_part, _CHUNKS)


def records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, checked against its payload."""
    last = read_chunks(archives, with_data=False).filter("last")
    response = F.col("record_type") == "response"
    sound = ~response | (
        (F.col("bytes_so_far") == F.col("stated_bytes")) & (F.col("digest_so_far") == F.col("stated_digest"))
    )
    return last.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(sound, F.col("stated_bytes")).otherwise(F.raise_error(F.lit("payload and digest differ"))).alias("payload_bytes"),
        F.col("stated_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
