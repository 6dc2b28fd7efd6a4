"""WARC archives with a Zstandard dictionary: written record by record, and read back.

An archive starts with a skippable frame that holds a dictionary trained on records of the
archive; every record follows as a frame of its own, so one can be read without the
others. Pages with equal payloads are stored once: the one with the largest id is a
``response``, the others are ``revisit`` records that refer to it, carry the HTTP head and
no payload. Payloads shorter than ``min_bytes`` are always stored.

Which payloads repeat is an aggregate over digests; the pages themselves are joined only to
the digests that occur twice. Tasks write archives of about ``ARCHIVE_BYTES`` under names of
their own attempt, and return their names; the list of archives that is read is the one
Spark has committed, so a lost or repeated attempt leaves no record twice.

Defined results: a null page is an empty payload. A null id is a record without a page id
(never the largest). Rows that repeat id and payload are all of the same type. Null URLs
give no target. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..workspace import scratch
from .common import settled

RESPONSE, REVISIT = "response", "revisit"
ARCHIVE_BYTES = 16 << 20  # of records, before compression
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES, SAMPLE_RECORD = 2 << 20, 16 << 10  # records that a dictionary is trained on
LEVEL = 3
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str
) -> bytes:
    """One record; a revisit where ``refers_to`` names a page."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if refers_to is not None else head + payload
    name = f"{_PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid4()}"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on evenly spaced records, an eighth of them in size at most; too few to train
    on are the dictionary themselves."""
    step = max(1, sum(min(len(r), SAMPLE_RECORD) for r in records) // SAMPLE_BYTES)
    samples = [r[:SAMPLE_RECORD] for r in records[::step]]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:
        content = b"".join(samples)[-size:].ljust(8, b"\0")
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes]) -> int:
    """Writes an archive to a file object; returns its bytes."""
    shared = dictionary(records)
    content = shared.as_bytes()
    written = out.write(struct.pack("<II", SKIPPABLE, len(content))) + out.write(content)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    for one in records:
        written += out.write(compressor.compress(one))
    return written


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, from a file object, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    shared = zstandard.ZstdCompressionDict(source.read(size))
    plain = io.BufferedReader(
        zstandard.ZstdDecompressor(dict_data=shared).stream_reader(source, read_across_frames=True), 1 << 16
    )
    while version := plain.readline():
        if version.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {version[:40]!r}")
        fields = {}
        while (line := plain.readline().strip()):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        block = plain.read(int(fields["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, block


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; paths without a scheme are local."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of (page_id, url, html); returns (archive, records, bytes)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    again = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1 AND last IS NOT NULL")
        .select("digest", "last")
    )
    refers_to = F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    records = rows.join(settled(again, "repeated"), "digest", "left").select(
        "page_id", "url", "payload", refers_to.alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path)
        held: list[bytes] = []

        def closed() -> pa.RecordBatch:
            name = f"{uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{path}/{name}", compression=None) as out:
                size = write_archive(out, held)
            made = pa.RecordBatch.from_pydict(
                {"archive": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([size], pa.int64())}
            )
            held.clear()
            return made

        size = 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns):
                held.append(
                    record(
                        page_id.as_py(), url.as_py(), payload.as_py().encode(), refers_to.as_py(), date
                    )
                )
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    size = 0
                    yield closed()
        if held:
            yield closed()

    return settled(records.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads that are stored must have the digest that their record names.
    """
    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )

    def page_of(name: str | None) -> int | None:
        return int(name[len(_PAGE) + 1 : -1]) if name and name.startswith(f"<{_PAGE}") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with files.open_input_file(f"{path}/{name}") as source:
                    for fields, block in read_archive(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == RESPONSE and (len(payload), payload_digest(payload)) != (length, digest):
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what was written")
                        own = page_of(fields["WARC-Record-ID"]), page_of(fields.get("WARC-Refers-To"))
                        rows.append((own[0], length, digest, kind, own[1]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                )

    tasks = max(1, archives.count() // 2)
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(run, schema)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder)
