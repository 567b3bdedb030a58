"""WARC archives: writing, normalising whole-file gzip to a member per record, reading by offset.

A crawler that gzips a whole file as one stream leaves an archive that can
only be read from its start. The normaliser inflates such a stream once, in
bounded pieces, writes every record as a gzip member of its own and beside the
file an index of offsets, lengths, types and ids; from then on a record costs
one seek.

Files go to the shared folder. A task names its files by a fresh id and only
the names that a finished task returns count, so a repeated task leaves at
most files that nobody reads. File lists are written tables, never recomputed.

Payloads are html in UTF-8; null is empty. Of equal payloads of at least
``least`` bytes the greatest page id has the response (a null id is least);
all rows with that id are responses. Smaller payloads are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import fields_of
from millrace.session import new_path, settle

FILE_BYTES = 32 << 20  # of records in a file before gzip
PIECE = 1 << 20
LEVEL = 1
LEAST = 1000
FILES = "path string, records long"
INDEX = "path string, record_id string, record_type string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload and refers_to: the page whose response a revisit names, null for responses.

    Only digests that occur more than once are joined back; pages of a very common payload
    meet in partial maxima and a join that may be split.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    groups = rows.filter(F.col("same").isNotNull()).groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("last").isNotNull()).select("same", "last")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(groups, "same", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {salt}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit holds the payload's digest and length but not the payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    address = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        *([] if url is None else [f"X-Url: {json.dumps(url)}"]),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(path: str):
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


class Gzip:
    """A gzip stream that is written piece by piece."""

    def __init__(self) -> None:
        self.made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def add(self, data: bytes) -> bytes:
        return self.made.compress(data)

    def end(self) -> bytes:
        return self.made.flush()


def _write(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out = stream = path = None
        size = records = 0
        done = []

        def close() -> None:
            out.write(stream.end())
            out.close()
            done.append((path, records))

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                page, url, payload, refers = (x.as_py() for x in row)
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, stream = store.open_output_stream(_open(path)[1], compression=None), Gzip()
                    size = records = 0
                data = record(page, url, payload, refers)
                out.write(stream.add(data))
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*done)) or [[], []], fields_of(FILES))], schema=fields_of(FILES))

    return write


def write_archives(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Whole-file gzip archives of the records (page_id, url, payload, refers_to): path, records."""
    folder = new_path(records.sparkSession, "warc-whole")
    return settle(records.select("page_id", "url", "payload", "refers_to").mapInArrow(_write(folder, file_bytes), FILES), "warc-files")


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or several members, in pieces."""
    made = zlib.decompressobj(31)
    while data := source.read(PIECE):
        while data:
            out = made.decompress(data, PIECE)
            if out:
                yield out
            if made.eof:
                data, made = made.unused_data, zlib.decompressobj(31)
            else:
                data = made.unconsumed_tail
    if rest := made.flush():
        yield rest


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and all bytes of each record of a stream; only one record and a piece are held."""
    held = bytearray()
    at = 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends inside a record")
                return
        headers = parse_headers(bytes(held[at:end]))
        size = end + 4 - at + int(headers["content-length"]) + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield headers, bytes(held[at : at + size])
        at += size


def parse_headers(data: bytes) -> dict[str, str]:
    first, *lines = data.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _normalise(folder: str):
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                source, place = _open(path)
                with source.open_input_stream(place, compression=None) as old, store.open_output_stream(_open(name)[1], compression=None) as new:
                    for headers, data in split_records(inflated(old)):
                        member = Gzip()
                        packed = member.add(data) + member.end()
                        new.write(packed)
                        rows.append((name, headers["warc-record-id"], headers["warc-type"], offset, len(packed)))
                        offset += len(packed)
                with store.open_output_stream(_open(name)[1] + ".idx", compression=None) as index:
                    for _, i, kind, start, n in rows:
                        index.write(json.dumps({"id": i, "type": kind, "offset": start, "length": n}).encode() + b"\n")
                schema = fields_of(FILES)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)])], schema=schema)

    return normalise


def normalise_archives(files: DataFrame) -> DataFrame:
    """Rewrite archives record by record, each with a sidecar index (``.idx``): path, records."""
    spark = files.sparkSession
    folder = new_path(spark, "warc-members")
    tasks = max(1, min(files.count(), 10_000))
    return settle(files.select("path").repartition(tasks).mapInArrow(_normalise(folder), FILES), "warc-normalised")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = fields_of(RECORDS)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, place = _open(path)
            with store.open_input_stream(place + ".idx", compression=None) as index:
                entries = [json.loads(line) for line in index.read().decode().splitlines()]
            rows, size = [], 0
            with store.open_input_file(place) as archive:
                for entry in entries:
                    data = zlib.decompress(archive.read_at(entry["length"], entry["offset"]), 31)
                    rows.append(_fields(data))
                    size += len(data)
                    if size > 8 * PIECE:
                        yield _batch(rows, schema)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _fields(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    block = block[: int(headers["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    page, url, refers = (headers.get(k) for k in ("x-page-id", "x-url", "x-refers-to-page"))
    if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {headers['warc-record-id']} is not what its digest says")
    return (
        page and int(page), url and json.loads(url), headers["warc-type"], int(headers["x-payload-length"]), digest,
        refers and int(refers), payload if headers["warc-type"] == "response" else None,
    )


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of normalised archives, member by member through the index."""
    tasks = max(1, min(files.count(), 10_000))
    return files.select("path").repartition(tasks).mapInArrow(_read, RECORDS)
