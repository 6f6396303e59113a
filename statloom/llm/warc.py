"""WARC archives written and read back as tables of chunks."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import fresh_path, materialize

#: Bytes of a payload that a task holds at once, and of a row of the chunk table at most.
CHUNK_BYTES = 1 << 20
#: Compressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20

MANIFEST = "archive string, records bigint, bytes bigint"
CHUNKS = "record_id string, page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, chunk_no bigint, chunk_bytes bigint, read_bytes bigint, digest_so_far string, is_last boolean, chunk binary"


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1 (hex) and refers_to: the page that a repeated payload revisits, else null.

    Of the pages with equal payloads of at least `least_bytes` bytes, that with the smallest page_id
    (a null id counts as the largest) is the response and the others refer to it. Only ids and digests
    are grouped; the pages meet their references by id and digest, so that copies of one payload
    spread over all tasks.
    """
    data = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    ids = data.select("page_id", "sha1", F.octet_length("html").alias("size")).where(F.col("size") >= least_bytes)
    first = ids.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
    later = ids.join(first, "sha1").where("not page_id <=> refers_to").select("page_id", "sha1", "refers_to").distinct()
    return data.alias("p").join(later.alias("l"), F.expr("p.page_id <=> l.page_id and p.sha1 = l.sha1"), "left").select("p.*", "l.refers_to")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of `with_references` and returns the manifest (archive, records, bytes).

    Every record is a gzip member of its own, with its payload compressed a piece at a time. Archives
    get names nobody else has, and only those of tasks that ended well are in the manifest, so that a
    task may run again after an executor is lost. Revisits hold the headers only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        system.create_dir(top, recursive=True)
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(posixpath.join(top, name), compression=None)
                for piece in _record(*(x.as_py() for x in row)):
                    out.write(piece)
                    size += len(piece)
                records += 1
                if size >= archive_bytes:
                    out.close()
                    yield _manifest(folder, name, records, size)
                    out = None
        if out is not None:
            out.close()
            yield _manifest(folder, name, records, size)

    return materialize(pages.mapInArrow(run, MANIFEST), "archives")


def _manifest(folder: str, name: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])


def _urn(page_id: int | None) -> str:
    return "" if page_id is None else f"<urn:page:{page_id}>"


def base32_digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record(page_id: int | None, url: str, html: str, sha1: str, refers_to: int | None) -> Iterator[bytes]:
    """A record as pieces of one gzip member."""
    payload = html.encode("utf-8", "surrogatepass")
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha1}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(url.split())}", f"WARC-Payload-Digest: sha1:{base32_digest(sha1)}", f"WARC-Page-ID: {_urn(page_id)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (len(payload) if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    yield packer.compress(("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + http)
    if refers_to is None:
        whole = memoryview(payload)
        for at in range(0, len(payload), CHUNK_BYTES):
            yield packer.compress(whole[at : at + CHUNK_BYTES])
    yield packer.compress(b"\r\n\r\n") + packer.flush()


class _Inflated:
    """Reads a file of gzip members as one stream, a bounded piece at a time."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.packed, self.held, self.inflate = file, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflate.eof:
            self.packed, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        if not self.packed:
            self.packed = self.file.read(CHUNK_BYTES)
            if not self.packed:
                return False
        self.held += self.inflate.decompress(self.packed, CHUNK_BYTES)
        self.packed = b"" if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to and with the mark; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        found, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("an archive ends inside a payload")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            if piece:
                yield piece


def _headers(block: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def _page(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def read_chunks(manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archives of a manifest as rows of (record, chunk number).

    A payload is read as chunks of at most `chunk_bytes`; each row carries the bytes and the digest of
    the payload so far, and is_last marks the end, so that no task holds a whole payload. An empty
    payload and a revisit are one row of no bytes. The digest of a revisit is the one its header names.
    A payload whose digest differs from its header raises ValueError. `with_data` keeps the chunks
    themselves.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                system, path = pyarrow.fs.FileSystem.from_uri(archive) if "://" in archive or archive.startswith("file:") else (pyarrow.fs.LocalFileSystem(), archive)
                with system.open_input_stream(path, compression=None) as file:
                    rows, held = [], 0
                    for row in _chunks(_Inflated(file), chunk_bytes):
                        rows.append(row if with_data else (*row[:-1], None))
                        held += row[7] if with_data else 0
                        if len(rows) >= 2000 or held >= 8 * CHUNK_BYTES:
                            yield _chunk_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _chunk_batch(rows)

    # A given number of partitions is not coalesced, however little a list of names weighs.
    return manifest.select("archive").repartition(max(1, manifest.count()), "archive").mapInArrow(run, CHUNKS)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _chunks(stream: _Inflated, chunk_bytes: int) -> Iterator[tuple]:
    while (block := stream.until(b"\r\n\r\n")) is not None:
        record = _headers(block.lstrip(b"\r\n"))
        http_block = stream.until(b"\r\n\r\n") or b""
        body = int(record["content-length"]) - len(http_block)
        size = int(_headers(http_block)["content-length"])
        kind, named = record["warc-type"], record["warc-payload-digest"].removeprefix("sha1:")
        start = (record["warc-record-id"], _page(record["warc-page-id"]), kind, _page(record.get("warc-refers-to")), named, size)
        digest, read, number, held = hashlib.sha1(), 0, 0, b""
        for piece in stream.pieces(body):
            held += piece
            while len(held) > chunk_bytes:
                chunk, held = held[:chunk_bytes], held[chunk_bytes:]
                digest.update(chunk)
                read += len(chunk)
                yield (*start, number, len(chunk), read, base64.b32encode(digest.digest()).decode(), False, chunk)
                number += 1
        digest.update(held)
        read += len(held)
        found = base64.b32encode(digest.digest()).decode() if kind == "response" else named
        if kind == "response" and (found, read) != (named, size):
            raise ValueError(f"payload of {record['warc-record-id']} is not what its header names")
        yield (*start, number, len(held), read, found, True, held)
        if b"".join(stream.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from archives.

    A null html is an empty payload and a null url an empty one; repeated rows of one id and payload
    are responses alike if the id is the smallest of the payload; a null page_id stays null. Texts of
    any length are whole. An empty table writes no archive. Other columns are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(with_references(pages, least_bytes), folder)
    return read_chunks(manifest, with_data=False).where("is_last").select(
        "page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )
