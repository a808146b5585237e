"""WARC archives: write, normalise monolithic gzip, read back.

`write_archives` writes each task's records as one whole-file gzip stream. `normalise` inflates such a
stream once, rewrites every record as a gzip member of its own and writes a sidecar index of offsets
(one JSON line a record). `read_records` seeks to indexed members. Files are written under names that
no other attempt uses and are known only through the manifest rows an attempt returns, so a task that
runs again after a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, map_arrow, new_folder, settle

READ = 1 << 20
#: A fixed date: archives of equal input are equal.
DATE = "2020-01-01T00:00:00Z"
#: Repeated payloads that are looked up by broadcast: 28 bytes each.
BROADCAST_ROWS = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response's page."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(read: Callable[[], bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and whole bytes of each record of an inflated stream; read() gives b"" at its end.

    Holds one record and one read at a time. A stream that ends inside a record raises ValueError.
    """
    have, ended = bytearray(), False

    def more() -> None:
        nonlocal ended
        got = read()
        ended = not got
        have.extend(got)

    while True:
        while have[:2] == b"\r\n":
            del have[:2]
        head = have.find(b"\r\n\r\n")
        while head < 0 and not ended:
            more()
            head = have.find(b"\r\n\r\n")
        if head < 0:
            if have.strip():
                raise ValueError("the archive ends inside a record's header")
            return
        first, *lines = bytes(have[:head]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = head + 4 + int(headers["content-length"]) + 4
        while len(have) < size and not ended:
            more()
        if len(have) < size:
            raise ValueError("the archive ends inside a record")
        yield headers, bytes(have[:size])
        del have[:size]


def _inflate(source) -> Callable[[], bytes]:
    """Reads of an inflated gzip file of one or more members."""
    unpack = zlib.decompressobj(31)

    def read() -> bytes:
        nonlocal unpack
        while True:
            if unpack.eof:
                rest, unpack = unpack.unused_data, zlib.decompressobj(31)
            else:
                rest = unpack.unconsumed_tail
            data = rest or source.read(READ)
            if not data:
                return b""
            if got := unpack.decompress(data, READ):
                return got

    return read


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder.removeprefix('file:')}"
    return pafs.FileSystem.from_uri(folder)


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, first): the smallest page_id of each payload of at least least_bytes that has one."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("n"))
    return rows.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """(path, records): one monolithic .warc.gz for each task that has rows.

    pages (page_id, url, html): a null html is an empty payload, a null url about:blank. Of records with
    equal payloads of at least `least_bytes` that with the smallest page_id is a response and the others
    revisit it. A page whose id is null revisits a page with an id, and is a response if there is none.
    Rows repeated with one page_id and payload are responses if that id is the smallest.
    """
    firsts = settle(first_pages(pages, least_bytes))
    html = F.col("html").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(F.coalesce(html, F.lit("")))).alias("digest"))
    # payloads that occur once, nearly all, stay where they are read: only those that repeat are looked up, by broadcast while
    # that is a bounded size, else by a shuffle of the payloads, whose very frequent ones adaptive execution splits
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None).cast("long")).otherwise(F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sink, pack, path = 0, None, zlib.compressobj(6, zlib.DEFLATED, 31), ""
        for batch in batches:
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    files, root = _files(folder)
                    files.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink = files.open_output_stream(path, compression=None)
                sink.write(pack.compress(record(page_id, url, (text or "").encode(), refers_to)))
                n += 1
        if sink is not None:
            sink.write(pack.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return settle(map_arrow(marked, run, "path string, records long"))


def normalise_file(files: pafs.FileSystem, path: str, level: int = 6) -> tuple[str, str, int]:
    """Rewrites one gzip archive with a member a record, and its index; their paths and the number of records."""
    to = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:12]}.members"
    offset = n = 0
    with files.open_input_stream(path, compression=None) as source, files.open_output_stream(f"{to}.warc.gz", compression=None) as sink, files.open_output_stream(f"{to}.index.jsonl", compression=None) as index:
        for headers, whole in split_records(_inflate(source)):
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = pack.compress(whole) + pack.flush()
            sink.write(member)
            index.write(json.dumps({"record": headers.get("warc-record-id"), "type": headers.get("warc-type"), "url": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest"), "offset": offset, "length": len(member)}).encode() + b"\n")
            offset += len(member)
            n += 1
    return f"{to}.warc.gz", f"{to}.index.jsonl", n


def _each(archives: DataFrame) -> DataFrame:
    """A partition for each archive: a row is a whole file's work, however small the row."""
    return archives.repartition(max(1, archives.count()))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index, records) of the rewritten archives. Each archive is one task's work, read once as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                done = normalise_file(files, path)
                yield pa.RecordBatch.from_arrays([pa.array([done[0]]), pa.array([done[1]]), pa.array([done[2]], pa.int64())], ["path", "index", "records"])

    return settle(_each(archives).mapInArrow(run, "path string, index string, records long"))


def read_members(files: pafs.FileSystem, path: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, read by the index's offsets."""
    with files.open_input_file(path) as source, files.open_input_stream(index, compression=None) as lines:
        for line in io.TextIOWrapper(io.BufferedReader(lines), "utf-8"):
            at = json.loads(line)
            source.seek(at["offset"])
            whole = zlib.decompress(source.read(at["length"]), 31)
            headers, raw = next(split_records(iter((whole, b"")).__next__))
            head = raw.find(b"\r\n\r\n") + 4
            yield headers, raw[head : head + int(headers["content-length"])]


def read_records(members: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every indexed record.

    A response's payload is checked against its digest; a revisit has a null payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _files(folder)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for headers, block in read_members(files, path, index):
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    payload = block[block.find(b"\r\n\r\n") + 4 :] if headers["warc-type"] == "response" else None
                    if payload is not None and base32_sha1(payload) != digest:
                        raise ValueError(f"{path}: payload of {headers['warc-record-id']} doesn't have its digest")
                    number = lambda name, h=headers: int(h[name]) if name in h else None
                    rows.append((number("page-id"), headers["warc-target-uri"], headers["warc-type"], number("page-payload-length") if payload is None else len(payload), digest, number("refers-to-page-id"), payload if payloads else None))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _each(members).select("path", "index").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Writes pages as monolithic archives, normalises them and reads every record back. Empty tables give an empty result."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    archives = write_archives(pages, folder, least_bytes)
    free_shuffles(pages.sparkSession)  # the pages' shuffle is as large as both kinds of archive
    return read_records(normalise(archives, folder), folder, payloads)
