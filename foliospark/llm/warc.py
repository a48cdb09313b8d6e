"""WARC archives in Zstandard frames with an embedded dictionary (operator 3).

An archive starts with a skippable frame (magic 0x184D2A5D) whose payload is the
dictionary, itself a Zstandard frame or raw; then each record is one frame
compressed with it. The reader loads the dictionary from that frame, decodes one
frame per record, and checks header syntax, the required fields, Content-Length
against the frame's end, and block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
#: A dictionary is trained on at most this many records and bytes of the archive's head.
DICTIONARY_RECORDS, DICTIONARY_SAMPLE = 200, 4 << 20
LEVEL = 3
#: A writer starts another archive beyond this size.
ARCHIVE_BYTES = 64 << 20


class WarcError(ValueError):
    """A damaged archive or a record that breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and body of the HTTP response in the block."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"HTTP/"):
            raise WarcError("the block is not an HTTP response")
        return _fields(head.split(b"\r\n")[1:]), body


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        out[name.decode("ascii")] = value.strip().decode("utf-8")
    return out


def digest_label(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Record:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError("not a WARC/1.1 record")
    headers = _fields(lines[1:])
    if missing := [k for k in REQUIRED if k not in headers]:
        raise WarcError(f"missing {missing}")
    size = headers["Content-Length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size} does not end the record")
    block = rest[:-4]
    if headers.get("WARC-Block-Digest", digest_label(block)) != digest_label(block):
        raise WarcError("block digest differs")
    return Record(headers, block)


def train(samples: list[bytes]) -> bytes:
    """A dictionary for the records to come, empty if there is too little to learn."""
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    def __init__(self, sink, dictionary: bytes):
        self.sink = sink
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
        self.bytes = sink.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True, write_checksum=True)

    def add(self, record: bytes) -> None:
        frame = self.zstd.compress(record)
        self.sink.write(frame)
        self.bytes = (self.bytes or 0) + len(frame)


def read_archive(source) -> Iterator[Record]:
    """Stream the records of an open archive, one frame each."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise WarcError("the archive must start with a dictionary frame")
    packed = source.read(size)
    if len(packed) != size:
        raise WarcError("the dictionary frame is cut short")
    dictionary = zstandard.ZstdDecompressor().decompress(packed) if packed.startswith(ZSTD_MAGIC) else packed
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = source.read(1 << 18)
    while data:
        if len(data) >= 4 and data[:4] != ZSTD_MAGIC:
            raise WarcError("a frame does not start with the Zstandard magic")
        frame, raw = zstd.decompressobj(), []
        try:
            while not frame.eof:
                if not data:
                    raise WarcError("the last frame is cut short")
                raw.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else source.read(1 << 18)
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from e
        yield parse(b"".join(raw))
        data = data or source.read(1 << 18)


def _record(page_id: int | None, url: str | None, html: bytes, digest: str, first: int | None) -> bytes:
    payload_digest = "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c if c > "\x20" and c != "\x7f" else "%%%02X" % ord(c) for c in url or ""),
        "WARC-Payload-Digest": payload_digest,
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    block = http + html
    if first is not None:
        headers |= {"WARC-Profile": IDENTICAL, "X-Refers-To-Page": str(first), "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>"}
        block = http
    headers["WARC-Block-Digest"] = digest_label(block)
    return serialise(headers, block)


def write_archives(pages: DataFrame, workspace: common.Workspace, min_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per page; return the manifest ``path string, records long``.

    Of equal payloads of at least ``min_revisit`` bytes the smallest id is written
    whole and the others as revisits of it, without the payload. A null payload
    is empty; a null id is written as no id, and a group with no other id keeps
    all its rows whole. Rows that repeat the smallest id are all responses.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    groups = pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html")).where(F.octet_length("html") >= min_revisit)
    groups = groups.groupBy(F.sha2("html", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    # Written, so that the join reads two plain exchanges and a hot digest can be split.
    groups = workspace.stage(groups.select("digest", "first"), "repeated")
    rows = rows.join(groups, "digest", "left")
    folder = workspace.path("warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.open_store(folder)
        fs.create_dir(base, recursive=True)
        made, waiting, held = [], [], 0
        sink = writer = name = None

        def flush() -> None:
            nonlocal sink, writer, name, waiting, held
            if writer is None:
                name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                sink = fs.open_output_stream(name, compression=None)
                writer = ArchiveWriter(sink, train(waiting))
                made.append([name, 0])
            for record in waiting:
                writer.add(record)
            made[-1][1] += len(waiting)
            waiting, held = [], 0
            if writer.bytes >= ARCHIVE_BYTES:
                close()

        def close() -> None:
            nonlocal sink, writer
            if sink is not None:
                sink.close()
            sink = writer = None

        for batch in batches:
            cols = [batch.column(n) for n in ("page_id", "url", "html", "digest", "first")]
            for page_id, url, body, digest, first in zip(cols[0].to_pylist(), cols[1].to_pylist(), common.utf8_views(cols[2]), cols[3].to_pylist(), cols[4].to_pylist()):
                record = _record(page_id, url, body, digest, None if first == page_id else first)
                waiting.append(record)
                held += len(record)
                if writer is not None or len(waiting) >= DICTIONARY_RECORDS or held >= DICTIONARY_SAMPLE:
                    flush()
        if waiting:
            flush()
        close()
        yield pa.record_batch([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return workspace.stage(rows.mapInArrow(write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri``; responses' payloads are checked against their digest,
    and every archive against the number of records written."""
    spark = manifest.sparkSession
    scheme = common.shared_root(spark).split("://")[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = common.open_store(f"{scheme}://{path}" if path.startswith("/") else path)
                out: list[list] = [[], [], [], [], [], []]
                with fs.open_input_stream(at, compression=None) as source:
                    for record in read_archive(source):
                        h = record.headers
                        http, body = record.http()
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
                        size = int(http["Content-Length"])
                        if h["WARC-Type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                            raise WarcError(f"{h['WARC-Record-ID']}: the payload differs from its headers")
                        row = (int(h["X-Page-ID"]) if h.get("X-Page-ID") else None, size, digest, h["WARC-Type"], int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, h["WARC-Target-URI"])
                        for column, v in zip(out, row):
                            column.append(v)
                if len(out[0]) != expected:
                    raise WarcError(f"{path} has {len(out[0])} records, not {expected}")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")
