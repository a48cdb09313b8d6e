"""Ogg media columns (operator 2).

The container layer is complete: pages with checksums, lacing values, packets
that continue over pages, interleaved logical streams, granule positions. What
it carries here are blocks of 8-bit samples, dealt in turn to two logical
streams; the reader puts them back by the time that granule positions give.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format.
CAPTURE = b"OggS"
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS = 255

#: The stream header packet: magic, version, channel, channels, bits, rate, block, bytes.
HEAD = struct.Struct("<8sBBBBIIQ")
HEAD_MAGIC = b"FOLIOPCM"
RATE = 8000
BLOCK = 576
CHANNELS = 2
PAD = 255

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A damaged or incomplete physical stream."""


def page_crc(page: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, most significant bit first, from
    0. It is the mirror image of the common CRC-32 over mirrored bytes."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def paginate(serial: int, packets: list[bytes], granules: list[int], max_segments: int = MAX_SEGMENTS) -> list[bytes]:
    """The pages of a logical stream. The first packet has a page of its own; a
    page's granule position is that of the last packet ending on it, else -1."""
    pages, done = [], 0
    groups = [(packets[:1], granules[:1]), (packets[1:], granules[1:])]
    for begin, (own, ends) in enumerate(groups):
        table, data = b"".join(lacing(len(p)) for p in own), b"".join(own)
        at = used = done = 0
        while at < len(table):
            laces = table[at : at + max_segments]
            size = sum(laces)
            more = len(laces) - laces.count(255)
            flags = CONTINUED * (at > 0 and table[at - 1] == 255) | FIRST * (begin == 0) | LAST * (at + len(laces) == len(table) and (begin == 1 or not groups[1][0]))
            done += more
            head = PAGE.pack(CAPTURE, 0, flags, ends[done - 1] if more else -1, serial, len(pages), 0, len(laces))
            page = head + laces + data[used : used + size]
            pages.append(page[:22] + struct.pack("<I", page_crc(page)) + page[26:])
            at, used = at + len(laces), used + size
    return pages


@dataclass
class LogicalStream:
    serial: int
    laces: list[bytes] = field(default_factory=list)
    data: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open: bool = False  # the last packet so far goes on
    ended: bool = False

    def packets(self) -> list[bytes]:
        """Packets from lacing values: each ends at the first value below 255."""
        values = np.frombuffer(b"".join(self.laces), np.uint8)
        ends = np.cumsum(values, dtype=np.int64)[values < 255].tolist()
        data = b"".join(self.data)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def end_times(self, samples: list[int]) -> list[int]:
        """The granule position of each packet's end: given for the last packet that
        ends on a page, and counted back from there for those before it."""
        times: list[int] = []
        at = 0
        for laces, granule in zip(self.laces, self.granules):
            n = len(laces) - laces.count(255)
            if not n:
                if granule != -1:
                    raise OggError("a granule position on a page where no packet ends")
                continue
            back, own = granule, []
            for size in reversed(samples[at : at + n]):
                own.append(back)
                back -= size
            if times and back != times[-1]:
                raise OggError("granule positions do not follow one another")
            times += reversed(own)
            at += n
        return times


def demultiplex(physical: bytes) -> dict[int, LogicalStream]:
    """Check every page and sort its content by logical stream."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(physical):
        if len(physical) - at < PAGE.size:
            raise OggError("a page header is cut short")
        capture, version, flags, granule, serial, number, crc, segments = PAGE.unpack_from(physical, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        body = at + PAGE.size + segments
        laces = physical[at + PAGE.size : body]
        end = body + sum(laces)
        if len(laces) < segments or end > len(physical):
            raise OggError("a page is cut short")
        if page_crc(physical[at : at + 22] + b"\0\0\0\0" + physical[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        stream = streams.get(serial)
        if (stream is None) != bool(flags & FIRST):
            raise OggError("a stream must begin with a first page, once")
        if stream is None:
            stream = streams[serial] = LogicalStream(serial)
        if stream.ended or number != len(stream.laces):
            raise OggError("a page is missing, repeated or after the end")
        if bool(flags & CONTINUED) != stream.open:
            raise OggError("a continued packet lacks its beginning or its rest")
        stream.laces.append(laces)
        stream.data.append(physical[body:end])
        stream.granules.append(granule)
        stream.open = bool(laces) and laces[-1] == 255
        stream.ended = bool(flags & LAST)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the block."""
    return data + bytes([PAD]) * (-len(data) % BLOCK if data else BLOCK)


def store(data: bytes, max_segments: int = MAX_SEGMENTS) -> bytes:
    """The payload of ``data`` as an Ogg file; equal data give equal files."""
    payload = pad(data)
    serial = zlib.crc32(payload)
    streams = []
    for channel in range(CHANNELS):
        head = HEAD.pack(HEAD_MAGIC, 1, channel, CHANNELS, 8, RATE, BLOCK, len(data))
        blocks = [payload[i : i + BLOCK] for i in range(channel * BLOCK, len(payload), CHANNELS * BLOCK)]
        granules = [BLOCK * (k + 1) for k in range(len(blocks))]
        streams.append(paginate(serial + channel & 0xFFFFFFFF, [head, *blocks], [0, *granules], max_segments))
    firsts = [s.pop(0) for s in streams]
    rest = [page for turn in range(max(map(len, streams))) for s in streams for page in s[turn : turn + 1]]
    return b"".join(firsts + rest)


@dataclass
class Media:
    n_bytes: int
    payload: bytes
    packets: int
    seconds: float


def load(media: bytes) -> Media:
    """Read a stored file back: blocks in the order of their start times, and of
    channels at equal times."""
    blocks, sizes, rate, last = [], set(), RATE, 0
    for stream in demultiplex(media).values():
        head, *packets = stream.packets()
        magic, version, channel, _, bits, rate, _, n_bytes = HEAD.unpack(head)
        if magic != HEAD_MAGIC or version != 1 or bits != 8:
            raise OggError("not a stream of 8-bit samples")
        sizes.add(n_bytes)
        times = stream.end_times([0, *map(len, packets)])[1:]
        blocks += [(end - len(p), channel, p) for end, p in zip(times, packets)]
        last = max(last, *times, 0) if times else last
    if len(sizes) != 1:
        raise OggError("streams disagree on the length")
    blocks.sort(key=lambda b: b[:2])
    return Media(sizes.pop(), b"".join(b[2] for b in blocks), len(blocks), last / rate)


def feature(media: Media) -> str:
    """Blocks, duration, mean, deviation and sign changes about the middle, as text."""
    x = np.frombuffer(media.payload, np.uint8)
    high = x >= 128
    return f"blocks={media.packets};seconds={media.seconds:.3f};mean={x.mean():.3f};deviation={x.std():.3f};crossings={np.count_nonzero(high[1:] != high[:-1])}"


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an Ogg column, read the column back, describe it.

    Per row: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``. The column is written as a table before
    it is read. A null or empty text is one block of padding; null and repeated
    ids are carried along; other columns are ignored. No shuffle.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    ws = common.Workspace(spark, "media")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([store(t) for t in common.utf8_views(batch[1])], pa.binary())], names=["doc_id", "media"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for raw in batch[1].to_pylist():
                media = load(raw)
                row = (media.n_bytes, len(media.payload), hashlib.sha256(media.payload).hexdigest(), zlib.crc32(media.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(media))
                for column, v in zip(out, row):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(v, k) for v, k in zip(out, kinds))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = ws.stage(rows.mapInArrow(encode, "doc_id long, media binary"), "media")
    return stored.mapInArrow(decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
