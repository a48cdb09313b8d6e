"""Sorted-string-table shards for token ids (operator 8).

Layout of one shard, all integers little-endian::

    block*        entries in key order; see below; then crc32 of the block (4)
    index block   per block: last key (9), offset (8), size (4), tokens before (8)
    filter block  Bloom filter over the keys, ``PROBES`` bits a key
    footer        index offset, filter offset, blocks, entries, tokens (8 each),
                  bytes per id (4), crc32 of index and filter (4), magic (8)

An entry is ``varint shared, varint unshared, varint value length, key tail,
value``: keys share a prefix with the entry before, except at every
``RESTART``-th entry, and the block ends with the restart offsets and their
count. Lookups test the filter, bisect the sparse index, then bisect the
block's restarts. A key is one byte (0: null id, 1: id) and the id as a
big-endian number with its sign bit flipped, so that byte order is id order and
null comes first. Equal ids are kept as adjacent entries; a lookup returns all.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

MAGIC = b"FOLIOSST"
BLOCK_BYTES = 64 << 10
RESTART = 16
BITS_PER_KEY = 10
PROBES = 7
#: A shard ends with the entry that reaches this size; index and keys, which are held in
#: memory until then, are bounded with it.
SHARD_BYTES = 64 << 20
FOOTER = struct.Struct("<5QII8s")
INDEX_ROW = struct.Struct("<9sQIQ")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id & (2**64 - 1)) ^ (1 << 63))


def id_of(key: bytes) -> int | None:
    if key[0] == 0:
        return None
    n = struct.unpack(">Q", key[1:])[0] ^ (1 << 63)
    return n - (1 << 64) if n >> 63 else n


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = zlib.crc32(key)
    step = zlib.adler32(key) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return [(h + i * step) % bits for i in range(PROBES)]


class ShardWriter:
    """Streams entries in key order to an open binary file."""

    def __init__(self, sink, id_bytes: int = 2):
        self.sink, self.id_bytes = sink, id_bytes
        self.offset = self.entries = self.tokens = self._before = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._block, self._restarts, self._in_block, self._last = bytearray(), [], 0, b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if key < self._last:
            raise ValueError("keys must not descend")
        shared = 0
        if self._in_block % RESTART == 0:
            self._restarts.append(len(self._block))
        else:
            while shared < 9 and key[shared] == self._last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        self._block += _varint(shared) + _varint(9 - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self._last = key
        self._in_block += 1
        self.entries += 1
        self.tokens += len(ids)
        if len(self._block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self._in_block:
            return
        body = bytes(self._block) + np.array([*self._restarts, len(self._restarts)], "<u4").tobytes()
        body += struct.pack("<I", zlib.crc32(body))
        self.sink.write(body)
        self.index.append(INDEX_ROW.pack(self._last, self.offset, len(body), self._before))
        self.offset += len(body)
        self._before = self.tokens
        self._block, self._restarts, self._in_block = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray(bits + 7 >> 3)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index, bloom = b"".join(self.index), struct.pack("<Q", bits) + bytes(bloom)
        self.sink.write(index + bloom)
        at = self.offset
        self.sink.write(FOOTER.pack(at, at + len(index), len(self.index), self.entries, self.tokens, self.id_bytes, zlib.crc32(index + bloom), MAGIC))


class Shard:
    """Reads a shard from a random-access file: ``scan`` in order, ``get`` by key."""

    def __init__(self, source, size: int):
        self.source = source
        head = self._read(size - FOOTER.size, FOOTER.size)
        at, bloom_at, blocks, self.entries, self.tokens, self.id_bytes, crc, magic = FOOTER.unpack(head)
        tail = self._read(at, size - FOOTER.size - at)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a shard, or its index is damaged")
        self.index = [INDEX_ROW.unpack_from(tail, i * INDEX_ROW.size) for i in range(blocks)]
        self.last_keys = [row[0] for row in self.index]
        self.bits = struct.unpack_from("<Q", tail, bloom_at - at)[0]
        self.bloom = tail[bloom_at - at + 8 :]

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _load(self, number: int) -> tuple[bytes, np.ndarray]:
        _, at, size, _ = self.index[number]
        body = self._read(at, size)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {number} is damaged")
        count = struct.unpack_from("<I", body, size - 8)[0]
        return body[: size - 8 - 4 * count], np.frombuffer(body, "<u4", count, size - 8 - 4 * count)

    def _entries(self, entries: bytes, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(entries):
            shared, at = _read_varint(entries, at)
            unshared, at = _read_varint(entries, at)
            size, at = _read_varint(entries, at)
            key = key[:shared] + entries[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(entries, f"<u{self.id_bytes}", size // self.id_bytes, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.index)):
            for key, ids in self._entries(self._load(number)[0]):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Every value under the key; an absent key reads no block unless the
        filter errs."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found: list[np.ndarray] = []
        for number in range(bisect_left(self.last_keys, key), len(self.index)):
            entries, restarts = self._load(number)
            lo, hi = 0, len(restarts)
            while lo < hi:  # the first restart whose key is not below
                mid = (lo + hi) // 2
                if next(self._entries(entries, int(restarts[mid])))[0] < key:
                    lo = mid + 1
                else:
                    hi = mid
            for k, ids in self._entries(entries, int(restarts[max(0, lo - 1)])):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
        return found


MANIFEST = "part int, number int, path string, first_id long, entries long, tokens long, bytes long"


def write_shards(docs: DataFrame, workspace: common.Workspace, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as shards in ascending id order; return their manifest, in which
    ``part, number`` order the shards.

    Rows are range-partitioned by id, so shards follow one another and a reader
    needs only the manifest to find one. There are as many ranges as the texts' bytes
    need, and a task rolls over to a new shard at ``SHARD_BYTES``. Each task attempt
    writes files of its own names; the manifest, committed by Spark, names those that
    count. Null ids come first; equal ids are ordered by their texts' beginnings, then
    by a hash, and may fall into several ranges, even if the row repeats. A null text is
    the end id alone, other columns are ignored, and an empty table gives no shard.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    folder = workspace.path("shards")
    wide = 2 if encoder(tokenizer_path).n_vocab <= 1 << 16 else 4
    limit = SHARD_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.open_store(folder)
        fs.create_dir(base, recursive=True)
        enc, part, made = encoder(tokenizer_path), TaskContext.get().partitionId(), []
        writer, sink, name, first = None, None, "", None

        def close() -> None:
            writer.close()
            sink.close()
            made.append((part, len(made), name, first, writer.entries, writer.tokens, fs.get_file_info(name).size))

        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), common.texts(batch[1])):
                if writer is not None and writer.offset >= limit:
                    close()
                    writer = None
                if writer is None:
                    name, first = f"{base}/{uuid.uuid4().hex}.sst", doc_id
                    sink = fs.open_output_stream(name, compression=None)
                    writer = ShardWriter(sink, wide)
                ids = enc.encode(text)
                ids.append(end_id)
                writer.add(doc_id, np.array(ids, np.uint32))
        if writer is not None:
            close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*made)) if made else [()] * len(kinds)
        yield pa.record_batch([pa.array(v, k) for v, k in zip(columns, kinds)], names=["part", "number", "path", "first_id", "entries", "tokens", "bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(common.shuffle_partitions(spark), size // SHARD_BYTES + 1)
    # The borders are sampled from these keys, so they hold no whole texts.
    keys = [F.col("doc_id"), F.left("text", F.lit(32)), F.xxhash64("text")]
    ordered = rows.repartitionByRange(ranges, *keys, F.rand(0)).sortWithinPartitions(*keys, "text")
    return workspace.stage(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document in the shards: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` sums the manifest and then runs within a shard. The sum is one task's work,
    over one small row a shard: some 1.6 million for 100 TB.
    """
    spark = manifest.sparkSession
    folder_scheme = common.shared_root(spark).split("://")[0]
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("path", "base", "bytes")
    shards = shards.repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = common.open_store(f"{folder_scheme}://{path}" if path.startswith("/") else path)
                with fs.open_input_file(at) as source:
                    doc_ids, starts, lengths, crcs = [], [], [], []
                    for doc_id, ids in Shard(source, size).scan():
                        doc_ids.append(doc_id)
                        starts.append(base)
                        lengths.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        base += len(ids)
                        if len(doc_ids) == 10_000:
                            yield pa.record_batch([pa.array(v, pa.int64()) for v in (doc_ids, starts, lengths, crcs)], names=names)
                            doc_ids, starts, lengths, crcs = [], [], [], []
                    yield pa.record_batch([pa.array(v, pa.int64()) for v in (doc_ids, starts, lengths, crcs)], names=names)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
