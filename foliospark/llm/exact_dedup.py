"""Exact deduplication in two passes over a Bloom filter (operator 7).

Pass one builds two bit planes over all digests, "seen" and "seen again", as one
distributed reduction. Pass two tests every digest against "seen again": a
digest that fails cannot repeat, so its row goes straight through; the others,
all true repeats among them, are shuffled and settled exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Filter bits a row, and bits a digest sets.
BITS_PER_ROW, PROBES = 16, 4
#: A plane's largest size. Beyond it the digests are cut into slices by value and
#: each slice gets a filter of its own, so a task never holds more than two planes.
MAX_BITS = 1 << 28
#: Rows of digests that one task cuts into slices: a file a slice, so files stay few.
SLICED_ROWS = 40_000_000
#: Bits in the unit in which planes travel.
SEGMENT_BITS = 1 << 19
#: Partial planes of a segment that one task merges at a time.
FAN_IN = 32


def _positions(digests: np.ndarray, bits: int) -> np.ndarray:
    """Probe positions, one row a digest. ``digests``: two 64-bit words a row."""
    first, step = digests[:, 0], digests[:, 1] | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def _words(column: pa.Array) -> np.ndarray:
    """The first 16 bytes of hex digests as two words a row."""
    return np.frombuffer(bytes.fromhex("".join(d[:32] for d in column.to_pylist())), "<u8").reshape(-1, 2)


class Planes:
    """Two bit planes; ``again`` holds every digest added or merged twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.seen, self.again = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)

    @staticmethod
    def has(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((plane[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    @staticmethod
    def put(plane: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(plane, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())

    def add(self, digests: np.ndarray) -> None:
        unique, counts = np.unique(digests, axis=0, return_counts=True)
        at = _positions(unique, self.bits)
        repeated = (counts > 1) | self.has(self.seen, at)
        self.put(self.again, at[repeated])
        self.put(self.seen, at)

    def pieces(self) -> Iterator[tuple[int, bytes, bytes]]:
        step = SEGMENT_BITS >> 3
        for i in range(0, len(self.seen), step):
            seen, again = self.seen[i : i + step], self.again[i : i + step]
            if seen.any():
                yield i // step, zlib.compress(seen.tobytes(), 1), zlib.compress(again.tobytes(), 1)


def _merge(seen: np.ndarray, again: np.ndarray, more_seen: np.ndarray, more_again: np.ndarray) -> None:
    """In place: what both sides have seen has been seen again."""
    again |= more_again | (seen & more_seen)
    seen |= more_seen


PIECE = "slice int, segment long, part long, seen binary, again binary"


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the slice changes. Files hold one slice each, so it seldom does."""
    for batch in batches:
        if batch.num_rows:
            own = batch["slice"].to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield int(own[lo]), batch.slice(lo, hi - lo)


def _partial_planes(digests: DataFrame, bits: int) -> DataFrame:
    """Each task's nonzero segments, slice after slice."""

    def rows(of: int, planes: Planes) -> pa.RecordBatch:
        found = list(planes.pieces())
        part = int.from_bytes(np.random.bytes(4), "little")  # only spreads the merging
        columns = [pa.array([of] * len(found), pa.int32()), pa.array([r[0] for r in found], pa.int64()), pa.array([part] * len(found), pa.int64()), pa.array([r[1] for r in found], pa.binary()), pa.array([r[2] for r in found], pa.binary())]
        return pa.record_batch(columns, names=["slice", "segment", "part", "seen", "again"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, at = None, None
        for of, batch in _by_slice(batches):
            if of != at:
                if planes is not None:
                    yield rows(at, planes)
                planes, at = Planes(bits), of
            planes.add(_words(batch["text_sha256"]))
        if planes is not None:
            yield rows(at, planes)

    return digests.select("text_sha256", "slice").mapInArrow(build, PIECE)


def _merged(pieces: DataFrame) -> DataFrame:
    """Merge each segment's partial planes to one."""

    def fold(table: pa.Table) -> pa.Table:
        step = SEGMENT_BITS >> 3
        seen = again = None
        for a, b in zip(table["seen"].to_pylist(), table["again"].to_pylist()):
            a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
            if seen is None:
                seen, again = a.copy(), b.copy()
            else:
                _merge(seen, again, a, b)
        assert len(seen) <= step
        return pa.table({"slice": table["slice"][:1], "segment": table["segment"][:1], "part": pa.array([0], pa.int64()), "seen": pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), "again": pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())})

    return pieces.groupBy("slice", "segment", "part").applyInArrow(fold, PIECE)


def _plane(rows: Iterator[tuple[int, bytes]], bits: int) -> np.ndarray:
    again, step = np.zeros(bits >> 3, np.uint8), SEGMENT_BITS >> 3
    for segment, packed in rows:
        again[segment * step : (segment + 1) * step] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return again


def _stored_plane(folder: str, of: int, bits: int) -> np.ndarray:
    """The plane of a slice, read where it is tested."""
    fs, base = common.open_store(f"{folder}/slice={of}")
    files = [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".parquet")]
    tables = (pq.read_table(f.path, filesystem=fs, columns=["segment", "again"], partitioning=None) for f in files)
    return _plane((r for t in tables for r in zip(t["segment"].to_pylist(), t["again"].to_pylist())), bits)


def possibly_repeated(digests: DataFrame, workspace: common.Workspace, rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``digests`` with ``maybe``: false only where the digest is certainly unique.

    ``digests`` must be a written table. One filter of at most ``max_bits`` a plane serves
    up to 16.7 million rows and is broadcast, compressed, within that bound. More rows
    are first rewritten by slice, without a shuffle, a folder each; all slices are then
    filtered at once by the same two jobs, whose tasks go through files of one slice
    each and read that slice's plane from the shared folder. So the number of jobs does
    not depend on the number of slices, and every digest is read three times.
    """
    want = max(SEGMENT_BITS, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length())
    slices = max(1, want // max_bits)
    bits = want // slices
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in digests.schema.fields)
    if slices == 1:
        digests = digests.withColumn("slice", F.lit(0))
    else:
        slice_of = F.pmod(F.conv(F.substring("text_sha256", 33, 8), 16, 10).cast("long"), F.lit(slices)).cast("int")
        sliced = digests.withColumn("slice", slice_of).coalesce(max(1, rows // SLICED_ROWS + 1))
        sliced.write.partitionBy("slice").mode("overwrite").parquet(workspace.path("sliced"))
        digests = digests.sparkSession.read.schema(f"{fields}, slice int").parquet(workspace.path("sliced"))
    pieces = workspace.stage(_partial_planes(digests, bits), "planes-0", "none")
    parts = pieces.groupBy("slice", "segment").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while parts > 1:  # a tree: no task merges more than FAN_IN partial planes of a segment
        parts = -(-parts // FAN_IN)
        level += 1
        pieces = workspace.stage(_merged(pieces.withColumn("part", F.pmod("part", F.lit(parts)))), f"planes-{level}", "none")
    names = [f.name for f in digests.schema.fields]
    if slices == 1:
        # At most max_bits / 8 bytes, compressed: bounded whatever the input.
        held = [(r["segment"], r["again"]) for r in pieces.select("segment", "again").toLocalIterator()]
        plane = digests.sparkSession.sparkContext.broadcast(held)
        load = lambda of: _plane(plane.value, bits)
    else:
        folder = workspace.path("planes")
        pieces.select("segment", "again", "slice").write.partitionBy("slice").mode("overwrite").option("compression", "none").parquet(folder)
        load = lambda of: _stored_plane(folder, of, bits)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, at = None, None
        for of, batch in _by_slice(batches):
            if of != at:
                again, at = load(of), of
            found = Planes.has(again, _positions(_words(batch["text_sha256"]), bits))
            keep = [i for i, n in enumerate(names) if n != "slice"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found)], names=[*(names[i] for i in keep), "maybe"])

    return digests.mapInArrow(test, f"{fields}, maybe boolean")


def text_digest(text_col: str = "text") -> Column:
    return F.sha2(common.lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty.
    Of equal texts the largest id stays. A null id ranks below all others. Rows
    that repeat an id and its text are one group, and each of them that carries
    the largest id counts as kept. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    ws = common.Workspace(spark, "exact-dedup")
    digest = text_digest(text_col)
    digests = ws.stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("text_sha256")), "digests")
    marked = ws.stage(possibly_repeated(digests, ws, digests.count(), max_bits), "marked")
    single = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = marked.where("maybe")
    # One row a group: pre-aggregated before the shuffle, and written so that the
    # join below reads two plain exchanges and a hot group's side can be split.
    groups = ws.stage(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    settled = again.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionAll(settled)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts.

    The largest id stays, null last; a null text counts as empty, so it is a copy of an
    empty one. Only what is dropped is joined back, by id and a hash of the text: rows
    that only share an id fare apart, and rows that repeat both are reduced to one of
    them. Other columns are carried along whatever their names (but for ``__id``,
    ``__hash`` and ``__own``, the operator's own); an empty table stays empty.
    """
    ws = common.Workspace(docs.sparkSession, "keep-one")
    result = ws.stage(exact_dedup(docs, id_col, text_col).where("group_size > 1"), "groups")
    keys = result.select(F.col("doc_id").alias("__id"), F.xxhash64("text_sha256").alias("__hash"), "kept")
    same = (F.col("__hash") == F.col("__own")) & F.col("__id").eqNullSafe(F.col(id_col).cast("long"))
    marked = docs.withColumn("__own", F.xxhash64(text_digest(text_col)))
    dropped = ws.stage(keys.where(~F.col("kept")).select("__id", "__hash").distinct(), "dropped")
    rest = marked.join(common.bounded(dropped), same, "left_anti")
    twins = ws.stage(keys.where("kept").groupBy("__id", "__hash").count().where("count > 1").select("__id", "__hash"), "twins")
    if twins.isEmpty():
        return rest.select(*docs.columns)
    repeated = rest.join(common.bounded(twins), same, "left_semi").dropDuplicates([id_col, "__own"])
    return rest.join(common.bounded(twins), same, "left_anti").unionByName(repeated).select(*docs.columns)
