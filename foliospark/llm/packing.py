"""Best-fit packing planned on a histogram of lengths (operator 6).

Only the histogram, at most ``max_tokens`` counts, reaches the driver. Best-fit
decreasing runs over counts: filling the tightest bin that fits until it no
longer does is what best-fit does with equal pieces one by one, so a run of bins
with the same room is handled at once. The plan is a list of runs; a piece
finds its slot from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Pieces in a group that are ranked together; groups grow in number with the input.
GROUP_PIECES = 20_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs ``(length, rank from, rank to, first sequence, pieces a sequence, offset)``
    and the number of sequences.

    The piece of rank q in a run goes to sequence ``first + (q - from) // pieces``
    at ``offset + (q - from) % pieces * length``. The runs are bounded by the
    capacity alone: a length splits at most one class of open bins, so classes
    number at most two a length, whatever the counts.
    """
    runs, total = [], 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, bins: int, room: int, each: int) -> None:
            nonlocal rank, left
            n = bins * each
            runs.append((length, rank, rank + n, first, each, capacity - room))
            rank += n
            left -= n
            if room - each * length:
                rooms.setdefault(room - each * length, []).append((first, bins))

        for room in sorted(r for r in rooms if r >= length):
            waiting, each = rooms.pop(room), room // length
            while waiting and left:
                first, bins = waiting.pop()
                full = min(bins, left // each)
                if full:
                    place(first, full, room, each)
                if full < bins and left:  # fewer than a bin's worth: they share one bin
                    place(first + full, 1, room, left)
                    full += 1
                if full < bins:
                    waiting.append((first + full, bins - full))
            if waiting:
                rooms.setdefault(room, []).extend(waiting)
            if not left:
                break
        each = capacity // length
        if full := left // each:
            place(total, full, capacity, each)
            total += full
        if left:
            place(total, 1, capacity, left)
            total += 1
    return runs, total


def cut(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of every document: only one of over ``max_tokens`` is cut, and
    its first piece takes what whole pieces leave over. ``salt`` numbers a task's
    pieces; it tells repeated rows apart."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, salt = encoder(tokenizer_path), 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch[0].to_pylist(), common.texts(batch[1])):
                ids = enc.encode(text)
                ids.append(end_id)
                n, raw = len(ids), np.array(ids, "<u4").tobytes()
                at, piece = 0, 0
                while at < n:
                    end = at + ((n - 1) % max_tokens + 1 if at == 0 else max_tokens)
                    for column, v in zip(out, (doc_id, piece, at, end - at, zlib.crc32(raw[4 * at : 4 * end]), salt)):
                        column.append(v)
                    at, piece, salt = end, piece + 1, salt + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is empty (the end id alone), null and repeated ids are packed row
    by row, other columns are ignored, an empty table packs into nothing.

    A piece's rank within its length is its rank within a small group (a hash of
    the piece and its salt) plus the group's base, so that a length held by a third of
    all pieces, even of one row repeated, is ranked by many tasks.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    ws = common.Workspace(spark, "packing")
    pieces = ws.stage(cut(docs, tokenizer_path, max_tokens, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, max_tokens)
    groups = max(1, -(-sum(histogram.values()) // GROUP_PIECES))

    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(groups)))
    local = Window.partitionBy("g", "length").orderBy("doc_id", "piece", "start", "ids_crc32", "salt")
    ranked = grouped.withColumn("local_rank", F.row_number().over(local) - 1)
    # per length, one row a group: a running sum over at most ``groups`` rows
    sizes = grouped.groupBy("g", "length").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("g", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    ranked = ranked.join(bases, ["g", "length"]).withColumn("rank", F.col("local_rank") + F.col("base"))

    schema = "length long, run_from long, run_to long, first long, each long, room_from long"
    slots = spark.createDataFrame(runs, schema)
    # The plan's size is bounded by max_tokens, not by the data: safe to broadcast.
    placed = ranked.join(F.broadcast(slots), "length").where((F.col("rank") >= F.col("run_from")) & (F.col("rank") < F.col("run_to")))
    at = F.col("rank") - F.col("run_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("room_from") + F.pmod(at, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
