"""N-gram Jaccard join by grouped prefixes (operator 4).

1. *Survivors.* A set can only reach the threshold with another if that share of
   its own shingles occurs elsewhere. Every chunk of documents sends each of its
   shingles once, 32 bits each, to the bucket of its hash; buckets report how many
   shingles of each set occur in more than one chunk. Most sets end here.
2. *Prefixes.* For survivors, exact frequencies order shingles from rare to
   frequent, so passages that many documents share come last. A set's prefix is
   its rarest ``n - ceil(t n) + 1`` shingles. Sets with equal prefix and size form
   one group, and groups, not sets, are joined on prefix shingles.
3. *Filter.* Two groups that share a prefix shingle pass if their sizes allow the
   threshold and if enough shingles are left from the shingle's position on in both
   (size and position filter). Pairs that pass are not listed: within a shingle the
   sizes that a group may meet are an interval, so one running maximum over
   (size, reach) ties every group to one that it passes with, and the ties connect
   exactly what the pairs would. Their components are the candidate clusters.
4. *Verification.* Groups expand to members. Small clusters are compared whole in
   memory. A large cluster is dealt to units of bounded size, each with the cluster's
   most central sets; most of it links there. Group pairs that pass the filter and are
   not yet known to be connected are then listed, expanded and compared, or, where
   that would be most of the pairs of a cluster, what stands outside the cluster's
   largest component meets the cluster in blocks.

Copies (equal sets) are one set from the start. Everything travels as packed
arrays; a shingle held by a third of all sets costs one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .shingles import shingle_sets

PERCENT = 75
#: A chunk ends at this many sets or shingles, a bucket is meant for so many shingles.
CHUNK_SETS, CHUNK_SHINGLES, BUCKET_SHINGLES, LEAST_BUCKETS = 4_000, 500_000, 2_000_000, 8
#: A cluster beyond either is large; a unit of one is meant for so many sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000
#: Sets in a bin of small clusters (a bin is read as a whole, compared in blocks).
BIN_SETS = 2_000
#: Central sets of a large cluster that each of its units gets, at most.
PIVOTS = 32
#: A cluster is compared in blocks if pairs would make so many times the rows.
PAIRS_PER_SET = 16
#: Reaches are rounded up to this share of the size, so that a shingle has few of them.
REACH_STEPS = 64

PACKED = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary, e binary"
DOCS, SINGLE, SHARED, COUNTS = range(4)


def least_overlap(n: np.ndarray | int, percent: int):
    """ceil(t n): what a set of n shingles must share to reach the threshold."""
    return -(-percent * n // 100)


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1  # fits a signed long


def _packed(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def _pack_rows(rows: list[tuple]) -> pa.RecordBatch:
    return _packed(rows, ("bucket", "kind", "chunk", "a", "b", "c", "d", "e"), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5))


def _small(counts: np.ndarray) -> bytes:
    """Counts in two bytes each if they fit, else in four."""
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def _counts(raw, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _buffers(column: pa.ChunkedArray) -> list:
    """The bytes of each value without copying; None for null."""
    return [v.as_buffer() if v.is_valid else None for v in column]


def _parts(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number in ``key`` and the places that hold it, in order."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(key) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(ranked[lo]), order[lo:hi]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids with text hashes, and shingle sets, a chunk at a time."""
    ids: list = []
    sets: list[np.ndarray] = []
    held = 0
    for batch in batches:
        new = shingle_sets(common.utf8_views(batch[1]))
        for i, h, s in zip(batch[0].to_pylist(), batch[2].to_pylist(), new):
            ids.append((i, h))
            sets.append(s)
            held += len(s)
            if len(sets) >= CHUNK_SETS or held >= CHUNK_SHINGLES:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1, map side. Sets travel as numbers within their chunk, in two bytes."""
    for ids, sets in _chunks(batches):
        fps = np.array([fingerprint(s) if len(s) else 0 for s in sets], np.uint64)
        sizes = np.array([len(s) for s in sets], np.uint32)
        known = np.array([i is not None for i, _ in ids])
        numbers = np.array([i if i is not None else 0 for i, _ in ids], np.int64)
        hashes = np.array([h for _, h in ids], np.int64)
        # Chunks of equal rows have one name; their counts add up, which drops no set.
        chunk = xxhash.xxh3_64_intdigest(numbers.tobytes() + hashes.tobytes()) >> 1
        home = chunk % buckets
        rows = [(home, DOCS, chunk, numbers.tobytes(), known.tobytes(), fps.tobytes(), sizes.tobytes(), hashes.tobytes())]
        _, first = np.unique(fps, return_index=True)
        first = first[sizes[first] > 0]
        if len(first):
            shingles = np.concatenate([sets[i] for i in first])
            owner = np.repeat(np.arange(len(first)), sizes[first])
            order = np.argsort(shingles)
            ranked = shingles[order]
            same = ranked[1:] == ranked[:-1]
            again = np.zeros(len(ranked), bool)
            again[1:] |= same
            again[:-1] |= same
            local = np.bincount(owner[order[again]], minlength=len(first)).astype(np.uint32)
            rows.append((home, COUNTS, chunk, fps[first].tobytes(), local.tobytes(), sizes[first].tobytes(), None, None))
            once = order[~again]
            once.sort()  # back to set order
            _split(rows, SINGLE, chunk, shingles[once], owner[once], buckets)
            _split(rows, SHARED, chunk, ranked[again & np.concatenate(([True], ~same))], None, buckets)
        yield _pack_rows(rows)


def _split(rows: list, kind: int, chunk: int, shingles: np.ndarray, owner, buckets: int) -> None:
    """A row per bucket that the chunk's shingles meet, so never more rows than shingles."""
    high, bucket = np.divmod(shingles, np.uint64(buckets))
    short = (high & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for b, at in _parts(bucket):
        if owner is None:
            rows.append((b, kind, chunk, short[at].tobytes(), None, None, None, None))
        else:
            who, counts = np.unique(owner[at], return_counts=True)
            rows.append((b, kind, chunk, short[at].tobytes(), _small(counts), who.astype(np.uint16).tobytes(), None, None))


def _receive(table: pa.Table) -> pa.Table:
    """Step 1, a bucket: per chunk and set, the shingles that another chunk has too."""
    passed = table.filter(pc.is_in(table["kind"], pa.array([DOCS, COUNTS], pa.int32())))
    lists = [r for r in zip(table["kind"].to_pylist(), table["chunk"].to_pylist(), *(_buffers(table[c]) for c in "abc")) if r[0] in (SINGLE, SHARED)]
    keep = []
    if lists:
        every = np.concatenate([np.frombuffer(r[2], np.uint32) for r in lists])
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        for kind, chunk, short, counts, who in lists:
            if kind == SINGLE and len(twice):
                short, who = np.frombuffer(short, np.uint32), np.frombuffer(who, np.uint16)
                at = np.searchsorted(twice, short)
                hit = twice[np.minimum(at, len(twice) - 1)] == short
                hits = np.bincount(np.repeat(np.arange(len(who)), _counts(counts, len(who))), hit, len(who)).astype(np.uint32)
                if hits.any():
                    keep.append((0, COUNTS, chunk, who[hits > 0].tobytes(), _small(hits[hits > 0]), None, None, None))
    return pa.concat_tables([passed, pa.Table.from_batches([_pack_rows(keep)]).cast(passed.schema)])


def _survivors(table: pa.Table, percent: int) -> pa.Table:
    """Step 1, a chunk: fingerprints of the sets that share enough."""
    rows = list(zip(*(_buffers(table[c]) for c in "abc")))
    fps, total, size = next((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32).astype(np.int64), np.frombuffer(c, np.uint32)) for a, b, c in rows if c is not None)
    for who, hits, own in rows:
        if own is None:
            who = np.frombuffer(who, np.uint16)
            total[who] += _counts(hits, len(who))
    return pa.table({"fp": pa.array(fps[total >= least_overlap(size.astype(np.int64), percent)].astype(np.int64))})


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: survivors' sets, one row a chunk."""
    for _, sets in _chunks(batches):
        sets = list({fingerprint(s): s for s in sets if len(s)}.values())
        if sets:
            sizes = np.array([len(s) for s in sets], np.uint32)
            every = np.concatenate(sets)
            chunk = xxhash.xxh3_64_intdigest(every.tobytes(), 1) >> 1
            yield _packed([(chunk, 0, every.tobytes(), sizes.tobytes())], ("chunk", "kind", "a", "b"), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))


CHUNK = "chunk long, kind int, a binary, b binary"


def _frequencies_out(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, raw in zip(batch["chunk"].to_pylist(), batch["a"].to_pylist()):
            unique, counts = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
            rows = [(p, chunk, unique[at].tobytes(), counts[at].astype(np.uint32).tobytes()) for p, at in _parts(unique % np.uint64(buckets))]
            yield _packed(rows, ("bucket", "chunk", "a", "b"), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))


def _frequencies_back(table: pa.Table) -> pa.Table:
    """Exact frequencies of a bucket's shingles, told to each chunk that has them."""
    lists = [np.frombuffer(x, np.uint64) for x in table["a"].to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table["b"].to_pylist()]
    unique, where = np.unique(np.concatenate(lists), return_inverse=True)
    df = np.bincount(where, np.concatenate(counts)).astype(np.uint32)
    rows = []
    for chunk, own in zip(table["chunk"].to_pylist(), lists):
        f = df[np.searchsorted(unique, own)]
        if (f > 1).any():
            rows.append((chunk, 1, own[f > 1].tobytes(), f[f > 1].tobytes()))
    return pa.Table.from_batches([_packed(rows, ("chunk", "kind", "a", "b"), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))])


MEMBERS = "gid long, fp long, n int, lone int, shingles binary, prefix array<long>"


def _prefixes(table: pa.Table, percent: int) -> pa.Table:
    """Step 2, a chunk: prefixes by (frequency, hash), and groups of equal ones.

    ``lone`` counts the shingles that no other set has; they stand first in the prefix,
    and ``prefix`` lists the others."""
    rows = list(zip(*(table[c].to_pylist() for c in ("kind", "a", "b"))))
    told = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)) for kind, a, b in rows if kind == 1]
    known, df = (np.concatenate(x) for x in zip(*told)) if told else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    order = np.argsort(known)
    known, df = known[order], df[order]
    out: list[list] = [[], [], [], [], [], []]
    seen = set()
    for kind, a, b in rows:
        if kind != 0:
            continue
        every, sizes, at = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), 0
        for n in sizes.tolist():
            s = every[at : at + n]
            at += n
            f = np.ones(n, np.uint32)
            if len(known):
                where = np.minimum(np.searchsorted(known, s), len(known) - 1)
                f = np.where(known[where] == s, df[where], 1)
            keep = n - int(least_overlap(n, percent)) + 1
            lone = int((f == 1).sum())
            if lone >= keep:
                continue
            fp = fingerprint(s)
            if fp in seen:
                continue
            seen.add(fp)
            head = np.lexsort((s, f))[:keep]
            prefix = s[head]
            gid = xxhash.xxh3_64_intdigest(prefix.tobytes(), n) >> 1
            for column, v in zip(out, (gid, fp, n, lone, s.tobytes(), prefix[f[head] > 1].view(np.int64).tolist())):
                column.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(v, k) for v, k in zip(out, kinds)], names=["gid", "fp", "n", "lone", "shingles", "prefix"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Shingles of few sets are counted pair by pair,
    those of many by a matrix product."""
    k = len(sets)
    shared = np.zeros((k, k), np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    begins = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    lengths = np.diff(np.concatenate((begins, [len(every)])))
    few = 8
    for length in range(2, few + 1):
        at = begins[lengths == length]
        if len(at):
            runs = owner[at[:, None] + np.arange(length)]
            for i in range(length):
                for j in range(i + 1, length):
                    shared += np.bincount(runs[:, i] * k + runs[:, j], minlength=k * k).reshape(k, k)
    many = np.flatnonzero(lengths > few)
    for part in range(0, len(many), 4096):
        own = many[part : part + 4096]
        grid = np.zeros((k, len(own)), np.float32)
        for column, (b, n) in enumerate(zip(begins[own].tolist(), lengths[own].tolist())):
            grid[owner[b : b + n], column] = 1
        product = grid @ grid.T
        shared += np.triu(product.astype(np.int64), 1)
    return shared + shared.T


def forest(linked: np.ndarray) -> np.ndarray:
    """Per set the smallest index it reaches in a symmetric boolean matrix."""
    k = len(linked)
    root = np.full(k, -1)
    for i in range(k):
        if root[i] < 0:
            reached = np.zeros(k, bool)
            reached[i] = True
            front = reached
            while front.any():
                grown = linked[front].any(axis=0) & ~reached
                reached = reached | grown
                front = grown
            root[reached] = i
    return root


def _runs(cluster: np.ndarray, block_sets: int) -> Iterator[slice]:
    """Cuts sorted cluster numbers into runs of whole clusters, of at most
    ``block_sets`` sets unless a single cluster has more."""
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1]))), [len(cluster)])).tolist()
    begin = 0
    for at, end in zip(edges[:-1], edges[1:]):
        if at > begin and end - begin > block_sets:
            yield slice(begin, at)
            begin = at
    yield slice(begin, edges[-1])


def linked(shared, a, b, percent: int):
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` common shingles link."""
    return (shared > 0) & (100 * shared >= percent * (a + b - shared))


def _verify(table: pa.Table, percent: int, block_sets: int) -> pa.Table:
    """Step 4, a bin of small clusters or a unit of a large one: a spanning forest of
    its links. A matrix of overlaps holds one cluster, or small ones up to the size of
    a block, however many sets the bin has."""
    every = table["fp"].to_numpy()
    _, first = np.unique(every, return_index=True)
    cluster = table["cluster"].to_numpy()[first]
    order = np.argsort(cluster, kind="stable")
    first, cluster = first[order], cluster[order]
    fps, shingles = every[first], _buffers(table["shingles"].take(pa.array(first)))
    a: list[int] = []
    b: list[int] = []
    for run in _runs(cluster, block_sets):
        sets, own = [np.frombuffer(x, np.uint64) for x in shingles[run]], fps[run]
        if len(sets) < 2:
            continue
        shared, size = overlaps(sets), np.array([len(s) for s in sets])
        root = forest(linked(shared, size[:, None], size[None, :], percent))
        tied = np.flatnonzero(root != np.arange(len(sets)))
        a += own[tied].tolist()
        b += own[root[tied]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Step 4, single pairs: those that link."""
    for batch in batches:
        keep = []
        for x, y in zip(_buffers(batch["x"]), _buffers(batch["y"])):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            keep.append(bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _postings(members: DataFrame, percent: int, *extra: str) -> DataFrame:
    """Step 3: ``shingle, gid, n, reach``, a row per group and listed prefix shingle.

    ``reach`` is the largest size that a set may have to link with the group if this
    shingle is the first that they share: from position p on, n - p shingles are left,
    and (100 + t) (n - p) >= t (n + m) bounds the other size m. Rounded up by less than
    a ``REACH_STEPS``-th of n."""
    listed = members.select(*extra, "gid", "n", "lone", F.posexplode("prefix").alias("at", "shingle")).distinct()
    left = F.col("n") - F.col("lone") - F.col("at")
    most = F.floor(left * (100 + percent) / percent + F.lit(1e-9)) - F.col("n")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / REACH_STEPS))
    return listed.select(*extra, "shingle", "gid", "n", (F.col("n") + F.ceil((most - F.col("n")) / step) * step).cast("long").alias("reach"))


def _ties(postings: DataFrame, ws: common.Workspace) -> DataFrame:
    """Step 3: edges ``a, b`` between groups with the components that all pairs passing
    the size and position filter would have, as many as there are postings at most.

    Groups with equal (shingle, n, reach) are a class. A group passes with a smaller
    one, of size m, if m <= its reach and its size <= the other's reach. So a class is
    placed at min(n, reach) and looks at the largest reach of classes before it that
    reach their own size at least; two of these that both reach a size beyond their
    own pass with each other, so one tie is enough. A class that reaches its own size
    is tied together; another only if it has found something to be tied to.
    """
    classes = postings.groupBy("shingle", "n", "reach").agg(F.min("gid").alias("rep"), F.count(F.lit(1)).alias("groups"))
    own = F.col("reach") >= F.col("n")
    before = Window.partitionBy("shingle").orderBy(F.least("n", "reach"), (~own).cast("int"), "reach", "rep").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(own, F.struct("reach", "rep"))).over(before)
    classes = classes.withColumn("best", best).withColumn("to", F.when(F.col("best.reach") >= F.col("n"), F.col("best.rep")))
    classes = ws.stage(classes.where(F.col("to").isNotNull() | (own & (F.col("groups") > 1))).select("shingle", "n", "reach", "rep", "to", "groups"), "classes-of-postings")
    chains = classes.where("to IS NOT NULL").select(F.col("rep").alias("a"), F.col("to").alias("b"))
    stars = postings.join(classes.where("groups > 1"), ["shingle", "n", "reach"]).where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    return chains.unionAll(stars)


def _units(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Step 4, first round: ``cluster, unit, fp, shingles`` of large clusters. Every set is
    in one unit, and the most central ones (fewest shingles of their own) are in all."""
    placed = members.join(sizes, "cluster")
    # at least one pivot, and not more than half a unit's shingles
    count = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(BLOCK_SHINGLES / 2 / (F.col("all") / F.col("sets")))))
    units = F.greatest(F.ceil(F.col("sets") / (BLOCK_SETS - PIVOTS)), F.ceil(2 * F.col("all") / BLOCK_SHINGLES)).cast("int")
    placed = placed.withColumn("units", units).withColumn("count", count)
    central = Window.partitionBy("cluster").orderBy(F.col("lone") / F.col("n"), "fp")
    pivots = placed.select("cluster", "fp", "n", "lone", "units", "count").withColumn("place", F.row_number().over(central)).where(F.col("place") <= PIVOTS).where("place <= count")
    pivots = pivots.join(members.select("fp", "shingles"), "fp").select("cluster", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), "fp", "shingles")
    return placed.select("cluster", F.pmod(F.xxhash64("fp"), F.col("units")).cast("int").alias("unit"), "fp", "shingles").unionAll(pivots)


def _unsettled(members: DataFrame, roots: DataFrame, ws: common.Workspace, percent: int) -> DataFrame:
    """Step 4, last round: the sets of large clusters that are not yet one component, with
    their ``root`` so far and how to go on. ``main`` is the cluster's largest component,
    ``u`` of the ``m`` sets stand outside it. ``dense``: listing group pairs would make
    far more rows than sending blocks of sets to each other."""
    known = members.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    known = ws.stage(known, "known-roots", "none")
    parts = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all"))
    parts = parts.groupBy("cluster").agg(F.max(F.struct("sets", "root")).alias("top"), F.sum("sets").alias("m"), F.sum("all").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    parts = ws.stage(parts.select("cluster", F.col("top.root").alias("main"), "m", (F.col("m") - F.col("top.sets")).alias("u"), "all"), "unsettled")
    lists = _postings(known.join(parts.select("cluster"), "cluster", "left_semi"), percent, "cluster").groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("k"))
    listed = ws.stage(lists.groupBy("cluster").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("listed")), "listed")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK_SETS), F.ceil(F.col(c) * F.col("all") / F.col("m") / BLOCK_SHINGLES)).cast("int")
    parts = parts.join(listed, "cluster", "left").withColumn("mb", blocks("m")).withColumn("ub", blocks("u"))
    sent = F.col("m") * F.col("ub") + F.col("u") * (F.col("mb") + F.col("ub"))
    parts = parts.select("cluster", "main", "mb", "ub", (F.coalesce("listed", F.lit(0)) > PAIRS_PER_SET * sent).alias("dense"))
    return ws.stage(known.join(parts, "cluster"), "open", "none")


def _blocks(rest: DataFrame) -> DataFrame:
    """``cluster, kind, i, j, fp, shingles``: of a dense cluster every block of stragglers
    meets every block of the others and of stragglers."""
    far = F.col("root") != F.col("main")
    i, j = F.pmod(F.xxhash64("fp"), F.col("mb")).cast("int"), F.pmod(F.xxhash64("fp"), F.col("ub")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = rest.where(~far).select("cluster", F.lit(0).alias("kind"), i.alias("i"), upto("ub").alias("j"), "fp", "shingles")
    away = rest.where(far).select("cluster", F.lit(0).alias("kind"), upto("mb").alias("i"), j.alias("j"), "fp", "shingles")
    both = rest.where(far & (F.col("ub") > 1)).select("cluster", j.alias("own"), upto("ub").alias("other"), "fp", "shingles")
    both = both.select("cluster", F.lit(1).alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "shingles")
    return near.unionAll(away).unionAll(both)


def _pairs(rest: DataFrame, ws: common.Workspace, percent: int) -> DataFrame:
    """``a, b`` of the set pairs to compare in clusters that are not dense: those of group
    pairs that pass the filter and whose sets are not yet known to be connected."""
    spans = ws.stage(rest.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")), "group-spans")
    entries = _postings(rest, percent).join(spans, "gid")
    mixed = entries.groupBy("shingle").agg(F.min("low").alias("r"), F.max("high").alias("s")).where("r < s").select("shingle")
    entries = ws.stage(entries.join(mixed, "shingle", "left_semi"), "entries")
    x, y = entries.alias("x"), entries.alias("y")
    settled = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    passes = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.gid") < F.col("y.gid")) & (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") <= F.col("x.reach")) & ~settled
    groups = x.join(y, passes).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).distinct()
    groups = ws.stage(groups.unionAll(spans.where("low < high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))), "group-pairs")
    one = rest.select(F.col("gid").alias("g"), F.col("fp").alias("a"), F.col("root").alias("ra"))
    other = rest.select(F.col("gid").alias("h"), F.col("fp").alias("b"), F.col("root").alias("rb"))
    return groups.join(one, "g").join(other, "h").where("ra <> rb AND (g <> h OR a < b)").select("a", "b")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, c, d, e in zip(*(batch[k].to_pylist() for k in "abcde")):
            known = np.frombuffer(b, bool)
            yield pa.record_batch([pa.array(np.frombuffer(a, np.int64), mask=~known), pa.array(np.frombuffer(c, np.uint64).astype(np.int64)), pa.array(np.frombuffer(d, np.uint32).astype(np.int64)), pa.array(np.frombuffer(e, np.int64))], names=["doc_id", "fp", "n_shingles", "text_hash"])


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per input row: ``doc_id, fp, n_shingles, text_hash``; and one row per
    set that several rows have or that links: ``fp, root, component``, the smallest set
    and the smallest id (null if all are) of its component."""
    spark = docs.sparkSession
    common.prepare(spark)
    ws = common.Workspace(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    characters = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Every set reports to every bucket that holds its shingles: no more buckets than needed.
    buckets = max(LEAST_BUCKETS, characters // 6 // BUCKET_SHINGLES + 1)

    sent = rows.mapInArrow(lambda it: _send(it, buckets), PACKED)
    packed = ws.stage(sent.groupBy("bucket").applyInArrow(_receive, PACKED), "packed")
    docs_table = ws.stage(packed.where(F.col("kind") == DOCS).mapInArrow(_documents, "doc_id long, fp long, n_shingles long, text_hash long"), "documents")
    survivors = packed.where(F.col("kind") == COUNTS).groupBy("chunk").applyInArrow(lambda t: _survivors(t, percent), "fp long")
    classes = docs_table.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = ws.stage(classes, "classes")
    reps = ws.stage(classes.join(survivors, "fp", "left_semi").select(F.col("least_id").alias("rep_id")), "representatives")
    ws.drop("packed")

    chosen = rows.join(common.bounded(reps), F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi")
    chunks = ws.stage(chosen.mapInArrow(_gather, CHUNK), "chunks", "none")
    parts = max(common.shuffle_partitions(spark), (chunks.agg(F.sum(F.octet_length("a"))).first()[0] or 0) // 8 // BUCKET_SHINGLES + 1)
    out = chunks.mapInArrow(lambda it: _frequencies_out(it, parts), "bucket int, chunk long, a binary, b binary")
    back = out.groupBy("bucket").applyInArrow(_frequencies_back, CHUNK)
    members = chunks.unionAll(back).groupBy("chunk").applyInArrow(lambda t: _prefixes(t, percent), MEMBERS)
    members = ws.stage(members, "members", "none")

    clusters = ws.stage(connected_components(_ties(ws.stage(_postings(members, percent), "postings"), ws), ws, "clusters"), "clusters").withColumnRenamed("node", "gid")
    ws.drop("postings")
    placed = members.join(clusters, "gid", "left").withColumn("cluster", F.coalesce("root", "gid")).drop("root")
    sizes = ws.stage(placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all")).where("sets > 1"), "sizes")
    small = (F.col("sets") <= BLOCK_SETS) & (F.col("all") <= BLOCK_SHINGLES)
    total = sizes.where(small).agg(F.sum("sets").alias("sets"), F.sum("all").alias("all")).first()
    bins, block_sets = int(max((total["sets"] or 0) // BIN_SETS, (total["all"] or 0) // BLOCK_SHINGLES) + 1), BLOCK_SETS
    bin_of = F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int").alias("bin")
    lone = placed.join(sizes.where(small).select("cluster"), "cluster").select(bin_of, "cluster", "fp", "shingles")
    links = ws.stage(lone.groupBy("bin").applyInArrow(lambda t: _verify(t, percent, block_sets), "a long, b long"), "links")
    large = sizes.where(~small)
    if not large.isEmpty():
        wide = ws.stage(placed.join(large.select("cluster"), "cluster"), "wide", "none")
        found = _units(wide, large).groupBy("cluster", "unit").applyInArrow(lambda t: _verify(t, percent, block_sets), "a long, b long")
        found = ws.stage(found, "unit-links")
        known = ws.stage(connected_components(found, ws, "units"), "unit-roots")
        links = links.unionAll(found)
        rest = _unsettled(wide, known, ws, percent)
        sparse = rest.where("NOT dense")
        if not rest.isEmpty():
            blocks = _blocks(rest.where("dense")).groupBy("cluster", "kind", "i", "j").applyInArrow(lambda t: _verify(t, percent, block_sets), "a long, b long")
            links = links.unionAll(ws.stage(blocks, "block-links"))
        if not sparse.isEmpty():
            pairs = ws.stage(_pairs(sparse, ws, percent), "pairs")
            sets = wide.select("fp", "shingles")
            held = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
            more = held.select("a", "b", "x", "y").mapInArrow(lambda it: _verify_pairs(it, percent), "a long, b long")
            links = links.unionAll(ws.stage(more, "pair-links"))
    roots = ws.stage(connected_components(links, ws, "components"), "components")

    least = classes.join(roots, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("least_id").alias("component"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "component")
    known = classes.join(linked, "fp", "left").where("copies > 1 OR root IS NOT NULL")
    # Written: the last join reads two plain exchanges, so a hot copy's rows can be split.
    known = ws.stage(known.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least_id").alias("component")), "known")
    return docs_table, known


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Sets link when 100 * intersection >= percent * union. The component is the
    smallest id reachable by links. A null, empty or blank text has no shingles
    and links with nothing. A row with a null id takes part; its component is the
    smallest id it reaches, null if none. Repeated rows are equal sets. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs_table, known = _judged(docs, percent, id_col, text_col)
    own = docs_table.join(known, "fp", "left")
    found = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", found.alias("component_id"))


def keep_representatives(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest id.

    Null ids come last; of rows that share the id, that with the smallest text hash
    stays, and rows that repeat both id and text are reduced to one of them. Rows are
    dropped by id and text hash, so rows that only share an id fare apart.
    """
    ws = common.Workspace(docs.sparkSession, "representatives")
    rows, known = _judged(docs, percent, id_col, text_col)
    found = rows.where("n_shingles > 0").join(known, "fp")
    found = ws.stage(found.select("root", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("doc_id").eqNullSafe(F.col("component")).alias("least")), "found")
    first = ws.stage(found.where("least").groupBy("root").agg(F.min("__hash").alias("first")), "first")
    keys = found.join(first, "root").select("__id", "__hash", (F.col("least") & (F.col("__hash") == F.col("first"))).alias("kept"))
    keys = ws.stage(keys, "keys")
    same = (F.col("__hash") == F.col("__own")) & F.col("__id").eqNullSafe(F.col(id_col).cast("long"))
    marked = docs.withColumn("__own", F.xxhash64(F.col(text_col)))
    gone = ws.stage(keys.where(~F.col("kept")).select("__id", "__hash").distinct(), "gone")
    rest = marked.join(common.bounded(gone), same, "left_anti")
    twins = ws.stage(keys.where("kept").groupBy("__id", "__hash").count().where("count > 1").select("__id", "__hash"), "twins")
    if twins.isEmpty():
        return rest.select(*docs.columns)
    repeated = rest.join(common.bounded(twins), same, "left_semi").dropDuplicates([id_col, "__own"])
    return rest.join(common.bounded(twins), same, "left_anti").unionByName(repeated).select(*docs.columns)
