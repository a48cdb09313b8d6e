"""Exact deduplication, the Jaccard join and components."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import common, exact_dedup, jaccard
from foliospark.llm.components import connected_components
from foliospark.llm.shingles import shingle_sets

from .data import ROWS, documents, nothing

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def expected_groups(rows):
    keys = [hashlib.sha256((t or "").encode().translate(LOWER)).hexdigest() for _, t in rows]
    out = []
    for (i, _), k in zip(rows, keys):
        ids = [j for (j, _), x in zip(rows, keys) if x == k]
        known = [j for j in ids if j is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(ids), i == keep, k))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, exact_dedup.SEGMENT_BITS])
def test_op7(spark, max_bits):
    got = exact_dedup.exact_dedup(documents(spark), max_bits=max_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == expected_groups(ROWS)


def test_slices_cover_all_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1 << 14)
    rows = [(i, f"text {i % 70}") for i in range(100)]
    got = exact_dedup.exact_dedup(documents(spark, rows), max_bits=exact_dedup.SEGMENT_BITS)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == expected_groups(rows)


@pytest.mark.parametrize("slices", [4, 64])
def test_all_slices_are_filtered_at_once(spark, monkeypatch, slices):
    """The tables written do not grow in number with the slices, and no digest is lost."""
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", slices << 10)
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    written, plain = [], common.Workspace.stage
    monkeypatch.setattr(common.Workspace, "stage", lambda self, df, name, codec="zstd": written.append(name) or plain(self, df, name, codec))
    rows = [(i, f"text {i % 400}") for i in range(500)]
    got = exact_dedup.exact_dedup(documents(spark, rows), max_bits=exact_dedup.SEGMENT_BITS)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == expected_groups(rows)
    assert len([n for n in written if not n.startswith("planes")]) == 3 and len(written) < 12


def test_op7_empty(spark):
    assert exact_dedup.exact_dedup(nothing(spark)).count() == 0


def test_unique_rows_pass_straight_through(spark):
    ws = common.Workspace(spark, "t")
    rows = documents(spark, [(i, f"text {i % 900}") for i in range(1000)]).select("doc_id", exact_dedup.text_digest().alias("text_sha256"))
    marked = exact_dedup.possibly_repeated(ws.stage(rows, "rows"), ws, 1000)
    assert 200 <= marked.where("maybe").count() <= 210


def test_planes_find_repeats_across_parts():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, (500, 2)).astype(np.uint64)
    a, b = exact_dedup.Planes(1 << 16), exact_dedup.Planes(1 << 16)
    a.add(words[:300])
    b.add(words[250:])
    b.add(words[400:410])
    exact_dedup._merge(a.seen, a.again, b.seen, b.again)
    hit = exact_dedup.Planes.has(a.again, exact_dedup._positions(words, 1 << 16))
    assert hit[250:300].all() and hit[400:410].all() and hit.sum() < 100


def test_keep_one(spark):
    kept = exact_dedup.keep_one(documents(spark)).collect()
    keys = [(r.text or "").encode().translate(LOWER) for r in kept]
    assert len(keys) == len(set(keys)) == len({(t or "").encode().translate(LOWER) for _, t in ROWS})
    assert kept[0].__fields__ == documents(spark).columns
    assert exact_dedup.keep_one(nothing(spark)).collect() == []


@pytest.mark.parametrize("limit", [1000, 0])
def test_keep_one_by_rows(spark, monkeypatch, limit):
    """Null and repeated ids: one row of each text, that with the largest id."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rows = [(None, "a"), (None, "A"), (None, "b"), (1, "b"), (1, "c"), (1, "C"), (1, "c"), (2, "d"), (2, "d"), (2, "e"), (3, None), (4, ""), (None, "f"), (None, "f")]
    kept = sorted(((r.doc_id, (r.text or "").lower()) for r in exact_dedup.keep_one(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([(None, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e"), (4, ""), (None, "f")], key=str)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def brute_set(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return sorted(out, key=str)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["A", "a", "b", "é", "xy", " ", "\n", "\x0b", "\t\r ", " "]), max_size=40).map("".join), min_size=1, max_size=12))
def test_shingles_equal_brute_force(texts):
    sets = [brute_set(t) for t in texts]
    hashed = shingle_sets([t.encode() for t in texts])
    for a, x in zip(hashed, sets):
        assert len(a) == len(x) and (np.diff(a.astype(object)) > 0).all()
        for b, y in zip(hashed, sets):
            assert len(np.intersect1d(a, b)) == len(x & y)


def near_copies(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for c in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(n // 12):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w += passage
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, dense", [(1, 0), (2, 10**9), (4, 0)])
def test_op4_on_near_copies(spark, monkeypatch, seed, dense):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 17)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "PAIRS_PER_SET", dense)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0 if seed == 2 else 1000)
    rows = near_copies(seed)
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def indexed_components(rows):
    """The same by an index of shingles, for more rows."""
    sets, holders = [brute_set(t) for _, t in rows], {}
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(i)
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_many_short_texts(spark):
    rng = random.Random(7)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 13))] for _ in range(1500)]
    rows = []
    for i in range(6000):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.choice([0, -1])] = f"w{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_components(documents(spark, rows, clash=False)).collect()
    assert sorted(map(tuple, got), key=str) == indexed_components(rows)


@pytest.mark.parametrize("dense", [0, 10**9])
def test_one_cluster_of_many_near_copies(spark, monkeypatch, dense):
    """Half the copies stray too far from the original to link with it."""
    sent = []
    plain = jaccard._units
    monkeypatch.setattr(jaccard, "_units", lambda *a: sent.append(plain(*a).count()) or plain(*a))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 64)
    monkeypatch.setattr(jaccard, "PIVOTS", 8)
    monkeypatch.setattr(jaccard, "PAIRS_PER_SET", dense)
    rng = random.Random(9)
    base, rows = [f"b{i}" for i in range(100)], []
    for i in range(900):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_components(documents(spark, rows, clash=False)).collect()
    assert sorted(map(tuple, got), key=str) == indexed_components(rows)
    assert sent and sent[0] < 1.3 * len(rows)


def test_op4_on_awkward_rows(spark):
    got = jaccard.jaccard_components(documents(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(ROWS)
    assert jaccard.jaccard_components(nothing(spark)).count() == 0


def test_threshold_is_exact(spark):
    # 8 and 6 shingles, 6 of them shared: 75 of 100; one more word on the long side: less.
    words = [f"t{i}" for i in range(20)]
    rows = [(1, " ".join(words[:12])), (2, " ".join(words[:10])), (3, " ".join(words[:13] + ["z"])), (4, "Q Q Q Q Q Q Q")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(documents(spark, rows)).collect()}
    assert got == {r[0]: r[2] for r in brute_components(rows)} and got[2] == 1 and got[4] == 4


def test_overlap_matrix():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(30)]
    shared = jaccard.overlaps(sets)
    assert all(shared[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    rows = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(rows, common.Workspace(spark, "t"), "c").collect()}
    root = {}

    def top(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    nodes = {i for e in edges if e[0] != e[1] for i in e}
    assert got == {i: top(i) for i in nodes}
    assert connected_components(rows.where("false"), common.Workspace(spark, "t"), "c").count() == 0


def test_keep_representatives(spark):
    rows = near_copies(3)
    kept = {r.doc_id for r in jaccard.keep_representatives(documents(spark, rows)).collect()}
    assert kept == {c for _, _, c in brute_components(rows)}


def awkward_components():
    """Rows, and of each component all of them."""
    words = [f"v{i}" for i in range(300)]
    a, b, c, d, e = (" ".join(words[i : i + 40]) for i in range(0, 250, 50))
    groups = [
        [(1, a), (None, a + " x")],  # a null id near a known one
        [(None, b)],  # alone, and of the same null id
        [(None, c), (None, c + " y"), (None, "z " + c)],  # near copies without any id
        [(7, d), (7, d + " q"), (7, d.upper())],  # near copies that share an id
        [(7, e), (9, e + " r")],  # the same id elsewhere
        [(9, "p q r s t u v w")],  # an id that went in another component
        [(5, "five five five"), (5, "five five five")],  # the whole row repeated
    ]
    return groups, [[(None, None)], [(9, "")], [(9, " ")], [(1, " ")]]


@pytest.mark.parametrize("limit", [1000, 0])
def test_keep_one_row_a_component(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    groups, blank = awkward_components()
    rows = [r for g in groups + blank for r in g]
    frame = jaccard.keep_representatives(documents(spark, rows))
    kept = [(r.doc_id, r.text) for r in frame.collect()]
    assert frame.columns == documents(spark, rows).columns
    for g in groups:
        ids = [i for i, _ in g if i is not None]
        own = [k for k in kept if k in g]
        assert len(own) == 1 and own[0][0] == (min(ids) if ids else None)
    assert sorted((k for k in kept if not (k[1] or "").strip()), key=str) == sorted((r for g in blank for r in g), key=str)
    assert len(kept) == len(groups) + len(blank)


def test_keep_representatives_of_nothing(spark):
    assert jaccard.keep_representatives(nothing(spark)).count() == 0


def test_matrices_of_a_bin_are_no_larger_than_a_block(monkeypatch):
    rng, held, sizes = np.random.default_rng(4), [], []
    plain = jaccard.overlaps
    monkeypatch.setattr(jaccard, "overlaps", lambda sets: sizes.append(len(sets)) or plain(sets))
    for cluster in range(300):
        base = rng.integers(0, 2**62, 12).astype(np.uint64)
        for k in range(rng.integers(2, 9)):
            s = np.unique(np.concatenate((base, rng.integers(0, 2**62, k % 3).astype(np.uint64))))
            held.append((cluster * 7919 % 300 - 150, jaccard.fingerprint(s), s.tobytes()))
    held = [held[i] for i in rng.permutation(len(held))]
    cluster, fp, shingles = zip(*held)
    table = pa.table({"cluster": pa.array(cluster, pa.int64()), "fp": pa.array(fp, pa.int64()), "shingles": pa.array(shingles, pa.binary())})
    got = jaccard._verify(table, 75, 40)
    assert max(sizes) <= 40 and sum(sizes) > 1000 > 300 > len(sizes)
    owner = dict(zip(fp, cluster))
    assert all(owner[a] == owner[b] for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()))
    assert set(got["a"].to_pylist()) | set(got["b"].to_pylist()) == set(fp) and got.num_rows == len(set(fp)) - 300
