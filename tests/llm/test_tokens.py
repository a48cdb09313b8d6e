"""Byte-level BPE, packing and shards."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import bpe, common, packing, sstable, tokens

from .data import ROWS, documents, nothing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_pattern_is_the_public_one():
    assert tokens.PATTERN == public_tokenizers.PATTERN


TEXTS = st.text(max_size=200) | st.text(alphabet="ab  '\nsTé日1!<|>", max_size=120)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_sentencepiece_equals_ranks(reference, text):
    coder = bpe.coder(RANKS)
    ids = coder.encode(text)
    assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_fast_encoder_equals_library(library, text):
    assert tokens.encoder(JSON).encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_every_vocabulary_entry_encodes_as_the_rank_encoder_does(reference):
    coder = bpe.coder(RANKS)
    for piece in random.Random(1).sample(coder.vocabulary, 3000):
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        assert coder.encode(text) == reference.encode_ordinary(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 10 * bpe.ENTRY_BYTES)
    coder = bpe.ByteBpe(bpe.load_ranks(RANKS))
    for k in range(20):
        text = " ".join(f"w{k}x{i}" for i in range(9))
        assert coder.round_trip(text)[1] == text.encode()
    assert len(coder.shown) < 100


def test_texts_learnt_together_equal_single_ones(reference, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 60)
    coder, texts = bpe.coder(RANKS), ["", "one two", "x" * 100, "", "three " * 30, "\u00e9 4", "y" * 70]
    assert [s for s, _ in coder.round_trips(texts)] == [",".join(map(str, reference.encode_ordinary(t))) for t in texts]
    assert [raw for _, raw in coder.round_trips(texts)] == [t.encode() for t in texts] and list(coder.round_trips([])) == []


def test_long_words_are_not_remembered(reference):
    coder = bpe.ByteBpe(bpe.load_ranks(RANKS))
    for k in range(3):
        text = f"short {chr(97 + k) * 300_000} end " + "xyz" * 30 + " \u00e9" * 3
        shown, raw = coder.round_trip(text)
        assert raw == text.encode() and shown == ",".join(map(str, reference.encode_ordinary(text)))
        assert coder.encode(text) == reference.encode_ordinary(text)
    assert max(map(len, coder.shown)) <= bpe.LONGEST and sum(map(len, coder.shown.values())) < 1000


def test_op1(spark, reference):
    got = bpe.encode_decode(documents(spark), RANKS).collect()
    expected = []
    for i, t in ROWS:
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert bpe.encode_decode(nothing(spark), RANKS).count() == 0


def brute_bins(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 25), max_size=10))))
def test_plan_is_best_fit_decreasing(case):
    capacity, histogram = case
    runs, total = packing.plan(histogram, capacity)
    bins, counts = {}, {}
    for length, a, b, first, each, offset in runs:
        for q in range(a, b):
            bins.setdefault(first + (q - a) // each, []).append((offset + (q - a) % each * length, length))
            counts[length] = counts.get(length, 0) + 1
    assert counts == histogram and len(bins) == total == brute_bins(histogram, capacity)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_op6(spark, library):
    rows = packing.pack(documents(spark), JSON, max_tokens=64).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    expected = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        at, piece = 0, 0
        while at < len(ids):
            end = at + ((len(ids) - 1) % 64 + 1 if at == 0 else 64)
            expected.append((i, piece, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())))
            at, piece = end, piece + 1
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(expected, key=str)
    assert packing.pack(nothing(spark), JSON).count() == 0


def test_packing_ranks_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    rows = packing.pack(documents(spark, [(i, "word " * (i % 7)) for i in range(400)]), JSON, max_tokens=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 400


def test_packing_a_repeated_row(spark, monkeypatch):
    """One row many times is ranked in many groups, and every copy has a place of its own."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    frame = documents(spark, [(1, "same words here")] * 600 + [(None, None)] * 300)
    rows = packing.pack(frame, JSON, max_tokens=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 900
    salted = packing.cut(frame, JSON, 16, 0, "doc_id", "text").groupBy(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(18))).count().collect()
    assert len(salted) == 18 and max(r["count"] for r in salted) < 100


def test_shard_lookup(tmp_path):
    rng = random.Random(3)
    data = sorted({rng.randrange(-(2**40), 2**40) for _ in range(3000)})
    values = {i: np.array([rng.randrange(50_000) for _ in range(rng.randrange(1, 40))], np.uint32) for i in data}
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f)
        w.add(None, np.array([7], np.uint32))
        for i in data:
            w.add(i, values[i])
        w.add(data[-1], np.array([9], np.uint32))
        w.close()
    with open(path, "rb") as f:
        shard = sstable.Shard(f, path.stat().st_size)
        assert len(shard.index) > 1
        for i in rng.sample(data[:-1], 200):
            assert [v.tolist() for v in shard.get(i)] == [values[i].tolist()]
        assert len(shard.get(data[-1])) == 2 and shard.get(None)[0].tolist() == [7]
        absent = [i for i in range(2000) if i not in values]
        assert not any(shard.get(i) for i in absent)
        assert [k for k, _ in shard.scan()] == [None, *data, data[-1]]
    raw = bytearray(path.read_bytes())
    raw[100] ^= 1
    path.write_bytes(raw)
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(sstable.Shard(f, len(raw)).scan())


def test_shard_keys_ascend():
    with pytest.raises(ValueError):
        w = sstable.ShardWriter(None)
        w.add(5, np.zeros(1, np.uint32))
        w.add(4, np.zeros(1, np.uint32))


def test_op8(spark, library):
    ws = common.Workspace(spark, "t")
    got = [tuple(r) for r in sstable.read_shards(sstable.write_shards(documents(spark), ws, JSON)).collect()]
    expected, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    assert sstable.read_shards(sstable.write_shards(nothing(spark), common.Workspace(spark, "t"), JSON)).count() == 0


def test_shards_roll_over_and_a_hot_id_is_split(spark, library, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 4_000)
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 500)
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, 7, rng.randrange(10**6)]), " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(40)))) for _ in range(800)] + [(7, "the same row")] * 400
    ws = common.Workspace(spark, "t")
    manifest = sstable.write_shards(documents(spark, rows), ws, JSON)
    shards = manifest.collect()
    assert max(r.bytes for r in shards) < 12_000 and sum(r.entries for r in shards) == len(rows)
    assert len({r.part for r in shards if r.first_id == 7}) > 1
    got = sorted(map(tuple, sstable.read_shards(manifest).collect()), key=lambda r: r[1])
    ids = lambda t: library.encode(t, add_special_tokens=False).ids + [0]
    assert sorted(((i, n, c) for i, _, n, c in got), key=str) == sorted(((i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows), key=str)
    assert [i for i, *_ in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:])) and got[0][1] == 0


@pytest.fixture(scope="module")
def plain_library():
    """The library as it reads the file: added tokens are recognised in a text."""
    return Tokenizer.from_file(JSON)


END = "<|endoftext|>"
PARTS = st.sampled_from([END, END[:-1], END[1:], "<|", "a", " ", "  \n", "Été ", "'s", "1!", "日本"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS | TEXTS, max_size=12).map("".join))
def test_added_tokens_in_texts_equal_library(plain_library, text):
    assert tokens.encoder(JSON).encode(text) == plain_library.encode(text, add_special_tokens=False).ids


def test_added_tokens_that_take_blanks_equal_library(tmp_path):
    spec = json.load(open(JSON, encoding="utf-8"))
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 50257, "content": END + "x", "lstrip": True})
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    library, coder = Tokenizer.from_file(str(path)), tokens.encoder(str(path))
    for text in (f"a  {END}x b", f"a {END} b{END}xx", "none"):
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert coder.n_vocab == 50258


def test_blanks_are_those_of_the_engine():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    engine = tiktoken.Encoding("s", pat_str=r"\s", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    assert "".join(re.findall(f"[{tokens.BLANK}]", every)) == bytes(engine.encode_ordinary(every)).decode()


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", " \t\r\n", "\xa0 "])
@pytest.mark.parametrize("before, after", [("", ""), ("a", ""), ("", "b"), ("it's", "1 x"), (END, END), ("\x1c", "\x1f")])
def test_long_blank_runs_equal_library(plain_library, monkeypatch, blank, before, after):
    monkeypatch.setattr(tokens, "LONG_RUN", 5)
    monkeypatch.setattr(tokens, "_LONG_RUN", re.compile(f"[{tokens.BLANK}]{{5,}}"))
    for n in range(1, 24):
        text = before + blank * n + after + blank * 7 + before + blank + after
        assert tokens.encoder(JSON).encode(text) == plain_library.encode(text, add_special_tokens=False).ids


def test_two_million_letters_equal_library(plain_library):
    for text in ("ab" * 1_000_000, "x" * 500_000 + END + "1" * 300_000):
        assert tokens.encoder(JSON).encode(text) == plain_library.encode(text, add_special_tokens=False).ids


HUGE = [(1, "a" + " " * 1_200_000 + "b"), (2, "\n" * 1_100_000), (3, "c")]


def test_over_a_million_blanks_equal_library(spark, plain_library):
    expected, at = [], 0
    for i, t in HUGE:
        ids = plain_library.encode(t, add_special_tokens=False).ids + [0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sstable.read_shards(sstable.write_shards(documents(spark, HUGE), common.Workspace(spark, "t"), JSON)).collect()
    assert sorted(map(tuple, got)) == expected
    packed = packing.pack(documents(spark, HUGE), JSON, max_tokens=2**21).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in packed) == [(i, n, crc) for i, _, n, crc in expected]


MARKED = [(1, f"a{END}b"), (2, f"{END}{END} "), (3, f"x  {END}\n{END[:-1]} y"), (4, "after"), (None, END), (4, f"{END} again " * 40)]


def test_op6_with_added_tokens(spark, plain_library):
    rows = packing.pack(documents(spark, MARKED), JSON).collect()
    expected = []
    for i, t in MARKED:
        ids = plain_library.encode(t, add_special_tokens=False).ids + [0]
        expected.append((i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(expected, key=str)


def test_op8_with_added_tokens(spark, plain_library):
    got = [tuple(r) for r in sstable.read_shards(sstable.write_shards(documents(spark, MARKED), common.Workspace(spark, "t"), JSON)).collect()]
    expected, at = [], 0
    for i, t in sorted(MARKED, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = plain_library.encode(t, add_special_tokens=False).ids + [0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
