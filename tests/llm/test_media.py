"""Ogg columns and WARC archives."""

import hashlib
import io
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import common, ogg, warc

from .data import ROWS, documents, nothing


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1 & 0xFFFFFFFF
    return crc


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_page_checksum(data):
    assert ogg.page_crc(data) == slow_crc(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([1, 2, 3, 7, 64, 255]))
def test_ogg_round_trip(data, segments):
    media = ogg.load(ogg.store(data, segments))
    assert media.payload == ogg.pad(data) and media.n_bytes == len(data) and len(media.payload) % 576 == 0


@pytest.mark.parametrize("sizes", [[0], [255], [510], [254, 0, 255, 1], [70000, 3]])
def test_lacing_values(sizes):
    packets = [bytes([i]) * n for i, n in enumerate(sizes)]
    for segments in (1, 5, 255):
        pages = ogg.paginate(9, [b"head", *packets], [0, *range(1, len(sizes) + 1)], segments)
        stream = ogg.demultiplex(b"".join(pages))[9]
        assert stream.packets() == [b"head", *packets]


def test_granules_give_times():
    pages = ogg.paginate(1, [b"h", b"a" * 300, b"b" * 300, b"c" * 300], [0, 300, 600, 900], 4)
    stream = ogg.demultiplex(b"".join(pages))[1]
    assert -1 in stream.granules or len(stream.granules) > 2
    assert stream.end_times([0, 300, 300, 300]) == [0, 300, 600, 900]


def test_damage_is_found():
    raw = ogg.store(b"x" * 200_000, 40)
    pages = [i for i in range(len(raw)) if raw[i : i + 4] == b"OggS"]
    flipped = bytearray(raw)
    flipped[pages[3] + 60] ^= 1
    for bad in (bytes(flipped), raw[:-1], raw[: pages[-1]], raw[: pages[3]] + raw[pages[4] :], b"junk" + raw):
        with pytest.raises(ogg.OggError):
            ogg.load(bad)


def test_op2(spark):
    got = {(r.doc_id, r.payload_sha256, r.n_bytes, r.payload_bytes, r.tail_crc32) for r in ogg.media_features(documents(spark)).collect()}
    expected = set()
    for i, t in ROWS:
        data = (t or "").encode()
        p = data + b"\xff" * (-len(data) % 576 if data else 576)
        expected.add((i, hashlib.sha256(p).hexdigest(), len(data), len(p), zlib.crc32(p[-32:])))
    assert got == expected
    rows = ogg.media_features(documents(spark)).where("doc_id IN (9, 10)").drop("doc_id").distinct()
    assert rows.count() == 1
    assert ogg.media_features(nothing(spark)).count() == 0


PAGE = "page_id long, url string, html string, digest string, first long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGE)


HTML = "<p>ü equal</p>" * 20
PAGES = [
    (5, "http://a/ b\n", HTML), (3, "http://b/", HTML), (9, None, HTML), (3, "http://b/", HTML), (None, "http://n/", HTML), (7, "http://c/", "short"), (8, "http://d/", "short"),
    (10, "http://e/", None), (11, "http://f/", ""), (12, "http://g/", "x" * 2_000_000), (13, "http://h/", "HTTP/1.1\r\n\r\n" * 30), (None, "u", "y" * 100), (None, "u", "y" * 100),
]


def test_op3(spark):
    ws = common.Workspace(spark, "t")
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages(spark, PAGES), ws)).collect()], key=str)
    expected = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        same = [j for j, _, x in PAGES if x == h and j is not None]
        revisit = len(data) >= 100 and same and min(same) != i
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.read_archives(warc.write_archives(pages(spark, []), common.Workspace(spark, "t"))).count() == 0


def archive(records, dictionary=b""):
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink, dictionary)
    for r in records:
        writer.add(r)
    return sink.getvalue()


def record(block=b"body", **headers):
    base = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x>", "WARC-Date": "2020-01-01T00:00:00Z"} | headers
    return warc.serialise(base, block)


def test_archives_hold_one_frame_a_record():
    records = [record(f"number {i} of many like it".encode() * 5) for i in range(300)]
    dictionary = warc.train(records)
    raw = archive(records, dictionary)
    assert dictionary and struct.unpack_from("<I", raw)[0] == warc.DICTIONARY_FRAME
    assert [r.block for r in warc.read_archive(io.BytesIO(raw))] == [warc.parse(r).block for r in records]
    assert len(raw) < len(archive(records))


@pytest.mark.parametrize("bad", [
    record().replace(b"WARC/1.1", b"WARC/9.9"), record().replace(b"Content-Length: 4", b"Content-Length: 5"), record().replace(b"Content-Length: 4", b"Content-Length: x"),
    record()[:-2], record().replace(b"WARC-Date", b"WARC Date"), record(**{"WARC-Block-Digest": "sha256:AAAA"}), record().replace(b"WARC-Type: resource\r\n", b""),
])
def test_bad_records_are_refused(bad):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(archive([bad]))))


def test_bad_archives_are_refused():
    raw = archive([record(), record()])
    for bad in (b"", raw[:-3], raw[8:], b"\0" * 4 + raw[4:], raw + b"tail"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
