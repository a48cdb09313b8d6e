"""Worked examples and invariants of single operators."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import alias, detect, layout, people, report
from foliospark.operators import operations as ops
from foliospark.operators import terms as t
from foliospark.sources import adapters
from foliospark.streaming import streams


def pages(spark, *texts):
    return spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(texts)], "document string, page int, text string")


def found(spark, detector, *texts):
    return sorted((r.page, r.value) for r in detect.findings(pages(spark, *texts), [detector]).collect())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("value, firm, expected", [
    ("2/17/2026 S. Ferris", False, "s. ferris"), ("Charles Drucker(7)(8", False, "charles drucker"), ("David Karnstedt - - -", False, "david karnstedt"),
    ("stephanie l. ferris", False, "stephanie ferris"), ("john a smith", False, "john smith"), ("Ernst & Young, LLP", True, "ernst & young llp"), ("Ernst & Young LLP", True, "ernst & young llp"),
])
def test_dedup_cleaner(spark, value, firm, expected):
    assert one(spark, value, lambda c: report.clean_for_dedup(c, firm)) == expected
    assert one(spark, expected, lambda c: report.clean_for_dedup(c, firm)) == expected


@pytest.mark.parametrize("value, expected", [("2/17/2026 S. Ferris", "S. Ferris"), ("Charles Drucker 11,925 148,940", "Charles Drucker"), ("Lars Anderson /s/", "Lars Anderson"), ("Charles Drucker(7)(8", "Charles Drucker")])
def test_name_cleaner(spark, value, expected):
    assert one(spark, value, people.clean_name) == expected


def test_keyword_as_first_name(spark):
    assert one(spark, "Grant Williams", people.plausible) and not one(spark, "Grant Date", people.plausible)


def test_prefix_roots_are_shortest(spark):
    rows = spark.createDataFrame([("t", x) for x in ("a b c", "a b d", "a b", "x", "x y", "ab c")], "type string, clean string")
    assert {r.clean: r.root for r in report.prefix_roots(rows).collect()} == {"a b c": "a b", "a b d": "a b", "a b": "a b", "x": "x", "x y": "x", "ab c": "ab c"}


def test_merged_names_show_the_plain_form(spark):
    rows = spark.createDataFrame([("d", 1, "person_name", "JOHN SMITH"), ("d", 2, "person_name", "John Smith"), ("d", 3, "person_name", "John Smith BOON")], "document string, page int, type string, value string")
    assert [(r.value, r.seen) for r in report.dedup_prefix(rows).collect()] == [("John Smith", 3)]


def test_phone_examples(spark):
    assert found(spark, detect.PHONE_US, "reach +1 (743) 555-3824 now") == [(1, "743) 555-3824")]
    assert found(spark, detect.PHONE_INTL, "Tel: +44 (0)20 7638 0129 or so") == [(1, "(0)20 7638 0129"), (1, "+44 (0)20 7638 0129")]
    assert found(spark, detect.PHONE_INTL, "Tel: +44 20 7638 0129 or so") == [(1, "+44 20 7638 0129")]
    assert found(spark, detect.PHONE_INTL, "Tel: 025 2024 2023 or so") == []


def test_identifier_examples(spark):
    assert found(spark, detect.CUSIP, "CUSIP 64110LAH9 here") == [(1, "64110LAH9")]
    assert found(spark, detect.ISIN_OTHER, "ISIN GB0002374006 here") == [(1, "GB0002374006")]
    assert found(spark, detect.SEDOL, "SEDOL B0WNLY7 here") == [(1, "B0WNLY7")]
    assert found(spark, detect.FIGI, "code BBG000BLNQ16 here") == [(1, "BBG000BLNQ16")]
    assert found(spark, detect.LEI, "LEI 549300VGEJKB7SVUZR78 here") == [(1, "549300VGEJKB7SVUZR78")]
    assert found(spark, detect.PATENT, "Patent US7654321B2 here") == [(1, "US7654321B2")]


def test_firm_examples(spark):
    rows = detect.firms(pages(spark, "Seen. Smith Jones LLP auditors of it", "it was by Smith Jones LLP there", "Seen. Smith Jones L.L.P. auditors"))
    assert [(r.page, r.type, r.value) for r in rows.collect()] == [(1, "auditor", "Smith Jones LLP")]


def test_emails_are_validated(spark):
    assert found(spark, detect.EMAIL, "a.b@firm.com, latest@x.com, x@y.zz, B@C.ORG and b..c@d.com") == [(1, "a.b@firm.com"), (1, "b@c.org")]


def test_null_empty_and_short_pages_have_no_findings(spark):
    assert detect.findings(pages(spark, None, "", "a@b.com", "   \n "), detect.SIMPLE).count() == 0
    assert detect.findings(pages(spark).where("false"), detect.SIMPLE).count() == 0


def test_anchored_lines(spark):
    tops = [0, 4, 7, 20, 25, 26]
    rows = spark.createDataFrame([(1, i, y, 0) for i, y in enumerate(tops)], "page int, word_id int, top int, x0 int")
    assert [r.line_no for r in layout.lines_anchored(rows).orderBy("word_id").collect()] == [1, 1, 2, 3, 3, 4]


def test_quality_example(spark):
    tables = spark.createDataFrame([("d", n, 1, 2) for n in (1, 2)] + [("d", n, 2, 3) for n in (1, 2)], "document string, table_id int, row int, width int")
    paragraphs = spark.createDataFrame([("d", "")] * 40, "document string, text string")
    assert layout.quality(tables, paragraphs).first().score == 88


def test_backoff_and_sizes(spark):
    assert [r.s for r in spark.range(1, 8).select(ops.backoff(F.col("id"), 1.0, 2.0, 30.0).alias("s")).collect()] == [1, 2, 4, 8, 16, 30, 30]


def test_hocr_and_quads(spark):
    hocr = "<span class='ocrx_word' title='bbox 1 2 30 40; x_wconf 9'><b>Hi</b></span><span class='ocrx_word' title='bbox 5 6 7 8'> </span>"
    rows = adapters.hocr_words(spark.createDataFrame([(1, hocr)], "page int, hocr string")).collect()
    assert [(r.text, r.x0, r.x1, r.top, r.bottom, r.conf) for r in rows] == [("Hi", 1, 30, 2, 40, 95)]
    box = [[1.0, 2.0], [9.0, 2.0], [9.0, 5.0], [1.0, 5.0]]
    quads = spark.createDataFrame([(1, box, "a", 90.0), (1, box, "b", 0.9), (1, box, " ", 90.0)], "page int, box array<array<double>>, text string, conf double")
    assert [(r.text, r.x0, r.x1, r.top, r.bottom) for r in adapters.quad_boxes(quads).collect()] == [("a", 1, 9, 2, 5)]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"two")
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "c.txt").write_text("START | convert | ok | pages=3\nEND | convert | ok\n")
    assert [r.path[-5:] for r in adapters.list_files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    lines = adapters.log_lines(spark, str(tmp_path / "c.txt"))
    assert ops.log_stats(lines).first().lines == 2
    assert adapters.audit_log(lines).first().fields == {"pages": "3"}


def test_exports(spark, tmp_path):
    rows = report.csv_rows(detect.findings(pages(spark, "write to a.b@firm.com"), [detect.EMAIL]))
    for kind in report.EXPORTS:
        report.export(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().value == "a.b@firm.com"
    with pytest.raises(ValueError):
        report.export(rows, str(tmp_path / "x"), "excel")


def test_windowed_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS account UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a'").write.parquet(str(tmp_path / "in"))
    stream = streams.page_stream(spark, str(tmp_path / "in"), "ts timestamp, account string")
    assert [r.used for r in streams.drain(streams.windowed_counter(stream), str(tmp_path / "cp"), "complete").collect()] == [2]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab1 @.-+()0279\n", max_size=60), min_size=1, max_size=20))
def test_spans_equal_finditer(spark, texts):
    pattern = r"[0-9]+[.-][0-9]+"
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, v string").select("i", F.explode(tx.spans(F.col("v"), pattern)).alias("x")).select("i", "x.s", "x.m")
    assert sorted(map(tuple, rows.collect())) == sorted((i, m.start(), m[0]) for i, x in enumerate(texts) for m in re.finditer(pattern, x))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ0189-.@ ", min_size=1, max_size=30), min_size=1, max_size=10))
def test_digit_aliases_keep_the_format(spark, values):
    rows = spark.createDataFrame([(x,) for x in values], "v string").select("v", alias.digits(F.col("v")).alias("a")).collect()
    assert all(re.sub("[0-9]", "0", r.v) == re.sub("[0-9]", "0", r.a) for r in rows)


def test_consolidation_ignores_document_order(spark):
    data = [("d1", 1, "email", "A@x.com"), ("d2", 3, "email", "a@x.com"), ("d1", 5, "email", "a@x.com")]
    kind = "document string, page int, type string, value string"
    a, b = (report.consolidated_report(report.consolidate(spark.createDataFrame(rows, kind))).collect() for rows in (data, data[::-1]))
    assert a == b and a[0].documents == "d1 p.1, p.5; d2 p.3"


def test_pages_are_sorted_and_distinct(spark):
    rows = spark.createDataFrame([("d", p, "ssn", "1") for p in (3, 1, 3)], "document string, page int, type string, value string")
    assert report.info_table(rows).first().pages == [1, 3] and report.document_report(rows).first().pages == "p.1, p.3"


def test_terms_are_consistent():
    assert set(t.BARE_TLDS) <= set(t.WEB_TLDS) and len(t.STATES) == 51


def test_columns_and_alignment_by_hand(spark):
    from foliospark.operators import layout

    rows = [("two", n // 4, 100 + n * 8 + (200 if n > 7 else 0)) for n in range(16)] + [("one", n // 4, 40 * n) for n in range(16)] + [("few", 0, 10)]
    words = spark.createDataFrame(rows, "page string, line int, x0 int")
    assert {r.page: r.column_count for r in layout.page_columns(words, 1000).collect()} == {"two": 2, "one": 1, "few": 1}
    met = [("a", line, x) for line, xs in enumerate([(0, 100), (60, 110), (65, 300), (70,), (400,), (0,)]) for x in xs]
    got = layout.aligned_lines(spark.createDataFrame(met, "page string, line int, x0 int")).collect()
    assert [(r.page, r.aligned, r.has_table) for r in got] == [("a", 3, False)]
