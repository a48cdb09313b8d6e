"""Words end at letters beyond ASCII, as in the SQL twins."""

import os
import re

from pyspark.sql import functions as F

from foliospark import catalogue
from foliospark.functions import text as tx

from .conftest import DATA, duck_rows, rows_of

TEXTS = [
    "Director: Adam Walkeré and SSN 123-45-6789é or é123-45-6788 and 212-555-0199é here",
    "Tel: +44 20 7638 1234ñ, CUSIP 64110L709ß, patent Éus US7654321B2é and ticker (NYSE: ABC)",
    "SßEDOL B0WNLY7 and ßEDOL B0WNLY8, SEDOL B0WNLY9 mail éadam.walker@harbor.com or adam.walker@harbor.comé",
    "See www.harbor.comé and éhttps://www.sec.gov/cgi-bin/x?CIK=1 CIK 1234567é Commission é7654321 LEI 5493AB00000000129178é",
    "12 First Street, Boston, CA 12345é and 12é First Street, Boston, CA 12345. By: Helen Hughesé | Presidenté",
    "marks \x1e and \x1f stand in the text: By: Helen Hughes, PresidentÉ, IRS EIN 12-3456789 and 12-3456780é",
]


def test_all_findings_with_letters_beyond_ascii(spark, duck, tmp_path):
    for name in os.listdir(DATA):
        if name != "documents.parquet":
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    rows = [(i, x, "en", f"s{i % 2}", len(x)) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows_of(catalogue.queries()["all_findings"](spark, str(tmp_path))) == duck_rows(con, catalogue.oracle_sql()["all_findings"])


def test_edges_of_ascii_words(spark):
    texts = ["Paul", "Paulé", "éPaul", "a Paul.", "", "Paul_", "1Paul", "x Paul"]
    for pattern in (r"\bPaul\b", r"(?i)\b(?:(p)[a-z]+)\b", r"\b\(?Paul", r"\b[a-z]*Paul", r"l\b"):
        frame = spark.createDataFrame([(x,) for x in texts], "v string").select("v", tx.like(F.col("v"), pattern).alias("ok"))
        assert {r.v: r.ok for r in frame.collect()} == {x: re.search(pattern, x, re.ASCII) is not None for x in texts}, pattern


def test_matches_and_spans_of_texts_with_marks(spark):
    texts = ["a1b2", "a1\x1eb2", "\x1f a1 \x1f", "none", None]
    frame = spark.createDataFrame([(x,) for x in texts], "v string")
    got = frame.select("v", tx.matches(F.col("v"), "([a-z])([0-9])", (2, 1)).alias("m"), tx.spans(F.col("v"), "([a-z])([0-9])", (2, 1)).alias("s")).collect()
    for r in got:
        found = list(re.finditer("([a-z])([0-9])", r.v or ""))
        assert [tuple(x) for x in r.m or []] == [(m[2], m[1]) for m in found]
        assert [tuple(x) for x in r.s] == [(m.start(), m[0], m[2], m[1]) for m in found]
