"""Layout in the page's row against the same rules word by word."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark import catalogue
from foliospark.operators import layout

from .conftest import DATA, duck_rows, rows_of

NAMES = ["line_columns", "column_sides", "word_lines_anchored", "multicolumn_pages", "column_balance", "table_grid", "nearest_column_cells"]


@pytest.mark.parametrize("name", NAMES)
def test_no_word_is_shuffled(spark, name):
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Window", "Sort "))


@pytest.mark.parametrize("name", NAMES)
def test_empty_words_and_texts_of_one_sheet_and_of_more(spark, duck, tmp_path, name):
    texts = ["", " ", "a", "a  b ", " ".join("abcdefgh"), "  ".join(["word"] * 150), " ".join(f"w{i}" * (i % 4) for i in range(200)), " ".join(f"w{i}" * (i % 3) for i in range(701)), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows_of(catalogue.queries()[name](spark, str(tmp_path))) == duck_rows(con, catalogue.oracle_sql()[name])


def test_sheets_of_repeated_ids_are_one_page(spark, tmp_path):
    rows = [(1, " ".join(["a"] * 12)), (1, " ".join(["b"] * 12)), (2, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["column_balance"](spark, str(tmp_path)).collect()
    assert [(r.page, r.left + r.right + r.centre) for r in got] == [("1:0", 24)]


def test_cells_equal_the_join_with_the_centres(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", i, f"t{i}", rng.randrange(0, 400), i // 6) for p in range(12) for i in range(rng.choice([1, 2, 7, 40]))]
    words = spark.createDataFrame(rows, "page string, word_id int, text string, x0 int, line int").withColumn("x1", F.col("x0") + 9)
    placed = layout.nearest_column(words, layout.clusters(words))
    assert rows_of(layout.nearest_cells(words)) == rows_of(placed.select("page", "word_id", "column"))
    assert rows_of(layout.page_grid(words)) == rows_of(layout.grid(placed))
