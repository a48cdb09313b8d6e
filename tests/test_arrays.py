"""Running folds and match positions against Python."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import arrays, text as tx

SIZES = [0, 1, 63, 64, 65, 127, 4095, 4096, 4097, 9000]


def test_running_maximum(spark):
    rows = [(n, [(i * 7919) % 1013 for i in range(n)]) for n in SIZES] + [(-1, None)]
    frame = spark.createDataFrame(rows, "n int, xs array<int>")
    best = arrays.scan(F.col("xs"), F.lit(-1), "int", lambda m, x: (F.greatest(m, x), m))
    for n, xs, got in frame.select("n", "xs", best).collect():
        want = None if xs is None else [max(xs[:i], default=-1) for i in range(len(xs))]
        assert got == want, n


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab1.é\U0001f600 ", max_size=60), min_size=1, max_size=20))
def test_spans_with_groups_equal_finditer(spark, texts):
    pattern = r"([0-9]+)\.([ab]?)"
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.spans(F.col("t"), pattern, (2, 0, 1)).alias("x"))
    got = {r.i: [tuple(x) for x in r.x] for r in frame.collect()}
    assert got == {i: [(m.start(), m[0], m[2], m[0], m[1]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_many_spans_in_one_text_cost_in_proportion(spark):
    def seconds(n):
        frame = spark.range(1).select(F.repeat(F.lit("10.0.0.1 "), n).alias("t"))
        began = time.time()
        starts = frame.select(tx.spans(F.col("t"), "[0-9][0-9.]+").alias("x")).selectExpr("x.s AS s").first()["s"]
        assert starts == [9 * i for i in range(n)]
        return time.time() - began

    seconds(1000)
    assert seconds(100_000) < 20 * max(0.5, seconds(10_000))


def test_alternatives_are_told_by_their_first_letter():
    looked = tx.first_letters(r"(?i)(?:Agent|Officer|Co\s+(?:A|B)|By):\s*([A-Z]+)")
    assert looked == r"(?i)(?:(?=[ABCO])(?:Agent|Officer|Co\s+(?:A|B)|By)):\s*([A-Z]+)"
    assert re.findall(looked, "an agent: ADAM, co b: BEN, buy: X") == ["ADAM", "BEN"]
    for left in (r"(?:a?b|c|d|e)", r"(?:[ab]|c|d|e)", r"(?:a|b|c)", r"(?:a||b|c|d)", r"(?!a|b|c|d)e", r"[(a|b|c|d)]", r"\(a|b|c|d\)"):
        assert tx.first_letters(left) == left


def test_long_runs_of_letters_by_a_sign_are_read_once(spark):
    from foliospark.operators import people

    texts = ["adam.walker@x.com ab.cd.ef@x a.b@x x1.yz@q " + "x" * 300_000, "y" * 300_000 + "@ a.b.c.d@x"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    began = time.time()
    rows = frame.select(people.FROM_EMAIL.values(F.col("text")).alias("v")).collect()
    assert [r.v for r in rows] == [["Adam Walker", "Ab.cd Ef"], ["B.c D"]] and time.time() - began < 60
