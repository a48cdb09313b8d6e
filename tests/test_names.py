"""Name filters by worked examples, each judged by hand against the rules."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import alias, companies, people
from foliospark.plans import detection

PERSONS = {
    "Adam Walker": True, "Helen Sterling": True, "Diana King": True, "Offer Letter": False, "Grant Date Fair": False,
    "Financing Activities": False, "Director Compensation": False, "Fifth Third": False, "Rule Walker": False, "Walker II": False,
    "Walker 8.1": False, "Leadership Structur": False, "Compris Ed": False, "Adding Cardtronics": False, "Global Presence": False,
    "Growth Rate": False, "Helen Development": False, "Carlos Ray™": False, "George Officer": False, "Brenda Plan": False,
}
FINAL = {
    "Harbor Energy Inc.": True, "Company": False, "Group Company": False, "Company Inc.": False, "Company Bank": True,
    "Corporate Foods Ltd": False, "Consolidated Worldpay Group": True, "Group, Inc": False, "Summit Joined Media": False,
    "Best Company Index": False, "Committee Going": True, "Committee Media Inc": True, "The Harbor Group": True,
    "Table of Contents Inc": True, "Liberty Motors Officer": True, "One Two Three Four Five Six Seven": True,
    "Digital Systems Corp": True, "Harbor, LLC": True,
}
NOT_RECOGNISED = {"Company Bank", "Committee Going", "The Harbor Group", "Table of Contents Inc", "Liberty Motors Officer", "One Two Three Four Five Six Seven"}


def judged(spark, names, predicate):
    frame = spark.createDataFrame([(n,) for n in names], "value string")
    return {r.value: r.ok for r in frame.select("value", predicate(F.col("value")).alias("ok")).collect()}


def test_examples_are_those_of_the_queries():
    assert set(PERSONS) == set(detection.PHRASE_NAMES.split("|")) and set(FINAL) == set(detection.COMPANY_NAMES.split("|"))


def test_person_phrases(spark):
    assert judged(spark, PERSONS, people.no_phrase) == PERSONS


def test_company_words(spark):
    assert judged(spark, FINAL, companies.final_name) == FINAL
    assert judged(spark, FINAL, companies.recognised_name) == {n: ok and n not in NOT_RECOGNISED for n, ok in FINAL.items()}


@pytest.mark.parametrize("text, ok", [
    ("The shop of Harbor Energy Inc. sells boats.", True), ("Under the loan agreement Harbor Energy Inc. pays.", False),
    ("Exact name of registrant: Harbor Energy Inc. (Commission)", True), ("Harbor Energy Inc." + " x" * 150 + " agreement", True),
])
def test_company_context(spark, text, ok):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(companies.context_allows(F.col("t"), F.lit("Harbor Energy Inc.")).alias("ok")).first().ok is ok


def test_generation_suffixes(spark):
    names = ["John Smith", "J. Smith", "John Smith Jr", "John Smith Jr.", "JOHN SMITH III", "Smith John"]
    frame = spark.createDataFrame([(n,) for n in names], "v string")
    got = {r.v: r.a for r in frame.select("v", alias.person(F.col("v")).alias("a")).collect()}
    given, family = got["John Smith"].split(" ")
    assert got["J. Smith"] == f"{given[0]}. {family}" and got["John Smith Jr"] == f"{given} {family} Jr" and got["John Smith Jr."] == f"{given} {family} Jr."
    assert got["JOHN SMITH III"] == f"{given} {family} III".upper() and got["Smith John"] != got["John Smith"]


def test_aliased_report_is_in_order(spark):
    from foliospark.operators import report

    rows = [("b", 2, "ssn", "123-45-6789"), ("a", 1, "ssn", "123-45-6789"), ("a", 3, "email", "x@y.org"), ("a", 2, "email", "x@y.org"), ("a", 1, "email", "a@y.org")]
    got = report.aliased_report(spark.createDataFrame(rows, "document string, page long, type string, value string")).collect()
    assert [(r.document, r.label, r.value, r.pages) for r in got] == [("a", "Email", "a@y.org", "p.1"), ("a", "Email", "x@y.org", "p.2, p.3"), ("a", "SSN", "123-45-6789", "p.1"), ("b", "SSN", "123-45-6789", "p.2")]
    assert got[2].alias == got[3].alias != got[0].alias and all(r.alias != r.value for r in got)


def test_page_range(spark):
    from foliospark.operators import operations as ops

    pages = spark.range(1, 10).withColumnRenamed("id", "page")
    pick = lambda *a: sorted(r.page for r in ops.page_range(pages, *a).collect())
    assert pick() == list(range(1, 10)) and pick(3) == list(range(3, 10)) and pick(None, 3) == [1, 2] and pick(4, 6) == [4, 5] and pick(6, 4) == []


def test_executives(spark):
    lines = [
        "Adam Walker, President", "Treasurer: Brenda Turner", "/s/ Carlos M. Hughes", "Signed: Diana Foster", "Name of Officer: Edward Griffin",
        "Fiona Coleman | Director", "George Bennett - Secretary", "Helen Turner CEO", "New York, President", "The Walker, President", "Adam Adam, CFO",
        "By: Ann Lee in table of contents", "Secretary",
    ]
    pages = spark.createDataFrame([(str(i), 1, line + " .. " + "." * 10) for i, line in enumerate(lines)], "document string, page long, text string")
    got = {(int(r.document), r.value) for r in people.executive_names(pages).collect()}
    assert got == {
        (0, "Adam Walker"), (1, "Brenda Turner"), (2, "Carlos M. Hughes"), (3, "Diana Foster"), (4, "Edward Griffin"),
        (5, "Fiona Coleman"), (6, "George Bennett"), (7, "Helen Turner"),
    }


def test_long_runs_of_letters_cost_in_proportion(spark):
    import time

    took = []
    for n in (100_000, 200_000):
        pages = spark.createDataFrame([("d", 1, "President " + "x" * n)], "document string, page long, text string")
        began = time.time()
        assert people.executive_names(pages).count() == 0
        took.append(time.time() - began)
    assert took[1] < 30


@pytest.mark.parametrize("names, recognised, kept", [
    (["Adam Walker", "Brenda Plan"], ["adam walker jr"], ["Adam Walker"]), (["Adam Walker", "Brenda Plan"], ["Other One"], ["Adam Walker", "Brenda Plan"]),
    ([], ["Adam"], []), (["Adam Walker"], [], ["Adam Walker"]),
])
def test_validated_or_all(spark, names, recognised, kept):
    frame = spark.createDataFrame([(names, recognised)], "n array<string>, r array<string>")
    assert frame.select(people.validated_or_all(F.col("n"), F.col("r")).alias("k")).first().k == kept


def test_second_pass(spark):
    text = "Harbor Energy Inc. met Cedar Foods LLC. Exact name of registrant Summit Media House" + " . " * 80 + "Pioneer Motors sold Group Inc to Energy"
    organisations = ["Harbor Energy", "Cedar  Foods LLC", "Summit Media House", "Pioneer Motors", "Group Inc", "lower Corp", "The Offer Co", "Cedar Foods LLC"]
    frame = spark.createDataFrame([(text, organisations, ["Harbor Energy Inc."])], "t string, o array<string>, f array<string>")
    got = frame.select(companies.second_pass(F.col("t"), F.col("o"), F.col("f")).alias("k")).first().k
    assert got == ["Cedar Foods LLC", "Summit Media House"]


def test_pairs_with_a_middle_part(spark):
    from foliospark.operators.detect import findings

    pages = spark.createDataFrame([("d", 1, "saw Adam John M. Smith today"), ("d", 2, "saw Adam McDonald today"), ("d", 3, "saw Turner, Brenda today")], "document string, page long, text string")
    got = {(r.page, r.value) for r in findings(pages, [people.PAIR, people.LAST_FIRST]).collect()}
    assert got == {(1, "Adam John M. Smith"), (2, "Adam McDonald"), (3, "Brenda Turner")}
