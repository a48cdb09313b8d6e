"""Decoders and recognisers plugged in from outside, on small fixtures."""

from foliospark.sources import plugins


def decoder():
    def pages(content: bytes):
        return [(i + 1, part.decode()) for i, part in enumerate(content.split(b"\f"))]

    return pages


def recogniser():
    import re

    return lambda text: [(m.start(), m.end(), "PERSON") for m in re.finditer("[A-Z][a-z]+ [A-Z][a-z]+", text)]


def test_decode_reports_failures_as_rows(spark):
    files = spark.createDataFrame([("a", bytearray(b"one\ftwo")), ("b", bytearray(b"\xff"))], "path string, content binary")
    rows = {(r["path"], r["page"], r["text"], (r["error"] or "").split(":")[0]) for r in plugins.decode(files, decoder, plugins.PAGES).collect()}
    assert rows == {("a", 1, "one", ""), ("a", 2, "two", ""), ("b", None, None, "UnicodeDecodeError")}
    assert plugins.decode(files.where("path = 'c'"), decoder, plugins.PAGES).count() == 0


def test_entities(spark):
    pages = spark.createDataFrame([("d", 1, "met Ann Smith and Ann Smith"), ("d", 2, None), ("d", 3, "")], "document string, page int, text string")
    found = plugins.entities(pages, recogniser)
    assert [len(r["entities"]) for r in found.orderBy("page").collect()] == [2, 0, 0]
    assert [tuple(r) for r in plugins.entity_names(found, "PERSON").collect()] == [("d", 1, "Ann Smith")]
