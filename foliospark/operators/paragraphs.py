"""Paragraph repairs: questions and answers, contents entries, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOC = r"^(.+?)\.{2,}\s*(\d+)$"
URL = r"https?://[^\s)]+"


def qa_split(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that hold ``Q: ... A: ...`` become a question and an answer row."""
    text = F.trim("text")
    both = F.regexp_like(text, F.lit(r"^Q:\s+.*\sA:\s"))
    parts = F.when(both, F.array(F.regexp_extract(text, r"^(Q:\s+.*?)\s+A:\s", 1), F.regexp_extract(text, r"^Q:\s+.*?\s+(A:\s.*)$", 1))).otherwise(F.array(text))
    rows = paragraphs.select("document", "idx", F.posexplode(parts).alias("part", "text"))
    kind = F.when(F.startswith("text", F.lit("Q:")), "question").when(F.startswith("text", F.lit("A:")), "answer").otherwise("text")
    return rows.select("document", "idx", "part", kind.alias("kind"), "text")


def toc_entries(paragraphs: DataFrame, width: int = 50) -> DataFrame:
    """Title and page of contents lines, refilled with dots to one width."""
    t = F.trim("text")
    title, page = F.trim(F.regexp_extract(t, TOC, 1)), F.regexp_extract(t, TOC, 2)
    rows = paragraphs.where(F.regexp_like(t, F.lit(TOC))).select("document", "idx", title.alias("title"), page.cast("int").alias("page"))
    dots = F.repeat(F.lit("."), F.greatest(F.lit(2), F.lit(width) - F.length("title")))
    return rows.withColumn("line", F.concat("title", F.lit(" "), dots, F.lit(" "), F.col("page").cast("string")))


def link_parts(text: Column) -> Column:
    """The text cut into plain pieces and links, in order."""
    links, plain = F.regexp_extract_all(text, F.lit(URL), F.lit(0)), F.split(text, URL, -1)
    pieces = F.flatten(F.transform(plain, lambda p, i: F.array(F.struct(F.lit(False).alias("link"), p.alias("text")), F.struct(F.lit(True).alias("link"), F.coalesce(F.get(links, i), F.lit("")).alias("text")))))
    return F.filter(pieces, lambda x: x["text"] != "")


def paragraphs_of(pages: DataFrame) -> DataFrame:
    """Lines grouped to paragraphs at blank lines: cut there, other breaks are blanks."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t]*(?:\n[ \t]*)+"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")
    return pages.select("document", "page", F.posexplode(parts).alias("idx", "text"))
