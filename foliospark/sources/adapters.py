"""Adapters for inputs that are not tables: HTML, hOCR, files, logs, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_words


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder (not below it) in path order, without their content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "modificationTime", "length").orderBy("path")


def file_hash(files: DataFrame) -> DataFrame:
    return files.select("path", F.md5("content").alias("doc_md5"))


def image_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(ascii_words(r"(?i)<img\b")))


def hocr_words(pages: DataFrame) -> DataFrame:
    """Word boxes of hOCR pages ``(page, hocr)``, whatever the element and the order of its
    attributes; ``rotate`` is 0 where none is given. Words without text or box are dropped,
    confidence is 95."""
    element = r"""(?is)<([a-z]+)\b([^>]*\bocrx_word\b[^>]*)>(.*?)</\1>"""
    parts = [F.regexp_extract_all("hocr", F.lit(element), F.lit(g)).alias(f"g{g}") for g in (2, 3)]
    rows = pages.select("page", F.posexplode(F.arrays_zip(*parts)).alias("word_id", "w"))
    text = F.trim(F.regexp_replace("w.g3", "<[^>]*>", ""))
    n = lambda g: F.regexp_extract("w.g2", r"\bbbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)", g).try_cast("int")
    turned = F.coalesce(F.regexp_extract("w.g2", r"\brotate\s+(-?\d+)", 1).try_cast("int"), F.lit(0))
    found = rows.select("page", "word_id", text.alias("text"), n(1).alias("x0"), n(3).alias("x1"), n(2).alias("top"), n(4).alias("bottom"), F.lit(95).alias("conf"), turned.alias("rotate"))
    return found.where((F.col("text") != "") & F.col("x0").isNotNull())


def quad_boxes(points: DataFrame) -> DataFrame:
    """Rectangles of four-point boxes ``(page, box array<array<double>>, text, conf)``;
    confidence above 30 is asked for before fractions are scaled to percent."""
    xs, ys = F.transform("box", lambda p: p[0]), F.transform("box", lambda p: p[1])
    kept = points.where((F.trim("text") != "") & (F.col("conf") > 30))
    return kept.select("page", "text", F.array_min(xs).cast("int").alias("x0"), F.array_max(xs).cast("int").alias("x1"), F.array_min(ys).cast("int").alias("top"), F.array_max(ys).cast("int").alias("bottom"), F.when(F.col("conf") < 1, F.col("conf") * 100).otherwise(F.col("conf")).cast("int").alias("conf"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def audit_log(lines: DataFrame) -> DataFrame:
    """``START | op | status | k=v | ...`` lines as columns and a map."""
    parts = F.transform(F.split("value", r"\|"), lambda p: F.trim(p))
    pairs = F.filter(parts, lambda p: F.contains(p, F.lit("=")))
    return lines.select(F.get(parts, 0).alias("event"), F.get(parts, 1).alias("op"), F.get(parts, 2).alias("status"), F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", "")))).alias("fields"))


def settings_json(rows: DataFrame, path: str) -> Column:
    """A dotted path in a JSON settings column."""
    return F.get_json_object("json", "$." + path)


def audit_lines(events: DataFrame) -> DataFrame:
    """``event, op, status, fields`` as one line each, fields in the order of their names."""
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    parts = F.concat(F.array("event", "op", "status"), F.coalesce(pairs, F.array().cast("array<string>")))
    return events.select(F.array_join(parts, " | ").alias("value"))


def append_audit(events: DataFrame, path: str) -> None:
    """Add the lines to the log at ``path``; what :func:`log_lines` and :func:`audit_log` read."""
    audit_lines(events).write.mode("append").text(path)
