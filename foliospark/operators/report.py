"""Reports over findings: page lists, roll-ups, consolidation, summaries.

Every aggregation is two-level where a value can stand in very many documents: pages
are gathered per document, and documents are counted per value, not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import terms as t
from .alias import alias


def page_list(pages: Column) -> Column:
    """``p.1, p.2``"""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("p."), p.cast("string"))), ", ")


def info_table(findings: DataFrame) -> DataFrame:
    """Per document, type and value: distinct pages in order, and all occurrences."""
    return findings.groupBy("document", "type", "value").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.count(F.lit(1)).alias("occurrences"))


def label(kind: Column) -> Column:
    """The type's label; by default its words, capitalised."""
    table = F.create_map(*(F.lit(x) for pair in t.LABELS.items() for x in pair))
    return F.coalesce(F.element_at(table, kind), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def document_report(findings: DataFrame) -> DataFrame:
    """One row per document, type and value with its page list."""
    return info_table(findings).select("document", "type", label(F.col("type")).alias("label"), "value", page_list(F.col("pages")).alias("pages"))


def aliased_report(findings: DataFrame) -> DataFrame:
    """The document report with the alias of each value, in the order of documents, labels
    and values (a range sort, so no task holds a whole report)."""
    rows = document_report(findings).withColumn("alias", alias(F.col("type"), F.col("value")))
    return rows.orderBy("document", "label", "value", "type")


def first_keyword(value: Column, keywords: list[str]) -> Column:
    """The first keyword, in list order, that the value contains; null if none."""
    if not keywords:
        return F.lit(None).cast("string")
    return F.coalesce(*(F.when(F.contains(F.lower(value), F.lit(k.lower())), F.lit(k)) for k in keywords))


def rollup_single(findings: DataFrame, keywords: list[str]) -> DataFrame:
    """Per document: values that contain a keyword become one row under it."""
    key = F.coalesce(F.initcap(first_keyword(F.col("value"), keywords)), F.col("value"))
    return findings.groupBy("document", "type", key.alias("value")).agg(F.sort_array(F.collect_set("page")).alias("pages"))


def rollup_consolidated(findings: DataFrame, keywords: list[str]) -> DataFrame:
    """Over all documents: values without a keyword are keyed by their lower-case form,
    and variants are merged, none lost."""
    hit = first_keyword(F.col("value"), keywords)
    keyed = findings.withColumn("key", F.coalesce(F.lower(hit), F.lower("value"))).withColumn("shown", F.coalesce(hit, "value"))
    per_document = keyed.groupBy("type", "key", "document").agg(F.min("shown").alias("shown"), F.sort_array(F.collect_set("page")).alias("pages"))
    return per_document.groupBy("type", "key").agg(F.min("shown").alias("value"), F.count(F.lit(1)).alias("documents"), F.sum(F.size("pages")).alias("page_count"))


def normal_key(kind: Column, value: Column) -> Column:
    return F.when(kind == "email", F.lower(value)).otherwise(value)


def consolidate(findings: DataFrame) -> DataFrame:
    """``type, key, document, best, pages``: a row per value and document, with the best
    form met there and its pages.

    A value that stands in very many documents stays in as many rows: no row and no
    task gathers its documents."""
    keyed = findings.withColumn("key", normal_key(F.col("type"), F.col("value")))
    shown = F.struct(((F.col("value") == F.upper("value")) & (F.col("value") != F.lower("value"))).alias("upper"), (-F.length("value")).alias("n"), F.col("value").alias("v"))
    return keyed.groupBy("type", "key", "document").agg(F.min(shown).alias("best"), F.sort_array(F.collect_set("page")).alias("pages"))


def consolidated_values(consolidated: DataFrame) -> DataFrame:
    """``type, key, value, documents, pages``: per value the form to show and its counts.
    The best form is not all upper-case, then longer, then first in order."""
    merged = consolidated.groupBy("type", "key").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("documents"), F.sum(F.size("pages")).alias("pages"))
    return merged.select("type", "key", F.col("best.v").alias("value"), "documents", "pages")


#: Documents in one line of the consolidated report.
REPORT_PART = 1_000


def consolidated_report(consolidated: DataFrame, part: int = REPORT_PART) -> DataFrame:
    """``doc p.1, p.2; doc2 p.3`` per value, in parts of at most ``part`` documents, so
    that no line grows with the corpus."""
    order = Window.partitionBy("type", "key").orderBy("document")
    placed = consolidated.withColumn("n", F.row_number().over(order) - 1).withColumn("part", F.floor(F.col("n") / part))
    place = F.struct("document", F.concat_ws(" ", "document", page_list(F.col("pages"))).alias("text"))
    lines = placed.groupBy("type", "key", "part").agg(F.sort_array(F.collect_list(place)).alias("places"))
    shown = consolidated_values(consolidated).select("type", "key", "value")
    return lines.join(shown, ["type", "key"]).select(label(F.col("type")).alias("label"), "value", "part", F.array_join(F.col("places.text"), "; ").alias("documents"))


def summary(findings: DataFrame) -> DataFrame:
    """Items and occurrences per type, and in total under the type ``(all)``."""
    info = info_table(findings)
    rolled = info.rollup("type").agg(F.count(F.lit(1)).alias("items"), F.sum("occurrences").alias("occurrences"))
    return rolled.select(F.coalesce("type", F.lit("(all)")).alias("type"), "items", "occurrences")


def consolidated_summary(consolidated: DataFrame) -> DataFrame:
    """Per type: values, documents that have any, and mentions (value and document)."""
    return consolidated.groupBy("type").agg(F.countDistinct("key").alias("items"), F.countDistinct("document").alias("documents"), F.count(F.lit(1)).alias("document_mentions"))


def image_findings(images: DataFrame) -> DataFrame:
    """Image counts as findings of their own type."""
    noun = F.when(F.col("image_count") == 1, " image").otherwise(" images")
    return images.select("document", "page", F.lit("image").alias("type"), F.concat(F.col("image_count").cast("string"), noun).alias("value"))


def with_images(findings: DataFrame, images: DataFrame) -> DataFrame:
    """Findings, and the image counts among them."""
    return findings.unionByName(image_findings(images))


def document_totals(findings: DataFrame, images: DataFrame) -> DataFrame:
    """Per document: findings, pages with any, and images; a document with either is named."""
    found = findings.select("document", "page", F.lit(1).alias("n"), F.lit(0).alias("images"))
    shown = images.select("document", F.lit(None).cast("long").alias("page"), F.lit(0).alias("n"), F.col("image_count").alias("images"))
    rows = found.unionByName(shown)
    return rows.groupBy("document").agg(F.sum("n").alias("findings"), F.countDistinct("page").alias("pages_with_findings"), F.sum("images").alias("images"))


def json_summary(findings: DataFrame) -> DataFrame:
    """Per document one JSON object: its items, its occurrences and its items by type. Its
    findings are the rows of :func:`csv_rows`; no row gathers them."""
    per_type = info_table(findings).groupBy("document", "type").agg(F.count(F.lit(1)).alias("items"), F.sum("occurrences").alias("occurrences"))
    types = F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "items"))))
    rows = per_type.groupBy("document").agg(F.sum("items").alias("total_items"), F.sum("occurrences").alias("total_occurrences"), types.alias("types"))
    return rows.select("document", F.to_json(F.struct("document", F.struct("total_items", "total_occurrences", "types").alias("summary"))).alias("json"))


def text_report(findings: DataFrame) -> DataFrame:
    """Fixed-width lines: label 30, value cut to 38 in 40, pages 30."""
    rows = document_report(findings)
    cut = lambda c, n: F.rpad(F.col(c), n, " ")
    line = F.concat(cut("label", 30), F.lit(" "), F.rpad(F.left("value", F.lit(38)), 40, " "), F.lit(" "), F.col("pages"))
    return rows.select("document", F.rtrim(line).alias("line"))


def json_rows(consolidated: DataFrame) -> DataFrame:
    """One JSON object per value: its counts."""
    item = F.struct("type", "value", F.col("documents").alias("document_count"), F.col("pages").alias("total_occurrences"))
    return consolidated_values(consolidated).select("type", "value", F.to_json(item).alias("json"))


def csv_rows(findings: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows of the CSV export, with the alias of each value where there is one."""
    rows = info_table(findings).select("document", "type", "value", F.array_join(F.transform("pages", lambda p: p.cast("string")), "; ").alias("pages"), F.size("pages").alias("page_count"))
    return rows if aliases is None else rows.join(aliases, ["type", "value"], "left")


EXPORTS = ("csv", "json", "parquet")


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Write rows in a named format."""
    if kind not in EXPORTS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(EXPORTS)}")
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def clean_for_dedup(v: Column, firm: bool) -> Column:
    """The form in which names are compared. Firms lose commas and periods; persons lose
    numbers, parentheses, dashes and marks at the ends, and middle initials."""
    v = F.trim(F.regexp_replace(F.lower(v), r"\s+", " "))
    if firm:
        return F.trim(F.regexp_replace(F.regexp_replace(v, "[,.]", ""), r"\s+", " "))
    for pattern in (r"^[\d/.,\s-]+", r"\s*/s/?\s*$", r"(\s*\([\d\s]*\)?)+\s*$", r"[\s\d/,.-]+$"):
        v = F.regexp_replace(v, pattern, "")
    return F.trim(F.regexp_replace(v, r"^(\S+) [a-z]\.? (\S+)$", "$1 $2"))


def prefix_roots(values: DataFrame) -> DataFrame:
    """``type, clean`` -> ``root``: the shortest whole-token prefix that is itself a value
    of the type.

    A value's token prefixes are exploded and met by an equality join; the
    prefixes of one value form a chain, so the shortest is unique. No pair of
    values is ever compared."""
    distinct = values.select("type", "clean").distinct()
    tokens = F.split("clean", " ")
    prefixes = distinct.select("type", "clean", F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), " "))).alias("root"))
    present = distinct.select("type", F.col("clean").alias("root"))
    met = prefixes.join(present, ["type", "root"], "left_semi")
    return met.groupBy("type", "clean").agg(F.min_by("root", F.length("root")).alias("root"))


def dedup_prefix(findings: DataFrame) -> DataFrame:
    """Names merged by root: ``type, root, value, pages_seen``. The shown value is the
    shortest met, not all upper-case if there is a choice, then first in order."""
    firm = F.col("type").isin(t.FIRM_TYPES)
    clean = F.when(firm, clean_for_dedup(F.col("value"), True)).otherwise(clean_for_dedup(F.col("value"), False))
    named = findings.where(F.col("type").isin(t.PREFIX_TYPES)).withColumn("clean", clean)
    per_clean = named.groupBy("type", "clean").agg(
        F.min(F.struct(F.length("value").alias("n"), ((F.col("value") == F.upper("value")) & (F.col("value") != F.lower("value"))).alias("upper"), F.col("value").alias("v"))).alias("best"),
        F.count(F.lit(1)).alias("seen"),
    )
    rooted = per_clean.join(prefix_roots(per_clean), ["type", "clean"])
    return rooted.groupBy("type", "root").agg(F.min("best").alias("best"), F.sum("seen").alias("seen")).select("type", "root", F.col("best.v").alias("value"), "seen")


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "document string, page long, type string, value string")
