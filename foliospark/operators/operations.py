"""Batch bookkeeping: validation, outcomes, quotas, history, caches, settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BYTES, MAX_BYTES = 100, 500 * 1024 * 1024
MONTHLY_LIMIT = 500


def validation_error() -> Column:
    """The first check that a file fails, in order; null if it passes."""
    size = F.col("file_size")
    return (
        F.when(~F.col("file_exists"), "file not found").when(~F.endswith(F.lower("path"), F.lit(".pdf")), "not a PDF file")
        .when(size == 0, "file is empty").when(size < MIN_BYTES, "file is too small").when(size > MAX_BYTES, "file is too large")
        .when(F.col("is_encrypted"), "file is encrypted").when(F.col("page_count").isNull(), "file cannot be read").when(F.col("page_count") == 0, "file has no pages")
    )


def validate(files: DataFrame) -> DataFrame:
    """A file without text is valid, with a warning that it needs recognition."""
    error = validation_error()
    return files.select("path", error.isNull().alias("valid"), error.alias("error"), (error.isNull() & ~F.col("has_text")).alias("needs_ocr"))


def outcome(runs: DataFrame) -> DataFrame:
    """Batch totals: a run succeeds if every part of it that was asked for did."""
    ok = F.coalesce(F.col("conversion") == "ok", F.lit(True)) & F.coalesce(F.col("analysis") == "ok", F.lit(True)) & F.col("error").isNull()
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def monthly_usage(events: DataFrame) -> DataFrame:
    return events.groupBy("account", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used"))


def quota(accounts: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """Used, limit and rest per account and, under ``(all)``, in total; an account
    without usage has used none."""
    now = usage.where(F.col("month") == month)
    rows = accounts.join(now, accounts["name"] == now["account"], "left").select("name", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("monthly_limit", F.lit(MONTHLY_LIMIT)).alias("monthly_limit"))
    rolled = rows.rollup("name").agg(F.sum("used").alias("used"), F.sum("monthly_limit").alias("monthly_limit"))
    left = F.greatest(F.lit(0), F.col("monthly_limit") - F.col("used"))
    return rolled.select(F.coalesce("name", F.lit("(all)")).alias("name"), "used", "monthly_limit", left.alias("remaining"), F.round(100.0 * F.col("used") / F.col("monthly_limit"), 4).alias("percentage"))


def recent(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest rows: a top-k, not a sort of the table."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def recent_per(events: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def retry_stats(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("attempts").alias("attempts"), F.count_if(F.col("ok")).alias("successes"), F.count_if((F.col("attempts") > 1) & F.col("ok")).alias("recovered"), F.max("attempts").alias("worst"),
    )


def backoff(attempt: Column, first: float, factor: float, cap: float) -> Column:
    """Seconds to wait before a repeated attempt (from 1)."""
    return F.least(F.lit(cap), F.lit(first) * F.pow(F.lit(factor), attempt - 1))


def cache_lookup(wanted: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("doc_md5", "page", "dpi", "lang")) -> tuple[DataFrame, DataFrame]:
    """Hits with their payload, and misses."""
    return wanted.join(cache, list(keys)), wanted.join(cache.select(*keys), list(keys), "left_anti")


def settings(defaults: DataFrame, given: DataFrame) -> DataFrame:
    """``key, value``: given settings over defaults, unknown keys kept."""
    d, g = defaults.alias("d"), given.alias("g")
    return d.join(g, "key", "full").select("key", F.coalesce("g.value", "d.value").alias("value"))


def file_size(n: Column) -> Column:
    """Bytes in the largest unit that keeps the number at least one."""
    units = [("B", 1), ("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)]
    shown = lambda u, b: F.concat(F.round(n / b, 1).cast("string"), F.lit(f" {u}"))
    return reduce(lambda c, ub: c.when(n >= ub[1], shown(*ub)), reversed(units[1:]), F.when(F.lit(False), F.lit(""))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def language_code(c: Column, codes: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.coalesce(F.element_at(table, c), c)


def log_stats(lines: DataFrame) -> DataFrame:
    """Lines and bytes of each log file."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))


def merge_counters(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Running totals: old counts and new ones, summed by key."""
    return old.unionByName(delta).groupBy("account", "month").agg(F.sum("used").alias("used"))


def page_range(pages: DataFrame, first: int | None = None, end: int | None = None) -> DataFrame:
    """Pages from ``first`` on and before ``end``; a bound that is not given does not bind."""
    rows = pages if first is None else pages.where(F.col("page") >= first)
    return rows if end is None else rows.where(F.col("page") < end)


def merge_totals(old: DataFrame, delta: DataFrame, *keys: str) -> DataFrame:
    """Old totals and what has been added since, summed by key; every other column is a sum.
    Write the result beside the old table, not over it."""
    sums = [c for c in old.columns if c not in keys]
    return old.unionByName(delta).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
