"""URL rules by a sort-merge range join (operator 5).

A rule (host, path prefix) holds for its host and every subdomain. A url is
therefore keyed once per level of its reversed host (``com``, ``com.example``,
...), with its path behind; under the level that is the rule's host, the rule
is the interval of keys that start with its path. Intervals of prefixes nest or
are disjoint, so one sweep over keys and rule starts in sorted order needs only
a stack of the rules that are open.

Keys are dealt to ranges of the sort order; a rule goes to the range of its
start and to each later range whose first key lies in its interval. Equal keys
of different hosts may fall into different ranges, so no key is too hot.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys sampled per range to choose where ranges begin. It moves work between
#: tasks and changes no result.
SAMPLED_PER_RANGE = 40

ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased. Path: from there up to ``?``, ``#`` or the end. Both are empty
    without a url or ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return common.lower_ascii(host), path


def levels(host: Column) -> Column:
    """Every level of a host, labels reversed: for ``a.b.c`` these are ``c``,
    ``c.b`` and ``c.b.a``."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``rows``: (range, level, path, is a url, host, rule, verdict) in this order.
    Yields (host, path, rule, verdict) for each url under the deepest open rule."""
    stack: list[tuple] = []
    current = None
    for part, level, path, is_url, host, rule, verdict in rows:
        if part != current:
            stack, current = [], part
        while stack and not (stack[-1][0] == level and path.startswith(stack[-1][1])):
            stack.pop()
        if not is_url:
            stack.append((level, path, rule, verdict))
        elif stack:
            yield host, path, stack[-1][2], stack[-1][3]


def match(urls: DataFrame, rules: DataFrame, ranges: int, workspace: common.Workspace) -> DataFrame:
    """``host, path, rule, verdict`` for each distinct (host, path) of ``urls`` that
    some rule of ``rules`` (host, path, verdict) fits; the longest rule wins, of
    equally long ones a blocking one, then the last by name."""
    lowered = rules.where("host IS NOT NULL").select(common.lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    tidy = lowered.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block beats allow
    tidy = tidy.select(F.array_join(F.reverse(F.split("rule_host", r"\.")), ".").alias("level"), F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    keys = urls.select("host", "path").distinct().withColumn("level", F.explode(levels(F.col("host"))))
    # Only levels that some rule names can match; how many there are decides on the join.
    named = workspace.stage(tidy.select("level").distinct(), "levels")
    keys = keys.join(common.bounded(named, "level"), "level", "left_semi")
    keys = keys.select("level", "path", F.lit(True).alias("is_url"), "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))

    wanted = SAMPLED_PER_RANGE * ranges
    sample = common.hash_share(keys.select("level", "path", "host"), wanted, "level", "path", "host").limit(2 * wanted).collect()
    drawn = sorted(tuple(r) for r in sample)
    every = max(1, len(drawn) // ranges)
    begins = sorted({drawn[i] for i in range(every, len(drawn), every)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, took = [], []
            for i, (level, path, is_url, host) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)))):
                part = bisect_right(begins, (level, path, host or ""))
                own.append(part)
                took.append(i)
                if not is_url:
                    while part < len(begins) and begins[part][0] == level and begins[part][1].startswith(path):
                        part += 1
                        own.append(part)
                        took.append(i)
            rows = batch.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *rows.columns], names=["part", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found: list[tuple] = []
        for hit in sweep(rows):
            found.append(hit)
            if len(found) == 10_000:
                yield _hits(found)
                found = []
        yield _hits(found)

    starts = tidy.select("level", "path", F.lit(False).alias("is_url"), F.lit(None).cast("string").alias("host"), "rule", "verdict")
    schema = "level string, path string, is_url boolean, host string, rule string, verdict string"
    dealt = keys.unionByName(starts).mapInArrow(deal, f"part int, {schema}")
    ordered = dealt.repartitionById(len(begins) + 1, F.col("part")).sortWithinPartitions("part", "level", "path", "is_url", "host")
    hits = ordered.mapInArrow(run, "host string, path string, rule string, verdict string")
    best = F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule"))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def _hits(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [(), (), (), ()]
    return pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict``.

    Without a fitting rule the rule is null and the verdict ``default``. A null
    url, or one without ``://``, has an empty host, which no named rule fits. Null and
    repeated ids are judged row by row, other columns are ignored, and empty
    tables of pages or rules are allowed.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    ws = common.Workspace(spark, "url-rules")
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # Written, so that the join reads two plain exchanges and a hot url's rows can be split.
    found = ws.stage(match(urls, rules, common.shuffle_partitions(spark), ws), "matches")
    return urls.join(common.bounded(found, "host", "path", "rule", "verdict"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
