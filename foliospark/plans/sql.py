"""DuckDB fragments that the SQL twins of the queries are put together from.

They are written by hand against the rules, not rendered from the detectors; only
the fixed patterns and lists are shared."""

from __future__ import annotations

from collections.abc import Iterable

from ..sources.views import FILINGS_SQL

DOCS = "SELECT source AS document, CAST(doc_id + 1 AS BIGINT) AS page, text FROM documents"
WEB = "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS document, CAST(page_id + 1 AS BIGINT) AS page, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, url, html FROM pages"
FILINGS = FILINGS_SQL.replace(" AS STRING)", " AS VARCHAR)")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_in(items: Iterable[str]) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


def clean(pages: str) -> str:
    return rf"(SELECT document, page, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM ({pages}) WHERE length(trim(text)) >= 10)"


def matches(pages: str, pattern: str, group: int = 0, value: str = "value") -> str:
    """document, page, value of every match."""
    return f"(SELECT document, page, {value} AS value FROM (SELECT document, page, unnest(regexp_extract_all(text, {q(pattern)}, {group})) AS value FROM {clean(pages)}))"


def located(pages: str, pattern: str, groups: Iterable[int] = (0,)) -> str:
    """document, page, text, s (start from 0), m, g0.. of every match."""
    p = q(pattern)
    fields = "".join(f", regexp_extract_all(text, {p}, {g}) AS e{i}" for i, g in enumerate(groups))
    picks = "".join(f", coalesce(e{i}[k], '') AS g{i}" for i, _ in enumerate(groups))
    return (
        f"(SELECT document, page, text, k, m[k] AS m, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s{picks} "
        f"FROM (SELECT document, page, text, regexp_extract_all(text, {p}, 0) AS m, regexp_split_to_array(text, {p}) AS gaps{fields} FROM {clean(pages)}) t, unnest(range(1, len(m) + 1)) u(k))"
    )


def window(n: int) -> str:
    return f"substr(text, greatest(1, s + 1 - {n}), least(s, {n}) + length(m) + {n})"


def has_any(c: str, items: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in items) + ")"


def n_digits(c: str) -> str:
    return f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"


WORDS = """
    SELECT page, word_id, text, x0, CAST(x0 + 6 * length(text) AS INT) AS x1, top, top + 10 AS bottom, size, conf, line FROM (
        SELECT page, word_id, text, CAST(word_id % 8 * 60 + CASE WHEN word_id % 8 >= 4 THEN 80 ELSE 0 END AS INT) AS x0,
               CAST(word_id // 8 * 12 + word_id % 3 AS INT) AS top, 10 + CASE WHEN word_id // 8 % 10 = 0 THEN 4 ELSE 0 END AS size,
               CAST(20 + word_id * 7 % 80 AS INT) AS conf, CAST(word_id // 8 AS INT) AS line
        FROM (SELECT doc_id || ':' || ((i - 1) // 200) AS page, CAST((i - 1) % 200 AS INT) AS word_id, w[i] AS text
              FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) d, unnest(range(1, len(w) + 1)) t(i)))
    WHERE length(text) > 0"""
