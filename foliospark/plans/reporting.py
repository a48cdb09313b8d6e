"""Queries: reports, roll-ups, deduplication, pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import alias, detect, report
from ..operators import terms as t
from ..operators.detect import findings
from ..sources import adapters
from ..sources import views as v
from .detection import REGISTRANT_SQL, email_sql
from .sql import DOCS, FILINGS, WEB, matches, q, words_in

QUERIES, SQL = {}, {}
KEYWORDS = ["summit", "cedar", "liberty energy"]


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def base(spark: SparkSession, d: str) -> DataFrame:
    """Findings that the report queries work on."""
    return findings(v.filings(spark, d), [detect.EMAIL, detect.SSN, detect.TICKER, detect.FIGI, detect.REGISTRANT])


BASE = (
    f"({email_sql(FILINGS)} UNION ALL SELECT document, page, 'ssn', value FROM {matches(FILINGS, t.SSN)} UNION ALL SELECT document, page, 'ticker_symbol', value FROM {matches(FILINGS, t.TICKER)} "
    f"UNION ALL SELECT document, page, 'figi_code', value FROM {matches(FILINGS, t.FIGI, 1)} UNION ALL {REGISTRANT_SQL})"
)
LABEL = "CASE type " + " ".join(f"WHEN {q(k)} THEN {q(x)}" for k, x in t.LABELS.items()) + " END"
PAGES = lambda c: f"array_to_string(list_transform({c}, lambda p: 'p.' || p), ', ')"
INFO = f"(SELECT document, type, value, list_sort(list(DISTINCT page)) AS pages, count(*) AS occurrences FROM {BASE} GROUP BY ALL)"


@query(f"SELECT document, type, value, pages, occurrences FROM {INFO}")
def info_table(spark: SparkSession, d: str) -> DataFrame:
    return report.info_table(base(spark, d))


@query(f"SELECT document, type, {LABEL} AS label, value, {PAGES('pages')} AS pages FROM {INFO}")
def document_report(spark: SparkSession, d: str) -> DataFrame:
    return report.document_report(base(spark, d))


HIT = "CASE " + " ".join(f"WHEN contains(lower(value), {q(k)}) THEN {q(k)}" for k in KEYWORDS) + " END"
TITLE = "CASE " + " ".join(f"WHEN contains(lower(value), {q(k)}) THEN {q(k.title())}" for k in KEYWORDS) + " ELSE value END"


@query(f"SELECT document, type, {TITLE} AS value, list_sort(list(DISTINCT page)) AS pages FROM {BASE} GROUP BY document, type, {TITLE}")
def keyword_rollup_single(spark: SparkSession, d: str) -> DataFrame:
    return report.rollup_single(base(spark, d), KEYWORDS)


@query(f"""
    WITH k AS (SELECT document, page, type, coalesce(lower({HIT}), lower(value)) AS key, coalesce({HIT}, value) AS shown FROM {BASE})
    SELECT type, key, min(shown) AS value, count(DISTINCT document) AS documents, count(DISTINCT document || '#' || page) AS page_count FROM k GROUP BY type, key
""")
def keyword_rollup_consolidated(spark: SparkSession, d: str) -> DataFrame:
    return report.rollup_consolidated(base(spark, d), KEYWORDS)


BEST = "first(value ORDER BY (value = upper(value) AND value <> lower(value)), length(value) DESC, value)"
CONSOLIDATED = f"""(
    WITH k AS (SELECT document, page, type, value, CASE WHEN type = 'email' THEN lower(value) ELSE value END AS key FROM {BASE}),
    b AS (SELECT type, key, {BEST} AS value FROM k GROUP BY type, key),
    p AS (SELECT type, key, document, list_sort(list(DISTINCT page)) AS pages FROM k GROUP BY type, key, document),
    o AS (SELECT type, key, list(struct_pack(document := document, pages := pages) ORDER BY document) AS occurrences FROM p GROUP BY type, key)
    SELECT type, key, value, occurrences FROM b JOIN o USING (type, key))"""


@query(f"SELECT type, key, value, len(occurrences) AS documents, CAST(list_sum(list_transform(occurrences, lambda o: len(o.pages))) AS BIGINT) AS pages FROM {CONSOLIDATED}")
def consolidated_findings(spark: SparkSession, d: str) -> DataFrame:
    return report.consolidated_values(report.consolidate(base(spark, d))).select("type", "key", "value", "documents", "pages")


PLACES = """(SELECT type, value, o, CAST((i - 1) // 5 AS BIGINT) AS part, i FROM (SELECT type, value, unnest(occurrences) AS o, unnest(range(1, len(occurrences) + 1)) AS i FROM """ + CONSOLIDATED + "))"


@query(f"SELECT {LABEL} AS label, value, part, string_agg(o.document || ' ' || {PAGES('o.pages')}, '; ' ORDER BY i) AS documents FROM {PLACES} GROUP BY type, value, part")
def consolidated_report(spark: SparkSession, d: str) -> DataFrame:
    return report.consolidated_report(report.consolidate(base(spark, d)), 5)


MIXED = "SELECT document, page, type, CASE WHEN page % 3 = 0 THEN upper(value) WHEN page % 3 = 1 AND type = 'email' THEN upper(value) ELSE value END AS value FROM " + BASE


@query(f"SELECT type, CASE WHEN type = 'email' THEN lower(value) ELSE value END AS key, {BEST} AS value FROM ({MIXED}) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY type, CASE WHEN type = 'email' THEN lower(value) ELSE value END"))
def best_display_value(spark: SparkSession, d: str) -> DataFrame:
    shout = F.when(F.col("page") % 3 == 0, F.upper("value")).when((F.col("page") % 3 == 1) & (F.col("type") == "email"), F.upper("value")).otherwise(F.col("value"))
    return report.consolidated_values(report.consolidate(base(spark, d).withColumn("value", shout))).select("type", "key", "value")


@query(f"SELECT coalesce(type, '(all)') AS type, count(*) AS items, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM {INFO} GROUP BY ROLLUP (type)")
def summary_by_type_rollup(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(base(spark, d))


@query(f"SELECT type, count(DISTINCT CASE WHEN type = 'email' THEN lower(value) ELSE value END) AS items, count(DISTINCT document) AS documents, count(DISTINCT CASE WHEN type = 'email' THEN lower(value) ELSE value END || chr(9) || document) AS document_mentions FROM {BASE} GROUP BY type")
def consolidated_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.consolidated_summary(report.consolidate(base(spark, d)))


@query(f"""SELECT type, value, '{{"type":"' || type || '","value":"' || value || '","document_count":' || len(occurrences) || ',"total_occurrences":' || CAST(list_sum(list_transform(occurrences, lambda o: len(o.pages))) AS BIGINT) || '}}' AS json FROM {CONSOLIDATED}""")
def json_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.json_rows(report.consolidate(base(spark, d)))


@query(f"SELECT document, type, value, array_to_string(pages, '; ') AS pages, len(pages) AS page_count FROM {INFO}")
def csv_export_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.csv_rows(base(spark, d))


@query(f"SELECT document, rtrim(rpad({LABEL}, 30, ' ') || ' ' || rpad(left(value, 38), 40, ' ') || ' ' || {PAGES('pages')}) AS line FROM {INFO}")
def text_report_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.text_report(base(spark, d))


@query(f"SELECT document, page, 'image' AS type, n || CASE WHEN n = 1 THEN ' image' ELSE ' images' END AS value FROM (SELECT document, page, len(regexp_extract_all(html || repeat('<img src=a.png>', CAST(length(url) % 4 AS INT)), '(?i)<img\\b')) AS n FROM ({WEB})) WHERE n > 0")
def images_in_report(spark: SparkSession, d: str) -> DataFrame:
    """The pages at hand show few images, so each gets up to three more."""
    html = F.concat("html", F.repeat(F.lit("<img src=a.png>"), (F.length("url") % 4).cast("int")))
    count = adapters.image_count(html).alias("image_count")
    return report.image_findings(v.web_pages(spark, d).select("document", "page", count).where("image_count > 0"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat("html", F.repeat(F.lit("<img src=a.png>"), (F.length("url") % 4).cast("int")))
    return v.web_pages(spark, d).select("document", "page", adapters.image_count(html).alias("image_count")).where("image_count > 0")


_IMAGES = f"(SELECT document, page, n FROM (SELECT document, page, len(regexp_extract_all(html || repeat('<img src=a.png>', CAST(length(url) % 4 AS INT)), '(?i)<img\\b')) AS n FROM ({WEB})) WHERE n > 0)"


@query(f"SELECT document, page, type, value FROM ({email_sql(WEB)}) UNION ALL SELECT document, page, 'image', n || CASE WHEN n = 1 THEN ' image' ELSE ' images' END FROM {_IMAGES}")
def findings_with_images(spark: SparkSession, d: str) -> DataFrame:
    return report.with_images(findings(v.web_pages(spark, d), [detect.EMAIL]), _images(spark, d))


@query(f"SELECT document, CAST(sum(f) AS BIGINT) AS findings, count(DISTINCT page) AS pages_with_findings, CAST(sum(i) AS BIGINT) AS images FROM (SELECT document, page, 1 AS f, 0 AS i FROM ({email_sql(WEB)}) UNION ALL SELECT document, NULL, 0, n FROM {_IMAGES}) GROUP BY document")
def web_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.document_totals(findings(v.web_pages(spark, d), [detect.EMAIL]), _images(spark, d))


@query(f"""
    WITH p AS (SELECT document, type, count(*) AS items, sum(occurrences) AS occurrences FROM {INFO} GROUP BY document, type)
    SELECT document, '{{"document":"' || document || '","summary":{{"total_items":' || CAST(sum(items) AS BIGINT) || ',"total_occurrences":' || CAST(sum(occurrences) AS BIGINT)
        || ',"types":{{' || string_agg('"' || type || '":' || items, ',' ORDER BY type) || '}}}}}}' AS json FROM p GROUP BY document
""")
def json_summaries(spark: SparkSession, d: str) -> DataFrame:
    return report.json_summary(base(spark, d))


@query(f"SELECT document, count(*) AS findings, count(DISTINCT page) AS pages_with_findings FROM {BASE} GROUP BY document")
def document_totals(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).groupBy("document").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("page").alias("pages_with_findings"))


@query(f"SELECT type, count(*) AS n FROM {BASE} GROUP BY type HAVING count(*) > 0")
def findings_by_type(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT document, type, value, n FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY n DESC, type, value) AS r FROM (SELECT document, type, value, count(*) AS n FROM {BASE} GROUP BY ALL)) WHERE r <= 3")
def top_findings_per_document(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counted = base(spark, d).groupBy("document", "type", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("document").orderBy(F.col("n").desc(), "type", "value")
    return counted.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


# Names with the wear and tear that the cleaner undoes.
RAW_NAMES = """
    SELECT CASE WHEN c_custkey % 2 = 0 THEN 'person_name' ELSE 'company_name' END AS type, CAST(c_custkey AS INT) AS page, concat('d', CAST(c_nationkey AS STRING)) AS document,
        CASE WHEN c_custkey % 2 = 0 THEN concat(
            CASE WHEN c_custkey % 10 = 0 THEN '2/17/2026 ' ELSE '' END,
            split_part('Adam|Brenda|Carlos|Diana|Edward', '|', CAST(c_custkey % 5 AS INT) + 1), ' ',
            CASE WHEN c_custkey % 6 = 0 THEN 'M. ' ELSE '' END,
            split_part('Walker|Turner|Bennett|Hughes|Coleman|Foster|Griffin', '|', CAST(c_custkey % 7 AS INT) + 1),
            CASE WHEN c_custkey % 12 = 2 THEN ' (7)(8' WHEN c_custkey % 12 = 4 THEN ' - - -' WHEN c_custkey % 12 = 8 THEN ' 11,925 148,940' WHEN c_custkey % 14 = 6 THEN ' Boon' ELSE '' END)
        ELSE concat(split_part('Ernst & Young|Vantiv|Harbor Energy|Summit', '|', CAST(c_custkey % 4 AS INT) + 1),
            CASE WHEN c_custkey % 3 = 0 THEN ', LLC' WHEN c_custkey % 3 = 1 THEN ' LLC.' ELSE '' END) END AS value
    FROM customer"""


def raw_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RAW_NAMES.replace("FROM customer", "FROM {customer}"), customer=v.table(spark, d, "customer"))


_PERSON = "trim(regexp_replace(lower(value), '\\s+', ' ', 'g'))"
for _p in (r"^[\d/.,\s-]+", r"\s*/s/?\s*$", r"(\s*\([\d\s]*\)?)+\s*$", r"[\s\d/,.-]+$"):
    _PERSON = f"regexp_replace({_PERSON}, {q(_p)}, '', 'g')"
_PERSON = f"trim(regexp_replace({_PERSON}, '^(\\S+) [a-z]\\.? (\\S+)$', '\\1 \\2'))"
_FIRM = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(value), '\\s+', ' ', 'g')), '[,.]', '', 'g'), '\\s+', ' ', 'g'))"
CLEAN = f"CASE WHEN type IN {words_in(t.FIRM_TYPES)} THEN {_FIRM} ELSE {_PERSON} END"
NAMES = RAW_NAMES.replace(" AS STRING)", " AS VARCHAR)")


@query(f"SELECT DISTINCT type, value, {CLEAN} AS clean FROM ({NAMES})")
def dedup_clean(spark: SparkSession, d: str) -> DataFrame:
    firm = F.col("type").isin(t.FIRM_TYPES)
    clean = F.when(firm, report.clean_for_dedup(F.col("value"), True)).otherwise(report.clean_for_dedup(F.col("value"), False))
    return raw_names(spark, d).select("type", "value", clean.alias("clean")).distinct()


@query(f"""
    WITH n AS (SELECT type, value, {CLEAN} AS clean FROM ({NAMES})), c AS (SELECT DISTINCT type, clean FROM n),
    r AS (SELECT a.type, a.clean, first(b.clean ORDER BY length(b.clean)) AS root FROM c a JOIN c b ON a.type = b.type AND (a.clean = b.clean OR starts_with(a.clean, b.clean || ' ')) GROUP BY a.type, a.clean)
    SELECT n.type, root, first(value ORDER BY length(value), (value = upper(value) AND value <> lower(value)), value) AS value, count(*) AS seen
    FROM n JOIN r ON n.type = r.type AND n.clean = r.clean GROUP BY n.type, root
""")
def dedup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return report.dedup_prefix(raw_names(spark, d))


def _idx(key: str, n: int, salt: str = "") -> str:
    return f"CAST(('0x' || substr(md5({key} || {q(salt)}), 1, 8))::BIGINT % {n} AS INT)"


def _pick(names: list[str], key: str, salt: str = "") -> str:
    return "[" + ", ".join(map(q, names)) + f"][{_idx(key, len(names), salt)} + 1]"


def _each(c: str, pattern: str, symbols: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN regexp_matches(substr({c}, i, 1), {q(pattern)}) "
        f"THEN substr({q(symbols)}, ('0x' || substr(md5({c} || ':' || (i - 1)), 1, 4))::INT % {len(symbols)} + 1, 1) ELSE substr({c}, i, 1) END), '')"
    )


_EMAIL_ALIAS = (
    f"CASE WHEN contains(split_part(value, '@', 1), '.') THEN lower({_pick(alias.GIVEN, 'value', 'g')}) || '.' || lower({_pick(alias.FAMILY, 'value', 'f')}) "
    f"WHEN contains(split_part(value, '@', 1), '_') THEN lower({_pick(alias.GIVEN, 'value', 'g')}) || '_' || lower({_pick(alias.FAMILY, 'value', 'f')}) "
    f"ELSE lower({_pick(alias.FAMILY, 'value', 'f')}) END || '@' || {_pick(alias.DOMAINS, 'split_part(value, chr(64), 2)')} || '.com'"
)
_WEB = lambda i: f"regexp_extract(value, '^(https?://)?(www\\.)?([^/]*?)(\\.[A-Za-z]+)?(/.*)?$', {i})"
_WEB_ALIAS = f"{_WEB(1)} || {_WEB(2)} || {_pick(alias.HOSTS, _WEB(3))} || {_WEB(4)} || {_WEB(5)}"
_SSN_ALIAS = f"({_idx('value', 900, 'a')} + 100) || '-' || ({_idx('value', 90, 'b')} + 10) || '-' || ({_idx('value', 9000, 'c')} + 1000)"
_ROOT = f"lower(trim(regexp_replace(value, {q(alias.SUFFIX)}, '')))"
_COMPANY_ALIAS = f"{_pick(alias.CITIES, _ROOT, 'c')} || ' ' || {_pick(alias.TRADES, _ROOT, 't')} || CASE WHEN regexp_extract(value, {q(alias.SUFFIX)}, 1) = '' THEN '' ELSE ' ' || regexp_extract(value, {q(alias.SUFFIX)}, 1) END"
_TICKER_ALIAS = "regexp_extract(value, '^(\\([A-Za-z]+:\\s*)', 1) || " + _each("regexp_extract(value, ':\\s*([A-Za-z]+)\\)$', 1)", "^[A-Za-z]$", alias.SYMBOLS[10:]) + " || ')'"
_MASK = f"repeat('X', least(length(value), {alias.MASK_LENGTH}))"
ALIAS = f"CASE type WHEN 'email' THEN {_EMAIL_ALIAS} WHEN 'ssn' THEN {_SSN_ALIAS} WHEN 'ticker_symbol' THEN {_TICKER_ALIAS} WHEN 'company_name' THEN {_COMPANY_ALIAS} ELSE {_MASK} END"


def _distinct(rows: DataFrame, f) -> DataFrame:
    return rows.select("value").distinct().select("value", f(F.col("value")).alias("alias"))


@query(f"SELECT value, {_each('value', '^[0-9]$', '0123456789')} AS alias FROM (SELECT DISTINCT value FROM {matches(DOCS, t.CARD)})")
def alias_digits(spark: SparkSession, d: str) -> DataFrame:
    pages = v.clean(v.document_pages(spark, d))
    return _distinct(pages.select(F.explode(F.regexp_extract_all("text", F.lit(tx.ascii_words(t.CARD)), F.lit(0))).alias("value")), alias.digits)


@query(f"SELECT value, {_each('value', '^[A-Za-z0-9]$', alias.SYMBOLS)} AS alias FROM (SELECT DISTINCT value FROM {matches(FILINGS, t.ISIN_US, 1)})")
def alias_codes(spark: SparkSession, d: str) -> DataFrame:
    return _distinct(findings(v.filings(spark, d), [detect.ISIN_US]), alias.code)


@query(f"SELECT value, {_EMAIL_ALIAS} AS alias FROM (SELECT DISTINCT value FROM ({email_sql(FILINGS)}))")
def alias_email(spark: SparkSession, d: str) -> DataFrame:
    return _distinct(findings(v.filings(spark, d), [detect.EMAIL]), alias.email)


@query(f"SELECT value, {_WEB_ALIAS} AS alias FROM (SELECT DISTINCT value FROM {matches(FILINGS, t.SEC_URL, 1)})")
def alias_website(spark: SparkSession, d: str) -> DataFrame:
    pages = v.clean(v.filings(spark, d))
    return _distinct(pages.select(F.explode(F.regexp_extract_all("text", F.lit(tx.ascii_words(t.SEC_URL)), F.lit(1))).alias("value")), alias.website)


_GEN = "(?i),?\\s+((?:jr|sr|ii|iii|iv|v|esq)\\.?)$"
_BARE = f"regexp_replace(value, {q(_GEN)}, '')"
_WORDS = f"string_split(regexp_replace({_BARE}, '\\.', '', 'g'), ' ')"
_KEY = f"lower(substr({_WORDS}[1], 1, 1) || '|' || {_WORDS}[-1])"
_SHOWN = f"CASE WHEN length({_WORDS}[1]) = 1 THEN substr({_pick(alias.GIVEN, _KEY, 'g')}, 1, 1) || '. ' ELSE {_pick(alias.GIVEN, _KEY, 'g')} || ' ' END || {_pick(alias.FAMILY, _KEY, 'f')}"
PEOPLE = (
    "SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN concat(substr(split_part('Adam|Brenda|Carlos', '|', CAST(c_custkey % 3 AS INT) + 1), 1, 1), '. ') ELSE concat(split_part('Adam|Brenda|Carlos', '|', CAST(c_custkey % 3 AS INT) + 1), ' ') END "
    "|| CASE WHEN c_custkey % 4 = 0 THEN 'WALKER' ELSE split_part('Walker|Turner|Bennett', '|', CAST(c_custkey % 11 % 3 AS INT) + 1) END || CASE WHEN c_custkey % 5 = 0 THEN ' Jr.' WHEN c_custkey % 7 = 0 THEN ' III' ELSE '' END AS value FROM customer"
)


@query(f"SELECT value, CASE WHEN {_BARE} = upper({_BARE}) AND {_BARE} <> lower({_BARE}) THEN upper({_SHOWN}) ELSE {_SHOWN} END || CASE WHEN regexp_extract(value, {q(_GEN)}, 1) = '' THEN '' ELSE ' ' || regexp_extract(value, {q(_GEN)}, 1) END AS alias FROM ({PEOPLE})")
def alias_person(spark: SparkSession, d: str) -> DataFrame:
    return _distinct(spark.sql(PEOPLE.replace("FROM customer", "FROM {customer}"), customer=v.table(spark, d, "customer")), alias.person)


@query(f"SELECT type, value, {ALIAS} AS alias FROM (SELECT DISTINCT type, value FROM {BASE})")
def alias_table(spark: SparkSession, d: str) -> DataFrame:
    return alias.alias_table(base(spark, d))


@query(f"SELECT document, page, type, value, {ALIAS} AS alias FROM {BASE}")
def pseudonymised_report(spark: SparkSession, d: str) -> DataFrame:
    return alias.pseudonymise(base(spark, d))


@query(f"SELECT document, type, {LABEL} AS label, value, {PAGES('pages')} AS pages, {ALIAS} AS alias FROM {INFO} ORDER BY document, label, value, type")
def aliased_report(spark: SparkSession, d: str) -> DataFrame:
    return report.aliased_report(base(spark, d))
