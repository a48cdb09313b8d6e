"""Pseudonyms as pure functions of type and value: md5 picks, nothing is remembered.

The same value gets the same alias in every document, partition and run, so no
alias table has to be shared while a report is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITIES = ["Ashford", "Brookside", "Clearwater", "Dunmore", "Eastvale", "Fernwood", "Glenhaven", "Hillcrest"]
TRADES = ["Industries", "Partners", "Systems", "Ventures", "Resources", "Works"]
GIVEN = ["Alex", "Blair", "Casey", "Drew", "Ellis", "Frankie", "Harper", "Jordan", "Kendall", "Logan"]
FAMILY = ["Abbott", "Barlow", "Carver", "Dalton", "Emerson", "Fletcher", "Garrison", "Holloway", "Ingram", "Jennings"]
DOMAINS = ["northmail", "fieldpost", "riverbox", "stonemail", "lakepost"]
HOSTS = ["northsite", "fieldweb", "riverpage", "stonehub", "lakeline"]
SUFFIX = r"(?i)[, ]+((?:Inc|LLC|LLP|Corp|Corporation|Ltd|Limited|Holdings|PLC|Company)\.?(?:,? (?:Inc|LLC|Ltd)\.?)?)$"
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DIGIT_TYPES = ["phone", "credit_card", "cik_number", "commission_file_number", "irs_ein", "important_date"]
MASK_LENGTH = 10


def index(key: Column, n: int, salt: str = "") -> Column:
    """A number below ``n`` from the first 32 bits of the key's md5."""
    word = F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(word, F.lit(n)).cast("int")


def pick(names: list[str], key: Column, salt: str = "") -> Column:
    return F.element_at(F.array(*map(F.lit, names)), index(key, len(names), salt) + 1)


def _each(v: Column, pattern: str, symbols: str) -> Column:
    """Characters that match are replaced by a symbol of (value, position)."""

    def swap(c: Column, i: Column) -> Column:
        word = F.conv(F.substring(F.md5(F.concat(v, F.lit(":"), i.cast("string"))), 1, 4), 16, 10).cast("int")
        return F.when(F.regexp_like(c, F.lit(pattern)), F.substring(F.lit(symbols), F.pmod(word, F.lit(len(symbols))) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(v, ""), swap), "")


def digits(v: Column) -> Column:
    return _each(v, "^[0-9]$", "0123456789")


def code(v: Column) -> Column:
    return _each(v, "^[A-Za-z0-9]$", SYMBOLS)


def ssn(v: Column) -> Column:
    part = lambda low, n, salt: (index(v, n, salt) + low).cast("string")
    return F.concat_ws("-", part(100, 900, "a"), part(10, 90, "b"), part(1000, 9000, "c"))


def email(v: Column) -> Column:
    """One alias per domain; the local part keeps its separator."""
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    given, family = F.lower(pick(GIVEN, v, "g")), F.lower(pick(FAMILY, v, "f"))
    name = F.when(F.contains(local, F.lit(".")), F.concat(given, F.lit("."), family)).when(F.contains(local, F.lit("_")), F.concat(given, F.lit("_"), family)).otherwise(family)
    return F.concat(name, F.lit("@"), pick(DOMAINS, domain), F.lit(".com"))


def website(v: Column) -> Column:
    """Protocol, ``www.``, top-level domain and path stay; the host's name goes."""
    g = lambda i: F.regexp_extract(v, r"^(https?://)?(www\.)?([^/]*?)(\.[A-Za-z]+)?(/.*)?$", i)
    return F.concat(g(1), g(2), pick(HOSTS, g(3)), g(4), g(5))


def company_root(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(v, SUFFIX, "")))


def company(v: Column) -> Column:
    """An alias per name without its legal suffix, which stays."""
    root, suffix = company_root(v), F.regexp_extract(v, SUFFIX, 1)
    base = F.concat_ws(" ", pick(CITIES, root, "c"), pick(TRADES, root, "t"))
    return F.when(suffix == "", base).otherwise(F.concat_ws(" ", base, suffix))


#: Generation suffixes and the like, which stay as they are.
GENERATION = r"(?i),?\s+((?:jr|sr|ii|iii|iv|v|esq)\.?)$"


def person(v: Column) -> Column:
    """Initial forms share the family name's alias with the full form; a generation suffix
    and all capitals stay."""
    suffix = F.regexp_extract(v, GENERATION, 1)
    bare = F.regexp_replace(v, GENERATION, "")
    words = F.split(F.regexp_replace(bare, r"\.", ""), " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    key = F.lower(F.concat(F.substring(first, 1, 1), F.lit("|"), last))
    given, family = pick(GIVEN, key, "g"), pick(FAMILY, key, "f")
    shown = F.when(F.length(first) == 1, F.concat(F.substring(given, 1, 1), F.lit(". "), family)).otherwise(F.concat_ws(" ", given, family))
    cased = F.when((bare == F.upper(bare)) & (bare != F.lower(bare)), F.upper(shown)).otherwise(shown)
    return F.when(suffix == "", cased).otherwise(F.concat_ws(" ", cased, suffix))


def place(v: Column) -> Column:
    """City and number invented; state and ZIP layout stay."""
    tail = F.regexp_extract(v, r"([A-Z]{2}) \d{5}", 1)
    zip_ = F.lpad(index(v, 100000, "z").cast("string"), 5, "0")
    return F.concat(pick(CITIES, v), F.lit(", "), tail, F.lit(" "), zip_)


def mask(v: Column) -> Column:
    return F.repeat(F.lit("X"), F.least(F.length(v), F.lit(MASK_LENGTH)))


def ticker(v: Column) -> Column:
    return F.concat(F.regexp_extract(v, r"^(\([A-Za-z]+:\s*)", 1), _each(F.regexp_extract(v, r":\s*([A-Za-z]+)\)$", 1), "^[A-Za-z]$", SYMBOLS[10:]), F.lit(")"))


def firm(v: Column) -> Column:
    """Two family names and the form at the end."""
    return F.concat(pick(FAMILY, v, "1"), F.lit(" & "), pick(FAMILY, v, "2"), F.lit(" "), F.substring_index(v, " ", -1))


def alias(kind: Column, v: Column) -> Column:
    """The alias of a value of a type."""
    return (
        F.when(kind.isin(DIGIT_TYPES), digits(v)).when(kind.isin("cusip_code", "isin_code"), code(v)).when(kind == "ssn", ssn(v))
        .when(kind == "email", email(v)).when(kind == "website", website(v)).when(kind == "company_name", company(v))
        .when(kind == "person_name", person(v)).when(kind.isin("address", "partial_address"), place(v)).when(kind == "ticker_symbol", ticker(v))
        .when(kind.isin("auditor", "law_firm", "underwriter", "financial_institution", "professional_firm"), firm(v))
        .otherwise(mask(v))
    )


def alias_table(findings: DataFrame) -> DataFrame:
    """``type, value, alias`` for each distinct value."""
    return findings.select("type", "value").distinct().withColumn("alias", alias(F.col("type"), F.col("value")))


def pseudonymise(findings: DataFrame) -> DataFrame:
    """Aliases in place, without a join: an alias depends on its row alone."""
    return findings.withColumn("alias", alias(F.col("type"), F.col("value")))
