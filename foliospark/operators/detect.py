"""Detectors: patterns, checks and context windows compiled to one column each.

A detector is data. Compiled, it is an expression from page text to an array of
structs; all detectors of a query stand in one ``select`` over one scan of the
pages, and one ``explode`` makes findings of them. No window, no join, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import bind
from ..sources.views import clean
from . import terms as t


@dataclass(frozen=True)
class Detector:
    """``groups``: the match groups handed to ``value`` (default: the first as is).
    ``near``: key words (a list, or a pattern), at least one of which must stand within
    ``reach`` characters; ``veto``: words that must not; ``fold``: how the window is folded before.
    ``gate``: a cheap test of the page before any pattern runs; ``needs``: such tests by
    pattern, true wherever the pattern has a match."""

    type: str
    patterns: tuple[str, ...]
    groups: tuple[int, ...] = (0,)
    value: Callable[..., Column] | None = None
    check: Callable[[Column], Column] | None = None
    reach: int = 0
    near: str | list[str] | None = None
    veto: str | list[str] | None = None
    fold: Callable[[Column], Column] = field(default=lambda c: c)
    gate: Callable[[Column], Column] | None = None
    distinct: bool = False
    needs: tuple[Callable[[Column], Column] | None, ...] = ()

    def values(self, text: Column) -> Column:
        """Accepted values on a page: ``array<string>``."""
        found = None
        for pattern, need in zip_longest(self.patterns, self.needs):
            if self.near or self.veto:
                hits = self._in_context(text, tx.spans(text, pattern, self.groups))
            else:
                hits = tx.matches(text, pattern, self.groups)
            make = self.value or (lambda *g: g[0])
            own = F.transform(hits, lambda x: make(*(x[f"g{i}"] for i in range(len(self.groups)))))
            if need is not None:
                own = F.when(need(text), own).otherwise(F.array().cast("array<string>"))
            found = own if found is None else F.concat(found, own)
        if self.check is not None:
            found = F.filter(found, self.check)
        if self.distinct:
            found = F.array_distinct(found)
        return F.when(self.gate(text), found) if self.gate is not None else found

    def typed(self, text: Column) -> Column:
        """Accepted values with their type: ``array<struct<type, value>>``."""
        values = F.coalesce(self.values(text), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(self.type).alias("type"), v.alias("value")))

    def _in_context(self, text: Column, hits: Column) -> Column:
        """The hits whose surroundings hold a ``near`` word and no ``veto`` word. Of long
        lists, only the words that the page has at all are looked for around each hit."""

        def on_page(words: str | list[str] | None) -> Column:
            listed = F.array(*map(F.lit, words)) if isinstance(words, list) else F.array().cast("array<string>")
            return bind(self.fold(text), lambda page: F.filter(listed, lambda w: F.contains(page, w)))

        def has(around: Column, words: str | list[str], met: Column) -> Column:
            return F.exists(met, lambda w: F.contains(around, w)) if isinstance(words, list) else tx.like(around, words)

        def kept(found: Column, words: str | list[str], wanted: bool) -> Column:
            def judged(met: Column) -> Column:
                ok = lambda around: has(around, words, met) if wanted else ~has(around, words, met)
                return F.filter(found, lambda x: bind(self.fold(tx.window(text, x["s"], F.length(x["m"]), self.reach)), ok))

            return F.when(F.size(found) > 0, bind(on_page(words), judged)).otherwise(found)

        if self.near:
            hits = bind(hits, lambda found: kept(found, self.near, True))
        return bind(hits, lambda found: kept(found, self.veto, False)) if self.veto else hits


def findings(pages: DataFrame, detectors: list[Detector], cleaned: bool = False) -> DataFrame:
    """``document, page, type, value``: one row per accepted match, or per distinct value
    on a page for detectors that say so."""
    rows = pages if cleaned else clean(pages)
    all_found = F.concat(*(d.typed(F.col("text")) for d in detectors))
    return rows.select("document", "page", F.explode(all_found).alias("f")).select("document", "page", "f.type", "f.value")


def _email_ok(v: Column) -> Column:
    domain = F.substring_index(v, "@", -1)
    local = F.substring_index(v, "@", 1)
    return (
        (F.length(v) <= 254) & (F.length(local) <= 64) & (F.length(domain) >= 3)
        & F.substring_index(v, ".", -1).isin(t.EMAIL_TLDS)
        & ~tx.has_any(v, t.FAKE_EMAIL) & ~tx.has_any(v, ["..", "--", "__"])
        & ~F.regexp_like(local, F.lit(r"^\.|\.$")) & ~F.regexp_like(domain, F.lit(r"^\.|\.$"))
    )


def _strip_url(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"[.,;:)\]]+$", ""))


def _web_ok(least: int) -> Callable[[Column], Column]:
    def ok(v: Column) -> Column:
        host = F.regexp_extract(F.regexp_replace(v, r"^https?://", ""), r"^[^/:?#]+", 0)
        return (F.length(v) > least) & F.substring_index(host, ".", -1).isin(t.WEB_TLDS)

    return ok


def _no_year(v: Column) -> Column:
    return ~tx.like(v, t.YEAR)


def has_folded(*words: str) -> Callable[[Column], Column]:
    """Whether one of the lower-case words stands in the text, whatever its case."""
    return lambda text: bind(F.lower(text), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)))


def _has(*words: str) -> Callable[[Column], Column]:
    return lambda text: tx.has_any(text, words)


EMAIL = Detector("email", (t.EMAIL,), value=F.lower, check=_email_ok, gate=_has("@"))
WEBSITES = [
    Detector("website", (t.URL_PROTOCOL,), (1,), _strip_url, _web_ok(10), gate=_has("://")),
    Detector("website", (t.URL_WWW,), (1,), _strip_url, _web_ok(7), gate=lambda c: F.regexp_like(c, F.lit("(?i)www"))),
    Detector("website", (t.URL_BARE,), (1,), F.lower, lambda v: (F.length(v) > 5) & ~F.substring_index(v, ".", 1).isin(t.SERVICE_LABELS), gate=_has(".")),
]
PHONE_US = Detector("phone", (t.PHONE_US,), check=lambda v: (tx.n_digits(v) == 10) & _no_year(v), distinct=True)
PHONE_INTL = Detector(
    "phone", tuple(t.PHONE_INTL), value=lambda v: F.regexp_replace(F.trim(v), tx.SPACE, " "), check=lambda v: tx.n_digits(v).between(7, 15) & _no_year(v),
    reach=50, near=t.PHONE_WORDS, veto=t.PHONE_VETO, fold=F.lower, distinct=True,
)
PHONE_EXT = Detector("phone", (t.PHONE_EXT,), (1, 2), lambda base, ext: F.concat(base, F.lit(" ext. "), ext), lambda v: tx.n_digits(F.substring_index(v, " ext. ", 1)).between(7, 15) & _no_year(v), distinct=True)
SSN = Detector("ssn", (t.SSN,))
CARD = Detector("credit_card", (t.CARD,), check=lambda v: F.call_function("luhn_check", tx.digits(v)))
COMMISSION = Detector("commission_file_number", (t.COMMISSION,), (1,))
EIN = Detector("irs_ein", (t.EIN,), (1,), reach=60, near=t.EIN_CONTEXT)
CUSIP = Detector("cusip_code", (t.CUSIP,), (1,), reach=50, near=t.CUSIP_CONTEXT, fold=tx.upper)
ISIN_US = Detector("isin_code", (t.ISIN_US,), (1,))
ISIN_OTHER = Detector("isin_code", (t.ISIN,), (1,), check=lambda v: ~F.startswith(v, F.lit("US")), reach=60, near=t.ISIN_CONTEXT, fold=tx.upper)
SEDOL = Detector("sedol_code", (t.SEDOL,), (1,), reach=60, near=t.SEDOL_CONTEXT, fold=tx.upper)
FIGI = Detector("figi_code", (t.FIGI,), (1,))
LEI = Detector("lei_code", (t.LEI,), (1,), check=lambda v: F.regexp_like(v, F.lit("[A-Z]")), reach=80, near=t.LEI_CONTEXT, fold=tx.upper)
PATENT = Detector("patent_number", (t.PATENT,), (1,), reach=80, near=t.PATENT_CONTEXT, fold=tx.upper)
TICKER = Detector("ticker_symbol", (t.TICKER,))
SEC_URL = Detector("sec_url", (t.SEC_URL,), (1,), lambda v: F.regexp_replace(v, r"[.,;:!?]+$", ""))
KNOWN = Detector("company_name", (t.KNOWN_COMPANY,), (1,), reach=60, near=t.KNOWN_COMPANY_CONTEXT, fold=F.lower, distinct=True)


def _registrant_ok(v: Column) -> Column:
    lowered = F.lower(v)
    first = F.substring_index(lowered, " ", 1)
    return F.length(v).between(5, 80) & (F.size(F.split(v, " ")) <= 9) & ~first.isin(t.COMPANY_FIRST_NOT) & ~lowered.isin(t.STRUCTURE_TERMS + t.BUSINESS_TERMS)


REGISTRANT = Detector("company_name", tuple(t.REGISTRANT), (1,), lambda v: F.regexp_replace(F.trim(v), tx.SPACE, " "), _registrant_ok, distinct=True)
DATES = Detector("important_date", (t.DATE_TEXT,), reach=80, near=t.DATE_CONTEXT, fold=F.lower, distinct=True)
US_DATES = Detector(
    "important_date", (t.DATE_US,), (1, 2, 3), lambda m, d, y: F.concat_ws("/", m, d, y),
    lambda v: F.substring_index(v, "/", 1).cast("int").between(1, 12) & F.substring_index(F.substring_index(v, "/", 2), "/", -1).cast("int").between(1, 31) & F.substring_index(v, "/", -1).cast("int").between(1900, 2100),
    reach=80, near=t.DATE_CONTEXT, fold=F.lower, distinct=True,
)
#: Quoted phrases; not among ``SIMPLE``, since few of them are titles.
QUOTED_TITLE = Detector("quoted_title", (t.QUOTED_TITLE,), (1,), F.trim, lambda v: F.length(v).between(10, 50), gate=lambda c: F.regexp_like(c, F.lit('["“”]')))
ISO_DATES = Detector(
    "important_date", (t.DATE_ISO,), (1, 2, 3), lambda y, m, d: F.concat_ws("-", y, m, d),
    lambda v: F.substring_index(v, "-", 1).cast("int").between(1900, 2100) & F.substring_index(F.substring_index(v, "-", 2), "-", -1).cast("int").between(1, 12) & F.substring_index(v, "-", -1).cast("int").between(1, 31),
    reach=80, near=t.DATE_CONTEXT, fold=F.lower, distinct=True,
)


def _city(city: Column) -> Column:
    words = F.filter(F.split(F.trim(city), tx.SPACE), lambda w: (F.length(w) > 1) & (F.regexp_like(w, F.lit("^[A-Z]")) | F.lower(w).isin(t.CITY_WORDS)))
    return F.array_join(words, " ")


def _address(number: Column, street: Column, kind: Column, direction: Column, city: Column, state: Column, zip_: Column) -> Column:
    """The address in one line; empty if the state is unknown or no city is left."""
    by_name = F.create_map(*(F.lit(x) for pair in t.STATES.items() for x in pair))
    short = F.when(F.length(state) == 2, F.upper(state)).otherwise(F.element_at(by_name, F.lower(F.regexp_replace(state, tx.SPACE, " "))))
    town = _city(city)
    towards = F.when(F.coalesce(direction, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(", "), direction))
    line = F.concat(number, F.lit(" "), F.regexp_replace(F.trim(street), tx.SPACE, " "), F.lit(" "), kind, towards, F.lit(", "), town, F.lit(", "), short, F.lit(" "), zip_)
    return F.when(short.isin(list(t.STATES.values())) & (town != ""), line).otherwise(F.lit(""))


def _address_ok(v: Column) -> Column:
    return F.length(v).between(20, 200) & ~tx.has_any(F.upper(v), t.ADDRESS_VETO)


def _zip_gate(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\d{5}"))


ADDRESS_ABBR = Detector("address", (t.ADDRESS_ABBR,), (1, 2, 3, 4, 5, 6, 7), _address, _address_ok, gate=_zip_gate, distinct=True)
ADDRESS_FULL = Detector("address", (t.ADDRESS_FULL,), (1, 2, 3, 4, 5, 6, 7), _address, _address_ok, gate=_zip_gate, distinct=True)


class _Addresses(Detector):
    """Both direct forms; only where a page has neither, the form read backwards from
    each ZIP code."""

    def values(self, text: Column) -> Column:
        none = F.array().cast("array<string>")
        direct = F.array_union(F.coalesce(ADDRESS_ABBR.values(text), none), F.coalesce(ADDRESS_FULL.values(text), none))
        return F.when(F.size(direct) > 0, direct).otherwise(inverse_addresses(text))


def inverse_addresses(text: Column) -> Column:
    """For each ZIP code, an address that ends right before it, within 250 characters."""

    def read(x: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - 250), F.least(x["s"], F.lit(250)))
        g = [F.regexp_extract(before, tx.ascii_words(t.INVERSE), i) for i in range(6)]
        line = F.concat(g[1], F.lit(" "), F.trim(g[2]), F.lit(" "), g[3], F.lit(", "), F.trim(g[4]), F.lit(", "), g[5], F.lit(" "), x["g0"])
        return F.when(g[5].isin(list(t.STATES.values())) & ~F.contains(F.upper(line), F.lit("WASHINGTON")), line).otherwise(F.lit(""))

    lines = F.transform(tx.spans(text, t.ZIP, (1,)), read)
    return F.when(_zip_gate(text), F.array_distinct(F.filter(lines, lambda v: F.length(v).between(25, 150))))


ADDRESS = _Addresses("address", ())


class _Partial(Detector):
    """City, state and ZIP that no full address of the page contains and no street
    stands before."""

    def values(self, text: Column) -> Column:
        full = F.coalesce(ADDRESS.values(text), F.array().cast("array<string>"))

        def ok(x: Column) -> Column:
            before = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - 50), F.least(x["s"], F.lit(50)))
            line = self._line(x)
            return x["g1"].isin(list(t.STATES.values())) & ~F.exists(full, lambda a: F.contains(a, line)) & ~tx.like(before, t.STREET_BEFORE)

        hits = F.filter(tx.spans(text, t.PARTIAL, (1, 2, 3)), ok)
        return F.when(_zip_gate(text), F.array_distinct(F.transform(hits, self._line)))

    @staticmethod
    def _line(x: Column) -> Column:
        return F.concat(x["g0"], F.lit(", "), x["g1"], F.lit(" "), x["g2"])


PARTIAL = _Partial("partial_address", ())


class _Cik(Detector):
    """Labelled numbers; only where a page has none, the first loose number near a
    telling word."""

    def values(self, text: Column) -> Column:
        labelled = F.regexp_extract_all(text, F.lit(tx.ascii_words(t.CIK)), F.lit(1))
        near = F.filter(tx.spans(text, t.CIK_LOOSE, (1,)), lambda x: tx.has_any(tx.window(text, x["s"], F.length(x["m"]), 100), t.CIK_CONTEXT))
        return F.when(F.size(labelled) > 0, labelled).otherwise(F.slice(F.transform(near, lambda x: x["g0"]), 1, 1))


CIK = _Cik("cik_number", ())

SIMPLE = [EMAIL, PHONE_US, PHONE_INTL, PHONE_EXT, ADDRESS, SSN, COMMISSION, EIN, TICKER, CIK, CUSIP, ISIN_US, ISIN_OTHER, SEDOL, FIGI, LEI, PATENT, SEC_URL, PARTIAL, KNOWN, REGISTRANT]


class _Websites(Detector):
    """Distinct per page over the three forms."""

    def values(self, text: Column) -> Column:
        return F.array_distinct(F.concat(*(F.coalesce(d.values(text), F.array().cast("array<string>")) for d in WEBSITES)))


class _Firms(Detector):
    """Firms and their class, by the first key word group met around the first mention
    on the page."""

    def typed(self, text: Column) -> Column:
        def named(x: Column) -> Column:
            around = tx.upper(tx.window(text, x["s"], F.length(x["m"]), 50))
            kind = F.when(F.lit(False), F.lit(""))
            for name, words in t.FIRM_CLASSES:
                kind = kind.when(tx.has_any(around, words), F.lit(name))
            value = F.regexp_replace(F.concat_ws(" ", x["g0"], x["g1"]), tx.SPACE, " ")
            return F.struct(kind.otherwise("professional_firm").alias("type"), value.alias("value"))

        def ok(v: Column) -> Column:
            words = F.filter(F.split(v, " "), lambda w: F.length(w) > 2)
            return F.length(v).between(10, 60) & F.forall(words, lambda w: F.regexp_like(w, F.lit("^[A-Z]"))) & ~v.isin(t.FIRM_NOT)

        def first(found: Column) -> Column:
            once = lambda values: F.transform(F.array_distinct(values), lambda v: F.get(found, F.array_position(values, v).cast("int") - 1))
            return bind(F.transform(found, lambda f: f["value"]), once)

        hits = F.transform(tx.spans(text, t.FIRM, (1, 2)), named)
        return bind(F.filter(hits, lambda f: ok(f["value"])), first)


WEBSITE = _Websites("website", ())
FIRM = _Firms("professional_firm", ())


def websites(pages: DataFrame) -> DataFrame:
    return findings(pages, [WEBSITE])


def firms(pages: DataFrame) -> DataFrame:
    return findings(pages, [FIRM])
