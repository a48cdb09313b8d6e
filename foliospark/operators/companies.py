"""Company names: what is taken for one, by its words and by the text around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import terms as t
from .detect import REGISTRANT, Detector, findings


def _words(v: Column) -> Column:
    return F.transform(F.split(F.lower(F.trim(v)), tx.SPACE), lambda w: F.regexp_replace(w, "[.,;:]+$", ""))


def final_name(v: Column) -> Column:
    """The last filter of every company name: generic words, pairs, starts and phrases."""
    words, lowered = _words(v), F.lower(F.trim(v))
    first, second, n = F.get(words, 0), F.get(words, 1), F.size(words)
    alone = first.isin([w for w in t.COMPANY_ALONE if w != "companies"]) & ((n == 1) | ((n == 2) & ~second.isin(t.COMPANY_SECOND)))
    starts = first.isin(t.COMPANY_STARTS) & (n <= 5) & ~F.exists(F.slice(words, 2, 100), lambda w: w.isin(t.COMPANY_KEPT))
    generic = F.forall(F.filter(words, lambda w: ~w.isin(t.COMPANY_FORMS)), lambda w: w.isin(t.COMPANY_GENERIC))
    return ~lowered.isin(t.COMPANY_ALONE + t.COMPANY_PAIRS + t.COMPANY_PHRASES) & ~alone & ~starts & ~generic & ~F.exists(words, lambda w: w.isin(t.COMPANY_VERBS))


def recognised_name(v: Column) -> Column:
    """The filter of names that a recogniser has found (see ``sources.plugins``)."""
    words, lowered = _words(v), F.lower(F.trim(v))
    first, n = F.get(words, 0), F.size(words)
    committee = F.startswith(lowered, F.lit("committee")) & ~tx.has_any(lowered, [" inc", " llc", " corp"])
    return (
        ~tx.has_any(lowered, t.RECOGNISED_SECTIONS) & ~committee & ~(first.isin(t.RECOGNISED_GENERIC) & (n <= 2)) & (n <= 6)
        & ~F.exists(words, lambda w: w.isin(t.RECOGNISED_VERBS)) & ~first.isin(t.RECOGNISED_STARTS) & final_name(v)
    )


def context_allows(text: Column, v: Column) -> Column:
    """Whether the 200 characters on both sides of the name's first mention speak of a
    name, or at least not of agreements, rules and the like."""
    at = F.instr(text, v)
    around = F.lower(tx.window(text, at - 1, F.length(v), 200))
    return (at == 0) | ~tx.has_any(around, t.COMPANY_CONTEXT_NOT) | tx.has_any(around, t.COMPANY_CONTEXT_NAMES)


class _Companies(Detector):
    """Registrants whose words and context allow them."""

    def values(self, text: Column) -> Column:
        return F.filter(REGISTRANT.values(text), lambda v: final_name(v) & context_allows(text, v))


COMPANIES = _Companies("company_name", ())


def company_names(pages: DataFrame) -> DataFrame:
    return findings(pages, [COMPANIES])


class _Standalone(Detector):
    """Names by their form alone, where no suspect word stands within 100 characters on
    either side. Searched on demand: the form alone says little."""

    def values(self, text: Column) -> Column:
        def ok(x: Column) -> Column:
            before = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - 100), F.least(x["s"], F.lit(100)))
            after = F.substring(text, x["s"] + F.length(x["m"]) + 1, F.lit(100))
            first = F.regexp_replace(F.lower(F.substring_index(self._name(x), " ", 1)), "[.,;:]+$", "")
            return ~tx.has_any(F.lower(F.concat(before, F.lit(" "), after)), t.COMPANY_STANDALONE_NOT) & ~first.isin(t.COMPANY_FIRST_NOT) & F.length(self._name(x)).between(5, 80)

        return F.array_distinct(F.transform(F.filter(tx.spans(text, t.COMPANY_STANDALONE, ()), ok), self._name))

    @staticmethod
    def _name(x: Column) -> Column:
        return F.regexp_replace(F.trim(x["m"]), tx.SPACE, " ")


STANDALONE = _Standalone("company_name", ())


def second_pass(text: Column, organisations: Column, found: Column) -> Column:
    """Of the ``organisations`` that a recogniser finds on a page, those to add to the names
    ``found``: none that overlaps a found name either way, none that is generic, and without
    a legal form only one that the text calls the registrant's or issuer's name."""

    def ok(v: Column) -> Column:
        lowered, shouted = F.lower(v), F.upper(v)
        first = F.regexp_replace(F.substring_index(lowered, " ", 1), "[.,;:]+$", "")
        at = F.instr(text, v)
        around = lambda n: F.lower(tx.window(text, at - 1, F.length(v), n))
        known = F.exists(found, lambda c: F.contains(F.lower(c), lowered) | F.contains(lowered, F.lower(c)))
        named = tx.like(v, t.ORGANISATION_FORM) | (at == 0) | tx.has_any(around(200), t.ORGANISATION_NAMED)
        return (
            F.length(v).between(5, 80) & ~known & ~lowered.isin(t.STRUCTURE_TERMS + t.BUSINESS_TERMS + t.ORGANISATION_GENERIC) & ~first.isin(t.COMPANY_FIRST_NOT)
            & F.regexp_like(v, F.lit("^[A-Z]")) & ~tx.has_any(shouted, t.ORGANISATION_NOT) & ((at == 0) | ~tx.has_any(around(100), t.ORGANISATION_CONTEXT_NOT)) & named
        )

    once = F.array_distinct(F.transform(organisations, lambda o: F.trim(F.regexp_replace(o, tx.SPACE, " "))))
    return F.filter(once, ok)
