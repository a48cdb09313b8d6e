"""Person names: six candidate streams, one cleaning chain, one chain of filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import bind
from . import terms as t
from .detect import Detector, findings, has_folded


def _proper(v: Column) -> Column:
    return F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substring(v, 2, 100)))


def _spaced(v: Column) -> Column:
    return F.regexp_replace(F.trim(v), tx.SPACE, " ")


_ROLES = has_folded("director", "officer", "employee", "trustee", "owner", "holder", "member", "partner", "principal", "agent", "representative", "signatory")
_LABELS = has_folded("name", "person", "individual", "contact")
_SECTIONS = has_folded("signed", "certified", "attested", "witnessed", "notarized")
_SIGNS, _SLASH = has_folded("by", "name", "signature"), has_folded("/s")
ROLE = Detector("person_name", (t.PERSON_ROLE, t.PERSON_LABEL), (1,), _spaced, distinct=True, needs=(_ROLES, _LABELS))
SIGNED = Detector("person_name", (t.PERSON_SECTION, t.PERSON_SIGNED, t.PERSON_SLASH), (1,), _spaced, distinct=True, needs=(_SECTIONS, _SIGNS, _SLASH))
ROW = Detector("person_name", (t.PERSON_ROW,), (1,), _spaced, reach=150, near=t.PERSON_ROW_CONTEXT, fold=F.lower, distinct=True)
PAIR = Detector("person_name", (t.PERSON_PAIR,), (1, 2), lambda a, b: F.concat_ws(" ", a, b), reach=100, veto=t.PAIR_VETO, fold=F.lower, distinct=True)
LAST_FIRST = Detector("person_name", (t.PERSON_COMMA,), (1, 2), lambda a, b: F.concat_ws(" ", b, a), reach=100, veto=t.PAIR_VETO, fold=F.lower, distinct=True)
STRICT = Detector(
    "person_name", (t.PERSON_GENERAL,), (1, 2, 3), lambda a, m, b: F.concat_ws(" ", a, F.when(F.trim(m) != "", F.trim(m)), b),
    check=lambda v: F.length(v).between(5, 50), reach=200, near=t.GENERAL_NEAR, veto=t.GENERAL_VETO, fold=F.lower, distinct=True,
)


def _words(v: Column) -> Column:
    return F.transform(F.split(F.lower(v), " "), lambda w: F.rtrim(w, F.lit(".,;:")))


def executive(v: Column) -> Column:
    """Whether a name that stands with a title or a signature looks like a person's."""
    return F.length(v).between(5, 50) & bind(_words(v), lambda words: _executive(v, words))


def _executive(v: Column, words: Column) -> Column:
    return (
        F.length(v).between(5, 50) & F.size(words).between(2, 5) & ~F.upper(v).isin(t.EXECUTIVE_NOT)
        & F.forall(F.split(v, " "), lambda w: F.length(w).between(2, 20)) & ~F.exists(words, lambda w: w.isin(t.EXECUTIVE_WORDS_NOT))
        & (tx.upper_ratio(v) <= 0.4) & (F.size(F.array_distinct(words)) == F.size(words))
    )


def _titled(before: str, after: str = r"\b") -> Callable[[Column], Column]:
    """Whether a title stands between the two. It is looked for where ``before`` is met, which
    takes far less time than looking for names."""
    return lambda text: tx.like(text, f"(?i){before}(?:{t.TITLES}){after}")


#: Names before and after titles, signed names, labelled names. A list of officers needs no
#: pattern of its own: each of its lines is a name before a title.
EXECUTIVES = [
    Detector("executive_name", (t.EXECUTIVE, t.EXECUTIVE_ROW, t.EXECUTIVE_PLAIN), (1,), _spaced, executive, needs=(_titled(r"[,:]\s*"), _titled(r"[|\-]\s*"), _titled(r"[A-Z]\s+"))),
    Detector("executive_name", (t.EXECUTIVE_REVERSE,), (2,), _spaced, executive),
    Detector("executive_name", (t.PERSON_SLASH, t.EXECUTIVE_SIGNED), (1,), _spaced, executive, needs=(_SLASH, has_folded("signature:", "signed:"))),
    Detector("executive_name", tuple(t.EXECUTIVE_LABEL), (1,), _spaced, executive, reach=100, veto=t.EXECUTIVE_LABEL_VETO, fold=F.lower),
]
#: ``t.PERSON_EMAIL`` with the runs of letters taken whole: what follows each of them is no
#: letter, so no other cut of a run can match, and a long run is not cut at every two places.
_EMAIL_NAME = r"(?i)\b((?:[a-z]++\.[a-z]++|[a-z]{2,}+))\.([a-z]+)@"
FROM_EMAIL = Detector(
    "person_name", (_EMAIL_NAME,), (1, 2),
    lambda a, b: F.when(F.lower(a).isin(t.TECHNICAL_PREFIXES) | F.lower(b).isin(t.TECHNICAL_PREFIXES), F.lit("")).otherwise(F.concat_ws(" ", _proper(a), _proper(b))),
    check=lambda v: F.length(v).between(5, 30), gate=lambda c: F.contains(c, F.lit("@")), distinct=True,
)
STREAMS = [ROLE, SIGNED, ROW, PAIR, LAST_FIRST, FROM_EMAIL, STRICT]


def clean_name(v: Column) -> Column:
    """Signature marks and parentheses first, then dates and numbers at either end."""
    for pattern in (r"^\s*/s/\s*|\s*/s/?\s*$", r"(\s*\([^()]*\)?)+\s*$", r"^[\d/.,\s-]+", r"[\s\d/,.-]+$", r"\s+"):
        v = F.regexp_replace(v, pattern, " ")
    return F.trim(v)


PHRASES_NOT = [*t.DOCUMENT_TITLES, *t.STRUCTURE_PHRASES, *t.ACTIVITY_PHRASES, *t.COMPENSATION_PHRASES, *t.COMPANY_REFERENCES]
#: The last word of a reference: a number, a Roman number, a number with a letter.
REFERENCE_LAST = r"^(?:[0-9][0-9.]*|[IVX]+|[0-9]+[A-Za-z]|[0-9]+\([a-z]\))$"


def no_phrase(v: Column) -> Column:
    """Neither a phrase of documents, activities, pay or companies, nor a reference to a
    part of a document, nor the beginning of a sentence."""
    lowered = F.lower(v)
    return bind(F.transform(F.split(lowered, " "), lambda w: F.rtrim(w, F.lit(".,;:"))), lambda words: _no_phrase(v, lowered, words))


def _no_phrase(v: Column, lowered: Column, words: Column) -> Column:
    first, second, last = F.get(words, 0), F.get(words, 1), F.element_at(words, -1)
    suffixed = F.regexp_like(second, F.lit("(?:" + "|".join(t.NOUN_SUFFIXES) + ")$")) & ~second.isin(t.SUFFIX_SURNAMES)
    reference = F.regexp_like(F.regexp_replace(F.substring_index(v, " ", -1), "[.,;:]+$", ""), F.lit(REFERENCE_LAST)) | first.isin(t.REFERENCE_FIRST_WORDS)
    pair = F.size(words) == 2
    return (
        ~lowered.isin(PHRASES_NOT) & ~((F.size(words) >= 2) & reference) & ~tx.like(v, r"\b[0-9]+\.[0-9]+\b|[®™]")
        & ~F.regexp_like(lowered, F.lit("(?:" + "|".join(t.TRUNCATED_ENDINGS) + ")$")) & ~tx.has_any(lowered, t.WAIVERS)
        & ~first.isin(t.START_VERBS + t.BUSINESS_ADJECTIVES) & ~(pair & suffixed) & ~(pair & first.isin(t.ABSTRACT_NOUNS) & second.isin(t.ABSTRACT_NOUNS))
        & ~last.isin(t.LAST_WORDS_NOT)
    )


def plausible(v: Column) -> Column:
    """Shape and word filters, cheap ones first."""
    parts = F.struct(F.split(v, " ").alias("words"), F.split(F.lower(v), " ").alias("low"))
    return F.length(v).between(5, 50) & bind(parts, lambda p: _plausible(v, p["words"], p["low"]))


def _plausible(v: Column, words: Column, low: Column) -> Column:
    lowered, first, second = F.lower(v), F.get(low, 0), F.get(low, 1)
    keyword = F.lit(False)
    for name, after in t.KEYWORD_NAMES.items():
        keyword = keyword | ((first == name) & second.isin(after))
    return (
        F.length(v).between(5, 50) & F.size(words).between(2, 5)
        & F.forall(words, lambda w: F.regexp_like(w, F.lit(r"^(?:[A-Z]\.?|[A-Z][A-Za-z']{1,19})$")))
        & (F.size(F.array_distinct(words)) == F.size(words)) & (tx.upper_ratio(v) <= 0.4)
        & ~lowered.isin(t.PERSON_NOT + t.JOB_TITLES) & ~F.exists(low, lambda w: w.isin(t.POSSESSIVES)) & ~F.exists(low, lambda w: w.isin(t.NAME_WORDS_NOT))
        & (~F.endswith(first, F.lit("ing")) | first.isin(t.ING_NAMES)) & ~keyword
        & ~tx.like(v, r"\b(?:Holdings|Street|Avenue|Road|Drive|Number|Commission|Exact|Inc|LLP|Shares)\b")
        & no_phrase(v)
    )


class _Persons(Detector):
    """Distinct cleaned and plausible names of a page, without those that it names as
    executives. All of it happens in the page's row: no join, one pass over the text."""

    def values(self, text: Column) -> Column:
        none = F.array().cast("array<string>")
        together = lambda ds: F.concat(*(F.coalesce(d.values(text), none) for d in ds))
        names = F.array_except(together(STREAMS), together(EXECUTIVES))
        return F.array_distinct(F.filter(F.transform(names, clean_name), plausible))


PERSONS = _Persons("person_name", ())


def validated_or_all(names: Column, recognised: Column) -> Column:
    """The names that a recogniser's names contain or are contained in, whatever their
    case; all of them if that leaves none."""
    meets = lambda n: F.exists(recognised, lambda r: F.contains(F.lower(n), F.lower(r)) | F.contains(F.lower(r), F.lower(n)))
    kept = F.filter(names, meets)
    return F.when(F.size(kept) > 0, kept).otherwise(names)


def executive_names(pages: DataFrame) -> DataFrame:
    """``document, page, value``: names that stand with a title."""
    return findings(pages, EXECUTIVES).select("document", "page", "value").distinct()


def person_names(pages: DataFrame) -> DataFrame:
    """``document, page, value``: distinct cleaned and plausible names per page, without
    those that the page names as executives. ``pages`` has a row per page."""
    return findings(pages, [PERSONS]).select("document", "page", "value")
