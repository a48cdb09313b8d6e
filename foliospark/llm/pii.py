"""Personal data by weak supervision, in DataFrame functions only (operator 9).

Base rules find e-mail addresses, IP addresses, card and phone numbers. Wider labelers
propose further spans: patterns (secrets, local phone numbers, identity numbers,
account numbers) and a gazetteer of key words, which proposes the value that a key word
names. Labelers vote on every span: the shape of the match, a gazetteer of words before
it, the characters around it, words that speak against it, and the mix of characters
inside. Votes with a few features of the span, not spans, are counted over the corpus.
Expectation-maximisation on these counts estimates how reliable each labeler is, for
each kind of span by itself with all kinds together as the prior, and its posteriors
train a logistic classifier, on votes and on features that no labeler sees, which
decides on the proposed spans. Base spans always stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, scan
from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "local_phone", "identity", "account")
KINDS = BASE_KINDS + ADDED_KINDS

# The base patterns. Possessive repetition and the look-behind on a
# run's start change no match; they keep long runs of digits or letters linear
# (and the regex engine off its stack).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?){3}$"
#: Key words whose value is proposed as a secret.
NAMING = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|credential"
# The wider patterns, one alternation; the last part is the value that a key word names.
ADDED = (
    r"(?<![A-Za-z0-9])(?:"
    r"[0-9a-f]{32,}+|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
    r")(?![A-Za-z0-9])"
    r"|(?<=[:=]\s{0,2}[\"']?)(?<=(?i:" + NAMING + r")[\"']?\s{0,2}[:=]\s{0,2}[\"']?)(?=[^\s\"'<>]*[0-9])[A-Za-z0-9+/_.~!@#$%^&*-]{8,}+"
)

#: Characters before a span that labelers read, back to the match before of its pattern.
CONTEXT = 40
#: Words of the gazetteer by kind, and words that speak against any kind.
GAZETTEER = {
    "email": "mail|contact|write|e-mail",
    "ip": "address|server|host|ip",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|fax|mobile",
    "secret": "token|secret|key|password|passwd|credential|auth",
    "local_phone": "phone|tel|call|fax|mobile",
    "identity": "ssn|social security|tax id|identity",
    "account": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = "sha-?[0-9]+|md5|checksum|digest|commit|version|isbn|order no|part no|invoice"
LABELERS = ("shape", "gazetteer", "around", "against", "mix")

#: Features of a span besides votes: classes of its length, of its share of digits, of
#: the variety of its characters, and of the character before and after.
FEATURES = (5, 4, 3, 5, 4)
#: Where each group of weights begins: bias, kinds, votes, features.
OFFSETS = [1, 1 + len(KINDS)]
for _n in (len(LABELERS), *FEATURES):
    OFFSETS.append(OFFSETS[-1] + _n)

#: Rounds of expectation-maximisation and of the classifier's gradient descent.
EM_ROUNDS, FIT_ROUNDS, FIT_STEP, SHRINK = 50, 200, 2.0, 1e-3
#: Pseudo-votes of a labeler on false and on true spans: better than chance, but few.
PRIOR_VOTES = ({-1: 4.0, 0: 2.0, 1: 1.0}, {-1: 1.0, 0: 2.0, 1: 4.0})
#: Pseudo-votes that a kind's tables take from those of all kinds.
KIND_PRIOR = 20.0
#: A proposed span is added from this probability on.
THRESHOLD = 0.5

SPAN = "struct<k:int,s:int,e:int,m:string,b:string,a:string>"


def _located(text: Column, pattern: str, kind: int) -> Column:
    """Matches of ``pattern``: kind, code points [start, end), matched text, the text
    before it (at most ``CONTEXT``) and the two characters after.

    The pieces that ``split`` leaves between matches give positions and context, so
    nothing is counted from the text's beginning again."""

    def rows(ms: Column, gaps: Column) -> Column:
        pairs = F.slice(F.arrays_zip(F.transform(ms, F.length).alias("n"), F.transform(gaps, F.length).alias("gap")), 1, F.size(ms))
        starts = scan(pairs, F.lit(0), "int", lambda at, x: (at + x["gap"] + x["n"], at + x["gap"]))
        before = F.transform(gaps, lambda g: F.when(g == "", "").otherwise(F.right(g, F.lit(CONTEXT))))
        after = F.transform(F.slice(gaps, 2, F.size(ms)), lambda g: F.left(g, F.lit(2)))
        every = F.slice(F.arrays_zip(starts.alias("s"), ms.alias("m"), before.alias("b"), after.alias("a")), 1, F.size(ms))
        return F.transform(every, lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = bind(matches, lambda ms: bind(F.split(text, pattern, -1), lambda gaps: rows(ms, gaps)))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; matches that fail their test are dropped."""
    n = lambda m: F.length(_digits(m))
    return {
        "email": F.when(F.contains(text, F.lit("@")), _located(text, EMAIL, 0)),
        "ip": F.filter(_located(text, IP, 1), lambda x: F.regexp_like(x["m"], F.lit(IP_VALID))),
        "card": F.filter(_located(text, CARD, 2), lambda x: n(x["m"]).between(13, 19) & _luhn(_digits(x["m"]))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_located(text, PHONE, 3), lambda x: n(x["m"]).between(9, 15))),
    }


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _added_kind(m: Column) -> Column:
    return (
        F.when(F.regexp_like(m, F.lit("^[0-9a-f]{32,}$")), 4)
        .when(F.regexp_like(m, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), 6)
        .when(F.regexp_like(m, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")), 7)
        .when(F.regexp_like(m, F.lit(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}$")), 5)
        .otherwise(4)
    )


def votes(x: Column) -> list[Column]:
    """+1, 0 or -1 of each labeler on a span, in the order of ``LABELERS``."""
    m, k, before, after = x["m"], x["k"], x["b"], x["a"]
    lowered = F.lower(before)
    kind_is = lambda names: k.isin([KINDS.index(n) for n in names])
    shape = (
        F.when(kind_is(("email", "phone")), 1)
        .when(k == KINDS.index("ip"), F.when(F.regexp_like(m, F.lit(r"^[1-9][0-9]*(\.(0|[1-9][0-9]*)){3}$")), 1).otherwise(-1))
        .when(k == KINDS.index("card"), F.when(F.length(_digits(m)).isin(15, 16), 1).otherwise(0))
        .when(k == KINDS.index("secret"), F.when(F.length(m).isin(32, 40, 64, 128), 1).when(F.regexp_like(m, F.lit("[^0-9a-f]")), 0).otherwise(-1))
        .when(k == KINDS.index("identity"), F.when(F.regexp_like(m, F.lit("^(000|666|9..)|-00-|-0000$")), -1).otherwise(1))
        .when(k == KINDS.index("account"), F.when(F.length(m).between(15, 34), 1).otherwise(-1))
        .otherwise(F.when(F.regexp_like(m, F.lit(r"^\(?[2-9]")), 1).otherwise(-1))
    )
    words = reduce(lambda c, i: c.when(k == i, F.regexp_like(lowered, F.lit(rf"\b(?:{GAZETTEER[KINDS[i]]})"))), range(len(KINDS)), F.when(F.lit(False), False))
    gazetteer = F.when(words, 1).otherwise(0)
    around = F.when(F.regexp_like(before, F.lit(r"[=:]\s*[\"']?$")), 1).when(F.regexp_like(before, F.lit(r"[/\\_#&=-]$")) | F.regexp_like(after, F.lit(r"^[/\\_-]")), -1).otherwise(0)
    against = F.when(F.regexp_like(lowered, F.lit(rf"\b(?:{AGAINST})\b")), -1).otherwise(0)
    varied = _variety(m)
    mix = F.when(varied <= 3, -1).when(k == KINDS.index("secret"), F.when(F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[A-Za-z]")), 1).otherwise(-1)).otherwise(0)
    return [v.cast("int") for v in (shape, gazetteer, around, against, mix)]


def _variety(m: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^A-Za-z0-9]", ""), "")))


def features(x: Column) -> list[Column]:
    """The class of a span in each of ``FEATURES``."""
    m, n = x["m"], F.length(x["m"])
    length = reduce(lambda c, i: c.when(n <= (8, 12, 16, 24)[i], i), range(4), F.when(F.lit(False), 0)).otherwise(4)
    share = F.length(_digits(m)) / n
    digits = F.when(share == 0, 0).when(share < 1 / 3, 1).when(share < 2 / 3, 2).otherwise(3)
    spread = _variety(m) / F.least(n, F.lit(16))
    variety = F.when(spread < 0.4, 0).when(spread < 0.7, 1).otherwise(2)
    last = F.right(x["b"], F.lit(1))
    before = F.when((x["b"] == "") | F.regexp_like(last, F.lit(r"\s")), 0).when(last.isin("'", '"'), 1).when(last.isin(":", "=", "("), 2).when(F.regexp_like(last, F.lit("[A-Za-z0-9]")), 4).otherwise(3)
    first = F.left(x["a"], F.lit(1))
    after = F.when((x["a"] == "") | F.regexp_like(first, F.lit(r"\s")), 0).when(first.isin("'", '"'), 1).when(first.isin(".", ",", ";", ":", "!", "?", ")"), 2).otherwise(3)
    return [f.cast("int") for f in (length, digits, variety, before, after)]


Tables = list[list[dict[int, float]]]


def _odds(share: float, tables: Tables, pattern: tuple[int, ...]) -> float:
    """Log odds of a true span. An abstention says nothing; a labeler that has proved
    worse than chance counts against its own direction."""
    odds = math.log(share / (1 - share)) + sum(math.log(tables[j][1][v] / tables[j][0][v]) for j, v in enumerate(pattern) if v)
    return max(-30.0, min(30.0, odds))


def _chance(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def estimate(counts: dict[tuple[int, ...], int], prior: list | None = None) -> tuple[float, Tables]:
    """Expectation-maximisation over counts of vote patterns: the share of true spans,
    and per labeler the probability of each vote given false and true. ``prior``: per
    labeler the pseudo-votes on false and on true spans."""
    prior = prior or [PRIOR_VOTES] * len(LABELERS)
    belief = {p: 0.9 if sum(p) > 0 else 0.1 if sum(p) < 0 else 0.5 for p in counts}
    share, tables, total = 0.5, [], sum(counts.values())
    for _ in range(EM_ROUNDS):
        share = min(0.99, max(0.01, sum(n * belief[p] for p, n in counts.items()) / total))
        tables = []
        for j in range(len(LABELERS)):
            pair = []
            for true in (0, 1):
                mass = dict(prior[j][true])
                for p, n in counts.items():
                    mass[p[j]] += n * (belief[p] if true else 1 - belief[p])
                pair.append({v: m / sum(mass.values()) for v, m in mass.items()})
            tables.append(pair)
        belief = {p: _chance(_odds(share, tables, p)) for p in counts}
    return share, tables


def posteriors(counts: dict[tuple[int, ...], int], prior: list | None = None) -> dict[tuple[int, ...], float]:
    share, tables = estimate(counts, prior)
    return {p: _chance(_odds(share, tables, p)) for p in counts}


def beliefs(counts: dict[tuple, int]) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior by (kind, votes) from counts by (kind, votes, features). Reliabilities
    are estimated per kind; those of all kinds give ``KIND_PRIOR`` pseudo-votes."""
    every: dict[tuple[int, ...], int] = {}
    own: dict[int, dict[tuple[int, ...], int]] = {}
    for (k, v, _), n in sorted(counts.items()):
        every[v] = every.get(v, 0) + n
        own.setdefault(k, {})
        own[k][v] = own[k].get(v, 0) + n
    if not every:
        return {}
    tables = estimate(every)[1]
    prior = [tuple({vote: KIND_PRIOR * p for vote, p in side.items()} for side in pair) for pair in tables]
    return {(k, v): p for k, of in own.items() for v, p in posteriors(of, prior).items()}


def active(kind: int, vote: tuple[int, ...], feature: tuple[int, ...]) -> list[tuple[int, float]]:
    """The inputs of the classifier that are not zero: place and value."""
    inputs = [(0, 1.0), (OFFSETS[0] + kind, 1.0)]
    inputs += [(OFFSETS[1] + j, float(v)) for j, v in enumerate(vote) if v]
    return inputs + [(OFFSETS[2 + j] + f, 1.0) for j, f in enumerate(feature)]


def fit(counts: dict[tuple, int]) -> list[float]:
    """Weights of a logistic classifier of (kind, votes, features), fitted to the
    posteriors. All sums run over distinct inputs, of which there are at most as
    many as there are combinations, however many spans the corpus has."""
    weights = [0.0] * OFFSETS[-1]
    if not counts:
        return weights
    target, total = beliefs(counts), sum(counts.values())
    rows = [(active(*key), n / total, target[key[:2]]) for key, n in sorted(counts.items())]
    for _ in range(FIT_ROUNDS):
        slope = [SHRINK * w for w in weights]
        for inputs, n, y in rows:
            error = n * (_chance(sum(weights[i] * x for i, x in inputs)) - y)
            for i, x in inputs:
                slope[i] += error * x
        weights = [w - FIT_STEP * s for w, s in zip(weights, slope)]
    return [round(w, 9) for w in weights]


def _clear(base: Column, wide: Column) -> Column:
    """The spans of ``wide`` (disjoint, in order) that touch none of ``base``: both in
    one order, those that begin before the last end so far, or end after the next
    start, touch one."""
    mark = lambda xs, w: F.transform(xs, lambda x, i: F.struct(x["s"].alias("s"), F.lit(w).alias("w"), x["e"].alias("e"), i.alias("i")))

    def tested(events: Column) -> Column:
        own = lambda x: x["w"] == 1
        ahead = scan(events, F.lit(0), "boolean", lambda end, x: (F.when(own(x), end).otherwise(F.greatest(end, x["e"])), own(x) & (x["s"] >= end)))
        back = scan(F.reverse(events), F.lit(1 << 30), "boolean", lambda start, x: (F.when(own(x), start).otherwise(x["s"]), own(x) & (x["e"] <= start)))
        both = F.arrays_zip(events.alias("x"), ahead.alias("p"), F.reverse(back).alias("q"))
        return F.transform(F.filter(both, lambda z: z["p"] & z["q"]), lambda z: z["x"]["i"])

    events = F.array_sort(F.concat(mark(base, 0), mark(wide, 1)))
    free = bind(events, lambda es: bind(tested(es), lambda kept: F.transform(kept, lambda i: F.get(wide, i))))
    return F.when(F.size(wide) == 0, wide).when(F.size(base) == 0, wide).otherwise(free)


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__base`` (kept base spans by kind and start) and ``__voted`` (all
    spans with their votes and features)."""
    columns = docs.columns
    none = F.array().cast(f"array<{SPAN}>")
    found = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    found = found.select(*columns, *(F.coalesce(c, none).alias(f"__{name}") for name, c in base_spans(F.col("__text")).items()), _located(F.col("__text"), ADDED, -1).alias("__wide"))
    found = found.select(*columns, F.concat(*(f"__{k}" for k in BASE_KINDS)).alias("__found"), "__wide")
    # Proposed spans that touch a base span are that span already.
    wide = F.transform(_clear(F.col("__found"), F.col("__wide")), lambda x: F.struct(_added_kind(x["m"]).cast("int").alias("k"), *(x[f].alias(f) for f in ("s", "e", "m", "b", "a"))))
    found = found.select(*columns, "__found", F.concat("__found", wide).alias("__both"))

    def voted(x: Column) -> Column:
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*votes(x)).alias("v"), F.array(*features(x)).alias("f"))

    empty = F.array().cast("array<struct<k:int,s:int,e:int,v:array<int>,f:array<int>>>")
    strip = F.transform("__found", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select(*columns, strip.alias("__base"), F.when(F.size("__both") > 0, F.transform("__both", voted)).otherwise(empty).alias("__voted"))


def spans(docs: DataFrame, workspace: common.Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, __base, __voted``, written once so that a query searches its
    texts once."""
    found = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__source")), "__source")
    return workspace.stage(found.drop("__source"), "spans")


def classifier(found: DataFrame) -> list[float]:
    """Weights from the corpus's counts of (kind, votes, features)."""
    patterns = found.where(F.size("__voted") > 0).select(F.explode("__voted").alias("x")).groupBy("x.k", "x.v", "x.f").count()
    return fit({(r["k"], tuple(r["v"]), tuple(r["f"])): r["count"] for r in patterns.collect()})


def decided(weights: list[float]) -> Column:
    """The base spans, by kind and start, then those proposed that the classifier takes."""
    held = F.array(*(F.lit(float(w)) for w in weights))

    def score(x: Column) -> Column:
        total = F.lit(weights[0]) + F.get(held, x["k"] + OFFSETS[0])
        for j in range(len(LABELERS)):
            total = total + F.lit(weights[OFFSETS[1] + j]) * x["v"][j]
        for j in range(len(FEATURES)):
            total = total + F.get(held, x["f"][j] + OFFSETS[2 + j])
        return total

    least = math.log(THRESHOLD / (1 - THRESHOLD))
    taken = F.filter("__voted", lambda x: (x["k"] >= len(BASE_KINDS)) & (score(x) > least))
    taken = F.array_sort(F.transform(taken, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.concat("__base", taken)


def show(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and digest cover the base spans. A null or empty text has none (the
    digest of the empty string); null and repeated ids are carried along; other
    columns are ignored; with no span in the corpus the classifier takes none.
    """
    ws = common.Workspace(docs.sparkSession, "pii")
    found = spans(docs, ws, id_col, text_col)
    result = found.select("doc_id", "__base", decided(classifier(found)).alias("__all"))
    count = lambda k: F.size(F.filter("__base", lambda x: x["k"] == k)).cast("long")
    return result.select("doc_id", *(count(i).alias(f"n_{name}") for i, name in enumerate(BASE_KINDS)), F.sha2(show(F.col("__base")), 256).alias("base_sha256"), show(F.col("__all")).alias("spans"))


#: Code points in a piece of a text, so that a stretch is cut from a piece, not from the
#: text's beginning.
PIECE = 2048


def _replaced(text: Column, found: Column) -> Column:
    """``text`` with each stretch of spans replaced by the kind that begins it."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["k"].alias("k"))))
    cuts = scan(ordered, F.lit(0), "struct<from:int,to:int,k:int>", lambda at, x: (F.greatest(at, -x["e"]), F.struct(at.alias("from"), F.when(x["s"] >= at, x["s"]).otherwise(-1).alias("to"), x["k"].alias("k"))))
    cuts = F.filter(cuts, lambda x: x["to"] >= 0)

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        held = F.when(first == last, F.get(pieces, first)).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
        return F.when(start >= end, "").otherwise(F.substring(held, start - first * PIECE + 1, end - start))

    def built(pieces: Column) -> Column:
        shown = F.transform(cuts, lambda x: F.concat(between(pieces, x["from"], x["to"]), F.lit("<"), F.get(names, x["k"]), F.lit(">")))
        tail = between(pieces, F.array_max(F.transform(found, lambda x: x["e"])), F.length(text))
        return F.concat(F.array_join(shown, ""), tail)

    return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), built)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets.

    Texts without a span stay as they are, null and empty texts too; ``length_col``, if
    there is one, follows the text; every other column is unchanged, whatever its name
    (names that begin with two underscores are the operator's own). Kinds can overlap
    one another: what overlaps is replaced as one stretch, named by the span that
    starts first, then by the longer. Null and repeated ids do not matter, no row is
    dropped, and an empty table gives an empty result. The texts are searched once:
    rows are written with their spans, the classifier is trained, the rows are read.
    """
    ws = common.Workspace(docs.sparkSession, "redact")
    found = ws.stage(with_spans(docs, text_col), "spans")
    found = found.withColumn("__all", decided(classifier(found)))
    new = F.when(F.size("__all") > 0, _replaced(F.col(text_col), F.col("__all"))).otherwise(F.col(text_col))
    done = found.withColumn("__new", new)
    kept = {text_col: F.col("__new").alias(text_col)}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        kept[length_col] = F.when(F.size("__all") > 0, F.length("__new")).otherwise(F.col(length_col)).cast(kind).alias(length_col)
    return done.select(*(kept.get(c, F.col(f"`{c}`")) for c in docs.columns))
