"""URL rules, personal data, language identification, the pipeline."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import language, pii, url_rules

from .data import BASIC, ROWS, documents, nothing

RULES = [("com", "/en/", "block"), ("Example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("x.org", "", "block"), ("x.org", "/a", "allow"), ("x.org", "/a", "block"), (None, "/", "block"), ("com", None, "allow")]
URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/7?x#y", "https://a.b.example.com/en/71", "https://notexample.com/en/7", "https://com/en/", "https://example.com./en/7", "http://www.net/de/8",
    "http://example.net/de/8", "http://example.net/de/9", "HTTP://USER@x.org:80/a", "http://x.org/b", "http://sub.x.org/ab", "http://x.org?q=/a", "http://x.org#/a", "http:///en/", "x://com/en/y://net/de/", "http://é.com/en/",
    "http://x.org/" + "p" * 5000,
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    tidy = {}
    for h, p, v in rules:
        if h is not None:
            k = (h.lower(), p or "")
            tidy[k] = max(v, tidy.get(k, ""))
    fits = [(len(h + p), v, h + p) for (h, p), v in tidy.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, "allow", None)
    return host, path, best[2], best[1]


def run_rules(spark, urls, rules):
    rows = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[0] if urls else None, "h", "r")], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(rows, table).collect()}


def test_op5(spark):
    got = run_rules(spark, URLS, RULES)
    assert got == {i: brute_verdict(u, RULES) for i, u in enumerate(URLS)} | {None: brute_verdict(URLS[0], RULES)}


def test_op5_query_judges_by_its_contract(spark, tmp_path):
    from foliospark.llm import queries

    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    rules = [(host, "/" + path, verdict) for verdict, rule in (x.split(" ") for x in contract.split(", ")) for host, path in [rule.split("/", 1)]]
    assert queries.URL_RULES == rules
    urls = [f"http://{h}{p}" for h in ("a.com", "example.com", "a.net", "m.example.net", "b.org", "net") for p in ("/en/7", "/en/1", "/de/8x", "/de/9", "/es/", "")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op5_url_rules(spark, str(tmp_path)).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert got[urls.index("http://a.net/de/9")] == ("a.net", "/de/9", "net/de/", "allow")


def test_rules_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "SAMPLED_PER_RANGE", 2)
    rng = random.Random(4)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    path = lambda: "".join("/" + rng.choice("xyz") for _ in range(rng.randrange(0, 5)))
    urls = [f"http://{rng.choice(hosts)}{path()}" for _ in range(400)] * 2
    rules = [(rng.choice(hosts), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    got = run_rules(spark, urls, rules)
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)} | {None: brute_verdict(urls[0], rules)}


def test_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    from foliospark.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    assert run_rules(spark, URLS, RULES) == {i: brute_verdict(u, RULES) for i, u in enumerate(URLS)} | {None: brute_verdict(URLS[0], RULES)}
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    plan = url_rules.judge(rows, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_rules_and_pages_may_be_missing(spark):
    assert {v[3] for v in run_rules(spark, URLS, []).values()} == {"allow"}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute_base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def check_base(spark, rows):
    got = sorted([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(documents(spark, rows)).collect()], key=str)
    expected = []
    for i, t in rows:
        spans = brute_base(t)
        expected.append((i, *(sum(s.startswith(k + ":") for s in spans) for k in BASE), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert got == sorted(expected, key=str)


def test_op9_on_awkward_rows(spark):
    hard = ["a@b.c_d@e.f.g h@i", "1.2.3.4.5.6.7.8 000.0255.1.1 999.1.1.1 1.1.1.256", "4111-1111 11111111 0 4111111111111112", "+1 (743) 555-3824 +12345 ++1 23 45 67 89", "\U0001f600\U0001f600 x@y.z \U0001f600 10.0.0.1", "a" * 50_000 + "@b.c", "1 " * 20_000, "." * 1000 + "@" * 50]
    check_base(spark, ROWS + [(100 + i, t) for i, t in enumerate(hard)])
    assert pii.find(nothing(spark)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1249@.- +()%_é\U0001f600", max_size=120), min_size=1, max_size=30))
def test_base_spans_equal_brute_force(spark, texts):
    check_base(spark, list(enumerate(texts)))


def test_secrets_are_added_and_clean_text_is_left_alone(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, f"nothing here {i} of note") for i in range(30)] + [(50, f'set token = "{secret}" then'), (51, f"sha1 checksum {secret}0 commit"), (52, "mail me a@b.cd")]
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, rows)).collect()}
    assert got[50] == "secret:13:53" and got[52] == "email:8:14" and got[51] == "" and all(got[i] == "" for i in range(30))


def test_label_model_ranks_labelers():
    counts = {(1, 1, 1, 0, 1): 50, (1, 0, 0, 0, 0): 400, (-1, 0, -1, 0, -1): 60, (-1, 0, 0, -1, 0): 30}
    p = pii.posteriors(counts)
    assert p[(1, 1, 1, 0, 1)] > 0.9 > 0.1 > p[(-1, 0, -1, 0, -1)]
    weights = pii.fit({(1, v, (0, 0, 0, 0, 0)): n for v, n in counts.items()})
    score = lambda v: sum(weights[i] * x for i, x in pii.active(1, v, (0, 0, 0, 0, 0)))
    assert score((1, 1, 1, 0, 1)) > 0 > score((-1, 0, -1, 0, -1)) and not any(pii.fit({}))


def brute_em(spans, prior):
    """Expectation-maximisation over single spans, each a tuple of votes."""
    import math

    belief = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v in spans]
    for _ in range(pii.EM_ROUNDS):
        share = min(0.99, max(0.01, sum(belief) / len(spans)))
        given = []
        for j in range(len(pii.LABELERS)):
            sides = []
            for true in (0, 1):
                mass = {x: prior[j][true][x] + sum((b if true else 1 - b) for b, v in zip(belief, spans) if v[j] == x) for x in (-1, 0, 1)}
                sides.append({x: m / sum(mass.values()) for x, m in mass.items()})
            given.append(sides)
        odds = [math.log(share / (1 - share)) + sum(math.log(given[j][1][x] / given[j][0][x]) for j, x in enumerate(v) if x) for v in spans]
        belief = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    return belief, given


def drawn_spans(seed, n, good=0.9, bad=None):
    """True and false spans; labelers vote rightly with chance ``good``, the last with ``bad``."""
    rng = random.Random(seed)
    truth = [rng.random() < 0.6 for _ in range(n)]
    chance = lambda j: bad if bad is not None and j == 4 else good
    votes = [tuple(rng.choice((0, 1)) and (1 if (rng.random() < chance(j)) == t else -1) for j in range(5)) for t in truth]
    return truth, votes


def test_em_on_counts_equals_em_on_spans():
    _, votes = drawn_spans(1, 300)
    counts = {v: votes.count(v) for v in votes}
    belief, _ = brute_em(votes, [pii.PRIOR_VOTES] * 5)
    found = pii.posteriors(counts)
    assert max(abs(found[v] - b) for v, b in zip(votes, belief)) < 1e-9


def test_reliabilities_are_estimated_per_kind():
    a, b = drawn_spans(2, 200)[1], drawn_spans(3, 200, bad=0.2)[1]
    counts = {}
    for k, votes in ((1, a), (4, b)):
        for v in votes:
            key = (k, v, (0, 0, 0, 0, 0))
            counts[key] = counts.get(key, 0) + 1
    _, given = brute_em(a + b, [pii.PRIOR_VOTES] * 5)
    prior = [tuple({x: pii.KIND_PRIOR * p for x, p in side.items()} for side in pair) for pair in given]
    found = pii.beliefs(counts)
    for k, votes in ((1, a), (4, b)):
        own, _ = brute_em(votes, prior)
        assert max(abs(found[(k, v)] - p) for v, p in zip(votes, own)) < 1e-9


def test_a_bad_labeler_is_found():
    truth, votes = drawn_spans(4, 3000, bad=0.1)
    _, tables = pii.estimate({v: votes.count(v) for v in set(votes)})
    assert tables[4][1][1] < tables[4][0][1] and tables[0][1][1] > tables[0][0][1]
    belief = pii.posteriors({v: votes.count(v) for v in set(votes)})
    heard = [(t, v) for t, v in zip(truth, votes) if sum(map(abs, v)) >= 3]
    assert sum((belief[v] > 0.5) == t for t, v in heard) > 0.93 * len(heard)


def python_span(k, m, before, after):
    """Votes and features of a span, recomputed."""
    kind, low, n = pii.KINDS[k], before.lower(), len(m)
    digits = re.sub("[^0-9]", "", m)
    variety = len(set(re.sub("[^A-Za-z0-9]", "", m)))
    if kind in ("email", "phone"):
        shape = 1
    elif kind == "ip":
        shape = 1 if re.match(r"[1-9][0-9]*(\.(0|[1-9][0-9]*)){3}$", m) else -1
    elif kind == "card":
        shape = 1 if len(digits) in (15, 16) else 0
    elif kind == "secret":
        shape = 1 if n in (32, 40, 64, 128) else 0 if re.search("[^0-9a-f]", m) else -1
    elif kind == "identity":
        shape = -1 if re.search("^(000|666|9..)|-00-|-0000$", m) else 1
    elif kind == "account":
        shape = 1 if 15 <= n <= 34 else -1
    else:
        shape = 1 if re.match(r"\(?[2-9]", m) else -1
    gazetteer = int(bool(re.search(rf"\b(?:{pii.GAZETTEER[kind]})", low)))
    around = 1 if re.search("[=:]\\s*[\"']?$", before) else -1 if re.search(r"[/\\_#&=-]$", before) or re.match(r"[/\\_-]", after) else 0
    against = -1 if re.search(rf"\b(?:{pii.AGAINST})\b", low) else 0
    mix = -1 if variety <= 3 else (1 if re.search("[0-9]", m) and re.search("[A-Za-z]", m) else -1) if kind == "secret" else 0
    share, spread = len(digits) / n, variety / min(n, 16)
    last, first = before[-1:], after[:1]
    side = 0 if not last or last.isspace() else 1 if last in "'\"" else 2 if last in ":=(" else 4 if re.match("[A-Za-z0-9]", last) else 3
    other = 0 if not first or first.isspace() else 1 if first in "'\"" else 2 if first in ".,;:!?)" else 3
    feature = (sum(n > x for x in (8, 12, 16, 24)), 0 if share == 0 else 1 if share < 1 / 3 else 2 if share < 2 / 3 else 3, 0 if spread < 0.4 else 1 if spread < 0.7 else 2, side, other)
    return (shape, gazetteer, around, against, mix), feature


def brute_spans(rows):
    """All spans of each row: base rules, proposals clear of them, the classifier."""
    import regex

    def hits(pattern, text):
        out, at = [], 0
        for m in pattern.finditer(text):
            out.append((m.start(), m.end(), m[0], text[at : m.start()][-pii.CONTEXT :]))
            at = m.end()
        return out

    found = []
    for _, text in rows:
        text, own = text or "", []
        for k, (p, ok) in enumerate(BASE.values()):
            own += [(k, *h) for h in hits(re.compile(p), text) if ok(h[2])]
        base = list(own)
        for s, e, m, b in hits(regex.compile(pii.ADDED), text):
            if not any(x[1] < e and s < x[2] for x in base):
                k = 4 if re.fullmatch("[0-9a-f]{32,}", m) else 6 if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m) else 7 if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", m) else 5 if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", m) else 4
                own.append((k, s, e, m, b))
        after = {}
        for k, s, e, m, b in own:  # up to the next match of the same pattern, two characters
            pattern = regex.compile(pii.ADDED) if k >= 4 else re.compile(list(BASE.values())[k][0])
            follow = next((x[0] for x in hits(pattern, text) if x[0] >= e), len(text))
            after[k, s] = text[e : min(follow, e + 2)]
        found.append([(k, s, e, python_span(k, m, b, after[k, s])) for k, s, e, m, b in own])
    counts = {}
    for own in found:
        for k, _, _, (v, f) in own:
            counts[k, v, f] = counts.get((k, v, f), 0) + 1
    weights = pii.fit(counts)
    out = {}
    for (i, _), own in zip(rows, found):
        taken = sorted((k, s, e) for k, s, e, (v, f) in own if k >= 4 and sum(weights[j] * x for j, x in pii.active(k, v, f)) > 0)
        out[i] = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in [x[:3] for x in own if x[0] < 4] + taken)
    return out


def personal_texts(seed, n):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    parts = [
        lambda: f'token = "{hexes(40)}"', lambda: f"password: {hexes(12)}Z", lambda: f"md5 checksum {hexes(32)}", lambda: f"commit/{hexes(40)}", lambda: "0" * 32, lambda: hexes(200),
        lambda: f"call (2{rng.randrange(10, 99)}) 555-{rng.randrange(1000, 9999)}", lambda: f"part no 0{rng.randrange(10, 99)}.555.{rng.randrange(1000, 9999)}", lambda: f"ssn {rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", lambda: "900-00-0000",
        lambda: f"IBAN DE{rng.randrange(10, 99)}{rng.randrange(10**15, 10**16)}", lambda: f"x@y{rng.randrange(9)}.org", lambda: f"server 10.0.{rng.randrange(300)}.1", lambda: "version 1.02.3.4", lambda: f"+1 (743) 555-{rng.randrange(1000, 9999)}", lambda: "4111 1111 1111 1111",
        lambda: "secret='caf\u00e9 9'", lambda: "words \U0001f600 and more",
    ]
    return [(i, " ".join(rng.choice(parts)() + rng.choice(["", ".", ",", "/x"]) for _ in range(rng.randrange(0, 7)))) for i in range(n)]


def test_added_spans_equal_brute_force(spark):
    rows = personal_texts(5, 400)
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, rows)).collect()}
    assert got == brute_spans(rows)
    assert any("secret" in x for x in got.values()) and any("identity" in x for x in got.values())


def test_planted_secrets_against_decoys(spark):
    """What the classifier takes, judged by how the texts were made."""
    rng, rows, planted = random.Random(6), [], set()
    for i in range(300):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        text = rng.choice(['token = "{}"', "secret: {}", "password={} now"]) if i % 2 else rng.choice(["commit {}/x", "sha1 checksum {}", "md5 {}_y"])
        planted |= {i} if i % 2 else set()
        rows.append((i, "some words " + text.format(value) + " follow"))
    got = {r.doc_id for r in pii.find(documents(spark, rows)).where("spans <> ''").collect()}
    assert len(got & planted) > 0.95 * len(planted) and len(got - planted) < 0.05 * len(rows)


def test_redaction(spark):
    rows = [(1, "ask jo@x.com or +1 (743) 555-3824!"), (2, None), (3, "clean"), (4, "")]
    out = {r.doc_id: r for r in pii.redact(documents(spark, rows)).collect()}
    assert out[1].text == "ask <email> or <phone>!" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean" and out[4].text == ""
    assert pii.redact(nothing(spark)).collect() == [] and pii.redact(nothing(spark)).columns == nothing(spark).columns


def brute_redaction(text, spans):
    out, at = "", 0
    for s, e, name in sorted((int(s), int(e), n) for n, s, e in (x.split(":") for x in spans.split(",") if x)):
        longest = max([int(x.split(":")[2]) for x in spans.split(",") if int(x.split(":")[1]) == s], default=e)
        if s >= at:
            name = min((pii.KINDS.index(x.split(":")[0]), x.split(":")[0]) for x in spans.split(",") if int(x.split(":")[1]) == s and int(x.split(":")[2]) == longest)[1]
            out += text[at:s] + f"<{name}>"
        at = max(at, longest, e)
    return out + text[at:]


def test_redaction_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 16)
    rows = personal_texts(7, 300) + [(900, "4111 1111 1111 1111@x.org 1.2.3.4@y.net"), (901, "\U0001f600\U0001f600 +1 (743) 555-3824@mail.org"), (901, None), (None, "x@y.org"), (None, "a" * 100 + " 10.0.0.1 " + "\n" * 50)]
    frame = documents(spark, rows)
    spans = brute_spans(rows_by_place := list(enumerate(t for _, t in rows)))
    want = sorted(((i, None if t is None else brute_redaction(t, spans[n])) for n, (i, t) in enumerate(rows)), key=str)
    out = pii.redact(frame)
    got = out.collect()
    assert out.columns == frame.columns and len(rows_by_place) == len(got)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert all(r.n_chars == len(r.text or "") and r.kept and r.spans == "x" and r.start == 1 for r in got)


def test_many_spans_cost_in_proportion(spark):
    import time

    def seconds(n):
        row = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("é 10.0.0.1 x@y.zz "), n).alias("text"))
        began = time.time()
        assert pii.redact(row).first().text == "é <ip> <email> " * n
        return time.time() - began

    seconds(1000)
    assert seconds(50_000) < 10 * max(1.0, seconds(10_000))


def test_native_plan(spark):
    plan = pii.find(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


SAMPLES = {"en": "the house and the garden with those that were there", "de": "das Haus und der Garten mit denen die dort waren", "fr": "la maison et le jardin avec ceux qui étaient là", "es": "la casa y el jardín con los que estaban allí"}


def test_language_held_out():
    rng = random.Random(6)
    draw = lambda lang: " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(40))
    model = language.train([(draw(lang), lang) for lang in SAMPLES for _ in range(40)])
    for lang in SAMPLES:
        for _ in range(20):
            lp = model[language.trigrams(draw(lang).encode())].sum(axis=0)
            assert language.CLASSES[int(lp.argmax())] == lang


def labelled(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(30)), lang, f"host.{lang}", 1) for i, lang in enumerate(list(SAMPLES) * 25)]
    return spark.createDataFrame(rows, BASIC)


def test_op10_awkward_rows(spark):
    docs = documents(spark, clash=False).unionAll(labelled(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    docs = docs.unionAll(spark.createDataFrame([(900, "the house and the garden", None, None, 1), (901, "!!! 123 ###", "en", "src0", 1), (902, "漢字仮名交じり文" * 9, "xx", "src0", 1)], BASIC))
    rows = {r.doc_id: r for r in language.identify(language.document_evidence(docs), docs).collect()}
    assert rows[900].lang == "en" and rows[900].kept and rows[901].lang == "und" and not rows[902].kept
    assert rows[1].lang == "und" and not rows[1].kept
    assert all(rows[1000 + i].lang == lang for i, lang in enumerate(list(SAMPLES) * 25))
    assert language.identify(language.document_evidence(docs.limit(0)), docs.limit(0)).count() == 0


def test_short_text_follows_its_host(spark):
    docs = labelled(spark).unionAll(spark.createDataFrame([(500, "la", "", "host.fr", 1), (501, "la", "", "host.es", 1)], BASIC))
    rows = {r.doc_id: r for r in language.identify(language.document_evidence(docs), labelled(spark)).collect()}
    assert rows[500].lang == "fr" and rows[501].lang == "es"


def test_page_evidence(spark):
    rows = spark.createDataFrame([(1, "https://a.example.fr:80/x", "<html lang='fr-CA'><script>var x</script><p>la&nbsp;maison</p>"), (2, None, None)], "page_id long, url string, html string")
    a, b = language.page_evidence(rows).orderBy("page_id").collect()
    assert (a.tag, a.suffix, a.host, a.text.split()) == ("fr", "fr", "a.example.fr:80", ["la", "maison"])
    assert (b.tag, b.suffix, b.host, b.text) == ("", "", "", "")
    judged = language.identify(language.page_evidence(rows), labelled(spark)).orderBy("page_id").collect()
    assert [(r.declared, r.lang) for r in judged] == [("fr", "fr"), ("none", "und")]


def brute_posterior(rows, classes):
    """The fused posterior of each row (declared, suffix, host, lp, best), recomputed."""
    import math

    k = len(classes)
    count = lambda some: [sum(r[4] == i for r in some) for i in range(k)]
    base = [1.0 + n for n in count(rows)]
    base[-1] = language.UNKNOWN_PRIOR * sum(base[:-1])
    overall = [b / sum(base) for b in base]
    told = {d: count([r for r in rows if r[0] == d]) for d in sorted({r[0] for r in rows} - {"none"})}
    seen = [sum(n[i] for n in told.values()) for i in range(k)]
    smooth = lambda own, above: [(n + language.STRENGTH * p) / (sum(own) + language.STRENGTH) for n, p in zip(own, above)]
    out = []
    for declared, suffix, host, lp, best in rows:
        at_suffix = smooth(count([r for r in rows if r[1] == suffix]), overall)
        others = count([r for r in rows if r[1] == suffix and r[2] == host])
        if best is not None:
            others[best] -= 1
        prior = smooth(others, at_suffix)
        evidence = [0.0] * k if declared == "none" else [math.log((told[declared][i] + 1) / (seen[i] + len(told))) if i < k - 1 else math.log(1 / len(told)) for i in range(k)]
        logs = [a + b + math.log(c) for a, b, c in zip(lp, evidence, prior)]
        top = max(logs)
        lang = "und" if best is None else classes[logs.index(top)]
        out.append((lang, 1 / sum(math.exp(x - top) for x in logs)))
    return out


def test_fused_posterior_equals_brute_force(spark):
    from foliospark.llm import common

    rng, rows = random.Random(11), []
    for _ in range(400):
        lp = [round(rng.gauss(0, 3), 6) for _ in range(4)] + [-8.0]
        best = rng.choice([lp.index(max(lp))] * 9 + [None])
        rows.append((rng.choice(["none", "de", "en", "fr", "other"]), rng.choice(["com", "de", ""]), f"h{int(rng.random() ** 3 * 30)}", lp, best))
    frame = spark.createDataFrame([(i, None, *r) for i, r in enumerate(rows)], "doc_id long, page_id long, declared string, suffix string, host string, lp array<double>, best int")
    ws = common.Workspace(spark, "t")
    got = {r.doc_id: (r.lang, r.posterior, r.kept) for r in language.fuse(ws.stage(frame, "scored"), ws).collect()}
    for i, (lang, p) in enumerate(brute_posterior(rows, language.CLASSES)):
        assert got[i][0] == lang and abs(got[i][1] - p) < 2e-6 and got[i][2] == (lang != "und" and got[i][1] >= language.MIN_POSTERIOR)


def test_model_of_tasks_equals_model_of_rows(spark):
    docs = labelled(spark).repartition(7)
    rows = [(r.text, r.lang) for r in docs.collect()]
    model = language.trained(docs, language.label_counts(docs), language.LANGUAGES)
    assert (model == language.train(rows)).all() and language.label_counts(docs) == dict.fromkeys(SAMPLES, 25)


def test_languages_come_from_the_labels(spark):
    italian = "la casa e il giardino con quelli che erano di là".split()
    rng = random.Random(12)
    rows = [(2000 + i, " ".join(rng.choice(italian) for _ in range(40)), "it-IT", "host.it", 1) for i in range(30)] + [(3000, "x y z", "?", "h", 1), (3001, "x y", "toolong", "h", 1)]
    docs = labelled(spark).unionAll(spark.createDataFrame(rows, BASIC))
    assert set(language.label_counts(docs)) == {*SAMPLES, "it"}
    found = {r.doc_id: r.lang for r in language.identify(language.document_evidence(docs), docs).collect()}
    assert all(found[2000 + i] == "it" for i in range(30))
    named = {r.doc_id: r.lang for r in language.identify(language.document_evidence(docs), docs, ("en", "fr")).collect()}
    assert set(named.values()) <= {"en", "fr", "und"}


def test_own_label_is_no_evidence(spark):
    docs = labelled(spark)
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "fr").otherwise(F.col("lang")))
    was, now = ({r.doc_id: r.lang for r in language.identify(language.document_evidence(d), docs).collect()} for d in (docs, wrong))
    assert was == now


def test_keep_identified(spark):
    docs = labelled(spark).unionAll(spark.createDataFrame([(600, "漢字仮名交じり文" * 9, "xx", "src0", 1), (601, None, "en", "src0", 1)], BASIC))
    kept = {r.doc_id for r in language.keep_identified(docs).collect()}
    assert kept == set(range(100))
    clash = documents(spark)
    wide = labelled(spark).join(clash.limit(0).drop("text", "lang", "source", "n_chars"), "doc_id", "left").select(*clash.columns)
    odd = [(None, None), (None, "the house and the garden with those"), (None, "the house and the garden with those"), (700, "!!!"), (700, "the garden and the house that were there"), (701, "")]
    docs = wide.unionAll(documents(spark, odd))
    out = language.keep_identified(docs)
    assert out.columns == docs.columns
    rest = sorted(((r.doc_id, r.text) for r in out.where("doc_id IS NULL OR doc_id >= 700").collect()), key=str)
    assert rest == sorted([odd[1], odd[2], odd[4]], key=str) and out.count() == 103
    assert language.keep_identified(nothing(spark)).collect() == []


def brute_pipeline(rows):
    """Ids that the filtering stages leave, from kept rows of known language."""
    from .test_dedup import LOWER, brute_components

    by_text = {}
    for i, t in rows:
        key = t.encode().translate(LOWER)
        by_text[key] = max(i, by_text.get(key, i))
    rest = [(i, t) for i, t in rows if by_text[t.encode().translate(LOWER)] == i]
    return {c for _, _, c in brute_components(rest)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    base = [" ".join(rng.choice(SAMPLES["en"].split()) + str(rng.randrange(10)) for _ in range(60)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:5])] + [(200 + i, t + " garden") for i, t in enumerate(base[5:9])]
    rows.append((300, "the house and jo@x.com with the garden"))
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows] + [(400, None, "en", "src0", 0), (401, "漢字仮名" * 20, "xx", "src0", 4)], BASIC).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == brute_pipeline(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "pii", "packing"]


def pipeline_rows():
    """Rows with null and repeated ids, and what the filtering stages leave of them."""
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(SAMPLES["en"].split()) + str(rng.randrange(10)) for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    rows = [
        (1, a), (None, a + " garden"), (None, b), (2, c), (2, c.upper()), (2, d), (2, d + " house"), (None, e), (None, e), (7, e + " there"),
        (3, None), (4, ""), (5, "!!! 12"), (6, "write to jo@x.com in the house and the garden"), (6, "the house and the garden with those that were there"),
    ]
    # The near copies keep the smallest id, null last; of d and its copy the smaller hash stays.
    left = [[(1, a)], [(None, b)], [(2, c), (2, c.upper())], [(2, d), (2, d + " house")], [(7, e + " there")], [rows[13]], [rows[14]]]
    return rows, left


@pytest.mark.parametrize("limit", [1000, 0])
def test_pipeline_stages_keep_rows_apart(spark, tmp_path, monkeypatch, limit):
    """Every stage on awkward rows with clashing columns, by row content."""
    import corpus_pipeline
    from foliospark.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rows, left = pipeline_rows()
    filler = [(1000 + i, " ".join(f"{w}{i}" for w in SAMPLES["en"].split() * 3)) for i in range(25)]
    docs = documents(spark, rows + filler)
    ws = common.Workspace(spark, "t")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns, name
        assert all(r.kept and r.spans == "x" and r.host == "h" and r.key == "k" for r in docs.collect()), name
        if name == "near_dedup":
            got = [(r.doc_id, r.text) for r in docs.where("doc_id IS NULL OR doc_id < 1000").collect()]
            assert len(got) == len(left) and all(sum(g in group for g in got) == 1 for group in left)
    texts = {r.text for r in docs.collect()}
    assert "write to <email> in the house and the garden" in texts and not any("jo@x.com" in t for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(packed) == len(left) + 25 and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_ids_and_places(spark, tmp_path):
    """Token ids of the redacted texts, by the tokenizers library, and gapless places."""
    import zlib

    import corpus_pipeline
    import numpy as np
    from tokenizers import Tokenizer

    from foliospark.llm.queries import BYTE_BPE

    library = Tokenizer.from_file(BYTE_BPE)
    rows = [(i, f"document {i} of the house and the garden number{i} with those{i * 7} that were there a{i}@x.org") for i in range(40)]
    documents(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t.replace(f"a{i}@x.org", "<email>"), add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in out) == want
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
