"""Language identification by Bayesian fusion of evidence (operator 10).

Four kinds of evidence on a text are multiplied: the likelihood of the text
under byte-trigram models, the declared markup language, the address suffix and
the host. Declarations count as much as they have proved reliable: a table of
declared against textual language is estimated from the whole corpus. The labels
that train the text models are not evidence: a document's own label never decides on
it, and declarations are those of pages alone. Suffix and host give a prior smoothed
along global -> suffix -> host, from counts that one grouped aggregation each
collects over all rows; a row's own text is left out of its host's counts.

The languages are those that the labels of the whole corpus name often enough, or
those that the caller names. Of classes that are equally probable the first by name
is taken, ``und`` last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: What ``train`` models unless told otherwise.
LANGUAGES = ("de", "en", "es", "fr")
CLASSES = (*LANGUAGES, UNKNOWN)
#: A label makes a class if at least so many rows carry it.
LEAST_LABELLED = 20

#: Hash buckets of the trigram models, and the pseudo-count of each.
BUCKETS, PSEUDO = 1 << 16, 0.05
#: Training reads about this many labelled rows of each language, whole texts, drawn by
#: a hash of their id. Their trigrams are counted where they lie; what reaches the
#: driver is one count a bucket and language.
TRAINING_ROWS = 1_000
#: Overlapping trigrams see every byte three times; their sum is divided by this.
OVERLAP = 3.0
#: Prior weight of the class that models no language (every trigram equally likely).
UNKNOWN_PRIOR = 1e-3
#: Pseudo-rows that a level of the host hierarchy takes from the level above.
STRENGTH = 10.0
#: A row is kept if its best class is a language and at least this probable.
MIN_POSTERIOR = 0.5

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
# Digits and ASCII punctuation say nothing about language; they count as blanks.
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(data: bytes) -> np.ndarray:
    """Bucket of each byte trigram of `` text ``, runs of blanks taken as one."""
    x = _LOWER[np.frombuffer(b" " + data + b" ", np.uint8)]
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return h >> np.uint32(16)


def model_of(counts: np.ndarray) -> np.ndarray:
    """Log probabilities, one row a bucket and one column a class, the unknown one last,
    from trigram counts of the languages (bucket by language)."""
    counts = np.concatenate((counts + PSEUDO, np.ones((BUCKETS, 1))), axis=1)
    model = np.log(counts / counts.sum(axis=0))
    model[:, counts.sum(axis=0) < PSEUDO * BUCKETS + 1] = -100.0  # a class without training text never wins
    return model.astype(np.float32)


def train(rows: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """The model of (text, language) pairs."""
    counts = np.zeros((BUCKETS, len(languages)))
    for text, lang in rows:
        if lang in languages:
            counts[:, languages.index(lang)] += np.bincount(trigrams((text or "").encode()), minlength=BUCKETS)
    return model_of(counts)


def primary(tag: Column) -> Column:
    """The primary part of a language tag, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]+)", 1))


def label_counts(labelled: DataFrame, lang_col: str = "lang") -> dict[str, int]:
    """Rows by label, over all rows: labels of two or three letters that at least
    ``LEAST_LABELLED`` rows carry (so at most some 18,000, whatever the corpus)."""
    tag = primary(F.col(lang_col))
    found = labelled.select(tag.alias("lang")).where(F.col("lang").rlike("^[a-z]{2,3}$") & (F.col("lang") != UNKNOWN)).groupBy("lang").count().where(F.col("count") >= LEAST_LABELLED)
    return {r["lang"]: r["count"] for r in found.collect()}


def trained(labelled: DataFrame, counts: dict[str, int], languages: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """The model of a drawn share of each language's rows.

    Tasks count trigrams, sums are aggregated per (language, bucket), and each language
    comes to the driver as one packed row of ``BUCKETS`` counts."""
    span = 1 << 31
    share = {lang: min(1.0, TRAINING_ROWS / max(1, counts.get(lang, 0))) for lang in languages}
    if not languages:
        return model_of(np.zeros((BUCKETS, 0)))
    tag = primary(F.col(lang_col))
    limit = reduce(lambda c, lang: c.when(tag == lang, int(span * share[lang])), languages, F.when(F.lit(False), 0)).otherwise(0)
    drawn = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(span)) < limit).select(tag.alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, np.ndarray] = {}
            for lang, data in zip(batch[0].to_pylist(), common.utf8_views(batch[1])):
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(trigrams(data), minlength=BUCKETS)
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    def pack(table: pa.Table) -> pa.Table:
        n = np.zeros(BUCKETS, np.int64)
        n[table["bucket"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"lang": table["lang"][:1], "packed": pa.array([n.tobytes()], pa.binary())})

    sums = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = {r["lang"]: r["packed"] for r in sums.groupBy("lang").applyInArrow(pack, "lang string, packed binary").collect()}
    empty = np.zeros(BUCKETS, np.int64)
    return model_of(np.stack([np.frombuffer(packed[lang], np.int64) if lang in packed else empty for lang in languages], axis=1).astype(float))


def scores(evidence: DataFrame, model: np.ndarray) -> DataFrame:
    """Adds ``lp`` (log likelihood per class) and ``best`` (index of the likeliest
    class, null without a trigram) in place of ``text``."""
    held = evidence.sparkSession.sparkContext.broadcast(model)  # BUCKETS x classes, not growing with the rows
    names = [c for c in evidence.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            lp, best = [], []
            for data in common.utf8_views(batch.column("text")):
                at = trigrams(data)
                total = table[at].sum(axis=0, dtype=np.float64) / OVERLAP
                lp.append(total.round(6).tolist())
                best.append(int(total.argmax()) if data.strip() and (at != _BLANK).any() else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lp, pa.list_(pa.float64())), pa.array(best, pa.int32())], names=[*names, "lp", "best"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in evidence.schema.fields if f.name != "text")
    return evidence.mapInArrow(run, f"{fields}, lp array<double>, best int")


_BLANK = np.uint32(((32 << 16 | 32 << 8 | 32) * 0x9E3779B1 & 0xFFFFFFFF) >> 16)


def _counts(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    """``n``: per class, of which there are ``k``, the rows whose text says so."""
    return scored.groupBy(*keys).agg(F.array(*(F.count_if(F.col("best") == i) for i in range(k))).alias("n"))


def _smooth(own: Column, above: Column) -> Column:
    """Counts ``own`` with ``STRENGTH`` pseudo-rows dealt as ``above``."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda n, p: (n + STRENGTH * p) / (total + STRENGTH))


def fuse(scored: DataFrame, workspace: common.Workspace, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """``scored`` must be a written table: it is read for each aggregation."""
    k = len(classes)
    row = _counts(scored, k).first()
    base = [1.0 + n for n in (row["n"] if row else [0] * k)]
    base[-1] = UNKNOWN_PRIOR * (sum(base[:-1]) or 1.0)
    overall = [b / sum(base) for b in base]
    # Declared language against textual language, of rows that declare one: at most
    # (classes + 1) rows.
    told = {r["declared"]: r["n"] for r in _counts(scored.where("declared <> 'none'"), k, "declared").collect()}
    seen = [sum(n[i] for n in told.values()) for i in range(k)]
    values = sorted(told, key=str)
    declared_lp = {v: [float(np.log((told[v][i] + 1.0) / (seen[i] + len(values)))) for i in range(k)] for v in values}
    declared_lp = {v: lp[:-1] + [float(np.log(1 / max(1, len(values))))] for v, lp in declared_lp.items()}

    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    suffixes = _counts(scored, k, "suffix").select("suffix", _smooth(F.col("n"), array(overall)).alias("suffix_prior"))
    hosts = _counts(scored, k, "suffix", "host").select("suffix", "host", F.col("n").alias("host_n"))
    hosts = workspace.stage(hosts.join(suffixes, "suffix"), "hosts")
    # One row a host on the one side: a hot host's rows can be split on the other.
    rows = scored.join(hosts, ["suffix", "host"], "left")
    others = F.transform("host_n", lambda n, i: (n - F.when(F.col("best") == i, 1).otherwise(0)).cast("double"))
    prior = _smooth(others, F.col("suffix_prior"))
    told_lp = reduce(lambda c, v: c.when(F.col("declared") == v, array(declared_lp[v])), values, F.when(F.lit(False), array([0.0] * k))).otherwise(array([0.0] * k))
    logs = F.zip_with(F.zip_with(F.col("lp"), told_lp, lambda a, b: a + b), prior, lambda a, p: a + F.log(p))
    rows = rows.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    weights = F.transform("logs", lambda x: F.exp(x - F.col("top")))
    where = F.array_position("logs", F.col("top")).cast("int")
    posterior = F.round(1 / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), 6)
    lang = F.when(F.col("best").isNull(), F.lit(UNKNOWN)).otherwise(F.element_at(F.array(*map(F.lit, classes)), where))
    rows = rows.withColumn("lang", lang).withColumn("posterior", posterior)
    return rows.withColumn("kept", (F.col("lang") != UNKNOWN) & (F.col("posterior") >= MIN_POSTERIOR)).drop("lp", "best", "host_n", "suffix_prior", "logs", "top")


def document_evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """Documents: the source is the host; they declare nothing (their language column is
    the label that trains). ``extra`` columns are carried along."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("tag"), F.lit("").alias("suffix"), F.coalesce(F.col(source_col), F.lit("")).alias("host"), *extra,
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages: declaration from the html element, host and suffix from the address."""
    from .url_rules import host_and_path

    html = F.coalesce("html", F.lit(""))
    host = host_and_path(F.col("url"))[0]
    shown = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[A-Za-z0-9#]+;", " ")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), shown.alias("text"),
        F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1).alias("tag"),
        F.regexp_extract(host, r"([^.:]*)(?::[0-9]*)?$", 1).alias("suffix"), host.alias("host"),
    )


def identify(evidence: DataFrame, labelled: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Per row of ``evidence``: ``doc_id, page_id, declared, suffix, host, lang, posterior,
    kept``.

    ``labelled`` (doc_id, text, lang) trains the text models on a bounded sample;
    ``languages`` names the classes, by default the labels that stand often enough.
    A declared tag is one of the languages, ``other`` or ``none``. A text without a
    letter is ``und`` and not kept; a null text is empty, a null host is a value of its
    own, a null tag declares nothing. Null and repeated ids are judged row by row.
    Without a language every text is ``und``; an empty table gives an empty result.
    """
    spark = evidence.sparkSession
    common.prepare(spark)
    ws = common.Workspace(spark, "language")
    counts = label_counts(labelled)
    names = tuple(sorted(counts if languages is None else languages))
    model = trained(labelled, counts, names)
    tag = primary(F.col("tag"))
    told = F.when(tag == "", "none").when(tag.isin(*names), tag).otherwise("other") if names else F.when(tag == "", "none").otherwise("other")
    evidence = evidence.select("doc_id", "page_id", "text", told.alias("declared"), *(c for c in evidence.columns if c not in ("doc_id", "page_id", "text", "tag")))
    return fuse(ws.stage(scores(evidence, model), "scores"), ws, (*names, UNKNOWN))


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, ...) whose language is identified.

    Decisions are joined back by a hash of these four columns, so equal rows fare
    alike, repeated and null ids are told apart by their texts, and null texts (which
    have no language) go; only the rejected rows' hashes are joined. Other columns are
    carried along whatever their names (but for ``__key``, the operator's own); an
    empty table stays empty.
    """
    key = F.xxhash64(*(F.col(c) for c in ("doc_id", "text", "lang", "source")))
    keyed = docs.withColumn("__key", key)
    evidence = document_evidence(keyed, extra=("__key",))
    ws = common.Workspace(docs.sparkSession, "rejected")
    rejected = ws.stage(identify(evidence, docs, languages).where(~F.col("kept")).select("__key").distinct(), "keys")
    return keyed.join(common.bounded(rejected), "__key", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
