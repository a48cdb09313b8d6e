"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Vocabulary files are named by path and never copied here.
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), MULTI_RANKS)


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    ws = common.Workspace(spark, "warc")
    return read_archives(write_archives(_table(spark, sf_dir, "pages"), ws)).drop("target_uri")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


#: The rules that the url query judges by: (host, path prefix, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(_table(spark, sf_dir, "pages"), rules)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import read_shards, write_shards

    ws = common.Workspace(spark, "shards")
    return read_shards(write_shards(_table(spark, sf_dir, "documents"), ws, BYTE_BPE))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import document_evidence, identify, page_evidence

    docs = _table(spark, sf_dir, "documents")
    evidence = document_evidence(docs).unionByName(page_evidence(_table(spark, sf_dir, "pages")))
    return identify(evidence, docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_byte_bpe, op2_ogg_media, op3_warc, op4_jaccard_join, op5_url_rules, op6_best_fit_packing, op7_exact_dedup, op8_token_shards, op9_pii, op10_language_id)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": """
            WITH p AS (
                SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                       sha256(coalesce(html, '')) AS payload_digest
                FROM pages),
            f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
            SELECT p.page_id, payload_bytes, p.payload_digest,
                   CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
            FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
        """,
        "op5_url_rules": """
            WITH r(host, path, rule, verdict) AS (VALUES
                ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'),
                ('net', '/de/', 'net/de/', 'block'), ('example.net', '/de/8', 'example.net/de/8', 'block'),
                ('org', '/es/', 'org/es/', 'block')),
            p AS (
                SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                FROM pages),
            q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM p),
            u AS (
                SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
                FROM q)
            SELECT page_id, u.host, u.path,
                   (max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule))).rule AS rule,
                   coalesce((max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule))).verdict, 'allow') AS verdict
            FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
            GROUP BY page_id, u.host, u.path
        """,
        "op7_exact_dedup": """
            WITH d AS (
                SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
                FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)
        """,
    }
