"""Queries: batch bookkeeping and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..operators import operations as ops
from ..operators import terms as t
from ..sources import views as v
from ..streaming import streams
from .detection import email_sql
from .sql import DOCS, matches, n_digits, q

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


FILES = """SELECT concat('f', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.PDF' END) AS path,
    CASE o_orderkey % 11 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 600000000 ELSE CAST(o_totalprice AS BIGINT) + 100 END AS file_size,
    CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(o_custkey % 50 AS INT) + 1 END AS page_count,
    o_orderkey % 17 = 0 AS is_encrypted, o_orderkey % 3 <> 0 AS has_text, o_orderkey % 19 <> 0 AS file_exists FROM orders"""
ERROR = """CASE WHEN NOT file_exists THEN 'file not found' WHEN NOT ends_with(lower(path), '.pdf') THEN 'not a PDF file' WHEN file_size = 0 THEN 'file is empty'
    WHEN file_size < 100 THEN 'file is too small' WHEN file_size > 524288000 THEN 'file is too large' WHEN is_encrypted THEN 'file is encrypted'
    WHEN page_count IS NULL THEN 'file cannot be read' WHEN page_count = 0 THEN 'file has no pages' END"""
VALIDATED = f"SELECT path, {ERROR} IS NULL AS valid, {ERROR} AS error, {ERROR} IS NULL AND NOT has_text AS needs_ocr FROM ({FILES.replace('AS STRING', 'AS VARCHAR')})"


def files(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(FILES.replace("FROM orders", "FROM {orders}"), orders=v.table(spark, d, "orders"))


@query(VALIDATED)
def validation_chain(spark: SparkSession, d: str) -> DataFrame:
    return ops.validate(files(spark, d))


@query(f"SELECT coalesce(error, 'valid') AS outcome, count(*) AS files, count(*) FILTER (needs_ocr) AS needs_ocr FROM ({VALIDATED}) GROUP BY 1")
def validation_split(spark: SparkSession, d: str) -> DataFrame:
    return ops.validate(files(spark, d)).groupBy(F.coalesce("error", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("files"), F.count_if("needs_ocr").alias("needs_ocr"))


RUNS = "SELECT o_orderkey AS document, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN NULL ELSE 'failed' END AS conversion, CASE WHEN o_custkey % 9 = 0 THEN 'failed' WHEN o_custkey % 9 = 1 THEN NULL ELSE 'ok' END AS analysis, CASE WHEN o_orderkey % 50 = 0 THEN 'boom' END AS error FROM orders"


@query(f"SELECT count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed FROM (SELECT coalesce(conversion = 'ok', true) AND coalesce(analysis = 'ok', true) AND error IS NULL AS ok FROM ({RUNS}))")
def batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    return ops.outcome(spark.sql(RUNS.replace("FROM orders", "FROM {orders}"), orders=v.table(spark, d, "orders")))


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "events").select(F.concat(F.lit("acct"), (F.col("user_id") % 7).cast("string")).alias("account"), "ts", "event_id")


USAGE = "SELECT 'acct' || (user_id % 7) AS account, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY ALL"
ACCOUNTS = "SELECT 'acct' || k AS name, CASE WHEN k % 2 = 0 THEN NULL ELSE 1000 + k END AS monthly_limit FROM range(0, 9) t(k)"


@query(USAGE)
def monthly_usage(spark: SparkSession, d: str) -> DataFrame:
    return ops.monthly_usage(usage_events(spark, d))


@query(f"""WITH u AS ({USAGE}), a AS ({ACCOUNTS}), m AS (SELECT max(month) AS month FROM u),
    r AS (SELECT name, coalesce(used, 0) AS used, coalesce(monthly_limit, 500) AS monthly_limit FROM a LEFT JOIN (SELECT u.* FROM u JOIN m USING (month)) ON name = account),
    s AS (SELECT coalesce(name, '(all)') AS name, CAST(sum(used) AS BIGINT) AS used, CAST(sum(monthly_limit) AS BIGINT) AS monthly_limit FROM r GROUP BY ROLLUP (name))
    SELECT name, used, monthly_limit, greatest(0, monthly_limit - used) AS remaining, round(100.0 * used / monthly_limit, 4)::DOUBLE AS percentage FROM s""")
def monthly_usage_quota(spark: SparkSession, d: str) -> DataFrame:
    used = ops.monthly_usage(usage_events(spark, d))
    k = F.col("id")
    accounts = spark.range(9).select(F.concat(F.lit("acct"), k.cast("string")).alias("name"), F.when(k % 2 == 0, None).otherwise(1000 + k).alias("monthly_limit"))
    latest = used.agg(F.max("month")).first()[0] or ""
    return ops.quota(accounts, used, latest)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_history_topk(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent(v.table(spark, d, "events")).select("event_id", "ts")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events) WHERE rank <= 5")
def recent_history_per_user(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent_per(v.table(spark, d, "events"), "user_id", 5).select("user_id", "event_id", "rank")


@query("SELECT event_type AS operation, count(*) AS calls, CAST(sum(event_id % 4 + 1) AS BIGINT) AS attempts, count(*) FILTER (event_id % 9 <> 0) AS successes, count(*) FILTER (event_id % 4 > 0 AND event_id % 9 <> 0) AS recovered, max(event_id % 4 + 1) AS worst FROM events GROUP BY event_type")
def retry_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "events").select(F.col("event_type").alias("operation"), (F.col("event_id") % 4 + 1).alias("attempts"), (F.col("event_id") % 9 != 0).alias("ok"))
    return ops.retry_stats(rows)


@query("SELECT a AS attempt, least(30.0, 1.0 * pow(2.0, a - 1))::DOUBLE AS seconds FROM range(1, 11) t(a)")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 11).select(F.col("id").alias("attempt"), ops.backoff(F.col("id"), 1.0, 2.0, 30.0).alias("seconds"))


WANTED = "SELECT md5(text) AS doc_md5, CAST(doc_id % 5 AS INT) AS page, 300 AS dpi, lang FROM documents"


@query(f"SELECT doc_md5, page, dpi, lang FROM ({WANTED}) WHERE (doc_md5, page, lang) NOT IN (SELECT md5(text), CAST(doc_id % 5 AS INT), lang FROM documents WHERE lang = 'en')")
def cache_miss_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents")
    row = docs.select(F.md5("text").alias("doc_md5"), (F.col("doc_id") % 5).cast("int").alias("page"), F.lit(300).alias("dpi"), "lang", "doc_id")
    cache = row.where("lang = 'en'").select("doc_md5", "page", "dpi", "lang", F.lit("x").alias("payload")).dropDuplicates(["doc_md5", "page", "dpi", "lang"])
    return ops.cache_lookup(row.drop("doc_id"), cache)[1]


@query(f"SELECT doc_md5, page, payload FROM ({WANTED}) w JOIN (SELECT md5(text) AS m, CAST(doc_id % 5 AS INT) AS p, lang AS l, min(doc_id) AS payload FROM documents WHERE lang = 'en' GROUP BY ALL) c ON doc_md5 = m AND page = p AND lang = l")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = v.table(spark, d, "documents")
    row = docs.select(F.md5("text").alias("doc_md5"), (F.col("doc_id") % 5).cast("int").alias("page"), F.lit(300).alias("dpi"), "lang", "doc_id")
    cache = row.where("lang = 'en'").groupBy("doc_md5", "page", "dpi", "lang").agg(F.min("doc_id").alias("payload"))
    return ops.cache_lookup(row.drop("doc_id"), cache)[0].select("doc_md5", "page", "payload")


@query("SELECT coalesce(g.key, d.key) AS key, coalesce(g.value, d.value) AS value FROM (SELECT 'k' || n_nationkey AS key, n_name AS value FROM nation) d FULL JOIN (SELECT 'k' || (r_regionkey * 10) AS key, r_name AS value FROM region) g ON d.key = g.key")
def settings_defaults(spark: SparkSession, d: str) -> DataFrame:
    defaults = v.table(spark, d, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    given = v.table(spark, d, "region").select(F.concat(F.lit("k"), (F.col("r_regionkey") * 10).cast("string")).alias("key"), F.col("r_name").alias("value"))
    return ops.settings(defaults, given)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def settings_json_path(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT source AS file, count(*) AS lines, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source")
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.log_stats(v.table(spark, d, "documents").select(F.col("source").alias("file"), F.col("text").alias("value")))


@query("SELECT doc_id, CASE WHEN n >= 1048576 THEN round(n / 1048576, 1) || ' MB' WHEN n >= 1024 THEN round(n / 1024, 1) || ' KB' ELSE n || ' B' END AS size FROM (SELECT doc_id, n_chars * 7 AS n FROM documents)")
def human_file_size(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").select("doc_id", ops.file_size(F.col("n_chars") * 7).alias("size"))


@query(f"SELECT account, month, CAST(sum(used) AS BIGINT) AS used FROM (SELECT * FROM ({USAGE}) UNION ALL SELECT account, month, used FROM ({USAGE}) WHERE used > 10) GROUP BY ALL")
def counter_merge(spark: SparkSession, d: str) -> DataFrame:
    used = ops.monthly_usage(usage_events(spark, d))
    return ops.merge_counters(used, used.where("used > 10"))


@query("SELECT count(*) AS features, count(*) FILTER (c_acctbal > 0) AS available FROM customer")
def feature_availability(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("c_acctbal") > 0).alias("available"))


def _checkpoint(spark: SparkSession) -> str:
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    return tempfile.mkdtemp(prefix="foliospark-stream-")


@query(f"{email_sql(DOCS)} UNION ALL SELECT DISTINCT document, page, 'phone', value FROM {matches(DOCS, t.PHONE_US)} WHERE {n_digits('value')} = 10 AND NOT regexp_matches(value, {q(t.YEAR)})")
def stream_findings(spark: SparkSession, d: str) -> DataFrame:
    """The e-mail detector on a stream of document files; equals the batch findings."""
    docs = streams.page_stream(spark, f"{d}/documents.parquet", "doc_id long, text string, lang string, source string, n_chars long")
    pages = docs.select(F.col("source").alias("document"), (F.col("doc_id") + 1).cast("long").alias("page"), "text")
    return streams.drain(streams.stream_findings(pages, [detect.EMAIL, detect.PHONE_US]), _checkpoint(spark))


@query(USAGE)
def stream_monthly_counter(spark: SparkSession, d: str) -> DataFrame:
    events = streams.page_stream(spark, f"{d}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    named = events.select(F.concat(F.lit("acct"), (F.col("user_id") % 7).cast("string")).alias("account"), "ts")
    return streams.drain(streams.monthly_counter(named), _checkpoint(spark), "complete")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_running_totals(spark: SparkSession, d: str) -> DataFrame:
    events = streams.page_stream(spark, f"{d}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    totals = streams.drain(streams.running_totals(events, "event_type"), _checkpoint(spark), "complete")
    return totals.withColumn("total", F.round("total", 4))


@query("SELECT DISTINCT md5(text) AS md5, CAST(1 AS INT) AS page FROM documents WHERE text IS NOT NULL")
def stream_unseen_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each content once, as the page cache would meet it."""
    docs = streams.page_stream(spark, f"{d}/documents.parquet", "doc_id long, text string, lang string, source string, n_chars long")
    pages = docs.where("text IS NOT NULL").select("text", F.lit(1).alias("page"), F.timestamp_seconds(F.lit(10**9)).alias("ts"))
    return streams.drain(streams.unseen_pages(pages).select("md5", "page"), _checkpoint(spark))


_HISTORY = "SELECT 'acct' || (user_id % 7) AS account, ts, event_id FROM events"


@query(f"SELECT account, CAST(r AS INT) AS rank, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, event_id DESC) AS r FROM ({_HISTORY})) WHERE r <= 100")
def stream_recent_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred events of each account after all files have come."""
    from pyspark.sql import Window

    events = streams.page_stream(spark, f"{d}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    named = events.select(F.concat(F.lit("acct"), (F.col("user_id") % 7).cast("string")).alias("account"), "ts", "event_id")
    rows = streams.drain(streams.recent_history(named), _checkpoint(spark), "update")
    latest = rows.withColumn("last", F.max("seen").over(Window.partitionBy("account")))
    return latest.where("seen = last").select("account", "rank", "ts", "event_id")


_TOTALS = "SELECT event_type, count(*) AS n FROM events {} GROUP BY event_type"


@query(_TOTALS.format(""))
def totals_merge(spark: SparkSession, d: str) -> DataFrame:
    """Totals up to an hour of the day, and those of the rest merged into them."""
    events = v.table(spark, d, "events")
    count = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return ops.merge_totals(count(events.where(F.hour("ts") < 12)), count(events.where(F.hour("ts") >= 12)), "event_type")
