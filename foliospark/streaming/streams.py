"""The same detectors and counters on unbounded tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.detect import Detector, findings


def page_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Rows from the Parquet files at ``path``, a folder or one file, each file once.

    The path is given as a pattern that only it fits: a stream takes a single file by
    no other way."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pattern)


def stream_findings(pages: DataFrame, detectors: list[Detector]) -> DataFrame:
    """Stateless: the batch plan on a stream."""
    return findings(pages, detectors)


def unseen_pages(pages: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Pages whose content has not passed within the watermark."""
    return pages.withColumn("md5", F.md5("text")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["md5", "page"])


def monthly_counter(events: DataFrame, watermark: str = "31 days") -> DataFrame:
    """Events per account and month; late ones count until the watermark passes."""
    return events.withWatermark("ts", watermark).groupBy("account", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used"))


def windowed_counter(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "account").agg(F.count(F.lit(1)).alias("used")).select("w.start", "w.end", "account", "used")


def running_totals(events: DataFrame, *keys: str) -> DataFrame:
    """Totals since the stream began, by key; for the complete or update mode."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def recent_history(events: DataFrame, n: int = 100) -> DataFrame:
    """``account, seen, rank, ts, event_id``: the newest ``n`` events of each account, whatever
    their order of arrival, each time that the account has new ones; ``seen`` counts the
    account's events so far, and the rows with the largest ``seen`` are its history.

    The state is ``n`` times and ids an account and does not grow with the stream. For the
    update mode."""

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, stamps, ids = state.get if state.exists else (0, [], [])
        kept = list(zip(stamps, ids))
        for batch in batches:
            seen += len(batch)
            stamps = batch["ts"].astype("datetime64[us]").astype("int64")
            kept = sorted([*kept, *zip(stamps.tolist(), batch["event_id"].tolist())], reverse=True)[:n]
        state.update((seen, [s for s, _ in kept], [i for _, i in kept]))
        yield pd.DataFrame([(key[0], seen, r + 1, s, i) for r, (s, i) in enumerate(kept)], columns=["account", "seen", "rank", "micros", "event_id"])

    rows = events.select("account", "ts", "event_id").groupBy("account").applyInPandasWithState(
        newest, "account string, seen long, rank int, micros long, event_id long", "seen long, stamps array<long>, ids array<long>", "update", "NoTimeout",
    )
    return rows.select("account", "seen", "rank", F.timestamp_micros("micros").alias("ts"), "event_id")


def drain(stream: DataFrame, shared: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table below ``shared``; return it.

    Each micro-batch has a folder of its own that a repeated batch overwrites; in
    the complete mode the last batch is the table. Nothing passes through the driver."""
    spark, name = stream.sparkSession, f"drained_{uuid.uuid4().hex}"
    path, columns = f"{shared}/{name}/table", stream.columns
    empty = spark.createDataFrame([], stream.schema)
    empty.write.parquet(f"{path}/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{shared}/{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).select(*columns)
