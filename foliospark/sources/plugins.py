"""Places for decoders and recognisers that need packages from outside.

A plug-in is a factory: it is called once per task, so that a model is loaded once
and not per row, and what it returns is called per file or text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decoder = Callable[[bytes], Iterable[tuple]]
Recogniser = Callable[[str], Iterable[tuple[int, int, str]]]

PAGES = "page int, text string"
WORDS = "page int, word_id int, text string, x0 int, x1 int, top int, bottom int, size int, conf int"
CELLS = "page int, table_id int, row int, cells array<string>"


def decode(files: DataFrame, factory: Callable[[], Decoder], schema: str) -> DataFrame:
    """Rows of ``schema`` (pages, words or cells) that the decoder finds in each file
    ``(path, content)``, with the path. A file that cannot be decoded gives one row of
    nulls and its ``error``, and does not end the job."""
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = factory()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(path, *row, None) for row in decoder(bytes(content))]
                except Exception as e:  # the plug-in's own failure, reported as data
                    rows = [(path, *[None] * len(names), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def entities(pages: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """``pages`` with ``entities``: start, end and label of each name a recogniser finds.
    A null text has none."""

    @F.pandas_udf("array<struct<start:int,end:int,label:string>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        recogniser = factory()
        for batch in texts:
            yield batch.map(lambda t: [{"start": s, "end": e, "label": k} for s, e, k in recogniser(t)] if t is not None else [])

    return pages.withColumn("entities", found(F.col("text")))


def entity_names(pages: DataFrame, label: str, least: int = 3, most: int = 80) -> DataFrame:
    """``document, page, value``: distinct entities of a label, by length."""
    rows = pages.select("document", "page", "text", F.explode("entities").alias("e")).where(F.col("e.label") == label)
    value = F.trim(F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")))
    return rows.select("document", "page", value.alias("value")).where(F.length("value").between(least, most)).distinct()
