"""Shared plumbing: written intermediate tables, Arrow batches, shared files.

Lineage is cut by writing Parquet tables below the folder that the session
names in ``spark.checkpoint.dir``; every executor can read that folder, so a
lost executor costs a task retry and never a lost intermediate result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes per Arrow batch sent to Python, where the session names no bound of its own.
#: A batch holds whole texts: it ends with the text that reaches the bound.
ARROW_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Only a local-mode session that names none
    (a test) gets a temporary folder; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            root = held
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            root = tempfile.mkdtemp(prefix="foliospark-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    return root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + root.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


class Workspace:
    """A fresh folder below the shared root for one query's intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append((spark, self.uri))

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def stage(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as a Parquet table and return a reader of that table."""
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a staged table that nothing will read again."""
        _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _cleanup() -> None:
    for spark, uri in _made:
        try:
            _delete(spark, uri)
        except Exception:  # the session may have ended already
            return


_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Bound the bytes in an Arrow batch and give the executors this package.

    The bound is the same for all operators, so a result that is read late runs under
    the bound it was planned with; what the session sets itself stays as it is."""
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="foliospark-src-")) / "foliospark_src.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((top / "foliospark").rglob("*.py")):
                z.write(f, f.relative_to(top))
        spark.sparkContext.addPyFile(str(archive))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Key rows up to this many are broadcast (a few longs each), else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of strings, uncompressed, up to which rows with strings are broadcast.
BROADCAST_BYTES = 8 << 20


def bounded(keys: DataFrame, *strings: str) -> DataFrame:
    """``keys``, a written table of numbers and of the columns ``strings``, marked for
    broadcast if a count of rows and bytes shows that it is small, else for a join by
    shuffle. (Spark's own threshold sees compressed bytes.)"""
    size = reduce(lambda a, c: a + F.coalesce(F.octet_length(c), F.lit(0)), strings, F.lit(0))
    rows, held = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(keys) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else keys.hint("merge")


def hash_share(rows: DataFrame, wanted: int, *columns: str) -> DataFrame:
    """About ``wanted`` of the rows, all if there are fewer, chosen by a hash of the columns."""
    count = rows.count()
    if count <= wanted:
        return rows
    span = 1 << 31
    return rows.where(F.pmod(F.xxhash64(*columns), F.lit(span)) < int(span * wanted / count))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would fold all of Unicode)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for executors that read or write own-format files."""
    return pafs.FileSystem.from_uri(uri)


def utf8_views(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def flatten(chunks: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(chunks) if chunks else np.zeros(0, dtype)
