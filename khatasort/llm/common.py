"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Words are runs of anything but ASCII white space (space, tab, newline, VT, FF, CR); bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark so that any store works."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch at most, as a batch is held on both sides of the pipe; its bytes are bounded by Spark's own setting.
BATCH_ROWS = 1000

_marked: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Make the session ready: executors have the package, Arrow batches are bounded (a setting of the session), and checkpoint() has a folder.

    The folder is the cluster's ``spark.checkpoint.dir``.  Where that is unset, a local master gets a temporary folder of its own, and any
    other master is an error, as no folder of one machine would be seen by all.  What this application puts there goes when its JVM ends.
    """
    sc = ship(spark).sparkContext
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "khatasort-checkpoints"))
    folder = sc._jsc.sc().getCheckpointDir().get()
    if folder not in _marked:
        _marked.add(folder)
        file_system(spark, folder)[0].deleteOnExit(sc._jvm.org.apache.hadoop.fs.Path(folder))
    return spark


def file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and its path."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def pinned(df: DataFrame) -> DataFrame:
    """The frame, computed once and written to the shared checkpoint folder, so a lost executor costs nothing."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id: int | None, n: int) -> int:
    """The same fold in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def blobs(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, nulls as b''."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def digest_of(text: Column) -> Column:
    """SHA-256 of a text, null as the empty text: a key of rows whose id is null or repeated."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def clipped(number: float, low: float, high: float) -> float:
    return max(low, min(high, number))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n_folds: int, held_fold: int, most: int) -> list[tuple[bytes, int, int]]:
    """At most ``most`` labelled texts outside the held-out fold, as (text, label, order), in a fixed order.

    The sample is the documented bound for fitting a classifier: the labelled ids with the smallest md5 of the id are
    taken, which is a deterministic uniform draw.  ``labels`` may repeat a doc_id; the largest label counts, and of
    different texts with one doc_id the smallest.  Rows with null label or id are no examples.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(fold(F.col("doc_id"), n_folds) != held_fold)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(most)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
        .collect()
    )
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [(r.text.encode(), int(r.y), i) for i, r in enumerate(rows)]


def logistic(x, y, rounds: int = 60, ridge: float = 1e-3):
    """Newton's method for a small ridge logistic regression; the last weight is the intercept."""
    import numpy as np

    x = np.column_stack([np.asarray(x, dtype=float), np.ones(len(y))])
    y = np.asarray(y, dtype=float)
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge * max(1, len(y)))
    pull[-1] = 1e-6 * max(1, len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - pull * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
