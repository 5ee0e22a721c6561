"""Helpers shared by the training-data operators: shared folder, written tables, chunking."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
#: Words of the contracts: runs of bytes that are neither space nor TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside the operators; it sorts before every other id.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share, deleted when the driver ends.

    That is ``spark.checkpoint.dir``, or else a checkpoint folder that was set by hand, or else the warehouse: never a
    machine's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else spark.conf.get("spark.sql.warehouse.dir")
    made = f"{base.rstrip('/')}/quillmask-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def written(df: DataFrame, base: str, name: str, **options: str) -> DataFrame:
    """Write ``df`` below ``base`` and read it back: lineage is cut, lost executors cost nothing."""
    path = f"{base}/{name}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def byte_size(spark: SparkSession, path: str) -> int:
    """Bytes of a written table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def trimmed_memory() -> None:
    """Give memory that a Python worker no longer uses back to the system: idle workers of one step live on beside the next one's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list[list], list[bytes]]]:
    """(rows of the other columns, UTF-8 texts) in groups of about ``limit`` bytes. ``text`` is the last column; null is empty."""
    rows: list[list] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        col = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        others = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for i, text in enumerate(col):
            value = text.as_py() or b""
            if texts and size + len(value) > limit:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append([c[i] for c in others])
            texts.append(value)
            size += len(value)
    if texts:
        yield rows, texts
    trimmed_memory()


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (null as NULL_ID) and the columns asked for, text last."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), *[docs[c] for c in more], docs["text"].alias("text"))


def tagged(docs: DataFrame) -> DataFrame:
    """doc, tag (a hash of the text), text: doc and tag together name a row, and rows that share both are alike."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(docs["text"]).alias("tag"), docs["text"].alias("text"))


def real_id(col: str = "doc"):
    return F.when(F.col(col) != NULL_ID, F.col(col))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all of its input."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
