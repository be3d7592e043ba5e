"""Arrow helpers the text operators share.

Texts travel as UTF-8 bytes: ``bytes.split()`` cuts at exactly the ASCII blanks 0x20 and
0x09-0x0D, and ``bytes.lower()`` touches A-Z alone.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.session import work_path

#: Text handled at a time; bounds the arrays a task holds, a longer text goes alone.
BLOCK_BYTES = 2_000_000
#: Rows and bytes of a batch that Spark hands to a Python worker, so that long texts don't pile up.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
#: Shuffle files go when their job ends, instead of when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the C library can return free memory.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` as bytes; other columns, whatever their names, stay behind."""
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
    )


def blocks(batch: pa.RecordBatch, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut where its texts reach ``limit`` bytes."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield batch.slice(start, end - start)
    release()


def release() -> None:
    """Give memory that is free in this worker back to the machine: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def texts(batch: pa.RecordBatch) -> list[bytes]:
    """Texts of a batch; null is the empty text."""
    return [value or b"" for value in batch.column("text").to_pylist()]


def importable(spark: SparkSession) -> SparkSession:
    """Bound the batches of Python workers, and let those on this machine import the package.

    They import it from where the driver did. On a cluster the package is installed on the executors or passed with ``--py-files``.
    """
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)
    return spark


def written(df: DataFrame, **options: object) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    ``options`` go to the writer. Cuts the lineage, survives lost executors, and later steps read the columns they need.
    Inside ``work_tables`` it goes with the others. The job's shuffle files are removed with its end: nothing else reads them.
    """
    spark = df.sparkSession
    path, before = work_path(spark, "written"), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
