"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only, so that they can be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Only for sessions built here: no Python call sites in column expressions, which makes
# deep ones several times faster to build.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on; sizes are left to the cluster."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "broadsheet", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, one machine) a temporary one is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        current = jsc.getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="broadsheet-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Paths of work tables made inside each open ``work_tables``, the innermost last.
_MADE: list[set[str]] = []


def work_path(spark: SparkSession, prefix: str = "table") -> str:
    """A new path for a work table in the shared folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid4().hex}"
    if _MADE:
        _MADE[-1].add(path)
    return path


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the work tables that are made inside, once their readers are done.

    Gives a function that keeps what a table reads: ``with work_tables(spark) as keep: out =
    keep(materialize(...))``. What is kept belongs to the enclosing ``work_tables``, if there is one.
    Anything else made inside must not be read later.
    """
    made: set[str] = set()
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(path for path in made if any(path.rpartition("/")[2] in file for file in files))
        return df

    _MADE.append(made)
    try:
        yield keep
    finally:
        _MADE.pop()
        if _MADE:
            _MADE[-1].update(kept)
        for path in sorted(made - kept):
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage and survives lost executors; later steps read only their columns.
    """
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
