"""Cached pages and assets as tables, and what became of fetches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.functions.urls import article_slug
from broadsheet.session import materialize

#: Keys that are broadcast, at most; a key is one short value.
MAX_BROADCAST_KEYS = 200_000
#: Folders of a table that is updated in place.
N_BUCKETS = 256


def cache_status(df: DataFrame, cache: DataFrame, key: str, enabled: bool = True) -> DataFrame:
    """Add ``cached``: whether ``key`` is in the cache (one join for hits and misses)."""
    if not enabled:
        return df.withColumn("cached", F.lit(False))
    known = cache.select(key).distinct().withColumn("_known", F.lit(True))
    marked = df.join(known, key, "left")
    return marked.withColumn("cached", F.col("_known").isNotNull()).drop("_known")


def fetch_plan(
    refs: DataFrame, cache: DataFrame, enabled: bool = True
) -> tuple[DataFrame, DataFrame]:
    """References whose page is cached under their slug, and those to fetch."""
    keyed = refs.withColumn("slug", article_slug(F.col("url")))
    if not enabled:
        return keyed.filter(F.lit(False)), keyed
    slugs = cache.select("slug")
    return keyed.join(slugs, "slug", "left_semi"), keyed.join(slugs, "slug", "left_anti")


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key; equal times are settled by the row's other values.

    Rows are written once with a number. The winner is found on narrow columns, time, digest and
    number, which combine before the shuffle; its row is taken by number, so texts are in no sort
    and no aggregate.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in (key, order)))), 256)
    rows = materialize(df.withColumn("_digest", digest).withColumn("_no", F.monotonically_increasing_id()))
    last = rows.groupBy(key).agg(F.max(F.struct(order, "_digest", "_no")).alias("_last"))
    chosen = last.select(F.col("_last._no").alias("_no"))
    return _narrow_join(rows, chosen, "_no", "left_semi").drop("_digest", "_no")


def _narrow_join(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with one narrow column of keys: broadcast while counted to be few, else hashed.

    Either way ``rows`` are not sorted, and while the keys are few not shuffled.
    """
    keys = materialize(keys)
    few = keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), key, how)


def cache_upsert(
    cache: DataFrame, new: DataFrame, key: str = "slug", order: str = "fetched_at"
) -> DataFrame:
    """The cache after writing ``new``: the last write of a key wins.

    Only the new rows are aggregated; cached rows pass an anti join, which needs no
    shuffle of them while the new keys are few. Write the result to a new path.
    """
    latest = latest_per_key(new, key, order)
    return _narrow_join(cache, latest.select(key), key, "left_anti").unionByName(latest)


def bucketed(df: DataFrame, key: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``df`` with the folder of its key; null keys share the first one."""
    return df.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64(key), F.lit(n_buckets)), F.lit(0)).cast("int"))


def merge_buckets(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    key: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """Merge ``new`` into a table laid out in folders by a hash of ``key``; rewrite touched folders only.

    ``merge`` gets the rows of the touched folders and the new ones and gives what is to be kept of
    both. Its result is written to a work table first, so that no folder is read while it is
    replaced; files of other folders stay as they are. The driver gets the numbers of the touched
    folders, at most ``n_buckets``. Returns the rows of the touched folders after the merge.
    """
    new = materialize(bucketed(new, key, n_buckets))
    touched = sorted(row["bucket"] for row in new.select("bucket").distinct().collect())
    old = new.limit(0)
    if _exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
    merged = materialize(merge(old, new).select(new.columns))
    writer = merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
    if touched:
        with _open_files(spark, n_buckets):
            writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return merged


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


@contextmanager
def _open_files(spark: SparkSession, n: int) -> Iterator[None]:
    """Let a task keep the files of so many folders open instead of sorting its rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def upsert_buckets(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    key: str = "slug",
    order: str = "fetched_at",
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """``cache_upsert`` on a table of ``merge_buckets``; returns the touched folders' rows."""
    return merge_buckets(spark, path, new, key, lambda old, rows: cache_upsert(old, rows, key, order), n_buckets)


def route_fetches(fetches: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``outcome`` (ok, skipped, fatal) and ``reason`` of landed fetches.

    Network failures and missing pages are skipped; any other bad status is fatal and,
    with ``strict``, fails the job.
    """
    status, error = F.col("status"), F.col("error")
    outcome = (
        F.when(error.isNotNull(), "skipped")
        .when(status == 404, "skipped")
        .when(status.between(200, 299), "ok")
        .otherwise("fatal")
    )
    reason = F.when(error.isNotNull(), "network").when(
        ~F.coalesce(status.between(200, 299), F.lit(False)),
        F.concat(F.lit("http_"), F.coalesce(status.cast("string"), F.lit("none"))),
    )
    if strict:
        fault = F.raise_error(F.concat_ws(" ", F.lit("fetch failed:"), reason, F.col("url")))
        outcome = F.when(outcome == "fatal", fault.cast("string")).otherwise(outcome)
    return fetches.withColumn("outcome", outcome).withColumn("reason", reason)
