"""Raw pages by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Wanted (address, version) keys that are broadcast, at most; a key is one short row.
MAX_BROADCAST_KEYS = 200_000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as stored; the session's file settings decide how they are split."""
    return spark.read.parquet(path)


def join_pages(
    refs: DataFrame,
    pages: DataFrame,
    version: str = "page_id",
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
) -> DataFrame:
    """References with the page of their address; the lowest ``version`` of a page counts.

    The version is picked on narrow columns of wanted addresses only. The wanted keys are
    counted: few are broadcast, so that page texts are read where they lie and no unwanted one
    is moved. Many meet the texts on address and version, which spreads copies of one address.
    """
    wanted = refs.select("url").distinct()
    few = wanted.limit(max_broadcast_keys + 1).count() <= max_broadcast_keys
    narrow = pages.select("url", version).join(F.broadcast(wanted) if few else wanted, "url", "left_semi")
    chosen = narrow.groupBy("url").agg(F.min(version).alias(version))
    texts = pages.join(F.broadcast(chosen) if few else chosen, ["url", version])
    return refs.join(texts, "url")


def lay_out_pages(pages: DataFrame, table: str, n_buckets: int, path: str | None = None) -> None:
    """Store pages as a table bucketed by address, for runs that want more than can be broadcast.

    Written once after pages have landed; every later join by address leaves the texts where they lie.
    """
    # One task writes a bucket, so that a bucket is one file.
    writer = pages.repartition(n_buckets, "url").write.bucketBy(n_buckets, "url").mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def join_laid_out(refs: DataFrame, table: str, version: str = "page_id") -> DataFrame:
    """``join_pages`` on a table of ``lay_out_pages``: references move to the pages, however many.

    References are shuffled to the buckets and hashed there; pages are neither shuffled nor sorted.
    The lowest version of each address is found inside its bucket, on narrow columns.
    """
    pages = refs.sparkSession.table(table)
    lowest = pages.groupBy("url").agg(F.min(version).alias("_version"))
    wanted = refs.join(lowest.hint("shuffle_hash"), "url")
    # As a range: an equality would become a key of the join, by which pages aren't bucketed.
    chosen = (F.col(version) >= F.col("_version")) & (F.col(version) <= F.col("_version"))
    renamed = wanted.withColumnRenamed("url", "_url").hint("shuffle_hash")
    return pages.join(renamed, (F.col("url") == F.col("_url")) & chosen).drop("_url", "_version")
