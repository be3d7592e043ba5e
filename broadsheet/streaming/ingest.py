"""Incremental feed ingest with Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.operators.feed import cutoff, first_wins, instant, last_n_days
from broadsheet.schemas import FEED_PAGE
from broadsheet.session import materialize, work_tables
from broadsheet.site import Site
from broadsheet.sources.cache import N_BUCKETS, merge_buckets
from broadsheet.sources.feed import FEED_ORDER, feed_lines, feed_members, numbered, parse_pages, valid_refs


def read_feed_stream(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """New feed pages as they land."""
    reader = spark.readStream.schema(FEED_PAGE).option("maxFilesPerTrigger", files_per_batch)
    return numbered(reader.json(landing))


def new_refs(
    pages: DataFrame, days: int, now: datetime | None = None, site: Site = Site()
) -> DataFrame:
    """Valid references, one per address within ``days``; ``now`` adds the calendar rule."""
    refs, _ = valid_refs(feed_members(pages), site)
    if now is not None:
        refs = last_n_days(refs, days, now)
    return one_per_url(refs, days)


def one_per_url(refs: DataFrame, days: int, published: str = "published") -> DataFrame:
    """First arrival per address; the watermark drops late rows and expires the state.

    A calendar window of ``days`` reaches back to midnight, up to a day and a clock change more.
    """
    return refs.withWatermark(published, f"{24 * days + 25} hours").dropDuplicatesWithinWatermark(["url"])


def ingest_stream(
    refs: DataFrame, out: str, checkpoint: str, partition_by: str | None = None
) -> StreamingQuery:
    """Append what has landed to a Parquet table, then stop."""
    if partition_by:
        refs = refs.withColumn(partition_by, F.to_date("published"))
    writer = refs.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return (
        writer.option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


OUTCOMES = ("rejected", "late", "kept", "duplicate")


def read_line_stream(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines as files land, pages or not; see ``feed_lines``."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(landing).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
    )


def merge_batch(
    lines: DataFrame,
    batch_id: int,
    out: str,
    days: int,
    now: datetime,
    site: Site = Site(),
    n_buckets: int = N_BUCKETS,
) -> None:
    """Bring one batch of landed lines into the tables under ``out``.

    ``refs`` holds the first reference of each address in feed order, whatever the order of
    arrival, in folders by address. The smaller of two places wins and equal ones are the same
    row, so a batch may come again. ``outcomes`` has the batch's other members with the reason,
    ``malformed`` its lines that are no page, and ``batches`` a row that accounts for all members:
    rejected + late + kept + duplicate = landed. These three are replaced when the batch comes again.
    """
    spark = lines.sparkSession
    pages, broken = parse_pages(materialize(lines))
    members = materialize(feed_members(pages))
    refs, rejected = valid_refs(members, site)
    # No state expires: a row is late when it is older than the calendar window.
    old = F.col("published") < instant(refs, "published", cutoff(now, days))
    counts = Observation(f"batch {batch_id}")
    routed = refs.withColumn("outcome", F.when(old, "late")).unionByName(
        rejected.withColumn("outcome", F.lit("rejected")), allowMissingColumns=True
    )
    numbers = [F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES[:2]]
    routed = materialize(routed.observe(counts, F.count("*").alias("landed"), *numbers))
    fresh = routed.where("outcome is null").drop("outcome", "reject_reason")

    def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
        return first_wins(stored.unionByName(rows), "url", FEED_ORDER)

    merged = merge_buckets(spark, f"{out}/refs", fresh, "url", merge, n_buckets)
    winners = merged.select("url", *FEED_ORDER).withColumn("kept", F.lit(True))
    told = materialize(fresh.join(winners, ["url", *FEED_ORDER], "left").withColumn("kept", F.coalesce("kept", F.lit(False))))
    lost = told.where("not kept").drop("kept").withColumn("outcome", F.lit("duplicate"))
    others = routed.where("outcome is not null").unionByName(lost, allowMissingColumns=True)
    n_kept, n_lost = told.agg(F.count_if("kept"), F.count_if(~F.col("kept"))).first()
    row = [(counts.get["landed"], counts.get["rejected"], counts.get["late"], n_kept, n_lost)]
    summary = spark.createDataFrame(row, "landed long, rejected long, late long, kept long, duplicate long")
    for name, table in (("outcomes", others), ("malformed", broken), ("batches", summary)):
        table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")


def ingest_feed(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    days: int,
    now: datetime,
    site: Site = Site(),
    n_buckets: int = N_BUCKETS,
) -> StreamingQuery:
    """``merge_batch`` for everything that has landed, batch by batch, then stop."""

    def one(batch: DataFrame, batch_id: int) -> None:
        with work_tables(batch.sparkSession):
            merge_batch(batch, batch_id, out, days, now, site, n_buckets)

    return (
        lines.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
