"""The JSON feed: pages of members, and members as article references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from broadsheet.functions.text import (
    author_name,
    blank_to_null,
    category_label,
    parse_published,
)
from broadsheet.functions.urls import normalize_url
from broadsheet.schemas import FEED_PAGE
from broadsheet.session import materialize
from broadsheet.site import EXCLUDED_CATEGORY_ID, Site

FEED_ORDER = ("page_no", "pos")


def read_feed(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Landed feed pages ``(page, totalItems, member)``; see ``numbered``."""
    return numbered(spark.read.schema(FEED_PAGE).option("multiLine", multiline).json(path))


def numbered(pages: DataFrame, file: str = "_metadata.file_name") -> DataFrame:
    """Pages without a number take the last one in their file's name; with neither the job fails."""
    named = F.nullif(F.regexp_extract(file, r"([0-9]+)[^0-9]*$", 1), F.lit(""))
    missing = F.raise_error(F.concat(F.lit("no page number: "), F.col(file))).cast("int")
    return pages.withColumn("page", F.coalesce("page", named.try_cast("int"), missing))


def feed_lines(lines: DataFrame) -> DataFrame:
    """Landed lines of text (column ``value``) with the place they were read from.

    ``at`` ascends in the order of reading, so within one block of a file it counts its lines.
    """
    return lines.select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def parse_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of ``feed_lines`` and the lines that are none, each as it was read.

    A line that is cut off or has a field of another kind is no page; blank lines are nothing.
    """
    schema = StructType([*FEED_PAGE.fields, StructField("_corrupt", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    page = F.from_json("value", schema, options)
    parsed = lines.where(F.trim("value") != "").withColumn("p", page)
    broken = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    pages = parsed.where(~broken).select("file", *[f"p.{name}" for name in FEED_PAGE.names])
    return numbered(pages, "file").drop("file"), parsed.where(broken).drop("p")


def read_feed_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed pages of JSON lines, and rejects ``(file, line, reject_reason, record)``.

    Lines are read once into a work table. A reject's line number is the number of lines in
    earlier blocks of its file and before it in its own; only counts for each block are summed.
    """
    lines = materialize(feed_lines(spark.read.text(path)))
    pages, broken = parse_pages(lines)
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rejects = broken.join(blocks, ["path", "block"]).select(
        F.col("path").alias("file"),
        (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"),
        F.lit("malformed_page").alias("reject_reason"),
        F.col("value").alias("record"),
    )
    return pages, rejects


def feed_members(pages: DataFrame) -> DataFrame:
    """One row per member with its place ``(page_no, pos)``; an empty page has none."""
    return pages.select(
        F.col("page").alias("page_no"), F.posexplode("member").alias("pos", "m")
    ).select("page_no", "pos", "m.*")


def feed_source_filter(
    df: DataFrame,
    kind: str = "post",
    excluded_category: int = EXCLUDED_CATEGORY_ID,
) -> DataFrame:
    """What the feed is asked for: posts that lists may show, without one category.

    Plain comparisons on stored columns, so a Parquet scan takes them over.
    """
    return df.filter(
        (F.col("type") == kind)
        & ~F.col("disabled_in_lists")
        & (F.col("category_id").isNull() | (F.col("category_id") != excluded_category))
    )


def _member_url(link: Column, path: Column, base: str) -> Column:
    return F.coalesce(
        F.nullif(link, F.lit("")), normalize_url(F.nullif(path, F.lit("")), base)
    )


def valid_refs(
    members: DataFrame, site: Site = Site(), order: tuple[str, ...] = FEED_ORDER
) -> tuple[DataFrame, DataFrame]:
    """References ``(title, url, published, category, author_hint)`` and rejected members."""
    raw = F.nullif(F.col("published"), F.lit(""))
    out = members.select(
        blank_to_null(F.col("title")).alias("title"),
        _member_url(F.col("link"), F.col("path"), site.base).alias("url"),
        parse_published(raw).alias("published"),
        category_label(F.col("category")["title"]).alias("category"),
        author_name(F.col("author")).alias("author_hint"),
        raw.isNull().alias("_undated"),
        *order,
    )
    reason = (
        F.when(F.col("_undated"), "no_published")
        .when(F.col("url").isNull(), "no_url")
        .when(F.col("title").isNull(), "no_title")
        .when(F.col("published").isNull(), "bad_published")
    )
    rejects = out.select(*order, reason.alias("reject_reason")).filter("reject_reason IS NOT NULL")
    refs = out.filter(
        ~F.col("_undated")
        & F.col("url").isNotNull()
        & F.col("title").isNotNull()
        & F.col("published").isNotNull()
    ).drop("_undated")
    return refs, rejects
