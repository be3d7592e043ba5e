"""Order, index and documents of an issue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions.text import (
    author_anchor,
    blank_to_null,
    casefold,
    category_rank,
    count_label,
    date_label,
    escape_xml,
    issue_name,
    issue_title,
)
from broadsheet.functions.urls import chapter_file
from broadsheet.operators.ranking import global_positions, with_group_start
from broadsheet.operators.skew import join_dimension
from broadsheet.session import materialize
from broadsheet.site import AUTHOR_INDEX_TITLE, CATEGORY_ORDER, DEFAULT_AUTHOR, TIME_ZONE, Site

AUTHORS_FILE = "authors.xhtml"
# The chapter format.
XHTML_OPEN = (
    "<!DOCTYPE html>\n"
    '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" '
    'lang="pl" xml:lang="pl">\n'
    '<head>\n  <meta charset="utf-8"/>\n  <title>'
)
XHTML_BODY = (
    '</title>\n  <link rel="stylesheet" type="text/css" href="../style/nav.css"/>\n\n'
    "</head>\n<body>\n  "
)
XHTML_CLOSE = "\n</body>\n</html>"


def assign_chapter_files(articles: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``chapter_file`` and ``n_sharing``; the first article keeps a shared name.

    Names are shared by equal slugs and by slugs that differ in replaced characters only.
    Later ones get a suffix from their address. It is 16 digits long, since a common slug
    may be shared by millions.
    """
    named = articles.withColumn("chapter_file", chapter_file(F.col("slug")))
    owners = named.groupBy("chapter_file").agg(
        F.min_by("url", F.struct(*order)).alias("_owner"), F.count("*").alias("n_sharing")
    )
    suffix = F.concat(
        F.regexp_replace("chapter_file", r"\.xhtml$", "-"),
        F.substring(F.sha2("url", 256), 1, 16),
        F.lit(".xhtml"),
    )
    own = F.col("_owner") == F.col("url")
    # A common slug is a hot key: the owners are a dimension, broadcast while few and else salted.
    return (
        join_dimension(named, materialize(owners), "chapter_file")
        .withColumn("chapter_file", F.when(own, F.col("chapter_file")).otherwise(suffix))
        .drop("_owner")
    )


def group_by_category(
    articles: DataFrame,
    order: Sequence[str],
    ranks: tuple[str, ...] = CATEGORY_ORDER,
) -> DataFrame:
    """Add ``section_pos``, ``chapter_pos`` in the section and the running ``chapter_no``.

    Sections follow the category list, then their name; chapters follow the date, ties the
    feed order. Pass narrow rows: all of them are sorted.
    """
    rank = category_rank(F.col("category"), ranks)
    numbered = global_positions(
        articles, [rank, "category", "published", *order], "chapter_no"
    )
    starts = numbered.groupBy("category").agg(F.min("chapter_no").alias("_start"))
    sections = global_positions(starts, ["_start"], "section_pos")
    return (
        join_dimension(numbered, sections, "category")
        .withColumn("chapter_pos", F.col("chapter_no") - F.col("_start") + 1)
        .drop("_start")
    )


def issue_toc(chapters: DataFrame, tz: str = TIME_ZONE) -> DataFrame:
    """Contents: sections with their chapters, the author index as the last section."""
    rows = chapters.select(
        "section_pos",
        F.col("category").alias("section"),
        "chapter_pos",
        "title",
        F.col("chapter_file").alias("href"),
        date_label(F.col("published"), tz).alias("date_label"),
    )
    last = chapters.agg((F.coalesce(F.max("section_pos"), F.lit(0)) + 1).alias("section_pos"))
    index = last.select(
        F.col("section_pos").cast("bigint"),
        F.lit(AUTHOR_INDEX_TITLE).alias("section"),
        F.lit(1).cast("bigint").alias("chapter_pos"),
        F.lit(AUTHOR_INDEX_TITLE).alias("title"),
        F.lit(AUTHORS_FILE).alias("href"),
        F.lit(None).cast("string").alias("date_label"),
    )
    return rows.unionByName(index)


def author_groups(chapters: DataFrame, collation: str | None = None) -> DataFrame:
    """``(author, author_pos, anchor)``: authors by casefolded name, ties by first chapter.

    A ``collation`` such as ``pl`` orders names as that language does instead.
    """
    authors = (
        chapters.withColumn("author", author_or_default(F.col("author")))
        .groupBy("author")
        .agg(F.min("chapter_no").alias("_first"))
    )
    name = F.collate("author", collation) if collation else casefold(F.col("author"))
    ranked = global_positions(authors, [name, "_first"], "author_pos")
    ranked = ranked.drop("_first").withColumn("anchor", author_anchor(F.col("author")))
    owned = with_group_start(ranked, "anchor", "author_pos", "_owner")
    suffixed = F.concat("anchor", F.lit("-"), F.substring(F.sha2("author", 256), 1, 8))
    own = F.col("author_pos") == F.col("_owner")
    return owned.select(
        "author", "author_pos", F.when(own, F.col("anchor")).otherwise(suffixed).alias("anchor")
    )


def author_or_default(author: Column) -> Column:
    return F.coalesce(blank_to_null(author), F.lit(DEFAULT_AUTHOR))


def author_index(
    chapters: DataFrame, groups: DataFrame | None = None, tz: str = TIME_ZONE
) -> DataFrame:
    """Authors in order with their articles by date."""
    groups = author_groups(chapters) if groups is None else groups
    rows = (
        chapters.withColumn("author", author_or_default(F.col("author")))
        .select("author", "title", "chapter_file", "published", "chapter_no")
    )
    rows = join_dimension(rows, groups, "author")
    placed = global_positions(rows, ["author_pos", "published", "chapter_no"], "_no")
    placed = with_group_start(placed, "author_pos", "_no", "_start")
    return placed.select(
        "author_pos",
        "author",
        "anchor",
        (F.col("_no") - F.col("_start") + 1).alias("pos"),
        "title",
        F.col("chapter_file").alias("href"),
        date_label(F.col("published"), tz).alias("date_label"),
    )


def issue_summary(
    refs: DataFrame,
    articles: DataFrame,
    now: datetime,
    site: Site = Site(),
    tz: str = TIME_ZONE,
) -> DataFrame:
    """One row: period of all references, number of articles, labels and names."""
    aware = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    period = refs.agg(F.min("published").alias("date_from"), F.max("published").alias("date_to"))
    n = articles.agg(F.count("*").alias("n")).scalar()
    first, last = F.col("date_from"), F.col("date_to")
    return period.withColumn("article_count", n).select(
        issue_title(site.name, first, last, tz).alias("title"),
        F.concat(date_label(first, tz), F.lit(" – "), date_label(last, tz)).alias("period"),
        issue_name(site.name.lower(), first, last, tz).alias("issue_name"),
        date_label(F.lit(aware), tz).alias("generated"),
        "article_count",
        count_label(F.col("article_count")).alias("count_label"),
    )


def chapter_content(
    title: Column, author: Column, anchor: Column, excerpt: Column, body: Column
) -> Column:
    """A chapter document; parts without content are left out."""

    def tagged(head: str, text: Column, tail: str) -> Column:
        whole = F.concat(F.lit(head), text, F.lit(tail))
        return F.when(F.coalesce(text, F.lit("")) != "", whole)

    heading = escape_xml(title)
    name = F.nullif(escape_xml(author), F.lit(""))
    link = F.concat(F.lit(f'<a href="../{AUTHORS_FILE}#'), anchor, F.lit('">'), name, F.lit("</a>"))
    parts = F.concat_ws(
        "\n  ",
        F.concat(F.lit("<h1>"), heading, F.lit("</h1>")),
        tagged('<p class="author">', link, "</p>"),
        tagged('<p class="excerpt">', escape_xml(excerpt), "</p>"),
        F.concat(F.lit('<div class="article-body">'), body, F.lit("</div>")),
    )
    return F.concat(F.lit(XHTML_OPEN), heading, F.lit(XHTML_BODY), parts, F.lit(XHTML_CLOSE))


def chapter_places(chapters: DataFrame, groups: DataFrame) -> DataFrame:
    """``(url, chapter_file, anchor)``: narrow rows, so that texts meet them by address only."""
    named = chapters.select("url", "chapter_file", author_or_default(F.col("author")).alias("author"))
    return join_dimension(named, groups.select("author", "anchor"), "author").drop("author")


def chapter_documents(bodies: DataFrame) -> DataFrame:
    """``(path, category, content)`` of every article.

    An ``anchor`` column gives the place in the author index; without it the name does.
    """
    if "anchor" not in bodies.columns:
        bodies = bodies.withColumn("anchor", author_anchor(F.col("author")))
    parts = ("title", "author", "anchor", "excerpt", "body_html")
    content = chapter_content(*[F.col(c) for c in parts])
    return bodies.select(F.col("chapter_file").alias("path"), "category", content.alias("content"))
