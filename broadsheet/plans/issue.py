"""The whole run: feed and pages in, tables of an issue out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.operators.assets import asset_manifest, asset_rewrite, judge_assets
from broadsheet.operators.feed import first_wins, last_n_days, require_rows
from broadsheet.operators.issue import (
    assign_chapter_files,
    author_groups,
    author_index,
    chapter_documents,
    chapter_places,
    group_by_category,
    issue_summary,
    issue_toc,
)
from broadsheet.operators.links import article_links, link_index, rewrite_links
from broadsheet.operators.pages import clean_pages, extract_pages, split_rejects
from broadsheet.operators.skew import heavy_keys
from broadsheet.session import materialize, work_tables
from broadsheet.site import NEWS_CLEAN, NEWS_EXTRACT, CleanProfile, ExtractProfile, Site
from broadsheet.sources.cache import fetch_plan, route_fetches
from broadsheet.sources.feed import FEED_ORDER
from broadsheet.sources.pages import join_pages

# Share of the bodies looked at to find addresses that many of them link to.
HEAVY_SAMPLE = 0.01


def issue_window(
    refs: DataFrame, now: datetime, days: int, order: tuple[str, ...] = FEED_ORDER
) -> DataFrame:
    """References of the last ``days``, the first one per address."""
    return first_wins(last_n_days(refs, days, now), "url", order)


def extract_window(
    window: DataFrame, pages: DataFrame, extract: ExtractProfile = NEWS_EXTRACT
) -> DataFrame:
    """Extracted pages of the window with date, category and order of their reference."""
    hint = "author_hint" if "author_hint" in window.columns else None
    joined = join_pages(window.withColumnRenamed("title", "feed_title"), pages)
    return extract_pages(joined, extract, hint=hint)


def build_issue(
    refs: DataFrame,
    pages: DataFrame,
    now: datetime,
    days: int = 7,
    assets: DataFrame | None = None,
    site: Site = Site(),
    extract: ExtractProfile = NEWS_EXTRACT,
    clean: CleanProfile = NEWS_CLEAN,
    order: tuple[str, ...] = FEED_ORDER,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """Tables of an issue by name.

    References and cleaned pages are written once to the checkpoint folder, since all
    tables start from them. ``rejects`` has the pages left out with the reason, and the pages
    kept whose dropped mark-up was not closed (``unclosed_markup``). Names, order, links and images are worked out on narrow rows;
    body texts move once, to meet them by address.
    """
    window = materialize(issue_window(refs, now, days, order))
    if strict:
        require_rows(window, "no article in the window")
    extracted = extract_window(window, pages, extract)
    pages_cleaned = materialize(clean_pages(extracted, clean, site, repairs=True))
    cleaned, rejects = split_rejects(pages_cleaned, strict)
    # Kept, but told: mark-up that was dropped was not closed.
    repaired = cleaned.where("n_repaired > 0").select("url", F.lit("unclosed_markup").alias("reject_reason"))
    cleaned = cleaned.drop("n_repaired")

    narrow = cleaned.select("url", "slug", "title", "author", "category", "published", *order)
    chapters = group_by_category(assign_chapter_files(narrow, order), order)
    groups = author_groups(chapters)

    sample = cleaned.sample(HEAVY_SAMPLE, seed=1)
    probe = article_links(sample, site)
    index = link_index(chapters, ["chapter_no"], site)
    bodies = rewrite_links(cleaned, index, site, heavy_keys(probe, "key"))
    manifest = asset_manifest(cleaned)
    if assets is not None:
        heavy = heavy_keys(asset_manifest(sample), "asset_key")
        manifest = judge_assets(manifest, assets, heavy=heavy)
        bodies = asset_rewrite(bodies, manifest)
    return {
        "toc": issue_toc(chapters),
        "author_index": author_index(chapters, groups),
        "documents": chapter_documents(bodies.join(chapter_places(chapters, groups), "url")),
        "summary": issue_summary(window, cleaned, now, site),
        "assets": manifest,
        "rejects": rejects.unionByName(repaired),
    }


def landed_pages(
    window: DataFrame, fetches: DataFrame, cache: DataFrame | None = None, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Pages ``(url, page_id, html)`` of a window from the cache or from fetches, and what is skipped.

    ``cache``: ``(slug, html)``, one row a slug; its page is taken before a fetched one.
    ``fetches``: ``(url, status, error, html)``; of several good ones the least digest counts.
    Skipped addresses come with the fetch's reason, those that were not fetched with ``not_fetched``.
    """
    urls = window.select("url").distinct()
    if cache is None:
        hits, misses = None, urls
    else:
        hits, misses = fetch_plan(urls, cache)
        misses = misses.select("url")
    landed = fetches.join(misses, "url", "left_semi")
    good = F.col("outcome") == "ok"
    fetched = route_fetches(landed).where(good).select("url", F.xxhash64("html").alias("page_id"), "html")
    # Narrow rows: the reason of each address without a good fetch. Written, so that a strict run
    # judges the window's fetches only.
    routed = route_fetches(materialize(landed.select("url", "status", "error")), strict)
    judged = routed.groupBy("url").agg(F.max(good).alias("ok"), F.min("reason").alias("reason"))
    skipped = (
        misses.join(judged, "url", "left")
        .where(~F.coalesce("ok", F.lit(False)))
        .select("url", F.coalesce("reason", F.lit("not_fetched")).alias("reject_reason"))
    )
    if hits is None:
        return fetched, skipped
    stored = hits.join(cache, "slug").select("url", F.lit(0).cast("bigint").alias("page_id"), "html")
    return stored.unionByName(fetched), skipped


def run_issue(
    refs: DataFrame,
    fetches: DataFrame,
    now: datetime,
    days: int = 7,
    cache: DataFrame | None = None,
    order: tuple[str, ...] = FEED_ORDER,
    strict: bool = False,
    allow_empty: bool = False,
    **options: object,
) -> dict[str, DataFrame]:
    """``build_issue`` from what was fetched and cached; skipped addresses are among the rejects.

    Without a reference in the window, or without an article of them, there is no issue and
    ``EmptyWindow`` is raised, unless ``allow_empty``.
    """
    window = materialize(issue_window(refs, now, days, order))
    if not allow_empty:
        require_rows(window, "no reference in the window")
    pages, skipped = landed_pages(window, fetches, cache, strict)
    tables = build_issue(window, pages, now, days, order=order, strict=strict, **options)
    if not allow_empty:
        require_rows(tables["documents"].select("path"), "no article in the window")
    return tables | {"rejects": tables["rejects"].unionByName(skipped)}


def issue_to(path: str, spark: SparkSession, *args: object, **options: object) -> None:
    """``run_issue`` and ``write_issue`` in one: the run's work tables are gone afterwards."""
    with work_tables(spark):
        write_issue(run_issue(*args, **options), path)


def write_issue(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table of an issue; documents are laid out by category.

    Documents are rebalanced by category: adaptive execution splits a large category and joins
    small ones, so there are about as many files as their size needs, and one a category at least.
    """
    for name, table in tables.items():
        if name == "documents":
            table.hint("rebalance", "category").write.mode("overwrite").partitionBy("category").parquet(f"{path}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
