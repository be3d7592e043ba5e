"""Registered queries: each reads whole driver tables and runs the library over them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce, wraps
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.functions import text as T, urls as U
from broadsheet.operators import assets, feed, issue, links, pages as P, skew
from broadsheet.plans.issue import build_issue, run_issue
from broadsheet.registry import derived as D
from broadsheet.session import checkpoint_dir, configure, materialize
from broadsheet.site import EXCLUDED_CATEGORY_ID, NEWS_EXTRACT, WEB_CLEAN, WEB_EXTRACT, Site
from broadsheet.sources import cache, feed as feed_source, listing
from broadsheet.sources.pages import join_laid_out, join_pages, lay_out_pages, read_pages
from broadsheet.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SITE = Site()
ORDER = ("recency", "event_id")
DAYS = 7


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A derived input; the number of pages comes from the file footers."""
    names = [n for n in ("events", "pages", "orders") if "{" + n + "}" in text]
    frames = {n: table(spark, sf_dir, n) for n in names if n != "pages"}
    if "pages" in names:
        frames["pages"] = read_pages(spark, f"{sf_dir}/pages.parquet")
    if "{n}" in text:
        text = text.replace("{n}", str(table(spark, sf_dir, "pages").count()))
    return spark.sql(text, **frames)


def now_of(spark: SparkSession, sf_dir: str):
    """The newest event counts as now."""
    return (
        table(spark, sf_dir, "events")
        .agg(F.max("ts").alias("now"))
        .collect()[0]["now"]
        .replace(tzinfo=timezone.utc)
    )


def feed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows, newest first by ``ORDER``."""
    refs = sql(spark, sf_dir, D.FEED).drop("page_id")
    return refs.withColumn("recency", -F.unix_micros(F.col("published").cast("timestamp")))


def window(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = feed.last_n_days(feed_refs(spark, sf_dir), DAYS, now_of(spark, sf_dir))
    return feed.first_wins(recent, "url", ORDER)


def stamp(col: str) -> Column:
    return F.date_format(F.col(col), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def web_articles(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    refs = window(spark, sf_dir).drop("title")
    found = join_pages(refs, read_pages(spark, f"{sf_dir}/pages.parquet"))
    out = P.extract_pages(found, WEB_EXTRACT, fields=fields)
    return P.split_rejects(out)[0]


def web_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = web_articles(spark, sf_dir, ("title",))
    narrow = articles.select(
        "url", "slug", "title", "author_hint", "category", "published", *ORDER
    ).withColumnRenamed("author_hint", "author")
    # names and order both start from it, and the pages are read for it
    narrow = materialize(narrow)
    return issue.group_by_category(issue.assign_chapter_files(narrow, ORDER), ORDER)


@query
def issue_toc(spark, sf_dir):
    return issue.issue_toc(web_chapters(spark, sf_dir))


@query
def issue_run(spark, sf_dir):
    """The contents of a whole run, with links and documents planned on the side."""
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    refs = feed_refs(spark, sf_dir)
    now = now_of(spark, sf_dir)
    return build_issue(
        refs, pages, now, DAYS, site=SITE, extract=WEB_EXTRACT, clean=WEB_CLEAN, order=ORDER
    )["toc"]


@query
def issue_run_tables(spark, sf_dir):
    """Every table of a whole run from feed rows and fetches: a row for each of theirs, as a digest."""
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    fetches = pages.select("url", F.expr(D.PAGE_STATUS).alias("status"), F.expr(D.PAGE_ERROR).alias("error"), "html")
    tables = run_issue(
        feed_refs(spark, sf_dir), fetches, now_of(spark, sf_dir), DAYS, order=ORDER,
        site=SITE, extract=WEB_EXTRACT, clean=WEB_CLEAN,
    )

    def digests(name: str) -> DataFrame:
        shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in D.RUN_TABLES[name]]
        digest = F.md5(F.concat_ws("|", *shown).cast("binary"))
        return tables[name].select(F.lit(name).alias("table_name"), digest.alias("row_md5"))

    return reduce(DataFrame.unionByName, map(digests, D.RUN_TABLES))


@query
def feed_valid_refs(spark, sf_dir):
    refs, rejects = feed_source.valid_refs(_members(spark, sf_dir), SITE, ("event_id",))
    good = refs.select(
        "event_id", "title", "url", stamp("published").alias("published"), "category",
        "author_hint", F.lit(None).cast("string").alias("reject_reason"),
    )
    return good.unionByName(rejects, allowMissingColumns=True)


def _members(spark, sf_dir):
    raw = sql(spark, sf_dir, D.MEMBERS)
    return raw.select(
        "event_id", "title", "link", "path", "published",
        F.struct(F.col("category").alias("title")).alias("category"),
        F.struct("firstname", "lastname").alias("author"),
    )


@query
def feed_read_json(spark, sf_dir):
    """Feed pages of 18 members written as JSON lines, then read back."""
    path = f"{_scratch(spark)}/feed"
    page = (F.floor(F.col("event_id") / 18) + 1).cast("int").alias("page")
    member = F.struct("event_id", "title", "link", "path", "published", "category", "author")
    rows = _members(spark, sf_dir).groupBy(page).agg(F.array_sort(F.collect_list(member)).alias("member"))
    rows.withColumn("totalItems", F.lit(table(spark, sf_dir, "events").count())).write.json(path)
    members = feed_source.feed_members(feed_source.read_feed(spark, path))
    refs, _ = feed_source.valid_refs(members, SITE)
    return refs.select(
        F.col("page_no").cast("bigint").alias("page_no"), F.col("pos").cast("bigint").alias("pos"),
        "title", "url", stamp("published").alias("published"), "category", "author_hint",
    )


def _land_feed(spark: SparkSession, sf_dir: str) -> str:
    """Feed pages of 18 members, eight files of JSON lines in no order, some lines cut off."""
    path = f"{_scratch(spark)}/landed"
    member = F.struct(
        "event_id", "title", F.col("url").alias("link"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("published"),
    )
    page = (F.floor(F.col("event_id") / 18) + 1).cast("int")
    rows = sql(spark, sf_dir, D.FEED).groupBy(page.alias("page")).agg(
        F.array_sort(F.collect_list(member)).alias("member")
    )
    whole = rows.select("page", F.to_json(F.struct("page", "member")).alias("value"))
    cut = rows.where("page % 25 = 3").select("page", F.expr(D.CUT_LINE).alias("value"))
    whole.union(cut).repartition(8, "page").select("value").write.text(path)
    return path


@query
def feed_read_rejects(spark, sf_dir):
    """Cut lines among landed pages: each is a reject, and the pages around them are read."""
    pages, rejects = feed_source.read_feed_checked(spark, _land_feed(spark, sf_dir))
    good = pages.select(
        F.col("page").cast("bigint").alias("page"), F.size("member").cast("bigint").alias("n_members"),
        F.lit(None).cast("string").alias("reject_reason"), F.lit(None).cast("string").alias("record"),
    )
    return good.unionByName(rejects.select("reject_reason", "record"), allowMissingColumns=True)


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """Landed files taken in four batches or more, and the lines of one file once again."""
    landed, scratch, now = _land_feed(spark, sf_dir), _scratch(spark), now_of(spark, sf_dir)
    lines = ingest.read_line_stream(spark, landed, files_per_batch=2)
    ingest.ingest_feed(lines, f"{scratch}/tables", f"{scratch}/state", DAYS, now, SITE, n_buckets=16).awaitTermination()
    again = feed_source.feed_lines(spark.read.text(landed))
    first = again.agg(F.min("file")).first()[0]
    ingest.merge_batch(again.where(F.col("file") == first), 1_000_000, f"{scratch}/tables", DAYS, now, SITE, n_buckets=16)
    return f"{scratch}/tables"


@query
def ingest_first_wins(spark, sf_dir):
    """First reference of each address in feed order, from files that land in any order."""
    refs = spark.read.parquet(f"{_ingested(spark, sf_dir)}/refs")
    return refs.select(
        "url", "title", stamp("published").alias("published"),
        F.col("page_no").cast("bigint").alias("page_no"), F.col("pos").cast("bigint").alias("pos"),
    )


@query
def ingest_late_rows(spark, sf_dir):
    """Members too old for the window, with the batches' accounts: no batch may lose a row."""
    tables = _ingested(spark, sf_dir)
    late = spark.read.parquet(f"{tables}/outcomes").where("outcome = 'late'")
    sums = spark.read.parquet(f"{tables}/batches").agg(
        F.count_if(F.expr("rejected + late + kept + duplicate <> landed")).alias("n")
    )
    rows = late.select("title", F.lit(0).cast("bigint").alias("n_unaccounted")).distinct()
    return rows.unionByName(sums.select(F.lit(None).cast("string").alias("title"), F.col("n").alias("n_unaccounted")))


def _scratch(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder; Spark creates it where it writes."""
    return f"{checkpoint_dir(spark)}/run-{uuid4()}"


@query
def feed_source_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(
        "event_id",
        F.col("event_type").alias("type"),
        (F.col("value") < 5).alias("disabled_in_lists"),
        F.get_json_object("props", "$.k").cast("int").alias("category_id"),
    )
    return feed_source.feed_source_filter(rows, "click", EXCLUDED_CATEGORY_ID).select("event_id")


@query
def feed_window_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = feed.last_n_days(events, DAYS, now_of(spark, sf_dir), published="ts")
    return kept.select("event_id", T.date_label(F.col("ts")).alias("date_label"))


@query
def feed_take_while(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    since = datetime(1995, 1, 20, tzinfo=timezone.utc)
    kept = feed.take_while_recent(orders, ["o_orderkey"], since, "o_orderdate")
    return kept.select("o_orderkey", "o_custkey")


@query
def feed_take_while_pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 18).alias("page_no"),
        (F.col("o_orderkey") % 18).alias("pos"),
        "o_orderkey",
        "o_orderdate",
    )
    since = datetime(1995, 1, 20, tzinfo=timezone.utc)
    return feed.take_while_recent(orders, ["page_no", "pos"], since, "o_orderdate").select(
        "o_orderkey"
    )


@query
def feed_take_while_ranges(spark, sf_dir):
    """Feed rows laid out by page, read range by range up to the first old one."""
    path = f"{_scratch(spark)}/feed"
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 180).alias("pos"), "o_orderkey", "o_orderdate",
        F.floor(F.col("o_orderkey") / 180).alias("page_no"),
    )
    rows.repartition("page_no").write.partitionBy("page_no").parquet(path)
    laid_out = spark.read.parquet(path).withColumn("page_no", F.col("page_no").cast("bigint"))
    since = datetime(1995, 1, 20, tzinfo=timezone.utc)
    kept = feed.take_while_in_ranges(laid_out, ["page_no", "pos"], since, "o_orderdate", first=2)
    return kept.select("o_orderkey")


@query
def feed_page_horizon(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pages = events.groupBy(F.floor(F.col("event_id") / 18).alias("page")).agg(
        F.count_if(F.col("event_type") == "view").alias("n_items"),
        (F.max("event_id") + F.max("user_id") * 20).alias("totalItems"),
    )
    return feed.page_horizon(pages, n_items=F.col("n_items"))


@query
def feed_first_wins(spark, sf_dir):
    first = feed.first_wins(feed_refs(spark, sf_dir), "url", ORDER)
    return first.select("url", "event_id", "title", stamp("published").alias("published"))


@query
def fetch_plan_cache_split(spark, sf_dir):
    stored = table(spark, sf_dir, "pages").filter(F.col("url").startswith("https:"))
    stored = stored.select(U.article_slug(F.col("url")).alias("slug"))
    hits, misses = cache.fetch_plan(window(spark, sf_dir), stored)
    return hits.select("url", "slug", F.lit(True).alias("cached")).unionByName(
        misses.select("url", "slug", F.lit(False).alias("cached"))
    )


@query
def cache_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "pages").select(
        U.article_slug(F.col("url")).alias("slug"),
        F.md5("html").alias("html"),
        F.to_timestamp(F.lit("2023-12-31 00:00:00")).alias("fetched_at"),
    )
    stored = cache.latest_per_key(stored, "slug", "html")
    recent = feed.last_n_days(feed_refs(spark, sf_dir), DAYS, now_of(spark, sf_dir))
    new = recent.select(
        U.article_slug(F.col("url")).alias("slug"),
        F.col("title").alias("html"),
        F.col("published").cast("timestamp").alias("fetched_at"),
    )
    return cache.cache_upsert(stored, new).select(
        "slug", "html", stamp("fetched_at").alias("fetched_at")
    )


@query
def cache_bucket_upsert(spark, sf_dir):
    """Whole pages in a cache of folders, then every feed row written over it."""
    path = f"{_scratch(spark)}/cache"
    stored = read_pages(spark, f"{sf_dir}/pages.parquet").select(
        U.article_slug(F.col("url")).alias("slug"),
        "html",
        F.expr("TIMESTAMP '2023-12-31 00:00:00' + make_dt_interval(0, 0, 0, page_id)").alias("fetched_at"),
    )
    new = feed_refs(spark, sf_dir).select(
        U.article_slug(F.col("url")).alias("slug"),
        F.col("title").alias("html"),
        F.col("published").cast("timestamp").alias("fetched_at"),
    )
    for rows in (stored, new.where("slug NOT LIKE '%7%'")):
        cache.upsert_buckets(spark, path, rows, n_buckets=16)
    return spark.read.parquet(path).select("slug", "html", stamp("fetched_at").alias("fetched_at"))


@query
def page_join_laid_out(spark, sf_dir):
    """Every feed row with the page of its address, pages laid out by address."""
    name = f"pages_{uuid4().hex}"
    lay_out_pages(read_pages(spark, f"{sf_dir}/pages.parquet"), name, 16, f"{_scratch(spark)}/pages")
    found = join_laid_out(feed_refs(spark, sf_dir), name)
    return found.select("event_id", "page_id", F.md5("html").alias("html_md5"))


@query
def fetch_outcome_routing(spark, sf_dir):
    routed = cache.route_fetches(sql(spark, sf_dir, D.FETCHES))
    return routed.select("event_id", "outcome", "reason")


@query
def page_tokens(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    return (
        P.tokenize(pages)
        .groupBy("page_id", "kind")
        .agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("n_chars"))
    )


@query
def page_extract(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    return P.extract_pages(pages, WEB_EXTRACT).select(
        "page_id", "title", "author", "slug", "prose_html", "reject_reason"
    )


@query
def page_extract_rejects(spark, sf_dir):
    out = P.extract_pages(sql(spark, sf_dir, D.NEWS_PAGES), NEWS_EXTRACT)
    return out.select("page_id", "title", "author", "excerpt", "reject_reason")


@query
def page_clean_body(spark, sf_dir):
    out = P.clean_pages(sql(spark, sf_dir, D.DIRTY_BODIES), site=SITE)
    return out.select("page_id", "body_html", F.array_join("image_urls", ",").alias("image_urls"))


@query
def page_clean_web(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    whole = pages.withColumn("html", F.concat(F.lit("<main>"), "html"))
    return P.clean_pages(whole, WEB_CLEAN, SITE, prose="html").select("page_id", "body_html")


@query
def page_drop_paragraphs(spark, sf_dir):
    out = P.clean_pages(sql(spark, sf_dir, D.LABELLED_BODIES), site=SITE)
    return out.select("page_id", "body_html")


@query
def image_best_source(spark, sf_dir):
    cols = [F.col(c) for c in ("src", "data_src", "srcset")]
    best = P.best_image_source(*cols, SITE.base)
    return sql(spark, sf_dir, D.IMAGES).select("event_id", best.alias("source"))


@query
def url_normalize(spark, sf_dir):
    href = F.expr(
        """CASE event_id % 11
           WHEN 1 THEN concat(' https://x.example/', event_id)
           WHEN 2 THEN concat('HTTPS://X.example/', event_id)
           WHEN 3 THEN concat(' //cdn.example/', event_id)
           WHEN 4 THEN concat(' http://x.example/', event_id)
           WHEN 5 THEN concat(' mailto:u', user_id, '@x.example')
           ELSE CASE event_type WHEN 'view' THEN concat('/a/./b/../', event_id, '?q=', user_id)
           WHEN 'click' THEN concat('//cdn.example/', event_id)
           WHEN 'signup' THEN concat('x//', event_id, '#f', user_id)
           WHEN 'purchase' THEN concat('mailto:u', user_id, '@news.example')
           ELSE concat('#', event_id) END END"""
    )
    return table(spark, sf_dir, "events").select(
        "event_id", U.normalize_url(href, "https://news.example/news/list").alias("url")
    )


@query
def url_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    keys = U.article_url_keys(F.col("url"), U.article_slug(F.col("url")), SITE)
    return pages.select("page_id", F.posexplode(keys).alias("pos", "key")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


@query
def href_keys(spark, sf_dir):
    keys = U.href_lookup_keys(F.col("href"), SITE)
    rows = sql(spark, sf_dir, D.LINKS).select("event_id", F.posexplode(keys).alias("pos", "key"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def url_paths(spark, sf_dir):
    """Slug, safe name, chapter path and relative path of every page address."""
    slug = U.article_slug(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        slug.alias("slug"),
        U.chapter_file(slug).alias("chapter_file"),
        U.relative_path(U.chapter_file(slug), F.lit("chapters")).alias("from_chapter"),
        U.relative_path(U.chapter_file(slug), F.lit("a/b")).alias("from_deeper"),
        U.relative_path(U.chapter_file(slug), F.lit("")).alias("from_root"),
    )


@query
def text_labels(spark, sf_dir):
    """Escapes, count labels and anchors over whole tables."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.md5(T.escape_xml(F.col("text"))).alias("escaped_md5"),
        T.count_label(F.col("n_chars")).alias("count_label"),
        T.author_anchor(F.col("text")).alias("anchor"),
    )


def _linked_bodies(spark, sf_dir):
    """Every page as an article whose body is its links in event order, after its own text."""
    made = sql(spark, sf_dir, D.LINKS).select(
        F.col("source_id").alias("page_id"),
        "event_id",
        F.concat(F.lit('<a href="'), "href", F.lit('">x</a>')).alias("a"),
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "a"))), lambda s: s["a"]), ""
    )
    bodies = made.groupBy("page_id").agg(joined.alias("links"))
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    text = F.regexp_extract("html", "<article>(.*)</article>", 1)
    slug = F.col("page_id").cast("string")
    return pages.join(bodies, "page_id").select(
        "page_id",
        F.concat(F.lit("https://news.example/news/"), "page_id").alias("url"),
        slug.alias("slug"),
        U.chapter_file(slug).alias("chapter_file"),
        F.concat(text, "links").alias("body_html"),
    )


@query
def link_index(spark, sf_dir):
    """Feed rows as articles: addresses recur, the last in order counts."""
    refs = feed_refs(spark, sf_dir).withColumn("slug", U.article_slug(F.col("url")))
    refs = refs.withColumn("chapter_file", U.chapter_file(F.col("title")))
    return links.link_index(refs, ORDER, SITE)


@query
def link_rewrite(spark, sf_dir):
    bodies = materialize(_linked_bodies(spark, sf_dir))
    # pages under http are not in the issue, links to them stay
    known = table(spark, sf_dir, "pages").filter(F.col("url").startswith("https:"))
    articles = bodies.join(known.select("page_id"), "page_id", "left_semi")
    index = links.link_index(articles.drop("body_html"), ["page_id"], SITE)
    probe = links.article_links(bodies.sample(0.1, seed=1), SITE)
    out = links.rewrite_links(bodies, index, SITE, skew.heavy_keys(probe, "key"))
    return out.select("page_id", "body_html")


@query
def group_by_category(spark, sf_dir):
    refs = feed_refs(spark, sf_dir).drop("title")
    out = issue.group_by_category(refs, ORDER)
    return out.select("event_id", "category", "section_pos", "chapter_pos", "chapter_no")


@query
def author_index(spark, sf_dir):
    return issue.author_index(web_chapters(spark, sf_dir))


@query
def asset_manifest(spark, sf_dir):
    manifest = assets.asset_manifest(_image_articles(spark, sf_dir))
    stored = manifest.filter(F.col("asset_url").startswith("https://news.example/i/"))
    status = assets.asset_plan(manifest, stored.select("asset_key"))
    return manifest.join(status.select("asset_key", "cached"), "asset_key").select(
        "url", F.col("idx").cast("bigint").alias("idx"), "asset_url", "asset_key", "asset_path",
        "cached",
    )


@query
def asset_files_judged(spark, sf_dir):
    """Images as they landed, packed into files: sizes from their bytes, some too large, some not there."""
    path = f"{_scratch(spark)}/images"
    manifest = assets.asset_manifest(_image_articles(spark, sf_dir))
    no = F.regexp_extract("asset_url", r"(\d+)(?:-800)?\.[a-z]+$", 1).cast("bigint")
    landed = manifest.select("asset_key", no.alias("no")).where("no % 7 <> 3").distinct()
    # An image is a line of text, so one byte more than its text.
    line = F.concat(F.repeat(F.lit("x"), (F.col("no") % 50 * 100).cast("int")), F.lit("\n"))
    assets.land_assets(landed.select("asset_key", line.cast("binary").alias("content")), path)
    judged = assets.judge_assets(manifest, assets.landed_assets(spark, path), max_bytes=2500)
    return judged.select("url", F.col("idx").cast("bigint").alias("idx"), "asset_status")


@query
def author_index_by_locale(spark, sf_dir):
    """Authors in Polish order."""
    rows = table(spark, sf_dir, "events").select(
        F.expr(D.POLISH_AUTHOR).alias("author"), F.col("event_id").alias("chapter_no")
    )
    return issue.author_groups(rows, collation="pl").select("author", "author_pos")


@query
def link_skipped(spark, sf_dir):
    """Links that lead to no page are not looked up."""
    made = sql(spark, sf_dir, D.SKIPPED_LINKS)
    body = F.concat(F.lit('<p><a href="'), "href", F.lit('">x</a></p>')).alias("body_html")
    bodies = made.select(F.concat(F.lit("https://news.example/news/"), "event_id").alias("url"), body)
    return links.article_links(bodies, SITE).select("url", "href").distinct()


def _image_articles(spark, sf_dir):
    cleaned = P.clean_pages(sql(spark, sf_dir, D.DIRTY_BODIES), site=SITE)
    # written once, several outputs start from it
    return materialize(cleaned.withColumn("slug", U.article_slug(F.col("url"))))


@query
def asset_rewrite(spark, sf_dir):
    """Large images stay remote: sizes come from the page texts."""
    cleaned = _image_articles(spark, sf_dir)
    manifest = assets.asset_manifest(cleaned)
    sizes = manifest.select(
        "asset_key",
        F.regexp_extract("asset_url", r"(\d+)[^/]*$", 1).cast("bigint").alias("no"),
    ).distinct()
    fetched = sizes.select(
        "asset_key",
        (F.col("no") * 100_000).alias("n_bytes"),
        F.when(F.col("no") % 10 == 9, "timeout").alias("error"),
    )
    heavy = skew.heavy_keys(manifest.sample(0.1, seed=1), "asset_key")
    judged = assets.judge_assets(manifest, fetched, heavy=heavy)
    return assets.asset_rewrite(cleaned, judged).select("page_id", "body_html")


@query
def issue_summary(spark, sf_dir):
    refs = window(spark, sf_dir)
    stored = table(spark, sf_dir, "pages").filter(F.col("url").startswith("https:"))
    articles = refs.join(stored.select("url"), "url", "left_semi")
    return issue.issue_summary(refs, articles, now_of(spark, sf_dir), SITE)


@query
def chapter_documents(spark, sf_dir):
    articles = web_articles(spark, sf_dir, ("title", "author", "excerpt", "prose_html"))
    # two outputs start from the articles: narrow rows for the names, texts for the documents
    cleaned = materialize(P.clean_pages(articles, WEB_CLEAN, SITE))
    names = issue.assign_chapter_files(cleaned.select("url", "slug", *ORDER), ORDER)
    named = cleaned.join(names.select("url", "chapter_file"), "url")
    named = named.withColumn("author", F.col("author_hint")).withColumn(
        "excerpt", F.when(F.col("category") == "Kraj", F.concat(F.lit('"'), "slug", F.lit('"')))
    )
    return issue.chapter_documents(named)


@query
def listing_refs(spark, sf_dir):
    cards = sql(spark, sf_dir, D.CARDS)
    html = F.concat(
        F.lit("<html><body><main>"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("event_id", "card"))), lambda s: s["card"]
            ),
            "\n",
        ),
        F.lit("</main></body></html>"),
    )
    pages = cards.groupBy("list_id").agg(html.alias("html"))
    found = listing.listing_refs(pages, now_of(spark, sf_dir), limit=15, site=SITE)
    return found.select(
        "list_id", F.col("pos").cast("bigint").alias("pos"), "title", "url",
        T.date_label(F.col("published")).alias("date_label"), "category", "author_hint",
    )


@query
def ingest_stream(spark, sf_dir):
    """Feed rows as a stream; which copy of an address arrives first is open, so keys only."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    n = table(spark, sf_dir, "pages").count()
    rows = stream.select(
        F.concat(F.lit("https://news.example/news/"), F.col("event_id") % n).alias("url"),
        F.col("ts").cast("timestamp").alias("published"),
    )
    rows = feed.last_n_days(rows, DAYS, now_of(spark, sf_dir))
    scratch = _scratch(spark)
    done = ingest.ingest_stream(
        ingest.one_per_url(rows, DAYS), f"{scratch}/refs", f"{scratch}/state"
    )
    done.awaitTermination()
    return spark.read.parquet(f"{scratch}/refs").select("url")
