from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import feed
from broadsheet.site import Site
from broadsheet.sources import cache, feed as source, listing
from tests.feed_pages import PAGES, member, write_pages

UTC = timezone.utc
WARSAW = ZoneInfo("Europe/Warsaw")


@pytest.mark.parametrize(
    "now, days, expected",
    [
        (datetime(2026, 6, 8, 12, tzinfo=UTC), 7, datetime(2026, 5, 31, 22, tzinfo=UTC)),
        (datetime(2026, 3, 30, 12, tzinfo=UTC), 1, datetime(2026, 3, 28, 23, tzinfo=UTC)),
        (datetime(2026, 10, 26, 12, tzinfo=UTC), 1, datetime(2026, 10, 24, 22, tzinfo=UTC)),
        (datetime(2026, 6, 8, 23, tzinfo=UTC), 1, datetime(2026, 6, 7, 22, tzinfo=UTC)),
        (datetime(2026, 6, 8, 12), 7, datetime(2026, 5, 31, 22, tzinfo=UTC)),
    ],
)
def test_cutoff(now, days, expected):
    assert feed.cutoff(now, days) == expected


def test_days_are_validated():
    with pytest.raises(ValueError):
        feed.cutoff(datetime.now(UTC), 0)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    write_pages(str(folder), "a", PAGES)
    return source.read_feed(spark, str(folder))


def test_members_and_refs(landed):
    refs, rejects = source.valid_refs(source.feed_members(landed))
    rows = {r["title"]: r for r in refs.collect()}
    assert set(rows) == {"Harbour", "Bridge", "Harbour again", "Long ago", "Late entry", "Behind the gap"}
    harbour, bridge = rows["Harbour"], rows["Bridge"]
    assert (harbour["url"], harbour["category"], harbour["author_hint"]) == ("https://news.example/news/harbour", "Sport", "Zoe")
    assert (bridge["url"], bridge["category"], bridge["author_hint"], bridge["page_no"], bridge["pos"]) == (
        "https://news.example/news/bridge?x=1", "Inne", "Uma Kot", 1, 5,
    )
    assert sorted(r["reject_reason"] for r in rejects.collect()) == [
        "bad_published", "no_published", "no_title", "no_url",
    ]


def test_page_numbers_from_file_names(spark, tmp_path):
    for name, page in (("posts_2", PAGES[0]), ("posts_10", PAGES[1])):
        write_pages(str(tmp_path / "in"), name, [{k: v for k, v in page.items() if k != "page"}])
    assert sorted(r["page"] for r in source.read_feed(spark, str(tmp_path / "in")).collect()) == [2, 10]
    write_pages(str(tmp_path / "bad"), "unnumbered", [{"totalItems": 1, "member": []}])
    with pytest.raises(Exception, match="no page number"):
        source.read_feed(spark, str(tmp_path / "bad")).collect()


def test_source_filter_follows_the_feed(spark, tmp_path):
    rows = [member("kept", "/a", type="post", disabled_in_lists=False, category_id=None), member("hidden", "/b", type="post", disabled_in_lists=True)]
    write_pages(str(tmp_path / "in"), "p1", [{"page": 1, "totalItems": 2, "member": rows}])
    members = source.feed_members(source.read_feed(spark, str(tmp_path / "in")))
    assert [r["title"] for r in source.feed_source_filter(members).collect()] == ["kept"]


def test_window_horizon_and_first_wins(landed):
    pages = feed.page_horizon(landed)
    assert [r["page"] for r in pages.collect()] == [1, 2]
    refs, _ = source.valid_refs(source.feed_members(pages))
    since = datetime(2025, 11, 5, tzinfo=WARSAW)
    taken = feed.take_while_recent(refs, ["page_no", "pos"], since)
    assert sorted(r["title"] for r in taken.collect()) == ["Bridge", "Harbour", "Harbour again"]
    kept = feed.last_n_days(refs, 5, datetime(2025, 11, 12, 9, tzinfo=UTC))
    assert sorted(r["title"] for r in kept.collect()) == ["Bridge", "Harbour", "Harbour again", "Late entry"]
    first = feed.first_wins(taken, "url", ["page_no", "pos"])
    assert sorted(r["title"] for r in first.collect()) == ["Bridge", "Harbour"]


def test_feed_rules_against_a_loop(spark):
    """Paging, take-while and first-wins against a plain loop over random feeds."""
    rnd = random.Random(5)
    day = datetime(2026, 6, 1, tzinfo=UTC)
    for _ in range(4):
        n_pages = rnd.randint(1, 6)
        data = []
        for page in range(1, n_pages + 1):
            size = rnd.choice([0, 3, 3, 4, 4])
            data.append(
                {
                    "page": page,
                    "totalItems": rnd.choice([20, 60, 200]),
                    "member": [
                        {
                            "title": f"t{page}-{i}",
                            "link": f"https://news.example/news/{rnd.randint(0, 5)}",
                            "published": (day + timedelta(hours=rnd.randint(-1, 40))).isoformat(),
                        }
                        for i in range(size)
                    ],
                }
            )
        seen, want, stop = set(), [], False
        for p in data:
            if not p["member"]:
                break
            for m in p["member"]:
                if datetime.fromisoformat(m["published"]) < day:
                    stop = True
                    break
                if m["link"] not in seen:
                    seen.add(m["link"])
                    want.append(m["title"])
            if stop or p["page"] * 18 >= p["totalItems"]:
                break
        landed = spark.createDataFrame(data, source.FEED_PAGE)
        refs, _ = source.valid_refs(source.feed_members(feed.page_horizon(landed)))
        got = feed.first_wins(
            feed.take_while_recent(refs, ["page_no", "pos"], day), "url", ["page_no", "pos"]
        )
        assert sorted(r["title"] for r in got.collect()) == sorted(want)


def test_take_while_keeps_all_without_an_old_row(spark):
    df = spark.range(5).withColumn("published", F.lit(datetime(2026, 1, 2, tzinfo=UTC)))
    assert feed.take_while_recent(df, ["id"], datetime(2026, 1, 1, tzinfo=UTC)).count() == 5


def test_empty_window_fails(spark):
    with pytest.raises(feed.EmptyWindow):
        feed.require_rows(spark.range(0), "nothing")
    assert feed.require_rows(spark.range(1), "nothing").count() == 1


def test_source_filter(spark):
    rows = [(1, "post", False, 7), (2, "post", True, 7), (3, "video", False, 7), (4, "post", False, 51), (5, "post", False, None)]
    df = spark.createDataFrame(rows, "id int, type string, disabled_in_lists boolean, category_id int")
    assert [r["id"] for r in source.feed_source_filter(df).orderBy("id").collect()] == [1, 5]


def test_window_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumn("published", F.timestamp_seconds("id")).write.parquet(f"{tmp_path}/t")
    df = feed.last_n_days(spark.read.parquet(f"{tmp_path}/t"), 1, datetime(1970, 1, 5, tzinfo=UTC))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published" in plan


def refs_of(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_fetch_plan(spark):
    refs = refs_of(spark, "https://a.example/x", "https://a.example/y/")
    stored = spark.createDataFrame([("y", "h"), ("y", "i")], "slug string, html string")
    hits, misses = cache.fetch_plan(refs, stored)
    assert [r["slug"] for r in hits.collect()] == ["y"]
    assert [r["slug"] for r in misses.collect()] == ["x"]
    hits, misses = cache.fetch_plan(refs, stored, enabled=False)
    assert (hits.count(), misses.count()) == (0, 2)


def test_cache_upsert(spark):
    schema = "slug string, html string, fetched_at int"
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 9)], schema)
    new = spark.createDataFrame([("b", "2", 2), ("b", "3", 3), ("c", "2", 2)], schema)
    got = {r["slug"]: r["html"] for r in cache.cache_upsert(old, new).collect()}
    assert got == {"a": "1", "b": "3", "c": "2"}


def test_fetch_routing(spark):
    rows = [("u1", 200, None), ("u2", 404, None), ("u3", None, "timeout"), ("u4", 500, None), ("u5", None, None)]
    df = spark.createDataFrame(rows, "url string, status int, error string")
    got = {r["url"]: (r["outcome"], r["reason"]) for r in cache.route_fetches(df).collect()}
    assert got == {
        "u1": ("ok", None), "u2": ("skipped", "http_404"), "u3": ("skipped", "network"),
        "u4": ("fatal", "http_500"), "u5": ("fatal", "http_none"),
    }
    with pytest.raises(Exception, match="http_500 u4"):
        cache.route_fetches(df.filter("url = 'u4'"), strict=True).collect()
    assert cache.route_fetches(df.filter("status < 405"), strict=True).count() == 2


LISTING = """<main>
<article class="post x"><a href="/tag/a">t</a><a href="/news/one"><span class="post__title">One <b>1</b></span></a>
 <ul><li class="post__info__item">Dzisiaj</li><li class="post__info__item">10 MIN</li>
 <li class="post__info__item">a1.02</li><li class="post__info__item">Sport</li></ul>
 <div class="post__author-name"> </div><div class="post__author-avatars"><i></i><img alt=" Av &amp; Co "></div></article>
<article class="post"><span class="post__title">No link</span></article>
<article class="postcard"><span class="post__title">Other</span><a href="/news/x">x</a></article>
<article class="post"><span class="post__title">Two</span><a href="/news/two#c">x</a><span class="post__author-name">Jo</span></article>
<article class="post"><span class="post__title">Three</span><a href="/news/three">x</a></article>
</main>"""


def test_listing(spark):
    df = spark.createDataFrame([(1, LISTING), (2, "<p>nothing</p>")], "list_id int, html string")
    now = datetime(2026, 6, 1, tzinfo=UTC)
    rows = listing.listing_refs(df, now, site=Site()).orderBy("pos").collect()
    assert [(r["title"], r["url"], r["category"], r["author_hint"]) for r in rows] == [
        ("One1", "https://news.example/news/one", "Sport", "Av & Co"),
        ("Two", "https://news.example/news/two#c", "Inne", "Jo"),
        ("Three", "https://news.example/news/three", "Inne", None),
    ]
    # the limit counts cards, also those without a link
    assert listing.listing_refs(df, now, limit=3).count() == 2


def test_listing_looks_up_each_part_of_a_card_once(spark):
    df = spark.createDataFrame([(1, LISTING)], "list_id int, html string")
    now = datetime(2026, 6, 1, tzinfo=UTC)
    plan = listing.listing_refs(df, now, limit=1)._jdf.queryExecution().optimizedPlan().toString()
    times = {name: plan.count(name) for name in ("post__title", r"post__author\-name", r"post__author\-avatars")}
    assert len(set(times.values())) == 1, times
    assert [r["pos"] for r in listing.listing_refs(df, now, limit=1).collect()] == [0]
    assert listing.listing_refs(df, now, limit=0).count() == 0
