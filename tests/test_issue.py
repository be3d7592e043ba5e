from __future__ import annotations

import random
from hashlib import sha256
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.urls import article_url_keys, href_lookup_keys
from broadsheet.operators import assets, issue, links, skew
from broadsheet.operators.ranking import global_positions
from broadsheet.plans.issue import build_issue, write_issue
from broadsheet.site import Site
from broadsheet.streaming import ingest

UTC = timezone.utc
SITE = Site()
START = datetime(2026, 6, 1, tzinfo=UTC)


def test_global_positions_match_a_sort(spark):
    rnd = random.Random(1)
    # one group holds a third of the rows
    rows = [(rnd.choice(["a", "a", "b", "c", "d", "e"]), rnd.randint(0, 9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = global_positions(df, ["g", "v", "i"], "no").orderBy("no").collect()
    assert [tuple(r) for r in got] == [(*row, no) for no, row in enumerate(sorted(rows), 1)]
    assert global_positions(df.filter("i < 0"), ["g", "i"], "no").collect() == []


def test_salted_join_equals_join(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)]
    left = spark.createDataFrame(rows, "key string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("kx", 4)], "key string, v int")
    heavy = skew.heavy_keys(left.sample(0.2, seed=3), "key")
    assert heavy.first()["key"] == "hot"
    want = sorted(map(tuple, left.join(right, "key").collect()))
    assert sorted(map(tuple, skew.salted_join(left, right, "key", heavy).collect())) == want
    spread = skew.salted_join(left, right, "key", heavy)
    assert len(spread.columns) == 3


def articles(spark, rows):
    """(slug, url, category, author, hours) -> articles in feed order."""
    data = [
        (url or f"https://news.example/news/{slug}", slug, f"T {slug}", cat, author, START + timedelta(hours=h), i)
        for i, (slug, url, cat, author, h) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "url string, slug string, title string, category string, author string, published timestamp, pos int"
    )


ROWS = [
    ("s2", None, "Sport", "Żurek", 5),
    ("k3", None, "Kraj", "adam", 9),
    ("x1", None, "Zebra", " ", 1),
    ("k1", None, "Kraj", "Adam", 1),
    ("i1", None, "Inne", "Adam", 1),
    ("k2", None, "Kraj", "Żurek", 1),
]


@pytest.fixture(scope="module")
def chapters(spark):
    named = issue.assign_chapter_files(articles(spark, ROWS), ["pos"])
    return issue.group_by_category(named, ["pos"]).cache()


def test_sections_and_chapters(chapters):
    rows = chapters.orderBy("chapter_no").collect()
    assert [(r["section_pos"], r["category"], r["chapter_pos"], r["slug"]) for r in rows] == [
        (1, "Kraj", 1, "k1"), (1, "Kraj", 2, "k2"), (1, "Kraj", 3, "k3"), (2, "Sport", 1, "s2"),
        (3, "Inne", 1, "i1"), (4, "Zebra", 1, "x1"),
    ]
    assert [r["chapter_no"] for r in rows] == [1, 2, 3, 4, 5, 6]


def test_toc(chapters):
    rows = issue.issue_toc(chapters).orderBy("section_pos", "chapter_pos").collect()
    assert tuple(rows[0]) == (1, "Kraj", 1, "T k1", "chapters/k1.xhtml", "01.06.2026")
    assert tuple(rows[-1]) == (5, "Indeks autorów", 1, "Indeks autorów", "authors.xhtml", None)


def test_author_index(chapters):
    rows = issue.author_index(chapters).orderBy("author_pos", "pos").collect()
    # equal folded names follow their first chapter, and share no anchor
    assert [(r["author_pos"], r["author"], r["pos"], r["title"]) for r in rows] == [
        (1, "Adam", 1, "T k1"), (1, "Adam", 2, "T i1"), (2, "adam", 1, "T k3"),
        (3, "Nieznany autor", 1, "T x1"), (4, "Żurek", 1, "T k2"), (4, "Żurek", 2, "T s2"),
    ]
    anchors = {r["author"]: r["anchor"] for r in rows}
    assert anchors["Adam"] == "author-adam"
    assert anchors["adam"].startswith("author-adam-") and len(anchors["adam"]) == 20


def test_shared_chapter_names(spark):
    df = articles(spark, [("a!", "https://n/1", "K", "A", 1), ("a?", "https://n/2", "K", "A", 2), ("b", "https://n/3", "K", "A", 3)])
    rows = issue.assign_chapter_files(df, ["pos"]).orderBy("pos").collect()
    assert rows[0]["chapter_file"] == "chapters/a_.xhtml"
    assert rows[1]["chapter_file"].startswith("chapters/a_-")
    assert [r["n_sharing"] for r in rows] == [2, 2, 1]
    assert len({r["chapter_file"] for r in rows}) == 3


def test_summary(spark):
    df = articles(spark, ROWS)
    row = issue.issue_summary(df, df.filter("pos < 2"), datetime(2026, 6, 1, 23, tzinfo=UTC), Site(name="Paper")).first()
    assert tuple(row) == (
        "Paper — 01.06.2026 – 01.06.2026", "01.06.2026 – 01.06.2026", "paper_2026-06-01_2026-06-01",
        "02.06.2026", 2, "artykuły",
    )


def test_chapter_document(spark):
    df = spark.createDataFrame(
        [("chapters/a.xhtml", "K", "Fog & sea", "Jo <x>", 'Lead "q"', "<p>b</p>"), ("chapters/b.xhtml", "K", "T", "", None, "")],
        "chapter_file string, category string, title string, author string, excerpt string, body_html string",
    )
    first, second = [r["content"] for r in issue.chapter_documents(df).orderBy("path").collect()]
    assert first.endswith(
        "<body>\n  <h1>Fog &amp; sea</h1>\n"
        '  <p class="author"><a href="../authors.xhtml#author-jo-x">Jo &lt;x&gt;</a></p>\n'
        '  <p class="excerpt">Lead &quot;q&quot;</p>\n'
        '  <div class="article-body"><p>b</p></div>\n</body>\n</html>'
    )
    assert "<title>Fog &amp; sea</title>" in first
    assert second.endswith('<body>\n  <h1>T</h1>\n  <div class="article-body"></div>\n</body>\n</html>')


def with_links(spark, rows):
    return spark.createDataFrame(
        [(f"https://news.example/news/{i}", f"chapters/{i}.xhtml", b) for i, b in enumerate(rows)],
        "url string, chapter_file string, body_html string",
    )


def test_link_rewriting(spark):
    found = articles(spark, [
        ("target", None, "K", "A", 1), ("again", "https://news.example/news/target?v=2", "K", "A", 2),
        ("odd", "http://news.example/news/odd/", "K", "A", 3), ("far", "https://live.example/x/far", "K", "A", 4),
    ])
    found = found.withColumn("chapter_file", F.concat(F.lit("chapters/"), "slug", F.lit(".xhtml")))
    index = links.link_index(found, ["pos"], SITE)
    cases = {
        '<a href="https://news.example/news/target">x</a>': "again.xhtml",
        '<a class="c" href="/news/target#a&amp;b">x</a>': "again.xhtml#a&amp;b",
        '<a href="https://www.news.example/news/target/">x</a>': "again.xhtml",
        '<a href="https://news.example/news/target?v=2">x</a>': "again.xhtml",
        '<a href="http://news.example/news/odd/">x</a>': "odd.xhtml",
        '<a href="/news/far">x</a>': "far.xhtml",
        '<a href="/news/absent">x</a>': "/news/absent",
        '<a href="https://other.example/news/target">x</a>': "https://other.example/news/target",
        '<a href="#top">x</a>': "#top",
        '<a href="mailto:a@b.c">x</a>': "mailto:a@b.c",
        "<p>no link</p>": None,
    }
    body = "".join(cases)
    df = with_links(spark, [*cases, body])
    heavy = skew.heavy_keys(links.article_links(df, SITE), "key")
    for hot in (None, heavy):
        rows = links.rewrite_links(df, index, SITE, hot).collect()
        got = {r["url"]: r["body_html"] for r in rows}
        for i, target in enumerate(cases.values()):
            text = got[f"https://news.example/news/{i}"]
            assert target is None and text == "<p>no link</p>" or f'href="{target}"' in text
        assert all(f'href="{t}"' in got[f"https://news.example/news/{len(cases)}"] for t in cases.values() if t)


def test_compact_index_equals_full_key_lists(spark):
    """The compact keys find what trying every address form in turn finds."""
    rnd = random.Random(9)
    forms = ["https://news.example/news/{}", "https://www.news.example/news/{}/", "http://news.example/news/{}",
             "https://news.example/news/{}?a=1", "https://live.example/{}", "https://news.example/news/{}/"]
    found = articles(spark, [
        (str(s), rnd.choice(forms).format(s), "K", "A", i) for i, s in enumerate(rnd.choices(range(6), k=14))
    ]).dropDuplicates(["url"]).withColumn("chapter_file", F.concat(F.lit("chapters/c"), "pos"))
    hrefs = [f.format(s) + e for f in [*forms, "/news/{}"] for s in range(7) for e in ("", "#f")]
    full = {}
    for r in found.select("pos", "chapter_file", article_url_keys(F.col("url"), F.col("slug"), SITE).alias("k")).orderBy("pos").collect():
        full.update(dict.fromkeys(r["k"], r["chapter_file"]))
    keys = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", href_lookup_keys(F.col("h"), SITE).alias("k"))
    want = {r["h"]: next((full[k] for k in r["k"] if k in full), None) for r in keys.collect()}
    df = with_links(spark, [f'<a href="{h}">x</a>' for h in hrefs])
    index = links.link_index(found, ["pos"], SITE)
    got = [r["body_html"] for r in links.rewrite_links(df, index, SITE).collect()]
    expected = [
        f'<a href="{want[h].removeprefix("chapters/") + ("#f" if h.endswith("#f") else "") if want[h] else h}">x</a>'
        for h in hrefs
    ]
    assert sorted(got) == sorted(expected)


def test_assets(spark):
    df = spark.createDataFrame(
        [("u1", "one", ["https://c/a", "https://c/ab", "https://c/big"], '<img src="https://c/ab"/><img src="https://c/a"/><img src="https://c/a"/><img src="https://c/big"/>'),
         ("u2", "two", ["https://c/a", "https://c/gone"], '<img src="https://c/a"/><img src="https://c/gone"/>'),
         ("u3", "three", [], "<p>x</p>")],
        "url string, slug string, image_urls array<string>, body_html string",
    )
    manifest = assets.asset_manifest(df)
    one, two = (f"{slug}_{sha256(url.encode()).hexdigest()[:16]}" for slug, url in (("one", "u1"), ("two", "u2")))
    assert sorted(r["asset_path"] for r in manifest.collect()) == sorted(
        f"images/{stem}_{idx}.jpg" for stem, n in ((one, 3), (two, 2)) for idx in range(n)
    )
    shared = df.withColumn("slug", F.lit("a?b#c&d"))
    paths = [r["asset_path"] for r in assets.asset_manifest(shared).collect()]
    assert len(set(paths)) == 5 and not any(c in p for p in paths for c in "?#&")
    key = F.sha2(F.col("u"), 256).alias("asset_key")
    stored = spark.createDataFrame([("https://c/a",)], "u string").select(key)
    plan = {r["asset_url"]: r["cached"] for r in assets.asset_plan(manifest, stored).collect()}
    assert plan == {"https://c/a": True, "https://c/ab": False, "https://c/big": False, "https://c/gone": False}
    got = spark.createDataFrame(
        [("https://c/a", 10, None), ("https://c/a", None, "timeout"), ("https://c/a", 10, None), ("https://c/ab", 5 * 1024 * 1024, None), ("https://c/big", 5 * 1024 * 1024 + 1, None)],
        "u string, n_bytes long, error string",
    ).select(key, "n_bytes", "error")
    judged = assets.judge_assets(manifest, got)
    assert sorted((r["asset_url"], r["asset_status"]) for r in judged.collect() if r["url"] == "u2") == [
        ("https://c/a", "ok"), ("https://c/gone", "missing"),
    ]
    bodies = {r["url"]: r["body_html"] for r in assets.asset_rewrite(df, judged).collect()}
    assert bodies == {
        "u1": f'<img src="../images/{one}_1.jpg"/><img src="../images/{one}_0.jpg"/><img src="../images/{one}_0.jpg"/><img src="https://c/big"/>',
        "u2": f'<img src="../images/{two}_0.jpg"/><img src="https://c/gone"/>',
        "u3": "<p>x</p>",
    }


def page(title, body):
    return (
        f'<html><h1>{title}</h1><span class="post__author-name">Ewa Lis</span><div class="prose">'
        f'<p class="post-excerpt">Lead</p>{body}</div></html>'
    )


def test_whole_run(spark, tmp_path):
    refs = articles(spark, [
        ("a", None, "Sport", None, 1), ("b", None, "Kraj", None, 2), ("a", None, "Kraj", None, 3),
        ("gone", None, "Kraj", None, 4), ("old", None, "Kraj", None, -300), ("bad", None, "Kraj", None, 5),
    ]).drop("slug", "author").withColumn("page_no", F.lit(1))
    base = "https://news.example/news"
    pages = spark.createDataFrame([
        (1, f"{base}/a", page("A", f'<p>x <a href="{base}/b#q">b</a></p><img src="/i.jpg">')),
        (2, f"{base}/b", page("B", '<p>y <a href="/news/a">a</a> <a href="/news/old">o</a></p>')),
        (9, f"{base}/b", page("B copy", "")),
        (3, f"{base}/bad", "<h1>x</h1>"),
        (4, f"{base}/old", page("O", "")),
    ], "page_id long, url string, html string")
    fetched = spark.createDataFrame([("https://news.example/i.jpg",)], "u string").select(
        F.sha2("u", 256).alias("asset_key"), F.lit(5).alias("n_bytes"), F.lit(None).cast("string").alias("error")
    )
    now = START + timedelta(days=1)
    tables = build_issue(refs, pages, now, 7, fetched)
    toc = tables["toc"].orderBy("section_pos", "chapter_pos").collect()
    assert [(r["section"], r["title"]) for r in toc] == [
        ("Kraj", "B"), ("Sport", "A"), ("Indeks autorów", "Indeks autorów"),
    ]
    docs = {r["path"]: r["content"] for r in tables["documents"].collect()}
    assert set(docs) == {"chapters/a.xhtml", "chapters/b.xhtml"}
    assert '<a href="b.xhtml#q">b</a>' in docs["chapters/a.xhtml"]
    assert f'<img src="../images/a_{sha256(f"{base}/a".encode()).hexdigest()[:16]}_0.jpg"/>' in docs["chapters/a.xhtml"]
    assert '<a href="a.xhtml">a</a> <a href="https://news.example/news/old">o</a>' in docs["chapters/b.xhtml"]
    assert tables["rejects"].collect()[0]["reject_reason"] == "no_author"
    summary = tables["summary"].first()
    assert (summary["article_count"], summary["count_label"]) == (2, "artykuły")
    write_issue(tables, str(tmp_path / "issue"))
    assert spark.read.parquet(str(tmp_path / "issue" / "documents")).count() == 2
    again = build_issue(refs, pages, now, 7, fetched)
    assert {r["path"]: r["content"] for r in again["documents"].collect()} == docs


def test_stream_ingest(spark, tmp_path):
    from tests.feed_pages import PAGES, member, write_pages

    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    # Late in the day, so that the window begins most of a day before now less five days.
    now = datetime(2025, 11, 12, 18, tzinfo=UTC)

    def run():
        refs = ingest.new_refs(ingest.read_feed_stream(spark, landing), 5, now)
        ingest.ingest_stream(refs, out, state, "published_date").awaitTermination()
        return sorted(r["url"].rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    newest = member("Newest", "/news/newest", "2025-11-12T17:59:00Z")
    write_pages(landing, "a", [*PAGES[:1], {"page": 9, "totalItems": 1, "member": [newest]}])
    assert run() == ["bridge?x=1", "harbour", "newest"]
    # A later file brings a copy, an old row, new ones and one from the first hours of the window.
    edge = {"page": 8, "totalItems": 1, "member": [member("Edge", "/news/edge", "2025-11-06T23:30:00Z")]}
    write_pages(landing, "b", [*PAGES[1:], edge])
    assert run() == ["behind", "bridge?x=1", "edge", "harbour", "late-entry", "newest"]
