from __future__ import annotations

import posixpath
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import urls as U
from broadsheet.site import Site

SITE = Site()
BASES = ["https://news.example", "https://news.example/a/b/page.html", "https://news.example/a/?q=1"]
RELATIVE = [
    "/news/x", "news/x", "../x", "/a/../../x", "./x/", "..", "/x/..", "?q=2", "x?q#f", "/x#f",
    "a//b", "//cdn.example/x", "mailto:a@b.c", "tel:1", "x/./y", "/", "g;x=1/../y", "/news/ł ó|x",
    "  /x", "https:y", "ftp://h/x", "x?", "/x/.",
]


@pytest.mark.parametrize("base", BASES)
def test_normalize_url_joins_like_the_standard(spark, base):
    df = spark.createDataFrame([(r,) for r in RELATIVE], "u string")
    got = [r["n"] for r in df.select(U.normalize_url(F.col("u"), base).alias("n")).collect()]
    expected = ["https:" + r if r.startswith("//") else urljoin(base, r) for r in RELATIVE]
    assert got == expected


@pytest.mark.parametrize(
    "url", ["", "#a", "data:image/gif;base64,A", "javascript:x()", "http://a/b", "https://a/../b"]
)
def test_normalize_url_keeps(evaluate, url):
    assert evaluate(U.normalize_url(F.col("u"), SITE.base), u=url) == url


def test_article_slug(evaluate):
    for url, slug in [
        ("https://news.example/news/foo-bar/", "foo-bar"),
        ("https://news.example/news/x?a=1#f", "x?a=1#f"),
        ("https://news.example", "news.example"),
        ("///", "article"),
        ("", "article"),
    ]:
        assert evaluate(U.article_slug(F.col("u")), u=url) == slug


def test_safe_slug_keeps_word_characters(evaluate):
    for slug in ["foo/bar!", "zażółć_gęś-1", "a²½b", "日本", "x" * 90, "é"]:
        expected = re.sub(r"[^\w\-]", "_", slug)[:80]
        assert evaluate(U.safe_slug(F.col("s")), s=slug) == expected
    assert evaluate(U.chapter_file(F.lit("a b"))) == "chapters/a_b.xhtml"


def test_article_keys(evaluate):
    def keys(url, slug):
        return evaluate(U.article_url_keys(F.col("u"), F.col("s"), SITE), u=url, s=slug)

    found = keys("https://news.example/news/river-gauge", "river-gauge")
    assert found[0] == "https://news.example/news/river-gauge"
    # the path alone, and both hosts with and without a last slash
    hosts = ("https://news.example", "https://www.news.example")
    every = {"/news/river-gauge"} | {f"{host}/news/river-gauge{end}" for host in hosts for end in ("", "/")}
    assert set(found) == every and len(found) == len(every)
    # an address of another section and host is known by its slug too
    assert "/news/low-tide" in keys("https://harbour.example/reports/low-tide", "low-tide")


@pytest.mark.parametrize("href", ["/news/low-tide?page=2#map", "//www.news.example/news/low-tide/#map", "https://news.example/news/low-tide"])
def test_href_keys(evaluate, href):
    found = evaluate(U.href_lookup_keys(F.col("h"), SITE), h=href)
    assert "/news/low-tide" in found and "https://www.news.example/news/low-tide" in found


@pytest.mark.parametrize("href", ["https://harbour.example/news/low-tide", "/reports/low-tide", "tel:112", "#map", "http://news.example:8080/news/low-tide"])
def test_hrefs_of_other_places_have_no_keys(evaluate, href):
    assert evaluate(U.href_lookup_keys(F.col("h"), SITE), h=href) == []


def test_fragment(evaluate):
    assert evaluate(U.fragment(F.col("u")), u="/a#b#c") == "b#c"
    assert evaluate(U.defragment(F.col("u")), u="/a#b#c") == "/a"


@pytest.mark.parametrize(
    "target, folder",
    [
        ("chapters/a.xhtml", "chapters"),
        ("chapters/a.xhtml", ""),
        ("authors.xhtml", "chapters"),
        ("a/b/c.x", "a/d/e"),
        ("a/b", "a/b"),
        ("a", "a/b/c"),
    ],
)
def test_relative_path(evaluate, target, folder):
    got = evaluate(U.relative_path(F.col("t"), F.col("f")), t=target, f=folder)
    assert got == posixpath.relpath(target, folder or ".")
