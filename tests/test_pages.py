from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import html as H
from broadsheet.operators import pages as P
from broadsheet.site import LEGACY_CLEAN, LEGACY_EXTRACT, NEWS_CLEAN, NEWS_EXTRACT, Site

ARTICLE = """<html><head>
<title>tab text</title><meta property="og:description" content="Shared lead">
<meta content="Night team" name="author">
</head><body><nav><a href="/">Start</a></nav>
<section class="wrap"><div class="lead prose wide" data-k="1">
<h2 id="one">Tides</h2><ul><li>low</li><li>high <b>water</b></li></ul>
<picture><img alt="chart" data-src="//img.example/tide.png" decoding="async" style="width:9px"></picture>
<p>At <a title="gauge" href="gauge?id=7">the gauge</a>, <i>4 m</i>.</p>
<figure><img src="/photos/pier.webp" sizes="100vw" srcset="https://img.example/pier-1.webp 320w, https://img.example/pier-2.webp 1280w"></figure>
<div data-slot="x" class="side ad-slot big"><span>buy</span><div>now</div></div>
<p class="small post-excerpt">Water rose&nbsp;overnight.</p>
<blockquote>Mind the gap</blockquote></div></section>
<footer><h1>High <small>tide</small> at noon</h1><b class="x post__author-name">Iwo <u>Rak</u></b></footer>
</body></html>"""


def pages(spark, *htmls):
    rows = [(i, f"https://news.example/news/{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)


def clean(spark, *bodies, profile=NEWS_CLEAN):
    df = pages(spark, *[f'<div class="prose">{b}</div>' for b in bodies])
    rows = P.clean_pages(df, profile, Site(), prose="html").orderBy("page_id").collect()
    return [(r["body_html"], r["image_urls"]) for r in rows]


def test_tokens_join_to_the_page(spark):
    odd = [
        ARTICLE,
        "a < b <3 <p title='x > y'>t</p><!-- <p> --><script>if (a<b) '</p>'</script>",
        "<p>unclosed <b quote=\"x>tail <i>z</i>",
        "<" * 50 + "x" + ">" * 50,
        "",
        "</p></ div><?xml v?><!DOCTYPE x><A HREF=/x>y</A>",
    ]
    tokens = P.tokenize(pages(spark, *odd))
    joined = tokens.groupBy("page_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]), ""
        ).alias("html")
    )
    got = {r["page_id"]: r["html"] for r in joined.collect()}
    assert got == {i: h for i, h in enumerate(odd) if h}


def test_token_kinds(spark):
    html = "<!-- c --><p class=a>x<br/><IMG src=y>a < b</p><style>p{}</style><x/>"
    rows = P.tokenize(pages(spark, html)).orderBy("pos").collect()
    assert [(r["kind"], r["name"]) for r in rows] == [
        ("decl", ""), ("open", "p"), ("text", ""), ("void", "br"), ("void", "img"), ("text", ""),
        ("close", "p"), ("raw", "style"), ("void", "x"),
    ]


def test_long_inputs_do_not_recurse(spark):
    many = "<p " + " ".join(f'a{i}="v{i}"' for i in range(3000)) + ' id="z">t</p>'
    long = "<p>" + "x < y " * 40_000 + "</p>"
    deep = "<div>" * 3000 + "t" + "</div>" * 3000
    bodies = [b for b, _ in clean(spark, many, long, deep)]
    assert " id=" not in bodies[0] and 'a2999="v2999"' in bodies[0]
    assert bodies[1:] == [long, deep]


@pytest.mark.parametrize(
    "tag, name, value",
    [
        ("<a title=\"x href='no'\" href='yes'>", "href", "yes"),
        ("<a HREF=/p>", "href", "/p"),
        ("<a data-href='no'>", "href", None),
        ("<a href = \"a&amp;b\" >", "href", "a&b"),
        ("<a href=\"\">", "href", ""),
        ("<img alt=\"src=x\" src=y/>", "src", "y/"),
        ("<a href>", "href", None),
    ],
)
def test_attribute(evaluate, tag, name, value):
    assert evaluate(H.attribute(F.col("t"), name), t=tag) == value


def test_extract(spark):
    row = P.extract_pages(pages(spark, ARTICLE)).first()
    assert (row["title"], row["author"]) == ("High tide at noon", "Iwo Rak")
    assert row["excerpt"] == "Water rose overnight."
    assert row["prose_html"].startswith('<div class="lead prose wide" data-k="1">')
    assert row["prose_html"].endswith("<blockquote>Mind the gap</blockquote></div>")
    assert (row["slug"], row["reject_reason"]) == ("0", None)
    legacy = P.extract_pages(pages(spark, ARTICLE), LEGACY_EXTRACT).first()
    assert (legacy["title"], legacy["author"]) == ("Hightideat noon", "IwoRak")


def test_extract_rejects_in_checking_order(spark):
    def page(h1="<h1>T</h1>", author="A", body='<div class="prose">', excerpt="E", og="O"):
        lead = f'<p class="post-excerpt">{excerpt}</p>' if excerpt is not None else ""
        meta = f'<meta property="og:description" content="{og}">' if og else ""
        name = f'<meta name="author" content="{author}">' if author else ""
        return f"<head>{meta}{name}</head>{h1}{body}{lead}<p>x</p></div>"

    cases = [
        (page(), None, "E"),
        (page(h1=""), "no_title", "E"),
        (page(h1="<h1></h1>"), None, "E"),
        (page(author=""), "no_author", "E"),
        (page(body="<div>"), "no_body", None),
        (page(excerpt=None), None, "O"),
        (page(excerpt=" "), "no_excerpt", ""),
        (page(excerpt=None, og=""), "no_excerpt", None),
        ("", "no_title", None),
    ]
    out = P.extract_pages(pages(spark, *[c[0] for c in cases]))
    rows = out.orderBy("page_id").collect()
    assert [(r["reject_reason"], r["excerpt"]) for r in rows] == [c[1:] for c in cases]
    good, bad = P.split_rejects(out)
    assert good.count() + bad.count() == len(cases)
    with pytest.raises(Exception, match="no_title"):
        P.split_rejects(out, strict=True)[0].select("url").collect()


def test_author_hint_is_the_last_resort(spark):
    df = pages(spark, ARTICLE.replace("post__author-name", "x").replace("Night team", " "))
    df = df.withColumn("hint", F.lit(" Jo "))
    assert P.extract_pages(df, hint="hint").first()["author"] == "Jo"


def test_clean_article(spark):
    prose = P.extract_pages(pages(spark, ARTICLE)).select("page_id", "url", F.col("prose_html").alias("html"))
    row = P.clean_pages(prose, prose="html").first()
    body = row["body_html"]
    assert len(row["image_urls"]) == 2 and row["image_urls"][0] == "https://img.example/tide.png"
    for gone in ("ad-slot", "buy", "now", "post-excerpt", "overnight", "decoding", "sizes=", "id="):
        assert gone not in body.replace("gauge?id=7", "")
    for kept in ("<h2>Tides</h2>", "<li>high <b>water</b></li>", 'href="https://news.example/gauge?id=7"', "<blockquote>Mind the gap</blockquote>"):
        assert kept in body


CLEANING = {
    "nested ad": ('<div class="x ad-slot"><div>a</div><div>b</div></div>c', "c"),
    "ad by part of a word": ('<div class="broad-slot">kept</div>', '<div class="broad-slot">kept</div>'),
    "void ad": ('<img class="ad-slot" src="/x">t', "t"),
    "ad in upper case": ('<div class="AD-SLOT">a</div>t', "t"),
    "iframe": ("a<iframe src=x>fallback</iframe>b", "ab"),
    "excerpt ends at the next block": ('<p class="post-excerpt">lead<p>t</p>', "<p>t</p>"),
    "grid": ('<div class="posts-grid wide"><div>x</div></div>t', "t"),
    "scripts": ("<script>a</script><style>b</style><noscript><p>c</p></noscript>t", "t"),
    "script that closes itself": ('a<script src="x"/>b<STYLE media="m"/>c', "abc"),
    "script without an end": ("a<script>var b=1;<p>c", "a"),
    "style without an end": ("<p>a</p><style>p{}<p>b", "<p>a</p>"),
    "noscript without an end": ("<p>a</p><noscript><p>b</p>", "<p>a</p>"),
    "comments": ("a<!-- <p>b</p> -->c<!--[-->", "ac"),
    "embed with link": (
        '<div class="oembed"><p>x <a href="/t?a=1&amp;b=2">see <b>it</b></a> y</p></div>',
        '<p><a href="https://news.example/t?a=1&amp;b=2">seeit</a></p>',
    ),
    "embed link without text": (
        '<div class="oembed"><a href="https://t.example/1"><img src=x></a></div>',
        '<p><a href="https://t.example/1">https://t.example/1</a></p>',
    ),
    "embed markup is escaped": (
        "<div data-oembed='1'><a href='https://t.example/?q=\"x\"'>a &lt;b&gt; c</a></div>",
        '<p><a href="https://t.example/?q=&quot;x&quot;">a &lt;b&gt; c</a></p>',
    ),
    "embed without link": ('a<div data-oembed="u">x</div>b', "ab"),
    "ad inside an embed": (
        '<div class="oembed"><div class="ad-slot"><a href="/ad">ad</a></div></div>',
        '<p><a href="https://news.example/ad">ad</a></p>',
    ),
    "framework attributes": (
        '<h2 data-v-1a2b="" data-v-x class="h" id=top>t</h2>',
        '<h2 class="h">t</h2>',
    ),
    "id inside a value stays": ('<b title="a id=1">t</b>', '<b title="a id=1">t</b>'),
    "relative link": ('<a class="c" href="../x">t</a>', '<a class="c" href="https://news.example/x">t</a>'),
    "anchor link": ('<a href="#x" id="y">t</a>', '<a href="#x">t</a>'),
    "empty embeds": (
        '<div class="embed"><div class="embed"> </div><b></b></div>t<div class="embed">x</div>',
        't<div class="embed">x</div>',
    ),
    "empty embed in a full one": (
        '<div class="embed"><i>x</i><span class="embed"> &nbsp;</span></div>',
        '<div class="embed"><i>x</i></div>',
    ),
    "embed with an image": (
        '<div class="embed"><img src="https://c.example/1"></div>',
        '<div class="embed"><img src="https://c.example/1"/></div>',
    ),
    "blank paragraphs": ("<p> </p><p>&nbsp;</p><p><b> </b></p><p>t</p>", "<p>t</p>"),
    "advertising label": ("<p> REK<i>lama</i></p><p>reklama x</p>", "<p>reklama x</p>"),
    "image paragraph": ('<p><img src="https://c.example/1"></p>t', "t"),
    "open paragraph before a block": ("<p>reklama<div>t</div>", "<div>t</div>"),
    "stray end": ("<p>a<div>b</div></p>c", "<p>a<div>b</div>c"),
    "unclosed drop root": ('a<div class="ad-slot">b<p>c</p>', "a"),
    "ad closed by an earlier element": (
        '<section><div class="ad-slot">ad</section><p>a</p>', "<section></section><p>a</p>"
    ),
    "frame that nothing closes": ('<p>a</p><iframe src="x"><p>after', "<p>a</p><p>after"),
    "frame in a list": ("<ul><li>a<li><iframe>b</ul><p>c</p>", "<ul><li>a<li></ul><p>c</p>"),
    "frame in a paragraph": ("<p>a<iframe>b</p><p>c</p>", "<p>a</p><p>c</p>"),
    "end tag of an element inside the ad": (
        '<section><div class="ad-slot"><section>x</section>y</div>t</section>',
        "<section>t</section>",
    ),
    "stray end inside an ad": ('<div class="ad-slot">x</section>y</div>t', "t"),
    "ad after an unclosed one": (
        '<ul><li><span class="ad-slot">x</ul>t<div class="ad-slot">y</div>u', "<ul><li></ul>tu"
    ),
    "embed closed by an earlier element": (
        '<section><div class="oembed"><a href="https://t.example/1">x</a></section><p>y</p>',
        '<section><p><a href="https://t.example/1">x</a></p></section><p>y</p>',
    ),
    "upper case": ('<P CLASS="post-excerpt">x</P><P>t</P>', "<P>t</P>"),
}


def test_cleaning_rules(spark):
    got = clean(spark, *[before for before, _ in CLEANING.values()])
    assert {k: b for k, (b, _) in zip(CLEANING, got)} == {k: v[1] for k, v in CLEANING.items()}


def test_repairs_are_counted(spark):
    bodies = [
        '<section><div class="ad-slot">ad</section><iframe><p>a</p>',
        '<div class="ad-slot">x</div><p class="post-excerpt">lead<div>t</div>',
        'a<div class="ad-slot">b',
    ]
    df = pages(spark, *[f'<div class="prose">{b}</div>' for b in bodies])
    rows = P.clean_pages(df, prose="html", repairs=True).orderBy("page_id").collect()
    assert [r["n_repaired"] for r in rows] == [2, 0, 1]


def test_many_subtrees(spark):
    """Long pages: subtrees of several parts of a fold."""
    n = 3 * H.FOLDED + 5
    ads = "".join(f'<div class="ad-slot">x</div><p>{i}</p><p> </p>' for i in range(n))
    embeds = '<div class="embed"><div class="embed"> </div><b></b></div>t' * n
    got = [body for body, _ in clean(spark, ads, embeds, "<section><i>" * n + "<iframe>x" + "</section>" * n + "t")]
    assert got[0] == "".join(f"<p>{i}</p>" for i in range(n))
    assert got[1] == "t" * n
    assert got[2].endswith("<i></section>" + "</section>" * (n - 1) + "t")


def test_cleaning_nothing(spark):
    df = pages(spark, "", '<div class="prose"></div>', "x").withColumn(
        "html", F.when(F.col("html") != "x", F.col("html"))
    )
    rows = P.clean_pages(df, prose="html").orderBy("page_id").collect()
    assert [(r["body_html"], r["image_urls"]) for r in rows] == [("", []), ("", []), (None, None)]


def test_cleaning_flags(spark):
    keep = replace(NEWS_CLEAN, keep_image_paragraphs=True)
    image = '<p><img src="https://c.example/1"/></p>'
    assert clean(spark, image, profile=keep) == [(image, ["https://c.example/1"])]
    broad = '<div class="broad-slot">x</div><div class="xoembed">y</div>t'
    assert clean(spark, broad, profile=LEGACY_CLEAN)[0][0] == "t"


SOURCES = {
    '<img src=" /a.jpg " srcset="https://c.example/b.jpg 9w">': "https://news.example/a.jpg",
    '<img src="" data-src="//c.example/a.jpg">': "https://c.example/a.jpg",
    '<img src="data:x" data-src="/no.jpg" srcset="https://c.example/a 4w, https://c.example/b 8w">': "https://c.example/b",
    '<img srcset="https://c.example/a 8w, https://c.example/b 8w">': "https://c.example/a",
    '<img srcset="https://c.example/a 1x, https://c.example/b 2x">': None,
    '<img src="data:x">': "data:x",
    '<img srcset="https://c.example/a 99999999999999w, https://c.example/b 100000000000000w">': "https://c.example/b",
    '<img srcset="/a.jpg 300w">': None,
    '<img alt="x">': None,
}


def test_image_sources(spark):
    got = clean(spark, *[f"t{tag}" for tag in SOURCES])
    assert [urls for _, urls in got] == [[s] if s else [] for s in SOURCES.values()]


def test_image_urls_are_distinct_in_order(spark):
    body = "".join(f'<img src="https://c.example/{n}">' for n in "bab")
    assert clean(spark, body)[0][1] == ["https://c.example/b", "https://c.example/a"]


def test_equal_page_ids_do_not_mix(spark):
    one = pages(spark, '<div class="prose"><p>a</p></div>')
    two = one.withColumn("html", F.lit('<div class="prose"><p>b</p></div>'))
    got = P.clean_pages(one.unionByName(two), prose="html").collect()
    assert sorted(r["body_html"] for r in got) == ["<p>a</p>", "<p>b</p>"]


def test_cleaning_needs_no_shuffle(spark):
    df = P.clean_pages(P.extract_pages(pages(spark, ARTICLE), NEWS_EXTRACT))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
