"""Test inputs derived from the driver tables, as SQL that Spark and DuckDB both run.

``{events}``, ``{pages}`` and ``{orders}`` stand for tables, ``{n}`` for the number of pages. Feed rows are
spread over the pages by event id; a page is met by as many events as there are per page.
"""

from __future__ import annotations

CATEGORY = (
    "CASE e.event_type WHEN 'view' THEN 'Sport' WHEN 'click' THEN 'Kraj' "
    "WHEN 'purchase' THEN 'Biznes' ELSE e.event_type END"
)

# Feed rows in the window or not: one per event.
FEED = f"""
SELECT e.event_id, concat(e.event_type, '-', e.event_id) AS title, p.url AS url,
       e.ts AS published, {CATEGORY} AS category, concat('user ', e.user_id) AS author_hint,
       p.page_id AS page_id
FROM {{events}} e JOIN {{pages}} p ON e.event_id % {{n}} = p.page_id
"""

# Raw feed members with the gaps a feed may have.
MEMBERS = """
SELECT e.event_id,
       CASE WHEN e.event_type = 'error' AND e.value < 5 THEN '  '
            ELSE concat('  ', e.event_type, '-', e.event_id, ' ') END AS title,
       CASE WHEN e.event_type IN ('view', 'signup') THEN ''
            ELSE concat('https://news.example/news/', e.event_id) END AS link,
       CASE WHEN e.event_type = 'view' THEN concat('/news/', e.event_id) ELSE NULL END AS path,
       CASE WHEN e.value < 1 THEN NULL WHEN e.value > 60 THEN 'soon'
            ELSE concat(substr(CAST(e.ts AS VARCHAR(40)), 1, 10), 'T',
                        substr(CAST(e.ts AS VARCHAR(40)), 12, 8), '+02:00') END AS published,
       CASE WHEN e.event_type = 'click' THEN ' ' WHEN e.event_type = 'purchase' THEN ' Sport '
            ELSE NULL END AS category,
       CASE WHEN e.event_type = 'click' THEN NULL ELSE ' user ' END AS firstname,
       CASE WHEN e.event_type = 'view' THEN '  ' ELSE concat(e.user_id, ' ') END AS lastname
FROM {events} e
"""

# A line of a feed page that was cut off.
CUT_LINE = """concat('{"page": ', page, ', "member": [{"title": "cut')"""

# News pages around the articles of the pages table: one part or another is missing.
NEWS_PAGES = """
SELECT page_id, concat('https://news.example/news/', page_id) AS url, concat(
  '<!DOCTYPE html><html><head><title>x</title>',
  CASE WHEN page_id % 7 = 0 THEN ''
       ELSE concat('<meta name="author" content=" Editor ', page_id, ' ">') END,
  CASE WHEN page_id % 4 = 2 THEN '' ELSE
       concat('<meta property="og:description" content="Summary ', page_id, ' &amp; more">') END,
  '</head><body>',
  CASE WHEN page_id % 11 = 0 THEN '' ELSE
       concat('<h1 class="t"> ', regexp_extract(html, '<h1>([^<]*)</h1>', 1), '<i> no ', page_id,
              '</i></h1>') END,
  CASE WHEN page_id % 3 = 0 THEN
       concat('<div><span class="x post__author-name">Jan <b>Kowalski</b> ', page_id,
              '</span></div>') ELSE '' END,
  CASE WHEN page_id % 13 = 0 THEN '<div class="prose-like">' ELSE '<div class="prose">' END,
  CASE WHEN page_id % 4 = 0 THEN
       concat('<p class="post-excerpt lead">Lead <em>', page_id, '</em></p>')
       WHEN page_id % 4 = 1 THEN '<p class="post-excerpt"> </p>' ELSE '' END,
  regexp_extract(html, '<article><h1>[^<]*</h1>(.*)</article>', 1),
  '</div><div>after</div></body></html>'
) AS html FROM {pages}
"""

# A body with every kind of mark-up the cleaner treats, around the whole article.
_DIRTY = (
    """'<p class="post-excerpt">lead</p>'""",
    """regexp_extract(html, '<article>(.*)</article>', 1)""",
    """'<div class="ad-slot-wrapper"><div>ad<iframe src="x"></iframe></div></div>'""",
    """concat('<div class="broad-slot" id="b', page_id, '">kept</div>')""",
    """concat('<div class="oembed"><blockquote><a href="/t/', page_id,
       '?a=1&amp;b=2">see <i>it</i></a></blockquote></div>')""",
    """'<div data-oembed="1">no link</div>'""",
    """'<!-- note --><script>var a="</div>";</script><noscript><b>x</b></noscript>'""",
    """'<section class="posts-grid"><section><p>more</p></section></section>'""",
    """concat('<figure data-v-1a2b=""><img class="w" src="data:image/gif;base64,AA" data-src="/x.jpg" ',
       'srcset="https://cdn.example/', page_id, '-400.jpg 400w, https://cdn.example/', page_id,
       '-800.jpg 800w, https://cdn.example/z.jpg 800w" width="1"></figure>')""",
    """concat('<img loading="lazy" src="/i/', page_id, '.png" alt="a &gt; b">')""",
    """'<div class="embed"><div class="embed"> </div><b> </b></div>'""",
    """'<div class="embed"><span>t</span><div class="embed"></div></div>'""",
    """'<p> Rek<b>lama</b> </p><p><img src="https://cdn.example/lost.jpg"></p><p>&nbsp;</p>'""",
    """'<section><div class="ad-slot">ad</section><p>a</p>'""",
    """'<p>b</p><iframe src="x"><p>after</p>'""",
    """'<ul><li>a<li><iframe>b</ul><p>c</p>'""",
    """concat('<p>tail <a href="/news/', page_id, '">a</a><div>end</div>')""",
)
_CLEAN = (
    """regexp_extract(html, '<article>(.*)</article>', 1)""",
    """'<div class="broad-slot">kept</div>'""",
    """concat('<p><a href="https://news.example/t/', page_id, '?a=1&amp;b=2">seeit</a></p>')""",
    """concat('<figure><img src="https://cdn.example/', page_id, '-800.jpg"/></figure>')""",
    """concat('<img src="https://news.example/i/', page_id, '.png" alt="a &gt; b"/>')""",
    """'<div class="embed"><span>t</span></div>'""",
    """'<section></section><p>a</p>'""",
    """'<p>b</p><p>after</p>'""",
    """'<ul><li>a<li></ul><p>c</p>'""",
    """concat('<p>tail <a href="https://news.example/news/', page_id, '">a</a><div>end</div>')""",
)
DIRTY_BODIES = f"""
SELECT page_id, url, concat('<div class="prose">', {", ".join(_DIRTY)}, '</div>') AS prose_html
FROM {{pages}}
"""
CLEAN_BODIES = f"""
SELECT page_id, concat({", ".join(_CLEAN)}) AS body_html,
       concat('https://cdn.example/', page_id, '-800.jpg,https://news.example/i/', page_id,
              '.png') AS image_urls
FROM {{pages}}
"""

# An advertising label after each paragraph.
LABELLED_BODIES = """
SELECT page_id, url, replace(
  concat('<div class="prose">', regexp_extract(html, '<article>(.*)</article>', 1), '</div>'),
  '</p>', '</p><p>Reklama</p><p> <b></b></p>') AS prose_html
FROM {pages}
"""

# Image attributes by event.
IMAGES = """
SELECT event_id,
       CASE event_type WHEN 'view' THEN concat('/img/', event_id, '.jpg')
            WHEN 'click' THEN '' WHEN 'error' THEN 'data:image/gif;base64,AA' END AS src,
       CASE event_type WHEN 'click' THEN concat(' //cdn.example/', event_id, '.jpg ') END AS data_src,
       concat('https://cdn.example/', event_id, '-a.jpg ', user_id, 'w, https://cdn.example/',
              event_id, '-b.jpg 75w, https://cdn.example/', event_id, '-c.jpg 2x') AS srcset
FROM {events}
"""

# One listing page per 20 events; the cards of a page are joined in order.
CARDS = """
SELECT CAST(floor(event_id / 20) AS BIGINT) AS list_id, event_id, concat(
  '<article class="post big"><a href="', CASE event_type WHEN 'error' THEN '/other/' ELSE '/news/' END,
  event_id, '"><span class="post__title"> ', event_type, ' <b>', event_id, '</b></span></a>',
  '<div class="post__info"><span class="post__info__item">Dzisiaj</span>',
  '<span class="post__info__item">5 min</span><span class="post__info__item">12.01</span>',
  CASE event_type WHEN 'signup' THEN '' ELSE concat('<span class="post__info__item">', event_type,
       '</span>') END, '</div>',
  CASE user_id % 3 WHEN 0 THEN concat('<span class="post__author-name"> user ', user_id, ' </span>')
       WHEN 1 THEN concat('<div class="post__author-avatars"><img src="x" alt=" av ', user_id,
                          ' "/></div>') ELSE '' END,
  '</article>') AS card
FROM {events}
"""

# A link of each event from one page to another, written in one of several forms.
LINKS = """
SELECT e.event_id, e.event_id % {n} AS source_id, e.user_id % {n} AS target_id, CASE e.event_type
  WHEN 'view' THEN concat('/news/', e.user_id % {n})
  WHEN 'click' THEN concat('https://news.example/news/', e.user_id % {n}, '/')
  WHEN 'signup' THEN concat('https://www.news.example/news/', e.user_id % {n}, '?x=1#part', e.user_id)
  WHEN 'purchase' THEN concat('//news.example/news/', e.user_id % {n}, '/#top')
  ELSE concat('https://other.example/news/', e.user_id % {n}) END AS href
FROM {events} e
"""

# A link of each event, of which several kinds lead to no page.
SKIPPED_LINKS = """
SELECT event_id, CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('#part', user_id)
  WHEN 2 THEN concat('mailto:u', user_id, '@x.example') WHEN 3 THEN concat('tel:', user_id)
  WHEN 4 THEN concat('/news/', user_id) ELSE concat('https://news.example/news/', user_id) END AS href
FROM {events}
"""

# A name whose first letter stands elsewhere in Polish than its code.
POLISH_AUTHOR = """concat(CASE user_id % 8 WHEN 0 THEN 'Ż' WHEN 1 THEN 'Z' WHEN 2 THEN 'Ć' WHEN 3 THEN 'D'
  WHEN 4 THEN 'Ł' WHEN 5 THEN 'L' WHEN 6 THEN 'Ą' ELSE 'B' END, lpad(CAST(user_id AS VARCHAR(20)), 6, '0'))"""

# What became of fetching each page, and the columns of a run's tables that are compared.
PAGE_STATUS = "CASE WHEN page_id % 19 = 0 THEN NULL WHEN page_id % 17 = 0 THEN 404 ELSE 200 END"
PAGE_ERROR = "CASE WHEN page_id % 19 = 0 THEN 'timeout' END"
RUN_TABLES = {
    "toc": ("section_pos", "section", "chapter_pos", "title", "href", "date_label"),
    "author_index": ("author_pos", "author", "anchor", "pos", "title", "href", "date_label"),
    "documents": ("path", "category", "content"),
    "summary": ("title", "period", "issue_name", "generated", "article_count", "count_label"),
    "rejects": ("url", "reject_reason"),
    "assets": ("url", "asset_url"),
}

# Landed fetches.
FETCHES = """
SELECT event_id, concat('https://news.example/news/', event_id) AS url,
       CAST(CASE user_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 301
            ELSE 200 END AS INT) AS status,
       CASE user_id % 10 WHEN 0 THEN 'timeout' END AS error
FROM {events}
"""
