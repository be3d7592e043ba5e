"""What each registered query has to return, as DuckDB SQL over the same tables.

Where an input is made up from a table, the expected values are written down from the
table's columns, not parsed back out of the input.
"""

from __future__ import annotations

from broadsheet.registry import derived as D

TABLES = {
    "events": "events",
    "pages": "pages",
    "orders": "orders",
    "n": "(SELECT count(*) FROM pages)",
}


def _fill(text: str) -> str:
    for name, value in TABLES.items():
        text = text.replace("{" + name + "}", value)
    return text


def _local(ts: str) -> str:
    return f"timezone('Europe/Warsaw', timezone('UTC', {ts}))"


def _label(ts: str) -> str:
    return f"strftime({_local(ts)}, '%d.%m.%Y')"


def _stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


NOW = "(SELECT max(ts) FROM events)"
CUTOFF = (
    f"timezone('UTC', timezone('Europe/Warsaw', CAST(CAST({_local(NOW)} AS DATE) - 7 AS TIMESTAMP)))"
)
SLUG = "coalesce(nullif(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), ''), 'article')"


def _file(slug: str) -> str:
    safe = rf"substr(regexp_replace({slug}, '[^\p{{L}}\p{{N}}_\-]', '_', 'g'), 1, 80)"
    return f"concat('chapters/', {safe}, '.xhtml')"


def _text(html: str) -> str:
    """Text of one node: entities of the driver pages, white space collapsed."""
    plain = f"regexp_replace(regexp_replace({html}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


FEED = f"feed AS ({_fill(D.FEED)})"
WINDOW = f"""{FEED}, recent AS (SELECT * FROM feed WHERE published >= {CUTOFF}),
win AS (SELECT * FROM (SELECT *, row_number() OVER (
          PARTITION BY url ORDER BY published DESC, event_id) AS rn FROM recent) WHERE rn = 1)"""
H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1)"
HOST = "regexp_extract(url, '//([^/?#]*)', 1)"
RANK = "CASE category WHEN 'Kraj' THEN 0 WHEN 'Sport' THEN 2 WHEN 'Biznes' THEN 4 ELSE 11 END"
NAMED = f"""{WINDOW}, arts AS (
  SELECT w.*, {_text(H1)} AS h1, p.html FROM (SELECT * EXCLUDE (title) FROM win) w
  JOIN (SELECT url AS purl, html FROM pages) p ON w.url = p.purl),
plain AS (SELECT *, {SLUG} AS slug, {_file(SLUG)} AS file FROM arts),
named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY file ORDER BY published DESC, event_id) = 1
    THEN file ELSE concat(regexp_replace(file, '\\.xhtml$', '-'), substr(sha256(url), 1, 16), '.xhtml')
    END AS chapter_file FROM plain),
chapters AS (SELECT *, dense_rank() OVER (ORDER BY {RANK}, category) AS section_pos,
    row_number() OVER (PARTITION BY category ORDER BY published, event_id) AS chapter_pos FROM named)"""

KIND = r"""CASE WHEN tok LIKE '</%' THEN 'close'
  WHEN regexp_matches(tok, '^<[!?]') THEN 'decl'
  WHEN regexp_matches(tok, '(?i)^<(script|style|noscript)\b') THEN 'raw'
  WHEN regexp_matches(tok, '(?i)^<(area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)\b') THEN 'void'
  WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'open' ELSE 'text' END"""
TOKEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
    r"""|</?[a-z!](?:[^>"'']+|"[^"]*"|''[^'']*'')*>|[^<]+|<"""
)

_HAS_H1 = "page_id % 11 <> 0"
_HAS_AUTHOR = "(page_id % 3 = 0 OR page_id % 7 <> 0)"
_HAS_BODY = "page_id % 13 <> 0"
_EXCERPT = """CASE WHEN page_id % 4 = 0 THEN concat('Lead ', page_id) WHEN page_id % 4 = 1 THEN ''
  WHEN page_id % 4 = 2 THEN NULL ELSE concat('Summary ', page_id, ' & more') END"""

_LINK_TARGET = "(SELECT page_id AS tid FROM pages WHERE url LIKE 'https:%')"

ORACLE: dict[str, str] = {
    "issue_toc": f"""WITH {NAMED}
SELECT section_pos, category AS section, chapter_pos, h1 AS title, chapter_file AS href,
       {_label("published")} AS date_label FROM chapters
UNION ALL SELECT (SELECT max(section_pos) FROM chapters) + 1, 'Indeks autorów', 1, 'Indeks autorów',
       'authors.xhtml', NULL""",
    "feed_valid_refs": f"""WITH m AS ({_fill(D.MEMBERS)}), r AS (
SELECT m.*, e.ts, e.event_type, e.user_id, CASE WHEN published IS NULL THEN 'no_published'
    WHEN event_type = 'signup' THEN 'no_url' WHEN trim(title) = '' THEN 'no_title'
    WHEN published = 'soon' THEN 'bad_published' END AS reject_reason
FROM m JOIN events e USING (event_id))
SELECT event_id, CASE WHEN reject_reason IS NULL THEN trim(title) END AS title,
  CASE WHEN reject_reason IS NULL THEN concat('https://news.example/news/', event_id) END AS url,
  CASE WHEN reject_reason IS NULL THEN
    {_stamp("date_trunc('second', ts) - INTERVAL 2 HOUR")} END AS published,
  CASE WHEN reject_reason IS NULL THEN
    CASE event_type WHEN 'purchase' THEN 'Sport' ELSE 'Inne' END END AS category,
  CASE WHEN reject_reason IS NULL THEN CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR)
    WHEN 'view' THEN 'user' ELSE concat('user ', user_id) END END AS author_hint, reject_reason
FROM r""",
    "feed_read_json": f"""WITH m AS ({_fill(D.MEMBERS)})
SELECT CAST(e.event_id // 18 + 1 AS BIGINT) AS page_no, CAST(e.event_id % 18 AS BIGINT) AS pos,
  trim(title) AS title, concat('https://news.example/news/', e.event_id) AS url,
  {_stamp("date_trunc('second', ts) - INTERVAL 2 HOUR")} AS published,
  CASE event_type WHEN 'purchase' THEN 'Sport' ELSE 'Inne' END AS category,
  CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN 'user'
    ELSE concat('user ', user_id) END AS author_hint
FROM m JOIN events e USING (event_id)
WHERE published IS NOT NULL AND published <> 'soon' AND event_type <> 'signup' AND trim(title) <> ''""",
    "feed_source_filter": """SELECT event_id FROM events
WHERE event_type = 'click' AND NOT value < 5
  AND CAST(json_extract_string(props, '$.k') AS INT) IS DISTINCT FROM 51""",
    "feed_window_filter": f"""SELECT event_id, {_label("ts")} AS date_label FROM events
WHERE ts >= {CUTOFF}""",
    "feed_take_while": """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <
  (SELECT min(o_orderkey) FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-20')""",
    "feed_take_while_pages": """SELECT o_orderkey FROM orders WHERE o_orderkey <
  (SELECT min(o_orderkey) FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-20')""",
    "feed_take_while_ranges": """SELECT o_orderkey FROM orders WHERE o_orderkey <
  (SELECT min(o_orderkey) FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-20')""",
    "asset_files_judged": """SELECT url, CAST(unnest([0, 1]) AS BIGINT) AS idx,
  CASE WHEN page_id % 7 = 3 THEN 'missing' WHEN page_id % 50 * 100 + 1 <= 2500 THEN 'ok' ELSE 'too_large' END AS asset_status
FROM pages""",
    "author_index_by_locale": f"""SELECT author, row_number() OVER (ORDER BY author COLLATE pl) AS author_pos
FROM (SELECT DISTINCT {D.POLISH_AUTHOR} AS author FROM events)""",
    "link_skipped": f"""SELECT concat('https://news.example/news/', event_id) AS url, href
FROM ({_fill(D.SKIPPED_LINKS)}) WHERE href LIKE '/news/%' OR href LIKE 'https:%'""",
    "feed_page_horizon": """WITH p AS (SELECT event_id // 18 AS page,
  count(*) FILTER (event_type = 'view') AS n_items,
  max(event_id) + max(user_id) * 20 AS "totalItems" FROM events GROUP BY 1)
SELECT CAST(page AS BIGINT) AS page, n_items, "totalItems" FROM p WHERE page <= coalesce(
  (SELECT min(CASE WHEN n_items = 0 THEN page - 1 WHEN page * 18 >= "totalItems" THEN page END) FROM p),
  (SELECT max(page) FROM p))""",
    "feed_first_wins": f"""WITH {FEED} SELECT url, event_id, title, {_stamp("published")} AS published
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published DESC, event_id) AS rn FROM feed)
WHERE rn = 1""",
    "fetch_plan_cache_split": f"""WITH {WINDOW}, stored AS (
  SELECT DISTINCT {SLUG} AS slug FROM pages WHERE url LIKE 'https:%')
SELECT url, {SLUG} AS slug, {SLUG} IN (SELECT slug FROM stored) AS cached FROM win""",
    "cache_upsert": f"""WITH {WINDOW},
new AS (SELECT slug, arg_max(title, published) AS html, max(published) AS fetched_at
        FROM (SELECT *, {SLUG} AS slug FROM recent) GROUP BY slug),
old AS (SELECT slug, max(md5(html)) AS html FROM (SELECT *, {SLUG} AS slug FROM pages) GROUP BY slug)
SELECT slug, html, {_stamp("fetched_at")} AS fetched_at FROM new
UNION ALL SELECT slug, html, '2023-12-31 00:00:00.000000' FROM old
WHERE slug NOT IN (SELECT slug FROM new)""",
    "fetch_outcome_routing": """SELECT event_id,
  CASE user_id % 10 WHEN 0 THEN 'skipped' WHEN 1 THEN 'skipped' WHEN 2 THEN 'fatal'
    WHEN 3 THEN 'fatal' ELSE 'ok' END AS outcome,
  CASE user_id % 10 WHEN 0 THEN 'network' WHEN 1 THEN 'http_404' WHEN 2 THEN 'http_500'
    WHEN 3 THEN 'http_301' END AS reason FROM events""",
    "page_tokens": f"""SELECT page_id, {KIND} AS kind, count(*) AS n,
  CAST(sum(length(tok)) AS BIGINT) AS n_chars
FROM (SELECT page_id, unnest(regexp_extract_all(html, '{TOKEN}')) AS tok FROM pages) GROUP BY 1, 2""",
    "page_extract": f"""SELECT page_id, {_text(H1)} AS title, {HOST} AS author, {SLUG} AS slug,
  concat('<article>', {ARTICLE}, '</article>') AS prose_html, CAST(NULL AS VARCHAR) AS reject_reason
FROM pages""",
    "page_extract_rejects": f"""SELECT page_id,
  CASE WHEN {_HAS_H1} THEN trim(concat({_text(H1)}, ' no ', page_id)) END AS title,
  CASE WHEN page_id % 3 = 0 THEN concat('Jan Kowalski ', page_id)
       WHEN page_id % 7 <> 0 THEN concat('Editor ', page_id) END AS author,
  CASE WHEN {_HAS_BODY} THEN {_EXCERPT} END AS excerpt,
  CASE WHEN NOT {_HAS_H1} THEN 'no_title' WHEN NOT {_HAS_AUTHOR} THEN 'no_author'
       WHEN NOT {_HAS_BODY} THEN 'no_body'
       WHEN coalesce({_EXCERPT}, '') = '' THEN 'no_excerpt' END AS reject_reason
FROM pages""",
    "page_clean_body": _fill(D.CLEAN_BODIES),
    "page_clean_web": rf"""SELECT page_id, regexp_replace(regexp_replace(html,
  '(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<script.*?</script>|<style.*?</style>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>',
  '', 'g'), '</main>$', '') AS body_html FROM pages""",
    "page_drop_paragraphs": f"""SELECT page_id, {ARTICLE} AS body_html FROM pages""",
    "image_best_source": """SELECT event_id, CASE event_type
  WHEN 'view' THEN concat('https://news.example/img/', event_id, '.jpg')
  WHEN 'click' THEN concat('https://cdn.example/', event_id, '.jpg')
  ELSE concat('https://cdn.example/', event_id, CASE WHEN user_id >= 75 THEN '-a.jpg' ELSE '-b.jpg' END)
  END AS source FROM events""",
    "url_normalize": """SELECT event_id, CASE event_id % 11
  WHEN 1 THEN concat('https://x.example/', event_id)
  WHEN 2 THEN concat('https://X.example/', event_id)
  WHEN 3 THEN concat('https://cdn.example/', event_id)
  WHEN 4 THEN concat(' http://x.example/', event_id)
  WHEN 5 THEN concat(' mailto:u', user_id, '@x.example')
  ELSE CASE event_type
  WHEN 'view' THEN concat('https://news.example/a/', event_id, '?q=', user_id)
  WHEN 'click' THEN concat('https://cdn.example/', event_id)
  WHEN 'signup' THEN concat('https://news.example/news/x/', event_id, '#f', user_id)
  WHEN 'purchase' THEN concat('mailto:u', user_id, '@news.example')
  ELSE concat('#', event_id) END END AS url FROM events""",
    "url_keys": f"""WITH s AS (SELECT page_id, url, {SLUG} AS slug FROM pages),
k AS (SELECT page_id, unnest([url, rtrim(url, '/'), concat('/news/', slug),
    concat('https://news.example/news/', slug), concat('https://news.example/news/', slug, '/'),
    concat('https://www.news.example/news/', slug),
    concat('https://www.news.example/news/', slug, '/')]) AS key, unnest(range(7)) AS i FROM s),
d AS (SELECT page_id, key, min(i) AS i FROM k GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS pos, key FROM d""",
    "href_keys": """WITH t AS (SELECT event_id, concat('/news/', user_id % (SELECT count(*) FROM pages)) AS path,
  event_type FROM events WHERE event_type <> 'error'),
f AS (SELECT event_id, path, CASE event_type WHEN 'view' THEN concat('https://news.example', path)
  WHEN 'click' THEN concat('https://news.example', path, '/')
  WHEN 'signup' THEN concat('https://www.news.example', path, '?x=1')
  ELSE concat('https://news.example', path, '/') END AS url FROM t),
k AS (SELECT event_id, unnest([url, rtrim(url, '/'), path, concat('https://news.example', path),
  concat('https://news.example', path, '/'), concat('https://www.news.example', path),
  concat('https://www.news.example', path, '/')]) AS key, unnest(range(7)) AS i FROM f),
d AS (SELECT event_id, key, min(i) AS i FROM k GROUP BY 1, 2)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS BIGINT) AS pos, key FROM d""",
    "url_paths": f"""SELECT page_id, {SLUG} AS slug, {_file(SLUG)} AS chapter_file,
  substr({_file(SLUG)}, 10) AS from_chapter, concat('../../', {_file(SLUG)}) AS from_deeper,
  {_file(SLUG)} AS from_root FROM pages""",
    "text_labels": r"""SELECT doc_id,
  md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'))
    AS escaped_md5,
  CASE WHEN n_chars = 1 THEN 'artykuł' WHEN n_chars % 10 IN (2, 3, 4) AND n_chars % 100 NOT IN (12, 13, 14)
    THEN 'artykuły' ELSE 'artykułów' END AS count_label,
  concat('author-', coalesce(nullif(substr(regexp_replace(trim(regexp_replace(
    lower(strip_accents(text)), '[^a-z0-9_\s\-]', '', 'g'), e' \t\n\r'), '[\s_]+', '-', 'g'), 1, 80), ''),
    'nieznany')) AS anchor FROM documents""",
    "link_index": f"""WITH {FEED}, a AS (SELECT *, {SLUG} AS slug, {_file("title")} AS chapter_file FROM feed),
k AS (SELECT unnest(list_distinct([url, rtrim(url, '/'), concat('/news/', slug)])) AS key,
  chapter_file, published, event_id FROM a)
SELECT key, chapter_file FROM (SELECT *, row_number() OVER (
  PARTITION BY key ORDER BY published, event_id DESC) AS rn FROM k) WHERE rn = 1""",
    "link_rewrite": f"""WITH l AS ({_fill(D.LINKS)}), a AS (
SELECT source_id, event_id, concat('<a href="', CASE WHEN t.tid IS NULL OR href LIKE '%other.example%' THEN href
  ELSE concat(target_id, '.xhtml', CASE WHEN href LIKE '%#%' THEN regexp_extract(href, '#.*$') ELSE '' END)
  END, '">x</a>') AS a FROM l LEFT JOIN {_LINK_TARGET} t ON l.target_id = t.tid),
b AS (SELECT source_id, string_agg(a, '' ORDER BY event_id) AS a FROM a GROUP BY 1)
SELECT page_id, concat({ARTICLE}, a) AS body_html FROM pages JOIN b ON page_id = source_id""",
    "group_by_category": f"""WITH {FEED} SELECT event_id, category,
  dense_rank() OVER (ORDER BY {RANK}, category) AS section_pos,
  row_number() OVER (PARTITION BY category ORDER BY published, event_id) AS chapter_pos,
  row_number() OVER (ORDER BY {RANK}, category, published, event_id) AS chapter_no FROM feed""",
    "author_index": f"""WITH {NAMED}
SELECT dense_rank() OVER (ORDER BY author_hint) AS author_pos, author_hint AS author,
  concat('author-', replace(author_hint, ' ', '-')) AS anchor,
  row_number() OVER (PARTITION BY author_hint ORDER BY published, section_pos, chapter_pos) AS pos,
  h1 AS title, chapter_file AS href, {_label("published")} AS date_label FROM chapters""",
    "asset_manifest": """WITH a AS (SELECT concat('https://news.example/news/', page_id) AS url0, url, page_id,
  unnest([concat('https://cdn.example/', page_id, '-800.jpg'),
          concat('https://news.example/i/', page_id, '.png')]) AS asset_url,
  unnest([0, 1]) AS idx FROM pages)
SELECT url, CAST(idx AS BIGINT) AS idx, asset_url, sha256(asset_url) AS asset_key,
  concat('images/', substr(regexp_replace(coalesce(nullif(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), ''), 'article'),
         '[^\\p{L}\\p{N}_\\-]', '_', 'g'), 1, 80), '_', substr(sha256(url), 1, 16), '_', idx, '.jpg') AS asset_path,
  idx = 1 AS cached FROM a""",
    "asset_rewrite": f"""WITH c AS ({_fill(D.CLEAN_BODIES)}), s AS (
SELECT c.page_id, body_html, concat(substr(regexp_replace({SLUG}, '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g'), 1, 80),
  '_', substr(sha256(url), 1, 16)) AS stem FROM c JOIN pages p ON c.page_id = p.page_id)
SELECT page_id, CASE WHEN page_id BETWEEN 1 AND 52 AND page_id % 10 <> 9 THEN replace(replace(body_html,
  concat('src="https://news.example/i/', page_id, '.png"'),
  concat('src="../images/', stem, '_1.jpg"')),
  concat('src="https://cdn.example/', page_id, '-800.jpg"'),
  concat('src="../images/', stem, '_0.jpg"')) ELSE body_html END AS body_html FROM s""",
    "issue_summary": f"""WITH {WINDOW}, s AS (SELECT min(published) AS a, max(published) AS b,
  count(*) FILTER (url LIKE 'https:%') AS n FROM win)
SELECT concat('News — ', {_label("a")}, ' – ', {_label("b")}) AS title,
  concat({_label("a")}, ' – ', {_label("b")}) AS period,
  concat('news_', strftime({_local("a")}, '%Y-%m-%d'), '_', strftime({_local("b")}, '%Y-%m-%d')) AS issue_name,
  {_label(NOW)} AS generated, n AS article_count,
  CASE WHEN n = 1 THEN 'artykuł' WHEN n % 10 IN (2, 3, 4) AND n % 100 NOT IN (12, 13, 14)
    THEN 'artykuły' ELSE 'artykułów' END AS count_label FROM s""",
    "chapter_documents": f"""WITH {NAMED}, e AS (SELECT *, replace(replace(replace(replace(
    h1, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS heading,
  CASE WHEN category = 'Kraj' THEN concat('  <p class="excerpt">&quot;', replace(slug, '&', '&amp;'),
    '&quot;</p>', chr(10)) ELSE '' END AS lead FROM chapters)
SELECT chapter_file AS path, category, concat('<!DOCTYPE html>', chr(10),
  '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="pl" xml:lang="pl">',
  chr(10), '<head>', chr(10), '  <meta charset="utf-8"/>', chr(10), '  <title>', heading, '</title>', chr(10),
  '  <link rel="stylesheet" type="text/css" href="../style/nav.css"/>', chr(10), chr(10), '</head>', chr(10),
  '<body>', chr(10), '  <h1>', heading, '</h1>', chr(10), '  <p class="author"><a href="../authors.xhtml#author-',
  replace(author_hint, ' ', '-'), '">', author_hint, '</a></p>', chr(10), lead, '  <div class="article-body">',
  {ARTICLE}, '</div>', chr(10), '</body>', chr(10), '</html>') AS content FROM e""",
    "listing_refs": f"""SELECT event_id // 20 AS list_id, event_id % 20 AS pos,
  concat(event_type, event_id) AS title, concat('https://news.example/news/', event_id) AS url,
  {_label(NOW)} AS date_label,
  CASE event_type WHEN 'signup' THEN 'Inne' ELSE event_type END AS category,
  CASE user_id % 3 WHEN 0 THEN concat('user ', user_id) WHEN 1 THEN concat('av ', user_id) END AS author_hint
FROM events WHERE event_type <> 'error' AND event_id % 20 < 15""",
    "feed_read_rejects": f"""WITH {FEED}, p AS (
  SELECT CAST(event_id // 18 + 1 AS BIGINT) AS page, count(*) AS n_members FROM feed GROUP BY 1)
SELECT page, n_members, NULL AS reject_reason, NULL AS record FROM p
UNION ALL SELECT NULL, NULL, 'malformed_page', {D.CUT_LINE} FROM p WHERE page % 25 = 3""",
    "ingest_first_wins": f"""WITH {FEED}, recent AS (
  SELECT *, date_trunc('second', published) AS second FROM feed WHERE date_trunc('second', published) >= {CUTOFF})
SELECT url, title, {_stamp("second")} AS published, CAST(event_id // 18 + 1 AS BIGINT) AS page_no,
  CAST(event_id % 18 AS BIGINT) AS pos
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id) AS rn FROM recent) WHERE rn = 1""",
    "ingest_late_rows": f"""WITH {FEED}
SELECT title, CAST(0 AS BIGINT) AS n_unaccounted FROM feed WHERE date_trunc('second', published) < {CUTOFF}
UNION ALL SELECT NULL, 0""",
    "cache_bucket_upsert": f"""WITH {FEED},
new AS (SELECT slug, arg_max(title, published) AS html, max(published) AS fetched_at
        FROM (SELECT *, {SLUG} AS slug FROM feed) WHERE slug NOT LIKE '%7%' GROUP BY slug),
old AS (SELECT slug, arg_max(html, page_id) AS html, max(page_id) AS page_id FROM (SELECT *, {SLUG} AS slug FROM pages) GROUP BY slug)
SELECT slug, html, {_stamp("fetched_at")} AS fetched_at FROM new
UNION ALL SELECT slug, html, {_stamp("TIMESTAMP '2023-12-31' + page_id * INTERVAL 1 SECOND")} FROM old
WHERE slug NOT IN (SELECT slug FROM new)""",
    "page_join_laid_out": f"""WITH {FEED}, k AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)
SELECT event_id, k.page_id, md5(html) AS html_md5
FROM feed JOIN k ON feed.url = k.url JOIN pages p ON p.page_id = k.page_id AND p.url = k.url""",
    "ingest_stream": f"""SELECT DISTINCT concat('https://news.example/news/',
  event_id % (SELECT count(*) FROM pages)) AS url FROM events WHERE ts >= {CUTOFF}""",
}


def _run_tables() -> str:
    """The tables of a run over pages that were fetched; authors are the pages' hosts."""
    named = NAMED.replace("html FROM pages)", "html FROM pages WHERE page_id % 17 <> 0 AND page_id % 19 <> 0)")
    anchor = "concat('author-', substr(regexp_replace(regexp_replace(lower(host), '[^a-z0-9_\\s\\-]', '', 'g'), '[\\s_]+', '-', 'g'), 1, 80))"
    escaped = "replace(replace(replace(replace(h1, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    content = f"""concat('<!DOCTYPE html>', chr(10),
  '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="pl" xml:lang="pl">',
  chr(10), '<head>', chr(10), '  <meta charset="utf-8"/>', chr(10), '  <title>', {escaped}, '</title>', chr(10),
  '  <link rel="stylesheet" type="text/css" href="../style/nav.css"/>', chr(10), chr(10), '</head>', chr(10),
  '<body>', chr(10), '  <h1>', {escaped}, '</h1>', chr(10), '  <p class="author"><a href="../authors.xhtml#',
  {anchor}, '">', host, '</a></p>', chr(10), '  <div class="article-body">',
  {ARTICLE}, '</div>', chr(10), '</body>', chr(10), '</html>')"""
    parts = {
        "toc": ORACLE["issue_toc"].partition("SELECT section_pos")[2],
        "author_index": f"""dense_rank() OVER (ORDER BY lower(host), host) AS author_pos, host AS author, {anchor} AS anchor,
  row_number() OVER (PARTITION BY host ORDER BY published, section_pos, chapter_pos) AS pos,
  h1 AS title, chapter_file AS href, {_label("published")} AS date_label FROM hosted""",
        "documents": f"chapter_file AS path, category, {content} AS content FROM hosted",
        "summary": "* FROM summary",
        "rejects": "w.url, CASE WHEN p.page_id % 19 = 0 THEN 'network' ELSE 'http_404' END AS reject_reason FROM win w JOIN pages p ON w.url = p.url WHERE p.page_id % 17 = 0 OR p.page_id % 19 = 0",
    }
    parts["toc"] = "section_pos" + parts["toc"]
    summary = ORACLE["issue_summary"].partition("SELECT concat")
    figures = "s AS (SELECT min(published) AS a, max(published) AS b, (SELECT count(*) FROM chapters) AS n FROM win)"
    ctes = f"{named}, hosted AS (SELECT *, {HOST} AS host FROM chapters), {figures}, summary AS (SELECT concat{summary[2]})"
    digests = []
    for name, text in parts.items():
        shown = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in D.RUN_TABLES[name])
        digests.append(f"SELECT '{name}' AS table_name, md5(concat_ws('|', {shown})) AS row_md5 FROM (SELECT {text})")
    return f"WITH {ctes} " + " UNION ALL ".join(digests)


ORACLE["issue_run_tables"] = _run_tables()
# A whole run has the same contents.
ORACLE["issue_run"] = ORACLE["issue_toc"]
