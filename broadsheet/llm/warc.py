"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response gives one metadata record (title, link and text counts, HTTP status, and the source's
headers and digest as warc-fields) and one conversion record (its text). Both name the response in
``WARC-Refers-To`` and keep its target, date, payload digest and HTTP headers. One narrow pass of
column expressions; ``serialize`` gives the records' bytes.

Defined cases: a null or empty payload gives records with empty text; a null header, target, date
or record id stays null and its line is left out of the serialized record; without a source digest
the payload's own is taken; records of other types are skipped; an element that is never closed
reaches to the end of the page; repeated responses each give their records; an empty table gives
none; extra columns are ignored. Pages are read by the charset of their header, and bytes that are
no character become U+FFFD. Character references of text and title are decoded as HTML 5 reads them,
in one pass, and a no-break space that is written as one becomes a blank.
"""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions.text import _code_point, _literal_map, let

#: Date of records whose source table has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Fixed patterns, in the order they are applied.
HIDDEN = ("script", "style", "noscript", "template")
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header"
    r"|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/][^>]*)?>"
)
TAG = r"</?[A-Za-z!?][^>]*>"
#: The references of the SQL; the query looks them up first and knows all others too.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: A reference to U+00A0 by name or number.
BLANK = r"&(?:nbsp;?|#0*160(?![0-9]);?|#[xX]0*[aA]0(?![0-9a-fA-F]);?)"
#: Names that end without a semicolon too, longer ones first: the rest of a word may follow.
OPEN_NAME = "^&(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
REFERENCE = r"&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[a-zA-Z][a-zA-Z0-9]*+;?|[^&]++|&"
#: Low numbers, of which some stand for another character than their own or for none.
LOW_NUMBER = {str(n): unescape(f"&#{n};") for n in range(0xA0)}
TITLE = r"(?is)<title[^>]*>(.*?)</title"
CHARSET = r"(?im)^content-type:[^\r\n]*charset\s*=\s*[\"']?([^\s;\"']+)"
#: Names under which Windows-1252 is sent, and its characters where Latin-1 has controls.
LATIN = ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii", "windows-1252", "cp1252")
WINDOWS_1252 = tuple(
    "".join(pair[k] for pair in ((chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)) if pair[1]) for k in (0, 1)
)
LINK = r"(?i)<a\s[^>]*href"


def hidden(name: str) -> str:
    return rf"(?is)<{name}(?:\s[^>]*)?>.*?(?:</{name}\s*>|\z)"


def references(text: Column) -> Column:
    """Character references decoded as ``html.unescape`` does."""

    def named(tok: Column) -> Column:
        start = F.regexp_extract(tok, OPEN_NAME, 1)
        open_one = F.concat(F.try_element_at(_literal_map(html5), start), F.substr(tok, F.length(start) + 2))
        return F.coalesce(F.try_element_at(_literal_map(html5), F.substr(tok, F.lit(2))), F.when(start != "", open_one), tok)

    def numbered(digits: Column, base: int) -> Column:
        short = F.regexp_replace(digits, "^0+(?=.)", "")

        def char(n: Column) -> Column:
            nothing = n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
            return (
                F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd")
                .when(n < 0xA0, F.try_element_at(_literal_map(LOW_NUMBER), n.cast("string")))
                .when(nothing, "")
                .otherwise(_code_point(n))
            )

        return let(F.when(F.length(short) <= 7, F.conv(short, base, 10).cast("bigint")), char)

    def one(tok: Column) -> Column:
        common = F.when(~tok.startswith("&"), tok)
        for entity, character in ENTITIES:
            common = common.when(tok == entity, F.lit(character))
        return (
            common.when(tok.rlike("^&#[0-9]"), numbered(F.regexp_extract(tok, "([0-9]+)", 1), 10))
            .when(tok.rlike("^&#[xX]"), numbered(F.regexp_extract(tok, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
            .otherwise(named(tok))
        )

    def decoded(value: Column) -> Column:
        joined = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0)), one), "")
        return F.when(value.contains("&"), joined).otherwise(value)

    return let(text, decoded)


def plain_text(html: Column) -> Column:
    """Text of a page: comments and hidden elements gone, block tags as line ends, tags dropped."""
    text = F.regexp_replace(html, COMMENT, "")
    for name in HIDDEN:
        text = F.regexp_replace(text, hidden(name), "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), TAG, "")
    text = references(F.regexp_replace(text, BLANK, " "))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"\A\n+|\n+\z", ""))


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid from the digest of what identifies the record."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest_of(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def decoded_page(payload: Column, http_header: Column) -> Column:
    """A page's characters by the charset of its header: Latin-1 as browsers read it, or UTF-8.

    What cannot be UTF-8 becomes U+FFFD; other charsets are read as UTF-8 too, so their ASCII stays.
    """
    charset = F.lower(F.regexp_extract(http_header, CHARSET, 1))
    latin = F.translate(F.decode(payload, "ISO-8859-1"), *WINDOWS_1252)
    return F.when(charset.isin(*LATIN), latin).otherwise(F.make_valid_utf8(payload.cast("string")))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Pages (``page_id``, ``url``, ``html``) as response records."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    header = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string")
    )
    return pages.select(
        F.lit("response").alias("record_type"),
        record_id("response", F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(NO_DATE).alias("warc_date"),
        header.alias("http_header"),
        payload.alias("payload"),
        F.lit(None).cast("string").alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two linked records for every response among ``records``."""
    source = records.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        "http_header",
        F.coalesce("payload", F.lit("").cast("binary")).alias("payload"),
        F.coalesce("payload_digest", digest_of(F.coalesce("payload", F.lit("").cast("binary")))).alias("payload_digest"),
    )
    html = decoded_page(F.col("payload"), F.col("http_header"))
    read = source.select(
        "*",
        plain_text(html).alias("text"),
        F.trim(F.regexp_replace(references(F.regexp_replace(F.regexp_extract(html, TITLE, 1), BLANK, " ")), r"\s+", " ")).alias("title"),
        F.regexp_count(html, F.lit(LINK)).alias("n_links"),
        F.coalesce(F.regexp_extract("http_header", r"^HTTP/\S+ (\d+)", 1), F.lit("")).alias("status"),
    )
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), F.col("title")),
        F.concat(F.lit("http-status: "), F.col("status")),
        F.concat(F.lit("links: "), F.col("n_links").cast("string")),
        F.concat(F.lit("text-length: "), F.length("text").cast("string")),
        F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")),
        # Folded, so that the source's header lines stay one field.
        F.concat(F.lit("source-http-header: "), F.replace(F.col("http_header"), F.lit("\r\n"), F.lit("\r\n "))),
        F.lit(""),
    )

    def made(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"),
            record_id(kind, F.col("refers_to")).alias("record_id"),
            F.lit(content_type).alias("content_type"),
            block.cast("binary").alias("block"),
        )

    both = read.select(
        "refers_to", "target_uri", "warc_date", "http_header", "payload_digest",
        F.explode(F.array(made("metadata", "application/warc-fields", fields), made("conversion", "text/plain; charset=utf-8", F.col("text")))).alias("r"),
    )
    return both.select(
        "r.record_type", "r.record_id", "refers_to", "target_uri", "warc_date", "r.content_type", "http_header", "payload_digest",
        digest_of(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("bigint").alias("content_length"),
        "r.block",
    )


def serialize(records: DataFrame) -> DataFrame:
    """``record``: the bytes of every derived record, as WARC/1.1."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    end = F.lit("\r\n\r\n").cast("binary")
    return records.select("record_id", F.concat(head.cast("binary"), end, F.col("block"), end).alias("record"))


def digests(records: DataFrame) -> DataFrame:
    """All but the blocks."""
    return records.drop("block")


def _sql_references(text: str) -> str:
    for entity, character in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, entity, character.replace("'", "''"))
    return text


def _sql_text(html: str) -> str:
    text = f"regexp_replace({html}, '{COMMENT}', '', 'g')"
    for name in HIDDEN:
        text = f"regexp_replace({text}, '{hidden(name)}', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '{BLOCK_TAG}', chr(10), 'g'), '{TAG}', '', 'g')"
    text = _sql_references(text)
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '\A\n+|\n+\z', '', 'g'), ' ')"


_UUID = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'"
_CRLF = "chr(13) || chr(10)"
#: DuckDB SQL for the query's rows.
SQL = rf"""
WITH source AS (
  SELECT md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS h, url AS target_uri, coalesce(html, '') AS html,
         'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) AS http_header FROM pages
), filed AS (
  SELECT {_UUID.format('h')} AS refers_to, target_uri, http_header, 'sha256:' || sha256(html) AS payload_digest, {_sql_text('html')} AS text,
         trim(regexp_replace({_sql_references(f"regexp_extract(html, '{TITLE}', 1)")}, '\s+', ' ', 'g'), ' ') AS title, len(regexp_extract_all(html, '{LINK}')) AS n_links FROM source
), made AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || title || {_CRLF} || 'http-status: 200' || {_CRLF} || 'links: ' || n_links || {_CRLF} || 'text-length: ' || length(text) || {_CRLF}
         || 'source-payload-digest: ' || payload_digest || {_CRLF} || 'source-http-header: ' || replace(http_header, {_CRLF}, {_CRLF} || ' ') || {_CRLF} AS block FROM filed
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM filed
)
SELECT record_type, {_UUID.format("md5(record_type || '|' || refers_to)")} AS record_id, refers_to, target_uri, '{NO_DATE}' AS warc_date, content_type, http_header,
       payload_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM made
"""
