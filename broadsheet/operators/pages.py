"""Jobs over a table of pages: tokens, extraction with rejects, cleaning.

Extraction and cleaning are narrow: one pass over the scan, no exchange.
"""

from __future__ import annotations

import re

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import html as H
from broadsheet.functions.text import blank_to_null, decode_entities, let, strip
from broadsheet.functions.urls import article_slug, normalize_url, url_host
from broadsheet.site import NEWS_CLEAN, NEWS_EXTRACT, CleanProfile, ExtractProfile, Selector, Site

_PARAGRAPH = H.matches(Selector("p"))


def with_columns_once(df: DataFrame, record: Column) -> DataFrame:
    """Add the fields of a struct expression, computed once per row.

    A generator keeps the optimizer from copying the expression into every filter
    and projection above it.
    """
    return df.select("*", F.inline_outer(F.array(record)))


def tokenize(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Token relation ``(key, pos, kind, name, tok)``; joined by ``pos`` it is the page again."""
    rows = pages.select(key, F.posexplode(H.raw_tokens(F.col(html))).alias("pos", "tok"))
    rows = rows.withColumn("name", H.token_name(F.col("tok")))
    kinds = F.array(*[F.lit(k) for k in H.KINDS])
    kind = F.element_at(kinds, H.token_kind(F.col("tok"), F.col("name")) + 1)
    return rows.select(key, "pos", kind.alias("kind"), "name", "tok")


EXTRACTED = ("title", "author", "excerpt", "prose_html")
# In the order in which a page is checked.
_REASONS = {
    "title": "no_title",
    "author": "no_author",
    "prose_html": "no_body",
    "excerpt": "no_excerpt",
}


@lru_cache
def _extract(
    html: str, url: str, hint: str | None, p: ExtractProfile, wanted: tuple[str, ...]
) -> Column:
    """Struct of the wanted parts; kept per profile, since it takes a while to build."""
    sep = p.text_separator
    hint_col = F.col(hint) if hint else F.lit(None).cast("string")

    def meta(tokens: Column, attr: str, value: str) -> Column:
        def named(x: Column) -> Column:
            return (x["n"] == "meta") & (H.attribute(x["t"], attr) == value)

        return strip(H.first_attribute(tokens, named, "content"))

    def fields(tokens: Column) -> Column:
        title = H.text_of(H.first_subtree(tokens, H.matches(p.title)), sep)
        authors = []
        if p.author:
            text = H.text_of(H.first_subtree(tokens, H.matches(p.author)), sep)
            authors.append(F.nullif(text, F.lit("")))
        if p.author_meta:
            authors.append(F.nullif(meta(tokens, "name", p.author_meta), F.lit("")))
        if p.author_from_hint:
            authors.append(blank_to_null(hint_col))
        if p.author_from_host:
            authors.append(F.nullif(url_host(F.col(url)), F.lit("")))

        def with_body(body: Column) -> Column:
            excerpt = F.lit(None).cast("string")
            if p.excerpt_property:
                excerpt = meta(tokens, "property", p.excerpt_property)
            if p.excerpt:
                here = H.first_subtree(body, H.matches(p.excerpt))
                excerpt = let(
                    here,
                    lambda e: F.when(e.isNotNull(), H.text_of(e, sep)).otherwise(excerpt),
                )
            found = {
                "title": title,
                "author": F.coalesce(*authors),
                "excerpt": F.when(body.isNotNull(), excerpt),
                "prose_html": H.html_of(body),
            }
            return F.struct(*[found[name].alias(name) for name in wanted])

        if not {"excerpt", "prose_html"} & set(wanted):
            return with_body(F.lit(None))

        return let(H.first_subtree(tokens, H.matches(p.body)), with_body)

    return let(H.items(F.col(html)), fields)


def extract_pages(
    pages: DataFrame,
    profile: ExtractProfile = NEWS_EXTRACT,
    url: str = "url",
    html: str = "html",
    hint: str | None = None,
    fields: tuple[str, ...] = EXTRACTED,
) -> DataFrame:
    """Title, author, excerpt, body and slug of every page.

    ``reject_reason`` is the first part that is missing, null for a whole article. With
    fewer ``fields`` only those are looked for, and only they can be missing.
    """
    out = with_columns_once(pages, _extract(html, url, hint, profile, fields)).drop(html)
    missing = {
        "title": F.col("title").isNull(),
        "author": F.col("author").isNull(),
        "prose_html": F.col("prose_html").isNull(),
        "excerpt": F.lit(profile.need_excerpt) & (F.coalesce("excerpt", F.lit("")) == ""),
    }
    reason = F.when(F.lit(False), "")
    for name, label in _REASONS.items():
        if name in fields:
            reason = reason.when(missing[name], label)
    return out.withColumn("slug", article_slug(F.col(url))).withColumn("reject_reason", reason)


def split_rejects(extracted: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Whole articles and rejects. With ``strict`` the first reject fails the job."""
    reason = F.col("reject_reason")
    rejects = extracted.filter(reason.isNotNull()).select("url", "reject_reason")
    if strict:
        # kept in the projection of the result, so that it cannot be pruned away
        failure = F.raise_error(F.concat(reason, F.lit(": "), F.col("url"))).cast("string")
        checked = F.when(reason.isNotNull(), failure).otherwise(F.col("url"))
        return extracted.withColumn("url", checked).drop("reject_reason"), rejects
    return extracted.filter(reason.isNull()).drop("reject_reason"), rejects


def best_image_source(src: Column, data_src: Column, srcset: Column, base: str) -> Column:
    """``src`` or ``data-src`` unless inlined, else the widest ``srcset`` entry (first on ties)."""
    entry = r"(https?://\S+?)\s+(\d+)w"

    def widest(texts: Column) -> Column:
        sized = F.transform(
            texts,
            lambda t, i: F.struct(
                F.regexp_extract(t, entry, 2).try_cast("decimal(38,0)").alias("width"),
                (-i).alias("early"),
                F.regexp_extract(t, entry, 1).alias("url"),
            ),
        )
        return F.array_max(sized)["url"]

    def choose(plain: Column) -> Column:
        own = plain.isNotNull() & ~plain.startswith("data:")
        entries = F.regexp_extract_all(srcset, F.lit(entry), F.lit(0))
        return F.when(own, strip(plain)).otherwise(widest(entries))

    plain = F.coalesce(F.nullif(src, F.lit("")), F.nullif(data_src, F.lit("")))
    return normalize_url(let(plain, choose), base)


def _edit_tag(x: Column, p: CleanProfile, base: str) -> Column:
    """A tag without framework attributes and id; links and images get absolute addresses."""
    tok = x["t"]
    extra = rf"{p.strip_attrs}|id(?=[\s=]|$)"
    image_extra = "|".join([extra, *(re.escape(a) + r"(?=[\s=]|$)" for a in p.image_strip_attrs)])

    def edited(drop: str, put: tuple[str, Column] | None) -> Column:
        return H.edit_tag(tok, x["n"], x["k"], drop, put)

    def link(href: Column) -> Column:
        whole = normalize_url(href, base)
        is_new = F.coalesce(whole != href, F.lit(False))
        return F.when(is_new | has_extra, edited(extra, ("href", F.when(is_new, whole)))).otherwise(
            tok
        )

    source = best_image_source(
        H.attribute(tok, "src"), H.attribute(tok, "data-src"), H.attribute(tok, "srcset"), base
    )
    has_extra = tok.rlike(rf"(?is)[\s/](?:{p.strip_attrs}|id\s*=)")
    return (
        F.when(~x["k"].between(H.OPEN, H.VOID), tok)
        .when(x["n"] == "img", edited(image_extra, ("src", source)))
        .when(x["n"] == "a", let(H.attribute(tok, "href"), link))
        .when(has_extra, edited(extra, None))
        .otherwise(tok)
    )


def _unwrap_embed(tokens: Column) -> Column:
    """A block replaced by its first link, or by nothing."""

    def is_link(x: Column) -> Column:
        return (x["k"] == H.OPEN) & (x["n"] == "a") & H.has_value(x["t"], "href")

    def is_end(x: Column) -> Column:
        return (x["k"] == H.CLOSE) & (x["n"] == "a")

    def linked(after: Column) -> Column:
        end = F.get(H.positions(after, is_end), F.lit(0))
        href = H.attribute(F.get(after, F.lit(0))["t"], "href")
        content = F.slice(after, 1, F.coalesce(end, F.size(after)))
        return H.link_items(href, F.coalesce(F.nullif(H.text_of(content), F.lit("")), href))

    def from_link(at: Column) -> Column:
        rest = F.slice(tokens, at + 1, F.size(tokens))
        return F.when(at.isNull(), H.no_items()).otherwise(let(rest, linked))

    return let(F.get(H.positions(tokens, is_link), F.lit(0)), from_link)


def _drop_paragraphs(toks: Column, p: CleanProfile) -> Column:
    """Paragraphs without text, or with nothing but an advertising label.

    An end tag that closes no paragraph counts as an empty one.
    """

    def blank(span: Column) -> Column:
        def test(content: Column) -> Column:
            text = H.text_of(content)
            is_blank = (text == "") | text.rlike(p.blank_paragraph)
            if p.keep_image_paragraphs:
                is_blank = is_blank & ~F.exists(content, lambda x: x["n"] == "img")
            return is_blank

        return let(H.part(toks, span), test)

    def dropped(spans: Column) -> Column:
        return H.splice(toks, F.filter(spans, lambda span: (span["r"] == 0) | blank(span)), None)

    return let(H.paragraphs(toks), dropped)


def clean_stages(p: CleanProfile, base: str) -> list[Callable[[Column], Column]]:
    """The cleaning rules in order.

    The first gives the visible tokens, the second adds the subtrees to drop; from the third on
    tokens go with the number of repaired subtrees.
    """

    def is_embed(x: Column) -> Column:
        classed = (x["c"] != "") & x["c"].rlike(p.embed_class)
        return x["k"].between(H.OPEN, H.VOID) & (classed | H.has_value(x["t"], p.embed_attr))

    def is_content(x: Column) -> Column:
        return ((x["k"] == H.TEXT) & (strip(decode_entities(x["t"])) != "")) | (x["n"] == "img")

    def is_script(x: Column) -> Column:
        # closed ones are single tokens; an open one reaches to the end, as its text would
        return x["k"].between(H.OPEN, H.VOID) & x["n"].isin("script", "style", "noscript")

    def found(toks: Column) -> Column:
        dropped = H.any_of((*p.drop, *p.ads))
        return F.struct(toks.alias("toks"), H.closed_subtrees(toks, dropped, is_embed, is_script).alias("drop"))

    def drops_and_embeds(both: Column) -> Column:
        toks = both["toks"]

        def new(span: Column, embed: Column) -> Column:
            shown = H.drop_subtrees(embed, H.any_of(p.drop))
            return F.when(span["r"] != 2, H.no_items()).otherwise(let(shown, _unwrap_embed))

        spliced = let(toks, lambda ts: H.splice(ts, both["drop"]["spans"], new))
        return F.struct(spliced.alias("toks"), both["drop"]["repaired"].alias("repaired"))

    def visible(toks: Column) -> Column:
        return F.filter(H.inner(toks), lambda x: x["k"] < H.DECL)

    def then(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """A rule on the tokens alone; the number of repairs stays."""

        def run(both: Column) -> Column:
            return F.struct(let(both["toks"], rule).alias("toks"), both["repaired"].alias("repaired"))

        return run

    return [
        visible,
        found,
        drops_and_embeds,
        then(lambda toks: F.transform(toks, lambda x: H.with_token(x, _edit_tag(x, p, base)))),
        then(
            lambda toks: H.splice(
                toks, H.empty_subtrees(toks, H.matches(p.empty_embed), is_content), None
            )
        ),
        then(lambda toks: _drop_paragraphs(toks, p)),
    ]


def _cleaned(both: Column) -> Column:
    toks = both["toks"]
    images = F.transform(
        F.filter(toks, lambda x: (x["n"] == "img") & (x["k"] != H.CLOSE)),
        lambda x: H.attribute(x["t"], "src"),
    )
    return F.struct(
        H.html_of(toks).alias("body_html"),
        F.array_distinct(F.filter(images, lambda s: s != "")).alias("image_urls"),
        both["repaired"].alias("n_repaired"),
    )


def clean_pages(
    articles: DataFrame,
    profile: CleanProfile = NEWS_CLEAN,
    site: Site = Site(),
    prose: str = "prose_html",
    repairs: bool = False,
) -> DataFrame:
    """Cleaned body and image addresses instead of the raw body; other columns stay.

    With ``repairs`` also ``n_repaired``: dropped subtrees that ended without their own end tag.
    """
    tokens, *rules, record = _clean_columns(prose, profile, site.base)
    out = articles.withColumn("_toks", tokens)
    for rule in rules:
        out = out.withColumn("_toks", rule)
    out = with_columns_once(out, record).drop("_toks", prose)
    return out if repairs else out.drop("n_repaired")


@lru_cache
def _clean_columns(prose: str, profile: CleanProfile, base: str) -> list[Column]:
    """Tokens, every rule and the result, each to be projected in turn.

    One projection per rule keeps the expressions shallow for the analyzer. Each binds its
    input once, so collapsing them repeats no work.
    """
    stages = [*clean_stages(profile, base), _cleaned]
    return [H.items(F.col(prose)), *[let(F.col("_toks"), stage) for stage in stages]]
