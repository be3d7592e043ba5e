"""Listing pages as an alternative source of references.

A card is a subtree of its page's tokens, so cards are exploded where the page lies.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import html as H
from broadsheet.functions.text import let, strip
from broadsheet.functions.urls import normalize_url
from broadsheet.operators.pages import with_columns_once
from broadsheet.site import DEFAULT_CATEGORY, RELATIVE_DAY_LABELS, Selector, Site

_CARD = H.matches(Selector("article", "post"))
_TITLE = H.matches(Selector("span", "post__title"))
_AUTHOR = H.matches(Selector(cls="post__author-name"))
_AVATARS = H.matches(Selector(cls="post__author-avatars"))
_INFO = H.matches(Selector(cls="post__info__item"))


def _category(card: Column) -> Column:
    """First info label that is neither a day, a duration nor a date."""
    labels = F.transform(H.subtrees(card, _INFO), lambda span: H.text_of(H.part(card, span)))
    fit = F.filter(
        labels,
        lambda t: (t != "")
        & ~t.isin(*RELATIVE_DAY_LABELS)
        & ~F.lower(t).contains("min")
        & ~F.substring(t, 1, 3).rlike(r"(?U)\d"),
    )
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit(DEFAULT_CATEGORY))


def _avatar_name(card: Column) -> Column:
    images = F.flatten(
        F.transform(
            H.subtrees(card, _AVATARS),
            lambda span: F.filter(H.part(card, span), lambda x: x["n"] == "img"),
        )
    )
    return let(
        images,
        lambda found: F.when(
            F.size(found) > 0, strip(H.attribute(F.element_at(found, 1)["t"], "alt"))
        ),
    )


def _card_fields(site: Site):
    def fields(card: Column) -> Column:
        def is_link(x: Column) -> Column:
            href = H.attribute(x["t"], "href")
            return (
                (x["k"] == H.OPEN)
                & (x["n"] == "a")
                & F.coalesce(href.startswith(site.article_prefix), F.lit(False))
            )

        href = H.first_attribute(card, is_link, "href")
        author = H.text_of(H.first_subtree(card, _AUTHOR))

        def unless_empty(value: Column) -> Column:
            # bound first: what nullif is given runs twice
            return let(value, lambda text: F.nullif(text, F.lit("")))

        return F.struct(
            H.text_of(H.first_subtree(card, _TITLE)).alias("title"),
            normalize_url(href, site.base).alias("url"),
            _category(card).alias("category"),
            F.coalesce(unless_empty(author), unless_empty(_avatar_name(card))).alias("author_hint"),
        )

    return fields


@lru_cache
def _card_columns(site: Site, limit: int | None) -> tuple[Column, Column]:
    def cards(toks: Column) -> Column:
        spans = H.subtrees(toks, _CARD)
        if limit is not None:
            # cards behind the limit are not cut out
            spans = F.slice(spans, 1, max(limit, 0))
        return F.transform(spans, lambda span: H.part(toks, span))

    return let(H.items(F.col("html")), cards), let(F.col("_card"), _card_fields(site))


def listing_refs(
    pages: DataFrame,
    now: datetime,
    limit: int | None = None,
    site: Site = Site(),
    key: str = "list_id",
) -> DataFrame:
    """References of the cards of every listing page; ``limit`` counts cards of one page."""
    cards, record = _card_columns(site, limit)
    rows = pages.select(key, F.posexplode(cards).alias("pos", "_card"))
    out = with_columns_once(rows, record).drop("_card")
    return out.filter(F.col("title").isNotNull() & F.col("url").isNotNull()).select(
        key, "pos", "title", "url", F.lit(now).alias("published"), "category", "author_hint"
    )
