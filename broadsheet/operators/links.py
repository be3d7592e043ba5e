"""Links between articles of an issue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.functions import html as H
from broadsheet.functions.text import let
from broadsheet.functions.urls import (
    CHAPTER_FOLDER,
    article_path,
    fragment,
    link_target,
    relative_path,
    rstrip_slash,
)
from broadsheet.operators.skew import salted_join
from broadsheet.site import Site


def _compact_keys(url: Column, path: Column, site: Site) -> Column:
    """Lookup keys of an address, without the four host forms its path stands for.

    Article and link take the same forms away, so a path matches whatever host form was
    written, and only unusual addresses are left to match exactly.
    """

    def keys(pair: Column) -> Column:
        u, p = pair["u"], pair["p"]
        usual = F.array(
            *[F.concat(F.lit(f"https://{h}"), p, F.lit(e)) for h in site.hosts for e in ("", "/")]
        )
        exact = F.filter(
            F.array(u, rstrip_slash(u)), lambda k: (k != "") & ~F.array_contains(usual, k)
        )
        return F.array_distinct(F.array_append(exact, p))

    return let(F.struct(url.alias("u"), path.alias("p")), keys)


def link_index(
    articles: DataFrame, order: Sequence[str], site: Site = Site()
) -> DataFrame:
    """``(key, chapter_file)``: where each address leads; the last article of a key wins."""
    path = article_path(F.col("url"), F.col("slug"), site)
    keys = articles.select(
        F.explode(_compact_keys(F.col("url"), path, site)).alias("key"),
        "chapter_file",
        F.struct(*order).alias("_order"),
    )
    return keys.groupBy("key").agg(F.max_by("chapter_file", "_order").alias("chapter_file"))


@lru_cache
def _hrefs() -> Column:
    """Distinct links of a body that may point at an article."""

    def is_link(x: Column) -> Column:
        return (x["k"] == H.OPEN) & (x["n"] == "a")

    tags = F.filter(H.items(F.col("body_html")), is_link)
    hrefs = F.transform(tags, lambda x: H.attribute(x["t"], "href"))
    return F.filter(F.array_distinct(hrefs), lambda h: ~h.rlike("^$|^#|^mailto:|^tel:"))


@lru_cache
def _lookups(site: Site) -> Column:
    """Keys of ``href``, null when it points elsewhere."""

    def keys(link: Column) -> Column:
        absolute = link["target"].rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")
        address = F.when(absolute, link["target"]).otherwise("")
        return F.when(link["path"] != "", _compact_keys(address, link["path"], site))

    return let(link_target(F.col("href"), site), keys)


def article_links(bodies: DataFrame, site: Site = Site()) -> DataFrame:
    """Lookup keys ``(url, href, key_pos, key)`` of the distinct links of each body."""
    return (
        bodies.select("url", F.explode(_hrefs()).alias("href"))
        .select("url", "href", F.posexplode(_lookups(site)))
        .withColumnsRenamed({"pos": "key_pos", "col": "key"})
    )


def resolve_links(
    links: DataFrame,
    index: DataFrame,
    heavy: DataFrame | None = None,
    folder: str = CHAPTER_FOLDER,
) -> DataFrame:
    """``(url, new)``: per body the map from link to chapter path as seen from ``folder``.

    A chapter many pages link to is a hot key of the join; ``heavy`` keys are salted.
    The group of one body is bounded by the body it came from.
    """
    hits = salted_join(links, index, "key", heavy)
    anchor = fragment(F.col("href"))
    hits = hits.select(
        "url",
        "href",
        "key_pos",
        F.concat(
            relative_path(F.col("chapter_file"), F.lit(folder)),
            F.when(anchor != "", F.concat(F.lit("#"), anchor)).otherwise(F.lit("")),
        ).alias("path"),
    )

    def first_key_only(found: Column) -> Column:
        def is_first(x: Column, i: Column) -> Column:
            return (i == 0) | (F.try_element_at(found, i)["href"] != x["href"])

        return F.map_from_entries(
            F.transform(F.filter(found, is_first), lambda x: F.struct(x["href"], x["path"]))
        )

    found = F.array_sort(F.collect_list(F.struct("href", "key_pos", "path")))
    return hits.groupBy("url").agg(found.alias("_found")).select(
        "url", let(F.col("_found"), first_key_only).alias("new")
    )


@lru_cache
def replace_attribute(body: str, tag: str, name: str, new: str) -> Column:
    """Body column with attribute values of one tag looked up in a map column; others stay."""

    def edited(x: Column) -> Column:
        value = F.when(x["n"] == tag, F.try_element_at(F.col(new), H.attribute(x["t"], name)))
        return let(
            value,
            lambda v: F.when(v.isNull(), x["t"]).otherwise(
                H.edit_tag(x["t"], x["n"], x["k"], None, (name, v))
            ),
        )

    whole = F.array_join(F.transform(H.items(F.col(body)), edited), "")
    return F.when(F.col(new).isNull(), F.col(body)).otherwise(whole)


def rewrite_links(
    cleaned: DataFrame,
    index: DataFrame,
    site: Site = Site(),
    heavy: DataFrame | None = None,
    folder: str = CHAPTER_FOLDER,
) -> DataFrame:
    """Bodies whose links to indexed articles are chapter paths as seen from ``folder``."""
    resolved = resolve_links(article_links(cleaned, site), index, heavy, folder)
    joined = cleaned.join(resolved, "url", "left")
    body = replace_attribute("body_html", "a", "href", "new")
    return joined.withColumn("body_html", body).drop("new")
