"""URL expressions (Column -> Column); base addresses are plan-time strings."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, functions as F

from broadsheet.functions.text import let
from broadsheet.site import DEFAULT_SLUG, Site

CHAPTER_FOLDER = "chapters"
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_AUTHORITY = rf"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = rf"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def rstrip_slash(col: Column) -> Column:
    return F.regexp_replace(col, "/+$", "")


def url_host(url: Column) -> Column:
    """Network location, '' when there is none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def url_path(url: Column) -> Column:
    """Path without query, fragment and the last segment's parameters."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), ";[^/]*$", "")


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)#(.*)$", 1)


def _resolve_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments of an absolute path."""
    empty = F.array().cast("array<string>")

    def step(done: Column, seg: Column) -> Column:
        parent = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(seg == "..", parent).when(seg == ".", done).otherwise(
            F.array_append(done, seg)
        )

    def resolve(segs: Column) -> Column:
        end = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
        joined = F.array_join(F.concat(F.aggregate(segs, empty, step), end), "/")
        return F.concat(F.lit("/"), F.regexp_replace(joined, "^/", ""))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(path, "/"), resolve)).otherwise(
        path
    )


def _join(base: str, url: Column) -> Column:
    parts = urlsplit(base)
    folder = parts.path.rsplit("/", 1)[0]

    def absolute_path(path: Column) -> Column:
        # a relative path keeps no empty segments before its last one
        below = F.concat(F.lit(folder + "/"), F.regexp_replace(path, "/{2,}", "/"))
        whole = F.when(path.startswith("/"), path).otherwise(below)
        return F.when(path == "", F.lit(parts.path)).otherwise(let(whole, _resolve_dots))

    def joined(rel: Column) -> Column:
        query = F.regexp_extract(rel, r"(?s)^[^?#]*(\?[^#]+)", 1)
        if parts.query:
            bare = (query == "") & rel.rlike("^(#|$)")
            query = F.when(bare, F.lit("?" + parts.query)).otherwise(query)
        return F.concat(
            F.lit(f"{parts.scheme}://{parts.netloc}"),
            let(F.regexp_extract(rel, r"(?s)^([^?#]*)", 1), absolute_path),
            query,
            F.regexp_extract(rel, r"(?s)^[^#]*(#.+)", 1),
        )

    def absolute_or_joined(rel: Column) -> Column:
        # an authority of its own is kept; empty queries and fragments are not
        bare = F.regexp_replace(F.regexp_replace(rel, r"#$", ""), r"\?(#|$)", "$1")
        return F.when(rel.startswith("//"), F.concat(F.lit(f"{parts.scheme}:"), bare)).otherwise(joined(rel))

    def resolved(stripped: Column) -> Column:
        other = stripped.rlike(f"^(?!(?i:{parts.scheme}):){_SCHEME[1:]}")
        rest = F.regexp_replace(stripped, f"(?i)^{parts.scheme}:", "")
        return F.when(other, url).otherwise(let(rest, absolute_or_joined))

    return let(F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""), resolved)


def normalize_url(url: Column, base: str) -> Column:
    """Absolute form of ``url``; data, script and fragment addresses stay as they are."""
    scheme = urlsplit(base).scheme
    # empty, kept as it is, or of a scheme that is not the base's
    kept = f"^$|^#|^data:|^javascript:|^https?://|^(?!(?i:{scheme}):){_SCHEME[1:]}"

    def absolute(u: Column) -> Column:
        return (
            F.when(u.isNull() | u.rlike(kept), u)
            .when(u.startswith("//"), F.concat(F.lit("https:"), u))
            .otherwise(_join(base, u))
        )

    return let(url, absolute)


def article_slug(url: Column) -> Column:
    """Last path piece; query and fragment stay in it."""
    last = F.regexp_extract(rstrip_slash(url), r"(?s)([^/]*)$", 1)
    return F.coalesce(F.nullif(last, F.lit("")), F.lit(DEFAULT_SLUG))


def safe_slug(slug: Column) -> Column:
    return F.substring(F.regexp_replace(slug, r"[^\p{L}\p{N}_\-]", "_"), 1, 80)


def chapter_file(slug: Column) -> Column:
    return F.concat(F.lit(f"{CHAPTER_FOLDER}/"), safe_slug(slug), F.lit(".xhtml"))


def _path_keys(path: Column, site: Site) -> list[Column]:
    keys = [path]
    for host in site.hosts:
        keys += [F.concat(F.lit(f"https://{host}"), path, F.lit(end)) for end in ("", "/")]
    return keys


def article_path(url: Column, slug: Column, site: Site) -> Column:
    """Canonical path an article is found under; the host is not checked."""
    path = rstrip_slash(url_path(url))
    fallback = F.concat(F.lit(site.article_prefix), slug)
    return F.when(path.startswith(site.article_prefix), path).otherwise(fallback)


def article_url_keys(url: Column, slug: Column, site: Site) -> Column:
    """Every address that may point at an article, in lookup order."""
    return let(
        article_path(url, slug, site),
        lambda path: F.array_distinct(F.array(url, rstrip_slash(url), *_path_keys(path, site))),
    )


def link_target(href: Column, site: Site) -> Column:
    """Absolute address without fragment, and the article path ('' when it points elsewhere)."""

    def split_up(target: Column) -> Column:
        path = rstrip_slash(url_path(target))
        local = url_host(target).isin("", *site.hosts)
        article = F.when(local & path.startswith(site.article_prefix), path).otherwise(F.lit(""))
        return F.struct(target.alias("target"), article.alias("path"))

    return let(defragment(normalize_url(href, site.base)), split_up)


def href_lookup_keys(href: Column, site: Site) -> Column:
    """Addresses under which a link's target may be indexed, in lookup order."""

    def keys(link: Column) -> Column:
        target, path = link["target"], link["path"]
        none = F.array().cast("array<string>")
        absolute = target.rlike(_SCHEME) & (url_host(target) != "")
        full = F.when(absolute, F.array(target, rstrip_slash(target))).otherwise(none)
        found = F.array_distinct(F.concat(full, F.array(*_path_keys(path, site))))
        return F.when(path != "", found).otherwise(none)

    return let(link_target(href, site), keys)


def relative_path(target: Column, folder: Column) -> Column:
    """``target`` as seen from ``folder`` (both plain relative paths)."""

    def parts(col: Column) -> Column:
        return F.filter(F.split(col, "/"), lambda p: ~p.isin("", "."))

    def tail(pair: Column) -> Column:
        here, there = pair["here"], pair["there"]
        same = F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False)))
        first_other = F.array_position(same, False)
        shared = F.when(first_other == 0, F.size(here)).otherwise(first_other - 1).cast("int")
        return F.array_join(
            F.concat(
                F.array_repeat(F.lit(".."), F.size(here) - shared),
                F.slice(there, shared + 1, F.size(there)),
            ),
            "/",
        )

    path = let(F.struct(parts(folder).alias("here"), parts(target).alias("there")), tail)
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("."))

