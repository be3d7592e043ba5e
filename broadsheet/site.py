"""What is particular to one news site: address, paths, labels and page mark-up."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Category order of an issue and the labels printed in it.
CATEGORY_ORDER = (
    "Kraj",
    "Świat",
    "Sport",
    "Opinie",
    "Biznes",
    "Technologia",
    "Wojsko",
    "Zdrowie",
    "Kultura",
    "Nauka",
    "Moto",
)
DEFAULT_CATEGORY = "Inne"
DEFAULT_AUTHOR = "Nieznany autor"
AUTHOR_INDEX_TITLE = "Indeks autorów"
DEFAULT_SLUG = "article"
DEFAULT_ANCHOR = "nieznany"
COUNT_LABELS = ("artykuł", "artykuły", "artykułów")
RELATIVE_DAY_LABELS = ("Dzisiaj", "Wczoraj")
TIME_ZONE = "Europe/Warsaw"
ITEMS_PER_PAGE = 18
EXCLUDED_CATEGORY_ID = 51
MAX_ASSET_BYTES = 5 * 1024 * 1024


@dataclass(frozen=True)
class Site:
    """Address of a site: ``host`` without www, and the path its articles live under."""

    host: str = "news.example"
    article_prefix: str = "/news/"
    name: str = "News"

    @property
    def base(self) -> str:
        return f"https://{self.host}"

    @property
    def hosts(self) -> tuple[str, str]:
        return (self.host, f"www.{self.host}")


@dataclass(frozen=True)
class Selector:
    """An element by tag name and/or one class token; ``cls_like`` is a class regex."""

    name: str | None = None
    cls: str | None = None
    cls_like: str | None = None


@dataclass(frozen=True)
class ExtractProfile:
    """Where title, author, excerpt and body are found in a page."""

    title: Selector = Selector("h1")
    author: Selector | None = Selector(cls="post__author-name")
    author_meta: str | None = "author"
    author_from_hint: bool = True
    author_from_host: bool = False
    body: Selector = Selector("div", "prose")
    excerpt: Selector | None = Selector("p", "post-excerpt")
    excerpt_property: str | None = "og:description"
    need_excerpt: bool = True
    # Text nodes are joined with one space; "" glues them together.
    text_separator: str = " "


@dataclass(frozen=True)
class CleanProfile:
    """Which subtrees the cleaner drops and how it treats what is left."""

    drop: tuple[Selector, ...] = (Selector("p", "post-excerpt"), Selector(cls="posts-grid"))
    # Class tokens that begin a word with ad-slot / oembed.
    ads: tuple[Selector, ...] = (Selector(cls_like=r"(?i)(^|[\s-])ad-slot"), Selector("iframe"))
    embed_class: str = r"(^|[\s-])oembed"
    embed_attr: str = "data-oembed"
    empty_embed: Selector = Selector(cls="embed")
    blank_paragraph: str = r"(?i)^\s*reklama\s*$"
    keep_image_paragraphs: bool = False
    strip_attrs: str = r"data-v-[^\s=]*"
    image_strip_attrs: tuple[str, ...] = (
        "srcset",
        "data-src",
        "data-nuxt-img",
        "loading",
        "decoding",
        "fetchpriority",
        "sizes",
        "onerror",
        "height",
        "width",
        "class",
    )


NEWS_EXTRACT = ExtractProfile()
NEWS_CLEAN = CleanProfile()

# Exact legacy behaviour: glued text nodes, no author hint, substring class matches.
LEGACY_EXTRACT = replace(NEWS_EXTRACT, author_from_hint=False, text_separator="")
LEGACY_CLEAN = replace(
    NEWS_CLEAN,
    ads=(Selector(cls_like="(?i)ad-slot"), Selector("iframe")),
    embed_class="oembed",
)

# Plain web pages: article element, author is the host, no excerpt wanted.
WEB_EXTRACT = ExtractProfile(
    author=None,
    author_from_hint=False,
    author_from_host=True,
    body=Selector("article"),
    excerpt=None,
    need_excerpt=False,
)
WEB_CLEAN = replace(
    NEWS_CLEAN,
    drop=(Selector("nav"), Selector("footer"), Selector(cls="ad")),
)
