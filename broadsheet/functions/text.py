"""Scalar text expressions: labels, dates, escapes, anchors (Column -> Column)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from broadsheet.site import (
    CATEGORY_ORDER,
    COUNT_LABELS,
    DEFAULT_ANCHOR,
    DEFAULT_CATEGORY,
    TIME_ZONE,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Catalyst may inline a projected column into a lambda, where it would run once per
    element; a lambda variable cannot be inlined. An aggregate over nothing hands its start
    value to the final lambda without a copy.
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda bound, _: bound, body)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def escape_xml(col: Column) -> Column:
    """Escape ``& < > "``; the apostrophe stays."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def _literal_map(pairs: Mapping[str, str]) -> Column:
    """A constant map as one literal, so that plans stay small."""
    entries = "\x02".join(f"{key}\x01{value}" for key, value in pairs.items())
    return F.str_to_map(F.lit(entries), F.lit("\x02"), F.lit("\x01"))


def one_of(col: Column, values: Sequence[str]) -> Column:
    """``isin`` for many short constants, as one literal."""
    return F.find_in_set(col, F.lit(",".join(values))) > 0


def _code_point(number: Column) -> Column:
    """Character of a code point (``chr`` covers ASCII only)."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entities(col: Column, bare: bool = True) -> Column:
    """Decode HTML character references; ``bare`` also takes those without a semicolon."""
    names = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
    end = ";?" if bare else ";"

    def one(tok: Column) -> Column:
        number = F.regexp_extract(tok, r"^&#0*([0-9]{1,7});?$", 1)
        hexed = F.regexp_extract(tok, r"(?i)^&#x0*([0-9a-f]{1,6});?$", 1)

        def char(value: Column) -> Column:
            known = (value > 0) & (value < 0x110000) & ~value.between(0xD800, 0xDFFF)
            return F.when(known, _code_point(value)).otherwise(tok)

        return (
            F.when(~tok.startswith("&"), tok)
            .when(number != "", char(number.cast("bigint")))
            .when(hexed != "", char(F.conv(hexed, 16, 10).cast("bigint")))
            .otherwise(
                F.coalesce(
                    F.try_element_at(_literal_map(names), F.regexp_replace(tok, "[&;]", "")), tok
                )
            )
        )

    def decoded(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"&#?[0-9a-zA-Z]++{end}|[^&]++|&"), F.lit(0))
        joined = F.array_join(F.transform(pieces, one), "")
        return F.when(text.contains("&"), joined).otherwise(text)

    return let(col, decoded)


def _replace_chars(col: Column, table: Mapping[str, str]) -> Column:
    """Replace single characters: ``translate`` where it can, a map where one becomes many."""
    short = {k: v for k, v in table.items() if len(v) <= 1}
    long = {k: v for k, v in table.items() if len(v) > 1}
    # translate drops characters that have no partner, so those go last
    order = sorted(short, key=lambda k: (short[k] == "", k))
    out = F.translate(col, "".join(order), "".join(short[k] for k in order))
    if not long:
        return out

    def spelled_out(text: Column) -> Column:
        # a plain range test finds the few characters worth a look-up
        pieces = F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]|[\x00-\x7F]++"), F.lit(0))
        parts = F.transform(
            pieces,
            lambda c: F.when(
                c > "\x7f", F.coalesce(F.try_element_at(_literal_map(long), c), c)
            ).otherwise(c),
        )
        return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(parts, "")).otherwise(text)

    return let(out, spelled_out)


@lru_cache
def _accent_table() -> dict[str, str]:
    table = {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if plain:
            table[char] = plain
    return table


def fold_accents(col: Column) -> Column:
    """Compatibility decomposition, then only ASCII is kept."""
    return F.regexp_replace(_replace_chars(col, _accent_table()), r"[^\x00-\x7F]", "")


@lru_cache
def _casefold_table() -> dict[str, str]:
    chars = (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    return {c: c.casefold() for c in chars if c.lower() == c and c.casefold() != c}


def casefold(col: Column) -> Column:
    return _replace_chars(F.lower(col), _casefold_table())


def author_anchor(author: Column) -> Column:
    """ASCII fragment id of an author."""
    plain = F.regexp_replace(F.lower(fold_accents(author)), r"[^a-z0-9_\s\-]", "")
    slug = F.regexp_replace(strip(plain), r"[\s_]+", "-")
    return F.concat(
        F.lit("author-"),
        F.coalesce(F.nullif(F.substring(slug, 1, 80), F.lit("")), F.lit(DEFAULT_ANCHOR)),
    )


def author_name(author: Column) -> Column:
    """Display name of a ``{firstname, lastname}`` struct, null when blank."""
    first = F.coalesce(strip(author["firstname"]), F.lit(""))
    last = F.coalesce(strip(author["lastname"]), F.lit(""))
    return blank_to_null(F.concat_ws(" ", first, last))


def category_label(title: Column) -> Column:
    return F.coalesce(blank_to_null(title), F.lit(DEFAULT_CATEGORY))


def category_rank(category: Column, order: tuple[str, ...] = CATEGORY_ORDER) -> Column:
    """Place in the category list from 0; unknown categories come after it."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(order))).cast("int")


def local_time(ts: Column, tz: str = TIME_ZONE) -> Column:
    """Wall-clock time in ``tz`` of an instant (from the session zone)."""
    return F.convert_timezone(None, F.lit(tz), ts.cast("timestamp_ntz"))


def date_label(ts: Column, tz: str = TIME_ZONE) -> Column:
    return F.date_format(local_time(ts, tz), "dd.MM.yyyy")


def parse_published(text: Column) -> Column:
    """ISO-8601 instant, null when it is none or has no full date; without an offset it is read as UTC."""
    return F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), text.try_cast("timestamp"))


def count_label(n: Column) -> Column:
    one, few, many = (F.lit(label) for label in COUNT_LABELS)
    is_few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(n == 1, one).when(is_few, few).otherwise(many)


def issue_title(name: str, date_from: Column, date_to: Column, tz: str = TIME_ZONE) -> Column:
    return F.concat(
        F.lit(f"{name} — "), date_label(date_from, tz), F.lit(" – "), date_label(date_to, tz)
    )


def issue_name(prefix: str, date_from: Column, date_to: Column, tz: str = TIME_ZONE) -> Column:
    def day(ts: Column) -> Column:
        return F.date_format(local_time(ts, tz), "yyyy-MM-dd")

    return F.concat_ws("_", F.lit(prefix), day(date_from), day(date_to))
