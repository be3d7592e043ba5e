"""A page as an array of tokens, handled inside its own row.

Splitting, finding subtrees, editing and joining are column expressions over that
array. A page never leaves its row, so cleaning needs no shuffle, no sort and no key,
and equal page ids cannot mix. ``operators.pages.tokenize`` gives the same tokens as rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from broadsheet.functions.text import collapse, decode_entities, escape_xml, let, one_of, strip
from broadsheet.site import Selector

# The possessive forms keep Java's matcher from recursing on long tags and texts.
TOKEN = (
    r"(?is)<!--.*?-->"
    r"|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>"
    r"""|<(?:/?[a-z]|[!?])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"|(?:[^<]++|<(?!/?[a-z]|[!?]))++|<"
)
_ATTR_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
_ATTR = rf"[\s/]++[^\s=>/]++(?:\s*+=\s*+{_ATTR_VALUE})?+"

# In an order that makes "opens an element" and "is a tag" ranges.
TEXT, OPEN, VOID, CLOSE, DECL, RAW = range(6)
KINDS = ("text", "open", "void", "close", "decl", "raw")

# Elements without content, and elements that end an open paragraph.
_VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
_RAW_TAGS = ("script", "style", "noscript")
_BLOCK_TAGS = (
    "address article aside blockquote center dd details dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section "
    "table tbody td tfoot th thead tr ul body html"
).split()

_ITEM = "struct<t:string,n:string,k:int,c:string>"
_SPANS = "array<struct<s:int,e:int,r:int>>"
# Elements of one part of a fold, and characters of open names kept.
FOLDED = 256
OPEN_NAMES = 4000
Items = Column
Predicate = Callable[[Column], Column]


def raw_tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def token_name(tok: Column) -> Column:
    return F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1))


def token_kind(tok: Column, name: Column) -> Column:
    return (
        F.when(~tok.startswith("<"), TEXT)
        .when(name == "", F.when(tok.rlike("^<[!?]"), DECL).otherwise(TEXT))
        .when(tok.startswith("</"), CLOSE)
        .when(name.isin(*_RAW_TAGS) & tok.rlike(r"</\w+\s*>$"), RAW)
        .when(one_of(name, _VOID_TAGS) | tok.endswith("/>"), VOID)
        .otherwise(OPEN)
    )


def _attr_raw(tok: Column, name: str) -> Column:
    key = re.escape(name)
    pattern = (
        rf"(?is)^<[a-z][^\s/>]*+(?:(?![\s/]++{key}\s*+=){_ATTR})*+"
        rf"[\s/]++{key}\s*+=\s*+({_ATTR_VALUE})"
    )
    return F.regexp_extract(tok, pattern, 1)


def attribute(tok: Column, name: str) -> Column:
    """Value of an attribute of a tag token, null when it has none."""

    def value(raw: Column) -> Column:
        quoted = F.substring(raw, 2, F.length(raw) - 2)
        return F.when(raw == "", None).otherwise(
            decode_entities(F.when(raw.rlike("^[\"']"), quoted).otherwise(raw), bare=False)
        )

    return F.when(F.lower(tok).contains(name), let(_attr_raw(tok, name), value))


def has_value(tok: Column, name: str) -> Column:
    """Whether a tag token has a non-empty attribute; cheaper than its value."""
    return F.lower(tok).contains(name) & ~_attr_raw(tok, name).isin("", '""', "''")


def _classes(tok: Column) -> Column:
    raw = _attr_raw(tok, "class")
    return F.when(
        F.lower(tok).contains("class"), F.regexp_replace(raw, "^[\"']|[\"']$", "")
    ).otherwise(F.lit(""))


def items(html: Column) -> Items:
    """Tokens with text ``t``, tag name ``n``, kind ``k`` and classes ``c``."""

    def whole(t: Column) -> Column:
        def with_name(n: Column) -> Column:
            return let(token_kind(t, n), lambda k: with_kind(n, k))

        def with_kind(n: Column, k: Column) -> Column:
            classes = F.when(k.between(OPEN, VOID), _classes(t)).otherwise(F.lit(""))
            return F.struct(t.alias("t"), n.alias("n"), k.alias("k"), classes.alias("c"))

        return let(token_name(t), with_name)

    return F.transform(raw_tokens(html), whole)


def _item(tok: Column, name: str, kind: int) -> Column:
    return F.struct(
        tok.alias("t"),
        F.lit(name).alias("n"),
        F.lit(kind).alias("k"),
        F.lit("").alias("c"),
    )


def with_token(x: Column, tok: Column) -> Column:
    return F.struct(tok.alias("t"), x["n"], x["k"], x["c"])


def positions(tokens: Items, test: Predicate) -> Column:
    """Positions from 0 of the tokens that pass; tokens themselves are not copied."""
    every = F.sequence(F.lit(0), F.size(tokens) - 1)
    return F.filter(every, lambda i: test(F.get(tokens, i)))


def matches(sel: Selector) -> Predicate:
    """Predicate on an opening (or empty) tag."""

    def test(x: Column) -> Column:
        cond = x["k"].between(OPEN, VOID)
        if sel.name:
            cond = cond & (x["n"] == sel.name)
        if sel.cls:
            cond = cond & (x["c"] != "") & x["c"].rlike(rf"(^|\s){re.escape(sel.cls)}(\s|$)")
        if sel.cls_like:
            cond = cond & (x["c"] != "") & x["c"].rlike(sel.cls_like)
        return cond

    return test


def any_of(selectors: Sequence[Selector]) -> Predicate:
    def test(x: Column) -> Column:
        cond = F.lit(False)
        for sel in selectors:
            cond = cond | matches(sel)(x)
        return cond

    return test


def _is_block(x: Column) -> Column:
    return x["k"].between(OPEN, CLOSE) & one_of(x["n"], _BLOCK_TAGS)


def subtrees(tokens: Items, *roots: Predicate) -> Column:
    """Outermost subtrees whose root matches; ``r`` is the number of the predicate (from 1).

    ``tokens`` has to be a lambda variable. Only tags named like some root are walked, so
    unclosed tags inside do no harm and a page without a root costs one filter. A paragraph
    also ends before the next block tag, and a root that is never closed reaches to the end
    of the tokens.
    """

    def walk(names: Column) -> Column:
        has_p = F.array_contains(names, "p")
        walked = positions(
            tokens,
            lambda x: x["k"].between(OPEN, CLOSE)
            & (F.array_contains(names, x["n"]) | (has_p & _is_block(x))),
        )
        return _walk(tokens, walked, roots)

    found = F.filter(tokens, lambda x: _number(x, roots) > 0)
    names = F.array_distinct(F.transform(found, lambda x: x["n"]))
    return let(
        names,
        lambda ns: F.when(F.size(ns) == 0, F.array().cast(_SPANS)).otherwise(walk(ns)),
    )


def _number(x: Column, roots: Sequence[Predicate]) -> Column:
    number = F.lit(0)
    for no, test in reversed(list(enumerate(roots, 1))):
        number = F.when(test(x), no).otherwise(number)
    return number


def _walk(tokens: Items, walked: Column, roots: Sequence[Predicate]) -> Column:
    """State machine over the walked tags: name, depth, start and number of the open root."""

    def state(n, d, s, r, out):
        return F.struct(n.alias("n"), d.alias("d"), s.alias("s"), r.alias("r"), out.alias("out"))

    def span(s, e, r):
        return F.struct(s.alias("s"), e.alias("e"), r.alias("r"))

    zero, none = F.lit(0), F.lit("")

    def begin(x, i, out):
        """At a tag outside of any subtree."""

        def rooted(r):
            alone = F.array_append(out, span(i, i, r))
            return (
                F.when(r == 0, state(none, zero, zero, zero, out))
                .when(x["k"] == OPEN, state(x["n"], F.lit(1), i, r, out))
                .otherwise(state(none, zero, zero, zero, alone))
            )

        return let(_number(x, roots), rooted)

    def step(st, i):
        x, out = F.get(tokens, i), st["out"]

        def ended(e):
            return F.array_append(out, span(st["s"], e, st["r"]))

        closed = state(none, zero, zero, zero, ended(i))
        depth = st["d"] + F.when(x["k"] == OPEN, 1).when(x["k"] == CLOSE, -1).otherwise(0)
        cut_short = (st["d"] > 0) & (st["n"] == "p") & _is_block(x)
        return (
            F.when(
                (st["d"] == 0) | (cut_short & ((x["n"] != "p") | (x["k"] != CLOSE))),
                begin(x, i, F.when(st["d"] == 0, out).otherwise(ended(i - 1))),
            )
            .when(x["n"] != st["n"], st)
            .when(depth == 0, closed)
            .otherwise(state(st["n"], depth, st["s"], st["r"], out))
        )

    def finish(st):
        last = F.size(tokens) - 1
        unclosed = F.array_append(st["out"], span(st["s"], last, st["r"]))
        return F.when(st["d"] > 0, unclosed).otherwise(st["out"])

    start = state(none, zero, zero, zero, F.array().cast(_SPANS))
    return F.aggregate(walked, start, step, finish)


def _folded(
    every: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    finish: Callable[[Column, Column], Column],
) -> Column:
    """Fold whose steps append subtrees to the state's ``now``; ``finish`` gets the state and all of them.

    A state is copied at every step. So the fold goes over parts of ``FOLDED`` elements, and what a
    part has found is put aside in an outer fold, which is copied once a part.
    """
    none = F.array().cast(_SPANS)
    zero = F.struct(start.alias("st"), F.array().cast(f"array<{_SPANS}>").alias("full"))

    def in_parts(bound: Column) -> Column:
        def one_part(acc: Column, at: Column) -> Column:
            def put_aside(st: Column) -> Column:
                return F.struct(
                    st.withField("now", none).alias("st"),
                    F.array_append(acc["full"], st["now"]).alias("full"),
                )

            part = F.slice(bound, at, F.lit(FOLDED))
            return let(F.aggregate(part, acc["st"], step), put_aside)

        parts = F.sequence(F.lit(1), F.greatest(F.size(bound), F.lit(1)), F.lit(FOLDED))
        return F.aggregate(parts, zero, one_part, lambda acc: finish(acc["st"], F.flatten(acc["full"])))

    return let(every, in_parts)


def _span(s: Column, e: Column, r: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"), r.alias("r"))


def paragraphs(tokens: Items) -> Column:
    """Paragraphs and end tags without one, of a lambda variable: ``r`` is 1 for paragraphs, else 0.

    Paragraphs don't nest: one ends at its end tag or before the next block tag, so each is
    told from the next tag alone and the work is linear in the tokens.
    """

    def paired(at: Column) -> Column:
        def whole(i: Column, no: Column) -> Column:
            def ended(x: Column, after: Column) -> Column:
                nxt = F.get(tokens, after)
                end = (
                    F.when(after.isNull(), F.size(tokens) - 1)
                    .when((nxt["n"] == "p") & (nxt["k"] == CLOSE), after)
                    .otherwise(after - 1)
                )
                return F.when(x["k"] == OPEN, _span(i, end, F.lit(1))).when(
                    x["k"] == VOID, _span(i, i, F.lit(1))
                )

            def stray(before: Column) -> Column:
                opened = (before["n"] == "p") & (before["k"] == OPEN)
                return F.when(~F.coalesce(opened, F.lit(False)), _span(i, i, F.lit(0)))

            x = F.get(tokens, i)
            closing = stray(F.get(tokens, F.get(at, no - 1)))
            return F.when(
                x["n"] == "p", F.when(x["k"] == CLOSE, closing).otherwise(ended(x, F.get(at, no + 1)))
            )

        return F.filter(F.transform(at, whole), lambda span: span.isNotNull())

    return let(positions(tokens, _is_block), paired)


def closed_subtrees(tokens: Items, *roots: Predicate) -> Column:
    """Outermost subtrees to be dropped: ``spans`` as ``subtrees`` gives them, and ``repaired``.

    The names of open elements are kept as a string, the last opened first. A root ends at its
    own end tag, or before the end tag of an element opened before it, or, being a paragraph,
    before the next block tag. A root that nothing closes ends before the next block tag unless
    it is a block itself, which reaches to the end; raw text always does. ``repaired`` counts the
    roots, paragraphs aside, that end without their own end tag.

    Elements that no later end tag names are not kept, and at most ``OPEN_NAMES`` characters of
    names, so a page full of open tags stays linear. ``tokens`` has to be a lambda variable.
    """
    nothing = F.struct(F.array().cast(_SPANS).alias("spans"), F.lit(0).alias("repaired"))

    def with_ends(ends: Column) -> Column:
        # Where each name is closed for the last time.
        backwards = F.reverse(F.transform(ends, lambda i: F.get(tokens, i)["n"]))
        return let(backwards, lambda names: let(_last_ends(ends, names), walk))

    def _last_ends(ends: Column, names: Column) -> Column:
        each = F.array_distinct(names)
        last = F.transform(
            each, lambda n: F.get(ends, F.size(ends) - F.array_position(names, n).cast("int"))
        )
        return F.map_from_arrays(each, last)

    def walk(last: Column) -> Column:
        walked = positions(tokens, lambda x: x["k"].between(OPEN, CLOSE))
        return _close_by_stack(tokens, walked, last, roots)

    found = F.exists(tokens, lambda x: _number(x, roots) > 0)
    ends = positions(tokens, lambda x: x["k"] == CLOSE)
    return F.when(found, let(ends, with_ends)).otherwise(nothing)


def _popped(names: Column, name: Column) -> Column:
    """Open names after closing the last one called ``name``, null when none is."""
    at = F.position(F.concat(F.lit(">"), name, F.lit(">")), names)
    return F.when(at > 0, F.substring(names, at + F.length(name) + 1, F.length(names)))


def _close_by_stack(tokens: Items, walked: Column, last: Column, roots: Sequence[Predicate]) -> Column:
    """Walk the tags with the names open around (``up``) and inside (``own``) the open root."""
    empty = F.lit(">")

    def state(up, own, s, r, ends, now, repaired):
        """``ends``: how the open root ends, by tags (0), before a block (1), not at all (2)."""
        named = zip(("up", "own", "s", "r", "ends", "now", "repaired"), (up, own, s, r, ends, now, repaired))
        return F.struct(*[value.alias(name) for name, value in named])

    def outside(up, now, repaired):
        return state(up, empty, F.lit(-1), F.lit(0), F.lit(0), now, repaired)

    def pushed(names, x, i):
        closes_later = F.coalesce(F.try_element_at(last, x["n"]), F.lit(-1)) > i
        longer = F.substring(F.concat(F.lit(">"), x["n"], names), 1, OPEN_NAMES)
        return F.when((x["k"] == OPEN) & closes_later, longer).otherwise(names)

    def without_p(names, x):
        return F.when(_is_block(x), F.coalesce(_popped(names, F.lit("p")), names)).otherwise(names)

    def outer_step(x, i, up, now, repaired):
        """A tag outside of any root."""

        def opened(above):
            def rooted(r):
                closes_later = F.coalesce(F.try_element_at(last, x["n"]), F.lit(-1)) > i
                how = (
                    F.when(one_of(x["n"], _RAW_TAGS), 2)
                    .when(closes_later | (above != empty) | _is_block(x), 0)
                    .otherwise(1)
                )
                own = F.concat(F.lit(">"), x["n"], empty)
                return (
                    F.when(r == 0, outside(pushed(above, x, i), now, repaired))
                    .when(x["k"] == OPEN, state(above, own, i, r, how, now, repaired))
                    .otherwise(outside(above, F.array_append(now, _span(i, i, r)), repaired))
                )

            return let(_number(x, roots), rooted)

        closed = outside(F.coalesce(_popped(up, x["n"]), up), now, repaired)
        return F.when(x["k"] == CLOSE, closed).otherwise(let(without_p(up, x), opened))

    def step(st, i):
        def at(x):
            is_p = st["own"].endswith(">p>") & (F.get(tokens, st["s"])["n"] == "p")

            def ended(e, fault):
                return F.array_append(st["now"], _span(st["s"], e, st["r"])), st["repaired"] + fault

            def inside(own, up=None):
                return state(st["up"] if up is None else up, own, st["s"], st["r"], st["ends"], st["now"], st["repaired"])

            before, fault = ended(i - 1, F.when(is_p, 0).otherwise(1))
            here, _ = ended(i, F.lit(0))

            def closing(rest):
                above = _popped(st["up"], x["n"])
                return (
                    F.when(rest == empty, outside(st["up"], here, st["repaired"]))
                    .when(rest.isNotNull(), inside(rest))
                    .when(above.isNotNull(), outside(above, before, fault))
                    .otherwise(st)
                )

            def opening(rest):
                # A block ends the root where that is a paragraph.
                return F.when(rest == empty, outer_step(x, i, st["up"], before, fault)).otherwise(
                    inside(pushed(rest, x, i))
                )

            return (
                F.when(st["s"] < 0, outer_step(x, i, st["up"], st["now"], st["repaired"]))
                .when(st["ends"] == 2, st)
                .when(
                    st["ends"] == 1,
                    F.when(_is_block(x), outer_step(x, i, st["up"], before, fault)).otherwise(st),
                )
                .when(x["k"] == CLOSE, let(_popped(st["own"], x["n"]), closing))
                .otherwise(let(without_p(st["own"], x), opening))
            )

        return let(F.get(tokens, i), at)

    def finish(st, spans):
        x = F.get(tokens, st["s"])
        block = F.get(F.filter(walked, lambda i: (i > st["s"]) & _is_block(F.get(tokens, i))), F.lit(0))
        stays_open = _is_block(x) | (st["ends"] == 2)
        end = F.when(stays_open | block.isNull(), F.size(tokens) - 1).otherwise(block - 1)
        rest = F.array_append(spans, _span(st["s"], end, st["r"]))
        fault = F.when(x["n"] == "p", 0).otherwise(1)
        return F.when(
            st["s"] >= 0, F.struct(rest.alias("spans"), (st["repaired"] + fault).alias("repaired"))
        ).otherwise(F.struct(spans.alias("spans"), st["repaired"].alias("repaired")))

    start = outside(empty, F.array().cast(_SPANS), F.lit(0))
    return _folded(walked, start, step, lambda st, spans: let(spans, lambda found: finish(st, found)))


def part(tokens: Items, span: Column) -> Items:
    return F.slice(tokens, span["s"] + 1, span["e"] - span["s"] + 1)


def inner(tokens: Items) -> Items:
    """Content of a subtree, without its own tags."""
    first, last = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(-1))
    own_end = (last["k"] == CLOSE) & (last["n"] == first["n"])
    return F.slice(
        tokens, 2, F.greatest(F.size(tokens) - F.when(own_end, 2).otherwise(1), F.lit(0))
    )


def splice(tokens: Items, spans: Column, new: Callable[[Column, Items], Items] | None) -> Items:
    """Replace ascending, disjoint subtrees of a lambda variable; without ``new`` drop them."""

    def build(cuts: Column) -> Column:
        def piece(cut, j):
            before = F.when(j == 0, 0).otherwise(F.try_element_at(cuts, j)["e"] + 1)
            kept = F.slice(tokens, before + 1, cut["s"] - before)
            return kept if new is None else F.concat(kept, new(cut, part(tokens, cut)))

        after = F.element_at(cuts, -1)["e"] + 1
        rest = F.slice(tokens, after + 1, F.size(tokens) - after)
        return F.when(F.size(cuts) == 0, tokens).otherwise(
            F.concat(F.flatten(F.transform(cuts, piece)), rest)
        )

    return let(spans, build)


def drop_subtrees(tokens: Items, *roots: Predicate) -> Items:
    return let(tokens, lambda toks: splice(toks, closed_subtrees(toks, *roots)["spans"], None))


def first_subtree(tokens: Items, root: Predicate) -> Items:
    """Tokens of the first matching subtree of a lambda variable, null when there is none."""
    return let(
        subtrees(tokens, root),
        lambda spans: F.when(F.size(spans) > 0, part(tokens, F.element_at(spans, 1))),
    )


def first_attribute(tokens: Items, root: Predicate, name: str) -> Column:
    """Attribute of the first matching tag."""
    found = F.filter(tokens, root)
    return let(found, lambda f: F.when(F.size(f) > 0, attribute(F.element_at(f, 1)["t"], name)))


def text_of(tokens: Items, separator: str = "") -> Column:
    """Text nodes, trimmed and joined; with a separator white space is collapsed as well."""
    trim = collapse if separator else strip
    texts = F.transform(
        F.filter(tokens, lambda x: x["k"] == TEXT), lambda x: trim(decode_entities(x["t"]))
    )
    return F.array_join(F.filter(texts, lambda t: t != ""), separator)


def html_of(tokens: Items) -> Column:
    return F.array_join(F.transform(tokens, lambda x: x["t"]), "")


def edit_tag(
    tok: Column,
    name: Column,
    kind: Column,
    drop: str | None = None,
    put: tuple[str, Column] | None = None,
) -> Column:
    """A tag without the attributes matching ``drop`` and, unless null, with one set."""
    attrs = F.regexp_extract_all(tok, F.lit(rf"(?is){_ATTR}"), F.lit(0))
    if drop:
        attrs = F.filter(attrs, lambda a: ~a.rlike(rf"(?is)^[\s/]+(?:{drop})\s*(=|$)"))
    shown = F.transform(attrs, lambda a: F.regexp_replace(a, r"^[\s/]+", " "))
    if put:
        key, value = put
        is_key = rf"(?is)^\s{re.escape(key)}\s*(=|$)"

        def placed(pair: Column) -> Column:
            old, new = pair["old"], pair["new"]
            swapped = F.transform(old, lambda a: F.when(a.rlike(is_key), new).otherwise(a))
            return (
                F.when(new.isNull(), old)
                .when(F.exists(old, lambda a: a.rlike(is_key)), swapped)
                .otherwise(F.array_append(old, new))
            )

        fresh = F.concat(F.lit(f' {key}="'), escape_xml(value), F.lit('"'))
        shown = let(F.struct(shown.alias("old"), fresh.alias("new")), placed)
    return F.concat(
        F.lit("<"),
        name,
        F.array_join(shown, ""),
        F.when(kind == VOID, F.lit("/>")).otherwise(F.lit(">")),
    )


def link_items(href: Column, text: Column) -> Items:
    """A paragraph that holds one link."""
    return F.array(
        _item(F.lit("<p>"), "p", OPEN),
        _item(F.concat(F.lit('<a href="'), escape_xml(href), F.lit('">')), "a", OPEN),
        _item(escape_xml(text), "", TEXT),
        _item(F.lit("</a>"), "a", CLOSE),
        _item(F.lit("</p>"), "p", CLOSE),
    )


def no_items() -> Items:
    return F.array().cast(f"array<{_ITEM}>")


def empty_subtrees(tokens: Items, root: Predicate, content: Predicate) -> Column:
    """Outermost matching subtrees without any ``content`` token, nested ones included.

    A stack of open roots is kept; the last content position tells which are empty.
    """

    def state(stack, full, now):
        return F.struct(stack.alias("stack"), full.alias("full"), now.alias("now"))

    def entry(n, d, s):
        return F.struct(n.alias("n"), d.alias("d"), s.alias("s"))

    def step(st, i):
        x, stack, full, out = F.get(tokens, i), st["stack"], st["full"], st["now"]
        below = F.slice(stack, 1, F.size(stack) - 1)

        def at_top(top):
            by = F.when(x["k"] == OPEN, 1).when(x["k"] == CLOSE, -1).otherwise(0)
            moved = F.array_append(below, entry(top["n"], top["d"] + by, top["s"]))
            found = F.array_append(out, _span(top["s"], i, F.lit(1)))
            return (
                F.when(x["n"] != top["n"], st)
                .when(top["d"] + by > 0, state(moved, full, out))
                .otherwise(state(below, full, F.when(full < top["s"], found).otherwise(out)))
            )

        opened = F.array_append(stack, entry(x["n"], F.lit(1), i))
        return (
            F.when(content(x), state(stack, i, out))
            .when((x["k"] == OPEN) & root(x), state(opened, full, out))
            .when(F.size(stack) == 0, st)
            .otherwise(let(F.element_at(stack, -1), at_top))
        )

    start = state(F.array().cast("array<struct<n:string,d:int,s:int>>"), F.lit(-1), F.array().cast(_SPANS))
    every = F.sequence(F.lit(0), F.size(tokens) - 1)
    found = _folded(every, start, step, lambda _, spans: let(F.array_sort(spans), _outermost))
    return F.when(F.exists(tokens, root), found).otherwise(F.array().cast(_SPANS))


def _outermost(spans: Column) -> Column:
    """Subtrees without those inside others; ``spans`` is a lambda variable in ascending order."""

    def step(st, span):
        kept = F.struct(F.array_append(st["now"], span).alias("now"), span["e"].alias("end"))
        return F.when(span["s"] > st["end"], kept).otherwise(st)

    start = F.struct(F.array().cast(_SPANS).alias("now"), F.lit(-1).alias("end"))
    return _folded(spans, start, step, lambda _, found: found)
