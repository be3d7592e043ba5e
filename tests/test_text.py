from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text as T


def col():
    return F.col("s")


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('1 < 2 && "3" > 2', "1 &lt; 2 &amp;&amp; &quot;3&quot; &gt; 2"),
        ("it's", "it's"),
        ("&amp;", "&amp;amp;"),
    ],
)
def test_escape_xml(evaluate, raw, expected):
    assert evaluate(T.escape_xml(col()), s=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a &amp; b", "a & b"),
        ("&lt;p&gt; &quot;x&quot; &#39;y&apos;", "<p> \"x\" 'y'"),
        ("&#322;&#x142;&#x1F600;", "łł\U0001f600"),
        ("&#0000000065;&#x000000000042;", "AB"),
        ("AT&amp no semicolon", "AT& no semicolon"),
        ("&unknown; & &#0; &#xD800;", "&unknown; & &#0; &#xD800;"),
        ("&nbsp;x&mdash;y", " x—y"),
        ("plain", "plain"),
    ],
)
def test_decode_entities(evaluate, raw, expected):
    assert evaluate(T.decode_entities(col()), s=raw) == expected


def test_bare_entities_stay_in_attributes(evaluate):
    assert evaluate(T.decode_entities(col(), bare=False), s="?a=1&copy=2&amp;b") == "?a=1&copy=2&b"


@pytest.mark.parametrize(
    "name",
    [
        "Świętosława d'Hôtel-Ćma",
        "𝐀dam 𝒵",
        "Ångström  Ünal_Öz",
        "ﬁlip № 5",
        "Иван",
        "  ",
        "x" * 100,
        "Ærø ½ ² ™ Ⅳ",
    ],
)
def test_author_anchor_matches_unicode_rules(evaluate, name):
    import re

    ascii_name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    slug = re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s\-]", "", ascii_name).strip())[:80]
    assert evaluate(T.author_anchor(col()), s=name) == f"author-{slug or 'nieznany'}"


@pytest.mark.parametrize("name", ["Żurek", "STRASSE", "Straße", "ΣΊΣΥΦΟΣ", "ﬁn", "İstanbul", "ab"])
def test_casefold(evaluate, name):
    expected = name.casefold()
    if name == "İstanbul":
        expected = name.lower().casefold()
    assert evaluate(T.casefold(col()), s=name) == expected


@pytest.mark.parametrize(
    "n, label",
    [(0, 2), (1, 0), (2, 1), (4, 1), (5, 2), (11, 2), (12, 2), (14, 2), (22, 1), (112, 2), (124, 1)],
)
def test_count_label(evaluate, n, label):
    assert evaluate(T.count_label(F.lit(n))) == ("artykuł", "artykuły", "artykułów")[label]


def test_strip_takes_all_white_space(evaluate):
    assert evaluate(T.strip(col()), s=" \t x y \n ") == "x y"


def test_date_label_is_local(evaluate):
    """The day changes at local midnight, two hours before UTC's in summer and one in winter."""
    for instant, label in [
        ("2029-07-14 21:59:59", "14.07.2029"),
        ("2029-07-14 22:00:00", "15.07.2029"),
        ("2029-11-08 22:59:59", "08.11.2029"),
        ("2029-11-08 23:00:00", "09.11.2029"),
    ]:
        assert evaluate(T.date_label(F.lit(instant).cast("timestamp"))) == label


def test_category_rank_and_label(evaluate):
    assert evaluate(T.category_rank(F.lit("Kraj"))) == 0
    assert evaluate(T.category_rank(F.lit("Moto"))) == 10
    assert evaluate(T.category_rank(F.lit("Inne"))) == 11
    assert evaluate(T.category_label(col()), s="  ") == "Inne"
    assert evaluate(T.category_label(F.lit(None).cast("string"))) == "Inne"


def test_issue_title_and_name(evaluate):
    """Both ends count as local days, also over the turn of a year and within one day."""
    cases = [
        ("2031-12-30 23:30:00", "2032-01-02 03:00:00", "31.12.2031 – 02.01.2032", "2031-12-31_2032-01-02"),
        ("2030-02-28 01:00:00", "2030-02-28 21:00:00", "28.02.2030 – 28.02.2030", "2030-02-28_2030-02-28"),
    ]
    for start, end, period, days in cases:
        first, last = (F.lit(at).cast("timestamp") for at in (start, end))
        assert evaluate(T.issue_title("Harbour", first, last)) == f"Harbour — {period}"
        assert evaluate(T.issue_name("harbour", first, last)) == f"harbour_{days}"


def test_parse_published(spark):
    rows = [("2026-06-01T12:00:00+02:00",), ("2026-06-01T12:00:00",), ("soon",), (None,)]
    df = spark.createDataFrame(rows, "s string").select(
        T.parse_published(F.col("s")).cast("string").alias("t")
    )
    got = [r["t"] for r in df.collect()]
    assert got == ["2026-06-01 10:00:00", "2026-06-01 12:00:00", None, None]
