"""License scans by MinHash bands over overlapping text windows; DataFrame operations only.

A text's word shingles that no template has cannot take part in a match, so the shingles are first
met with the broadcast set of template shingles (``MAX_SHINGLES`` at most). What is left, few rows
of texts with license-like passages, is filed under overlapping windows at half-window steps: any
passage of up to half a window lies whole in one of them. Templates fall into classes by length, and
each class has its own windows: ``WINDOW`` shingle positions for notices of up to half of that, twice
as many for texts up to twice as long, and so on, so that a window is at least twice its template.
Windows with fewer shingles than the shortest template of the class needs are dropped.
A window's minima over its shingles form ``BANDS`` bands of one row, so a window of similarity s to
a template retrieves it with probability 1 - (1 - s)^BANDS. A lone license is at s = 0.8 or more; even
at s = 0.1, where the window holds ten times the license in words of others of its class, the chance
to miss it is 1e-6. Retrieved templates are verified by the exact share of their shingles that the
window contains.

Defined cases: null text has no words; a template needs at least one shingle; equal shingles in a
window count once; a document reports a template once, with its best window (the first one, in
ties); rows repeated under one id and text share their matches and each give a row; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.llm.batches import written
from broadsheet.llm.secrets import row_key

SHINGLE = 3
#: Positions in a window of the shortest class, for templates of up to half as many.
WINDOW = 64
BANDS = 128
PERCENT = 80
#: Template shingles that are broadcast at most; a larger set is joined by shuffle.
MAX_SHINGLES = 1_000_000
SEPARATORS = r"[^\p{L}\p{N}.]+"

#: Fixed notices of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
}
#: Whole license texts, as files of the package.
TEXTS = "license_texts"


@cache
def full_texts() -> dict[str, str]:
    """Whole license texts by name."""
    found = (f for f in files("broadsheet.llm").joinpath(TEXTS).iterdir() if f.name.endswith(".txt"))
    return {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in found}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS, -1), "")


def shingles_of(words: Column) -> Column:
    """Array of (w1, w2, w3); of a shorter text, its words followed by nulls."""
    n = F.size(words)
    rest = [F.slice(words, k + 1, F.greatest(n - (SHINGLE - 1), F.lit(1))) for k in range(SHINGLE)]
    zipped = F.arrays_zip(*(part.alias(f"w{k}") for k, part in enumerate(rest)))
    return F.when(n > 0, zipped).otherwise(F.slice(zipped, 1, 0))


def _hash() -> Column:
    return F.xxhash64(*(F.col(f"s.w{k}") for k in range(SHINGLE)))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """``template`` and ``text``; a table with these columns may be given instead."""
    return spark.createDataFrame(sorted((templates or TEMPLATES).items()), "template string, text string")


def banded(shingles: Column) -> Column:
    """Bands of a set of shingles: for each band the minimum of its seeded hash over the set."""

    def band(number: Column) -> Column:
        return F.xxhash64(number, F.array_min(F.transform(shingles, lambda s: F.xxhash64(number, s))))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)


def half_window(n: Column) -> Column:
    """Step of the windows for templates of ``n`` positions: the next power of two, ``WINDOW // 2`` at least."""
    least = (WINDOW // 2 - 1).bit_length()
    return F.pow(F.lit(2), F.greatest(F.length(F.bin(n - 1)), F.lit(least))).cast("bigint")


def scan(documents: DataFrame, templates: DataFrame, percent: int = PERCENT, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """``doc_id``, ``template``, matching and total shingles, word position of the best window."""
    rows = row_key(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
        )
    )
    spelled = templates.select("template", shingles_of(words_of(F.col("text"))).alias("all")).where(F.size("all") > 0)
    halves = spelled.groupBy("template").agg(half_window(F.sum(F.size("all"))).alias("half"))
    known = spelled.select("template", F.explode("all").alias("s")).select("template", _hash().alias("shingle")).join(halves, "template")
    sets = known.groupBy("half", "template").agg(F.collect_set("shingle").alias("own"))
    wanted = known.select("half", "shingle").distinct()
    if wanted.limit(max_shingles + 1).count() <= max_shingles:
        wanted = F.broadcast(wanted)
    placed = (
        rows.select("row_key", F.posexplode(shingles_of(words_of(F.col("text")))).alias("pos", "s"))
        .select("row_key", "pos", _hash().alias("shingle"))
        .join(wanted, "shingle")
    )
    block = F.floor(F.col("pos") / F.col("half"))
    # Position p lies in the windows that start at its half-window and at the one before.
    windows = (
        placed.select("row_key", "half", "shingle", "pos", F.explode(F.array(block, block - 1)).alias("window"))
        .where(F.col("window") >= 0)
        .groupBy("row_key", "half", "window", "shingle")
        .agg(F.min("pos").alias("pos"))
    )
    # A window that many documents copy is compared once: its shingles are its name.
    shortest = sets.groupBy("half").agg(F.min(F.size("own")).alias("shortest"))
    # Few rows; written once, since the texts are read for them.
    named = written(
        windows.groupBy("row_key", "half", "window")
        .agg(F.sort_array(F.collect_set("shingle")).alias("shingles"), F.min("pos").alias("pos"))
        .join(F.broadcast(shortest), "half")
        .where(100 * F.size("shingles") >= percent * F.col("shortest"))
        .select("row_key", "half", "shingles", "pos")
    )
    distinct = named.select("half", "shingles").distinct()
    window_bands = distinct.select("half", "shingles", F.explode(F.array_distinct(banded(F.col("shingles")))).alias("band"))
    template_bands = sets.select("half", "template", F.explode(F.array_distinct(banded(F.col("own")))).alias("band"))
    retrieved = window_bands.join(template_bands, ["half", "band"]).select("half", "shingles", "template").distinct()
    share = F.size(F.array_intersect("shingles", "own"))
    verified = (
        retrieved.join(sets, ["half", "template"])
        .select("half", "shingles", "template", share.alias("n_match"), F.size("own").alias("n_template"))
        .where(100 * F.col("n_match") >= percent * F.col("n_template"))
    )
    best = (
        named.join(verified, ["half", "shingles"])
        .groupBy("row_key", "template")
        .agg(F.max(F.struct("n_match", (-F.col("pos")).alias("before"), "n_template")).alias("b"))
    )
    return rows.select("row_key", "doc_id").join(best, "row_key").select(
        "doc_id",
        "template",
        F.col("b.n_match").cast("bigint").alias("n_match"),
        F.col("b.n_template").cast("bigint").alias("n_template"),
        (-F.col("b.before")).cast("bigint").alias("position"),
    )




def _sql_shingles(key: str, table: str) -> str:
    return rf"""
  SELECT {key}, w[i] || ' ' || coalesce(w[i + 1], '') || ' ' || coalesce(w[i + 2], '') AS s, i - 1 AS pos
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i
        FROM (SELECT {key}, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '{SEPARATORS}') if x <> ''] AS w FROM {table})
        WHERE len(w) > 0)"""


def _sql() -> str:
    """DuckDB SQL for the query's rows: every window against every template of its class."""
    texts = sorted((TEMPLATES | full_texts()).items())
    listed = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in texts)
    least = (WINDOW // 2 - 1).bit_length()
    return f"""
WITH t(template, text) AS (VALUES {listed}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
spelled AS ({_sql_shingles('template', 't')}),
halves AS (SELECT template, CAST(pow(2, greatest(length(bin(count(*) - 1)), {least})) AS BIGINT) AS half FROM spelled GROUP BY template),
own AS (SELECT DISTINCT template, half, s FROM spelled JOIN halves USING (template)),
sizes AS (SELECT template, count(*) AS n_template FROM own GROUP BY template),
wanted AS (SELECT DISTINCT half, s FROM own),
placed AS (SELECT r, half, pos, s FROM ({_sql_shingles('r', 'd')}) JOIN wanted USING (s)),
filed AS (
  SELECT r, half, pos, s, pos // half AS win FROM placed
  UNION ALL SELECT r, half, pos, s, pos // half - 1 FROM placed WHERE pos >= half
), firsts AS (SELECT r, half, win, min(pos) AS pos FROM filed GROUP BY r, half, win),
shared AS (
  SELECT r, half, win, template, count(DISTINCT s) AS n_match FROM filed JOIN own USING (half, s) GROUP BY r, half, win, template
), good AS (
  SELECT * FROM shared JOIN sizes USING (template) JOIN firsts USING (r, half, win) WHERE 100 * n_match >= {PERCENT} * n_template
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY n_match DESC, pos) AS k FROM good
)
SELECT doc_id, template, n_match, n_template, pos AS position FROM best JOIN d USING (r) WHERE k = 1
"""


SQL = _sql()
