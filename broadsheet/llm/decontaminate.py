"""Benchmark decontamination by a prefix-filtered set join; DataFrame operations only.

Every window of an item is a set of word shingles (of one word, so that short items have some)
that a contaminated text must contain whole. At containment 1 the necessary prefix of a window is
its single rarest shingle; rarity is the shingle's count over the whole corpus. Only texts that
contain a window's prefix are candidates. The shingle's offset in the window gives the one place
where the window can lie (positional bound), which must fit the text (length bound); then the
item-sized window there is compared word for word.

Joins and counts use Unicode-folded words, a coarser key than the contract's A-Z; the comparison
uses the contract's. Windows are broadcast up to ``MAX_WINDOWS``; beyond, narrow (row, position,
word) records meet them in a shuffled join and the text is fetched for the candidates only.

Defined cases: null text or item has no words; such a document has no hits, such an item no
window; a null ``item_id`` reads as the word null; items repeated under one id count once, and
windows equal in several items count for each; repeated documents each give a row; empty tables
give no rows or no hits; extra columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.llm.secrets import row_key

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A hit document is contaminated when at least one word in this many is hit.
HIT_SHARE = 20
#: Distinct windows that are broadcast at most; a window is at most ``WINDOW`` words.
MAX_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS, -1), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def documents_of(documents: DataFrame) -> DataFrame:
    """Row key, id and words of every document."""
    rows = row_key(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
        )
    )
    return rows.select("row_key", "doc_id", words_of(F.col("text")).alias("words"))


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows with their words, text and the items they occur in."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        words_of(ascii_lower(F.col("text").cast("string"))).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1))))
    return (
        items.select("item_id", "words", starts.alias("start"))
        .select("item_id", F.slice("words", F.col("start"), width).alias("window_words"))
        .groupBy("window_words")
        .agg(F.collect_set("item_id").alias("items"))
    )


def counted(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """Folded benchmark words with their number of occurrences in the whole corpus."""
    vocabulary = windows.select(F.explode("window_words").alias("w")).select(F.lower("w").alias("token")).distinct()
    side = F.broadcast(vocabulary) if small else vocabulary
    seen = (
        docs.select(F.explode("words").alias("w"))
        .select(F.lower("w").alias("token"))
        .join(side, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    return vocabulary.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest word and that word's offset; windows with a word that no
    document has are dropped, as they cannot occur."""
    keyed = windows.select(F.array_join("window_words", " ").alias("window"), F.size("window_words").alias("width"), "items", "window_words")
    rarest = (
        keyed.select("window", F.posexplode("window_words").alias("offset", "w"))
        .select("window", "offset", F.lower("w").alias("token"))
        .join(counts, "token")
        .groupBy("window")
        .agg(F.min(F.struct("n", "token", "offset")).alias("prefix"))
    )
    return (
        keyed.drop("window_words")
        .join(rarest, "window")
        .where("prefix.n > 0")
        .select(F.col("prefix.token").alias("token"), F.col("prefix.offset").alias("offset"), "width", "window", "items")
    )


def _at(start: Column, width: Column) -> Column:
    """Text of the document's words there, as the contract compares them."""
    return ascii_lower(F.array_join(F.slice("words", start + 1, width), " "))


def hits(docs: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """One mark for each document and one row for each occurrence of a window.

    The mark (null ``start``) carries the word count and keeps documents without hits.
    """
    n = F.size("words")
    # The empty first element is the mark; real words follow from position 1.
    spread = F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "w")
    start = F.col("pos") - 1 - F.col("offset")
    fits = (start >= 0) & (start + F.col("width") <= n)
    if small:
        met = (
            docs.select("row_key", "doc_id", "words", spread)
            .join(F.broadcast(table.withColumnRenamed("token", "prefix")), F.lower("w") == F.col("prefix"), "left")
            .where((F.col("pos") == 0) | (F.col("prefix").isNotNull() & fits))
        )
        return met.where((F.col("pos") == 0) | (_at(start, F.col("width")) == F.col("window"))).select(
            "row_key",
            "doc_id",
            n.cast("bigint").alias("n_words"),
            F.when(F.col("pos") > 0, start).alias("start"),
            F.when(F.col("pos") > 0, F.col("width")).alias("width"),
            F.when(F.col("pos") > 0, F.col("items")).alias("items"),
        )
    marks = docs.select(
        "row_key", "doc_id", n.cast("bigint").alias("n_words"), F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("array<string>").alias("items"),
    )
    narrow = docs.select("row_key", n.alias("n"), spread).where("pos > 0").select("row_key", "n", "pos", F.lower("w").alias("token"))
    wanted = (
        narrow.join(table, "token")
        .select("row_key", "n", start.alias("start"), "width", "window", "items")
        .where((F.col("start") >= 0) & (F.col("start") + F.col("width") <= F.col("n")))
        .distinct()
    )
    verified = (
        docs.drop_duplicates(["row_key"]).join(wanted, "row_key").where(_at(F.col("start"), F.col("width")) == F.col("window"))
    )
    return marks.union(verified.select("row_key", "doc_id", n.cast("bigint"), "start", "width", "items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Hit words, items and verdict of every document."""
    docs = documents_of(documents)
    windows = windows_of(benchmark, width)
    small = windows.limit(max_windows + 1).count() <= max_windows
    found = hits(docs, prefixes(windows, counted(docs, windows, small)), small)
    # Repeated rows share a key: their marks say how many rows the result has.
    per_row = found.groupBy("row_key", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "width")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda state, s: F.struct(
            F.greatest(state["upto"], s["start"] + s["width"]).alias("upto"),
            (state["n"] + F.greatest(s["start"] + s["width"] - F.greatest(state["upto"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda state: state["n"],
    )
    counted_rows = per_row.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    )
    return counted_rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated rows; columns stay as they are."""
    marked = row_key(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            F.struct("*").alias("_row"),
        )
    )
    docs = documents_of(documents)
    windows = windows_of(benchmark)
    small = windows.limit(MAX_WINDOWS + 1).count() <= MAX_WINDOWS
    spans = (
        hits(docs, prefixes(windows, counted(docs, windows, small)), small)
        .where("start is not null")
        .select("row_key", "n_words", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("at"))
        .distinct()
        .groupBy("row_key")
        .agg(F.count("*").alias("n_hit"), F.max("n_words").alias("n_words"))
        .where(HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    )
    return marked.join(spans.select("row_key"), "row_key", "left_anti").select("_row.*")


#: DuckDB SQL for the query's rows.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)
), texts AS (
  SELECT r, m, [array_to_string(w[i : i + m - 1], ' ') for i in range(1, greatest(len(w) - m + 2, 1))] AS ts FROM d, (SELECT DISTINCT n AS m FROM windows)
), places AS (
  SELECT r, m, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM texts
), hit AS (
  SELECT DISTINCT r, i, n, item FROM places JOIN windows USING (t) WHERE n = m
), told AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(CAST(i AS BIGINT), CAST(i + n AS BIGINT))) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {HIT_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN told USING (r) LEFT JOIN items USING (r)
"""
