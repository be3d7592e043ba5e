"""Secret scans with corpus-wide ownership frequency; DataFrame operations only.

Candidates are found with their positions: the matches of a pattern and the pieces between them
give every offset. Their hashes are then counted over the whole corpus by distinct repository and
owner. A value that several owners carry is a widely copied example; one that a single owner has
is specific and looks live. Ownership also admits a further kind, ``key``: long mixed tokens that
no base pattern covers count as secrets only if they belong to one owner.

Defined cases: null text is empty and has no spans; a null owner or repository counts as one
unnamed owner or repository; rows equal in id and text share their spans and each give a row; an
empty table gives no rows; extra columns are ignored. Counts aggregate distinct
(value, owner, repository) rows, so a value in a third of all rows shrinks before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.llm.batches import written

#: Fixed patterns of the base kinds, in their order, with the group whose length is tested.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "key")
LEAST = {"assign": 12, "access": 18, "hex": 16, "key": 20}
#: The same matches without runs that are too short anyway.
SEARCH = {"assign": ASSIGN, "access": ACCESS, "hex": r"[0-9a-f]{16,}", "key": r"[A-Za-z0-9]{20,}"}
VALUE_GROUP = {"assign": 2, "access": 0, "hex": 0, "key": 0}
#: A value with this many owners is an example that people copy.
COPIED_OWNERS = 2
EXAMPLE_MARK, SECRET_MARK = "[example]", "[secret]"


def row_key(df: DataFrame) -> DataFrame:
    """``row_key``: digest of id and text, equal for repeated rows only."""
    return df.withColumn(
        "row_key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")).cast("binary"))
    )


def scan_rows(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Key, id, text, owner and repository; nothing else is read."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
    )
    return row_key(rows)


def spans_of(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, value) of one kind's matches, in code points, end exclusive."""
    pattern, group = F.lit(SEARCH[kind]), VALUE_GROUP[kind]
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(group)) if group else matches
    gaps = F.split(text, SEARCH[kind], -1)
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        lambda r: F.struct(F.length(r["m"]).alias("size"), F.length(r["g"]).alias("gap"), r["v"].alias("value")),
    )
    # The end of a match is the sum of the gaps and matches up to it.
    spans = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out")),
        lambda state, r: F.struct(
            (state["at"] + r["gap"] + r["size"]).alias("at"),
            F.concat(
                state["out"],
                F.array(
                    F.struct(
                        F.lit(kind).alias("kind"),
                        (state["at"] + r["gap"]).alias("start"),
                        (state["at"] + r["gap"] + r["size"]).alias("end"),
                        r["value"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
        lambda state: state["out"],
    )
    long_enough = F.filter(spans, lambda s: F.length(s["value"]) >= LEAST[kind])
    if kind == "key":
        # Mixed tokens only: lower and upper case and at least two digits.
        long_enough = F.filter(
            long_enough,
            lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9][^0-9]*[0-9]"),
        )
    return F.when(text.rlike(SEARCH[kind]), long_enough).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    )


def candidates(rows: DataFrame) -> DataFrame:
    """One row for each span of every text: key, owner, repository, kind, start, end, value hash."""
    found = rows.select(
        "row_key", "owner", "repository", F.explode(F.flatten(F.array(*(spans_of(k, F.col("text")) for k in KINDS)))).alias("s")
    )
    return found.select(
        "row_key", "owner", "repository", "s.kind", "s.start", "s.end", F.md5(F.col("s.value").cast("binary")).alias("value_hash")
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate hash."""
    by_owner = (
        found.select("value_hash", "owner", "repository")
        .distinct()
        .groupBy("value_hash", "owner")
        .agg(F.count("*").alias("repositories"))
    )
    return by_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories")
    )


def classify(found: DataFrame) -> DataFrame:
    """Candidates with their owner and repository counts; ``live`` for owner-specific values.

    Counts meet the candidates on the hash. Values that several owners share are the only hot
    ones, and the join splits them: its other side has one row for each value.
    """
    joined = found.join(ownership(found), "value_hash", "left")
    return joined.withColumn("live", F.col("owners") < COPIED_OWNERS)


def _joined(spans: Column) -> Column:
    texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def scan(documents: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Spans of every document: ``doc_id``, ``text`` and ``spans`` with ownership counts.

    A ``key`` candidate stays only if it is live and no base span covers part of it.
    """
    rows = scan_rows(
        documents, F.col("source") if owner is None else owner, F.col("source") if repository is None else repository
    )
    return rows.select("row_key", "doc_id").join(row_spans(rows), "row_key", "left")


def row_spans(rows: DataFrame) -> DataFrame:
    """``row_key``, ``base_spans`` and ``spans`` of the keys that have candidates."""
    # Written once: the patterns run over the texts for them, and they are counted and classified.
    found = written(candidates(rows).drop_duplicates(["row_key", "kind", "start"]))
    per_row = (
        classify(found)
        .withColumn("rank", F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int"))
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "owners", "repositories", "live"))).alias("all_spans"))
    )
    base = F.filter("all_spans", lambda s: s["kind"] != "key")
    added = F.filter(
        "all_spans",
        lambda s: (s["kind"] == "key")
        & s["live"]
        & ~F.exists(F.col("base_spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return per_row.withColumn("base_spans", base).select(
        "row_key", "base_spans", F.array_sort(F.concat("base_spans", added)).alias("spans")
    )


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans and their verdicts."""
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,owners:bigint,repositories:bigint,live:boolean>>")
    full = scanned.select(
        "doc_id", F.coalesce("base_spans", nothing).alias("base_spans"), F.coalesce("spans", nothing).alias("spans")
    )

    def count(condition):
        return F.size(F.filter("spans", condition)).cast("bigint")

    def of_kind(kind):
        return lambda s: s["kind"] == kind

    return full.select(
        "doc_id",
        *(count(of_kind(kind)).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )


def redact(documents: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """``documents`` with every span replaced: ``[secret]`` for live values, ``[example]`` for copied ones.

    Overlapping spans become one mark, live if any part is. ``n_chars``, where there is one,
    follows the new text; the other columns stay.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("source") if repository is None else repository
    found = row_spans(scan_rows(documents, owner, repository)).select("row_key", "spans")
    # The text meets its spans as part of the row, once.
    keyed = row_key(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            F.struct("*").alias("_row"),
        )
    ).select("row_key", "_row")
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int,live:boolean>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] > s["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["start"].alias("start"),
                        F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"),
                        (F.element_at(out, -1)["live"] | s["live"]).alias("live"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(F.struct(s["start"], s["end"], s["live"])))),
    )
    pieces = F.aggregate(
        merged,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda state, s: F.struct(
            s["end"].alias("at"),
            F.concat(
                state["out"],
                F.substring(text, state["at"] + 1, s["start"] - state["at"]),
                F.when(s["live"], SECRET_MARK).otherwise(EXAMPLE_MARK),
            ).alias("out"),
        ),
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    # The spans grow with the corpus: no broadcast at any size.
    joined = keyed.join(found.hint("merge"), "row_key", "left").withColumn("new_text", F.when(F.col("spans").isNotNull(), pieces))
    columns = []
    for name in documents.columns:
        old = F.col(f"_row.`{name}`")
        if name == "text":
            old = F.coalesce("new_text", old)
        elif name == "n_chars":
            old = F.coalesce(F.length("new_text").cast(documents.schema[name].dataType), old)
        columns.append(old.alias(name))
    return joined.select(*columns)


#: DuckDB SQL for the query's rows.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, row_number() OVER () AS r FROM documents
), raw AS (
  SELECT r, owner, 1 AS rank, 'assign' AS kind, regexp_extract_all(text, '{ASSIGN.replace("'", "''")}') AS m,
         regexp_extract_all(text, '{ASSIGN.replace("'", "''")}', 2) AS v, regexp_split_to_array(text, '{ASSIGN.replace("'", "''")}') AS g FROM d
  UNION ALL
  SELECT r, owner, 2, 'access', regexp_extract_all(text, '{ACCESS}'), regexp_extract_all(text, '{ACCESS}'), regexp_split_to_array(text, '{ACCESS}') FROM d
  UNION ALL
  SELECT r, owner, 3, 'hex', regexp_extract_all(text, '{HEX}'), regexp_extract_all(text, '{HEX}'), regexp_split_to_array(text, '{HEX}') FROM d
  UNION ALL
  SELECT r, owner, 4, 'key', regexp_extract_all(text, '[A-Za-z0-9]+'), regexp_extract_all(text, '[A-Za-z0-9]+'), regexp_split_to_array(text, '[A-Za-z0-9]+') FROM d
), each_match AS (
  SELECT r, owner, rank, kind, unnest(m) AS m, unnest(v) AS v, unnest(list_slice(g, 1, len(m))) AS g, generate_subscripts(m, 1) AS i FROM raw WHERE len(m) > 0
), placed AS (
  SELECT r, owner, rank, kind, v, CAST(sum(length(m) + length(g)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e, length(m) AS n FROM each_match
), found AS (
  SELECT r, owner, rank, kind, v, e - n AS s, e FROM placed
  WHERE length(v) >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 WHEN 'hex' THEN 16 ELSE 20 END
    AND (kind <> 'key' OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9][^0-9]*[0-9]')))
), owned AS (
  SELECT v, count(DISTINCT owner) AS owners FROM found GROUP BY v
), judged AS (
  SELECT f.*, o.owners < {COPIED_OWNERS} AS live FROM found f JOIN owned o USING (v)
), kept AS (
  SELECT * FROM judged j WHERE kind <> 'key' OR (live AND NOT EXISTS (
    SELECT 1 FROM found b WHERE b.r = j.r AND b.kind <> 'key' AND b.s < j.e AND j.s < b.e))
), told AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'key') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN told USING (r)
"""
