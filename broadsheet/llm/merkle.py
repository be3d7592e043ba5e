"""Merkle manifest of a dataset by bitmap-rank indexing.

Every row is a leaf, the SHA-256 of its columns. The leaves of a source ascend by document id; runs
of three become their parent's digest until one node, the source's subroot, remains. Subroots in
the order of their sources give the dataset's root in the same way.

A leaf's place is found by rank, not by sorting leaves. Ids are cut into containers of 65,536 by
their upper bits. Each Arrow batch turns its ids into compressed bitmaps (sorted 16-bit numbers
while these are shorter), which are merged by source and container, in two rounds so that no task
gets all pieces of one container. A directory over containers, and over ranges of containers where
ids reach far, holds how many ids come before; inside a container a directory of popcounts does.
A rank is the sum of the three. Ids that occur more than once carry counts beside the bitmap.

Levels are reduced in slot arrays: nodes are keyed by their place divided by ``BLOCK`` and lie in an
array at the remainder, where six levels are folded at once, so a source of n leaves needs
log n / log 729 groupings of bounded groups, and a source with a third of all rows is cut into blocks
like any other. Proofs come down the same blocks: a block's proof is computed once and each of its
nodes adds the siblings inside the block.

Defined cases: null columns are written ``-``; rows without an id come before all ids; repeated ids
are leaves of their own, ordered by leaf digest, and equal rows take neighbouring places in any
order; a null source is a source of its own and the first one; a row without an id is not tampered
with; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.llm.batches import written
from broadsheet.operators.ranking import global_positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels folded in one slot array.
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
CONTAINER_BITS = 16
CONTAINER = 1 << CONTAINER_BITS
#: Pieces of a container are merged in so many groups first.
MERGE_GROUPS = 64
#: Container of rows without an id: below all others.
NO_ID = -(1 << 47) - 1

_PIECE = "key string, hi bigint, bits binary, more_low array<int>, more_n array<bigint>, n bigint"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# Leaves


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_of(columns: list[Column]) -> Column:
    """SHA-256 of a row: each column as its length in bytes, a colon and its text."""
    return F.sha2(F.concat(*map(_field, columns)).cast("binary"), 256)


def source_key(source: Column) -> Column:
    """A source as a string that is never null; sorts as sources do, null first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def leaves(documents: DataFrame) -> DataFrame:
    """``key``, ``doc_id``, ``hi``, ``low``, ``leaf`` and ``tampered``, null where nothing changes; written once."""
    rows = documents.select(*[F.col(name) for name in FIELDS])
    columns = [F.col(name) for name in FIELDS]
    changes = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    bare = leaf_of([*columns[:-1], F.replace("text", F.lit("\n"), F.lit(""))])
    doc_id = F.col("doc_id").cast("bigint")
    placed = rows.select(
        source_key(F.col("source")).alias("key"),
        doc_id.alias("doc_id"),
        F.coalesce(F.shiftright(doc_id, CONTAINER_BITS), F.lit(NO_ID)).alias("hi"),
        F.coalesce(doc_id.bitwiseAND(CONTAINER - 1), F.lit(0)).cast("int").alias("low"),
        leaf_of(columns).alias("leaf"),
        F.when(changes, bare).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(placed)


# Bitmaps and ranks


def pack(lows: np.ndarray) -> bytes:
    """Distinct ascending numbers of a container, as a sorted list or a bitmap, whichever is shorter."""
    if 16 * len(lows) < CONTAINER:
        return b"A" + lows.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, np.uint8)
    bits[lows] = 1
    return b"B" + zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def unpack_words(data: bytes) -> np.ndarray:
    """The bitmap as 64-bit words."""
    if data[:1] == b"B":
        return np.frombuffer(zlib.decompress(data[1:]), "<u8")
    bits = np.zeros(CONTAINER, np.uint8)
    bits[np.frombuffer(data, "<u2", offset=1)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _members(data: bytes) -> np.ndarray:
    if data[:1] == b"A":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(unpack_words(data).view(np.uint8), bitorder="little"))


class Container:
    """Rank queries on one container: places before each 64-bit word, then bits before the id's own."""

    def __init__(self, data: bytes, more_low, more_n):
        self.words = unpack_words(data)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.directory = np.cumsum(count) - count
        self.more_low = np.asarray([] if more_low is None else more_low, np.int64)
        self.more_before = np.concatenate([[0], np.cumsum(np.asarray([] if more_n is None else more_n, np.int64))])

    def rank(self, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with smaller ids, and how many rows have the id itself."""
        lows = lows.astype(np.int64)
        word, bit = lows >> 6, (lows & 63).astype(np.uint64)
        inside = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        first, after = (np.searchsorted(self.more_low, lows, side) for side in ("left", "right"))
        before = self.directory[word] + inside + self.more_before[first]
        return before, 1 + self.more_before[after] - self.more_before[first]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each batch as one bitmap for each container."""
    for batch in batches:
        found = [
            _piece(key, hi, *np.unique(lows.to_numpy(np.int64), return_counts=True))
            for (key, hi), lows in batch.to_pandas().groupby(["key", "hi"])["low"]
        ]
        yield from _as_batch(found)


def _piece(key: str, hi: int, lows: np.ndarray, times: np.ndarray) -> tuple:
    several = times > 1
    return key, int(hi), pack(lows), lows[several].tolist(), (times[several] - 1).tolist(), int(times.sum())


def _as_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
    names = [field.split()[0] for field in _PIECE.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(values, t) for values, t in zip(zip(*rows), types)], names)


def _merge(pieces: pd.DataFrame) -> pd.DataFrame:
    """One container from its pieces; holds one count for each possible id, however many pieces there are."""
    times = np.zeros(CONTAINER, np.int64)
    for data, more_low, more_n in zip(pieces["bits"], pieces["more_low"], pieces["more_n"]):
        times[_members(data)] += 1
        times[np.asarray(more_low, np.int64)] += np.asarray(more_n, np.int64)
    lows = np.flatnonzero(times)
    row = _piece(pieces["key"].iloc[0], pieces["hi"].iloc[0], lows, times[lows])
    return pd.DataFrame([row], columns=[field.split()[0] for field in _PIECE.split(", ")])


def containers(rows: DataFrame) -> DataFrame:
    """Bitmap index of the ids of every source: a row for each container, written once."""
    pieces = rows.select("key", "hi", "low").mapInArrow(_pieces, _PIECE).withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
    some = pieces.groupBy("key", "hi", "part").applyInPandas(_merge, _PIECE)
    return written(some.groupBy("key", "hi").applyInPandas(_merge, _PIECE))


def directory(index: DataFrame) -> DataFrame:
    """``key``, ``hi``, ``start`` (rows of the source in lower containers) and ``total`` (rows of the source).

    A directory's node has at most 65,536 children; where containers reach further, nodes have nodes
    above them, for 64-bit ids three levels in all.
    """
    low, high = index.agg(F.min("hi"), F.max("hi")).first()
    level, tables = index.select("key", F.col("hi").alias("node"), "n"), []
    while True:
        whole = low is None or high - low < CONTAINER
        level = level.withColumn("above", F.lit(0).cast("bigint") if whole else F.shiftright("node", CONTAINER_BITS))
        before = Window.partitionBy("key", "above").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        tables.append(level.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
        level = level.groupBy("key", "above").agg(F.sum("n").alias("n")).withColumnRenamed("above", "node")
        if whole:
            break
        low, high = low >> CONTAINER_BITS, high >> CONTAINER_BITS
    starts = level.select("key", F.col("node").alias("above"), F.lit(0).cast("bigint").alias("base"), F.col("n").alias("total"))
    for table in reversed(tables):
        starts = table.join(starts, ["key", "above"]).select("key", F.col("node").alias("above"), (F.col("base") + F.col("before")).alias("base"), "total")
    return starts.withColumnsRenamed({"above": "hi", "base": "start"})


_RANKED = "key string, doc_id bigint, hi bigint, low int, leaf string, tampered string, row bigint, idx bigint, n bigint, times bigint"


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of leaves; every container comes before the leaves that ask it."""
    held: tuple[Container, int, int] | None = None
    for batch in batches:
        is_container = np.asarray(batch.column("bits").is_valid())
        cuts = np.flatnonzero(is_container).tolist()
        for begin, end in zip([0, *(cut + 1 for cut in cuts)], [*cuts, batch.num_rows]):
            if begin and is_container[begin - 1]:
                row = batch.slice(begin - 1, 1).to_pylist()[0]
                held = Container(row["bits"], row["more_low"], row["more_n"]), row["start"], row["total"]
            if begin < end:
                part = batch.slice(begin, end - begin)
                index, start, total = held
                before, times = index.rank(part.column("low").to_numpy())
                names = [field.split()[0] for field in _RANKED.split(", ")[:7]]
                columns = [part.column(name) for name in names]
                columns += [pa.array(start + before), pa.array(np.full(len(before), total)), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "idx", "n", "times"])


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``idx``, the place among the source's leaves, and ``n``, their number; written once."""
    index = containers(rows)
    starts = directory(index)
    asked = index.join(starts, ["key", "hi"]).withColumn("parts", F.ceil(F.col("n") / CONTAINER).cast("int"))
    # A container of many repeated rows is asked in as many parts as keep to a container's size.
    several = asked.where("parts > 1").select("key", "hi", "parts")
    part = F.lit(0)
    if not several.isEmpty():
        rows = rows.join(several, ["key", "hi"], "left")
        part = F.pmod("row", F.coalesce("parts", F.lit(1))).cast("int")
    questions = rows.select("key", "hi", part.alias("part"), "doc_id", "low", "leaf", "tampered", "row")
    answers = asked.select("key", "hi", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "bits", "more_low", "more_n", "start", "total")
    both = questions.unionByName(answers, allowMissingColumns=True)
    dealt = both.repartition("key", "hi", "part").sortWithinPartitions("key", "hi", "part", F.col("bits").isNull())
    ranked = written(dealt.mapInArrow(_ranks, _RANKED))
    again = ranked.where("times > 1")
    if again.isEmpty():
        return ranked.drop("hi", "low", "times")
    # Rows of one id: their order is that of their digests, found in one range-partitioned sort.
    ordered = global_positions(again, ["key", "idx", "leaf", "row"], "at")
    first = ordered.groupBy("key", "idx").agg(F.min("at").alias("first"))
    moved = ordered.join(first, ["key", "idx"]).withColumn("idx", F.col("idx") + F.col("at") - F.col("first")).select(ranked.columns)
    return written(ranked.where("times = 1").union(moved)).drop("hi", "low", "times")


# Slot arrays


def _levels(n: int) -> int:
    """Levels that a slot array folds where a tree has ``n`` nodes left."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _after(n: int) -> int:
    """Nodes left once slot arrays have been folded."""
    return -(-n // BLOCK)


def _runs(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a slot array at every level, its own first."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[at : at + ARITY])) for at in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], slot: int) -> list[str]:
    """What stands left and right of a slot's node in its run, level by level."""
    path = []
    for nodes in levels[:-1]:
        start = slot - slot % ARITY
        path += ("".join(nodes[start:slot]), "".join(nodes[slot + 1 : start + ARITY]))
        slot //= ARITY
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for at in range(0, len(path), 2):
        leaf = digest(path[at] + leaf + path[at + 1])
    return leaf


def _slots(block: pd.DataFrame, of: str) -> list[str]:
    nodes = np.empty(len(block), object)
    nodes[(block["idx"] % BLOCK).to_numpy()] = block[of].to_numpy()
    return nodes.tolist()


def _up(block: pd.DataFrame) -> pd.DataFrame:
    first = block.iloc[0]
    n = int(first["n"])
    top = _runs(_slots(block, "leaf"), _levels(n))[-1]
    return pd.DataFrame({"key": [first["key"]], "idx": [int(first["idx"]) // BLOCK], "leaf": top, "n": [_after(n)]})


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (key, idx, leaf, n) and what each round of slot arrays leaves, up to one node for each key."""
    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        blocked = tables[-1].select("key", "idx", "leaf", "n").groupBy("key", (F.col("idx") / BLOCK).cast("bigint"))
        tables.append(written(blocked.applyInPandas(_up, "key string, idx bigint, leaf string, n bigint")))
        most = _after(most)
    return tables


_PATH = "key string, idx bigint, subroot string, root string, path array<string>"


def _with_parent(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series, list[list[str]]]:
    """The nodes of a block, their parent's row, and their digests at every level."""
    own = block["leaf"].notna()
    parent, nodes = block[~own].iloc[0], block[own]
    return nodes, parent, _runs(_slots(nodes, "leaf"), _levels(int(nodes["n"].iloc[0])))


def _down(block: pd.DataFrame) -> pd.DataFrame:
    nodes, parent, levels = _with_parent(block)
    above = list(parent["path"])
    paths = [siblings(levels, idx % BLOCK) + above for idx in nodes["idx"].tolist()]
    return pd.DataFrame({"key": parent["key"], "idx": nodes["idx"].to_numpy(), "subroot": parent["subroot"], "root": parent["root"], "path": paths})


_PROVEN = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(block: pd.DataFrame) -> pd.DataFrame:
    nodes, parent, levels = _with_parent(block)
    above, root = list(parent["path"]), parent["root"]
    proofs, folded = [], []
    for idx, leaf, tampered in zip(nodes["idx"].tolist(), nodes["leaf"], nodes["tampered"]):
        path = siblings(levels, idx % BLOCK) + above
        proofs.append(digest("".join(path)))
        folded.append(fold(leaf if tampered is None else tampered, path))
    return pd.DataFrame(
        {
            "doc_id": nodes["doc_id"].to_numpy(),
            "leaf": nodes["leaf"].to_numpy(),
            "subroot": parent["subroot"],
            "root": root,
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [value == root for value in folded],
        }
    )


def _joined(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes and their parents' rows, to be grouped by ``key`` and ``block``."""
    below = nodes.withColumn("block", (F.col("idx") / BLOCK).cast("bigint"))
    above = parents.withColumn("block", F.col("idx"))
    return below.unionByName(above, allowMissingColumns=True)


def descend(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Proofs of the nodes of ``tables[0]``, from those of ``tables[-1]``."""

    def step(parents: DataFrame, nodes: DataFrame) -> DataFrame:
        return _joined(nodes.select("key", "idx", "leaf", "n"), parents).groupBy("key", "block").applyInPandas(_down, _PATH)

    return reduce(step, reversed(tables[:-1]), paths)


def manifest(documents: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether its proof still holds once tampered with."""
    levels = climb(coordinates(leaves(documents)))
    subroots = levels[-1].select(F.col("key").alias("source_key"), F.col("leaf"))
    # Sources are few next to rows; their order is a sort of one row for each.
    placed = global_positions(subroots, ["source_key"], "at")
    n_sources = placed.count()
    if not n_sources:
        return documents.sparkSession.createDataFrame([], _PROVEN.replace("doc_id string", "doc_id bigint"))
    top = placed.select(F.lit("").alias("key"), (F.col("at") - 1).alias("idx"), "leaf", F.lit(n_sources).cast("bigint").alias("n"), "source_key")
    tops = climb(top)
    root = tops[-1].select("leaf").first()[0]
    none = F.array().cast("array<string>")
    ends = tops[-1].select("key", "idx", F.lit(root).alias("subroot"), F.lit(root).alias("root"), none.alias("path"))
    over = descend(tops, ends).select("idx", "root", "path")
    of_source = top.join(over, "idx").select(
        F.col("source_key").alias("key"), F.lit(0).cast("bigint").alias("idx"), F.col("leaf").alias("subroot"), "root", "path"
    )
    # Where every source is a single leaf there is no round between leaves and subroots.
    above = descend(levels[1:], of_source) if len(levels) > 1 else of_source
    # As text: a column of numbers with nulls would reach pandas as floats.
    nodes = levels[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    proven = _joined(nodes, above).groupBy("key", "block").applyInPandas(_prove, _PROVEN)
    return proven.withColumn("doc_id", F.col("doc_id").cast("bigint"))


# The same in SQL, level by level


def _sql(levels: int, top_levels: int) -> str:
    """Root, proofs and tampering in DuckDB, for at most ``3 ** levels`` leaves of a source."""

    def row(text: str) -> str:
        values = {name: f"CAST({name} AS VARCHAR)" for name in FIELDS} | {"text": text}
        parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE CONCAT(strlen({v}), ':', {v}) END" for v in values.values()]
        return f"sha256({' || '.join(parts)})"

    ctes = [
        """crc_table AS MATERIALIZED (SELECT list(list_reduce(list_concat([i], range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i))""",
        f"""leaves AS MATERIALIZED (SELECT doc_id, coalesce('+' || source, '') AS key, {row('text')} AS leaf,
            CASE WHEN doc_id IS NULL OR xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 1 OR text IS NULL THEN NULL
            ELSE {row("replace(text, chr(10), '')")} END AS tampered FROM documents, crc_table)""",
        """n0 AS MATERIALIZED (SELECT row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
            doc_id, key, leaf AS node, tampered FROM leaves)""",
    ]

    def climbing(name: str, count: int) -> None:
        for level in range(count):
            # A node alone at its level is the root of its tree and stays.
            ctes.append(
                f"""{name}{level + 1} AS MATERIALIZED (SELECT key, idx // 3 AS idx,
                    CASE WHEN any_value(total) > 1 THEN sha256(string_agg(node, '' ORDER BY idx)) ELSE any_value(node) END AS node
                FROM (SELECT *, count(*) OVER (PARTITION BY key) AS total FROM {name}{level}) GROUP BY ALL)"""
            )
            ctes.append(
                f"""{name}_beside{level} AS MATERIALIZED (SELECT a.key, a.idx, count(*) > 1 OR a.idx > 0 OR any_value(a.total) > 1 AS paired,
                    coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
                    coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS behind
                FROM (SELECT *, count(*) OVER (PARTITION BY key) AS total FROM {name}{level}) AS a
                JOIN {name}{level} AS b ON a.key = b.key AND a.idx // 3 = b.idx // 3 GROUP BY a.key, a.idx)"""
            )

    climbing("n", levels)
    ctes.append(f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key) - 1 AS idx, '' AS key, key AS source_key, node FROM n{levels})")
    climbing("m", top_levels)
    ctes.append("p0 AS (SELECT n0.*, coalesce(tampered, n0.node) AS folded, '' AS path, m0.idx AS source_no, m0.node AS subroot FROM n0 JOIN m0 ON n0.key = m0.source_key)")
    step = 0
    for name, place, count in (("n", "idx", levels), ("m", "source_no", top_levels)):
        for level in range(count):
            key = "p.key = s.key AND " if name == "n" else ""
            ctes.append(
                f"""p{step + 1} AS MATERIALIZED (SELECT p.* REPLACE (
                    CASE WHEN paired THEN sha256(before || folded || behind) ELSE folded END AS folded, path || before || behind AS path)
                FROM p{step} AS p JOIN {name}_beside{level} AS s ON {key}p.{place} // {3**level} = s.idx)"""
            )
            step += 1
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, node AS leaf, subroot, root, sha256(path) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p{step}, (SELECT node AS root FROM m{top_levels}) AS top"""


SQL = _sql(levels=8, top_levels=5)
