"""Near-duplicate groups by a chosen-path set similarity join.

1. Every text becomes its set of word shingles. Texts with equal sets form a class, counted by an
   aggregate that combines before its shuffle; one representative of each class goes on.
2. A representative enters ``trees`` independent trees. At a node it is sent down two branches,
   each named by the value that a hash function, chosen by the node, takes as its minimum over the
   set. Two sets of similarity s part in one branch with probability 1 - s, so a tree loses a pair
   of similarity 0.8 with probability q = (0.2 + 0.8 q)^2 = 0.0625 however deep it gets, and
   ``trees`` trees lose it with q^trees. The number of trees follows from ``recall``.
3. Candidates are pairs of a node whose minima and sizes allow the similarity, verified on whole
   sets. Round one is linear: a node's members, ordered by a further minimum, are compared in
   blocks of ``small``; each proposes its most similar neighbour and the first of its part. The
   verified links are merged into components; a node that lies in one component is settled.
4. Of the nodes that are not, large ones branch again, so a shingle that a third of all documents
   share is split by further ones, unless one component fills them. The rest are compared
   exhaustively in numpy, small ones whole and large ones in blocks of bounded size, every two of
   which meet: first by minima, which leave the members that may be linked to another component,
   then by those members' whole sets. A meeting gives one verified link for every two components
   that have any, so none between components is left out and no group becomes all its pairs.

Defined cases: a null or empty text, or one of blanks, has an empty set and is linked with
nothing; fewer words than a shingle count as one shingle; rows repeated under one ``doc_id`` are
separate texts of one document, linked by their id, and each give a row; a null ``doc_id`` gives a
row with a null component that is never kept or linked; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.batches import blocks, id_and_text, texts, written
from broadsheet.llm.components import connected_components
from broadsheet.session import work_tables

#: The contract of the near-duplicate query: four words, 80 percent.
SHINGLE = 4
PERCENT = 80
RECALL = 1 - 1e-6
BRANCHES = 2
DEPTH = 4
SMALL = 64
#: Minima kept of each set for branching and estimates, 16 bits each.
MINIMA = 128
BLOCK = 512
#: A component that has at least one in this many of a node's members fills it.
COHESIVE = 4
#: Members of a node that one task orders, at most about.
PART = 10_000


def trees_for(recall: float, percent: int = PERCENT, branches: int = BRANCHES) -> int:
    """Trees needed so that a pair at the threshold meets with probability ``recall``."""
    s, q = percent / 100, 0.0
    for _ in range(200):
        q = (1 - s + s * q) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def least_agreeing(recall: float, percent: int = PERCENT) -> int:
    """Equal minima that a pair at the threshold has but for a tenth of what ``recall`` allows to lose."""
    share, below, least = percent / 100, 0.0, 0
    while least < MINIMA:
        below += math.comb(MINIMA, least) * share**least * (1 - share) ** (MINIMA - least)
        if below > (1 - recall) / 10:
            break
        least += 1
    return least


_RNG = np.random.default_rng(20)
XOR = _RNG.integers(0, 2**64, MINIMA, dtype=np.uint64)
ODD = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROOT_XOR = _RNG.integers(0, 2**64, 64, dtype=np.uint64)
ROOT_ODD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        # A blank inside keeps it apart from any single word.
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words) + b" ", 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = h[:n].copy()
    for shift in range(1, width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[shift : n + shift]
    return np.unique(_finish(mixed))


def sets(documents: DataFrame, width: int = SHINGLE, flag: str = "several") -> DataFrame:
    """``set_key``, the whole set as packed 64-bit hashes, and a boolean column of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found = [shingle_set(text, width).tobytes() for text in texts(block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([md5(s).digest() for s in found], pa.binary()), pa.array(found, pa.binary()), block.column(flag)],
                    ["set_key", "shingles", flag],
                )

    rows = documents.select(F.col("text").cast("string").cast("binary").alias("text"), flag)
    return rows.mapInArrow(run, f"set_key binary, shingles binary, {flag} boolean")


def signatures(documents: DataFrame, trees: int, width: int = SHINGLE) -> DataFrame:
    """Set size, set digest, minima, and the two branches of each tree's root."""
    roots = trees * BRANCHES
    if roots > len(ROOT_XOR):
        raise ValueError("too many trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found = [shingle_set(text, width) for text in texts(block)]
                sizes = np.array([len(s) for s in found], np.int64)
                keys = [md5(s.tobytes()).digest() for s in found]
                full = np.flatnonzero(sizes)
                minima = np.zeros((len(found), MINIMA), np.uint16)
                first = np.zeros((len(found), roots), np.uint64)
                if len(full):
                    flat = np.concatenate([found[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(MINIMA):
                        low = np.minimum.reduceat((flat ^ XOR[k]) * ODD[k], starts)
                        minima[full, k] = _finish(low) >> np.uint64(48)
                    for k in range(roots):
                        low = np.minimum.reduceat((flat ^ ROOT_XOR[k]) * ROOT_ODD[k], starts)
                        first[full, k] = _finish(low + np.uint64(k))
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pa.array(sizes),
                        pa.array(keys, pa.binary()),
                        pa.array([row.tobytes() for row in minima], pa.binary()),
                        pa.array(list(first.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "minima", "roots"],
                )

    return id_and_text(documents).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, minima binary, roots array<bigint>"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, MINIMA)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of the rows' nodes: the node's hash chooses which minima name them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy().view(np.uint64)
        minima, rows = _matrix(batch.column("minima")), np.arange(batch.num_rows)
        # Two different functions, chosen by the node.
        one = _finish(node + np.uint64(0x632BE59BD9B4E019)) % np.uint64(MINIMA)
        two = (one + np.uint64(1) + _finish(node ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(MINIMA - 1)) % np.uint64(MINIMA)
        children = [
            _finish(_finish(node ^ minima[rows, at.astype(np.int64)]) + at * np.uint64(0x9E3779B97F4A7C15)) for at in (one, two)
        ]
        out = np.stack(children, axis=1).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out), *(pa.array(np.repeat(batch.column(k).to_numpy(), BRANCHES)) for k in ("rep", "label"))], ["node", "rep", "label"]
        )


PAIRS = "a bigint, b bigint"


def _pairs(a, b) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _likely(minima: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, limits: tuple[int, int]) -> np.ndarray:
    """Equal minima of the row pairs; 0 where the sizes or the minima rule a link out.

    ``limits``: the least number of equal minima, and the threshold in percent.
    """
    least, percent = limits
    agree = (minima[i] == minima[j]).sum(axis=1)
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return np.where((agree >= max(1, least)) & (100 * low >= percent * high), agree, 0)


class _Rows:
    """Columns of sorted rows, with those of an unfinished group kept for the next batch."""

    def __init__(self, keys: tuple[str, ...], others: tuple[str, ...], sketch: str | None = "minima", sets: str | None = None):
        self.keys, self.names, self.sketch, self.sets = keys, (*keys, *others), sketch, sets
        self.columns: dict[str, np.ndarray] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in self.names}
        if self.sketch:
            new[self.sketch] = _matrix(batch.column(self.sketch))
        if self.sets:
            new[self.sets] = np.array([*batch.column(self.sets).to_pylist(), None], object)[:-1]
        self.columns = {k: np.concatenate([self.columns[k], v]) for k, v in new.items()} if self.columns else new

    def groups(self) -> np.ndarray:
        """First rows of the groups."""
        n = len(self.columns[self.keys[0]])
        new = np.ones(n, bool)
        new[1:] = np.any([self.columns[k][1:] != self.columns[k][:-1] for k in self.keys], axis=0)
        return np.flatnonzero(new)

    def keep(self, start: int) -> None:
        self.columns = {k: v[start:] for k, v in self.columns.items()}


def _nearest(small: int, limits: tuple[int, int]):
    """Round one over rows sorted by part of a node."""

    def propose(rows: _Rows, first: np.ndarray, hub: tuple | None) -> pa.RecordBatch:
        c = rows.columns
        rep, size, minima, n = c["rep"], c["size"], c["minima"], len(c["rep"])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        # Blocks start anew in each group.
        block = group * np.int64(n + 1) + (np.arange(n) - first[group]) // small
        best, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(1, small):
            i = np.flatnonzero(block[d:] == block[:-d])
            if not len(i):
                break
            agree = _likely(minima, size, i, i + d, limits)
            for x, y in ((i, i + d), (i + d, i)):
                more = agree > best[x]
                best[x[more]], other[x[more]] = agree[more], rep[y[more]]
        good = best > 0
        head = first[group]
        to_hub = (np.arange(n) > head) & (_likely(minima, size, np.arange(n), head, limits) > 0)
        a, b = [rep[good], rep[to_hub]], [other[good], rep[head[to_hub]]]
        if hub is not None:
            # The first group began in an earlier batch: its first member counts here too.
            mine = np.flatnonzero(group == 0)
            near = _likely(np.vstack([minima[mine], hub[2][None]]), np.append(size[mine], hub[1]), np.arange(len(mine)), np.full(len(mine), len(mine)), limits) > 0
            a.append(rep[mine[near]])
            b.append(np.full(int(near.sum()), hub[0]))
        return _pairs(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, hub = _Rows(("node", "part"), ("rep", "size")), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows.add(batch)
            first = rows.groups()
            yield propose(rows, first, hub)
            last = int(first[-1])
            if last:
                hub = None
            if hub is None:
                hub = (rows.columns["rep"][last], rows.columns["size"][last], rows.columns["minima"][last].copy())
            # The last group's last block may go on.
            rows.keep(last + (len(rows.columns["rep"]) - last - 1) // small * small)

    return run


def _sides(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks that meet; of one block, all rows twice."""
    return np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: _Rows) -> Iterator[tuple[dict, np.ndarray]]:
    """Columns and first rows of complete groups, as the sorted batches complete them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows.add(batch)
        first = rows.groups()
        if first[-1]:
            yield {k: v[: first[-1]] for k, v in rows.columns.items()}, first[:-1]
            rows.keep(int(first[-1]))
    if rows.columns:
        yield rows.columns, rows.groups()


def _open(small: int, limits: tuple[int, int]):
    """Round two, by minima: members that may be linked to one of another component."""

    def mark(c: dict, first: np.ndarray) -> np.ndarray:
        label, size, minima, n = c["label"], c["size"], c["minima"], len(c["rep"])
        counts = np.diff(np.append(first, n))
        group = np.repeat(np.arange(len(first)), counts)
        marked = np.zeros(n, bool)

        def check(i, j):
            i, j = i[label[i] != label[j]], j[label[i] != label[j]]
            for at in range(0, len(i), 50_000):
                x, y = i[at : at + 50_000], j[at : at + 50_000]
                good = _likely(minima, size, x, y, limits) > 0
                marked[x[good]] = marked[y[good]] = True

        few = counts[group] <= small
        for d in range(1, small):
            i = np.flatnonzero((group[d:] == group[:-d]) & few[d:])
            if not len(i):
                break
            check(i, i + d)
        for g in np.flatnonzero(counts > small):
            inside = slice(first[g], first[g] + counts[g])
            low, high = _sides(c["block"][inside])
            for i in low + first[g]:
                check(np.full(len(high), i), high + first[g])
        return marked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, first in _whole_groups(batches, _Rows(("node", "meet"), ("rep", "label", "size", "block"))):
            marked = mark(c, first)
            yield pa.RecordBatch.from_arrays([pa.array(c[k][marked]) for k in OPEN_COLUMNS], OPEN_COLUMNS)

    return run


OPEN_COLUMNS = ["node", "meet", "rep", "label", "block"]


def _exact(percent: int):
    """Round two, by whole sets: one verified link for every two components that have any."""

    def links(label: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        names, counts = np.unique(label, return_counts=True)
        parent = {name: name for name in names.tolist()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        meets = np.zeros((len(sets), 2), bool)
        for side, rows in enumerate(_sides(block)):
            meets[rows, side] = True
        # Of two components one is not the largest: its members look for the others.
        for i in np.flatnonzero(label != names[counts.argmax()]).tolist():
            low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))
            both = np.bincount(owner[at], minlength=len(sets))
            linked = 100 * both >= percent * (sizes + sizes[i] - both)
            linked &= (label != label[i]) & ((meets[i, 0] & meets[:, 1]) | (meets[i, 1] & meets[:, 0]))
            for j in np.flatnonzero(linked).tolist():
                x, y = find(label[i].item()), find(label[j].item())
                if x != y:
                    parent[x] = y
                    yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(("node", "meet"), ("rep", "label", "block"), sketch=None, sets="shingles")
        for c, first in _whole_groups(batches, rows):
            found = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(c["rep"])]):
                sets = [np.frombuffer(s, np.uint64) for s in c["shingles"][a:b]]
                found += [(c["rep"][a + i], c["rep"][a + j]) for i, j in links(c["label"][a:b], c["block"][a:b], sets)]
            yield _pairs([x for x, _ in found], [y for _, y in found])

    return run


def verified(pairs: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"]
            )

    joined = pairs.join(whole.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(
        whole.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(run, PAIRS)


def _counted(level: DataFrame) -> DataFrame:
    """Members of nodes with at least two."""
    sizes = level.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
    return level.join(sizes, "node")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of nodes that lie in several components; ``most``: members of the largest one."""
    labels = members.groupBy("node", "label").agg(F.count("*").alias("n"))
    nodes = labels.groupBy("node").agg(F.count("*").alias("labels"), F.max("n").alias("most")).where("labels > 1")
    return members.join(nodes.select("node", "most"), "node")


def near_groups(
    documents: DataFrame, width: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL, depth: int = DEPTH, small: int = SMALL
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    trees, limits = trees_for(recall, percent), (least_agreeing(recall, percent), percent)
    signed = written(signatures(documents, trees, width))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # A class is named by a 64-bit digest of its set; any member's minima will do.
    by_class = full.select("doc_id", F.xxhash64("set_key").alias("rep"))
    reps = written(
        full.groupBy(F.xxhash64("set_key").alias("rep")).agg(
            F.first("minima").alias("minima"), F.first("roots").alias("roots"), F.first("n_shingles").alias("size")
        )
    )
    sketch = reps.select("rep", "minima", "size")
    roots = written(_counted(reps.select(F.explode("roots").alias("node"), "rep")))

    # Members of a large node are spread by a further minimum, and by hash where many share it.
    at = F.pmod("node", F.lit(MINIMA)).cast("int") * 2 + 1
    further = F.xxhash64(F.substring("minima", at, 2), F.pmod(F.xxhash64("node", "rep"), F.ceil(F.col("members") / PART)))
    parted = roots.join(sketch, "rep").withColumn("part", F.when(F.col("members") > small, further).otherwise(0))
    pairs = written(
        parted.select("node", "part", "rep", "size", "minima")
        .repartition("node", "part")
        .sortWithinPartitions("node", "part", "rep")
        .mapInArrow(_nearest(small, limits), PAIRS)
        .distinct()
    )

    # Whole sets, written once, of all that may still be in a candidate pair.
    wanted = (
        pairs.select(F.col("a").alias("rep"))
        .union(pairs.select("b"))
        .union(roots.where(F.col("members") > small).select("rep"))
        .distinct()
    )
    inside = written(by_class.join(wanted, "rep", "left_semi").groupBy("rep").agg(F.min("doc_id").alias("doc_id")))
    # An id of a single row gives its class's set and no other; only sets of further ids are sorted out.
    rows_of = signed.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    chosen = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        inside.select("doc_id").distinct().join(rows_of, "doc_id"), "doc_id"
    )
    found = written(sets(chosen, width).select(F.xxhash64("set_key").alias("rep"), "shingles", "several"))
    doubtful = found.where("several").select("rep", "shingles").join(inside.select("rep"), "rep", "left_semi")
    certain = found.where("not several").select("rep", "shingles")
    whole = certain.union(written(doubtful.join(certain.select("rep"), "rep", "left_anti").drop_duplicates(["rep"])))
    # Texts of one id belong together whatever their similarity.
    several = by_class.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high")
    same_id = several.join(by_class.distinct(), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    links = written(verified(pairs, whole, percent).union(same_id))
    labels = connected_components(links)

    named = labels.select(F.col("id").alias("rep"), F.col("component").alias("label"))
    level = roots.join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rest = None
    for step in range(depth + 1):
        # A node that one component fills would not get smaller by branching.
        stays = F.lit(step == depth) | (F.col("members") <= small) | (COHESIVE * F.col("most") >= F.col("members"))
        level = written(_mixed(level).select("node", "rep", "label", "members", stays.alias("stays")))
        ready = level.where("stays").drop("stays")
        rest = ready if rest is None else rest.union(ready)
        large = level.where("not stays")
        if step == depth or large.isEmpty():
            break
        level = _counted(large.join(sketch, "rep").select("node", "rep", "label", "minima").mapInArrow(_branch, "node bigint, rep bigint, label bigint").distinct())
    n_blocks = F.when(F.col("members") > small, F.ceil(F.col("members") / BLOCK)).otherwise(1).cast("int")
    placed = rest.join(sketch, "rep").withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    # Every two blocks of a large node meet in one group of bounded size.
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn(
        "meet", F.least("block", "other") * F.lit(1 << 31).cast("bigint") + F.greatest("block", "other")
    )
    unsettled = (
        met.select("node", "meet", "rep", "label", "size", "block", "minima")
        .repartition("node", "meet")
        .sortWithinPartitions("node", "meet", "block", "rep")
        .mapInArrow(_open(small, limits), "node bigint, meet bigint, rep bigint, label bigint, block int")
    )
    more = written(
        unsettled.join(whole, "rep")
        .repartition("node", "meet")
        .sortWithinPartitions("node", "meet", "block", "rep")
        .mapInArrow(_exact(percent), PAIRS)
        .distinct()
    )
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    # The component's id is its smallest document.
    of_rep = by_class.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    least = of_rep.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_rep = of_rep.select("rep", "component").distinct().join(least, "component").select("rep", "component_id")
    keyed = signed.select("doc_id", "n_shingles", F.xxhash64("set_key").alias("rep"))
    out = keyed.join(by_rep, "rep", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each group, the one with the least id; columns stay as they are.

    A kept id keeps each of its distinct texts once; of rows that differ in other columns only, the
    one with the least digest of all columns. Rows without an id or without words stay. Repeated
    rows are found on ids and digests of all rows, so texts move once, to meet the kept ids, unless
    a row repeats another's. Work tables are removed but for the two that the result reads.
    """
    with work_tables(documents.sparkSession) as keep:
        groups = near_groups(documents)
        # Written, since the rows are met with it more than once; the tables it came from go.
        kept = keep(written(groups.where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()))
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    whole = F.sha2(F.to_json(F.struct(*documents.columns)).cast("binary"), 256)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_text", F.unhex(text)).withColumn("_whole", F.unhex(whole))

    with_id = documents.where("doc_id is not null")
    again = written(
        keyed(with_id)
        .groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_same"))
        .agg(F.count("*").alias("_n"), F.min("_whole").alias("_first"))
        .where("_n > 1")
    )
    # The ids grow with the corpus: no broadcast at any size.
    named = with_id.join(kept.hint("merge"), F.col("doc_id").cast("bigint") == F.col("_kept_id"), "left_semi")
    if not again.isEmpty():
        same = (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_same"))
        single = keyed(named).join(again, same, "left_anti")
        first = keyed(named).join(again, same & (F.col("_whole") == F.col("_first"))).drop_duplicates(["doc_id", "_text"])
        named = single.select(documents.columns).union(first.select(documents.columns))
    return named.union(documents.where("doc_id is null"))
