from __future__ import annotations

import random
import zlib
from hashlib import sha256
from itertools import groupby

import numpy as np
import pytest

from broadsheet.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, row string, idx string, leaf string, key string"


def h(text):
    return sha256(text.encode()).hexdigest()


def tree(nodes):
    """Root and each node's siblings with their side, level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, place in zip(paths, places):
            start = place // 3 * 3
            path.append((nodes[start:place], nodes[place + 1 : start + 3]))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        places = [place // 3 for place in places]
    return nodes[0], paths


def brute(rows):
    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def order(row):
        return (row[1] is not None, (row[1] or "").encode(), row[0] is not None, row[0] or 0, leaf(row))

    rows = sorted(rows, key=order)
    sources = [list(g) for _, g in groupby(rows, key=lambda row: row[1])]
    trees = [tree([leaf(row) for row in own]) for own in sources]
    root, top = tree([subroot for subroot, _ in trees]) if trees else ("", [])
    out = []
    for own, (subroot, paths), above in zip(sources, trees, top):
        for row, path in zip(own, paths):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].replace("\n", ""))
            node = leaf(changed)
            for left, right in path + above:
                node = h("".join([*left, node, *right]))
            proof = h("".join("".join([*left, *right]) for left, right in path + above))
            out.append((row[0], leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def result(spark, rows, parts=3):
    df = spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], SCHEMA).repartition(parts)
    return sorted((tuple(row) for row in merkle.manifest(df).collect()), key=repr)


def test_pack_and_rank():
    rng = random.Random(2)
    for size in (0, 1, 5, 4_095, 4_096, 40_000, 65_536):
        lows = np.array(sorted(rng.sample(range(65_536), size)), np.int64)
        again = sorted(rng.sample(lows.tolist(), size // 3))
        box = merkle.Container(merkle.pack(lows), again, [2] * len(again))
        assert merkle._members(merkle.pack(lows)).tolist() == lows.tolist()
        before, times = box.rank(lows)
        every = np.sort(np.concatenate([lows, np.repeat(np.array(again, np.int64), 2)]))
        assert before.tolist() == np.searchsorted(every, lows).tolist()
        assert times.sum() == len(every)


def test_large_and_small_sources(spark):
    rng = random.Random(4)
    rows = [(i, "large" if i % 3 else f"s{i % 11}", "en", i, f"a\n{rng.random()}" if i % 2 else "plain") for i in range(1_700)]
    rows += [(5_000, "alone", "en", 1, "x\ny"), (5_001, None, "en", 1, "x\ny"), (5_002, "", "en", 1, "é\n漢"), (5_003, "two", "en", 1, None), (5_004, "two", None, None, "")]
    assert result(spark, rows, 5) == brute(rows)


def test_edges(spark):
    rows = [(i * 1_000_003 * (-1) ** i, "far", "en", 1, f"\n{i}") for i in range(40)]
    rows += [(2**62 + i, "far", "en", 1, "\n") for i in range(5)] + [(-(2**63), "far", "en", 1, "\n"), (2**63 - 1, "far", "en", 1, "\n")]
    rows += [(7, "again", "en", 1, f"t\n{i}") for i in range(800)] + [(7, "again", "en", 1, "same\n")] * 30 + [(8, "again", "en", 1, "z"), (6, "again", "en", 1, "z")]
    rows += [(None, "far", "en", 1, f"no id {i}") for i in range(4)] + [(None, None, None, None, None)] * 3 + [(9, "long", "en", 1, "word\n" * 50_000)]
    rows += [(1, "ä", "en", 1, "a"), (1, "z", "en", 1, "a"), (1, "+", "en", 1, "a")]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_few_rows(spark, n):
    rows = [(i, "s", "en", 1, "a\nb") for i in range(n)]
    assert result(spark, rows) == brute(rows)
    assert n == 0 or result(spark, [(i, f"s{i}", "en", 1, "a\nb") for i in range(n)]) == brute([(i, f"s{i}", "en", 1, "a\nb") for i in range(n)])


def test_container_with_more_rows_than_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CONTAINER", 1 << 16)
    rows = [(3, "hot", "en", i % 50, "a\n") for i in range(66_000)] + [(i, "hot", "en", 1, "b\n") for i in range(9)]
    found = result(spark, rows, 4)
    assert found == brute(rows)


def test_sf_documents(sf_docs, spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in sf_docs.collect()]
    assert sorted((tuple(r) for r in merkle.manifest(sf_docs).collect()), key=repr) == brute(rows)
