from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

from broadsheet.llm import near
from broadsheet.llm.components import connected_components
from broadsheet.session import checkpoint_dir
from tests.llm.conftest import EDGE_ROWS


def brute(rows, width=4, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(text, every, mark):
    return " ".join(w if k % every else mark for k, w in enumerate(text.split(), 1))


@pytest.fixture(scope="module")
def rows(words):
    rows, n = [], 0
    for base in range(40):
        text = words(60 + base, base)
        for copy in range(1 + base % 4):
            rows.append((n, edited(text, 25 + base, f"mark{copy % 3}") if copy else text))
            n += 1
    hot = words(120, 999)
    rows += [(1000 + k, edited(hot, 61 + k % 7, f"x{k}")) for k in range(90)]
    rows += [(2000 + k, hot.upper()) for k in range(30)]
    return rows + [(3000, "a b c"), (3001, "A B C"), (3002, "a b"), (3003, None), (3004, ""), (3005, " ")]


@pytest.mark.parametrize("small, depth", [(64, 4), (8, 2)])
def test_groups_equal_brute_force(make_docs, rows, small, depth):
    got = near.near_groups(make_docs(rows), small=small, depth=depth).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_other_thresholds(make_docs, words):
    base = [words(90, k) for k in range(12)]
    rows = [(10 * k + c, edited(text, 8 + c, f"m{c}")) for k, text in enumerate(base) for c in range(5)]
    for percent in (60, 90):
        got = near.near_groups(make_docs(rows), percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, percent=percent)
    assert near.least_agreeing(1 - 1e-6) == 77 and near.least_agreeing(1 - 1e-6, 40) < 40


def test_edge_rows(make_docs):
    got = Counter(tuple(r) for r in near.near_groups(make_docs(EDGE_ROWS)).collect())
    assert got[(6, 1, 6, True)] == 2 and got[(1, 0, 1, True)] == got[(3, 0, 3, True)] == 1
    assert got[(None, 2, None, False)] == 1 and got[(8, 1, 8, True)] == 1
    assert near.near_groups(make_docs([])).count() == 0


def test_texts_under_one_id_are_linked(make_docs, words):
    rows = [(1, words(50, 1)), (2, words(50, 2)), (3, words(50, 1)), (3, words(50, 2))]
    assert {(r.doc_id, r.component_id) for r in near.near_groups(make_docs(rows)).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_stage_keeps_one_of_each_group(make_docs, rows):
    docs = make_docs(rows + [(None, "no id"), (0, rows[0][1])])
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    want = Counter(i for i, (_, _, first) in brute(rows).items() if first) + Counter([None])
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_stage_keeps_distinct_texts_of_an_id(spark, make_docs, words):
    one, other = words(40, 1), words(40, 2)
    docs = make_docs([(1, one), (1, other), (1, one), (2, other), (3, words(40, 3))])
    assert sorted((r.doc_id, r.text) for r in near.keep_first(docs).collect()) == sorted([(1, one), (1, other), (3, words(40, 3))])
    plain = spark.createDataFrame([(7, "a b c d e", "y"), (7, "a b c d e", "x"), (7, "a b c d e", "x")], "doc_id int, text string, other string")
    assert near.keep_first(plain).count() == 1
    assert near.keep_first(plain).first() == near.keep_first(plain.repartition(3)).first()


def test_stage_leaves_only_the_tables_its_result_reads(spark, make_docs, rows):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    kept = near.keep_first(make_docs(rows))
    assert len({*folder.glob("*")} - before) <= 2
    assert kept.count() == sum(first for _, _, first in brute(rows).values())


def test_sets_of_ids_with_several_texts(make_docs, words):
    base = [words(60, k) for k in range(6)]
    rows = [(10 * k, text) for k, text in enumerate(base)] + [(10 * k + 1, edited(text, 50, "x")) for k, text in enumerate(base)]
    # Ids that also have an empty text, the same text, another's text, and one that is linked with nothing.
    rows += [(0, ""), (10, base[1]), (20, base[0]), (31, words(60, 99)), (40, None)]
    got = {(r.doc_id, r.component_id) for r in near.near_groups(make_docs(rows)).collect() if r.n_shingles}
    assert got == {(0, 0), (1, 0), (20, 0), (21, 0), (10, 10), (11, 10), (30, 30), (31, 30), (40, 40), (41, 40), (50, 50), (51, 50)}


def test_trees_reach_the_recall():
    assert near.trees_for(1 - 1e-6) == 5 and near.trees_for(0.9) == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 2), (9, 8), (8, 7), (5, 5)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + k: 100 for k in range(41)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
