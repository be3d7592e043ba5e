from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from broadsheet.llm import simhash
from tests.llm.conftest import EDGE_ROWS


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    found = [xxhash.xxh64(gram.encode(), seed=42).intdigest() for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in found) > len(found))


def brute(rows):
    """Fingerprint and class of each row, by comparing all distinct fingerprints."""
    prints = [brute_print(text) for _, text in rows]
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return sorted(((i, f"{p:016x}", least.get(root(p))) for (i, _), p in zip(rows, prints)), key=repr)


def result(docs):
    return sorted((tuple(row) for row in simhash.simhash_groups(docs).collect()), key=repr)


def test_code_is_perfect_and_near_codewords_are_all():
    words = np.array(random.Random(3).sample(range(1 << 23), 200))
    code = np.array([m << 11 | simhash._remainder(m << 11) for m in range(1 << 12)])
    for word, found in zip(words, simhash.near_codewords(words)):
        away = np.bitwise_count(code ^ word)
        assert (away <= 3).sum() == 1 and found[0] == code[away <= 3][0] >> 11
        assert {i for i in found.tolist() if i >= 0} == set((code[away <= 4] >> 11).tolist())


def test_every_error_pattern_shares_a_key():
    rng = random.Random(5)
    patterns = [p for n in range(1, 4) for p in combinations(range(64), n)]
    for places in rng.sample(patterns, 3_000) + [p for p in patterns if len(p) < 3][:500]:
        one = rng.getrandbits(64)
        other = one ^ sum(1 << place for place in places)
        _, filed, nearest = simhash.fingerprint_keys(np.array([one], np.uint64))
        _, sought, _ = simhash.fingerprint_keys(np.array([other], np.uint64))
        assert set(filed[nearest].tolist()) & set(sought.tolist())


def test_links_are_all_close_pairs(spark):
    rng = random.Random(9)
    centers = [rng.getrandbits(64) for _ in range(40)]
    prints = set(centers)
    for center in centers:
        for _ in range(30):
            prints.add(center ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 7))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    found = {tuple(row) for row in simhash.links(spark.createDataFrame([(p,) for p in signed], "print bigint")).collect()}
    wanted = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == wanted and len(wanted) > 500


def test_groups_equal_brute_force(make_docs, words):
    rng = random.Random(21)
    rows = [(i, words(rng.randrange(1, 300), i % 40)) for i in range(120)]
    for i in range(120, 260):
        own = rows[i % 7][1].split() + words(200, i % 7).split()
        own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own).upper() if i % 2 else "\n".join(own)))
    rows += EDGE_ROWS + [(900, None), (901, ""), (None, None), (902, rows[0][1]), (3, rows[0][1])]
    assert result(make_docs(rows)) == brute(rows)


def test_empty_table(make_docs):
    assert result(make_docs([])) == []


def test_sf_documents_equal_brute_force(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    assert result(sf_docs) == brute(rows)


def test_tables_that_grow_are_not_broadcast(make_docs, monkeypatch, words):
    plans, write = [], simhash.written

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def recorded(df, **options):
        plans.append(plan(df))
        return write(df, **options)

    monkeypatch.setattr(simhash, "written", recorded)
    rows = [(i, words(50, i % 20)) for i in range(60)]
    groups = simhash.simhash_groups(make_docs(rows))
    plans += [plan(groups), plan(simhash.links(make_docs(rows).selectExpr("doc_id as print")))]
    assert sorted((tuple(row) for row in groups.collect()), key=repr) == brute(rows)
    assert not [p for p in plans if "Broadcast" in p]
    assert sum(p.count("SortMergeJoin") for p in plans) == 4
