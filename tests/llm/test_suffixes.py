from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from broadsheet.llm import suffixes as S
from tests.llm.conftest import EDGE_ROWS


def brute(rows, window=50):
    least = {}
    for i, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - window + 1):
            key = data[k : k + window]
            rank = S.NO_ID if i is None else i
            least[key] = min(least.get(key, rank), rank)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        cover = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - window + 1):
            if least[data[k : k + window]] < (S.NO_ID if i is None else i):
                cover[k : k + window] = True
        kept = bytes(b for b, c in zip(data, cover) if not c)
        out.append((i, len(data), int(cover.sum()), int((cover[:-1] & ~np.append(False, cover[:-2])).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def rows(words):
    shared, border = words(30, 1), words(12, 2)
    rows = [(k, words(20, 10 + k) + " " + shared + " " + words(15, 50 + k)) for k in range(12)]
    rows += [(20 + k, words(5, 90 + k) + border[: 49 + k] + words(5, 190 + k)) for k in range(8)]
    rows += [(40, "ab" * 300), (41, "x" + "ab" * 200 + "y"), (42, words(60, 7)), (43, words(60, 7)), (43, words(60, 7))]
    return rows + [(44, "é" * 60), (45, "é" * 40), (None, shared), (None, words(40, 77)), (46, words(40, 77)), (47, "漢字" * 40)]


@pytest.mark.parametrize("window, broadcast", [(50, S.MAX_BROADCAST_ROWS), (40, 2)])
def test_removal_equals_brute_force(make_docs, rows, window, broadcast):
    got = Counter(tuple(r) for r in S.digests(S.remove_repeats(make_docs(rows), window, broadcast)).collect())
    assert got == brute(rows, window)


def test_edge_rows(make_docs):
    got = Counter(tuple(r) for r in S.digests(S.remove_repeats(make_docs([r for r in EDGE_ROWS if r[0] != 8]))).collect())
    assert got == brute([r for r in EDGE_ROWS if r[0] != 8])
    assert S.digests(S.remove_repeats(make_docs([]))).count() == 0


def test_small_blocks_and_buckets_change_nothing(make_docs, rows, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 500)
    monkeypatch.setattr(S, "CHUNK", 3)
    got = Counter(tuple(r) for r in S.digests(S.remove_repeats(make_docs(rows).repartition(7))).collect())
    assert got == brute(rows)


def test_intervals_are_all_maximal_repeats():
    pieces = [b"abcabcXYZ", b"QabcabcX", b"abcabcXYW"]
    got = {(pieces[w[0]][o[0] : o[0] + n], tuple(sorted(zip(w.tolist(), o.tolist())))) for n, w, o in S.maximal_repeats(pieces, 3)}
    where = defaultdict(set)
    for p, piece in enumerate(pieces):
        for a in range(len(piece)):
            for b in range(a + 3, len(piece) + 1):
                where[piece[a:b]].add((p, a))
    want = set()
    for text, at in where.items():
        if len(at) < 2:
            continue
        right = {pieces[p][a + len(text) : a + len(text) + 1] or (p, a) for p, a in at}
        left = {pieces[p][a - 1 : a] if a else (p, a) for p, a in at}
        # An occurrence at the start of a piece counts as differing on the left.
        if len(right) > 1 and (len(left) > 1 or any(a == 0 for _, a in at)):
            want.add((text, tuple(sorted(at))))
    assert got == want


def test_groups_list_all_occurrences(make_docs, words):
    shared = words(9, 4)[:60]
    docs = make_docs([(k, f"{k}{words(3, k + 60)}{shared}{k}{words(3, k + 80)}") for k in range(5)]).repartition(5)
    found = defaultdict(set)
    for r in S.repeat_groups(docs).collect():
        found[r.repeat_id].add(r.doc)
    assert any(docs_of == set(range(5)) for docs_of in found.values())


def brute_groups(rows, window=50):
    """Maximal repeats inside pieces by trying every substring."""
    of_gram = defaultdict(list)
    for doc, text in dict.fromkeys(rows):
        data = text.encode()
        for _, a, b, low in zip(*S.pieces(data, np.array([0, len(data)]), window)):
            of_gram[int(low)].append((doc, int(a), data[a:b]))
    out = Counter()
    for found in of_gram.values():
        where = defaultdict(list)
        for p, (_, _, piece) in enumerate(found):
            for a in range(len(piece) - window + 1):
                for b in range(a + window, len(piece) + 1):
                    where[piece[a:b]].append((p, a))
        for text, at in where.items():
            right = {found[p][2][a + len(text) : a + len(text) + 1] or p for p, a in at}
            left = {found[p][2][a - 1 : a] if a else (p, a) for p, a in at}
            places = frozenset((found[p][0], found[p][1] + a) for p, a in at)
            if len(right) > 1 and len(left) > 1 and len({d for d, _ in places}) > 1:
                out[(len(text), places)] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_groups_with_exact_copies_equal_brute_force(make_docs, words, partitions):
    shared = words(30, 1)
    rows = [(k, words(20, 10 + k % 3) + " " + shared + " " + words(15, 50 + k % 4)) for k in range(12)]
    rows += [(42, words(60, 7)), (43, words(60, 7)), (44, "x" + words(60, 7)), (45, "é" * 40), (46, shared)]
    groups = defaultdict(list)
    for r in S.repeat_groups(make_docs(rows).repartition(partitions)).collect():
        groups[r.repeat_id, r.length].append((r.doc, r.start))
    assert all(len(set(at)) == len(at) for at in groups.values())
    assert Counter((length, frozenset(at)) for (_, length), at in groups.items()) == brute_groups(rows)


def hot_rows(words):
    """One gram, the least of all, in every document, with other words around it."""
    pool = [words(3, k).replace(" ", "")[:8].ljust(8, "q") for k in range(500)]
    hot = min(pool, key=lambda w: int(S.gram_hashes(w.encode())[0]))
    lines = [f"{words(9, 100 + k % 150)} {hot} {words(9, 500 + k % 130)}" for k in range(300)]
    return list(enumerate(lines))


def test_hot_grams_are_split(make_docs, words, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 4_000)
    rows = hot_rows(words)
    docs = S._rows(make_docs(rows).repartition(3)).cache()
    total = sum(len(t) for _, t in rows)
    text = [t.encode() for _, t in rows]
    data, offsets = b"".join(text), np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
    plain = S.pieces(data, offsets)

    def most(filed):
        contents = {(int(low), data[a:b]) for _, a, b, low in zip(*filed)}
        sizes = Counter()
        for low, content in contents:
            sizes[low] += len(content)
        return max(sizes.values())

    hot = S.hot_keys(docs, total, 50)
    *split, further = S.refiled(data, *plain, hot, 50)
    assert further.any() and not further.all()
    assert most(plain) > S.BUCKET_BYTES >= most(split)
    # Every window is filed once, and equal windows under one key.
    def windows(filed):
        return Counter((int(t), k) for t, a, b, _ in zip(*filed) for k in range(a, b - 49))

    assert windows(plain) == windows(split)
    keys = defaultdict(set)
    for _, a, b, low in zip(*split):
        for k in range(a, b - 49):
            keys[data[k : k + 50]].add(int(low))
    assert all(len(k) == 1 for k in keys.values())
    got = Counter(tuple(r) for r in S.digests(S.remove_repeats(make_docs(rows).repartition(3))).collect())
    assert got == brute(rows)
