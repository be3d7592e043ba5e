from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from broadsheet.llm import decontaminate as D
from tests.llm.conftest import EDGE_ROWS


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(rows, items, width=13):
    out = []
    for i, text in rows:
        w, hit, found = split(text), set(), set()
        for item, passage in items:
            p = split(passage)
            for a in range(max(1, len(p) - width + 1)) if p else ():
                window = p[a : a + width]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        found.add("null" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.fixture(scope="module")
def data(spark, make_docs, words):
    passage = words(40, 500)
    cut = passage.split()
    items = [(1, passage), (2, words(13, 501)), (10, "Tiny item"), (11, None), (12, ""), (13, " ".join(cut[5:25])), (13, "tiny ITEM"), (None, words(9, 502))]
    rows = [(k, words(60, k)) for k in range(12)]
    rows += [(20, words(30, 20) + " " + passage.upper() + ". " + words(9, 21)), (21, " ".join(cut[3:15])), (22, " ".join(cut[3:16]))]
    rows += [(23, words(13, 501).replace(" ", "-- ")), (24, "a tiny item, tiny  item!"), (25, words(400, 26) + " tiny item"), (26, words(9, 502)), (26, words(9, 502)), (27, "É tiny item é")]
    rows += EDGE_ROWS[:-1]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    return make_docs(rows), rows, benchmark, items


@pytest.mark.parametrize("limit", [D.MAX_WINDOWS, 3])
def test_hits_equal_brute_force(data, limit):
    docs, rows, benchmark, items = data
    got = D.decontaminate(docs, benchmark, max_windows=limit)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == brute(rows, items)


def test_stage_drops_contaminated_rows_only(data):
    docs, rows, benchmark, items = data
    kept = D.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    want = Counter(i for (i, *_, bad), n in brute(rows, items).items() for _ in range(n) if not bad)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_empty_tables(data, make_docs):
    docs, rows, benchmark, _ = data
    assert D.decontaminate(make_docs([]), benchmark).count() == 0
    got = D.decontaminate(docs, benchmark.limit(0)).collect()
    assert len(got) == len(rows) and not any(r.contaminated for r in got)


def test_main_path_runs_no_python(data):
    docs, _, benchmark, _ = data
    plan = D.decontaminate(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
