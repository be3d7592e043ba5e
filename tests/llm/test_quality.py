from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from broadsheet.llm import quality as Q
from tests.llm.conftest import EDGE_ROWS


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(make_docs, words):
    rows = [(i, words(40, i) + "\n" + words(12, i) + " ## *\n" + words(12, i)) for i in range(20)] + [(90, "a b c d e f " * 9), (91, "x\ny\nx\n\n \nx")]
    got = {r.doc_id: r for r in Q.score(make_docs(rows), None).collect()}
    for i, text in rows:
        assert tuple(got[i][k] for k in Q.STATISTICS) == brute(text)
        n, _, _, _, repeated = brute(text)
        assert got[i].base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert got[i].p_quality is None and got[i].kept == (not got[i].base_failed)


def test_edge_rows(make_docs):
    got = Q.score(make_docs(EDGE_ROWS), None).collect()
    assert len(got) == len(EDGE_ROWS)
    by = Counter((r.doc_id, r.n_words, r.kept) for r in got)
    assert by[(1, 0, False)] == by[(2, 0, False)] == by[(3, 0, False)] == 1
    assert by[(6, 2, False)] == 2 and by[(8, 30000, False)] == 1 and (None, 5, False) in by
    assert Q.score(make_docs([]), None).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, make_docs, words):
    good = [(i, words(60, i)) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in words(60, 5000 + i).split())) for i in range(120)]
    docs = make_docs(good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:120]] + [(i, 0, 0) for i, _ in bad[:70]] + [(None, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_classifier_on_unseen_rows(labelled):
    docs, labels = labelled
    got = Q.quality_rules(docs, labels).collect()
    unseen = [r for r in got if 120 <= r.doc_id < 1000 or r.doc_id >= 1070]
    assert np.mean([r.kept == (r.doc_id < 1000) for r in unseen]) > 0.97
    assert all(0 <= r.p_quality <= 1 for r in got)


def test_filter_keeps_columns_and_agrees(labelled):
    docs, labels = labelled
    kept = Q.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.quality_rules(docs, labels).collect() if r.kept}


def test_without_both_classes_there_is_no_model(spark, labelled):
    docs, labels = labelled
    assert Q.train(docs, labels.where("quality = 1")) is None
    assert Q.train(docs, labels.limit(0)) is None


def test_the_sample_is_bounded(labelled):
    docs, labels = labelled
    assert Q.train(docs, labels, max_train=60) is not None


def test_held_out_accuracy_on_driver_tables(spark, sf_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = labels.where("doc_id % 2 = 0")
    scored = Q.quality_rules(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = [r for r in scored.collect() if not r.base_failed]
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
