from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from broadsheet.llm import lm
from tests.llm.conftest import EDGE_ROWS


def base(rows):
    def held(i):
        return crc32(("" if i is None else str(i)).encode()) % 7 == 2

    counts = Counter()
    for i, text in rows:
        if not held(i):
            counts.update(lm.tokens((text or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        words = lm.tokens((text or "").encode())
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), total, round(score, 6)))
    return Counter(out)


def rounded(rows):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_base_equals_brute_force(make_docs, words, head):
    rows = [(i, words(30, i)) for i in range(60)] + [(700, "wholly unseen zzz words"), (5, "again")] + EDGE_ROWS[:7]
    got = lm.score(make_docs(rows), head).collect()
    assert rounded(got) == base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_empty_table_and_no_training_rows(make_docs):
    assert lm.score(make_docs([])).count() == 0
    only_held = [i for i in range(200) if lm.held_out(i)][:3]
    got = lm.score(make_docs([(i, "a b") for i in only_held])).collect()
    assert rounded(got) == base([(i, "a b") for i in only_held])
    assert all(math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one(make_docs, words):
    docs = make_docs([(i, words(50, i)) for i in range(40)])
    counts = lm.word_counts(docs).cache()
    known = lm.vocabulary(counts)
    model = lm.train(docs, known)
    for context in ([3, 5], [known.n_symbols, known.n_symbols], [0, 7]):
        norm = model.log_norm(np.array([context]))[0]
        n = known.n_symbols
        logs = model.scores(np.full(n, context[0]), np.full(n, context[1]), np.arange(n)) - norm
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    # Words of a class and one unseen word share the class.
    shares = Counter()
    for row in counts.collect():
        if known.symbols[known.index[bytes(row["word"])]] >= lm.WORDS:
            k = lm.word_class(bytes(row["word"]))
            shares[k] += (row["c"] + 1) / (known.class_tokens[k] + known.class_words[k] + 1)
    for k, share in shares.items():
        assert share + 1 / (known.class_tokens[k] + known.class_words[k] + 1) == pytest.approx(1)


def test_training_improves_held_out_texts(make_docs):
    rng = np.random.default_rng(1)
    tongues = [[f"{c}{k}" for k in range(150)] for c in "pqrs"]
    rows = [(i, " ".join(rng.choice(tongues[i % 4], 80))) for i in range(600)]
    got = [r for r in lm.score(make_docs(rows)).collect() if r.held_out]
    assert np.mean([r.score / r.n_tokens for r in got]) > np.mean([r.base_score / r.n_tokens for r in got]) + 0.2


def test_head_is_bounded(make_docs, words):
    counts = lm.word_counts(make_docs([(i, words(50, i)) for i in range(40)]))
    assert len(lm.vocabulary(counts, 25).index) <= 25
    assert len(lm.vocabulary(counts, 0).index) == 0
