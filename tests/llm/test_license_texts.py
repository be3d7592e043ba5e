"""Whole license texts, against containment computed over whole documents."""

from __future__ import annotations

import random
import re

from broadsheet.llm import licenses


def shingles(text):
    words = [w for w in re.split(r"[^\w.]+|_+", text.lower()) if w]
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def brute(rows, templates, percent=80):
    found = set()
    for i, text in rows:
        have = shingles(text)
        for name, body in templates.items():
            own = shingles(body)
            if 100 * len(own & have) >= percent * len(own):
                found.add((i, name, len(own & have), len(own)))
    return found


def test_whole_texts_are_found_wherever_they_begin(spark, make_docs, words):
    templates = licenses.TEMPLATES | licenses.full_texts()
    rng, rows = random.Random(5), []
    for number, (name, body) in enumerate(sorted(templates.items())):
        for k, lead in enumerate((0, 17, 33, 1_000)):
            rows.append((100 * number + k, words(lead, number) + " " + body + " " + words(200, number + 50)))
        parts = body.split()
        # A twentieth of the words changed, and the first half alone.
        changed = [f"other{rng.randrange(99)}" if rng.random() < 0.05 else w for w in parts]
        rows += [(100 * number + 10, words(45, number) + " " + " ".join(changed)), (100 * number + 11, " ".join(parts[: len(parts) // 2]))]
    want = brute(rows, templates)
    assert {name for _, name, *_ in want} == set(templates)
    table = licenses.template_table(spark, templates)
    got = licenses.scan(make_docs(rows), table).collect()
    assert {(r.doc_id, r.template, r.n_match, r.n_template) for r in got} == want and len(got) == len(want)


def test_templates_between_the_steps(spark, make_docs, words):
    """33 to 80 shingles, at every alignment with the shortest windows' steps."""
    body = words(70, 3)
    rows = [(lead, words(lead, 9) + " " + body + " " + words(80, 8)) for lead in range(0, 64, 5)]
    got = licenses.scan(make_docs(rows), licenses.template_table(spark, {"own": body})).collect()
    assert {(r.doc_id, "own", r.n_match, r.n_template) for r in got} == brute(rows, {"own": body}) and len(got) == len(rows)
