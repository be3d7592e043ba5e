from __future__ import annotations

import json
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from broadsheet.llm import alignment
from tests.llm.conftest import EDGE_ROWS

A_PATH, B_PATH = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["a  b", " lead", "tail ", "x\ty", "two\n\nlines", "a\n \nb", "line\nline", "▁mark a", "<|endoftext|> <s> </s> <0x41>", "naïve café 漢字 😀 é", "\x00 \x01", " x", "'s 't I'll", "ﬁ ½ Å", "   ", "\n"]


@pytest.fixture(scope="module")
def tokens():
    """Ids and bytes of both tokenizers for a whole text, from the libraries alone."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    signs = {c: i for i, c in enumerate(_signs())}

    def of(text):
        if not text:
            return [], []
        left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece) if b.is_byte(i) else None
            right.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (left, right) if all(b"".join(x for _, x in side) == whole for side in (left, right)) else ([], [])

    return of


def _signs():
    """The 256 signs of byte-level vocabularies, read off the file: single-byte tokens in byte order."""
    model = Tokenizer.from_file(A_PATH)
    model.encode_special_tokens = True
    vocabulary = json.load(open(A_PATH))["model"]["vocab"]
    singles = [token for token in vocabulary if len(token) == 1]
    seen = {}
    for byte in range(256):
        sign = [t for t in singles if ord(t) == byte] if (33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255) else None
        seen[byte] = sign[0] if sign else None
    rest = iter(sorted((t for t in singles if ord(t) > 255), key=ord))
    return [seen[byte] or next(rest) for byte in range(256)]


def brute(rows, tokens):
    per_doc, held = [], defaultdict(set)
    for no, (i, text) in enumerate(rows):
        left, right = tokens(text)
        spans = []
        for side in (left, right):
            at, found = 0, []
            for token, data in side:
                found.append((at, at + len(data), token))
                at += len(data)
            spans.append(found)
        links, first = [], 0
        for x in spans[0]:
            while first < len(spans[1]) and spans[1][first][1] <= x[0]:
                first += 1
            for y in spans[1][first:]:
                if y[0] >= x[1]:
                    break
                links.append((x[2], y[2]))
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for s, e, t in side if low <= s and e <= cut) for side in spans))
            low = cut
        for pair in links:
            held[pair].add(no)
        digest = sha256(";".join(groups).encode()).hexdigest() if groups else ""
        per_doc.append((i, len(left), len(right), len(groups), links, digest))
    count = {pair: len(docs) for pair, docs in held.items()}
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((i, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest) for i, n_a, n_b, n_groups, links, digest in per_doc),
        key=repr,
    )


def result(docs):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(row) for row in alignment.alignment(docs, A_PATH, B_PATH).select(columns).collect()), key=repr)


def test_equals_brute_force(make_docs, tokens, words):
    rows = list(enumerate(ODD, 100)) + [row if len(row[1] or "") < 9_000 else (row[0], row[1][:9_000].strip()) for row in EDGE_ROWS]
    rows += [(i, words(60, i)) for i in range(200, 230)] + [(200, words(60, 200))]
    docs = make_docs(rows)
    wanted = brute(rows, tokens)
    assert result(docs.repartition(7)) == wanted
    assert result(docs.coalesce(1)) == wanted


def test_random_characters(make_docs, tokens):
    rng = random.Random(8)
    pool = [" ", " ", "\n", "a", "B", "é", "ß", "漢", "1", ".", "'", "s", "-", "́", "😀", "_", "the", "ing", "​", "Ω"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    assert result(make_docs(rows)) == brute(rows, tokens)


def test_empty_tables(make_docs):
    assert result(make_docs([])) == []
    assert result(make_docs([(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_and_blocks(make_docs, tokens, words, monkeypatch):
    rows = [(i, " ".join(words(400, i * 7 + k) for k in range(6))) for i in range(8)]
    rows.append((50, "\n".join(words(300, k) for k in range(20))))
    assert result(make_docs(rows).repartition(3)) == brute(rows, tokens)


def test_sf_documents_equal_brute_force(sf_docs, tokens):
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    assert result(sf_docs) == brute(rows, tokens)
