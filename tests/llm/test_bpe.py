from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from broadsheet.llm import bpe
from tests.llm.conftest import EDGE_ROWS

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Tokenizer(PATH, PATTERN, bpe.newer_characters())


@pytest.mark.parametrize("pool", ["ab 'st\n1.,é", " \t\n\r 　x", "=-* a", "漢字かな한글😀é", "<|endoftext|> "])
def test_ids_equal_the_library(ours, library, pool):
    rng = random.Random(pool)
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))
        assert ours.encode(text) == library.encode_ordinary(text)


def test_any_character(ours, library):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(chr(c) for c in (rng.randrange(0x323AF) for _ in range(20)) if not 0xD800 <= c < 0xE000)
        assert ours.encode(text) == library.encode_ordinary(text)


def test_long_runs_are_whole(ours, library):
    for text in ("a" * 20_000, " " * 9_999 + "x", "ab" * 8_000 + "é" * 500):
        assert ours.encode(text) == library.encode_ordinary(text)


def test_small_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    monkeypatch.setattr(bpe, "MAX_MATCHES", 2)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 3)
    small = bpe.Tokenizer(PATH, PATTERN)
    text = "The quick brown fox, the quick brown fox. Überraschung"
    assert small.encode(text) == library.encode_ordinary(text)


def test_states_are_kept_as_numbers(ours):
    """Hundreds of thousands of them are kept."""
    ours.encode("Several words, which lead to several states")
    steps = ours.transducer._steps
    assert len(steps) > 20 and all(type(step) is int for item in steps.items() for step in item)


def test_what_is_forgotten_is_found_anew(library):
    some = bpe.Tokenizer(PATH, PATTERN)
    some.max_words = 4
    texts = ["The quick brown fox", "Überraschung, the quick  fox", "", "a\nb c d e f g h"]
    want = [i for text in texts for i in library.encode_ordinary(text)]
    for _ in range(3):
        ids, ends = some.encode_all(texts)
        assert ids.tolist() == want and ends[-1] == len(want)
        assert len(some._number) <= 4
    some.forget_all()
    assert not some._number and not some._known and not some.transducer._steps
    assert some.encode_all(texts)[0].tolist() == want


def test_sparing_round_trip_is_the_same(make_docs):
    docs = make_docs(EDGE_ROWS)
    full, sparing = (bpe.digests(bpe.round_trip(docs, PATH, PATTERN, sparing=how)) for how in (False, True))
    assert sorted(map(tuple, full.collect()), key=str) == sorted(map(tuple, sparing.collect()), key=str)


def test_streaming_decode_never_splits_a_character(ours):
    text = "naïve 漢字 😀 end"
    ids = ours.encode(text)
    pieces = list(ours.decode_stream(ids))
    assert "".join(pieces) == text and all("�" not in p for p in pieces)


def test_utf8_machine_against_the_codec():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xFF]) for _ in range(12))
        machine = bpe.Utf8Machine()
        got = "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close()
        assert got == data.decode("utf-8", "replace")


def test_unknown_id_raises(ours):
    with pytest.raises(ValueError):
        ours.decode_bytes([10**6])


def test_table_round_trip(make_docs, library):
    docs = make_docs(EDGE_ROWS)
    want = sorted(
        (-1 if i is None else i, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in EDGE_ROWS
    )
    for run in (bpe.round_trip(docs, PATH, PATTERN), bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)):
        assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in bpe.digests(run).collect()) == want
    assert bpe.digests(bpe.round_trip(make_docs([]), PATH, PATTERN)).count() == 0
