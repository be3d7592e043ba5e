"""Byte-level BPE by a lazily determinised finite-state transducer.

Text is cut by the tokenizer's pattern; each match is encoded on its own. The transducer reads
a match byte by byte. For every prefix exactly one token can end the prefix's own encoding, and
that token is found from the encodings of shorter prefixes: a token may follow another if merging
their joint bytes gives back just these two. A state is therefore the set of tokens begun but
not complete, as (bytes read, trie node, token before it); the transition on a byte is worked out
once, when it is first met, and kept. A token leaves the transducer as soon as no token begun
before its end is still open: lookahead is bounded by the longest token.

Decoding is a stream: bytes of ids pass through an incremental UTF-8 machine that holds back an
unfinished character and replaces what cannot be UTF-8 by U+FFFD.

Defined cases: null is the empty text and has no ids; ids and text of repeated rows are equal;
an id outside the vocabulary raises ``ValueError``; very long texts are split by match, never cut;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.batches import blocks, id_and_text, release, texts

#: Entries a worker keeps; beyond, the memory is emptied and filled anew.
MAX_STATES = 300_000
MAX_MATCHES = 150_000
MAX_PAIRS = 600_000
#: Longest match whose ids are remembered.
REMEMBER_BYTES = 64
#: Characters below are the same letters and numbers in every version of Unicode since 1991.
OLDER_THAN = "\u0250"
#: Between words while texts are cut; texts that hold it go match by match.
CUT = "\0"
#: Text encoded at a time; its words as objects take many times its bytes.
ENCODED_BYTES = 500_000
#: Words whose ids are remembered, and ids decoded at a time.
MAX_WORDS = 600_000
#: Words remembered by workers that have to be sparing with memory.
FEW_WORDS = 200_000
STREAMED = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: one base64 token and its id a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=1)
def newer_characters() -> str:
    """A class of the letters and numbers that ``regex`` knows and the tokenizer library doesn't.

    The two follow different versions of Unicode. An encoding whose whole pattern is one class
    gives no id for what the library leaves out of the class.
    """
    bytes_only = {bytes([b]): b for b in range(256)}
    found = set()
    for name in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=bytes_only, special_tokens={})
        ours = regex.compile(name)
        found.update(c for c in range(0x110000) if ours.match(chr(c)) and not probe.encode_ordinary(chr(c)))
    runs: list[list[int]] = []
    for c in sorted(found):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in runs) + "]" if runs else ""


class Transducer:
    """Encoder of single matches; states are made when they are first reached."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Trie over the tokens by ``node << 8 | byte``; of a node: the token it completes, its
        #: depth, and whether longer tokens go on from it.
        self.child: dict[int, int] = {}
        self.complete, self.depth, self.inner = [-1], [0], [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                found = self.child.get(node << 8 | byte)
                if found is None:
                    found = self.child[node << 8 | byte] = len(self.complete)
                    self.complete.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                node = found
            self.complete[node] = rank
        self._reached: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._made: dict[int, tuple[int, ...] | None] = {}
        self._forget()

    def _forget(self) -> None:
        # What a state has begun lists node and token before, longest begun token first; last comes
        # the token that ended just here (-1 at the start).
        self._begun: list[tuple[int, ...]] = [(-1,)]
        self._states: dict[tuple[int, ...], int] = {self._begun[0]: 0}
        # Transitions by ``state << 8 | byte``, each as one number: next state, token that ends the
        # prefix (24 bits), how far back a begun token reaches (16 bits). Hundreds of thousands are
        # kept, so they are no objects of their own.
        self._steps: dict[int, int] = {}

    def forget_all(self) -> None:
        self._forget()
        self._pairs.clear()

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """The merges applied by definition, those below a rank only; used for single tokens."""
        below = len(self.ranks) + 1 if below is None else below
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that were merged into this one; None for a byte."""
        known = self._made.get(token, 0)
        if known == 0:
            data, known = self.tokens[token], None
            if len(data) > 1:
                known = tuple(self.merge(data, token))
                if len(known) != 2:
                    raise ValueError(f"token {token} is not made of two")
            self._made[token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' joint bytes are encoded as just these two; -1 is no token, at the start.

        Merges at the joint are undone, the latest first. The two stay apart unless what then meets
        at the joint would have been merged before that; of equal merges the left one comes first.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._whole(right) and (left < 0 or self._apart(left, right))
        return known

    def _apart(self, left: int, right: int) -> bool:
        tokens, ranks, before = self.tokens, self.ranks, len(self.ranks) + 1
        while True:
            joint = ranks.get(tokens[left] + tokens[right])
            if joint is not None and joint < before:
                return False
            of_left, of_right = self._halves(left), self._halves(right)
            if of_left and (left > right or not of_right):
                before, left = left, of_left[1]
            elif of_right:
                before, right = right + 1, of_right[0]
            else:
                return True

    def _whole(self, token: int) -> bool:
        """Whether the merges reach the token from its bytes."""
        known = self._reached.get(token)
        if known is None:
            known = self._reached[token] = self.merge(self.tokens[token]) == [token]
        return known

    def _step(self, state: int, byte: int) -> int:
        """The transition on a byte: determinised now, kept for later."""
        begun = self._begun[state]
        child, complete, inner, pairs = self.child, self.complete, self.inner, self._pairs
        carried: list[int] = []
        ended = -1
        for at in range(0, len(begun), 2):
            # The last entry is a token that ended here: one begins at the root after it.
            node, before = (begun[at], begun[at + 1]) if at + 1 < len(begun) else (0, begun[at])
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if ended < 0:
                token = complete[node]
                if token >= 0:
                    may = pairs.get(before << 32 | token)
                    if may or may is None and self.may_follow(before, token):
                        ended = token
            if inner[node]:
                carried += (node, before)
        if ended < 0:
            raise ValueError("a byte without a token")
        back = self.depth[carried[0]] if carried else 0
        carried.append(ended)
        key = tuple(carried)
        after = self._states.get(key)
        if after is None:
            after = self._states[key] = len(self._begun)
            self._begun.append(key)
        step = self._steps[state << 8 | byte] = after << 40 | ended << 16 | back
        return step

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match."""
        if len(self._states) > MAX_STATES:
            self._forget()
        state, ids, steps = 0, [], self._steps
        #: Tokens that end the prefixes not yet emitted.
        pending: list[int] = []
        for byte in data:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state = step >> 40
            pending.append(step >> 16 & 0xFFFFFF)
            if not step & 0xFFFF:
                # No token begun earlier is open: what is pending is final.
                ids += self._trace(pending)
                pending.clear()
        return ids + self._trace(pending) if pending else ids

    def _trace(self, pending: list[int]) -> list[int]:
        tokens, out, at = self.tokens, [], len(pending)
        while at > 0:
            token = pending[at - 1]
            out.append(token)
            at -= len(tokens[token])
        out.reverse()
        return out


class Utf8Machine:
    """Incremental UTF-8: ``feed`` gives the characters completed so far, ``close`` the rest."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of a character begun at the end of the data but not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Tokenizer:
    """Pattern, transducer and the ids of words met before."""

    def __init__(self, path: str, pattern: str, newer: str = ""):
        self.max_words = MAX_WORDS
        self.transducer = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.newer = re.compile(newer) if newer else None
        self._empty()

    def _empty(self) -> None:
        self._known: dict[str, tuple[int, ...]] = {}
        self._number: dict[str, int] = {}
        #: Of all words met: their ids in a row, where each word's begin, and the block that had it last.
        self._flat = np.zeros(0, np.int32)
        self._begin = np.zeros(1, np.int64)
        self._used = np.zeros(0, np.int64)
        self._block = 0

    def forget_all(self) -> None:
        """Empty every memory and give its space back; what is met again is found anew."""
        self._empty()
        self.transducer.forget_all()
        release()

    def matches(self, text: str) -> list[str]:
        """The text cut by the pattern; characters in ``newer`` count as unassigned."""
        if self.newer is None or text.isascii() or max(text) < OLDER_THAN or not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(self.newer.sub("\ue000", text))]

    def _by_match(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self._known
        for match in self.matches(text):
            found = known.get(match)
            if found is None:
                data = match.encode()
                found = tuple(self.transducer.encode(data))
                if len(data) <= REMEMBER_BYTES:
                    if len(known) >= MAX_MATCHES:
                        known.clear()
                    known[match] = found
            ids += found
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, match by match."""
        return self._by_match(text)

    def _word(self, word: str) -> list[int]:
        """Ids of a word with the blank before it; one of ASCII letters after a space is one match."""
        letters = word[1:]
        if word[:1] == " " and letters.isascii() and letters.isalpha():
            return self.transducer.encode(word.encode())
        return self._by_match(word)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end.

        Where blanks are single spaces and line ends between other characters, a match never
        reaches over them: a space opens the next match, a line end is one by itself. So such
        texts are cut before every blank, and each distinct word is encoded once. Words that
        recent blocks had are remembered. Other texts go match by match.
        """
        plain = [at for at, text in enumerate(texts) if _is_plain(text)]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for at in set(range(len(texts))).difference(plain):
            out[at] = np.array(self._by_match(texts[at]), np.int32)
        if plain:
            joint = CUT.join(texts[at] for at in plain)
            words = joint.replace(" ", CUT + " ").replace("\n", CUT + "\n").split(CUT)
            self._learn([word for word in set(words) if word not in self._number])
            asked = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))
            self._used[asked] = self._block
            first = self._begin[asked]
            size = self._begin[asked + 1] - first
            upto = np.cumsum(size)
            ids = self._flat[np.repeat(first - (upto - size), size) + np.arange(upto[-1])]
            n_words = np.cumsum([texts[at].count(" ") + texts[at].count("\n") + 1 for at in plain])
            for at, part in zip(plain, np.split(ids, upto[n_words[:-1] - 1])):
                out[at] = part
            self._block += 1
            self._forget()
        ends = np.cumsum([len(part) for part in out])
        return np.concatenate(out) if out else np.zeros(0, np.int32), ends

    def _learn(self, words: list[str]) -> None:
        found = list(map(self._word, words))
        self._number.update(zip(words, range(len(self._number), len(self._number) + len(words))))
        ends = self._begin[-1] + np.cumsum([len(ids) for ids in found], dtype=np.int64)
        fresh = np.fromiter(chain.from_iterable(found), np.int32)
        self._flat = np.concatenate([self._flat, fresh])
        self._begin = np.concatenate([self._begin, ends])
        self._used = np.concatenate([self._used, np.full(len(words), self._block)])

    def _forget(self) -> None:
        """Beyond ``max_words``, keep the words that came up again most lately, half as many at most."""
        if len(self._number) <= self.max_words:
            return
        order = np.argsort(self._used, kind="stable")[-self.max_words // 2 :]
        order.sort()
        keep = np.zeros(len(self._used), bool)
        keep[order] = True
        size = np.diff(self._begin)
        self._flat = self._flat[np.repeat(keep, size)]
        self._begin = np.concatenate([[0], np.cumsum(size[keep])])
        self._used = self._used[keep]
        words = [word for word, kept in zip(self._number, keep.tolist()) if kept]
        self._number = dict(zip(words, range(len(words))))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        try:
            return b"".join(map(self.transducer.tokens.__getitem__, ids))
        except KeyError as missing:
            raise ValueError(f"no token has the id {missing}") from None

    def decode_stream(self, ids: Iterable[int], at_once: int = 1) -> Iterator[str]:
        """Text as the ids arrive, ``at_once`` of them; never half a character."""
        machine = Utf8Machine()
        ids = iter(ids)
        while some := list(islice(ids, at_once)):
            if piece := machine.feed(self.decode_bytes(some)):
                yield piece
        if rest := machine.close():
            yield rest


    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the text that the stream gives."""
        return "".join(self.decode_stream(ids, STREAMED)).encode()


def _is_plain(text: str) -> bool:
    """Whether blanks are single spaces and line ends between other characters."""
    return CUT not in text and text != "" and " ".join(text.split()) == text.replace("\n", " ")


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str, newer: str = "") -> Tokenizer:
    """One tokenizer for each worker and vocabulary."""
    return Tokenizer(path, pattern, newer)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text; ``path`` is a rank file every worker has."""

    newer = newer_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path, pattern, newer)
        for batch in batches:
            for block in blocks(batch, ENCODED_BYTES):
                flat, ends = encoder.encode_all([text.decode("utf-8", "replace") for text in texts(block)])
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), _lists(flat, ends)], ["doc_id", "ids"])

    return id_and_text(documents).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` rows with the bytes their ``ids`` stand for; null ids give null."""

    newer = newer_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = tokenizer(path, pattern, newer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                data = [None if ids is None else decoder.decode(ids) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str, sparing: bool = False) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that one worker holds one tokenizer.

    ``sparing`` is for executors whose heap and workers earlier stages have filled: fewer words are
    remembered and nothing is after a task, at the cost of finding them anew. Results are the same.
    """
    newer = newer_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizer(path, pattern, newer)
        both.max_words = FEW_WORDS if sparing else MAX_WORDS
        try:
            for batch in batches:
                for block in blocks(batch, ENCODED_BYTES):
                    flat, ends = both.encode_all([text.decode("utf-8", "replace") for text in texts(block)])
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    data = [both.decode(flat[start:end].tolist()) for start, end in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [block.column("doc_id"), _lists(flat, ends), pa.array(data, pa.binary())], ["doc_id", "ids", "decoded"]
                    )
        finally:
            if sparing:
                both.forget_all()

    return id_and_text(documents).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Token count and SHA-256 of the decimal ids and of the decoded bytes."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
