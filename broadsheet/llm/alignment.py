"""Alignment of two tokenizers' tokens over the same bytes.

Texts are encoded in blocks by both tokenizers, A (byte-level BPE) over a space and the text, B
(pieces with byte fallback) over the text, to which it adds the space. Each token has the bytes it
stands for, so both sides cut the same byte string. ``merge_asof`` keyed by document finds, for each
token's start, the other side's covering token; the union of both directions is every overlapping
pair, and where both sides end together a group ends.

How many documents hold a pair of ids is counted over the corpus. A block keeps each pair once, with
its documents' links as places in that list, so what is shuffled for the counts shrinks with the
number of pairs that repeat. Counts come back to a block as one list next to the block's links.

Words after single spaces or line ends are encoded once and remembered: neither tokenizer merges
over these (which is checked). Texts with other blanks are encoded whole.

Defined cases: null and empty texts, and texts whose tokens don't give back their bytes, have no
tokens, zeros and no groups; special tokens' names are plain text; repeated rows and ids count as
documents of their own; rows without an id keep a null id; a long text goes alone, never cut; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.batches import blocks, id_and_text, texts, written

#: Text aligned at a time.
ALIGN_BYTES = 1_000_000
ROW_GROUP_BYTES = 16 << 20
#: Distinct words whose ids a worker remembers; beyond, it starts anew before the next block.
MAX_WORDS = 250_000
#: Words encoded as one text.
WORDS_AT_ONCE = 500
#: The mark that stands for a space in pieces.
SPACE = "▁"

ALIGNED = (
    "block string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups array<string>, n_pairs array<int>, place array<int>, times array<int>, pairs array<bigint>, docs array<int>"
)


def _unwritten() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies are written.

    Visible Latin-1 characters stand for themselves, the other bytes for characters from 256 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + no): byte for no, byte in enumerate(hidden)}


class Side:
    """One tokenizer and the bytes of its ids."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.lengths = np.array([len(token) for token in token_bytes], np.int64)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text after one space; none for an empty text."""
        raise NotImplementedError

    def faithful(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text after one space, None where their bytes are something else."""
        out: list[np.ndarray | None] = []
        for text, ids in zip(texts, self.encode_all(texts)):
            same = b"".join(map(self.token_bytes.__getitem__, ids)) == (" " + text).encode()
            out.append(np.array(ids, np.int32) if same and text else None)
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has; -1 where it is not faithful.

        Many words are encoded as one text, which is cut at its spaces.
        """
        ids, sizes = [], []
        for start in range(0, len(words), WORDS_AT_ONCE):
            part = words[start : start + WORDS_AT_ONCE]
            (joint,) = self.faithful([" ".join(part)])
            if joint is None:
                for own in self.faithful(part):
                    ids.append(np.zeros(0, np.int32) if own is None else own)
                    sizes.append([-1 if own is None else len(own)])
                continue
            token_ends = np.cumsum(self.lengths[joint])
            word_ends = np.cumsum([len(word.encode()) + 1 for word in part])
            cuts = np.searchsorted(token_ends, word_ends)
            if not np.array_equal(token_ends[cuts], word_ends):
                raise ValueError("a token reaches over a space")
            ids.append(joint)
            sizes.append(np.diff(cuts, prepend=-1))
        return self._without_space(words, np.concatenate(ids), np.concatenate(sizes))

    def _without_space(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin with a line end follow no space: they lose the token that stands for it."""
        own = np.maximum(sizes, 0)
        after_line = np.fromiter((word[:1] == "\n" for word in words), bool, len(words)) & (sizes > 0)
        first = (np.cumsum(own) - own)[after_line]
        if (self.lengths[ids[first]] != 1).any():
            raise ValueError("a token reaches over a line end")
        return np.delete(ids, first), sizes - after_line


class ByteLevel(Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _unwritten()
        pieces: list[bytes] = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        super().__init__(pieces)
        self.ranked = self._ranked(path)

    def _ranked(self, path: str) -> tiktoken.Encoding | None:
        """The same merges by rank, several times faster; None where ids don't ascend as merges do."""
        with open(path, encoding="utf-8") as lines:
            model = json.load(lines)["model"]
        joined = ["".join(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
        ids = [model["vocab"].get(token) for token in joined]
        singles = sorted(i for token, i in model["vocab"].items() if len(token) == 1)
        if singles != list(range(256)) or ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {self.token_bytes[i]: i for i in range(256 + len(ids))}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        # The two libraries follow different versions of Unicode, which agree on ASCII.
        ascii_only = [self.ranked is not None and text.isascii() for text in texts]
        rest = [" " + text for text, plain in zip(texts, ascii_only) if not plain]
        others = iter(self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else [])
        return [self.ranked.encode_ordinary(" " + text) if plain else next(others).ids for text, plain in zip(texts, ascii_only)]


class Pieces(Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(self.tokenizer.get_piece_size()):
            piece = self.tokenizer.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} reaches over a space")
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if self.tokenizer.is_byte(i) else None
            pieces.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode())
        super().__init__(pieces)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(texts, num_threads=1) if texts else []


class Memory:
    """Words met before and both sides' ids of them, in one array for each side."""

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        #: Of each side: the ids of all words in a row, and where each word's begin; a last one ends them.
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]
        self.begin = [np.zeros(1, np.int64) for _ in self.sides]
        #: Words without tokens: a text with one has none.
        self.bad = np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        bad = np.zeros(len(words), bool)
        for no, side in enumerate(self.sides):
            ids, sizes = side.words(words)
            bad |= sizes < 0
            ends = self.begin[no][-1] + np.cumsum(np.maximum(sizes, 0))
            self.flat[no] = np.concatenate([self.flat[no], ids])
            self.begin[no] = np.concatenate([self.begin[no], ends])
        self.bad = np.concatenate([self.bad, bad])

    def encode(self, rows: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; none where their bytes are not a space and the text."""
        if len(self.number) > MAX_WORDS:
            self._forget()
        none = np.zeros(0, np.int32)
        out = [(none, none)] * len(rows)
        by_word = [at for at, row in enumerate(rows) if row and _is_plain(row)]
        plain = set(by_word)
        whole = [at for at, row in enumerate(rows) if row and at not in plain]
        for at, *both in zip(whole, *(side.faithful([rows[at] for at in whole]) for side in self.sides)):
            if all(ids is not None for ids in both):
                out[at] = tuple(both)
        if not by_word:
            return out
        words = " ".join(rows[at] for at in by_word).replace("\n", " \n").split(" ")
        fresh = [word for word in set(words) if word not in self.number]
        if fresh:
            self._learn(sorted(fresh, key=str.isascii))
        asked = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([rows[at].count(" ") + rows[at].count("\n") + 1 for at in by_word])
        starts = np.concatenate([[0], ends[:-1]])
        faults = np.add.reduceat(self.bad[asked].astype(np.int64), starts)
        each = [self._gathered(no, asked, ends) for no in range(len(self.sides))]
        for at, fault, *both in zip(by_word, faults.tolist(), *each):
            if not fault:
                out[at] = tuple(both)
        return out

    def _gathered(self, no: int, asked: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of one side of each text, whose words' numbers end at ``ends``."""
        first = self.begin[no][asked]
        size = self.begin[no][asked + 1] - first
        upto = np.cumsum(size)
        places = np.repeat(first - (upto - size), size)
        places += np.arange(len(places))
        return np.split(self.flat[no][places], upto[ends[:-1] - 1])


def _is_plain(text: str) -> bool:
    """Whether blanks are single spaces and line ends between other characters, without B's mark of a space."""
    return SPACE not in text and " ".join(text.split()) == text.replace("\n", " ")


@lru_cache(maxsize=1)
def memory(a_path: str, b_path: str) -> Memory:
    """Both tokenizers and what they have met, once for each worker."""
    return Memory((ByteLevel(a_path), Pieces(b_path)))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


class Aligned:
    """Tokens of a block of documents, aligned.

    ``a`` and ``b`` are frames with ``doc``, ``at`` (first byte in the block), ``no`` and ``id``;
    ``left`` and ``right`` number the linked tokens.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], left: Side, right: Side):
        self.a, self.b = (self._frame([row[no] for row in rows], side) for no, side in ((0, left), (1, right)))
        covering = ["doc", "at", "no"]
        down = pd.merge_asof(self.a, self.b[covering].rename(columns={"no": "other"}).assign(begin=self.b["at"]), on="at", by="doc")
        up = pd.merge_asof(self.b, self.a[covering].rename(columns={"no": "other"}).assign(begin=self.a["at"]), on="at", by="doc")
        # Tokens that start together are found from both sides; they are linked once and open a group.
        self.a_opens = (down["begin"] == down["at"]).to_numpy()
        self.b_opens = (up["begin"] == up["at"]).to_numpy()
        inside = ~self.b_opens
        self.left = np.concatenate([down["no"].to_numpy(), up["other"].to_numpy()[inside]])
        self.right = np.concatenate([down["other"].to_numpy(), up["no"].to_numpy()[inside]])

    @staticmethod
    def _frame(rows: list[np.ndarray], side: Side) -> pd.DataFrame:
        ids = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
        return pd.DataFrame({"doc": doc, "at": _starts(side.lengths[ids]), "no": np.arange(len(ids)), "id": ids})

    def groups(self, n_rows: int, left: Side, right: Side) -> tuple[np.ndarray, list[str]]:
        """Number of groups of each document, and the groups written as ``a1,a2|b1;a3|b2,b3``."""
        a_group, b_group = np.cumsum(self.a_opens) - 1, np.cumsum(self.b_opens) - 1
        n_groups = int(self.a_opens.sum())
        a_count, b_count = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        order = np.empty(len(a_group) + len(b_group), np.int64)
        last_a = np.append(a_group[1:] != a_group[:-1], True) if len(a_group) else np.zeros(0, bool)
        last_b = np.append(b_group[1:] != b_group[:-1], True) if len(b_group) else np.zeros(0, bool)
        size = max(len(left.token_bytes), len(right.token_bytes))
        order[np.arange(len(a_group)) + _starts(b_count)[a_group]] = self.a["id"].to_numpy() + size * last_a
        order[np.arange(len(b_group)) + np.cumsum(a_count)[b_group]] = self.b["id"].to_numpy() + 2 * size * last_b
        shown = _numerals(size)
        doc = self.a["doc"].to_numpy()
        per_doc = np.bincount(doc, minlength=n_rows) + np.bincount(self.b["doc"].to_numpy(), minlength=n_rows)
        ends = np.cumsum(per_doc).tolist()
        codes, out, start = order.tolist(), [], 0
        for end in ends:
            out.append("".join(map(shown.__getitem__, codes[start:end]))[:-1])
            start = end
        return np.bincount(doc[self.a_opens], minlength=n_rows), out


@lru_cache(maxsize=1)
def _numerals(size: int) -> list[str]:
    """Decimal ids with the sign that follows: inside a side, after A's last, after B's last."""
    return [f"{i}{sign}" for sign in ",|;" for i in range(size)]


def _block_row(doc_id: pa.Array, rows: list[bytes], known: Memory) -> pa.RecordBatch:
    a, b = known.sides
    aligned = Aligned(known.encode([row.decode("utf-8", "replace") for row in rows]), a, b)
    n_rows, n_b_ids = len(rows), len(b.token_bytes)
    n_groups, shown = aligned.groups(n_rows, a, b)
    a_ids, b_ids, a_doc = (x.to_numpy() for x in (aligned.a["id"], aligned.b["id"], aligned.a["doc"]))
    pair = a_ids[aligned.left] * n_b_ids + b_ids[aligned.right]
    pairs, place = np.unique(pair, return_inverse=True)
    doc = a_doc[aligned.left]
    held, times = np.unique(doc * max(1, len(pairs)) + place, return_counts=True)
    holder, place = np.divmod(held, max(1, len(pairs)))
    count = lambda values: np.bincount(values, minlength=n_rows)
    longs = {
        "doc_id": doc_id,
        "n_a": count(a_doc),
        "n_b": count(aligned.b["doc"].to_numpy()),
        "n_groups": n_groups,
        "n_links": count(doc),
        "pairs": pairs,
    }
    ints = {"n_pairs": count(holder), "place": place, "times": times, "docs": np.bincount(place, minlength=len(pairs))}
    digests = pa.array([sha256(text.encode()).hexdigest() if text else "" for text in shown], pa.string())
    columns = {"block": pa.array([uuid4().hex]), "groups": _as_row(digests)}
    columns |= {name: _as_row(pa.array(values, pa.int64())) for name, values in longs.items()}
    columns |= {name: _as_row(pa.array(values, pa.int32())) for name, values in ints.items()}
    names = [field.split()[0] for field in ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([columns[name] for name in names], names)


def _as_row(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def align_blocks(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of documents: their figures, and their links as places in ``pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(a_path, b_path)
        for batch in batches:
            for block in blocks(batch, ALIGN_BYTES):
                yield _block_row(block.column("doc_id"), texts(block), known)

    return id_and_text(documents).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, n_b_ids: int) -> DataFrame:
    """``pair``, the number of documents that hold it linked, and whether no pair of its A id has more."""
    held = aligned.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n_docs"))
    counts = written(held.withColumn("a", F.expr(f"pair div {n_b_ids}")))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    # One row for each id of A's vocabulary at most.
    return counts.join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _summed(aligned: pa.Table, counted: pa.Table) -> pa.Table:
    """Figures of a block's documents; ``counted`` has the block's pairs with their counts."""
    at = np.asarray(counted.column("at"), np.int64)
    n_docs, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n_docs[at] = np.asarray(counted.column("n_docs"), np.int64)
    best[at] = np.asarray(counted.column("best")).astype(np.int64)
    row = {name: aligned.column(name).combine_chunks().flatten() for name in aligned.column_names if name != "block"}
    sizes, used, times = (np.asarray(row[name], np.int64) for name in ("n_pairs", "place", "times"))
    doc = np.repeat(np.arange(len(sizes)), sizes)

    def total(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        np.add.at(out, doc, values)
        return out

    columns = [row[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    columns += [pa.array(total(times * best[used])), pa.array(total(times * n_docs[used])), row["groups"]]
    return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: tokens, groups and links of the two tokenizers, and how usual its links are.

    ``a_path`` is a byte-level tokenizer file, ``b_path`` a piece model; every worker has both.
    """
    # A row is a block of some megabytes; small row groups bound what a reader holds.
    aligned = written(align_blocks(documents, a_path, b_path), **{"parquet.block.size": ROW_GROUP_BYTES})
    counts = pair_counts(aligned, len(memory(a_path, b_path).sides[1].token_bytes))
    listed = aligned.select(F.col("block").alias("holder"), F.posexplode("pairs").alias("at", "pair"))
    counted = listed.join(counts, "pair").select("holder", "at", "n_docs", "best")
    figures = aligned.drop("pairs", "docs").groupBy("block").cogroup(counted.groupBy("holder"))
    return figures.applyInArrow(
        _summed,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    )
