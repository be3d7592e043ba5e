"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where more than half of the XXH64 hashes of its word
shingles have it. Two fingerprints are linked at three or fewer differing bits.

The perfect binary Golay code has one codeword within distance 3 of any 23-bit word and at most
five more at distance 4. So for two words that differ in one bit, the codeword nearest to the one
is among the up to six codewords near the other: codeword indices are keys that forgive an error.
Errors are dealt by pigeonhole. Five pieces of a fingerprint share three errors, so two pieces
agree; of the two halves of what is left, one has at most one error. A key is two whole pieces and
the index of a codeword near a half: 20 keys name a fingerprint's nearest codewords, 120 all of
them. Each fingerprint is filed under the former and looked up under the latter; candidates are
verified on all 64 bits in the join. About 38 bits of a key are free, so buckets stay small: only
distinct fingerprints are joined, and adaptive execution can split a bucket that is large all the same.

Classes are the connected components of the links; copies share one fingerprint and are never
paired. At most 43,744 other words lie within three bits of a fingerprint, whatever the corpus.

Defined cases: null, empty and blank texts have no shingles and fingerprint zero, which is linked
like any other; a text with fewer words than a shingle has its whole sequence as one; repeated rows
and ids each keep a row; a row without an id is in its class but never names it; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.llm.batches import blocks, id_and_text, texts, written
from broadsheet.llm.components import connected_components

SEED = 42
#: Most differing bits of a link; the pigeonhole of ``key_plan`` is laid out for three.
MAX_DISTANCE = 3
PIECES = 5
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 17

#: The generator polynomial of the binary Golay code of 23 bits, 12 of them information.
GENERATOR = 0b110001110101
LENGTH, CHECK_BITS = 23, 11
#: Codewords at most at distance 4 of a word.
MOST_NEAR = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of words by their upper and lower bits, and error patterns by remainder.

    Row ``r`` of the patterns lists what leads from a word of remainder ``r`` to codewords: first to
    the nearest, then to those at distance 4; -1 fills up.
    """
    ones = [_remainder(1 << bit) for bit in range(LENGTH)]

    def span(bits: list[int]) -> np.ndarray:
        table = np.zeros(1 << len(bits), np.int64)
        for at, value in enumerate(bits):
            table[1 << at : 2 << at] = table[: 1 << at] ^ value
        return table

    patterns = np.full((1 << CHECK_BITS, MOST_NEAR), -1, np.int64)
    used = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            pattern = remainder = 0
            for place in places:
                pattern |= 1 << place
                remainder ^= ones[place]
            patterns[remainder, used[remainder]] = pattern
            used[remainder] += 1
    return span(ones[12:]), span(ones[:12]), patterns


_UPPER, _LOWER, _PATTERNS = _golay_tables()


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (their 12 information bits) of the codewords near each word, the nearest first; -1 fills up."""
    words = words.astype(np.int64)
    patterns = _PATTERNS[_UPPER[words >> 12] ^ _LOWER[words & 0xFFF]]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> CHECK_BITS)


def key_plan() -> list[tuple[list[int], list[int]]]:
    """For each kind of key: the bits taken whole and the bits of the half that may hold one error."""
    pieces = [list(range(64 * no // PIECES, 64 * (no + 1) // PIECES)) for no in range(PIECES)]
    plan = []
    for whole in combinations(range(PIECES), PIECES - MAX_DISTANCE):
        rest = [bit for no in range(PIECES) if no not in whole for bit in pieces[no]]
        for half in (rest[: len(rest) // 2], rest[len(rest) // 2 :]):
            plan.append(([bit for no in whole for bit in pieces[no]], half))
    return plan


def _gathered(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint next to each other, run by run."""
    out = np.zeros(len(prints), np.uint64)
    at = start = 0
    while start < len(bits):
        end = start + 1
        while end < len(bits) and bits[end] == bits[end - 1] + 1:
            end += 1
        width = end - start
        out |= ((prints >> np.uint64(bits[start])) & np.uint64((1 << width) - 1)) << np.uint64(at)
        at, start = at + width, end
    return out.astype(np.int64)


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints: row numbers, keys, and whether the codeword is the nearest."""
    rows, keys, nearest = [], [], []
    for kind, (whole, half) in enumerate(key_plan()):
        codes = near_codewords(_gathered(prints, half))
        base = (kind << 26 | _gathered(prints, whole)) << 12
        row, place = np.nonzero(codes >= 0)
        rows.append(row)
        keys.append(base[row] | codes[row, place])
        nearest.append(place == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(nearest)


def hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    digest = xxhash.xxh64_intdigest
    found = (digest(line[start:end], SEED) for start, end in zip(starts, (ends[width - 1 :] - 1).tolist()))
    return np.fromiter(found, np.uint64, len(starts))


def _bit_counts(values: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for start in range(0, len(values), CHUNK):
        part = np.ascontiguousarray(values[start : start + CHUNK], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(values: np.ndarray) -> int:
    """The fingerprint of the hashes, as an unsigned number; none give zero."""
    bits = 2 * _bit_counts(values) > len(values)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``print``, the fingerprint as a signed number; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                prints = np.array([fingerprint(hashes(text, width)) for text in texts(block)], np.uint64)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return id_and_text(documents).mapInArrow(run, "doc_id bigint, print bigint")


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False)
        for start in range(0, len(prints), 2_000):
            part = prints[start : start + 2_000]
            row, key, nearest = fingerprint_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(nearest)], ["key", "print", "nearest"])


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``print``, each once) within three bits."""
    keys = prints.select("print").mapInArrow(_filed, "key bigint, print bigint, nearest boolean")
    filed = keys.where("nearest").select("key", F.col("print").alias("a"))
    sought = keys.select("key", F.col("print").alias("b"))
    # Each is found under the other's nearest codeword, so one direction is enough.
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
    # Spark sizes the 120 keys of a fingerprint like the one it comes from: no broadcast at any size.
    return filed.join(sought.hint("merge"), (filed["key"] == sought["key"]) & near).select("a", "b").distinct()


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def simhash_groups(documents: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` as 16 hex digits, and ``component_id``, the class's smallest id."""
    signed = written(fingerprints(documents, width))
    prints = written(signed.groupBy("print").agg(F.min("doc_id").alias("least")))
    labels = connected_components(links(prints)).select(F.col("id").alias("print"), "component")
    # Labels, roots and prints grow with the corpus, and their files are smaller than their rows: no broadcast at any size.
    joined = prints.join(labels.hint("merge"), "print", "left")
    named = joined.withColumn("component", F.coalesce("component", "print"))
    named = written(named)
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.select("print", "component").join(roots.hint("merge"), "component").select("print", "component_id")
    return signed.join(by_print.hint("merge"), "print").select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")
