"""Exact removal of repeated byte strings by common-prefix interval trees.

A string of ``window`` bytes that two texts share must contain the same least gram (by hash), so
every window is filed under its least gram: a text becomes pieces, maximal runs of windows with
one least gram, and equal windows of any two texts meet in one bucket. There is a bucket for each
``BUCKET_BYTES`` of the corpus. The text of each gram is counted first; windows of a gram with more
than ``BUCKET_BYTES`` are filed under their next-least gram too, and so on, at last under a hash of
the whole window: equal windows share all of these. What cannot be split are equal windows, which
each block sends once. Before the shuffle, a piece that occurs in
several documents of a block leaves it once, for the smallest document; for the others the
verdict is known already and they only send a span.

In a bucket, pieces whose gram no other piece has are done, and so are those in which the gram's
neighbourhood, of a length that every window has on one side of it, is nowhere else. The others get
an enhanced suffix array: all suffixes of at least ``window`` bytes in order, with the common prefixes of neighbours.
A scan with a stack gives the tree of common-prefix intervals; an interval whose occurrences
follow different bytes (or begin a piece) is a maximal repeat, and it is put out with all its
occurrences. A repeat longer than a piece appears as overlapping maximal repeats, one for each piece.

Defined cases: null or empty text has no bytes; texts shorter than the window lose nothing; rows
repeated under one ``doc_id`` are judged against smaller ids only, never against each other; a null
``doc_id`` counts as greater than every id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.batches import blocks, texts, written

WINDOW = 50
GRAM = 8
#: Windows in a piece at most; a longer run is cut into pieces that share all but one byte of a window.
RUN = 79
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 2_000_000
#: Next-least grams that hot windows are filed under before the hash of the whole window.
LEVELS = 6
#: Hot keys every worker holds at most, those with most text.
MAX_HOT = 1_000_000
#: Rows with spans whose keys are broadcast at most; with more, all texts meet the spans by shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Suffixes put out at a time.
CHUNK = 500_000
#: Bit of a piece's gram that tells pieces filed under further keys.
REFILED = np.uint32(1)
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).max
#: Stands for a window without a further gram.
NO_GRAM = np.iinfo(np.uint64).max


def gram_hashes(data: bytes, size: int = GRAM) -> np.ndarray:
    """Hash of the gram at every byte; ``size`` is between 8 and 16."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    n = len(data) - size + 1
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= words[size - 8 : size - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def least_grams(data: bytes, window: int = WINDOW, size: int = GRAM) -> np.ndarray:
    """Least gram hash of every window."""
    low, width, need = gram_hashes(data, size), 1, window - size + 1
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    return low


def pieces(data: bytes, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Text number, start, end and least gram of every piece of concatenated texts."""
    sizes = np.diff(offsets)
    if len(data) < window:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    low = least_grams(data, window)
    after = offsets[:-1] + np.maximum(sizes - window + 1, 0)
    starts = np.unique(np.concatenate([np.flatnonzero(low[1:] != low[:-1]) + 1, offsets[:-1], after]))
    starts = starts[starts <= len(low)]
    ends = np.append(starts[1:], len(low))
    text = np.searchsorted(offsets, starts, "right") - 1
    good = (text < len(sizes)) & (starts < after[np.minimum(text, len(sizes) - 1)]) & (starts < ends)
    starts, ends, text = starts[good], ends[good], text[good]
    parts = -(-(ends - starts) // RUN)
    first = np.repeat(starts, parts)
    order = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first + order * RUN
    finish = np.minimum(begin + RUN, np.repeat(ends, parts)) + window - 1
    return np.repeat(text, parts), begin, finish, low[begin]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _split(data: bytes, begin: np.ndarray, finish: np.ndarray, key: np.ndarray, least: np.ndarray, level: int, window: int):
    """Runs of windows of pieces that share one further key: piece number, start, end, key and least gram.

    ``least`` is the greatest gram used so far; at ``LEVELS`` the window's own hash is the key.
    """
    size = finish - begin
    blob = b"".join([data[a:b] for a, b in zip(begin.tolist(), finish.tolist())])
    h = gram_hashes(blob)
    heads, counts = np.cumsum(size) - size, size - window + 1
    at = _spread(heads, counts)
    if level < LEVELS:
        h[h <= np.repeat(least, size)[: len(h)]] = NO_GRAM
        low, width, need = h, 1, window - GRAM + 1
        while 2 * width <= need:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        further = np.minimum(low[at], low[at + need - width])
    else:
        further = h[at]
        for k in [*range(GRAM, window - GRAM, GRAM), window - GRAM]:
            further = _mixed(further, h[at + k])
    owner = np.repeat(np.arange(len(size)), counts)
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (further[1:] != further[:-1])))
    runs = np.diff(np.append(new, len(at)))
    piece = owner[new]
    start = begin[piece] + at[new] - heads[piece]
    return piece, start, start + runs + window - 1, _mixed(key[piece], further[new]), further[new]


def refiled(data: bytes, text, begin, finish, low, hot: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces with those of hot keys (sorted) cut by further keys until no key is hot, and which are."""
    done, key, least = [], low, low
    for level in range(LEVELS + 1):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        again = hot[at] == key
        done.append((text[~again], begin[~again], finish[~again], key[~again], np.full(int((~again).sum()), level > 0)))
        text = text[again]
        if not len(text):
            break
        piece, begin, finish, key, least = _split(data, begin[again], finish[again], key[again], least[again], level, window)
        text = text[piece]
    else:
        done.append((text, begin, finish, key, np.full(len(text), True)))
    return tuple(np.concatenate([d[k] for d in done]) for k in range(5))


def count_keys(share: float, window: int):
    """Mapper: keys, of whatever level, that have more than a share of a block's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, BLOCK_BYTES):
                body = texts(block)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in body])]).astype(np.int64)
                data = b"".join(body)
                _, begin, finish, key = pieces(data, offsets, window)
                least, keys, sizes = key, [], []
                for level in range(LEVELS + 1):
                    if not len(key):
                        break
                    names, which = np.unique(key, return_inverse=True)
                    size = np.bincount(which, finish - begin).astype(np.int64)
                    heavy = size > share * len(data)
                    keys.append(names[heavy].view(np.int64))
                    sizes.append(size[heavy])
                    again = heavy[which]
                    if level == LEVELS or not again.any():
                        break
                    _, begin, finish, key, least = _split(data, begin[again], finish[again], key[again], least[again], level, window)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], ["key", "size"])

    return run


def hot_keys(rows: DataFrame, total: int, window: int) -> np.ndarray:
    """Keys with more than ``BUCKET_BYTES`` of text, sorted.

    A block leaves out keys with less than its share of half a bucket, so all blocks together miss
    less than half a bucket of any key. Whichever keys are taken, the result is the same.
    """
    counted = rows.mapInArrow(count_keys(BUCKET_BYTES / (2 * total), window), "key bigint, size bigint")
    hot = counted.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > BUCKET_BYTES // 2)
    found = hot.orderBy(F.desc("size")).limit(MAX_HOT).select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(np.uint64))


OF_CONTENT = (("low", np.uint32), ("size", np.uint8))
OF_OCCURRENCE = (("doc", np.int64), ("row", np.uint32), ("start", np.int32), ("which", np.int32))


def _pack(**arrays) -> bytes:
    """Occurrences (``doc``, ``row``, ``start``, ``which``) of distinct contents (``low``, ``size``, ``content``)."""
    counts = np.array([len(arrays["low"]), len(arrays["doc"])], np.int32)
    body = b"".join([counts.tobytes(), *(arrays[k].tobytes() for k, _ in (*OF_CONTENT, *OF_OCCURRENCE)), arrays["content"]])
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(payload: bytes) -> dict:
    body = zstandard.ZstdDecompressor().decompress(payload)
    counts = np.frombuffer(body, np.int32, 2)
    at, out = 8, {}
    for names, n in zip((OF_CONTENT, OF_OCCURRENCE), counts.tolist()):
        for name, kind in names:
            out[name] = np.frombuffer(body, kind, n, at)
            at += n * np.dtype(kind).itemsize
    out["doc"] = np.cumsum(out["doc"])
    out["content"] = body[at:]
    return out


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each row united where they overlap or touch."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Ends so far, never across rows: rows lie one behind the other on a common line.
    shift = np.cumsum(np.append(0, row[1:] != row[:-1])) * (np.int64(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, (start + shift)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], (reach - shift)[np.append(at[1:], len(row)) - 1]


def file_pieces(n_buckets: int, window: int, hot: np.ndarray | None = None, groups: bool = False):
    """Mapper: blocks of texts to packed pieces by bucket, and spans that are settled already.

    With ``groups``, settled pieces send their occurrences too; a content leaves the block once
    all the same. ``hot`` are the keys whose windows are filed under a further key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, BLOCK_BYTES):
                docs = block.column("doc_id").fill_null(NO_ID).to_numpy()
                rows = block.column("row").to_numpy()
                body = texts(block)
                # Smallest documents first, each row once.
                order = np.lexsort((rows, docs))
                once = np.append(True, (docs[order][1:] != docs[order][:-1]) | (rows[order][1:] != rows[order][:-1]))
                order = order[once[: len(order)]]
                docs, rows, body = docs[order], rows[order], [body[i] for i in order]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in body])]).astype(np.int64)
                data = b"".join(body)
                text, begin, finish, low = pieces(data, offsets, window)
                further = np.zeros(len(text), bool)
                if hot is not None and len(hot):
                    text, begin, finish, low, further = refiled(data, text, begin, finish, low, hot, window)
                content = [data[a:b] for a, b in zip(begin.tolist(), finish.tolist())]
                seen: dict[bytes, int] = {}
                first = np.fromiter((seen.setdefault(c, i) for i, c in enumerate(content)), np.int64, len(content))
                settled = docs[text] > docs[text[first]] if len(text) else np.zeros(0, bool)
                start = begin - offsets[text]
                out_bucket, out_payload = [], []
                done = np.flatnonzero(settled)
                spans = merged(text[done], start[done], start[done] + finish[done] - begin[done])
                ship = np.arange(len(text)) if groups else np.flatnonzero(~settled)
                bucket = ((low[ship] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
                ranked = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(bucket[ranked]) != 0)) if len(ranked) else []
                for a, b in zip(cuts, [*cuts[1:], len(ranked)]):
                    part = ship[ranked[a:b]]
                    doc = docs[text[part]]
                    leads, which = np.unique(first[part], return_inverse=True)
                    out_bucket.append(int(bucket[ranked[a]]))
                    out_payload.append(
                        _pack(
                            low=low[leads].astype(np.uint32) & ~REFILED | further[leads],
                            doc=np.diff(doc, prepend=np.int64(0)),
                            row=rows[text[part]].astype(np.uint32),
                            start=start[part].astype(np.int32),
                            size=(finish[leads] - begin[leads]).astype(np.uint8),
                            which=which.astype(np.int32),
                            content=b"".join([content[i] for i in leads.tolist()]),
                        )
                    )
                if len(spans[0]):
                    # Any bucket will do; ids spread the blocks.
                    out_bucket.append((int(docs[0]) * 31 + int(docs[-1]) * 17 + int(rows[0])) % n_buckets)
                    out_payload.append(None)
                k = len(spans[0])
                packed = [None] * (len(out_payload) - bool(k))
                table = np.stack([docs[spans[0]], rows[spans[0]], spans[1], spans[2]]).astype(np.int64).tobytes() if k else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_bucket, pa.int32()), pa.array(out_payload, pa.binary()), pa.array(packed + [table] * bool(k), pa.binary())],
                    ["bucket", "payload", "settled"],
                )

    return run


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of rows of big-endian words."""
    differ = a != b
    any_differ = differ.any(axis=1)
    word = np.where(any_differ, differ.argmax(axis=1), a.shape[1])
    safe = np.minimum(word, a.shape[1] - 1)
    rows = np.arange(len(a))
    x = a[rows, safe] ^ b[rows, safe]
    lead = np.zeros(len(a), np.int64)
    for k in range(8):
        lead += (x >> np.uint64(8 * (7 - k))) == 0
    return np.where(any_differ, 8 * word + np.minimum(lead, 7), 8 * a.shape[1])


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The big-endian word of eight bytes at every position; ``data`` is padded."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))[at].astype(np.uint64)


def interval_tree(contents: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Maximal repeats of at least ``window`` bytes: length, first and end in the list of
    occurrences, then that list: piece numbers and offsets in the order of the suffix array.

    Pieces are distinct. A left neighbour differs if the bytes before two occurrences do or if
    an occurrence begins its piece.
    """
    nothing = (np.zeros(0, np.int64),) * 5
    sizes = np.array([len(c) for c in contents], np.int64)
    wide = -(-int(sizes.max()) // 8)
    data = np.frombuffer(b"".join(contents) + bytes(8 * wide + 16), np.uint8)
    heads = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - window + 1, 0)
    piece = np.repeat(np.arange(len(contents), dtype=np.int32), counts)
    offset = (np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    at = heads[piece] + offset
    # Suffixes whose first window is unique are in no interval.
    words = [_word(data, at + 8 * k) for k in range(-(-window // 8))]
    if window % 8:
        words[-1] >>= np.uint64(64 - 8 * (window % 8))
    order = np.lexsort(words[::-1])
    equal = np.ones(max(len(order) - 1, 0), bool)
    for word in words:
        ordered = word[order]
        equal &= ordered[1:] == ordered[:-1]
    del words
    grouped = np.append(equal, False) | np.append(False, equal) if len(order) else np.zeros(0, bool)
    group = np.cumsum(np.append(True, ~equal))[grouped] if len(order) else order
    chosen = order[grouped]
    if not len(chosen):
        return nothing
    # Groups that follow one and the same byte everywhere are no maximal repeats, nor is any part.
    left = np.where(offset[chosen] > 0, data[np.maximum(at[chosen] - 1, 0)].astype(np.int64), -1 - np.arange(len(chosen)))
    edge = np.flatnonzero(np.append(True, np.diff(group) != 0))
    diverse = np.minimum.reduceat(left, edge) != np.maximum.reduceat(left, edge)
    keep = np.repeat(diverse, np.diff(np.append(edge, len(group))))
    chosen, group = chosen[keep], group[keep]
    if not len(chosen):
        return nothing
    rest = sizes[piece[chosen]] - offset[chosen]
    full = []
    for k in range(wide):
        # Bytes beyond the piece do not count.
        over = np.clip(8 * (k + 1) - rest, 0, 8).astype(np.uint64)
        shift = over * np.uint64(8) % np.uint64(64)
        full.append(np.where(over >= 8, np.uint64(0), (_word(data, at[chosen] + 8 * k) >> shift) << shift))
    order = np.lexsort((*full[::-1], group))
    chosen, group, rest = chosen[order], group[order], rest[order]
    full = np.stack([word[order] for word in full], axis=1)
    lcp = np.zeros(len(chosen) + 1, np.int64)
    lcp[1:-1] = np.minimum(np.minimum(common_prefix(full[:-1], full[1:]), rest[:-1]), rest[1:])
    lcp[1:-1][group[1:] != group[:-1]] = 0
    del full
    # The stack holds open intervals: common prefix and left end.
    stack: list[tuple[int, int]] = []
    found: list[tuple[int, int, int]] = []
    for i, length in enumerate(lcp[1:].tolist(), 1):
        left_end = i - 1
        while stack and stack[-1][0] > length:
            value, left_end = stack.pop()
            found.append((value, left_end, i))
        if length >= window and (not stack or stack[-1][0] < length):
            stack.append((length, left_end))
    length, low, high = np.array(found, np.int64).reshape(-1, 3).T
    # Running counts tell whether the bytes before an interval's occurrences differ.
    before = np.where(offset[chosen] > 0, data[np.maximum(at[chosen] - 1, 0)].astype(np.int64), -1)
    changes = np.append(0, np.cumsum(before[1:] != before[:-1]))
    begins = np.append(0, np.cumsum(before < 0))
    differ = (changes[high - 1] > changes[low]) | (begins[high] > begins[low])
    return length[differ], low[differ], high[differ], piece[chosen].astype(np.int64), offset[chosen].astype(np.int64)


def sharing(contents: list[bytes], low: np.ndarray, window: int) -> np.ndarray:
    """Which pieces may hold a window that another place of the bucket holds too.

    A window has its least gram somewhere and at least half of its other bytes on one side of it.
    So a gram with that many bytes before it, or behind it, comes again wherever the window does.
    Pieces filed under further keys (``REFILED``) stay.
    """
    side = -(-(window - GRAM) // 2)
    sizes = np.array([len(c) for c in contents], np.int64)
    heads = np.cumsum(sizes) - sizes
    data = b"".join(contents) + bytes(GRAM)
    h = gram_hashes(data)
    marks = np.repeat(low.astype(np.uint32) & ~REFILED, sizes)
    at = np.flatnonzero((h[: len(marks)].astype(np.uint32) & ~REFILED) == marks)
    piece = np.searchsorted(heads, at, "right") - 1
    before, behind = at - heads[piece], heads[piece] + sizes[piece] - at
    keys, owners = [], []
    for good, begin, tag in ((before >= side, at - side, 1), (behind >= GRAM + side, at, 2)):
        begin = begin[good]
        key = np.full(len(begin), tag, np.uint64)
        for k in [*range(0, side, GRAM), side]:
            key = _mixed(key, h[begin + k])
        keys.append(key)
        owners.append(piece[good])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.append(same, False) | np.append(False, same)
    out = (low.astype(np.uint32) & REFILED) != 0
    out[owner[order[again[: len(order)]]]] = True
    return out


def maximal_repeats(contents: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, piece numbers and offsets of every maximal repeat."""
    lengths, low, high, piece, offset = interval_tree(contents, window)
    for length, a, b in zip(lengths.tolist(), low.tolist(), high.tolist()):
        yield length, piece[a:b], offset[a:b]


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] times each, one after the other."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _interval_spans(tree: tuple, least: np.ndarray, first: np.ndarray, by_content: np.ndarray, doc, row, start) -> Iterator[list]:
    """Spans of all intervals' occurrences in documents after the interval's smallest."""
    length, low, high, piece, offset = tree
    a = 0
    total = np.cumsum(high - low)
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK)))
        sizes = (high - low)[a:b]
        suffix = _spread(low[a:b], sizes)
        smallest = np.repeat(np.minimum.reduceat(least[piece[suffix]], np.cumsum(sizes) - sizes), sizes)
        long = np.repeat(length[a:b], sizes)
        # All occurrences: every document of every piece in the interval.
        here = piece[suffix]
        counts = first[here + 1] - first[here]
        at = by_content[_spread(first[here], counts)]
        later = doc[at] > np.repeat(smallest, counts)
        at = at[later]
        begin = start[at] + np.repeat(offset[suffix], counts)[later]
        code, begin, finish = merged(at, begin, begin + np.repeat(long, counts)[later])
        yield [doc[code], row[code], begin, finish]
        a = b


def _occurrences(found: list[tuple], distinct: list[bytes], least, first, by_content, doc, row, start):
    """Columns of all groups in several documents: intervals, and whole pieces that no interval has."""
    most = np.full(len(distinct), -1)
    np.maximum.at(most, np.repeat(np.arange(len(distinct)), np.diff(first)), doc[by_content])
    whole = {(n, c) for n, where, offset in found for c, o in zip(where.tolist(), offset.tolist()) if o == 0 and n == len(distinct[c])}
    alone = [c for c in np.flatnonzero(least < most).tolist() if (len(distinct[c]), c) not in whole]
    found = [*found, *((len(distinct[c]), np.array([c]), np.array([0])) for c in alone)]

    def columns(bucket: int) -> list[np.ndarray]:
        parts = [np.zeros((5, 0), np.int64)]
        for number, (length, where, offset) in enumerate(found):
            if least[where].min() == most[where].max():
                continue
            counts = first[where + 1] - first[where]
            at = by_content[_spread(first[where], counts)]
            # Rows repeated in several blocks are one occurrence.
            places = np.unique(np.stack([doc[at], row[at], start[at] + np.repeat(offset, counts)]), axis=1)
            parts.append(np.vstack([np.full((1, places.shape[1]), bucket << 32 | number), np.full((1, places.shape[1]), length), places]))
        return list(np.concatenate(parts, axis=1))

    return columns


def settle(window: int, groups: bool = False):
    """Reducer of one bucket: spans to remove, or with ``groups`` the maximal repeats themselves."""

    def empty() -> pd.DataFrame:
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in (GROUP_COLUMNS if groups else SPAN_COLUMNS)})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = [np.frombuffer(t, np.int64).reshape(4, -1) for t in frame["settled"] if t is not None]
        payloads = [_unpack(p) for p in frame["payload"] if p is not None]
        spans = [[k[0], k[1] & 0xFFFFFFFF, k[2], k[3]] for k in known]
        found: list[tuple] = []
        if payloads:
            low, size, doc, row, start = (np.concatenate([p[k] for p in payloads]) for k in ("low", "size", "doc", "row", "start"))
            heads = np.cumsum([0] + [len(p["low"]) for p in payloads])
            which = np.concatenate([p["which"].astype(np.int64) + head for p, head in zip(payloads, heads)])
            blob = b"".join([p["content"] for p in payloads])
            end = np.cumsum(size, dtype=np.int64)[which]
            low, size = low[which], size[which]
            # Grams that only one document has are done.
            order = np.argsort(low, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(low[order].astype(np.int64)) != 0))
            several = np.minimum.reduceat(doc[order], edge) < np.maximum.reduceat(doc[order], edge)
            shared = order[np.repeat(several, np.diff(np.append(edge, len(order))))]
            if len(shared):
                seen: dict[bytes, int] = {}
                sent, at = np.unique(which[shared], return_index=True)
                bounds = zip(end[shared][at].tolist(), size[shared][at].tolist())
                number = np.fromiter((seen.setdefault(blob[b - s : b], len(seen)) for b, s in bounds), np.int64, len(sent))
                content = number[np.searchsorted(sent, which[shared])]
                distinct = list(seen)
                doc, row, start, size, low = doc[shared], row[shared].astype(np.int64), start[shared].astype(np.int64), size[shared].astype(np.int64), low[shared]
                least = np.full(len(distinct), NO_ID)
                np.minimum.at(least, content, doc)
                # A piece that equals a smaller document's is a repeat as a whole.
                whole = doc > least[content]
                spans.append([doc[whole], row[whole], start[whole], (start + size)[whole]])
                # Grams with different pieces need the tree.
                gram_of = np.zeros(len(distinct), np.int64)
                gram_of[content] = low
                _, which, times = np.unique(gram_of, return_inverse=True, return_counts=True)
                mixed = np.flatnonzero(times[which] > 1)
                if len(mixed):
                    mixed = mixed[sharing([distinct[i] for i in mixed], gram_of[mixed], window)]
                by_content = np.argsort(content, kind="stable")
                first = np.searchsorted(content[by_content], np.arange(len(distinct) + 1))
                if len(mixed):
                    pieces_of = [distinct[i] for i in mixed]
                    if groups:
                        found += [(length, mixed[where], offset) for length, where, offset in maximal_repeats(pieces_of, window)]
                    else:
                        length, low_end, high_end, piece, offset = interval_tree(pieces_of, window)
                        if len(length):
                            tree = length, low_end, high_end, mixed[piece], offset
                            spans += _interval_spans(tree, least, first, by_content, doc, row, start)
                if groups:
                    out = _occurrences(found, distinct, least, first, by_content, doc, row, start)
                    return pd.DataFrame({k: v for k, v in zip(GROUP_COLUMNS, out(int(frame["bucket"].iloc[0])))})
        if groups or not spans:
            return empty()
        doc, row, begin, finish = (np.concatenate([s[k] for s in spans]) for k in range(4))
        if not len(doc):
            return empty()
        pairs, code = np.unique(np.stack([doc, row]), axis=1, return_inverse=True)
        code, begin, finish = merged(code.ravel().astype(np.int64), begin, finish)
        return pd.DataFrame(dict(zip(SPAN_COLUMNS, (pairs[0][code], pairs[1][code], begin, finish))))

    return run


SPAN_COLUMNS = ("doc", "tag", "start", "end")
GROUP_COLUMNS = ("repeat_id", "length", "doc", "tag", "start")


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    # Ids that occur once need nothing to tell their rows apart, and zeros cost nothing to move.
    unique = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    row = F.lit(0).cast("bigint") if unique else F.xxhash64("doc_id", "text")
    return rows.select("doc_id", row.alias("row"), F.col("text").cast("binary").alias("text"))


def _filed(rows: DataFrame, window: int, groups: bool = False) -> DataFrame:
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    hot = hot_keys(rows, total, window) if n_buckets > 1 else None
    return rows.mapInArrow(file_pieces(n_buckets, window, hot, groups), "bucket int, payload binary, settled binary")


def repeat_groups(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal repeats that lie in at least two documents, one row for each occurrence.

    ``tag`` tells rows of one id apart.
    """
    return _filed(_rows(documents), window, groups=True).groupBy("bucket").applyInPandas(
        settle(window, groups=True), "repeat_id bigint, length bigint, doc bigint, tag bigint, start bigint"
    )


def removed_spans(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans to remove, by ``doc`` (null id: the greatest number) and ``tag``; they may overlap."""
    return _filed(_rows(documents), window).groupBy("bucket").applyInPandas(
        settle(window), "doc bigint, tag bigint, start bigint, end bigint"
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            starts, ends = block.column("starts").to_pylist(), block.column("ends").to_pylist()
            for text, start, end in zip(texts(block), starts, ends):
                start, end = np.array(start or [], np.int64), np.array(end or [], np.int64)
                _, start, end = merged(np.zeros(len(start), np.int64), start, end)
                kept, at = [], 0
                for a, b in zip(start.tolist(), end.tolist()):
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int((end - start).sum()))
                out["n_spans"].append(len(start))
                out["kept"].append(b"".join(kept))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeats(documents: DataFrame, window: int = WINDOW, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every row with its remaining bytes (``kept``) and the counts of what was removed."""
    rows = _rows(documents)
    spans = written(removed_spans(documents, window))
    by_row = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("s")).select(
        "doc", "tag", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")
    )
    keyed = rows.withColumn("doc", F.coalesce("doc_id", F.lit(int(NO_ID)))).withColumn("tag", F.col("row").bitwiseAND(0xFFFFFFFF))
    found = spans.select("doc", "tag").distinct()
    if found.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        # Only texts that lose something move.
        hit, whole = (keyed.join(F.broadcast(found), ["doc", "tag"], how) for how in ("left_semi", "left_anti"))
        cut = hit.join(by_row, ["doc", "tag"]).select("doc_id", "text", "starts", "ends").mapInArrow(_cut, KEPT)
        size = F.octet_length("text").cast("bigint")
        nothing = F.lit(0).cast("bigint")
        return cut.union(whole.select("doc_id", size.alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.col("text").alias("kept")))
    return keyed.join(by_row, ["doc", "tag"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(_cut, KEPT)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
