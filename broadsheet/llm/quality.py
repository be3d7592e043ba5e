"""Quality rules: text statistics and a calibrated n-gram classifier.

Hashed word and character n-grams feed a logistic regression. It learns from a bounded sample
of labelled rows (``max_train``), is calibrated on the held-out part of that sample and scores
every text in Arrow batches against fixed thresholds.

Defined cases: a null or empty text has no words and fails the base rule; a null ``doc_id`` is
scored like any other row; repeated rows each give a row; labels that disagree count by their
mean; without labelled rows of both classes there is no model, ``p_quality`` is null and the
base rule alone decides; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.batches import blocks, id_and_text, texts

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Fixed thresholds on the calibrated probability of good quality.
KEEP_AT = 0.5
SURE_AT = 0.9
BUCKET_BITS = 16
#: Labelled rows the classifier is fitted on, at most; taken by hash of ``doc_id``.
MAX_TRAIN = 2_000
CALIBRATION_FOLDS = 4

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (
    "doc_id bigint, "
    + ", ".join(f"{name} bigint" for name in STATISTICS)
    + ", base_failed boolean, p_quality double, band string, kept boolean"
)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words by first appearance, and the distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, list(seen)


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words covered by windows of ``window`` words that occur at least twice."""
    n = len(ids)
    if n < window + 1:
        return 0
    # Ranks stay below n, so a pair of them fits 64 bits: windows are compared exactly.
    code = ids[: n - window + 1]
    for shift in range(1, window):
        code = code * np.int64(n + 1) + ids[shift : n - window + 1 + shift]
        code = _ranks(code)
    starts = np.bincount(code)[code] > 1
    if not starts.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, ...]:
    """The values named in ``STATISTICS``."""
    raw = np.frombuffer(text, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return (
        len(words),
        points - sum(text.count(bytes([b])) for b in BLANKS),
        sum(text.count(bytes([b])) for b in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(text: bytes, ids: np.ndarray, vocabulary: list[bytes]) -> list[np.ndarray]:
    """Buckets of the words, word pairs and runs of four bytes; one array for each kind."""
    found = []
    hashes = np.fromiter(map(crc32, vocabulary), np.uint64, len(vocabulary))[ids] if len(ids) else ids.astype(np.uint64)
    found.append(_mix(hashes, 1))
    found.append(_mix(hashes[:-1] * np.uint64(0x100000001B3) ^ hashes[1:], 2))
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(raw) >= 4:
        found.append(_mix(raw[:-3] | raw[1:-2] << np.uint64(8) | raw[2:-1] << np.uint64(16) | raw[3:] << np.uint64(24), 3))
    return [kind for kind in found if len(kind)]


@dataclass(frozen=True)
class Model:
    """Weights of the buckets, intercept, and the calibrating line over the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, kinds: list[np.ndarray]) -> float:
        return self.bias + sum(float(self.weights[kind].mean()) for kind in kinds)

    def probability(self, kinds: list[np.ndarray]) -> float:
        return float(_sigmoid(self.slope * self.margin(kinds) + self.offset))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], labels: np.ndarray, held: np.ndarray, steps: int = 150) -> Model:
    """Logistic regression by full-batch Adam, then Platt's line on the held-out rows.

    ``rows`` are (id, buckets, values); the result depends on their order only by rounding.
    """
    train = np.flatnonzero(~held)
    columns = np.concatenate([rows[i][1] for i in train])
    values = np.concatenate([rows[i][2] for i in train])
    sizes = np.array([len(rows[i][1]) for i in train])
    owner = np.repeat(np.arange(len(train)), sizes)
    y = labels[train]
    weights, bias = np.zeros(1 << BUCKET_BITS), 0.0
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, steps + 1):
        margin = bias + np.bincount(owner, weights[columns] * values, len(train))
        error = (_sigmoid(margin) - y) / len(train)
        gradient = np.append(np.bincount(columns, error[owner] * values, len(weights)) + 1e-7 * weights, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        change = 0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights -= change[:-1]
        bias -= change[-1]
    checked = np.flatnonzero(held)
    margin = np.array([bias + (weights[rows[i][1]] * rows[i][2]).sum() for i in checked])
    slope, offset = _platt(margin, labels[checked])
    return Model(weights.astype(np.float32), float(bias), slope, offset)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, towards Platt's smoothed targets."""
    good = float(y.sum())
    if not 0 < good < len(y):
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x = np.stack([margin, np.ones_like(margin)])
    line = np.array([0.0, np.log((good + 1) / (len(y) - good + 1))])
    loss = np.inf
    for _ in range(50):
        p = _sigmoid(line @ x)
        gradient = x @ (p - target)
        hessian = (x * np.maximum(p * (1 - p), 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-4:
            p = np.clip(_sigmoid((line - scale * step) @ x), 1e-12, 1 - 1e-12)
            now = -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()
            if now < loss:
                break
            scale /= 2
        else:
            break
        line, loss = line - scale * step, now
    return float(line[0]), float(line[1])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            ids, labels, buckets, values = [], [], [], []
            for doc, label, text in zip(block.column("doc_id").to_pylist(), block.column("label").to_pylist(), texts(block)):
                numbers, vocabulary = word_ids(text.split())
                kinds = features(text, numbers, vocabulary)
                ids.append(doc)
                labels.append(label)
                if kinds:
                    mass = np.concatenate([np.full(len(kind), 1.0 / len(kind)) for kind in kinds])
                    column, where = np.unique(np.concatenate(kinds), return_inverse=True)
                    summed = np.bincount(where, mass, len(column))
                else:
                    column, summed = np.zeros(0, np.int64), np.zeros(0)
                buckets.append(column.astype("<u4").tobytes())
                values.append(summed.astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "label": pa.array(labels, pa.int32()),
                    "buckets": pa.array(buckets, pa.binary()),
                    "vals": pa.array(values, pa.binary()),
                }
            )


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        for row in batch.to_pylist():
            rows.append((row["doc_id"], np.frombuffer(row["buckets"], "<u4"), np.frombuffer(row["vals"], "<f4")))
            labels.append(row["label"])
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rows, y = [rows[i] for i in order], np.array([labels[i] for i in order], float)
    held = np.array([crc32(str(row[0]).encode()) % CALIBRATION_FOLDS == 0 for row in rows], bool)
    if not rows or len(set(y[~held])) < 2:
        return
    model = fit(rows, y, held)
    yield pa.RecordBatch.from_pydict(
        {
            "weights": pa.array([model.weights.astype("<f4").tobytes()], pa.binary()),
            "line": pa.array([[model.bias, model.slope, model.offset]], pa.list_(pa.float64())),
        }
    )


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """The classifier, or None without labelled rows of both classes.

    At most ``max_train`` labelled documents, so the id list that is broadcast, the sample that
    one task fits and the weights that come back are bounded whatever the size of the tables.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .dropna()
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    texts_of = (
        id_and_text(documents)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )
    sparse = texts_of.mapInArrow(_sparse, "doc_id bigint, label int, buckets binary, vals binary")
    fitted = sparse.repartition(1).mapInArrow(_fit_sample, "weights binary, line array<double>").collect()
    if not fitted:
        return None
    return Model(np.frombuffer(fitted[0]["weights"], "<f4"), *fitted[0]["line"])


def score(documents: DataFrame, model: Model | None, keep_at: float = KEEP_AT, sure_at: float = SURE_AT) -> DataFrame:
    """Statistics, probability and verdict of every text; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                stats, failed, chance, band, kept = [], [], [], [], []
                for text in texts(block):
                    words = text.split()
                    numbers, vocabulary = word_ids(words)
                    row = statistics(text, words, numbers)
                    bad = base_failed(row[0], row[4])
                    p = model.probability(features(text, numbers, vocabulary)) if model else None
                    stats.append(row)
                    failed.append(bad)
                    chance.append(p)
                    band.append(None if p is None else "sure" if p >= sure_at else "keep" if p >= keep_at else "reject")
                    kept.append(not bad and (p is None or p >= keep_at))
                columns = {"doc_id": block.column("doc_id")}
                for i, name in enumerate(STATISTICS):
                    columns[name] = pa.array([row[i] for row in stats], pa.int64())
                columns |= {
                    "base_failed": pa.array(failed, pa.bool_()),
                    "p_quality": pa.array(chance, pa.float64()),
                    "band": pa.array(band, pa.string()),
                    "kept": pa.array(kept, pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return id_and_text(documents).mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep_at: float = KEEP_AT) -> DataFrame:
    """``documents`` without the rejected rows; one narrow pass, columns stay as they are."""
    model = train(documents, labels, max_train)

    def good(text: bytes) -> bool:
        words = text.split()
        numbers, vocabulary = word_ids(words)
        if base_failed(len(words), repeated_words(numbers)):
            return False
        return model is None or model.probability(features(text, numbers, vocabulary)) >= keep_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").cast(pa.binary()))):
                kept = pa.array([good(text) for text in texts(block)], pa.bool_())
                rows = block.filter(kept)
                yield rows.set_column(rows.schema.get_field_index("text"), "text", rows.column("text").cast(pa.string()))

    return documents.mapInArrow(run, documents.schema)


def quality_rules(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Train on the labelled rows among ``documents`` and judge every document."""
    return score(documents, train(documents, labels, max_train))
