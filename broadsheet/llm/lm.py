"""Log-bilinear language model trained with noise-contrastive estimation.

Words are counted over all training texts. The most frequent ones and classes of the rest, by the
hash of their last three bytes, are the model's symbols; a symbol's score after two others is
bilinear in their vectors. Every task trains on all its texts from the same start, in numpy, with
noise shared by a mini-batch; the parameters are averaged by training tokens. Scores are
normalised over all symbols by matrix products, each context once a task; a word of a class gets
its share of the class by its count. So the probabilities of all known words and one unseen word
of each class sum to one after any context.

Counts of frequent words travel as a broadcast of at most ``HEAD`` words; rarer words of a text are
joined with the count table and summed back by row.

Defined cases: null text is empty and is its end token alone; a null ``doc_id`` hashes as the empty
text; without training rows every count is 0 and the model is uniform; repeated rows each give a
row; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.batches import blocks, id_and_text, texts, written

FOLDS, HELD_FOLD = 7, 2
#: Words broadcast with their counts, at most.
HEAD = 131_072
#: Steps a factor e of the count is cut into to find where the head ends.
STEPS = 64
WORDS, CLASSES, DIMENSIONS = 1024, 64, 24
BATCH, NOISE, RATE, SEED = 2048, 64, 0.2, 5
#: A task with fewer mini-batches goes over its texts again, up to this many steps.
LEAST_STEPS = 600
#: No word contains a blank, so this stands for the end of a text.
END = b"\n"


def held_out(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_FOLD


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_class(word: bytes) -> int:
    return crc32(word[-3:]) % CLASSES


def word_counts(documents: DataFrame) -> DataFrame:
    """``word`` and ``c`` over all training texts; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found: Counter[bytes] = Counter()
                for doc, text in zip(block.column("doc_id").to_pylist(), texts(block)):
                    if not held_out(doc):
                        found.update(tokens(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"]
                )

    return id_and_text(documents).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """Totals, frequent words with counts and symbols, and size of every class."""

    total: int
    distinct: int
    index: dict[bytes, int]
    counts: np.ndarray
    symbols: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def n_symbols(self) -> int:
        return WORDS + CLASSES

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Head index (-1 for rarer words) and symbol of every token."""
        get = self.index.get
        head = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        symbol = self.symbols[head] if len(self.symbols) else np.full(len(words), -1, np.int64)
        for i in np.flatnonzero(head < 0).tolist():
            symbol[i] = WORDS + word_class(words[i])
        return head, symbol

    def unigram(self) -> np.ndarray:
        """Smoothed share of every symbol among the training tokens."""
        share = np.full(self.n_symbols, 0.5)
        model = self.symbols < WORDS
        share[self.symbols[model]] += self.counts[model]
        share[WORDS:] += self.class_tokens
        return share / share.sum()


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The bounded part of the count table and its totals.

    The head ends where a step of the logarithm of the count would make it larger than ``head``,
    so no order over all words is needed.
    """
    step = F.floor(F.ln("c") * STEPS).cast("int")
    total, distinct, steps = 0, 0, []
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("t")).collect():
        steps.append((row["step"], row["n"]))
        total, distinct = total + row["t"], distinct + row["n"]
    least, taken = None, 0
    for value, n in sorted(steps, reverse=True):
        if taken + n > head:
            break
        least, taken = value, taken + n
    rows = counts.where(step >= least).collect() if least is not None else []
    top = sorted(((-row["c"], bytes(row["word"])) for row in rows))
    # The end of a text has a symbol of its own, whatever its rank.
    chosen = [w for _, w in top if w != END][: WORDS - 1]
    symbol_of = {w: i + 1 for i, w in enumerate(chosen)} | {END: 0}
    words = [w for _, w in top]
    symbols = np.array([symbol_of.get(w, WORDS + word_class(w)) for w in words] + [0], np.int64)
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    number = F.crc32(F.substring("word", -3, 3)) % CLASSES
    for row in counts.groupBy(number.alias("k")).agg(F.sum("c").alias("t"), F.count("*").alias("n")).collect():
        class_tokens[row["k"]], class_words[row["k"]] = row["t"], row["n"]
    for c, w in top:
        if w in symbol_of:
            class_tokens[word_class(w)] += c
            class_words[word_class(w)] -= 1
    values = np.array([-c for c, _ in top] + [0], float)
    return Vocabulary(total, distinct, {w: i for i, w in enumerate(words)}, values, symbols, class_tokens, class_words)


@dataclass
class Model:
    """Context vectors for one and two tokens back, output vectors and biases."""

    one: np.ndarray
    two: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        n = len(unigram)
        # The last context row stands before the beginning of a text.
        tables = [rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32) for size in (n + 1, n + 1, n)]
        return cls(*tables, np.log(unigram).astype(np.float32))

    def log_norm(self, contexts: np.ndarray, width: int = 2048) -> np.ndarray:
        """Natural log of the normaliser of contexts (pairs of symbols)."""
        norm = np.empty(len(contexts), np.float32)
        for a in range(0, len(contexts), width):
            part = contexts[a : a + width]
            scores = (self.one[part[:, 0]] + self.two[part[:, 1]]) @ self.out.T + self.bias
            high = scores.max(axis=1)
            norm[a : a + width] = high + np.log(np.exp(scores - high[:, None]).sum(axis=1))
        return norm

    def scores(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        hidden = self.one[one] + self.two[two]
        return np.einsum("ij,ij->i", hidden, self.out[symbol]) + self.bias[symbol]


def contexts_of(symbols: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols one and two tokens back; ``start`` before the beginning. ``ends``: tokens up to each text's end."""
    one = np.append(start, symbols[:-1])
    two = np.concatenate([[start, start], symbols[:-2]])[: len(symbols)]
    begin = np.append(0, ends[:-1])
    one[begin] = start
    two[begin] = start
    second = begin + 1
    second = second[second < ends]
    two[second] = start
    return one, two


def _add(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One adaptive step for the rows of a table; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    rows, gradient = rows[order], gradient[order]
    edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    summed, at = np.add.reduceat(gradient, edge), rows[edge]
    squares[at] += summed**2
    table[at] += RATE * summed / np.sqrt(squares[at] + 1e-6)


def train_on(model: Model, noise: np.ndarray, one: np.ndarray, two: np.ndarray, symbol: np.ndarray, squares: list[np.ndarray], rng) -> None:
    """Noise-contrastive steps over the tokens, in place."""
    log_noise = np.log(NOISE * noise).astype(np.float32)
    line = np.cumsum(noise)
    for a in range(0, len(symbol), BATCH):
        c1, c2, w = one[a : a + BATCH], two[a : a + BATCH], symbol[a : a + BATCH]
        drawn = np.minimum(np.searchsorted(line, rng.random(NOISE)), len(noise) - 1)
        hidden = model.one[c1] + model.two[c2]
        target = np.einsum("ij,ij->i", hidden, model.out[w]) + model.bias[w] - log_noise[w]
        pulled = (1 / (1 + np.exp(np.clip(target, -30, 30)))).astype(np.float32)
        other = hidden @ model.out[drawn].T + model.bias[drawn] - log_noise[drawn]
        pushed = -(1 / (1 + np.exp(-np.clip(other, -30, 30)))).astype(np.float32)
        to_hidden = pulled[:, None] * model.out[w] + pushed @ model.out[drawn]
        rows = np.concatenate([w, drawn])
        to_out = np.concatenate([pulled[:, None] * hidden, pushed.T @ hidden])
        to_bias = np.concatenate([pulled, pushed.sum(axis=0)])[:, None]
        scale = np.float32(1 / len(w))
        _add(model.one, squares[0], c1, to_hidden * scale)
        _add(model.two, squares[1], c2, to_hidden * scale)
        _add(model.out, squares[2], rows, to_out * scale)
        _add(model.bias[:, None], squares[3], rows, to_bias * scale)


def train(documents: DataFrame, words: Vocabulary) -> Model:
    """Average of the models that the tasks train, each on all its training texts."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(words)
    unigram = words.unigram()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value, Model.start(unigram)
        squares = [np.zeros_like(t) for t in (model.one, model.two, model.out, model.bias[:, None])]
        rng, seen = np.random.default_rng(SEED), 0
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for block in blocks(batch):
                lists = [tokens(t) for d, t in zip(block.column("doc_id").to_pylist(), texts(block)) if not held_out(d)]
                if not lists:
                    continue
                _, symbol = known.read([w for one in lists for w in one])
                one, two = contexts_of(symbol, np.cumsum([len(one) for one in lists]), known.n_symbols)
                order = rng.permutation(len(symbol))
                train_on(model, unigram, one[order], two[order], symbol[order], squares, rng)
                seen += len(symbol)
                if seen <= LEAST_STEPS * BATCH:
                    held.append((one, two, symbol))
        if seen:
            again = [np.concatenate(arrays) for arrays in zip(*held)]
            for _ in range((LEAST_STEPS - seen // BATCH) // -(-seen // BATCH)):
                order = rng.permutation(seen)
                train_on(model, unigram, *(a[order] for a in again), squares, rng)
            n = known.n_symbols
            values = np.zeros((n + 1, 3 * DIMENSIONS + 1))
            values[:, :DIMENSIONS], values[:, DIMENSIONS : 2 * DIMENSIONS] = model.one, model.two
            values[:n, 2 * DIMENSIONS : -1], values[:n, -1] = model.out, model.bias
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n + 1)), pa.array(list(values), pa.list_(pa.float64())), pa.array(np.full(n + 1, float(seen)))],
                ["symbol", "vals", "weight"],
            )

    parts = id_and_text(documents).mapInArrow(run, "symbol bigint, vals array<double>, weight double")
    # Sums of single numbers combine before the shuffle: no group of whole models is gathered.
    mean = (
        parts.select("symbol", "weight", F.posexplode("vals").alias("pos", "v"))
        .groupBy("symbol", "pos")
        .agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
        .collect()
    )
    start = Model.start(unigram)
    if not mean:
        return Model(np.zeros_like(start.one), np.zeros_like(start.two), np.zeros_like(start.out), start.bias)
    n, d = words.n_symbols, DIMENSIONS
    values = np.zeros((n + 1, 3 * d + 1), np.float32)
    for row in mean:
        values[row["symbol"], row["pos"]] = row["v"]
    return Model(values[:, :d].copy(), values[:, d : 2 * d].copy(), values[:n, 2 * d : -1].copy(), values[:n, -1].copy())


def score_rows(documents: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """Per row: token counts, sums over frequent words, model sum, and the rarer words."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, neural = shared.value
        n = known.n_symbols
        log_counts = np.log10(known.counts + 1)
        class_norm = np.log10(known.class_tokens + known.class_words + 1)
        # Normalisers by context, worked out when first met.
        norms = np.full((n + 1) * (n + 1), np.nan, np.float32)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in blocks(batch):
                lists = [tokens(t) for t in texts(block)]
                flat = [w for one in lists for w in one]
                head, symbol = known.read(flat)
                sizes = np.array([len(one) for one in lists])
                ends = np.cumsum(sizes)
                one, two = contexts_of(symbol, ends, n)
                code = one * (n + 1) + two
                new = np.unique(code[np.isnan(norms[code])])
                norms[new] = neural.log_norm(np.stack([new // (n + 1), new % (n + 1)], axis=1))
                logs = ((neural.scores(one, two, symbol) - norms[code]) / np.log(10)).astype(np.float64)
                inside = np.where(head >= 0, log_counts[head], 0.0)
                of_class = symbol >= WORDS
                logs[of_class] += inside[of_class] - class_norm[symbol[of_class] - WORDS]
                begin = ends - sizes
                rare = []
                for a, b in zip(begin.tolist(), ends.tolist()):
                    missing = np.flatnonzero(head[a:b] < 0).tolist()
                    rare.append(list(Counter(flat[a + i] for i in missing).items()) if missing else [])
                sums = [np.add.reduceat(v, begin) for v in ((head >= 0).astype(np.int64), inside, logs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(lists))),
                        block.column("doc_id"),
                        pa.array([held_out(d) for d in block.column("doc_id").to_pylist()], pa.bool_()),
                        pa.array(sizes),
                        *map(pa.array, sums),
                        pa.array([[w for w, _ in r] for r in rare], pa.list_(pa.binary())),
                        pa.array([[c for _, c in r] for r in rare], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare", "times"],
                )
                row += len(lists)

    return id_and_text(documents).mapInArrow(
        run,
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, model double, "
        "rare array<binary>, times array<bigint>",
    )


def score(documents: DataFrame, head: int = HEAD) -> DataFrame:
    """Train on the training folds and score every text."""
    counts = written(word_counts(documents))
    words = vocabulary(counts, head)
    scored = written(score_rows(documents, words, train(documents, words)))
    rarer = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")
    )
    added = (
        rarer.join(counts, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(words.total + words.distinct + 1)))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
