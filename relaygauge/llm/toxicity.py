"""Toxicity scores: subword-bag embeddings averaged over windows of words into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.frames import ALNUM, LOWER, MIX_A, byte_arrays, chunks, first_of_each, utf8, word_spans

BUCKETS_LOG2 = 18  # character n-grams share 2^18 vectors
SIZES = (3, 4, 5)  # bytes per n-gram, word edges included
DIMENSIONS = 8
WINDOW = 4  # words whose n-grams are averaged together
SAMPLE_ROWS = 1200  # labelled texts per class that a model is fitted on, at most
SAMPLE_TEXT_BYTES = 1 << 15  # longer texts are not learned from
EPOCHS = 60


class Bags:
    """The n-grams of joined texts by the byte they start at, and the windows of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
        # A blank ends each text, so that no n-gram or word crosses to the next.
        gaps = np.arange(len(offsets))
        self.offsets = offsets + gaps
        data = np.insert(LOWER[data], offsets[1:], np.uint8(0x20))
        data = np.concatenate([np.uint8([0x20]), data, np.full(max(SIZES), 0x20, np.uint8)])
        self.offsets[1:] += 1
        self.offsets[0] = 1
        inside = ALNUM[data]
        data = np.where(inside, data, np.uint8(0x20))
        n = len(data)
        within = np.zeros(n + 1, np.int32)
        np.cumsum(inside, out=within[1:])
        self.grams = []
        code = data[: n - 1].astype(np.uint64) << np.uint64(8) | data[1:]
        for size in range(3, max(SIZES) + 1):
            code = code[: n - size + 1] << np.uint64(8) | data[size - 1 :]
            if size in SIZES:
                inner = np.arange(n - size + 1)
                real = within[inner + size - 1] - within[inner + 1] == size - 2
                at = ((code * np.uint64(2) + np.uint64(1)) * MIX_A) >> np.uint64(64 - BUCKETS_LOG2)
                self.grams.append((at.astype(np.int32), real))
        self.count = np.zeros(n + 1, np.int32)
        self.count[1:] = sum(np.pad(real, (0, n - len(real))).astype(np.int32) for _, real in self.grams).cumsum()
        starts, ends = word_spans(data, np.array([0, n]), ALNUM)
        row = np.searchsorted(self.offsets, starts, side="right") - 1
        self.first = np.searchsorted(row, np.arange(len(offsets)))
        # A window of up to ``window`` words begins at each word.
        last = np.minimum(np.arange(len(starts)) + window, self.first[row + 1] if len(row) else 0) - 1
        self.low, self.high = starts - 1, ends[last] if len(row) else ends
        self.size = n

    def windows(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of the n-grams in each window."""
        sums = np.zeros(self.size, np.float64)
        for at, real in self.grams:
            sums[: len(at)] += np.where(real, weights[at], 0)
        total = np.zeros(self.size + 1)
        np.cumsum(sums, out=total[1:])
        return (total[self.high] - total[self.low]) / np.maximum(self.count[self.high] - self.count[self.low], 1)

    def best(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that have a word, and the largest value among the windows of each."""
        rows = np.flatnonzero(np.diff(self.first) > 0)
        return rows, np.maximum.reduceat(values, self.first[rows]) if len(rows) else np.zeros(0)


    def worst(self, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each text with a word, the n-grams of its first window of the largest mean weight."""
        values = self.windows(weights)
        for row in np.flatnonzero(np.diff(self.first) > 0):
            at = self.first[row] + int(np.argmax(values[self.first[row] : self.first[row + 1]]))
            a, b = self.low[at], self.high[at]
            yield int(row), np.concatenate([gram[a:b][real[a:b]] for gram, real in self.grams])


@dataclass
class Model:
    """What scoring needs of a fitted model: one weight per n-gram bucket, as the softmax is linear."""

    weights: np.ndarray
    bias: float

    def scores(self, bags: Bags, rows: int) -> np.ndarray:
        logits = np.full(rows, min(self.bias, 0.0))
        at, best = bags.best(bags.windows(self.weights))
        logits[at] = best + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def fit(texts: list[bytes], labels: np.ndarray, importance: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Embeddings of n-grams and the softmax over their averages, trained together by AdaGrad.

    A text's class is read from its most toxic window.  The first component of the embeddings
    starts from how much more often an n-gram stands in toxic texts, so that the first epochs
    already look at the right windows.
    """
    labels = np.asarray(labels, bool)
    if not len(texts) or labels.all() or not labels.any():
        share = float(np.average(labels, weights=importance)) if len(texts) else 0.0
        return Model(np.zeros(1 << BUCKETS_LOG2, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    # A part of the texts at a time, so that arrays over their bytes stay small.
    parts = [(i, Bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in chunks(offsets)]
    number = 1 << BUCKETS_LOG2
    present = np.zeros((2, number))
    for begin, bags in parts:
        for row in range(len(bags.offsets) - 1):
            a, b = bags.offsets[row] - 1, bags.offsets[row + 1]
            seen = np.unique(np.concatenate([at[a:b][real[a:b]] for at, real in bags.grams]))
            present[int(labels[begin + row]), seen] += 1
    counts = np.array([(~labels).sum(), labels.sum()])
    odds = np.log((present[1] + 1) / (counts[1] + 2)) - np.log((present[0] + 1) / (counts[0] + 2))
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.05, (number, DIMENSIONS))
    embedding[:, 0] += odds * (present.sum(axis=0) > 0)
    softmax = random.normal(0, 0.05, (DIMENSIONS, 2))
    softmax[0] += [-1, 1]
    bias = np.array([0.0, -3.0])
    squares = [np.full_like(embedding, 1e-2), np.full_like(softmax, 1e-2), np.full_like(bias, 1e-2)]
    weight = importance / importance.mean()
    for _ in range(epochs):
        slope = softmax[:, 1] - softmax[:, 0]
        weights = (embedding @ slope).astype(np.float32)
        picked = [(begin + row, gram) for begin, bags in parts for row, gram in bags.worst(weights)]
        rows, grams = np.array([row for row, _ in picked], int), [gram for _, gram in picked]
        if not len(rows):
            break
        sizes = np.array([max(len(g), 1) for g in grams])
        flat = np.concatenate(grams)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        mean = np.zeros((len(grams), DIMENSIONS))
        np.add.at(mean, owner, embedding[flat])
        mean /= sizes[:, None]
        logits = mean @ softmax + bias
        shares = np.exp(logits - logits.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        error = shares.copy()
        error[np.arange(len(rows)), labels[rows].astype(int)] -= 1
        error *= weight[rows][:, None]
        touched, back = np.unique(flat, return_inverse=True)
        pull = np.zeros((len(touched), DIMENSIONS))
        np.add.at(pull, back, ((error @ softmax.T) / sizes[:, None])[owner])
        for value, gradient, square, at in (
            (embedding, pull + 1e-3 * embedding[touched], squares[0], touched),
            (softmax, mean.T @ error / len(rows), squares[1], slice(None)),
            (bias, error.mean(axis=0), squares[2], slice(None)),
        ):
            square[at] += gradient**2
            value[at] -= 0.2 * gradient / np.sqrt(square[at])
    slope = softmax[:, 1] - softmax[:, 0]
    return Model((embedding @ slope).astype(np.float32), float(bias[1] - bias[0]))


def fit_on_labels(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    rows: int = SAMPLE_ROWS,
    text_bytes: int = SAMPLE_TEXT_BYTES,
) -> Model:
    """A model fitted on a bounded sample: ``rows`` labelled texts per class, of up to
    ``text_bytes`` each, in an order given by a hash of the key; classes weigh as among all labels."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    counts = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = first_of_each(marked.withColumn("_order", F.xxhash64(F.lit(11), F.col("_key"))), "_label", ["_order", "_key"], rows)
    ids = docs.sparkSession.createDataFrame(wanted.select("_key", "_label").collect(), "_key " + marked.schema["_key"].dataType.simpleString() + ", _label int")
    # Two classes of ``rows`` ids: small enough to send to every task.
    sample = docs.select(F.col(key).alias("_key"), utf8(text).alias("_text")).where(F.octet_length("_text") <= text_bytes)
    taken = sample.join(F.broadcast(ids), "_key").orderBy(F.xxhash64("_key"), "_key", "_label", "_text").collect()
    texts = [bytes(r["_text"]) for r in taken]
    marks = np.array([r["_label"] for r in taken], int)
    sampled = np.bincount(marks, minlength=2) if len(marks) else np.zeros(2)
    importance = np.array([counts.get(m, 0) / max(sampled[m], 1) for m in marks], float)
    return fit(texts, marks, importance)


def toxicity(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, score) for each row of ``docs``: 0 to 1, that of the most toxic window of words.

    A null text, or one without a word, scores as the prior does.  All of a text is read; repeated
    rows and null keys each give their row; other columns are not read.
    """
    carried = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights, whatever was learned from
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_arrays(batch.column("_text"))
            for i, j in chunks(offsets):
                bags = Bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").slice(i, j - i), pa.array(carried.value.scores(bags, j - i))], ["_key", "score"]
                )

    rows = docs.select(F.col(key).alias("_key"), utf8(text).alias("_text"))
    return rows.mapInArrow(score, f"_key {kind}, score double").withColumnRenamed("_key", key)
