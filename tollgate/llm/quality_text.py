"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax on top.

Every word, every pair of neighbouring words and every run of 3 to 5 bytes of a word (with its edges marked) has a hashed
vector. A document's vector is the mean
over all their occurrences in its whole text; a softmax over it gives the class. Vectors and weights are learned
together by stochastic gradient descent in numpy, one document at a time.

Fitting takes a bounded sample of labelled rows (``FIT_ROWS``, those with the smallest md5 of their id) in one task, and the
driver gets the learned numbers. Scoring is a pass over the table without a shuffle. As both
layers are linear up to the softmax, scoring needs one number per bucket, the difference of the two classes' products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.arrays import _SPACE, find_words, hash_spans, mix, slices, text_bytes

BITS = 16
BUCKETS = 1 << BITS
DIMENSIONS = 12
LENGTHS = (3, 4, 5)
FIT_ROWS = 4_000
EPOCHS = 12
RATE = 3.0

_LETTERS = (mix(np.arange(500, 756, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLACES = (mix(np.arange(900, 900 + max(LENGTHS), dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kinds of features of all texts: bucket of each occurrence, whether it counts, and where each text begins.

    Each text is preceded by one space, so no text is without an entry, and one follows the last.
    """
    stream = np.insert(data, offsets, 32)
    starts = offsets[:-1] + np.arange(len(offsets) - 1)
    space = _SPACE[stream]
    begin, end, text = find_words(stream, np.append(starts, len(stream)))
    words = np.zeros(len(stream), np.uint32)
    there = np.zeros(len(stream), bool)
    words[begin] = (hash_spans(stream, begin, end, fold=False) >> np.uint64(64 - BITS)).astype(np.uint32)
    there[begin] = True
    yield words, there, starts
    # Neighbouring words as the difference of their hashes: a word said twice is the same feature whatever the word.
    marks = hash_spans(stream, begin, end)
    pairs = np.zeros(len(stream), np.uint32)
    there = np.zeros(len(stream), bool)
    pairs[begin[1:]] = (mix(marks[1:] ^ marks[:-1]) >> np.uint64(64 - BITS)).astype(np.uint32)
    there[begin[1:]] = text[1:] == text[:-1]
    yield pairs, there, starts
    letters = np.where(space, np.uint32(2654435761), _LETTERS[stream])
    closed = np.cumsum(space, dtype=np.int32)
    edge = np.zeros(len(stream), bool)
    edge[starts] = True
    opened = np.cumsum(edge, dtype=np.int32)
    for n in LENGTHS:
        m = len(stream) - n + 1
        grams = np.zeros(len(stream), np.uint32)
        there = np.zeros(len(stream), bool)
        if m > 0:
            sums = np.zeros(m, np.uint32)
            for k in range(n):
                sums += letters[k:k + m] * _PLACES[k]
            sums ^= sums >> np.uint32(15)
            sums *= np.uint32(0x85EBCA6B | 1) + np.uint32(2 * n)
            grams[:m] = sums >> np.uint32(32 - BITS)
            # No space inside; all of one text (the space before the next text is an end, too).
            there[:m] = (closed[n - 2:n - 2 + m] == closed[:m]) & ((opened[n - 1:n - 1 + m] == opened[:m]) | edge[n - 1:n - 1 + m])
        yield grams, there, starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, and the buckets and counts of each text's features."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for row in range(batch.num_rows):
            seen = np.zeros(BUCKETS, np.int64)
            for i, (buckets, there, _) in enumerate(_features(data[offsets[row]:offsets[row + 1]], offsets[row:row + 2] - offsets[row])):
                seen += np.bincount(buckets[there], minlength=BUCKETS)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(row, 1), pa.array([at.astype(np.uint16).tobytes()]),
                pa.array([seen[at].astype(np.float32).tobytes()])], names=["label", "buckets", "counts"])


@dataclass(frozen=True)
class QualityModel:
    """The learned vectors and weights (None without labels of both kinds) and what scoring needs of them."""
    vectors: np.ndarray | None
    weights: np.ndarray | None
    bias: np.ndarray
    products: np.ndarray  # per bucket: class 1 less class 0


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent. Rows of one class alone, or none, give the share of the class as every score."""
    ones = sum(label for label, _, _ in rows)
    share = (ones + 0.5) / (len(rows) + 1)
    bias = np.array([np.log(1 - share), np.log(share)])
    if not rows or ones in (0, len(rows)):
        return QualityModel(None, None, bias, np.zeros(BUCKETS, np.float32))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = random.normal(0, 1, (2, DIMENSIONS)).astype(np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            label, at, counts = rows[k]
            pace = np.float32(rate * (1 - step / steps))
            step += 1
            if not len(at):
                continue
            shares = counts / counts.sum()
            hidden = shares @ vectors[at]
            logits = weights @ hidden + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            wrong = wrong.astype(np.float32)
            back = wrong @ weights
            weights -= pace * 0.1 * np.outer(wrong, hidden)
            bias -= pace * 0.01 * wrong
            vectors[at] -= np.outer(shares * (pace * np.float32(len(at)) ** 0.5), back)
    return QualityModel(vectors, weights, bias, vectors @ (weights[1] - weights[0]))


def sample_labels(labels: DataFrame, id_col: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` rows of a label table, those that ``fit`` would take: join texts to these and not to all labels."""
    return labels.orderBy(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), *labels.columns).limit(rows)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and training in one task: the sample is bounded, and the driver gets the model alone."""
    rows = [(x.column(0)[0].as_py(), np.frombuffer(x.column(1)[0].as_py(), np.uint16), np.frombuffer(x.column(2)[0].as_py(), np.float32))
            for x in _count(batches)]
    model = train(rows)
    parts = [model.vectors, model.weights, np.asarray(model.bias, np.float64), model.products.astype(np.float32)]
    yield pa.RecordBatch.from_arrays([pa.array([None if x is None else x.tobytes()], pa.binary()) for x in parts],
                                     names=["vectors", "weights", "bias", "products"])


def fit(labelled: DataFrame, label_col: str = "label", id_col: str = "doc_id", text_col: str = "text",
        rows: int = FIT_ROWS) -> QualityModel:
    """Learn from at most ``rows`` labelled texts, those with the smallest md5 of their id. Null labels are left out."""
    sample = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("by"))
    sample = sample.orderBy("by", "label", "text").limit(rows).select("label", "text")
    learned = sample.coalesce(1).mapInArrow(_learn, "vectors binary, weights binary, bias binary, products binary").first()
    if learned is None:  # no partition, no task
        return train([])
    vectors, weights, bias, products = (None if x is None else bytes(x) for x in learned)
    return QualityModel(
        None if vectors is None else np.frombuffer(vectors, np.float32).reshape(BUCKETS, DIMENSIONS),
        None if weights is None else np.frombuffer(weights, np.float32).reshape(2, DIMENSIONS),
        np.frombuffer(bias, np.float64), np.frombuffer(products, np.float32))


def score_slice(data: np.ndarray, offsets: np.ndarray, products: np.ndarray, bias: float) -> np.ndarray:
    total, number = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for buckets, there, starts in _features(data, offsets):
        total += np.add.reduceat(np.where(there, products[buckets], np.float32(0)), starts, dtype=np.float64)
        number += np.add.reduceat(there, starts, dtype=np.float64)
    return 1 / (1 + np.exp(-(total / np.maximum(number, 1) + bias)))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``quality`` (0 to 1, higher: label 1 likelier). Null and empty texts get the bias alone.
    Repeated ids and texts are rows like any other, equal texts score alike, and an empty table stays empty."""
    products, bias = model.products.astype(np.float32), float(model.bias[1] - model.bias[0])
    shared = docs.sparkSession.sparkContext.broadcast(products)  # BUCKETS numbers, whatever the data
    kept = text_col in keep  # a text that is kept is not sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(keep.index(text_col) if kept else len(keep)))
            for i, j in slices(offsets):
                got = score_slice(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shared.value, bias)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(got)], names=[*keep, "quality"])

    inner = docs.select(*[F.col(c) for c in keep], *[] if kept else [F.col(text_col).alias("\x00text")])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:len(keep)])
    return inner.mapInArrow(run, f"{types}, quality double")
