"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise part is computed as
half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), in time linear in the features of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from symtrail.llm import labelled
from symtrail.llm.arrays import blocks, texts_of, words_of

#: Buckets of hashed words, factors, and the labelled documents that a fit uses at most.
WORD_BUCKETS, FACTORS, SAMPLE_DOCS = 1 << 15, 4, 5_000
HELD_OUT = (4, 2)
THRESHOLD = 0.7

_CLASSES = {name: k for k, name in enumerate(("other", "lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "symbol", "bracket", "high"))}
_CLASS_OF = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS_OF[_b] = _CLASSES[
        "high" if _b > 127 else "lower" if _c.islower() else "upper" if _c.isupper() else "digit" if _c.isdigit()
        else "newline" if _c == "\n" else "space" if _c.isspace() else "stop" if _c in ".?" else "comma" if _c in ",;:'\"-"
        else "bang" if _c == "!" else "symbol" if _c in "#$%&*|~^=_+@\\/" else "bracket" if _c in "<>{}[]()" else "other"]
N_STATS = len(_CLASSES) + 8


@dataclass
class Features:
    """Hashed words (document, bucket, value) in document order, and a row of statistics per document."""

    doc: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def features_of(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> Features:
    n_docs = len(offsets) - 1
    words = words_of(data, offsets)
    n_bytes, n_words = np.diff(offsets), np.diff(words.first)
    keys, counts = np.unique(words.doc * WORD_BUCKETS + (words.hash >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, return_counts=True)
    doc, bucket = keys // WORD_BUCKETS, keys % WORD_BUCKETS
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(doc, value ** 2, n_docs))
    value = value / norm[doc]
    classes = np.bincount(np.repeat(np.arange(n_docs), n_bytes) * len(_CLASSES) + _CLASS_OF[data], minlength=n_docs * len(_CLASSES))
    shares = classes.reshape(n_docs, -1) / np.maximum(n_bytes, 1)[:, None]
    lengths = words.end - words.start
    longest = np.zeros(n_docs)
    np.maximum.at(longest, words.doc, lengths)
    each = np.maximum(n_words, 1)
    stats = np.column_stack([
        shares, np.log1p(n_bytes), np.log1p(n_words), np.bincount(words.doc, lengths, n_docs) / each, np.log1p(longest),
        np.bincount(doc, minlength=n_docs) / each, np.bincount(doc, counts.astype(float) ** 2, n_docs) / each ** 2,
        np.log1p(np.maximum(n_chars, 0)), np.clip(n_chars / np.maximum(n_bytes, 1), 0, 2)])
    return Features(doc, bucket, value, stats)


@dataclass
class Machine:
    """Weights of word buckets followed by those of the standardised statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_forward(self, f, len(f.stats))[0], -30, 30)))


def _forward(m: Machine, f: Features, n: int):
    dense = np.clip((f.stats - m.mean) / m.scale, -4, 4)
    z = m.bias + np.bincount(f.doc, m.linear[f.bucket] * f.value, n) + dense @ m.linear[WORD_BUCKETS:]
    own = m.factors[f.bucket] * f.value[:, None]
    tail = m.factors[WORD_BUCKETS:]
    sums = np.column_stack([np.bincount(f.doc, own[:, k], n) for k in range(own.shape[1])]) + dense @ tail
    squares = np.bincount(f.doc, (own ** 2).sum(1), n) + dense ** 2 @ (tail ** 2).sum(1)
    return z + 0.5 * ((sums ** 2).sum(1) - squares), sums, dense


def fitted(f: Features, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, decay: float = 1e-5, seed: int = 1) -> Machine:
    """Weights by stochastic gradient descent (Adam) on the logistic loss."""
    rng = np.random.default_rng(seed)
    size = WORD_BUCKETS + N_STATS
    scale = f.stats.std(0)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), f.stats.mean(0), np.where(scale > 1e-9, scale, 1.0))
    weights = np.column_stack([m.linear, m.factors])
    first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
    starts = np.searchsorted(f.doc, np.arange(len(labels) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            rows = np.sort(order[k:k + batch])
            counts = starts[rows + 1] - starts[rows]
            at = np.repeat(starts[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            part = Features(np.repeat(np.arange(len(rows)), counts), f.bucket[at], f.value[at], f.stats[rows])
            m.linear, m.factors = weights[:, 0], weights[:, 1:]
            z, sums, dense = _forward(m, part, len(rows))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            slope = error[part.doc] * part.value
            gradient = decay * weights
            gradient[:WORD_BUCKETS, 0] += np.bincount(part.bucket, slope, WORD_BUCKETS)
            gradient[WORD_BUCKETS:, 0] += dense.T @ error
            for j in range(FACTORS):
                inner = sums[part.doc, j] - m.factors[part.bucket, j] * part.value
                gradient[:WORD_BUCKETS, j + 1] += np.bincount(part.bucket, slope * inner, WORD_BUCKETS)
                gradient[WORD_BUCKETS:, j + 1] += (dense * (sums[:, j:j + 1] - m.factors[WORD_BUCKETS:, j] * dense)).T @ error
            step += 1
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient ** 2 - second)
            weights -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            m.bias -= rate * error.sum() * 10
    m.linear, m.factors = weights[:, 0].copy(), weights[:, 1:].copy()
    return m


def _numbers(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(np.array(column.cast(pa.float64()).to_numpy(zero_copy_only=False), float))


def _scored(m: Machine, batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = texts_of(batch.column("text"))
    n_chars = _numbers(batch.column("n_chars"))
    parts = [m.score(features_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n_chars[a:b])) for a, b in blocks(data, offsets)]
    return np.concatenate([np.zeros(0), *parts])


def _with_chars(docs: DataFrame) -> DataFrame:
    """`docs` with the metadata column n_chars (null where the table has none)."""
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """A machine fitted to at most `sample_docs` labelled documents that are not held out.

    Features are taken in tasks; the driver gets those of the sample only.  Without a usable label every
    score is 0.5."""
    chosen = labelled.sample(labels, "quality", *HELD_OUT, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            n_chars, answers = _numbers(batch.column("n_chars")), batch.column("label")
            for a, b in blocks(data, offsets):
                f = features_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n_chars[a:b])
                at = pa.array(np.searchsorted(f.doc, np.arange(b - a + 1)).astype(np.int32))
                wide = pa.array(np.arange(0, (b - a + 1) * N_STATS, N_STATS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [answers.slice(a, b - a).cast(pa.int32()), pa.ListArray.from_arrays(at, pa.array(f.bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(at, pa.array(f.value.astype(np.float32))), pa.ListArray.from_arrays(wide, pa.array(f.stats.ravel()))],
                    ["label", "bucket", "value", "stats"])

    found = labelled.with_label(_with_chars(docs), chosen, "text", "n_chars").mapInArrow(
        run, "label int, bucket array<int>, value array<float>, stats array<double>").toArrow().combine_chunks()
    answers = found.column("label").to_numpy()
    if len(answers) == 0:
        size = WORD_BUCKETS + N_STATS
        return Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    lists = found.column("bucket").combine_chunks()
    doc = np.repeat(np.arange(len(answers)), lists.value_lengths().to_numpy())
    f = Features(doc, lists.flatten().to_numpy(), found.column("value").combine_chunks().flatten().to_numpy(),
                 found.column("stats").combine_chunks().flatten().to_numpy().reshape(len(answers), -1))
    return fitted(f, answers.astype(float))


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs` (doc_id, text and, if there, n_chars).

    Whole texts are scored; a null text counts as empty and is scored by its statistics, a null n_chars
    counts as 0, a null doc_id is not held out.  An empty table gives no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scored(shared.value, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    modulus, out = HELD_OUT
    held = (labelled.remainder(F.col("doc_id"), modulus) == out).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_chars(docs).select("doc_id", held, "text", "n_chars").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches `threshold`; they are filtered where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n_chars = batch.column("n_chars") if "n_chars" in names else pa.nulls(len(batch), pa.int64())
            view = pa.RecordBatch.from_arrays([batch.column("text"), n_chars], ["text", "n_chars"])
            yield batch.filter(pa.array(_scored(shared.value, view) >= threshold))

    return docs.mapInArrow(run, docs.schema)
