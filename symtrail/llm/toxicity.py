"""Toxicity: a linear-chain conditional random field tags toxic words; marginals become document scores.

Labels state documents, not words, so the words of the training sample are labelled first: in a toxic
document, those whose presence among the sampled documents speaks for toxicity.  The chain (states clean
and toxic) is trained on such word labels by forward-backward gradients.  The messages of a two-state
chain are one number per word, the odds of its states, and many segments move forward at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from symtrail.llm import labelled
from symtrail.llm.arrays import PUNCTUATION, blocks, texts_of, words_of

#: Hash buckets of each kind of feature, and the labelled documents that a fit uses at most.
BUCKETS, SAMPLE_DOCS = 1 << 17, 6_000
HELD_OUT = (4, 2)
THRESHOLD = 0.3

#: A word's features: itself, and its first bytes of these lengths (stems with varied endings).
PREFIXES = (4, 5, 6)

#: Words of a segment, and the words on either side that its messages start from.
SEGMENT, HALO = 256, 16

#: A feature marks toxic words when it has so many different surroundings in sampled toxic documents, and they
#: are so large a share of all its surroundings.  (Copies of one document repeat their surroundings.)
LEAST_PLACES, LEAST_SHARE = 6, 0.8


@dataclass
class Chain:
    """Scores of the toxic state by feature [kind, bucket]; transition scores; document calibration."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    calibration: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """The score of the toxic state at each word, from its features [kind, word]."""
        out = np.full(features.shape[1], self.bias)
        for table, own in zip(self.weights, features):
            out += table[own]
        return out


def features_of(data: np.ndarray, offsets: np.ndarray):
    """The words, and the bucket of each feature [kind, word]."""
    words = words_of(data, offsets, PUNCTUATION, PREFIXES)
    return words, np.stack([(h >> np.uint64(36)).astype(np.int32) % BUCKETS for h in (words.hash, *words.prefixes)])


def _messages(odds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the toxic state from the words up to each place, and from those after it.

    `odds` has a row per place and a column per segment; before its first row a segment is clean."""
    m = np.exp(moves)
    forward, backward = np.empty_like(odds), np.empty_like(odds)
    r = np.zeros(odds.shape[1])
    for t in range(len(odds)):
        r = odds[t] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
        forward[t] = r
    b = np.ones(odds.shape[1])
    for t in range(len(odds) - 1, -1, -1):
        backward[t] = b
        x = odds[t] * b
        b = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
    return forward, backward


def marginals(chain: Chain, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each word.

    Documents are cut into segments of SEGMENT words; each also sees HALO words on either side, over which
    the messages of a two-state chain forget where they began."""
    n = features.shape[1]
    if n == 0:
        return np.zeros(0)
    odds = np.exp(np.clip(chain.emissions(features), -30, 30))
    counts = np.diff(first)
    per_doc = -(-counts // SEGMENT)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    begin = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * SEGMENT
    out = np.empty(n)
    for part in np.array_split(np.arange(len(doc)), max(1, len(doc) // 4096)):
        at = begin[part][None, :] + np.arange(-HALO, SEGMENT + HALO)[:, None]
        inside = (at >= first[doc[part]]) & (at < first[doc[part] + 1])
        rows = min(len(at), int(inside.any(1).nonzero()[0].max(initial=0)) + 1)
        at, inside = at[:rows], inside[:rows]
        forward, backward = _messages(np.where(inside, odds[np.clip(at, 0, len(odds) - 1)], 0.0), chain.moves)
        joint = forward * backward
        core = inside & (np.arange(rows) >= HALO)[:, None] & (np.arange(rows) < HALO + SEGMENT)[:, None]
        out[at[core]] = (joint / (1 + joint))[core]
    return out


def _evidence(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """What a document's score is made of: its surest word (log odds), and how many words are toxic."""
    most = np.full(n, 1e-6)
    np.maximum.at(most, doc, np.clip(p, 1e-6, 1 - 1e-6))
    sure = np.bincount(doc, np.where(p >= 0.5, p, 0.0), n)
    return np.column_stack([np.ones(n), np.log(most / (1 - most)), np.log1p(sure)])


def _probability(calibration: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(evidence @ calibration, -30, 30)))


def _places(own: np.ndarray, around: np.ndarray) -> np.ndarray:
    """In how many different surroundings each bucket occurs."""
    order = np.lexsort((around, own))
    own, around = own[order], around[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (around[1:] != around[:-1])
    return np.bincount(own[new], minlength=BUCKETS)


def word_labels(doc: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each word of the sample counts as toxic: it is in a toxic document, and a feature marks it."""
    around = np.zeros(len(doc), np.int64)
    around[1:] = features[0, :-1].astype(np.int64) + 1
    around[:-1] = around[:-1] * BUCKETS + features[0, 1:]
    bad = toxic[doc].astype(bool)
    marked = np.zeros(len(doc), bool)
    for own in features:
        hits, others = (_places(own[bad == side], around[bad == side]) for side in (True, False))
        marked |= ((hits >= LEAST_PLACES) & (hits / (hits + others + 1) >= LEAST_SHARE))[own]
    return marked & bad


def fitted(features: np.ndarray, first: np.ndarray, toxic: np.ndarray, epochs: int = 6, width: int = 48, batch: int = 512, rate: float = 0.1, seed: int = 1) -> Chain:
    """A chain fitted to whole sampled documents: `first` has the place of each one's first word."""
    rng = np.random.default_rng(seed)
    chain = Chain(np.zeros((len(PREFIXES) + 1, BUCKETS)), -3.0, np.array([[0.0, -1.0], [0.0, 0.0]]), np.array([-2.0, 0.5, 0.5]))
    n, total = len(toxic), features.shape[1]
    doc = np.repeat(np.arange(n), np.diff(first))
    if n == 0 or total == 0:
        return chain
    marked = word_labels(doc, features, toxic)
    per_doc = -(-np.diff(first) // width)
    begin = np.repeat(first[:-1], per_doc) + (np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)) * width
    until = np.minimum(begin + width, np.repeat(first[1:], per_doc))
    counts = np.concatenate(([0], np.cumsum(marked)))
    holds = counts[until] > counts[begin]
    rest = np.flatnonzero(~holds)
    used = np.concatenate([np.flatnonzero(holds), rng.permutation(rest)[:max(2000, 2 * holds.sum())]])
    speed = np.zeros_like(chain.weights)
    for _ in range(epochs):
        order = rng.permutation(used)
        for k in range(0, len(order), batch):
            part = order[k:k + batch]
            at = begin[part][None, :] + np.arange(width)[:, None]
            inside = at < until[part]
            at = np.minimum(at, total - 1)
            scores = chain.emissions(features[:, at.ravel()]).reshape(at.shape)
            odds = np.where(inside, np.exp(np.clip(scores, -30, 30)), 0.0)
            forward, backward = _messages(odds, chain.moves)
            p = forward * backward / (1 + forward * backward)
            y = np.where(inside, marked[at], False)
            here, wrong = at[inside], (p - y)[inside]
            for table, speeds, own in zip(chain.weights, speed, features):
                gradient = np.bincount(own[here], wrong, BUCKETS)
                touched = np.flatnonzero(gradient)
                speeds[touched] += gradient[touched] ** 2
                table[touched] -= rate * gradient[touched] / np.sqrt(speeds[touched] + 1e-8)
            chain.bias -= 0.5 * wrong.mean()
            _move_gradient(chain, odds, forward, backward, y, inside)
    p = marginals(chain, features, first)
    chain.calibration = _calibrated(_evidence(p, doc, n), toxic.astype(float))
    return chain


def _move_gradient(chain: Chain, odds: np.ndarray, forward: np.ndarray, backward: np.ndarray, y: np.ndarray, inside: np.ndarray) -> None:
    """One step on the transition scores: expected minus counted moves between neighbouring words."""
    m = np.exp(chain.moves)
    both = inside[1:] & inside[:-1]
    right = odds[1:] * backward[1:]
    joint = np.stack([np.ones_like(right) * m[0, 0], right * m[0, 1], forward[:-1] * m[1, 0], forward[:-1] * right * m[1, 1]])
    joint /= joint.sum(0)
    seen = y[:-1] * 2 + y[1:]
    for k in range(1, 4):
        gap = (joint[k] - (seen == k))[both].mean()
        chain.moves[k // 2, k % 2] -= 0.5 * gap


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _probability(w, x)
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w[1:] = np.maximum(w[1:], 0)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Chain:
    """A chain fitted to at most `sample_docs` labelled documents that are not held out (whole texts, as
    hashed words).  Without a usable label nothing is toxic."""
    chosen = labelled.sample(labels, "toxic", *HELD_OUT, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in blocks(data, offsets):
                words, features = features_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                kinds = len(features)
                lists = pa.ListArray.from_arrays(pa.array((words.first * kinds).astype(np.int32)), pa.array(features.T.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a).cast(pa.int32()), lists], ["label", "features"])

    found = labelled.with_label(docs, chosen, "text").mapInArrow(run, "label int, features array<int>").toArrow().combine_chunks()
    toxic = found.column("label").to_numpy()
    lists = found.column("features").combine_chunks()
    kinds = len(PREFIXES) + 1
    if len(toxic) == 0:
        return fitted(np.zeros((kinds, 0), np.int32), np.zeros(1, np.int64), toxic)
    first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy() // kinds)))
    return fitted(np.ascontiguousarray(lists.flatten().to_numpy().reshape(-1, kinds).T), first, toxic)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), one row per row of `docs` (doc_id, text).

    `spans` lists the offending byte offsets (start, end; UTF-8) in order: runs of words whose toxic
    marginal is at least one half.  Whole texts are scored; a null or wordless text has no spans and the
    least score.  A null doc_id is not held out.  An empty table gives no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in blocks(data, offsets):
                start_at = offsets[a:b + 1] - offsets[a]
                words, features = features_of(data[offsets[a]:offsets[b]], start_at)
                p = marginals(own, features, words.first)
                scores = _probability(own.calibration, _evidence(p, words.doc, b - a))
                hit = np.flatnonzero(p >= 0.5)
                opens = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(words.doc[hit]) > 0)))[:len(hit)]
                closes = np.concatenate((opens[1:], [True]))[:len(hit)]
                where = words.doc[hit[opens]]
                spans = pa.StructArray.from_arrays(
                    [pa.array(words.start[hit[opens]] - start_at[where]), pa.array(words.end[hit[closes]] - start_at[where])], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(b - a + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(scores),
                     pa.array((scores >= threshold).astype(np.int32)), lists],
                    ["doc_id", "held_out", "score", "predicted", "spans"])

    modulus, out = HELD_OUT
    held = (labelled.remainder(F.col("doc_id"), modulus) == out).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held, "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long>>")
