"""Language ID: a small bidirectional gated recurrent network over bytes.

Every byte position is labelled from a forward and a backward state; a document's probabilities are the
means over its positions.  The unit has an update gate z and a candidate c,

    h' = z h + (1 - z) c,   z = (1 + g(a_z)) / 2,   c = g(a_c),   a = E[byte] + U h,   g(x) = x / (1 + |x|),

so a step is one small matrix product and a division over thousands of windows at once.  It is trained
in numpy by backpropagation through time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from symtrail.llm import labelled
from symtrail.llm.arrays import blocks, mixed, texts_of

#: State size of each direction, bytes of a window, windows that a step moves at once.
STATE, WINDOW, WIDTH = 8, 128, 1024

#: Documents of each language, and windows of each document, that a fit uses at most.
SAMPLE_DOCS, SAMPLE_WINDOWS, TRAIN_WINDOW = 1_000, 3, 64
HELD_OUT = (3, 1)

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """`embed` [direction, gate and candidate, byte], `turn` [direction, gate and candidate, state],
    `out` [language, both states], `bias` [language]."""

    languages: list[str]
    embed: np.ndarray
    turn: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def fresh(languages: list[str], state: int = STATE, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    return Network(languages, rng.normal(0, 0.3, (2, 2 * state, 256)), rng.normal(0, 0.3, (2, 2 * state, state)),
                   rng.normal(0, 0.3, (len(languages), 2 * state)), np.zeros(len(languages)))


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    return x / x.sum(axis, keepdims=True)


def gradients(net: Network, windows: np.ndarray, answers: np.ndarray, lengths: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the first `lengths` positions of `windows` (window, byte), and its gradients through time.

    A padded place has no loss and, read backwards, leaves the state at its start."""
    n, steps = windows.shape
    h = net.turn.shape[2]
    held = np.ones((steps, n)) if lengths is None else (np.arange(steps)[:, None] < lengths).astype(float)
    states = np.zeros((2, steps + 1, h, n))
    shape, gates, candidates = np.zeros((2, steps, 2 * h, n)), np.zeros((2, steps, h, n)), np.zeros((2, steps, h, n))
    order = [range(steps), range(steps - 1, -1, -1)]
    for d in range(2):
        for k, t in enumerate(order[d]):
            a = net.embed[d][:, windows[:, t]] + net.turn[d] @ states[d, k]
            scale = 1 / (1 + np.abs(a))
            shape[d, k] = scale ** 2
            g = a * scale
            gates[d, k], candidates[d, k] = 0.5 + 0.5 * g[:h], g[h:]
            states[d, k + 1] = gates[d, k] * states[d, k] + (1 - gates[d, k]) * candidates[d, k]
            if d == 1:
                states[d, k + 1] *= held[t]
    both = np.concatenate([states[0, 1:], states[1, :0:-1]], 1)                   # step, state, window
    p = _softmax(net.out @ both + net.bias[:, None], 1)
    target = np.zeros_like(p)
    target[:, answers, np.arange(n)] = 1
    loss = -(np.log(np.maximum((p * target).sum(1), 1e-12)) * held).sum() / held.sum()
    error = (p - target) * held[:, None] / held.sum()
    d_out = np.einsum("tln,tsn->ls", error, both)
    d_states = np.einsum("ls,tln->tsn", net.out, error)
    d_embed, d_turn = np.zeros_like(net.embed), np.zeros_like(net.turn)
    for d in range(2):
        flow = np.zeros((h, n))
        for k in range(steps - 1, -1, -1):
            t = order[d][k]
            flow = flow + d_states[t, d * h:(d + 1) * h]
            if d == 1:
                flow = flow * held[t]
            z, c, before = gates[d, k], candidates[d, k], states[d, k]
            d_a = np.concatenate([0.5 * flow * (before - c), flow * (1 - z)]) * shape[d, k]
            d_turn[d] += d_a @ before.T
            for row in range(2 * h):
                d_embed[d, row] += np.bincount(windows[:, t], d_a[row], 256)
            flow = flow * z + net.turn[d].T @ d_a
    return loss, [d_embed, d_turn, d_out, error.sum((0, 2))]


def fitted(languages: list[str], windows: np.ndarray, lengths: np.ndarray, answers: np.ndarray, rounds: int = 350, batch: int = 192, rate: float = 0.02, seed: int = 3) -> Network:
    """A network fitted (Adam) to windows of bytes (the first `lengths` of each count) with the index of their language."""
    net = fresh(languages, seed=seed)
    if len(windows) == 0:
        return net
    rng = np.random.default_rng(seed)
    tables = [net.embed, net.turn, net.out, net.bias]
    first, second = [np.zeros_like(x) for x in tables], [np.zeros_like(x) for x in tables]
    for step in range(1, rounds + 1):
        rows = rng.integers(0, len(windows), batch)
        _, slopes = gradients(net, windows[rows], answers[rows], lengths[rows])
        norm = np.sqrt(sum((s ** 2).sum() for s in slopes))
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for x, s, m, v in zip(tables, slopes, first, second):
            s = s / max(1.0, norm)
            m += 0.1 * (s - m)
            v += 0.01 * (s ** 2 - v)
            x -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def position_sums(net: Network, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the label probabilities over the first `lengths` positions of each window (window, language).

    Both directions move together: step k reads byte k forwards and byte -k backwards."""
    steps, n = windows.shape[1], len(windows)
    h, languages = net.turn.shape[2], len(net.languages)
    embed = [np.ascontiguousarray(net.embed[d].T.astype(np.float32)) for d in range(2)]
    turn = [np.ascontiguousarray(net.turn[d].T.astype(np.float32)) for d in range(2)]
    out = [np.ascontiguousarray(net.out[:, d * h:(d + 1) * h].T.astype(np.float32)) for d in range(2)]
    bias = net.bias.astype(np.float32)
    by_step = np.ascontiguousarray(windows.T)
    sums = np.zeros((n, languages))
    logits = np.empty((steps, min(n, WIDTH), languages), np.float32)
    for a in range(0, n, WIDTH):
        b = min(n, a + WIDTH)
        m = b - a
        room = lengths[a:b]
        logits[:, :m] = bias
        for d in range(2):
            state = np.zeros((m, h), np.float32)
            pre, size, gate, product = (np.empty((m, 2 * h), np.float32), np.empty((m, 2 * h), np.float32), np.empty((m, h), np.float32), np.empty((m, 2 * h), np.float32))
            label = np.empty((m, languages), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(embed[d], by_step[t, a:b], axis=0, out=pre, mode="clip")
                np.matmul(state, turn[d], out=product)
                pre += product
                np.abs(pre, out=size)
                size += 1
                pre /= size
                # z h + (1 - z) c with z = (1 + g) / 2
                np.subtract(state, pre[:, h:], out=gate)
                state += pre[:, h:]
                gate *= pre[:, :h]
                state += gate
                state *= 0.5
                if d == 1:
                    state *= (t < room)[:, None]        # a padded place leaves the state at its start
                np.matmul(state, out[d], out=label)
                logits[t, :m] += label
        part = logits[:, :m]
        np.exp(part - part.max(2, keepdims=True), out=part)
        part /= part.sum(2, keepdims=True)
        part *= (np.arange(steps)[:, None] < room)[:, :, None]
        sums[a:b] = part.sum(0)
    return sums


def windows_of(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bytes, length) of the consecutive windows of each document, the last one padded."""
    counts = -(-np.diff(offsets) // width)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * width
    length = np.minimum(offsets[1:][doc] - begin, width)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    return doc, padded[begin[:, None] + np.arange(width)], length


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """A network fitted to windows of at most `sample_docs` documents of each language.

    Only non-empty text and a non-null lang of documents that are not held out are used, from rows with an
    id.  Of a long text three windows are used, a text shorter than a window is one, padded: a language
    whose texts are all short is learned like others."""
    spoken = docs.filter(F.octet_length("text") > 0)
    chosen = labelled.sample(spoken, "lang", *HELD_OUT, sample_docs, per_class=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            places, found = [], []
            for k in range(len(batch)):
                n = int(offsets[k + 1] - offsets[k])
                at = mixed(np.arange(SAMPLE_WINDOWS, dtype=np.uint64) + np.uint64(n)) % np.uint64(max(n - TRAIN_WINDOW, 0) + 1)
                for x in at.astype(np.int64).tolist() if n > TRAIN_WINDOW else [0]:
                    places.append(k)
                    found.append(data[offsets[k] + x:min(offsets[k] + x + TRAIN_WINDOW, offsets[k + 1])].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(places, pa.int64())), pa.array(found, pa.binary())], ["lang", "bytes"])

    found = labelled.with_label(spoken.select("doc_id", "text"), chosen, "text", longest=None).mapInArrow(run, "lang string, bytes binary").toArrow()
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    held = found.column("bytes").to_pylist()
    lengths = np.array([len(x) for x in held], np.int64)
    windows = np.frombuffer(b"".join(x.ljust(TRAIN_WINDOW, b"\0") for x in held), np.uint8).reshape(-1, TRAIN_WINDOW)
    place = {x: k for k, x in enumerate(languages)}
    answers = np.array([place[x] for x in names], np.int64)
    order = np.lexsort((answers, lengths, *windows.T[::-1]))          # rows arrive in any order
    return fitted(languages, windows[order], lengths[order], answers[order])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of `docs` (doc_id, text).

    All bytes of whole texts are labelled.  A text that is null or has no letter gets `und` and score 0,
    and so does every text if the network knows no language.  A null doc_id is not held out.  An empty
    table gives no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in blocks(data, offsets):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                raw = part.tobytes()
                spoken = np.array([bool(own.languages) and bool(_LETTER.search(raw[x:y].decode("utf-8", "replace"))) for x, y in zip(at.tolist(), at[1:].tolist())], bool)
                best, sure = np.full(b - a, len(own.languages)), np.zeros(b - a)
                if spoken.any():
                    doc, windows, lengths = windows_of(part, at)
                    sums = position_sums(own, windows, lengths)
                    pooled = np.column_stack([np.bincount(doc, sums[:, k], b - a) for k in range(sums.shape[1])]) / np.maximum(np.diff(at), 1)[:, None]
                    best = np.where(spoken, pooled.argmax(1), best)
                    sure = np.where(spoken, np.clip(pooled.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(names[best], pa.string()), pa.array(sure)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    modulus, out = HELD_OUT
    held = (labelled.remainder(F.col("doc_id"), modulus) == out).alias("held_out")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
