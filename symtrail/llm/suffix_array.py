"""Suffix-array dedup: removes bytes covered by a long string that also starts earlier.

Suffixes are bucketed by a q-gram and buckets are refined until they hold equal strings of LENGTH bytes.

1. Anchors.  Every string of LENGTH bytes is filed under its anchor, the q-gram in it with the least hash
   (the leftmost of equal ones).  Equal strings have equal anchors at equal places, and the strings of one
   anchor are a short run, so an anchor with its run (a piece) stands for up to 81 suffixes.
2. Buckets of anchors.  Pieces meet by anchor hash.  Of equal pieces the first one stays and the others
   are removed whole; a bucket that then holds one piece is done.  Equal pieces of one task are combined
   before the shuffle.
3. Refinement.  The pieces of a bucket with several are fetched from the text, and the suffixes in them are
   refined by bucket-pointer steps: the bucket numbers of 8 bytes are refined by sorting on the numbers of
   later offsets to 16, 32, 64 and LENGTH bytes, each step reusing the numbers of the last.  All but the
   first suffix of a final bucket are removed.
4. A bucket of more than HOT pieces is spread by the hashes of its single strings instead.

Texts are bytes; matches do not cross documents; all strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from symtrail.llm.arrays import U64, blocks, byte_table, mixed, powers, texts_of
from symtrail.session import cut

LENGTH, GRAM = 100, 20
_RUN = LENGTH - GRAM + 1

#: Bytes of text that anchors are taken from at once; a longer text is cut with an overlap of LENGTH - 1.
SEGMENT = 1 << 20

#: Pieces of one anchor that are refined in one task, bytes of pieces that are refined at once, and bytes
#: of pieces that a task packs at once.
HOT, REFINED_AT_ONCE, PACK_BYTES = 20_000, 1_500_000, 8 << 20

_BYTES = byte_table(fold=False, seed=11)
_PLACE = U64((1 << 20) - 1)

#: Kinds of rows.
_PIECE, _GONE, _COLD, _HOT = 0, 1, 2, 3


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place; places too near the end have other values."""
    def join(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
        out = left * U64(0x9E3779B97F4A7C15)
        out[:-by] += right[by:] ^ (right[by:] >> U64(29))
        out *= U64(0xBF58476D1CE4E5B9)
        out ^= out >> U64(31)
        return out

    h = _BYTES[data]
    for by in (1, 2):
        h = join(h, h, by)
    four = h
    for by in (4, 8):
        h = join(h, h, by)
    return join(h, four, 16)        # 16 + 4 bytes


def anchors(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor, first start, last start, anchor hash) of the pieces of documents in `data`.

    `first` has where each document begins, and the end of the last; `data` is at most SEGMENT long."""
    strings = np.maximum(np.diff(first) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(strings)), strings)
    if len(doc) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64)
    start = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(strings) - strings, strings)
    hashes = gram_hashes(data)
    least = (hashes & ~_PLACE) | np.arange(len(data), dtype=U64)
    width = 1
    while width * 2 <= _RUN:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _RUN - width
    at = (np.minimum(least[start], least[start + rest]) & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return doc[begin], at[begin], start[begin], start[end], hashes[at[begin]]


def _string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def _packed(low: np.ndarray, anchor: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """First start, anchor and last start relative to it, and 16 bits of the text's hash, in one long."""
    return (low << 30) | ((anchor - low) << 23) | ((high - low) << 16) | tag


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = place >> 30
    return low, low + ((place >> 23) & 127), low + ((place >> 16) & 127)


def _runs(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of spans after those of one owner that touch or overlap were joined."""
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    if len(start) == 0:
        return owner, start, end
    lift = (owner - owner[0]).astype(np.int64)
    lift = np.cumsum(np.concatenate(([0], lift[1:] != lift[:-1]))) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return owner[begin], start[begin], (reach - lift)[np.append(begin[1:], len(start)) - 1]


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tag, text): `doc` orders documents (a null id first), `tag` tells texts of one id apart."""
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).alias("tag"), "text")


def _pieces(docs: DataFrame) -> DataFrame:
    """Pieces (kind 0: key, piece hash, doc, place), and what equal ones in a task already remove (kind 1:
    doc, start and tag in place, end in piece)."""

    def of_segments(doc: np.ndarray, tag: np.ndarray, base: np.ndarray, data: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        own, at, low, high, key = anchors(data, first)
        piece = mixed(_string_hashes(data, low, high + LENGTH) + (at - low).astype(U64) * U64(0x9E3779B97F4A7C15))
        shift = base[own] - first[:-1][own]
        low, at, high = low + shift, at + shift, high + shift
        order = np.lexsort((low, doc[own], piece, key))
        own, at, low, high, key, piece = (x[order] for x in (own, at, low, high, key, piece))
        new = np.ones(len(own), bool)
        new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        group = np.cumsum(new) - 1
        lead = np.flatnonzero(new)[group] if len(own) else group
        later = (doc[own] != doc[own[lead]]) | (low != low[lead])
        gone_own, start, end = _runs(low[later], high[later] + LENGTH, own[later])
        kinds = np.concatenate([np.full(len(lead[new]), _PIECE), np.full(len(gone_own), _GONE)]).astype(np.int8)
        place = np.concatenate([_packed(low[new], at[new], high[new], tag[own[new]]), (start << 30) | tag[gone_own]])
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(np.concatenate([key[new].view(np.int64), mixed(start.astype(U64)).view(np.int64)])),
             pa.array(np.concatenate([piece[new].view(np.int64), end])), pa.array(doc[np.concatenate([own[new], gone_own])]), pa.array(place)],
            ["kind", "key", "piece", "doc", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for a, b in blocks(data, offsets, SEGMENT - 1):
                part, first = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                if len(part) < SEGMENT:
                    yield of_segments(doc[a:b], tag[a:b], np.zeros(b - a, np.int64), part, first)
                    continue
                for s in range(0, len(part) - LENGTH + 1, SEGMENT - LENGTH):      # one long text
                    piece = part[s:s + SEGMENT - 1]
                    yield of_segments(doc[a:b], tag[a:b], np.array([s]), piece, np.array([0, len(piece)]))

    return docs.select("doc", "tag", "text").mapInArrow(run, "kind byte, key long, piece long, doc long, place long")


def _decided(pieces: DataFrame) -> DataFrame:
    """(doc, kind, place, end): pieces that are removed whole (kind 0), spans that are already removed (kind 1,
    with their end) and pieces to refine.

    Rows come sorted by key and piece, so that of a bucket only its pieces up to HOT are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(4, np.int64)                # key, piece, doc, first start of the class now open
        started, hot = False, False
        waiting_doc: list[np.ndarray] = []          # first pieces of the bucket now open
        waiting_place: list[np.ndarray] = []

        def emit(doc: np.ndarray, place: np.ndarray, kind: int, end: np.ndarray | None = None) -> pa.RecordBatch:
            end = np.zeros(len(doc), np.int64) if end is None else end
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(np.full(len(doc), kind, np.int8)), pa.array(place), pa.array(end)], ["doc", "kind", "place", "end"])

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            key, piece, doc, place = (batch.column(c).to_numpy() for c in ("key", "piece", "doc", "place"))
            gone = kind == _GONE
            if gone.any():
                yield emit(doc[gone], place[gone], _GONE, piece[gone])
            key, piece, doc, place = key[~gone], piece[~gone], doc[~gone], place[~gone]
            n = len(key)
            if n == 0:
                continue
            bucket, new = np.ones(n, bool), np.ones(n, bool)
            bucket[1:] = key[1:] != key[:-1]
            new[1:] = bucket[1:] | (piece[1:] != piece[:-1])
            if started:
                bucket[0] = key[0] != last[0]
                new[0] = bucket[0] or piece[0] != last[1]
            low = place >> 30
            lead = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            lead_doc = np.where(lead >= 0, doc[lead], last[2])
            lead_low = np.where(lead >= 0, low[lead], last[3])
            later = ~new & ((doc != lead_doc) | (low != lead_low))
            if later.any():
                yield emit(doc[later], place[later], _PIECE)
            firsts = np.flatnonzero(new)
            opens = np.flatnonzero(bucket[firsts])
            head = firsts[:opens[0]] if len(opens) else firsts           # of the bucket that was open
            if len(head):
                if hot:
                    yield emit(doc[head], place[head], _HOT)
                else:
                    waiting_doc.append(doc[head])
                    waiting_place.append(place[head])
                    if sum(map(len, waiting_doc)) > HOT:
                        hot = True
                        yield emit(np.concatenate(waiting_doc), np.concatenate(waiting_place), _HOT)
                        waiting_doc, waiting_place = [], []
            if len(opens):
                if sum(map(len, waiting_doc)) > 1:
                    yield emit(np.concatenate(waiting_doc), np.concatenate(waiting_place), _COLD)
                sizes = np.diff(np.append(opens, len(firsts)))
                inner = np.repeat((sizes > 1) & (np.arange(len(sizes)) < len(sizes) - 1), sizes)
                crowded = np.repeat(sizes > HOT, sizes) & inner
                body = firsts[opens[0]:]
                for mask, k in ((inner & ~crowded, _COLD), (crowded, _HOT)):
                    if mask.any():
                        yield emit(doc[body[mask]], place[body[mask]], k)
                tail = firsts[opens[-1]:]
                waiting_doc, waiting_place, hot = [doc[tail]], [place[tail]], False
            last = np.array([key[-1], piece[-1], lead_doc[-1], lead_low[-1]])
            started = True
        if not hot and sum(map(len, waiting_doc)) > 1:
            yield emit(np.concatenate(waiting_doc), np.concatenate(waiting_place), _COLD)

    ordered = pieces.repartition("key").sortWithinPartitions("key", "piece", "doc", "place")
    return ordered.mapInArrow(run, "doc long, kind byte, place long, end long")


def refine(data: np.ndarray, suffixes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Final bucket numbers: equal for suffixes (places in `data`) of one bucket with equal LENGTH bytes.

    Bucket-pointer refinement: numbers of 8 bytes, then pairs of numbers at an offset, each step twice as
    deep.  Only suffixes whose bucket holds another one are refined further."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(data)]
    numbers = np.unique(np.ascontiguousarray(words).view("<u8").ravel(), return_inverse=True)[1]
    depth = 8
    while depth * 2 <= LENGTH:
        pair = numbers.copy()
        pair[:-depth] = numbers[:-depth] * np.int64(len(data) + 1) + numbers[depth:]
        numbers = np.unique(pair, return_inverse=True)[1]
        depth *= 2
    own = np.unique(bucket * np.int64(len(data) + 1) + numbers[suffixes], return_inverse=True)[1]
    crowded = np.bincount(own)[own] > 1
    out = np.arange(len(suffixes)) + len(suffixes)
    deep = own[crowded] * np.int64(len(data) + 1) + numbers[suffixes[crowded] + LENGTH - depth]
    out[crowded] = np.unique(deep, return_inverse=True)[1]
    return out


def _found(decided: DataFrame) -> DataFrame:
    """(doc, tag, gone, cold, hot), one row per document: spans removed so far, and pieces to refine."""
    of = lambda kind, value: F.collect_list(F.when(F.col("kind") == kind, value))
    rows = decided.withColumn("tag", F.col("place").bitwiseAND(F.lit(0xFFFF))).groupBy("doc", "tag").agg(
        of(_PIECE, F.col("place")).alias("whole"), of(_GONE, F.col("place")).alias("begin"), of(_GONE, F.col("end")).alias("end"),
        of(_COLD, F.col("place")).alias("cold"), of(_HOT, F.col("place")).alias("hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)

        for batch in batches:
            (whole, of_whole), (begin, of_begin), (end, _) = (flat(batch.column(c)) for c in ("whole", "begin", "end"))
            low, _, high = _unpacked(whole)
            own, start, stop = _runs(np.concatenate([low, begin >> 30]), np.concatenate([high + LENGTH, end]), np.concatenate([of_whole, of_begin]))
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(own, np.arange(len(batch) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), lists, batch.column("cold"), batch.column("hot")], ["doc", "tag", "gone", "cold", "hot"])

    return rows.mapInArrow(run, "doc long, tag long, gone array<struct<start:long,end:long>>, cold array<long>, hot array<long>")


def _zipped(texts: DataFrame) -> DataFrame:
    """(doc_id, doc, tag, packed, n_bytes): every text compressed, as it is shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            raw, at = memoryview(data), offsets.tolist()
            packed = [pa.compress(pa.py_buffer(raw[a:b]), "zstd", asbytes=True) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "doc", "tag")), pa.array(packed, pa.binary()), pa.array(np.diff(offsets))], ["doc_id", "doc", "tag", "packed", "n_bytes"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, doc long, tag long, packed binary, n_bytes long")


def _unzipped(packed, n_bytes: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n_bytes, "zstd"), np.uint8) if n_bytes else np.zeros(0, np.uint8)


def _piece_texts(rows: DataFrame, n_blocks: int) -> DataFrame:
    """(block, blob): the pieces to refine of `rows`, packed by a hash of their anchor's bytes.

    Rows without any are skipped here and not filtered, so that this plan and that of the result read one
    exchange of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, doc, place, sizes = (np.concatenate([h[k] for h in held]) for k in range(4))
            data = np.concatenate([h[4] for h in held])
            block = (key % U64(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            edges = np.searchsorted(block[order], np.arange(n_blocks + 1))
            starts = np.cumsum(sizes) - sizes
            blobs = []
            for k in range(n_blocks):
                own = order[edges[k]:edges[k + 1]]
                flat = data[np.repeat(starts[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())]
                raw = b"".join([np.array([len(own), len(flat)], "<i8").tobytes(), key[own].tobytes(), doc[own].tobytes(), place[own].tobytes(), sizes[own].tobytes(), flat.tobytes()])
                blobs.append(np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n_blocks, dtype=np.int32)), pa.array(blobs, pa.binary())], ["block", "blob"])

        for batch in batches:
            docs, counts = batch.column("doc").to_numpy(), batch.column("n_bytes").to_numpy()
            for k in range(len(batch)):
                place = batch.column("cold").slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                if len(place) == 0:
                    continue
                data = _unzipped(batch.column("packed")[k].as_buffer(), int(counts[k]))
                low, at, high = _unpacked(place)
                sizes = high + LENGTH - low
                ends = np.cumsum(sizes)
                flat = data[np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])]
                grams = data[at[:, None] + np.arange(GRAM)]
                key = _string_hashes(grams.ravel(), np.arange(0, grams.size, GRAM), np.arange(GRAM, grams.size + 1, GRAM))
                held.append((key, np.full(len(place), docs[k]), place, sizes, flat))
                size += len(flat)
                if size >= PACK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.select("doc_id", "doc", "tag", "packed", "n_bytes", "cold").mapInArrow(run, "block int, blob binary")


def _later_suffixes(pieces: DataFrame, n_blocks: int) -> DataFrame:
    """(doc, tag, start, end): spans of the strings in `pieces` that also start earlier."""

    def judged(key: np.ndarray, doc: np.ndarray, place: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        low, _, high = _unpacked(place)
        base = np.cumsum(sizes) - sizes
        counts = high - low + 1
        owner = np.repeat(np.arange(len(place)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        bucket = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))[owner]
        name = refine(data, base[owner] + within, bucket)
        start = low[owner] + within
        order = np.lexsort((start, doc[owner], name))
        name, start, owner = name[order], start[order], owner[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
        later = (doc[owner] != doc[owner[lead]]) | (start != start[lead])
        own, begin, end = _runs(start[later], start[later] + LENGTH, owner[later])
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[own]), pa.array(place[own] & 0xFFFF), pa.array(begin), pa.array(end)], ["doc", "tag", "start", "end"])

    def of_block(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, as many at once as hold about REFINED_AT_ONCE bytes."""
        parts = []
        for blob in blobs:
            raw = pa.decompress(pa.py_buffer(blob)[8:], int(np.frombuffer(blob, "<i8", 1)[0]), "zstd").to_pybytes()
            n, size = np.frombuffer(raw, "<i8", 2).tolist()
            columns = [np.frombuffer(raw, kind, n, 16 + 8 * n * k) for k, kind in enumerate(("<u8", "<i8", "<i8", "<i8"))]
            parts.append((*columns, np.frombuffer(raw, np.uint8, size, 16 + 32 * n)))
        key, doc, place, sizes, data = (np.concatenate(x) for x in zip(*parts))
        del parts
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((place, doc, key))
        ranked, until = key[order], np.cumsum(sizes[order])
        borders = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, len(ranked))
        first = 0
        while first < len(order):
            reach = np.searchsorted(until, (until[first - 1] if first else 0) + REFINED_AT_ONCE)
            stop = int(borders[np.searchsorted(borders, max(reach, first + 1), "left")]) if reach < len(order) else len(order)
            own = order[first:stop]
            flat = data[np.repeat(starts[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())]
            yield judged(key[own], doc[own], place[own], sizes[own], flat)
            first = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for k, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
                if k != block and held:
                    yield from of_block(held)
                    held = []
                block = k
                held.append(blob)
        if held:
            yield from of_block(held)

    return pieces.repartition(n_blocks, "block").sortWithinPartitions("block").mapInArrow(run, "doc long, tag long, start long, end long")


def _later_strings(rows: DataFrame) -> DataFrame:
    """(doc, tag, start, end) as `_later_suffixes`, for crowded buckets: every string is spread by its own hashes."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for k in range(len(batch)):
                place = np.array(batch.column("hot")[k].as_py() or [], np.int64)
                if len(place) == 0:         # skipped here, as in _piece_texts
                    continue
                data = _unzipped(batch.column("packed")[k].as_buffer(), batch.column("n_bytes")[k].as_py())
                for part in np.array_split(place, max(1, len(place) // 2_000)):
                    low, _, high = _unpacked(part)
                    counts = high - low + 1
                    start = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start]
                    flat, at = view.ravel(), np.arange(0, view.size, LENGTH)
                    one = _string_hashes(flat, at, at + LENGTH)
                    two = _string_hashes(flat[::-1].copy(), at, at + LENGTH)[::-1].copy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(start), doc[k])), pa.array(np.full(len(start), tag[k])), pa.array(start)],
                        ["one", "two", "doc", "tag", "start"])

    own = rows.select("doc_id", "doc", "tag", "packed", "n_bytes", "hot").mapInArrow(strings, "one long, two long, doc long, tag long, start long")
    firsts = own.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = own.join(firsts, ["one", "two"]).filter("struct(doc, start) != lead")
    return later.select("doc", "tag", "start", (F.col("start") + LENGTH).alias("end"))


def removed_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of `docs` (doc_id, text).

    Removed is every byte covered by a string of 100 bytes that also starts earlier: in a document with a
    smaller doc_id, or earlier in the same one.  A null id comes before all others.  Rows with the same id
    and text are one document that is listed several times; rows with the same id and other text compare by
    where their strings start.  Null counts as empty; texts under 100 bytes lose nothing.  An empty table
    gives no rows; other columns are not read."""
    n_blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _identified(docs)
    found = cut(_found(_decided(_pieces(texts))))
    rows = _zipped(texts).join(found, ["doc", "tag"], "left")
    later = _later_suffixes(_piece_texts(rows, n_blocks), n_blocks)
    if not found.filter(F.size("hot") > 0).isEmpty():
        later = later.unionByName(_later_strings(rows))
    more = later.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
            lists = column.slice(k, 1).flatten()
            return tuple(lists.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))

        for batch in batches:
            removed, runs, digests = [], [], []
            for k in range(len(batch)):
                text = _unzipped(batch.column("packed")[k].as_buffer(), batch.column("n_bytes")[k].as_py())
                pairs = [spans(batch.column(c), k) for c in ("gone", "more")]
                start, end = (np.concatenate([p[j] for p in pairs]) for j in (0, 1))
                _, start, end = _runs(start, end, np.zeros(len(start), np.int64))
                inner = np.zeros(len(text) + 1, np.int8)
                inner[start] += 1
                inner[end] -= 1
                covered = np.cumsum(inner[:-1], dtype=np.int8).astype(bool)
                removed.append(int(covered.sum()))
                runs.append(len(start))
                digests.append(hashlib.sha256(text[~covered].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(more, ["doc", "tag"], "left").select("doc_id", "doc", "tag", "packed", "n_bytes", "gone", "more").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
