"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Symbols of many words lie in one flat array.  In each round the keys of all adjacent pairs are looked up
by binary search in the sorted pair keys, every word finds its lowest rank, and all its pairs of that
rank are merged at once.  Words without a known pair leave the array.

Texts are first cut into pieces: at single spaces between other characters, where the splitting pattern
always cuts, or else by the pattern itself.  A bounded cache holds the ids of recent pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from symtrail.llm.arrays import blocks, texts_of

#: Pieces whose ids a task remembers; when there are more, it starts anew.
CACHE_PIECES = 200_000

#: The splitting pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_UNMERGEABLE = np.iinfo(np.int32).max
_CUT = "\0"
_LOOSE_SPACE = re.compile(r" \s|\s ")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Sorted pair keys with ranks and results, and the bytes of every id."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    token_bytes: np.ndarray
    token_starts: np.ndarray
    digits: np.ndarray
    digit_starts: np.ndarray
    specials: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        letters, ids = byte_letters(), stated["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in stated["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.uint64)
        order = np.argsort(keys)
        specials = {t["content"]: t["id"] for t in stated.get("added_tokens", [])}
        of_id = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        of_id |= {i: content.encode() for content, i in specials.items()}
        tokens = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        byte_ids = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        token_bytes, token_starts = _joined(tokens)
        digits, digit_starts = _joined([b"%d," % i for i in range(len(tokens))])
        return cls(byte_ids, keys[order], np.arange(len(merges), dtype=np.int32)[order],
                   np.array([ids[a + b] for a, b in merges], np.int32)[order],
                   token_bytes, token_starts, digits, digit_starts, specials)

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as byte values in a row, and how many each word has."""
        ids, done_ids, done_words = self.byte_ids[symbols], [], []
        word = np.repeat(np.arange(len(lengths)), lengths)
        while len(ids):
            rank = np.full(len(ids), _UNMERGEABLE, np.int32)
            new = np.zeros(len(ids), np.int32)
            together = np.flatnonzero(word[1:] == word[:-1])
            keys = (ids[together].astype(np.uint64) << np.uint64(32)) | ids[together + 1].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[at] == keys
            rank[together[known]] = self.pair_ranks[at[known]]
            new[together[known]] = self.pair_ids[at[known]]
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            counts = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            busy = np.repeat(least < _UNMERGEABLE, counts)
            if not busy.all():
                done_ids.append(ids[~busy])
                done_words.append(word[~busy])
            best = (rank == np.repeat(least, counts)) & busy
            place = np.flatnonzero(best)
            if len(place) > 1:      # of pairs that overlap (aaa), every second one from the left
                run = np.concatenate(([True], (np.diff(place) > 1) | (rank[place[1:]] != rank[place[:-1]])))
                first = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
                place = place[(np.arange(len(place)) - first) % 2 == 0]
            ids[place] = new[place]
            busy[place + 1] = False
            ids, word = ids[busy], word[busy]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(lengths))

    def expanded(self, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of `ids` in a table of byte strings, in a row, and where each begins."""
        lengths = (starts[1:] - starts[:-1])[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return flat[np.repeat(starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def decoded(self, ids: np.ndarray) -> str:
        """The text of `ids`; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.token_starts) - 1)]
        return self.expanded(ids, self.token_bytes, self.token_starts)[0].tobytes().decode("utf-8", "replace")


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return np.frombuffer(b"".join(parts), np.uint8), starts


class Encoder:
    """Ids of texts, with a bounded cache of pieces."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE_PIECES):
        self.vocabulary, self.cache = vocabulary, cache
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")") if vocabulary.specials else None
        self._forget()

    def _forget(self) -> None:
        self.known = {content: k for k, content in enumerate(self.vocabulary.specials)}
        self.pool = np.array(list(self.vocabulary.specials.values()), np.int32)
        self.starts = np.arange(len(self.known) + 1)

    def pieces(self, text: str) -> list[str]:
        """Parts of the text whose ids do not depend on what surrounds them."""
        if self.special is not None and self.special.search(text):
            parts = [p for p in self.special.split(text) if p]
            return [x for p in parts for x in ([p] if p in self.vocabulary.specials else self.pattern.findall(p))]
        if _CUT in text or _LOOSE_SPACE.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", _CUT + " ").split(_CUT)

    def learn(self, pieces: list[str]) -> None:
        """Put new pieces and their ids into the cache."""
        words, per_piece = [], np.empty(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            found = self.pattern.findall(piece)
            per_piece[k] = len(found)
            words += found
        encoded = [w.encode() for w in words]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids, counts = self.vocabulary.merged(np.frombuffer(b"".join(encoded), np.uint8), lengths)
        ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum(per_piece)]
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.starts = np.concatenate((self.starts, len(self.pool) + ends))
        self.pool = np.concatenate((self.pool, ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins)."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                pieces += self.pieces(text)
            ends.append(len(pieces))
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new and len(self.known) + len(new) > self.cache:
            self._forget()
            new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        lengths = (self.starts[1:] - self.starts[:-1])[at]
        until = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.pool[np.repeat(self.starts[at] - until[:-1], lengths) + np.arange(until[-1])]
        return ids, until[np.array(ends)]


def _texts(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> list[str]:
    raw = data[offsets[first]:offsets[last]].tobytes()
    at = (offsets[first:last + 1] - offsets[first]).tolist()
    return [raw[a:b].decode() for a, b in zip(at, at[1:])]


def _shared(df: DataFrame, path: str):
    """The vocabulary, read once on the driver; its size is that of the file."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary.from_file(path))


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of `docs` (doc_id, text), one row per row.

    Null and empty texts have no ids; the strings of special tokens become their ids.  Texts are encoded
    whole.  An empty table gives no rows; other columns are not read."""
    vocabulary = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for first, last in blocks(data, offsets):
                ids, at = encoder.encode(_texts(data, offsets, first, last))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of `encoded` (doc_id, ids); null ids give an empty text, unknown ids nothing."""
    vocabulary = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary.value.decoded(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_id_type(encoded)}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and its ids decoded again.

    The same as digests of `encode` and `decode`, without moving the ids between two passes."""
    vocabulary = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        encoder = Encoder(own)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for first, last in blocks(data, offsets):
                ids, at = encoder.encode(_texts(data, offsets, first, last))
                digits, digit_at = own.expanded(ids, own.digits, own.digit_starts)
                letters, letter_at = own.expanded(ids, own.token_bytes, own.token_starts)
                digits, letters = digits.tobytes(), letters.tobytes()
                named, decoded = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    named.append(hashlib.sha256(digits[digit_at[a]:max(digit_at[a], digit_at[b] - 1)]).hexdigest())
                    text = letters[letter_at[a]:letter_at[b]].decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(np.diff(at)), pa.array(named), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
