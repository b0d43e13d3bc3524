"""Licence scans by a positional index of the rarest words of licence notices.

Phrases and notices are filed under their rarest word over all documents.  A file's licence words are looked
up in that index; each posting gives the place where the phrase would begin, the postings of its other words
must agree with that place, and the words found are compared with the phrase.  A notice counts where its
mandatory phrases stand at their places (some words of slack) and enough of its weight is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from symtrail.llm.arrays import Words, blocks, texts_of, words_of

#: Words by which a part of a notice may be off its place.
SLACK = 4

#: Notices travel to every task; more words than this are refused.
MAX_WORDS = 50_000

#: Places that are measured at once.
PLACES = 1 << 14

#: All bytes that are no ASCII letter or digit and not part of a longer character.
SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

#: Phrases and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: The method's own labels: label, notice, and the phrases it must hold.
NOTICES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "following conditions are met")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee is hereby granted")),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted free of charge", "any person obtaining a copy")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("public-domain", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)

HIT = "struct<label:string,base:boolean,word:bigint,begin:bigint,end:bigint,score:double>"
HIT_TYPE = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def offset_of(phrase: list[str], words: list[str]) -> int:
    return next(k for k in range(len(words)) if words[k:k + len(phrase)] == phrase)


@dataclass
class Templates:
    """Phrases and notices as word numbers, with the weights of the words."""

    phrases: tuple = PHRASES
    notices: tuple = NOTICES
    weights: dict[str, int] = field(default_factory=dict)

    @cached_property
    def vocabulary(self) -> list[str]:
        every = [t for t, _ in self.phrases] + [t for _, t, _ in self.notices]
        out = sorted({w for t in every for w in t.split()})
        if sum(len(t.split()) for t in every) > MAX_WORDS:
            raise ValueError(f"notices of more than {MAX_WORDS} words are not sent to the tasks")
        return out

    @cached_property
    def _hashed(self) -> tuple[np.ndarray, np.ndarray]:
        data = " ".join(self.vocabulary).encode()
        hashed = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), SEPARATORS).hash
        order = np.argsort(hashed)
        return hashed[order], order

    def numbers(self, words: Words) -> np.ndarray:
        """The place of each word in the vocabulary, -1 for others."""
        hashed, order = self._hashed
        if not len(words.hash):
            return np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(hashed, words.hash), len(hashed) - 1)
        return np.where(hashed[at] == words.hash, order[at], -1).astype(np.int32)

    def weight(self, words: list[str]) -> int:
        return sum(self.weights[w] for w in words)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    data, offsets = texts_of(batch.column("text"))
    for lo, hi in blocks(data, offsets):
        part = data[offsets[lo]:offsets[hi]]
        yield lo, hi, part, words_of(part, offsets[lo:hi + 1] - offsets[lo], SEPARATORS)


def word_weights(docs: DataFrame, templates: Templates) -> dict[str, int]:
    """1,000 * log2(1 + documents / (1 + those that hold the word)), rounded, of each word of the templates.

    Every document is counted; a task sends one number per word of the templates."""
    vocabulary = templates.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, _, words in _batches(batch):
                numbers = templates.numbers(words)
                hit = np.flatnonzero(numbers >= 0)
                pairs = np.unique(words.doc[hit] * len(vocabulary) + numbers[hit])
                held += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary, ""]), pa.array([*held.tolist(), n], pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in counts}
    return {w: round(1000 * math.log2(1 + n.get("", 0) / (1 + n.get(w, 0)))) for w in vocabulary}


# -- one block of text -----------------------------------------------------------------------------------

class Block:
    """Some documents' words, and the places of phrases in them."""

    def __init__(self, templates: Templates, data: np.ndarray, words: Words):
        self.templates, self.data, self.words = templates, data, words
        self.numbers = templates.numbers(words)
        licence = np.flatnonzero(self.numbers >= 0)
        licence = licence[np.argsort(self.numbers[licence], kind="stable")]
        cuts = np.searchsorted(self.numbers[licence], np.arange(len(templates.vocabulary) + 1))
        self.postings = [licence[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.places: dict[str, np.ndarray] = {}

    def of(self, phrase: str) -> np.ndarray:
        """Words (of the block) at which `phrase` begins, in order."""
        if phrase not in self.places:
            parts = phrase.split()
            number = {w: k for k, w in enumerate(self.templates.vocabulary)}
            rarest = max(range(len(parts)), key=lambda k: (self.templates.weights[parts[k]], -k))
            starts = self.postings[number[parts[rarest]]] - rarest
            starts = starts[starts >= 0]
            doc = self.words.doc[starts]
            starts = starts[starts + len(parts) <= self.words.first[doc + 1]]
            for k, w in enumerate(parts):
                starts = starts[self.numbers[starts + k] == number[w]]
            same = [self._reads(s, parts) for s in starts.tolist()]
            self.places[phrase] = starts[np.array(same, bool)] if same else starts
        return self.places[phrase]

    def _reads(self, start: int, parts: list[str]) -> bool:
        found = (self.data[self.words.start[start + k]:self.words.end[start + k]].tobytes() for k in range(len(parts)))
        return all(f.lower() == p.encode() for f, p in zip(found, parts))

    def notice(self, text: str, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(beginnings of the notice's surest phrase, share of the notice's weight that stands in place)."""
        parts = text.split()
        weight = [self.templates.weight(k.split()) for k in keys]
        surest = weight.index(max(weight))
        places = self.of(keys[surest])
        total = self.templates.weight(parts)
        if not len(places) or not total:
            return places[:0], np.zeros(0)
        begins, doc = places - offset_of(keys[surest].split(), parts), self.words.doc[places]
        low, high = self.words.first[doc], self.words.first[doc + 1]
        for key in keys:
            around, at = self.of(key), begins + offset_of(key.split(), parts)
            held = np.searchsorted(around, np.minimum(at + SLACK, high - 1), "right") > np.searchsorted(around, np.maximum(at - SLACK, low), "left")
            places, begins, low, high = places[held], begins[held], low[held], high[held]
        number = {w: k for k, w in enumerate(self.templates.vocabulary)}
        covered = np.zeros(len(places), np.int64)
        for first in range(0, len(places), PLACES):
            some = slice(first, first + PLACES)
            for k, w in enumerate(parts):
                at = begins[some, None] + k + np.arange(-SLACK, SLACK + 1)
                inside = (at >= low[some, None]) & (at < high[some, None])
                there = inside & (self.numbers[np.where(inside, at, 0)] == number[w])
                covered[some] += there.any(axis=1) * self.templates.weights[w]
        return places, covered / total


def _hits(block: Block) -> list[tuple[np.ndarray, np.ndarray, str, bool, np.ndarray]]:
    """(first word, last word, label, base, score) of all phrases and notices of a block."""
    out = []
    for phrase, label in block.templates.phrases:
        places = block.of(phrase)
        out.append((places, places + len(phrase.split()) - 1, label, True, np.ones(len(places))))
    for label, text, keys in block.templates.notices:
        places, share = block.notice(text, keys)
        enough = share >= 0.5
        weight = [block.templates.weight(k.split()) for k in keys]
        n = len(keys[weight.index(max(weight))].split())
        out.append((places[enough], places[enough] + n - 1, label, False, share[enough]))
    return out


def hits(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, hits), one row per row of `docs` (doc_id, text).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.  `hits` lists every
    place of a phrase (`base`, score 1) and every place of a notice's surest phrase around which at least
    half of the notice's weight stands, ordered by `word` (from 0), then label: `begin` and `end` are byte
    offsets in the text.  A null or empty text has no words and no hits.  Repeated rows give repeated rows.
    An empty table gives no rows; other columns are not read."""
    templates = Templates(phrases, notices)
    templates.weights = word_weights(docs, templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = [], []
            for lo, hi, data, words in _batches(batch):
                counts.append(np.diff(words.first))
                begin = np.concatenate([[0], np.cumsum(np.diff(texts_of(batch.column("text"))[1][lo:hi + 1]))])
                lists.extend(_rows(_hits(Block(templates, data, words)), words, begin, hi - lo))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lists, pa.list_(HIT_TYPE))], ["doc_id", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, hits array<{HIT}>")


def _rows(found: list, words: Words, begin: np.ndarray, n_docs: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    for starts, ends, label, base, score in found:
        for s, e, x in zip(starts.tolist(), ends.tolist(), score.tolist()):
            doc = int(words.doc[s])
            out[doc].append({"label": label, "base": base, "word": s - int(words.first[doc]), "begin": int(words.start[s] - begin[doc]),
                             "end": int(words.end[e] - begin[doc]), "score": x})
    for one in out:
        one.sort(key=lambda h: (h["word"], h["label"], not h["base"]))
    return out


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of `docs`.

    `score` is the greatest one of a document's hits, 0 without any.  Labels are distinct, sorted and joined
    by commas, empty without any.  Nulls, empty texts, repeated rows and empty tables: see `hits`."""
    found = hits(docs, phrases, notices)
    base = F.filter("hits", lambda h: h["base"])

    def joined(rows):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda h: h["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["word"])).alias("first_word"), F.array_max(F.transform(base, lambda h: h["word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"))


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


_PHRASES = ", ".join(f"({_list(p)}, '{label}')" for p, label in PHRASES)
_KEYS = ", ".join(
    f"({k}, '{label}', {_list(text)}, {_list(key)}, {offset_of(key.split(), text.split())}, {n})"
    for k, (label, text, keys) in enumerate(NOTICES) for n, key in enumerate(keys))

SQL = rf"""
with docs as (
  select row_number() over () id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
tokens as (select id, unnest(w) word, unnest(range(len(w))) pos from docs),
phrases(p, label) as (values {_PHRASES}),
keys(k, label, notice, p, off, n) as (values {_KEYS}),
vocabulary as (select distinct unnest(p) word from phrases union select distinct unnest(notice) from keys),
held as (select word, count(distinct id) df from tokens semi join vocabulary using (word) group by 1),
weights as (
  select word, round(1000 * log2(1 + (select count(*) from docs) / (1 + coalesce(df, 0))::double))::bigint weight from vocabulary left join held using (word)),
every as (select p from phrases union select p from keys),
placed as (
  select p, t.id, t.pos from every join tokens t on t.word = p[1] join docs d on d.id = t.id where d.w[t.pos + 1:t.pos + len(p)] = p),
base as (
  select id, count(*) n_base, min(pos) first_word, max(pos) last_word, string_agg(distinct label, ',' order by label) labels, list(distinct label) names
  from placed join phrases using (p) group by id),
key_weights as (select k, n, (select sum(weight) from (select unnest(p) word) join weights using (word)) weight from keys),
surest as (select k, arg_max(n, weight * 1000 - n) n from key_weights group by k),
candidates as (
  select k, label, notice, id, pos - off start from keys join surest using (k, n) join placed using (p)),
kept as (
  select k, label, notice, c.id, c.start from candidates c
  where (select count(*) from keys x where x.k = c.k and exists (
          select 1 from placed y where y.p = x.p and y.id = c.id and y.pos between c.start + x.off - {SLACK} and c.start + x.off + {SLACK}))
        = (select count(*) from keys x where x.k = c.k)),
parts as (select *, unnest(notice) word, unnest(range(len(notice))) j from kept),
shares as (
  select label, p.id, start, sum(weight) total,
         sum(case when list_contains(d.w[greatest(start + j - {SLACK}, 0) + 1:greatest(start + j + {SLACK} + 1, 0)], word) then weight else 0 end) covered
  from parts p join docs d on d.id = p.id join weights using (word) group by all),
own as (select id, list(distinct label) names, max(covered / total::double) score from shares where covered * 2 >= total and total > 0 group by id)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
       coalesce(b.labels, '') base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.names, []), coalesce(o.names, [])))), ',') as labels,
       case when n_base > 0 then 1.0 else coalesce(o.score, 0.0) end::double score
from docs d left join base b on b.id = d.id left join own o on o.id = d.id
"""
