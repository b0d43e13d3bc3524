"""Spelling variants: words one edit apart, found by walking a distributed trie level by level.

The trie is a table of edges between its branching nodes; a run of letters without a branch is one edge.  It is
read off the sorted words, range by range: a node is where neighbours part.  Two words one edit apart part
ways at such a node, so a state (word, position, node, edits) without an edit exists only there.  It takes its
edit by a join with the edges of its node; states with an edit then follow their remaining letters by joins,
edge by edge, and a state that reaches the end of a word is a neighbour.

An edit lies in the second half of a word or, read backwards, in its second half too: so there is a trie of
the words and one of the reversed words, and both only hold nodes below the middle, where branches are few.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from symtrail.llm.arrays import blocks, texts_of
from symtrail.llm.merkle import CRC_TABLE, crc_sql
from symtrail.session import cut

#: What ends every path; no letter.
END = "$"

#: Longer prefixes are named by a 128-bit hash.
NAMED_BY_TEXT = 32

#: Longer runs are hashed one by one.
LONG = 256

#: Words that a task counts before it passes them on.
COUNTED = 400_000

#: Rows of an Arrow batch that a task emits.
BATCH = 20_000


# -- words -----------------------------------------------------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True      # 0xC3 leads U+00C0 to U+00FF and nothing else

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of letters in the bytes of some documents; none crosses documents."""
    inside = _LETTER[data]
    inside[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of many pieces of `data`, each continued from `begun`: all first bytes, then all second ones."""
    crc = begun ^ np.uint32(0xFFFFFFFF)
    longest = end - start > LONG
    rows = np.flatnonzero(~longest)
    at = start[rows]
    while len(rows):
        crc[rows] = _CRC[(crc[rows] ^ data[at]) & 0xFF] ^ (crc[rows] >> np.uint32(8))
        at = at + 1
        more = at < end[rows]
        rows, at = rows[more], at[more]
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(longest):
        crc[k] = zlib.crc32(data[start[k]:end[k]].tobytes(), int(begun[k]))
    return crc


def _words_of(ids: list[str], data: np.ndarray, offsets: np.ndarray, least: int, misspelt: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(word, n) of some documents: runs as they stand, then those that lose a letter."""
    data = _LOWER[data]
    start, end = _runs(data, offsets)
    two_bytes = np.concatenate([[0], np.cumsum(data == 0xC3)])
    letters = end - start - (two_bytes[end] - two_bytes[start])
    kept = letters >= least
    start, end, letters = start[kept], end[kept], letters[kept]
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = _crc32(data, start, end, begun[np.searchsorted(offsets, start, "right") - 1]) if len(start) else np.zeros(0, np.uint32)
    lost = h % misspelt == 0
    whole = ~lost
    size = (end - start)[whole]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start[whole]] += 1
    inside[end[whole]] -= 1
    held = data[np.cumsum(inside[:-1]).astype(bool)]
    places = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(places), pa.py_buffer(held)])
    counted = words.value_counts()
    yield counted.field("values"), counted.field("counts")
    spelt = []
    for k in np.flatnonzero(lost).tolist():
        word, at = data[start[k]:end[k]].tobytes().decode(), int(h[k]) % int(letters[k])
        if letters[k] > least:
            spelt.append(word[:at] + word[at + 1:])
    yield pa.array(spelt, pa.large_string()), pa.array(np.ones(len(spelt), np.int64))


def occurrences(docs: DataFrame, least: int = 7, misspelt: int = 31) -> DataFrame:
    """(word, n): how often each word of at least `least` letters occurs in `docs` (doc_id, text).

    A word is a maximal run of letters, A-Z lower-cased.  If `misspelt` divides the crc32 h of
    `<doc_id>:<run>` (a null id is empty), the run's letter h % length is deleted first.  A task counts the
    words of about 1 MB at once, and adds them up until it holds COUNTED different ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added_up() -> pa.Table:
            one = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
            held.clear()
            return one

        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in blocks(data, offsets):
                for words, n in _words_of(ids[lo:hi], data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], least, misspelt):
                    held.append(pa.table({"word": words, "n": n}))
                if sum(t.num_rows for t in held) >= 2 * COUNTED:
                    held.append(added_up())
                    if held[0].num_rows >= COUNTED:
                        yield from _narrow(held.pop())
        if held:
            yield from _narrow(added_up())

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _narrow(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for k in range(0, table.num_rows, BATCH):
        yield from table.slice(k, BATCH).cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()


# -- trie ------------------------------------------------------------------------------------------------

def _code(letter: str) -> int:
    return 0 if letter == END else ord(letter)


def _bit_of(code: int) -> int:
    bit = 1 << code % 64
    return bit - (1 << 64) if bit >> 63 else bit


def _name(letters: str) -> str:
    """Of the node below some letters, the first of which tells the two tries apart."""
    return letters if len(letters) <= NAMED_BY_TEXT else f"{letters[0]}#{md5(letters.encode()).hexdigest()}"


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    if high < 64:
        while low < high and a[low] == b[low]:
            low += 1
        return low
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _first_edit(path: str) -> int:
    """Where edits begin on a path, counted with its side letter: behind the middle of the word."""
    n = len(path) - 1
    return 1 + (n // 2 if path[0] == "f" else n - n // 2)


class Node:
    """A branching node of the part of a trie that a task holds."""

    __slots__ = ("depth", "first", "forced", "letters", "edges")

    def __init__(self, depth: int, first: int, forced: bool = False):
        self.depth, self.first, self.forced, self.letters, self.edges = depth, first, forced, 0, []


def branching(paths: list[str], left: int, right: int, least: int) -> Iterator[tuple[Node, int]]:
    """(node, end) of the branching nodes of sorted `paths`, children first: those below it are paths[first:end].

    An edge of a node is (path, child node or None).  Of the first path the prefixes of up to `left` letters
    are shared with another task, and of the last one those of up to `right`: they are nodes in any case,
    as every task must see them alike.  Nodes of fewer than `least` letters are left out."""
    stack: list[Node] = [Node(0, 0)]

    def forced(k: int, shared: int) -> None:
        upto = left if k == 0 else 0
        if right > shared:
            upto = max(upto, min(right, _shared(paths[k], paths[-1])))
        for depth in range(max(shared + 1, least), upto + 1):
            stack.append(Node(depth, k, True))

    def closed(k: int, shared: int) -> Iterator[tuple[Node, int]]:
        """Path k - 1 is over; path k has its first `shared` letters."""
        last: Node | None = None
        first = k - 1
        while stack[-1].depth > shared:
            node = stack.pop()
            node.edges.append((first, last))
            if node.depth >= least:
                yield node, k
            last, first = node, node.first
        if stack[-1].depth < shared:
            stack.append(Node(shared, first))
        stack[-1].edges.append((first, last))

    for k, path in enumerate(paths):
        shared = _shared(paths[k - 1], path) if k else 0
        if k:
            yield from closed(k, shared)
        forced(k, shared)
    if paths:
        yield from closed(len(paths), 0)


def _marked(node: Node, paths: list[str]) -> list[tuple[int, int, Node | None, str, int]]:
    """(code, path, child, label, mask) of a node's edges; sets the node's letters.

    The label of an edge to a word ends with END.  A child that other tasks share too may have any letter."""
    out = []
    for k, child in node.edges:
        path = paths[k] + END if child is None else paths[k]
        label = path[node.depth:] if child is None else path[node.depth:child.depth]
        code = _code(label[0])
        if len(label) > 1:
            mask = _bit_of(_code(label[1]))
        else:
            mask = 0 if child is None else -1 if child.forced else child.letters
        node.letters |= _bit_of(code)
        out.append((code, k, child, label, mask))
    return out


EDGES = "node string, code int, label string, size int, child string, target string, target_n long, mask long"
STATES = "path string, n long, at int, node string"


def _sorted_paths(words: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(part, path, n) of both tries, dealt out by range and sorted, and what each part shares with its neighbours.

    Only the first and last path of each part come to the driver."""
    sides = F.explode(F.array(F.concat(F.lit("f"), "word"), F.concat(F.lit("r"), F.reverse("word")))).alias("path")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))       # stated, or small ranges are merged
    dealt = words.select(sides, "n").repartitionByRange(parts, "path").sortWithinPartitions("path")
    rows = cut(dealt.select(F.spark_partition_id().alias("part"), "path", "n"))
    ends = sorted(rows.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect(), key=lambda r: r["part"])
    between = [0, *(_shared(a["last"], b["first"]) for a, b in zip(ends, ends[1:])), 0]
    return rows, {r["part"]: (between[k], between[k + 1]) for k, r in enumerate(ends)}


def _trie(rows: DataFrame, shared: dict[int, tuple[int, int]], least: int, schema: str) -> DataFrame:
    """The edges (`schema` EDGES) or the states without an edit (STATES) of the tries of `rows`."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = held[0].column("part")[0].as_py()
        paths = [p for b in held for p in b.column("path").to_pylist()]
        counts = [n for b in held for n in b.column("n").to_pylist()]
        begins = [_first_edit(p) for p in paths]
        columns: list[list] = [[] for _ in names]
        for node, end in branching(paths, *shared[part], least):
            if len(node.edges) < 2 and not node.forced:
                continue
            edges = _marked(node, paths)
            name = _name(paths[node.first][:node.depth])
            if schema == EDGES:
                for code, k, child, label, mask in edges:
                    below = None if child is None else _name(paths[k][:child.depth])
                    word = None if child is not None else paths[k][1:] if paths[k][0] == "f" else paths[k][:0:-1]
                    for column, value in zip(columns, (name, code, label, len(label), below, word, None if child is not None else counts[k], mask)):
                        column.append(value)
            else:
                for k in range(node.first, end):
                    if begins[k] <= node.depth:
                        for column, value in zip(columns, (paths[k] + END, counts[k], node.depth, name)):
                            column.append(value)
            if len(columns[0]) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
                columns = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    of = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    names, kinds = zip(*[(c.split()[0], of[c.split()[1]]) for c in schema.split(", ")])
    names = list(names)
    return rows.mapInArrow(walk, schema)


def _letter(path: Column, at: Column) -> Column:
    """Code of a path's letter, 0 for its end and beyond."""
    letter = F.substring(path, at + 1, F.lit(1))
    return F.when(letter.isin(END, ""), 0).otherwise(F.ascii(letter))


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (code % 64).cast("int"))


def _has(mask: Column, bit: Column) -> Column:
    return mask.bitwiseAND(bit) != 0


def _follows(path: str, at: Column) -> Column:
    """Behind the label, if the letters of `path` from `at` on are those of the label, else null."""
    return F.when(F.substring(path, at + 1, F.col("size")) == F.col("label"), at + F.col("size"))


def _edited(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States that replace or delete a letter at their node, by its edges other than their own.

    A letter is replaced by later ones only: of two words that differ so, one finds the other.  Of two
    words that differ by a letter more, the longer finds the shorter.  The join's condition is on integers."""
    own, nxt = _letter(F.col("path"), F.col("at")), _letter(F.col("path"), F.col("at") + 1)
    s = states.filter(F.col("at") < F.length("path") - 1).select(
        "path", "n", "at", F.col("node").alias("here"), own.alias("own"), nxt.alias("next"), _bit(nxt).alias("next_bit"),
        _bit(_letter(F.col("path"), F.col("at") + 2)).alias("then_bit"))
    replaced = (F.col("code") > F.col("own")) & _has(F.col("mask"), F.col("next_bit"))
    deleted = (F.col("code") == F.col("next")) & (F.col("code") != F.col("own"))
    met = s.join(edges, (F.col("here") == F.col("node")) & (replaced | deleted))
    one, at = F.col("size") == 1, F.col("at")
    rest = F.substring("label", F.lit(2), F.col("size"))
    matched = F.when(one | (F.substring("path", at + 2, F.col("size") - 1) == rest), at + F.col("size"))
    through = F.when(replaced, matched)
    around = F.when(deleted, F.when(one & F.col("child").isNotNull(), F.when(_has(F.col("mask"), F.col("then_bit")), at + 2)).otherwise(_follows("path", at + 1)))
    return met.select("path", "n", F.explode(F.array_compact(F.array(through, around))).alias("at"), F.col("child").alias("node"), "target", "target_n")


def _followed(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States after the next edge of their own letters."""
    s = states.select("path", "n", F.col("at").alias("from"), F.col("node").alias("here"), _letter(F.col("path"), F.col("at")).alias("wanted"))
    met = s.join(edges, (F.col("here") == F.col("node")) & (F.col("wanted") == F.col("code")))
    one = (F.col("size") == 1) & F.col("child").isNotNull()
    to = F.when(one, F.when(_has(F.col("mask"), _bit(_letter(F.col("path"), F.col("from") + 1))), F.col("from") + 1)).otherwise(_follows("path", F.col("from")))
    return met.select("path", "n", to.alias("at"), F.col("child").alias("node"), "target", "target_n").filter("at is not null")


def neighbours(words: DataFrame, least: int = 7) -> DataFrame:
    """(word, near, near_n): all pairs of different words one inserted, deleted or replaced letter apart, both ways.

    `words` is (word, n) with distinct words of at least `least` letters.  There are as many rounds as
    branching nodes on a path; a round joins on the node, of which none has more edges than there are letters."""
    rows, shared = _sorted_paths(words)
    shallowest = 1 + least // 2
    edges = cut(_trie(rows, shared, shallowest, EDGES))
    states = cut(_edited(_trie(rows, shared, shallowest, STATES), edges))
    found = []
    while True:
        found.append(states.filter("target is not null").select("path", "n", "target", "target_n"))
        rest = states.filter("target is null")
        if rest.isEmpty():
            break
        states = cut(_followed(rest, edges))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    letters = F.substring("path", F.lit(2), F.length("path") - 2)
    word = F.when(F.substring("path", 1, 1) == "r", F.reverse(letters)).otherwise(letters)
    pairs = every.select(word.alias("word"), "n", "target", "target_n")
    ways = F.array(*[F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(c).alias("near_n")) for a, b, c in (("word", "target", "target_n"), ("target", "word", "n"))])
    return pairs.select(F.explode(ways).alias("w")).select("w.*").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


# -- forms -----------------------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): where following forms ends.  Each round doubles the way."""
    way = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        longer = cut(way.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        way = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return way


def variants(docs: DataFrame, least: int = 7, often: int = 2, times: int = 10, misspelt: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of `docs` (doc_id, text) that occurs `often`.

    A word's form is its near word of largest n (ties: first in code-point order) if that is at least
    `times` its own; its root is where forms end, itself without one.  Null and empty texts have no words;
    repeated rows count again; a null doc_id counts as empty in the hash that misspells.  Very long runs are
    words like others.  An empty table gives no rows; other columns are not read."""
    words = cut(occurrences(docs, least, misspelt).filter(F.col("n") >= often))
    best = neighbours(words, least).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    fits = -F.col("best.n") >= times * F.col("n")
    full = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")))
    ends = roots(full.filter("form is not null").select("word", "form"))
    return full.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_BYTES = ("list_concat([ascii(c)::ubigint for c in regexp_extract_all(coalesce(doc_id::varchar, '') || ':', '.')], "
          "flatten([case when unicode(c) < 128 then [unicode(c)::ubigint] else [195::ubigint, (unicode(c) - 64)::ubigint] end for c in regexp_extract_all(run, '.')]))")

SQL = f"""
with recursive {CRC_TABLE},
runs as (
  select doc_id, run, count(*) k from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents)
  where length(run) >= 7 group by all),
hashed as (select run, k, {crc_sql(_BYTES)} h from runs, crc),
spelt as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end word, k from hashed),
words as (select word, sum(k)::bigint n from spelt where length(word) >= 7 group by word having sum(k) >= 2),
gaps as (select word, i, substr(word, 1, i) || substr(word, i + 2) rest from (select word, unnest(range(length(word))) i from words)),
near as (
  select a.word, b.word near from gaps a join gaps b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select g.word, w.word from gaps g join words w on w.word = g.rest
  union select w.word, g.word from gaps g join words w on w.word = g.rest),
best as (
  select near.word, count(*) n_near, first(near order by n desc, near) form, max(n) form_n from near join words w on w.word = near.near group by near.word),
formed as (
  select words.word, words.n, coalesce(n_near, 0)::bigint n_near, case when b.form_n >= 10 * words.n then form end form,
         case when b.form_n >= 10 * words.n then b.form_n end::bigint form_n
  from words left join best b on b.word = words.word),
follow(word, now) as (select word, word from formed union all select f.word, g.form from follow f join formed g on g.word = f.now where g.form is not null),
ends as (select word, now as root from follow f where not exists (select 1 from formed g where g.word = f.now and g.form is not null))
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""
