"""Merkle manifest of a dataset: an append log of nodes in postorder, and inclusion proofs read from it.

Every row is a leaf; leaves of one tree are numbered in order, and aligned builders take 8**LEVELS
consecutive ones.  A builder appends a node as soon as its last child is there, so its log is in postorder,
and the place of any node follows from the sizes of the subtrees before it.  The tops of the builders are
the leaves of the next tier, until a tree has one top, its subroot; the subroots are the leaves of one more
tree, whose top is the root.  A proof needs no search: the places of the siblings are computed.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from symtrail.operators.keyed import lookup
from symtrail.session import cut

#: Children of a node, and levels that one builder completes (a builder holds 8**4 = 4,096 leaves).
FAN, LEVELS = 8, 4

STEPS = "array<struct<left:string,right:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# -- one builder -----------------------------------------------------------------------------------------

def height_of(n: int, levels: int, alone: bool) -> int:
    """Levels above `n` leaves of a builder: all of its levels, or if it is `alone` as many as leave one node."""
    if not alone:
        return levels
    height = 0
    while FAN ** height < n:
        height += 1
    return height


def place(level: int, index: np.ndarray, n: int, height: int) -> np.ndarray:
    """Where the log of `n` leaves holds the nodes `index` of `level`: the number of nodes completed before.

    A node whose last leaf is the `until`-th comes after all nodes that end by then on its level and below,
    and after those on higher levels that end earlier."""
    until = np.minimum((index + 1) * FAN ** level, n)
    below = sum(-(-until // FAN ** k) for k in range(level + 1))
    above = sum((until - 1) // FAN ** k for k in range(level + 1, height + 1))
    return below + above - 1


def completed(leaves: list[str], height: int) -> list[str]:
    """The log of a builder: its leaves and the nodes above them, each as soon as its last child is there."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(height + 1)]
    for k, leaf in enumerate(leaves, 1):
        log.append(leaf)
        open_[0].append(leaf)
        for level in range(height):
            if len(open_[level]) < FAN and k < len(leaves):
                break
            node = sha256("".join(open_[level]).encode()).hexdigest()
            open_[level] = []
            open_[level + 1].append(node)
            log.append(node)
    return log


def steps_of(log: bytes, n: int, height: int, rows: np.ndarray, upper: list[dict]) -> pa.Array:
    """For the leaves `rows` of a builder: what stands left and right of their path, level by level, then `upper`."""
    nodes = [log[k:k + 32].hex() for k in range(0, len(log), 32)]
    levels = []
    for level in range(height):
        at = place(level, np.arange(-(-n // FAN ** level)), n, height)
        runs = ["".join(nodes[p] for p in at[k:k + FAN]) for k in range(0, len(at), FAN)]
        levels.append([(runs[i // FAN][:64 * (i % FAN)], runs[i // FAN][64 * (i % FAN + 1):]) for i in range(len(at))])
    above = [(s["left"], s["right"]) for s in upper]
    found = [[*(levels[k][r // FAN ** k] for k in range(height)), *above] for r in rows.tolist()]
    flat = [s for one in found for s in one]
    pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (height + len(above)), pa.int32()), pairs)


# -- trees -----------------------------------------------------------------------------------------------

def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with `rank` (from 0, along `order`) and `n` within their `tree`.

    Rows are dealt out by range and sorted there; only a count per tree and range is carried across."""
    parts = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = cut(parts.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    tree = W.partitionBy("tree")
    ahead = F.sum("here").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("tree", "part", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    return lookup(rows, cut(starts), ["tree", "part"], "inner").withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _built(nodes: DataFrame, levels: int) -> DataFrame:
    """A row per builder of `nodes` (tree, rank, n, digest): (tree, block, n, size, height, log, top)."""
    capacity = FAN ** levels

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        n, size = rows["n"][0].as_py(), rows.num_rows
        height = height_of(size, levels, n <= capacity)
        log = completed(rows["digest"].to_pylist(), height)
        return pa.table({
            "tree": rows["tree"].slice(0, 1), "block": rows["block"].slice(0, 1), "n": pa.array([n], pa.int64()), "size": pa.array([size], pa.int32()),
            "height": pa.array([height], pa.int32()), "log": pa.array([bytes.fromhex("".join(log))], pa.binary()), "top": [log[-1]]})

    blocks = nodes.select("tree", F.floor(F.col("rank") / capacity).alias("block"), "rank", "n", "digest")
    return blocks.groupBy("tree", "block").applyInArrow(build, "tree string, block long, n long, size int, height int, log binary, top string")


def append_log(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The log of `nodes` (tree, rank, n, digest), a table per tier with a row per builder.

    Each tier has 8**levels times fewer rows than the one below; trees of one top are complete."""
    capacity = FAN ** levels
    tiers = [cut(_built(nodes, levels))]
    while True:
        rest = tiers[-1].filter(F.col("n") > capacity)
        if rest.isEmpty():
            return tiers
        tops = rest.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / capacity).alias("n"), F.col("top").alias("digest"))
        tiers.append(cut(_built(tops, levels)))


def tops(tiers: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, top) of every tree."""
    done = [t.filter(F.col("n") <= FAN ** levels).select("tree", "top") for t in tiers]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _extracted(items: DataFrame, log: DataFrame, levels: int) -> DataFrame:
    """`items` (tree, rank, ...) with `steps`, from the row of `log` (with `upper`) that holds them."""
    capacity = FAN ** levels

    def extract(rows: pa.Table, found: pa.Table) -> pa.Table:
        (n,), (height,), (log,), (upper,) = (found[c].to_pylist() for c in ("size", "height", "log", "upper"))
        steps = steps_of(log, n, height, rows["rank"].to_numpy() % capacity, upper)
        return rows.append_column("steps", steps)

    keyed = items.withColumn("block", F.floor(F.col("rank") / capacity))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    held = log.select("tree", "block", "size", "height", "log", "upper")
    return keyed.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInArrow(extract, f"{shape}, steps {STEPS}").drop("block")


def proofs(items: DataFrame, tiers: list[DataFrame], above: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """`items` (tree, rank, ...), leaves of the log, with `steps` up to the top of their tree and on through
    those of `above` (tree, steps).

    The tiers are walked from the top: a builder inherits the steps of its own top, one row per builder."""
    none = F.array().cast(STEPS)
    inherited = None
    for k in range(len(tiers) - 1, -1, -1):
        last = tiers[k].filter(F.col("n") <= FAN ** levels)
        last = last.withColumn("upper", none) if above is None else lookup(last, above.select("tree", F.col("steps").alias("upper")), ["tree"], "inner")
        log = last
        if inherited is not None:
            log = last.unionByName(tiers[k].join(inherited, ["tree", "block"]))
        if k == 0:
            return _extracted(items, log, levels)
        below = tiers[k - 1].filter(F.col("n") > FAN ** levels).select("tree", F.col("block").alias("rank"))
        inherited = cut(_extracted(below, log, levels).select("tree", F.col("rank").alias("block"), F.col("steps").alias("upper")))


# -- documents -------------------------------------------------------------------------------------------

def field(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, now: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, steps[, now]), one row per row of `docs` (doc_id, text, lang, source, n_chars).

    Leaves of a `lang` ascend by doc_id, null first, and by leaf where ids are equal, so repeated rows
    are leaves of their own.  A null lang is a tree of its own, before all others.  `steps` has, from the
    leaf's level up, the digests left and right of the path as one text each (empty where nothing stands
    there), so `folded(leaf, steps)` is the root.  `now` is a second leaf of each row, as a reader would
    compute it today; it is carried along.  An empty table gives no rows; other columns are not read.
    Texts are hashed where they are read; only digests travel."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    kept = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", "lang", leaf(*columns).alias("leaf"),
        *([] if now is None else [now.alias("now")]))
    leaves = cut(ranked(cut(kept), ["doc_id", "leaf"]))
    log = append_log(leaves.select("tree", "rank", "n", F.col("leaf").alias("digest")), levels)
    subroots = cut(ranked(tops(log, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")), ["name"]))
    high = append_log(subroots, levels)
    root = tops(high, levels).first()
    above = cut(proofs(subroots.select("tree", "rank", "name", "digest"), high, None, levels).select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "steps"))
    found = proofs(leaves.drop("n"), log, above, levels)
    return lookup(found, above.select("tree", "subroot"), ["tree"], "inner").withColumn("root", F.lit(root and root["top"])).drop("tree", "rank")


def verified(docs: DataFrame, tampered: Column, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of `docs`, held against
    documents in which the A-Z of those that are `tampered` were lower-cased since.

    Digests are of the untampered documents; `folded_root` is what the leaf of a document as it is now and
    its stored siblings give.  A tampered text that is null or has no A-Z is unchanged, so it verifies.  A
    null in `tampered` means false.  Nulls, ties, repeated rows and empty tables: see `manifest`."""
    lowered = F.translate(F.col("text"), UPPER, UPPER.lower())
    now = F.when(tampered, leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered))
    found = manifest(docs, now, levels)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("now", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 as DuckDB can state it: a table by the polynomial, and a fold over the bytes of ASCII text.
CRC_TABLE = """crc as (
  select list(x order by k) t from (
    select k, list_reduce(list_concat([k::ubigint], range(8)::ubigint[]),
                          lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) x
    from range(256) r(k)))"""


def crc_sql(bytes_: str) -> str:
    """crc32 of a list of byte values, given the table `t` of CRC_TABLE."""
    return (f"xor(list_reduce(list_concat([4294967295::ubigint], {bytes_}), "
            "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::bigint + 1])), 4294967295::ubigint)")


_PARTS = "||".join(f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_LEAF = "sha256(" + _PARTS + "||coalesce(octet_length(encode({text}))::varchar || ':' || {text}, '-'))"
_LOWER = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
_DIGITS = "[ascii(c)::ubigint for c in regexp_extract_all(doc_id::varchar, '.')]"
_UP = """
  select tree, lvl + 1, r // 8, sha256(string_agg(h, '' order by r)) from (select *, count(*) over (partition by tree) c from {name}) where c > 1
  group by tree, lvl, r // 8"""
_FOLD = """
  select id, f.tree, f.lvl + 1, f.r // 8, sha256(array_to_string(hs[:f.r % 8], '') || cur || array_to_string(hs[f.r % 8 + 2:], '')),
         proof || array_to_string(hs[:f.r % 8], '') || array_to_string(hs[f.r % 8 + 2:], '')
  from {name} f join {runs} u on u.tree = f.tree and u.lvl = f.lvl and u.run = f.r // 8 where u.tall"""

SQL = f"""
with recursive {CRC_TABLE},
leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 r, row_number() over () id from (
    select doc_id, coalesce('=' || lang, '') tree, {_LEAF.format(text='text')} leaf,
           case when doc_id is not null and {crc_sql(_DIGITS)} % 3 = 0 then {_LEAF.format(text=_LOWER)} else {_LEAF.format(text='text')} end seen
    from documents, crc)),
up(tree, lvl, r, h) as (select tree, 0, r, leaf from leaves union all {_UP.format(name='up')}),
heights as (select tree, max(lvl) top from up group by tree),
runs as (select tree, lvl, r // 8 run, list(h order by r) hs, lvl < top tall from up join heights using (tree) group by all),
subroots as (select tree, h, row_number() over (order by tree) - 1 r from up join heights using (tree) where lvl = top),
high(tree, lvl, r, h) as (select '', 0, r, h from subroots union all {_UP.format(name='high')}),
high_runs as (select tree, lvl, r // 8 run, list(h order by r) hs, lvl < (select max(lvl) from high) tall from high group by all),
one(id, tree, lvl, r, cur, proof) as (select id, tree, 0, r, seen, '' from leaves union all {_FOLD.format(name='one', runs='runs')}),
two(id, tree, lvl, r, cur, proof) as (
  select o.id, '', 0, s.r, o.cur, o.proof from one o join heights g on o.tree = g.tree and o.lvl = g.top join subroots s on s.tree = o.tree
  union all {_FOLD.format(name='two', runs='high_runs')}),
roots as (select h root, lvl top from high order by lvl desc limit 1)
select l.doc_id, l.leaf, s.h subroot, root, sha256(w.proof) proof_sha256, w.cur folded_root, w.cur = root verified
from leaves l join subroots s on s.tree = l.tree join two w on w.id = l.id join roots on w.lvl = roots.top
"""
