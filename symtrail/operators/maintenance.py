"""Incremental maintenance: snapshots, moves, epoch-stamped merges, orphan and stale-edge removal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from symtrail.operators.keyed import as_of, lookup, numbered, range_buckets
from symtrail.session import cut

#: Moves handled by one task of a path's history.
HISTORY_BUCKET = 4096


# -- snapshots ---------------------------------------------------------------------------------

def reconcile_diff(tree: DataFrame, known: DataFrame, reparse_all: bool = False) -> DataFrame:
    """`repo_id, rel_path, change` (added, modified, deleted) between a tree and what is stored."""
    key = ["repo_id", "rel_path"]
    both = tree.select(*key, F.col("content_hash").alias("now")).join(
        known.select(*key, F.col("content_hash").alias("was")), key, "full_outer")
    differs = F.lit(True) if reparse_all else F.col("now") != F.col("was")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(differs, "modified")
    return both.select(*key, change.alias("change")).filter("change is not null")


def poll_diff(before: DataFrame, after: DataFrame, known: DataFrame) -> DataFrame:
    """`repo_id, rel_path, change` from two stat snapshots: saved (stat differs or newly allowed) or removed.

    Snapshots carry `repo_id, rel_path, mtime_ns, size, allowed, content_hash`; a touched file whose
    content hash is already stored in `known(repo_id, rel_path, content_hash)` is no change."""
    key = ["repo_id", "rel_path"]
    a = before.select(*key, F.struct("mtime_ns", "size").alias("was"), F.col("allowed").alias("was_allowed"))
    b = after.select(*key, F.struct("mtime_ns", "size").alias("now"), F.col("allowed").alias("now_allowed"), "content_hash")
    both = a.join(b, key, "full_outer").join(
        known.select(*key, F.col("content_hash").alias("stored")), key, "left")
    was, now = F.coalesce("was_allowed", F.lit(False)), F.coalesce("now_allowed", F.lit(False))
    moved = ~F.col("was").eqNullSafe(F.col("now"))
    saved = now & (moved | ~was) & ~F.col("content_hash").eqNullSafe(F.col("stored"))
    change = F.when(was & ~now, "removed").when(saved, "saved")
    return both.select(*key, change.alias("change")).filter("change is not null")


# -- moves -----------------------------------------------------------------------------------------

def collapse_chains(moves: DataFrame) -> DataFrame:
    """`repo_id, old_path, new_path` of what each repository's moves, ordered by `seq`, amount to.

    A move continues the move that last put a file at its old path, unless another move took that
    file away since.  Predecessors come from one as-of join per path; chain ends from pointer
    doubling, so a chain of n moves needs log2(n) joins.  Round trips vanish."""
    touches = moves.select("repo_id", F.col("old_path").alias("path"), (F.col("seq") * 2).alias("at"), F.lit(None).cast("bigint").alias("by"))\
        .unionByName(moves.select("repo_id", F.col("new_path").alias("path"), (F.col("seq") * 2 + 1).alias("at"), F.col("seq").alias("by")))
    bucket = lambda c: F.floor(c / (2 * HISTORY_BUCKET))
    linked = as_of(moves.withColumn("path", F.col("old_path")).withColumn("_at", F.col("seq") * 2), touches, ["repo_id", "path"], "_at",
                   "at", ["by"], bucket, strict=True).select("repo_id", "seq", "old_path", "new_path", F.col("by").alias("prev"))
    state = cut(linked.select("repo_id", "seq", "old_path", "new_path", "prev", F.col("old_path").alias("origin")))
    while not state.filter("prev is not null").isEmpty():
        ahead = state.select("repo_id", F.col("seq").alias("prev"), F.col("prev").alias("_prev"), F.col("origin").alias("_origin"))
        state = cut(state.join(ahead, ["repo_id", "prev"], "left").select(
            "repo_id", "seq", "old_path", "new_path", F.col("_prev").alias("prev"), F.coalesce("_origin", "origin").alias("origin")))
    last = touches.groupBy("repo_id", "path").agg(F.max_by(F.struct("by"), "at").alias("t")).select("repo_id", F.col("t.by").alias("seq")).filter("seq is not null")
    return state.join(last, ["repo_id", "seq"], "left_semi").filter("origin <> new_path").select("repo_id", F.col("origin").alias("old_path"), "new_path")


def undetected_moves(deleted: DataFrame, added: DataFrame) -> DataFrame:
    """`old_path, new_path` pairs: each deleted path, in order, takes the first free added path that
    shares an identity.  Inputs are `rel_path, identity` rows.

    Identities are never paired with each other.  Each round every identity offers its least free new
    path and its least waiting old path (two minima); a pair that is best for both sides is what the
    ordered greedy would choose, so it is final.  Paths whose shared identities belong to the same
    single group on both sides are matched by rank at once, which settles large groups of copies.  An identity
    that lies inside another (equal texts, which also have equal lengths) pairs nothing new and is left out first."""
    old = deleted.select(F.col("rel_path").alias("old"), "identity").distinct()
    new = added.select(F.col("rel_path").alias("new"), "identity").distinct()
    shared = old.select("identity").distinct().join(new.select("identity").distinct(), "identity", "left_semi")
    old, new = cut(old.join(shared, "identity", "left_semi")), cut(new.join(shared, "identity", "left_semi"))
    inside = cut(_inside_another(old, new))
    old, new = old.join(inside, "identity", "left_anti"), new.join(inside, "identity", "left_anti")

    def lone(df, side):
        """Identities all of whose paths have no other shared identity."""
        width = df.groupBy(side).agg(F.count(F.lit(1)).alias("w"))
        return df.join(width, side).groupBy("identity").agg(F.max("w").alias("w")).filter("w = 1").select("identity")

    pure = lone(old, "old").join(lone(new, "new"), "identity", "left_semi")
    firsts = _ranked(old.join(pure, "identity", "left_semi"), "old")
    seconds = _ranked(new.join(pure, "identity", "left_semi"), "new")
    pairs = firsts.join(seconds, ["identity", "n"]).select("old", "new")
    old, new = old.join(pure, "identity", "left_anti"), new.join(pure, "identity", "left_anti")
    pairs, old, new = cut(pairs), cut(old), cut(new)
    while not old.isEmpty() and not new.isEmpty():
        offers = new.groupBy("identity").agg(F.min("new").alias("best_new"))
        calls = old.groupBy("identity").agg(F.min("old").alias("best_old"))
        wants = old.join(offers, "identity").groupBy("old").agg(F.min("best_new").alias("new"))
        takes = new.join(calls, "identity").groupBy("new").agg(F.min("best_old").alias("old"))
        both = cut(wants.join(takes, ["old", "new"], "left_semi"))
        if both.isEmpty():
            break
        pairs = pairs.unionByName(both)
        old = cut(old.join(both.select("old"), "old", "left_anti"))
        new = cut(new.join(both.select("new"), "new", "left_anti"))
    return pairs.select(F.col("old").alias("old_path"), F.col("new").alias("new_path"))


def _inside_another(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identities whose paths all hold one other, wider identity: what they pair, that one pairs too.

    Of a path only its most widely held identity is looked at, so a path of many identities is as many rows."""
    both = old.select(F.concat(F.lit("o"), "old").alias("at"), "identity").unionByName(
        new.select(F.concat(F.lit("n"), "new").alias("at"), "identity"))
    held = lookup(both, both.groupBy("identity").agg(F.count(F.lit(1)).alias("n")), ["identity"], "inner")
    widest = held.groupBy("at").agg(F.max(F.struct("n", "identity"))["identity"].alias("wide"))
    per = both.join(widest, "at").groupBy("identity").agg(F.min("wide").alias("a"), F.max("wide").alias("b"))
    return per.filter((F.col("a") == F.col("b")) & (F.col("a") != F.col("identity"))).select("identity")


def _ranked(df: DataFrame, side: str) -> DataFrame:
    """Rank within an identity in path order; copies of one file are spread over range buckets."""
    ranged = range_buckets(df, "identity", side)
    return numbered(ranged, ["identity"], F.col("bucket"), [F.col(side)], "n").select("identity", side, "n")


def remaps(moves: DataFrame, as_old: DataFrame, as_new: DataFrame) -> DataFrame:
    """`repo_id, old_uid, new_uid, old_path, new_path` from two parses of the same bytes, paired by position.

    Moves are `repo_id, old_path, new_path`; both parses carry `repo_id, rel_path, seq, uid, kind, arity, ordinal, name`; a pair that differs in
    anything but a module's name is dropped, and so is a file whose parses differ in length."""
    each = W.partitionBy("repo_id", "rel_path")
    cols = ["seq", "uid", "kind", "arity", "ordinal", "name", "_n"]
    side = lambda df, path, p: df.withColumn("_n", F.count(F.lit(1)).over(each)).select(
        "repo_id", F.col("rel_path").alias(path), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    old, new = side(as_old, "old_path", "o"), side(as_new, "new_path", "n")
    # Sorted and merged: sizes that are guessed from the scanned columns would have the moves gathered by the driver.
    both = moves.hint("merge").join(old.hint("merge"), ["repo_id", "old_path"]).hint("merge").join(
        new.withColumnRenamed("n_seq", "o_seq").hint("merge"), ["repo_id", "new_path", "o_seq"])
    same = (F.col("o__n") == F.col("n__n"))
    for c in ("kind", "arity", "ordinal"):
        same = same & (F.col(f"o_{c}") == F.col(f"n_{c}"))
    same = same & ((F.col("o_kind") == "module") | (F.col("o_name") == F.col("n_name")))
    return both.filter(same).select("repo_id", F.col("o_uid").alias("old_uid"), F.col("n_uid").alias("new_uid"), "old_path", "new_path")


@dataclass
class Graph:
    """The three stored tables of a repository set."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


def apply_remaps(graph: Graph, mapping: DataFrame, epoch: int) -> Graph:
    """Rewrite uids in place, so edges from unchanged files survive a move.

    A uid that already exists is not overwritten; a file row moves unless its new path exists."""
    taken = graph.symbols.select(F.col("uid").alias("new_uid"))
    use = mapping.join(taken, "new_uid", "left_anti").select(F.col("old_uid").alias("uid"), "new_uid", "old_path", "new_path")
    use = cut(use.join(graph.symbols.select("uid"), "uid", "left_semi"))
    moved = F.col("new_uid").isNotNull()
    names = [c for c in graph.symbols.columns]
    fresh = {"uid": "new_uid", "rel_path": "new_path", "origin_path": "new_path"}
    symbols = lookup(graph.symbols, use, ["uid"]).select(*[
        F.when(moved, F.col(fresh[c])).otherwise(F.col(c)).alias(c) if c in fresh
        else F.when(moved, F.lit(epoch)).otherwise(F.col(c)).alias(c) if c == "epoch" else F.col(c) for c in names])
    ends = use.select("uid", "new_uid")
    edges = lookup(graph.edges, ends.toDF("src", "_src"), ["src"])
    edges = lookup(edges, ends.toDF("tgt", "_tgt"), ["tgt"])
    paths = mapping.select(F.col("new_uid").alias("_from"), F.col("old_path").alias("_old"), F.col("new_path").alias("_new")).distinct()
    edges = lookup(edges.withColumn("_from", F.coalesce("_src", "src")), paths, ["_from"])
    repoint = F.col("origin_path") == F.col("_old")
    edges = edges.select(
        "repo_id", F.coalesce("_src", "src").alias("src"), F.coalesce("_tgt", "tgt").alias("tgt"), "kind",
        F.when(repoint, F.col("_new")).otherwise(F.col("origin_path")).alias("origin_path"),
        F.when(repoint, F.lit(epoch)).otherwise(F.col("epoch")).alias("epoch"))
    renames = mapping.select("repo_id", F.col("old_path").alias("rel_path"), "new_path").distinct()
    free = renames.join(graph.files.select("repo_id", F.col("rel_path").alias("new_path")), ["repo_id", "new_path"], "left_anti")
    files = graph.files.join(free, ["repo_id", "rel_path"], "left").withColumn(
        "epoch", F.when(F.col("new_path").isNotNull(), F.lit(epoch)).otherwise(F.col("epoch"))).withColumn(
            "rel_path", F.coalesce("new_path", "rel_path")).select(*graph.files.columns)
    return Graph(files, symbols, edges)


# -- merges -------------------------------------------------------------------------------------------

def upsert(old: DataFrame, new: DataFrame, key: list[str], created: bool = False, epoch: int = 0) -> DataFrame:
    """Merge by key: a null in the new row keeps the old value; `created_epoch` is set only once."""
    columns = old.columns
    fresh = new.select(*key, F.lit(True).alias("_in"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in key])
    both = old.withColumn("_had", F.lit(True)).join(fresh, key, "full_outer")

    def value(c):
        if c in key:
            return F.col(c)
        if created and c == "created_epoch":
            return F.when(F.col("_had").isNull(), F.lit(epoch)).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c)

    return both.select(*[value(c) for c in columns])


def upsert_edges(old: DataFrame, new: DataFrame, symbols: DataFrame, epoch: int) -> DataFrame:
    """Merge edges by (src, kind, origin_path, tgt); both ends must exist."""
    ids = symbols.select("uid")
    key = ["src", "kind", "origin_path", "tgt"]
    good = new.dropDuplicates(key).join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("uid", "tgt"), "tgt", "left_semi")
    rest = old.join(good.select(*key), key, "left_anti")
    return rest.select(*old.columns).unionByName(good.withColumn("epoch", F.lit(epoch).cast("bigint")).select(*old.columns))


def without_stale_edges(edges: DataFrame, symbols: DataFrame, paths: DataFrame, epoch: int) -> DataFrame:
    """Drop older edges whose source sits at a batch path (paths: `repo_id, rel_path`)."""
    own = symbols.filter(F.col("epoch") <= epoch).join(
        paths.select("repo_id", F.col("rel_path").alias("origin_path")), ["repo_id", "origin_path"], "left_semi")
    stale = edges.filter(F.col("epoch") < epoch)
    gone = stale.join(own.select(F.col("uid").alias("src")), "src", "left_semi").select("src", "kind", "origin_path", "tgt")
    return edges.join(gone, ["src", "kind", "origin_path", "tgt"], "left_anti").select(*edges.columns)


def orphans(symbols: DataFrame, paths: DataFrame, epoch: int) -> DataFrame:
    """Symbols at batch paths that the batch did not write."""
    at = paths.select("repo_id", F.col("rel_path").alias("origin_path"))
    return symbols.filter(F.col("epoch") < epoch).join(at, ["repo_id", "origin_path"], "left_semi")


def without_orphans(graph: Graph, paths: DataFrame, epoch: int) -> Graph:
    dead = orphans(graph.symbols, paths, epoch).select("uid")
    edges = graph.edges.join(dead.withColumnRenamed("uid", "src"), "src", "left_anti").join(
        dead.withColumnRenamed("uid", "tgt"), "tgt", "left_anti").select(*graph.edges.columns)
    gone = graph.files.filter(F.col("epoch") < epoch).join(paths.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_semi")
    files = graph.files.join(gone.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_anti").select(*graph.files.columns)
    return Graph(files, graph.symbols.join(dead, "uid", "left_anti").select(*graph.symbols.columns), edges)


def outside_callers(graph: Graph, paths: DataFrame, epoch: int) -> DataFrame:
    """Paths outside the batch with an edge into one of its orphans: they must be linked again."""
    dead = orphans(graph.symbols, paths, epoch).select(F.col("uid").alias("tgt"))
    into = lookup(graph.edges.select("src", "tgt"), dead, ["tgt"], "inner").select(F.col("src").alias("uid")).distinct()
    callers = graph.symbols.join(into, "uid", "left_semi").select("repo_id", F.col("origin_path").alias("rel_path")).distinct()
    return callers.join(paths.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_anti")


# -- embedding cache --------------------------------------------------------------------------------------

def cache_split(symbols: DataFrame, cache: DataFrame, model: str, stored: DataFrame | None = None) -> DataFrame:
    """Adds `hit` and `header_only` (a miss whose stored body hash is unchanged) and the `vector`."""
    own = cache.filter(F.col("model") == model).select("cache_key", F.col("vector").alias("_v"))
    out = lookup(symbols, own, ["cache_key"])
    out = out.withColumn("hit", F.col("_v").isNotNull()).withColumnRenamed("_v", "vector")
    if stored is None:
        return out.withColumn("header_only", F.lit(False))
    was = stored.select("uid", F.col("body_hash").alias("_was"))
    return out.join(was, "uid", "left").withColumn(
        "header_only", ~F.col("hit") & F.coalesce(F.col("_was") == F.col("body_hash"), F.lit(False))).drop("_was")
