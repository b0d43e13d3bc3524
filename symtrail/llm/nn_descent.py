"""Embedding near-dedup by NN-descent.

1. Equal vectors are one node.  A first neighbour graph comes from sorted random projections: nodes in a
   row form small blocks, and each keeps its best neighbours in its block, over several projections.
2. NN-descent.  The neighbours of a node (forwards and backwards) are compared with each other wherever one
   of them is new, and every node keeps its best; rounds end when few neighbours are new.
3. Links are counted block by block within the components of threshold edges.  A node with as many of them as
   a list holds is saturated: it may have links that no list holds, also out of its component.  It is compared
   with every vector of its label, which may join components; that ends when no saturated node is left.
4. An audit compares the links of sampled nodes with brute force over all vectors, sampled apart for nodes
   without links, in small and in large components.  While the mean recall of a node with few or with many
   links is too low, a further graph starts from other projections; after the last of them every node that
   was not yet is compared with its whole label, which leaves nothing out.

Vectors are compared only within one label (and one length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from symtrail.llm.components import components
from symtrail.session import cut

THRESHOLD = 0.98

#: Neighbours that a node keeps, nodes of a first block, and the least projections of one start.
NEIGHBOURS, BLOCK, PROJECTIONS = 6, 64, 6

#: Share of the pairs at the threshold that the projections of one start may all part.
PARTED = 0.001

#: Neighbours that are compared with each other at once; a longer list (of a hub) is compared in parts.
LIST = 32

#: Rounds of descent at most, and the share of new neighbours below which they end.
ROUNDS, STILL_NEW = 3, 0.02

#: Vectors of a block when components are counted.
COUNT_BLOCK = 1_024

#: Vectors of a block when saturated nodes are compared with all, and rows of it that are compared at once.
SEARCH_BLOCK, SEARCH_ROWS = 4_096, 512

#: Nodes of each kind, about, whose links the audit counts by brute force, the recall asked for, and the starts before all is compared.
AUDITED, RECALL, STARTS = 2_048, 0.97, 3


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles, each divided by its length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows ** 2).sum(1, keepdims=True))


def _usable(vector: Column, label: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _projections(bits: int) -> int:
    """How many orders by the sides of `bits` planes leave a pair at the threshold in one place of one of them."""
    together = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return max(PROJECTIONS, int(np.ceil(np.log(PARTED) / np.log1p(-together))))


def _first_graph(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """(u, v, sim): the best neighbours of each node in its block of every projection's order."""
    bits = min(30, max(1, int(np.log2(max(2, n / BLOCK)))))
    projections = _projections(bits)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                vectors = _matrix(part.column("embedding"))
                for t in range(projections):
                    planes = np.random.default_rng((seed, t, size)).normal(size=(size, bits + 1))
                    sides = vectors @ planes
                    code = (sides[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), t, np.int32)), part.column("label"), part.column("size"), pa.array(code), pa.array(sides[:, bits]),
                         part.column("node"), part.column("embedding")],
                        ["table", "label", "size", "code", "side", "node", "embedding"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "group", "size")])
            borders = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(batch)]))
            nodes_of = batch.column("node").to_numpy()
            found = []
            for a, b in zip(borders.tolist(), borders[1:].tolist()):
                for s in range(a, b, BLOCK):
                    e = min(b, s + BLOCK)
                    if e - s < 2:
                        continue
                    vectors = _matrix(batch.column("embedding").slice(s, e - s))
                    sim = vectors @ vectors.T
                    np.fill_diagonal(sim, -2)
                    k = min(NEIGHBOURS, e - s - 1)
                    best = np.argpartition(-sim, k - 1, 1)[:, :k]
                    found.append((np.repeat(nodes_of[s:e], k), nodes_of[s:e][best].ravel(), np.take_along_axis(sim, best, 1).ravel()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v", "sim"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    rows = nodes.select("label", "size", "node", "embedding").mapInArrow(
        project, f"table int, label {label}, size int, code long, side double, node long, embedding {kind}")
    order = ["table", "group", "size", "code", "side"]
    placed = rows.withColumn("group", F.xxhash64("label"))
    parts = max(1, min(n * projections // (BLOCK * 64) + 1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(neighbours, "u long, v long, sim double")


def _best(edges: DataFrame) -> DataFrame:
    """(u, v, sim, fresh): the best neighbours of each node; a pair that was known is not fresh."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return cut(one.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS).drop("place"))


def _compared(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, sim): neighbours of neighbours that are better than the worst neighbour u has."""
    both = graph.select(F.col("u").alias("w"), F.col("v").alias("x"), "fresh").unionByName(
        graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "fresh")).groupBy("w", "x").agg(F.max("fresh").alias("fresh"))
    busy = both.groupBy("w").agg(F.max("fresh").alias("any")).filter("any").select("w")
    worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    known = nodes.select(F.col("node").alias("x"), "embedding").join(worst.select(F.col("u").alias("x"), "worst"), "x")
    rows = both.join(busy, "w").join(known, "x").select("w", "x", "fresh", "worst", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w").to_numpy()
            if len(w) == 0:
                continue
            x, worst = batch.column("x").to_numpy(), batch.column("worst").to_numpy()
            fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
            borders = np.concatenate(([0], np.flatnonzero(w[1:] != w[:-1]) + 1, [len(w)]))
            found = []
            for a, b in zip(borders.tolist(), borders[1:].tolist()):
                for s in range(a, b, LIST):
                    e = min(b, s + LIST)
                    if e - s < 2 or not fresh[s:e].any():
                        continue
                    vectors = _matrix(batch.column("embedding").slice(s, e - s))
                    sim = vectors @ vectors.T
                    better = (sim > worst[s:e, None]) & (fresh[s:e, None] | fresh[None, s:e])
                    np.fill_diagonal(better, False)
                    i, j = np.nonzero(better)
                    found.append((x[s:e][i], x[s:e][j], sim[i, j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["u", "v", "sim"])

    return rows.repartition("w").sortWithinPartitions("w", "x").mapInArrow(run, "u long, v long, sim double")


def neighbour_graph(nodes: DataFrame, n: int, seed: int, known: DataFrame | None = None) -> DataFrame:
    """(u, v, sim, fresh) after NN-descent from fresh projections and the edges of `known`."""
    start = _first_graph(nodes, n, seed).withColumn("fresh", F.lit(True))
    graph = _best(start if known is None else start.unionByName(known))
    for _ in range(ROUNDS):
        more = _compared(graph, nodes).withColumn("fresh", F.lit(True))
        graph = _best(graph.withColumn("fresh", F.lit(False)).unionByName(more))
        if graph.filter("fresh").count() <= STILL_NEW * n * NEIGHBOURS:
            break
    return graph


def _units(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """(key, its rows) of sorted batches, for each value of the key columns."""
    key, held = None, []
    for batch in batches:
        if len(batch) == 0:
            continue
        own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns])
        borders = np.concatenate(([0], np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1, [len(batch)]))
        for a, b in zip(borders.tolist(), borders[1:].tolist()):
            now = tuple(own[:, a].tolist())
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _counted(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, links, others): the links of each node within its component, counted block by block.

    A component of more than COUNT_BLOCK nodes is cut into blocks by hash, and each pair of blocks is a unit
    of work of its own; a link to a node counts once for each of its copies, and once in `others`."""
    sizes = joined.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(COUNT_BLOCK)).cast("int").alias("parts"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    pair = lambda x: F.struct(F.least(F.col("part"), x).alias("i"), F.greatest(F.col("part"), x).alias("j"))
    rows = (
        joined.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .select("node", "component", "part", F.explode(F.transform(others, pair)).alias("unit"))
        .join(nodes.select("node", "copies", "embedding"), "node")
        .select("component", "unit.i", "unit.j", "part", "node", "copies", "embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in _units(batches, ("component", "i", "j")):
            part = np.concatenate([h.column("part").to_numpy() for h in held])
            names = np.concatenate([h.column("node").to_numpy() for h in held])
            copies = np.concatenate([h.column("copies").to_numpy() for h in held])
            vectors = np.concatenate([_matrix(h.column("embedding")) for h in held])
            if i == j:
                near = vectors @ vectors.T >= THRESHOLD
                np.fill_diagonal(near, False)
                links, others = near @ copies, near.sum(1)
            else:
                left, right = part == i, part == j
                near = vectors[left] @ vectors[right].T >= THRESHOLD
                links, others = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                links[left], links[right] = near @ copies[right], near.T @ copies[left]
                others[left], others[right] = near.sum(1), near.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(links), pa.array(others)], ["node", "links", "others"])

    units = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "part", "node")
    return units.mapInArrow(run, "node long, links long, others long").groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))


def _across(nodes: DataFrame, joined: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b): components that a link of an `asked` node joins, after comparing it with every node of its label.

    Nodes and asked nodes of a label are cut into blocks by hash, and each pair of blocks is a unit of work."""
    placed = nodes.join(joined, "node", "left").select(
        F.xxhash64("label").alias("group"), "size", "node", F.coalesce("component", "node").alias("component"), "embedding")
    sought = placed.join(asked.select("node"), "node", "left_semi")
    parts = lambda rows, name: rows.groupBy("group", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(SEARCH_BLOCK)).cast("int").alias(name))
    sizes = parts(placed, "rows").join(parts(sought, "columns"), ["group", "size"])
    own = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    kept = ("node", "component", "embedding")
    rows = placed.join(sizes, ["group", "size"]).select("group", "size", own("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("asked"), *kept).unionByName(
        sought.join(sizes, ["group", "size"]).select("group", "size", every("rows").alias("i"), own("columns").alias("j"), F.lit(1).alias("asked"), *kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _units(batches, ("group", "size", "i", "j")):
            asks = np.concatenate([h.column("asked").to_numpy() for h in held]) == 1
            if asks.all() or not asks.any():
                continue
            component = np.concatenate([h.column("component").to_numpy() for h in held])
            vectors = np.concatenate([_matrix(h.column("embedding")) for h in held])
            columns, of_column, found = vectors[asks].T, component[asks], []
            vectors, component = vectors[~asks], component[~asks]
            for s in range(0, len(vectors), SEARCH_ROWS):
                i, j = np.nonzero(vectors[s:s + SEARCH_ROWS] @ columns >= THRESHOLD)
                pair = np.stack([component[s + i], of_column[j]], 1)
                found.append(np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0))
            pair = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    key = ("group", "size", "i", "j")
    return rows.repartition(*key).sortWithinPartitions(*key, "asked", "node").mapInArrow(run, "a long, b long").distinct()


def _closed(nodes: DataFrame, edges: DataFrame, searched: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(joined, counted, edges, searched) when every saturated node was compared with its whole label.

    `searched` names those that were; the components their links joined are among the edges."""
    while True:
        joined = components(edges)
        counted = cut(_counted(nodes, joined))
        full = counted.filter(F.col("others") >= NEIGHBOURS).select("node")
        full = cut(full if searched is None else full.join(searched, "node", "left_anti"))
        if full.isEmpty():
            return joined, counted, edges, searched
        searched = full if searched is None else searched.unionByName(full)
        more = cut(_across(nodes, joined, full))
        if more.isEmpty():
            return joined, counted, edges, searched
        edges = edges.unionByName(more)


def _recall(nodes: DataFrame, joined: DataFrame, counted: DataFrame) -> float:
    """Mean share of a node's links that were found, the lower one of nodes with few and with many links.

    About AUDITED nodes are sampled by hash of those without links, in components of at most NEIGHBOURS + 1 nodes, and in
    larger ones; a sampled node stands for its share of them.  Links are counted by brute force."""
    sizes = joined.groupBy("component").agg((F.count(F.lit(1)) > NEIGHBOURS + 1).cast("int").alias("large"))
    kinds = nodes.join(joined.join(sizes, "component").select("node", "large"), "node", "left").select("node", (F.coalesce("large", F.lit(-1)) + 1).alias("kind"))
    of_kind = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    if not of_kind:
        return 1.0
    of = F.coalesce(*(F.when(F.col("kind") == k, F.lit(count)) for k, count in of_kind.items()))
    sampled = kinds.filter(F.pmod(F.xxhash64(F.lit("audit"), "node"), of) < AUDITED)
    asked = sampled.join(nodes, "node").join(counted, "node", "left").select(
        "node", "kind", "label", "size", "embedding", F.coalesce("links", F.lit(0)).alias("links")).toArrow()
    queries = {}
    for label, size, node, vector in zip(*(asked.column(c).to_pylist() for c in ("label", "size", "node", "embedding"))):
        names, vectors = queries.setdefault((label, size), ([], []))
        names.append(node)
        vectors.append(vector)
    queries = {k: (np.array(a), _matrix(pa.array(v))) for k, (a, v) in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = {key: np.zeros(len(names), np.int64) for key, (names, _) in queries.items()}
        for batch in batches:
            labels, sizes = batch.column("label").to_pylist(), batch.column("size").to_pylist()
            rows = {}
            for k, key in enumerate(zip(labels, sizes)):
                if key in queries:
                    rows.setdefault(key, []).append(k)
            for key, at in rows.items():
                names, wanted = queries[key]
                for s in range(0, len(at), SEARCH_ROWS):
                    part = batch.take(pa.array(at[s:s + SEARCH_ROWS]))
                    near = _matrix(part.column("embedding")) @ wanted.T >= THRESHOLD
                    near &= part.column("node").to_numpy()[:, None] != names
                    true[key] += part.column("copies").to_numpy() @ near
        for key, links in true.items():
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(queries[key][0][some]), pa.array(links[some])], ["node", "true"])

    counts = nodes.select("label", "size", "node", "copies", "embedding").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    true = {r["node"]: r["true"] for r in counts.collect()}
    kind, links = asked.column("kind").to_numpy(), asked.column("links").to_numpy()
    real = np.array([true.get(k, 0) for k in asked.column("node").to_pylist()])
    weight = np.array([of_kind[k] for k in kind.tolist()]) / np.bincount(kind, minlength=3)[kind]
    shares = [float(np.average(links[of] / real[of], weights=weight[of])) for of in ((real > 0) & (real <= NEIGHBOURS), real > NEIGHBOURS) if of.any()]
    return min(shares, default=1.0)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall), one row per row of `vectors` (vec_id, embedding, label).

    Vectors of one label link when their cosine, in double precision, is at least 0.98; none below links.
    n_links counts the other vectors linked directly, copies included; component_id is the least vec_id that
    links reach.  audited_recall is at least 0.97: if no start arrives there, all vectors of a label are compared.
    A vector that is null, empty, zero or holds null or non-finite numbers, or whose label is
    null, links with nothing and is its own component.  An empty table gives no rows; other columns are not
    read.  Equal vectors are found by a 64-bit hash; a null vec_id is nobody's component_id."""
    usable = _usable(F.col("embedding"), F.col("label"))
    rows = vectors.select("vec_id", "label", "embedding", F.when(usable, F.xxhash64("label", "embedding")).alias("node"))
    nodes = cut(rows.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("size", F.size("embedding")))
    n = nodes.count()
    known, edges, searched = None, None, None
    for start in range(STARTS):
        known = neighbour_graph(nodes, n, start, known)
        linked = known.filter(F.col("sim") >= THRESHOLD).select(F.col("u").alias("a"), F.col("v").alias("b"))
        joined, counted, edges, searched = _closed(nodes, linked if edges is None else edges.unionByName(linked), searched)
        recall = _recall(nodes, joined, counted)
        if recall >= RECALL:
            break
    else:
        rest = nodes.select("node") if searched is None else nodes.select("node").join(searched, "node", "left_anti")
        joined = components(edges.unionByName(cut(_across(nodes, joined, rest))))
        counted = cut(_counted(nodes, joined))
        recall = _recall(nodes, joined, counted)
    grouped = nodes.select("node", "copies", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = (
        grouped.join(lowest, "component").join(counted, "node", "left")
        .select(F.col("node").alias("named"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(of_node, F.col("node") == F.col("named"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"), F.lit(recall).alias("audited_recall"))
