"""Full-text and vector arms, rank fusion, and seed selection, for a batch of questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from symtrail import constants as K
from symtrail.functions import text as X
from symtrail.operators.keyed import lookup
from symtrail.session import cut

#: Question vectors, and vectors they are compared with, that a task holds at once.
QUERY_BLOCK, VECTOR_TILE = 4096, 8192

#: Postings whose documents a task scores at once; of each it may hold a score per question.
POSTINGS_PER_TASK = 200_000


# -- inverted index ------------------------------------------------------------------------------

def postings(documents: DataFrame, text: str = "search_text") -> DataFrame:
    """`uid, term, tf, dl`: the inverted index as a table.

    A document's words sit in one row, so the partial aggregate is complete before it shuffles."""
    words = documents.select("uid", X.analyzed_words(F.col(text)).alias("words"))
    return words.select("uid", F.size("words").alias("dl"), F.explode("words").alias("term"))\
        .groupBy("uid", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(questions: DataFrame) -> DataFrame:
    """`question_id, term, weight`; a word that several terms contain weighs that often."""
    return questions.select("question_id", F.explode(X.query_terms(F.col("query"))).alias("term"))\
        .groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def bm25(documents: DataFrame, questions: DataFrame, k: int = K.ARM_K, text: str = "search_text",
         tenant: str | None = None) -> DataFrame:
    """Top `k` documents per question: `question_id, uid, score, rank` (ties: least uid).

    Documents are scanned once.  Words outside the questions' vocabulary are dropped by the join
    before anything is counted or shuffled; the final ranking prunes inside each task.  Statistics
    are global; with `tenant`, only rows of the question's own tenant are ranked."""
    columns = ["uid"] + ([tenant] if tenant else [])
    asked = cut(query_terms(questions))
    vocabulary = asked.select("term").distinct()
    words = documents.select(*columns, X.analyzed_words(F.col(text)).alias("words")).withColumn("dl", F.size("words"))
    totals = words.agg(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))
    exploded = words.select(*columns, "dl", F.explode("words").alias("term"))
    kept = lookup(exploded, vocabulary, ["term"], "inner", bound=asked)
    # The postings of the vocabulary are read twice (frequencies, scores); texts are tokenized once.
    counts = cut(kept.groupBy(*columns, "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = totals.select("n").scalar(), totals.select("avgdl").scalar()
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(frequency, "term").select("question_id", "term", (F.col("weight") * idf).alias("w"))
    keys = ["term"]
    if tenant:
        weighted = weighted.join(questions.select("question_id", tenant), "question_id")
        keys.append(tenant)
    saturation = F.col("tf") * (K.BM25_K1 + 1) / (
        F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / avgdl))
    # Dealt out by document, a task holds whole documents: it sums their scores and prunes to the `k` best by itself.
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // POSTINGS_PER_TASK))
    pairs = lookup(counts.repartition(tasks, "uid"), weighted, keys, "inner", bound=asked).groupBy("question_id", "uid").agg(
        F.round(F.sum(F.col("w") * saturation), 9).alias("score"))
    return ranked(pairs, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "uid")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# -- vectors -----------------------------------------------------------------------------------------

def _unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    matrix = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    length = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(length == 0, 1.0, length)[:, None]


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the `k` greatest scores of each query; all that may round to the k-th stay, so ties are
    settled globally."""
    floor = np.partition(scores, -k, axis=0)[-k] - 2e-9 if len(scores) > k else np.full(scores.shape[1], -np.inf)
    return np.nonzero(scores >= floor)


def _best_of_batches(queries: dict, k: int, uid_type: pa.DataType):
    """Per Arrow batch, the `k` best rows of each query of the row's tenant (matrix products)."""
    schema = pa.schema([("question_id", pa.string()), ("uid", uid_type), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("vector").is_valid())
            if batch.num_rows == 0:
                continue
            tenants = np.array(batch.column("tenant").to_pylist())
            matrix = _unit_rows(batch.column("vector"))
            for tenant in np.unique(tenants):
                if tenant not in queries:
                    continue
                ids, block = queries[tenant]
                rows = np.flatnonzero(tenants == tenant)
                scores = matrix[rows] @ block.T
                at, q = _best(scores, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in q], pa.string()), batch.column("uid").take(pa.array(rows[at])),
                     pa.array(scores[at, q])], schema=schema)

    return run


def nearest(vectors: DataFrame, questions: DataFrame, k: int = K.ARM_K, block: int = QUERY_BLOCK, tile: int = VECTOR_TILE) -> DataFrame:
    """Top `k` vectors by cosine within each question's tenant: `question_id, uid, score, rank`.

    `vectors(uid, tenant, vector)`, `questions(question_id, tenant, vector)`.  Exact: the tenant is
    applied before ranking, so a small tenant never loses its rows to a large one.  Up to `block` questions
    go to the vectors, which are scanned where they lie.  More are data like the vectors: a tenant's
    questions in blocks meet its vectors in tiles, a block and a tile in a task, so neither a large tenant nor
    many questions meet in one place.  Each task keeps its own best `k` per question and only those move on."""
    asked = cut(questions.filter("vector is not null").select(F.col("question_id").cast("string").alias("question_id"), "tenant", "vector"))
    uid_type = "bigint" if dict(vectors.dtypes)["uid"] == "bigint" else "string"
    arrow = pa.int64() if uid_type == "bigint" else pa.string()
    held = vectors.filter("vector is not null").select("uid", "tenant", "vector")
    shape = f"question_id string, uid {uid_type}, score double"
    few = asked.limit(block + 1).toArrow()
    if few.num_rows <= block:
        tenants = few.column("tenant").to_pylist()
        queries = {}
        for tenant in set(tenants):
            mine = few.take(pa.array([i for i, t in enumerate(tenants) if t == tenant]))
            queries[tenant] = (mine.column("question_id").to_pylist(), _unit_rows(mine.column("vector")))
        found = held.filter(F.col("tenant").isin(list(queries))).mapInArrow(_best_of_batches(queries, k, arrow), shape)
    else:
        found = _tiled(held, asked, k, block, tile, shape, arrow)
    best = ranked(found.withColumn("score", F.round("score", 9)), k)
    return best.withColumn("question_id", F.col("question_id").cast(dict(questions.dtypes)["question_id"]))


def _tiled(held: DataFrame, asked: DataFrame, k: int, block: int, tile: int, shape: str, arrow: pa.DataType) -> DataFrame:
    """The best `k` of every (question block, vector tile) of a tenant."""
    n = lambda df, name, size: df.groupBy("tenant").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = cut(n(asked, "blocks", block).join(n(held, "tiles", tile), "tenant"))
    part = lambda count: F.pmod(F.xxhash64(F.col("uid") if count == "tiles" else F.col("question_id")), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = lookup(held, sizes, ["tenant"], "inner").withColumn("tile", part("tiles")).withColumn("block", every("blocks"))
    right = lookup(asked, sizes, ["tenant"], "inner").withColumn("block", part("blocks")).withColumn("tile", every("tiles"))
    keys = ["tenant", "tile", "block"]

    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or queries.num_rows == 0:
            return pa.table({"question_id": pa.array([], pa.string()), "uid": pa.array([], arrow), "score": pa.array([], pa.float64())})
        scores = _unit_rows(rows.column("vector")) @ _unit_rows(queries.column("vector")).T
        at, q = _best(scores, k)
        return pa.table({"question_id": queries.column("question_id").take(pa.array(q)), "uid": rows.column("uid").take(pa.array(at)), "score": scores[at, q]})

    left, right = left.select(*keys, "uid", "vector"), right.select(*keys, "question_id", "vector")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, shape)


# -- fusion ---------------------------------------------------------------------------------------------

def fuse(arms: dict[str, DataFrame], k: int = K.RRF_K, limit: int = K.RRF_TOP_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked arms: `question_id, uid, score, rank, <arm>_rank...`."""
    rows = None
    for name, arm in arms.items():
        part = arm.select("question_id", "uid", F.lit(name).alias("arm"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("question_id", "uid").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"),
        *[F.max(F.when(F.col("arm") == name, F.col("rank"))).alias(f"{name}_rank") for name in arms])
    return ranked(fused, limit)


def semantic_seeds(fused: DataFrame, leads: DataFrame | None = None, count: int = K.SEED_COUNT) -> DataFrame:
    """`question_id, uid, score, position`: leads first, above every candidate, then the best rest."""
    if leads is None:
        return fused.filter(F.col("rank") <= count).select("question_id", "uid", "score", F.col("rank").alias("position"))
    top = fused.groupBy("question_id").agg(F.max("score").alias("top"))
    sizes = leads.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    first = leads.join(sizes, "question_id").join(top, "question_id", "left").select(
        "question_id", "uid", (F.coalesce("top", F.lit(1.0)) + 1.0 + F.col("n") - F.col("position") + 1).alias("score"),
        "position")
    rest = fused.join(leads.select("question_id", "uid"), ["question_id", "uid"], "left_anti")
    order = W.partitionBy("question_id").orderBy("rank")
    rest = rest.withColumn("_rn", F.row_number().over(order)).join(sizes, "question_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))).filter(F.col("_rn") + F.col("n") <= count)
    return first.unionByName(rest.select("question_id", "uid", "score", (F.col("_rn") + F.col("n")).alias("position")))


# -- gold passages ------------------------------------------------------------------------------------

def _shifted(values: Column, width: int) -> Column:
    """Every run of `width` neighbouring values, joined."""
    parts = F.arrays_zip(*[F.slice(values, i + 1, F.greatest(F.size(values) - width + 1, F.lit(0))).alias(f"v{i}") for i in range(width)])
    return F.transform(parts, lambda p: F.concat_ws("\x00", *[p[f"v{i}"] for i in range(width)]))


def containing(documents: DataFrame, passages: DataFrame, width: int = 6) -> DataFrame:
    """`question_id, uid` of documents that contain the passage text, without pairing all of both.

    A document that contains a passage contains the passage's inner words in sequence, so their first
    `width` (all, where there are fewer) are an equi-join key.  A passage of one or two words has no
    inner word; its first three characters (or fewer) are the key, met by a document's character runs
    of that length.  `contains` settles every match; an empty passage is in every document and has no row."""
    split = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    words = split(F.col("query"))
    inner = F.least(F.size("w") - 2, F.lit(width))
    chars = F.least(F.char_length("query"), F.lit(3))
    keyed = passages.filter("query <> ''").select("question_id", "query", words.alias("w")).select(
        "question_id", "query",
        F.when(inner > 0, F.struct(F.lit("words").alias("kind"), inner.alias("n"), F.array_join(F.slice("w", F.lit(2), inner), "\x00").alias("run")))
        .otherwise(F.struct(F.lit("chars").alias("kind"), chars.alias("n"), F.array_join(F.filter(F.split(F.substr("query", F.lit(1), chars), ""), lambda c: c != ""), "\x00").alias("run"))).alias("key"))
    keyed = cut(keyed.withColumn("hash", F.xxhash64("key.kind", "key.n", "key.run")))
    kinds = sorted((r["kind"], r["n"]) for r in keyed.select("key.kind", "key.n").distinct().collect())      # at most `width` + 3
    if not kinds:
        shape = {**dict(passages.dtypes), **dict(documents.dtypes)}
        return passages.sparkSession.createDataFrame([], f"question_id {shape['question_id']}, uid {shape['uid']}")
    body = documents.select("uid", "text", split(F.col("text")).alias("w"), F.filter(F.split("text", ""), lambda c: c != "").alias("c"))

    def hashed(kind: str, n: int) -> Column:
        return F.transform(_shifted(F.col("w" if kind == "words" else "c"), n), lambda r: F.xxhash64(F.lit(kind), F.lit(n), r))

    runs = [hashed(kind, n) for kind, n in kinds]
    grams = body.select("uid", F.explode(F.array_distinct(F.concat(*runs))).alias("hash"))
    # Few documents hold a key: they are written down, so that texts meet them where they lie.
    pairs = cut(lookup(grams, keyed.select("question_id", "hash"), ["hash"], "inner").select("question_id", "uid").distinct())
    checked = lookup(documents.select("uid", "text"), pairs, ["uid"], "inner").join(passages.select("question_id", "query"), "question_id")
    return checked.filter(F.contains("text", F.col("query"))).select("question_id", "uid")
