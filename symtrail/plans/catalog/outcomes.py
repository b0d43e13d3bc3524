"""Outcomes of questions, exact ranks, samples, counters of a run, embedder records and a polled tree."""

from __future__ import annotations

import os
import uuid
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from symtrail import counters as CT
from symtrail.operators import embedding, grounding as GR, metrics as ME, outcomes as O
from symtrail.plans.catalog import SQL, query
from symtrail.plans.catalog.answers import _ANS, _CLS, _answers, _context
from symtrail.plans.catalog.retrieval import release_gates
from symtrail.plans.demo_graph import table
from symtrail.session import cut, shared_dir
from symtrail.sources import stats
from symtrail.sources.meta import Meta


# -- outcomes ----------------------------------------------------------------------------------------

def _outcomes(spark, sf):
    """Answers of conversations as questions: class, language, frames and costs follow from their numbers."""
    answers = _answers(spark, sf)
    q = F.col("answer_id").alias("question_id")
    kind = F.element_at(F.array(F.lit("TRACE"), F.lit("STRUCTURAL"), F.lit("SEMANTIC")), (F.col("conv_id") % 3 + 1).cast("int"))
    questions = answers.select(q, kind.alias("class"), F.when(F.col("conv_id") % 2 == 0, "typescript").otherwise("python").alias("language"))
    rank = F.substring("handle", 2, 9).cast("int")
    packed = _context(spark, sf).select(q, "uid", F.when(rank != 7, F.col("handle")).alias("handle"), rank.alias("rank"), (rank * 10).cast("bigint").alias("cost"))
    gold = answers.select(q, F.concat(F.lit("U"), F.col("turn") % 9 + 1).alias("uid"))
    classified = GR.sentences(answers)
    report = GR.report(classified).withColumnRenamed("answer_id", "question_id").join(answers.filter("conv_id % 10 <> 0").select(q), "question_id", "left_semi")
    errors = GR.handle_errors(classified, _context(spark, sf)).withColumnRenamed("answer_id", "question_id")
    n = F.explode(F.sequence(F.lit(1), (F.col("conv_id") % 4 + 1).cast("int")))
    tier = F.element_at(F.array(F.lit("direct"), F.lit("name"), F.lit("unresolved")), ((F.col("turn") + F.col("n")) % 3 + 1).cast("int"))
    frames = answers.select(q, "conv_id", "turn", n.alias("n")).select(
        "question_id", F.when(F.col("conv_id") % 2 == 0, "typescript").otherwise("python").alias("language"),
        F.when(F.col("n") == 3, "node_modules/x/y.ts").otherwise("src/y.ts").alias("file_path"), tier.alias("tier"))
    costs = answers.select(q, (F.col("turn") / 1000).alias("usd"), (F.col("conv_id") % 100 / 50).alias("ttft"), (F.col("conv_id") % 5 == 0).alias("retried"))
    return cut(O.question_outcomes(questions, packed, gold, report, frames, errors, None, costs))


_OUT = f"""{_ANS}, {_CLS}, r AS (SELECT answer_id, count_if(is_claim) AS claims, count_if(is_claim AND cited) AS cited FROM claim WHERE conv_id % 10 <> 0 GROUP BY answer_id),
bad AS (SELECT answer_id, count(*) AS n FROM (SELECT answer_id, conv_id, unnest(hs)::INT AS h FROM claim) WHERE h > conv_id % 7 + 1 GROUP BY answer_id),
fr AS (SELECT answer_id, count(*) AS total, count_if((turn + n) % 3 < 2) AS resolved FROM (SELECT answer_id, conv_id, turn, unnest(range(1, conv_id % 4 + 2)) AS n FROM ans) WHERE n <> 3 AND conv_id % 2 = 0 GROUP BY answer_id),
o AS (SELECT answer_id AS question_id, ['TRACE', 'STRUCTURAL', 'SEMANTIC'][conv_id % 3 + 1] AS class, CASE WHEN conv_id % 2 = 0 THEN 'typescript' ELSE 'python' END AS language,
  list_sum(list_transform(list_filter(range(1, conv_id % 7 + 2), lambda k: k <> 7), lambda k: 10 * k))::BIGINT AS packed_tokens,
  CASE WHEN turn % 9 + 1 <= conv_id % 7 + 1 AND turn % 9 + 1 <> 7 THEN (turn % 9 + 1)::BIGINT END AS gold_rank, r.answer_id IS NOT NULL AS answered, coalesce(claims, 0) AS claims, coalesce(cited, 0) AS cited,
  coalesce(bad.n, 0) AS unknown_citations, coalesce(total, 0) AS frames_total, coalesce(resolved, 0) AS frames_resolved, turn / 1000 AS usd, conv_id % 100 / 50 AS ttft, conv_id % 5 = 0 AS retried,
  conv_id % 5 = 0 AND coalesce(cited / nullif(claims, 0), 1.0) < 0.6 AS needs_review
  FROM ans LEFT JOIN r USING (answer_id) LEFT JOIN bad USING (answer_id) LEFT JOIN fr USING (answer_id))"""


@query("question_outcomes", f"""WITH {_OUT} SELECT question_id, class, language, packed_tokens, gold_rank, answered, claims, cited, unknown_citations, frames_total, frames_resolved,
  round(usd, 6) AS usd, round(ttft, 6) AS ttft, retried, needs_review FROM o""")
def question_outcomes(spark, sf):
    return _outcomes(spark, sf).select(
        "question_id", "class", "language", "packed_tokens", "gold_rank", "answered", "claims", "cited", "unknown_citations", "frames_total", "frames_resolved",
        F.round("usd", 6).alias("usd"), F.round("ttft", 6).alias("ttft"), "retried", "needs_review")


@query("outcome_rollup", f"""WITH {_OUT}, g AS (SELECT grouping_id(class, language) AS s, class, language, count(*) AS questions, count_if(answered) AS answered, count_if(gold_rank <= 10) AS gold_packed, count_if(retried) AS retried,
  count_if(needs_review) AS needs_review, coalesce(sum(claims) FILTER (answered), 0)::BIGINT AS claims, coalesce(sum(cited) FILTER (answered), 0)::BIGINT AS cited, coalesce(sum(unknown_citations) FILTER (answered), 0)::BIGINT AS unknown_citations,
  coalesce(sum(frames_total) FILTER (language = 'typescript'), 0)::BIGINT AS frames_total, coalesce(sum(frames_resolved) FILTER (language = 'typescript'), 0)::BIGINT AS frames_resolved
  FROM o GROUP BY GROUPING SETS ((class, language), (class), (language), ()))
SELECT ['class, language', 'class', 'language', 'all'][s + 1] AS level, class, language, questions, answered, gold_packed, retried, needs_review, claims, cited, unknown_citations, frames_total, frames_resolved,
  round(gold_packed / questions, 6) AS gold_rate, round(cited / nullif(claims, 0), 6) AS coverage, round(frames_resolved / nullif(frames_total, 0), 6) AS frame_resolution FROM g""")
def outcome_rollup(spark, sf):
    """Every level of class and language from one pass over the outcomes."""
    out = O.rollup(_outcomes(spark, sf)).drop("relations", "relations_verified", "conflicts", "unsupported", "relation_precision")
    return out.withColumns({c: F.round(c, 6) for c in ("gold_rate", "coverage", "frame_resolution")})


@query("outcome_measures", f"""WITH {_OUT}, d AS (SELECT * FROM o WHERE answered),
p AS (SELECT * FROM (VALUES (0.5::DOUBLE, '50'), (0.95::DOUBLE, '95')) x(f, n))
SELECT 'Citation Coverage' AS name, round(sum(cited) / nullif(sum(claims), 0), 6) AS value FROM d UNION ALL SELECT 'Relation Precision', NULL
UNION ALL SELECT concat('TTFT p', n), round(list_sort(vs)[greatest(0, least(len(vs) - 1, CAST(round_even(f * len(vs) + 0.5, 0) AS BIGINT) - 1)) + 1], 6) FROM p, (SELECT list(ttft) AS vs FROM d)
UNION ALL SELECT concat('$/query p', n, ' (uncached)'), round(list_sort(vs)[greatest(0, least(len(vs) - 1, CAST(round_even(f * len(vs) + 0.5, 0) AS BIGINT) - 1)) + 1], 6) FROM p, (SELECT list(usd) AS vs FROM d)""")
def outcome_measures(spark, sf):
    """What outcomes measure of the gates: pooled ratios and percentiles over answered questions."""
    return O.measures(_outcomes(spark, sf)).withColumn("value", F.round("value", 6))


@query("outcome_percentiles", """WITH f AS (SELECT unnest([0.0, 0.5, 0.95, 1.0])::DOUBLE AS fraction),
o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, fraction, value FROM o, f WHERE i = greatest(0, least(n - 1, CAST(round_even(fraction * n + 0.5, 0) AS BIGINT) - 1))""")
def outcome_percentiles(spark, sf):
    """Exact ranks from merged histograms, of which only the bin with the rank is looked at again."""
    return ME.rank_values(table(spark, sf, "events"), ["event_type"], "value", [0.0, 0.5, 0.95, 1.0])


@query("gate_partitions", f"WITH gs AS ({SQL['release_gates']})" + """
SELECT s.status, count(name) AS n, coalesce(string_agg(name, '; ' ORDER BY name), '') AS names FROM (VALUES ('PASS'), ('FAIL'), ('NOT MEASURED')) s(status) LEFT JOIN gs ON gs.status = s.status GROUP BY s.status""")
def gate_partitions(spark, sf):
    """Passing, failing and unmeasured release gates."""
    gates = release_gates(spark, sf).withColumn("position", F.lit(0))
    return O.gate_partitions(gates)


@query("seeded_sample", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(concat('7', chr(0), doc_id))) AS k FROM documents) WHERE k <= 50""")
def seeded_sample(spark, sf):
    """Fifty documents of each language by a seeded hash, found by counts of hash prefixes."""
    return ME.seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), 50, [F.col("doc_id")], 7, ["lang"])


# -- counters -------------------------------------------------------------------------------------------

@query("run_counters", """WITH d AS (SELECT doc_id, sha256(text) AS k, n_chars FROM documents), c AS (SELECT DISTINCT k FROM d JOIN labels USING (doc_id)), h AS (SELECT d.k IN (SELECT k FROM c) AS hit, n_chars % 2 = 0 AS even FROM d),
n AS (SELECT count(*) AS lookups, count_if(hit) AS hits, count_if(NOT hit) AS misses, count_if(NOT hit AND even) AS headers FROM h)
SELECT * FROM (SELECT 'cache.lookups' AS counter, lookups AS n FROM n UNION ALL SELECT 'cache.hits', hits FROM n UNION ALL SELECT 'cache.miss.total', misses FROM n UNION ALL SELECT 'cache.miss.header_only', headers FROM n) WHERE n > 0""")
def run_counters(spark, sf):
    """Look-ups, hits and misses of an embedding run, counted on the rows that it writes."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("uid"), "doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("cache_key"), F.lit("").alias("chunk_text"))
    docs = docs.withColumn("body_hash", F.col("cache_key"))
    cache = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("cache_key").distinct().select(
        F.lit("none").alias("model"), "cache_key", F.lit(1).alias("dimensions"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    stored = docs.select("uid", F.when(F.col("n_chars") % 2 == 0, F.col("body_hash")).alias("body_hash"))
    counters = CT.Counters()
    embedding.embed_symbols(docs, cache, embedding.DisabledProvider(dimensions=1), stored, counters)
    seen = counters.values()
    seen.pop("index.embedding_unavailable")
    return CT.rows(spark, seen)


# -- embedder records -------------------------------------------------------------------------------------

def _recorded(spark, sf):
    """A record per customer, its market segment as the model; customers of nation 0 to 4 were embedded again."""
    meta = Meta(spark, f"{shared_dir(spark)}/symtrail-meta/{uuid.uuid4().hex}")
    repos = table(spark, sf, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("repo_id"), "c_custkey", "c_mktsegment", "c_nationkey")
    key = embedding.embedder_key(F.col("repo_id")).alias("key")
    first = meta.put(repos.filter("c_custkey % 7 <> 0").select(key, F.col("c_mktsegment").alias("value")))
    meta.put(repos.filter("c_nationkey < 5").select(key, F.lit("BUILDING").alias("value")), based_on=first)
    return repos, meta.read()


_REC = "rec AS (SELECT concat('r', c_custkey) AS repo_id, c_custkey, CASE WHEN c_nationkey < 5 THEN 'BUILDING' WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS recorded FROM customer)"
_MODEL = SimpleNamespace(name="BUILDING", semantic=True, local=False)


@query("vector_gate", f"""WITH {_REC} SELECT repo_id, recorded, recorded IS NOT DISTINCT FROM 'BUILDING' AS usable, CASE WHEN recorded IS NOT DISTINCT FROM 'BUILDING' THEN '' ELSE
  concat('the index was embedded with ', coalesce(recorded, 'no embedding model'), ', not BUILDING: index again to use vector search') END AS reason FROM rec""")
def vector_gate(spark, sf):
    """Which repositories may be searched by vectors, after two versions of the record."""
    repos, meta = _recorded(spark, sf)
    return embedding.vector_gate(repos, meta, _MODEL)


@query("bootstrap_decision", f"""WITH {_REC}, k AS (SELECT *, c_custkey IN (SELECT o_custkey FROM orders) AS known, recorded IS DISTINCT FROM 'BUILDING' AS stale FROM rec)
SELECT repo_id, CASE WHEN NOT known THEN 'index' ELSE 'reconcile' END AS action, CASE WHEN known AND stale THEN
  concat('embedded with ', coalesce(recorded, 'no embedding model'), '; vector search stays off until it is indexed again') ELSE '' END AS note FROM k""")
def bootstrap_decision(spark, sf):
    """What brings each repository level at a start; those with orders are known, and the model is billed."""
    repos, meta = _recorded(spark, sf)
    known = table(spark, sf, "orders").select(F.concat(F.lit("r"), "o_custkey").alias("repo_id"))
    return embedding.bootstrap_decision(repos, known, meta, _MODEL)


# -- a polled tree -----------------------------------------------------------------------------------------

def _put_files(rows, root: str) -> None:
    """Write (path, content) as files below `root`, from the tasks; a null content removes the file."""
    def run(batches):
        for frame in batches:
            for path, content in zip(frame["path"], frame["content"]):
                full = os.path.join(root, path)
                if content is None:
                    os.remove(full)
                    continue
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    rows.select("path", F.col("text").cast("binary").alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).collect()


@query("polled_changes", """
WITH t AS (SELECT concat(lang, '/', source, '/', doc_id, '.py') AS p, text || CASE WHEN toxic = 1 THEN 'x' ELSE '' END AS c FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0),
k AS (SELECT concat(lang, '/', source, '/', doc_id, '.py') AS p, text AS c FROM documents JOIN labels USING (doc_id))
SELECT coalesce(t.p, k.p) AS rel_path, CASE WHEN t.p IS NULL THEN 'removed' ELSE 'saved' END AS change, octet_length(encode(t.c))::BIGINT AS size, sha256(t.c) AS content_hash
FROM t FULL OUTER JOIN k ON t.p = k.p WHERE t.c IS DISTINCT FROM k.c""")
def polled_changes(spark, sf):
    """Labelled documents are the files of a tree at the start; then it loses those of low quality, toxic ones
    are edited, and unlabelled ones appear.  A stream that polls times and sizes tells exactly that."""
    base = f"{shared_dir(spark)}/symtrail-trees/{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".py")).alias("path")
    both = docs.join(labels, "doc_id", "left").select(path, "text", "quality", "toxic")
    _put_files(both.filter("quality is not null"), f"{base}/tree")
    stream = stats.changes(spark, f"{base}/tree", "docs", f"{base}/snapshots")
    out = stream.select("rel_path", "change", "size", F.sha2("content", 256).alias("content_hash"))

    def look():
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    look()
    edited = F.when(F.col("quality") == 0, None).otherwise(F.concat("text", F.when(F.col("toxic") == 1, "x").otherwise(""))).alias("text")
    _put_files(both.filter("quality is null or quality = 0 or toxic = 1").select("path", edited), f"{base}/tree")
    look()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
