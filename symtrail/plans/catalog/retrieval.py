"""Full-text, vector and fused search, gold passages, packing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from symtrail.operators import metrics as ME, packing, retries as RY, retrieval as R
from symtrail.plans.catalog import query
from symtrail.plans.demo_graph import table, texts
from symtrail.session import cut, stored


def _docs(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select(F.col("doc_id").alias("uid"), F.col("text").alias("search_text"), "text", "source", "lang")


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))


def _fulltext(spark, sf):
    """The full-text arm, ranked once and reused by the queries that fuse, score or pack it."""
    return stored(spark, f"fulltext {sf}", lambda: R.bm25(_docs(spark, sf), _asked(spark, sf)))


def _vectors(spark, sf):
    """The vector arm: a question's vector is the one stored under its id; labels are tenants."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), F.col("label").alias("tenant"), F.col("embedding").alias("vector"))
    asked = _asked(spark, sf).join(vectors.withColumnRenamed("uid", "question_id"), "question_id").select("question_id", "tenant", "vector")
    return R.nearest(vectors, asked)


_SPLIT = (r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[_\-./:]+', ' ', 'g'), "
          r"'([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' '), lambda x: x <> '')")
_BM25 = f"""
raw AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ts FROM benchmark),
term AS (SELECT item_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM raw),
tok AS (SELECT item_id, i, 0 AS j, lower(t) AS tk FROM term UNION ALL SELECT item_id, i, generate_subscripts({_SPLIT.format('t')}, 1), lower(unnest({_SPLIT.format('t')})) FROM term),
firsts AS (SELECT item_id, tk, min(i * 1000 + j) AS ord FROM tok GROUP BY ALL),
lim AS (SELECT item_id, tk, row_number() OVER (PARTITION BY item_id ORDER BY ord) AS rn FROM firsts),
q AS (SELECT item_id, w, count(*) AS weight FROM (SELECT item_id, unnest(regexp_extract_all(tk, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM lim) GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
tot AS (SELECT count_if(len(ws) > 0) AS n, avg(CASE WHEN len(ws) > 0 THEN len(ws) END) AS avgdl FROM d),
tf AS (SELECT doc_id, len(ws) AS dl, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
bm AS (SELECT q.item_id, tf.doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN tf USING (w) JOIN df USING (w), tot GROUP BY ALL),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 60)"""
_NEAR = """
vq AS (SELECT vec_id AS item_id, label, embedding FROM embeddings JOIN benchmark ON item_id = vec_id),
vs AS (SELECT q.item_id, e.vec_id AS doc_id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 9) AS score
  FROM vq q JOIN embeddings e USING (label)),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= 60)"""


@query("fulltext_search", f"WITH {_BM25} SELECT item_id AS question_id, doc_id AS uid, round(score, 6) AS score, rank FROM ft")
def fulltext_search(spark, sf):
    out = R.bm25(_docs(spark, sf), _asked(spark, sf))
    return out.select("question_id", "uid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("vector_search", f"WITH {_NEAR} SELECT item_id AS question_id, doc_id AS uid, round(score, 6) AS score, rank FROM vec")
def vector_search(spark, sf):
    return _vectors(spark, sf).select("question_id", "uid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_FUSED = """
arm AS (SELECT 'f' AS a, item_id, doc_id, rank FROM ft UNION ALL SELECT 'v', item_id, doc_id, rank FROM vec),
fu AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, max(CASE WHEN a = 'f' THEN rank END) AS fr, max(CASE WHEN a = 'v' THEN rank END) AS vr FROM arm GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fu) WHERE rank <= 30)"""


def _fuse(spark, sf):
    return R.fuse({"fulltext": _fulltext(spark, sf), "vector": _vectors(spark, sf)})


@query("rank_fusion", f"WITH {_BM25}, {_NEAR}, {_FUSED} SELECT item_id AS question_id, doc_id AS uid, round(CAST(score AS DOUBLE), 6) AS score, rank, fr AS fulltext_rank, vr AS vector_rank FROM fused")
def rank_fusion(spark, sf):
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return _fuse(spark, sf).select("question_id", "uid", F.round("score", 6).alias("score"), big("rank"), big("fulltext_rank"), big("vector_rank"))


@query("semantic_seeds", f"""WITH {_BM25}, {_NEAR}, {_FUSED}, lead AS (SELECT item_id, max(doc_id) AS doc_id FROM fused WHERE rank > 20 GROUP BY item_id),
rest AS (SELECT f.item_id, f.doc_id, row_number() OVER (PARTITION BY f.item_id ORDER BY rank) + (l.doc_id IS NOT NULL)::INT AS position FROM fused f
  LEFT JOIN lead l USING (item_id) WHERE l.doc_id IS DISTINCT FROM f.doc_id)
SELECT item_id AS question_id, doc_id AS uid, CAST(1 AS BIGINT) AS position FROM lead UNION ALL SELECT item_id, doc_id, position FROM rest WHERE position <= 8""")
def semantic_seeds(spark, sf):
    """Eight seeds per question, led by one entity (the greatest id among ranks after 20)."""
    fused = _fuse(spark, sf)
    leads = fused.filter("rank > 20").groupBy("question_id").agg(F.max("uid").alias("uid")).withColumn("position", F.lit(1))
    return R.semantic_seeds(fused, leads).select("question_id", "uid", F.col("position").cast("bigint").alias("position"))


@query("gold_passages", "SELECT item_id AS question_id, doc_id AS uid FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_passages(spark, sf):
    """Documents that contain a benchmark passage, by shingle join and a containment check."""
    return R.containing(_docs(spark, sf), _asked(spark, sf))


def _hits(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.length("text") % 2 == 0, "SEMANTIC").otherwise("STRUCTURAL").alias("class"))
    return ME.first_hits(asked, _fulltext(spark, sf), gold_passages(spark, sf))


_HITS = """
gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
hit AS (SELECT b.item_id, CASE WHEN length(text) % 2 = 0 THEN 'SEMANTIC' ELSE 'STRUCTURAL' END AS class, b.item_id IN (SELECT item_id FROM gold) AS scoreable,
  (SELECT min(rank) FROM ft JOIN gold USING (item_id, doc_id) WHERE ft.item_id = b.item_id) AS first_hit FROM benchmark b)"""
_RECALL = """count_if(scoreable) AS scoreable, count_if(scoreable AND NOT coalesce(first_hit <= 10, false)) AS misses,
  round(coalesce(avg(CASE WHEN scoreable THEN CAST(coalesce(first_hit <= 10, false) AS INT) END), 0.0), 6) AS recall,
  round(coalesce(avg(CASE WHEN scoreable THEN coalesce(1.0 / first_hit, 0.0) END), 0.0), 6) AS mrr, round(coalesce(100.0 / nullif(count_if(scoreable), 0), 0.0), 6) AS resolution_pp"""


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), 6))
    return df


@query("first_hits", f"WITH {_BM25}, {_HITS} SELECT item_id AS question_id, class, scoreable, first_hit FROM hit")
def first_hits(spark, sf):
    return _hits(spark, sf).withColumn("first_hit", F.col("first_hit").cast("bigint"))


@query("recall_and_mrr", f"WITH {_BM25}, {_HITS} SELECT {_RECALL} FROM hit")
def recall_and_mrr(spark, sf):
    return _rounded(ME.recall_and_mrr(_hits(spark, sf)), "recall", "mrr", "resolution_pp")


@query("recall_by_class", f"WITH {_BM25}, {_HITS} SELECT class, {_RECALL} FROM hit GROUP BY class")
def recall_by_class(spark, sf):
    return _rounded(ME.recall_and_mrr(_hits(spark, sf), by="class"), "recall", "mrr", "resolution_pp")


@query("traversal_scores", """
WITH e AS (SELECT DISTINCT o_custkey q, l_partkey x FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'A'),
r AS (SELECT DISTINCT o_custkey q, l_partkey x FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O'),
f AS (SELECT e.q IS NOT NULL AS e, r.q IS NOT NULL AS r FROM e FULL OUTER JOIN r ON e.q = r.q AND e.x = r.x)
SELECT count_if(e AND r) AS hits, count_if(e) AS expected, count_if(r) AS returned, round(count_if(e AND r) / count_if(r), 6) AS "precision", round(count_if(e AND r) / count_if(e), 6) AS recall FROM f""")
def traversal_scores(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = ME.set_scores(both.filter("l_returnflag <> 'A'"), both.filter("o_orderstatus <> 'O'"), ["o_custkey", "l_partkey"])
    return _rounded(out, "precision", "recall")


@query("caller_benchmark", """
WITH g AS (SELECT DISTINCT l_partkey f, l_suppkey c FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT DISTINCT l_partkey f, l_suppkey c FROM lineitem WHERE l_quantity > 25),
j AS (SELECT g.f IS NOT NULL AS g, o.f IS NOT NULL AS o, coalesce(g.f, o.f) IN (SELECT f FROM g) AS has FROM g FULL OUTER JOIN o ON g.f = o.f AND g.c = o.c)
SELECT count_if(g AND o) AS hits, count_if(g) AS gold, count_if(o AND has) AS found, count_if(o) AS found_all, round(count_if(g AND o) / count_if(o AND has), 6) AS "precision",
  round(count_if(g AND o) / count_if(o), 6) AS precision_all, round(count_if(g AND o) / count_if(g), 6) AS recall FROM j""")
def caller_benchmark(spark, sf):
    items = table(spark, sf, "lineitem")
    pair = [F.col("l_partkey").alias("function"), F.col("l_suppkey").alias("caller")]
    out = ME.caller_scores(items.filter("l_returnflag = 'R'").select(*pair), items.filter("l_quantity > 25").select(*pair))
    return _rounded(out, "precision", "precision_all", "recall")


def _percentile_sql(index):
    return f"""WITH f AS (SELECT unnest([0.0, 0.5, 0.95, 1.0]) AS fraction),
o AS (SELECT l_shipmode, v, row_number() OVER (PARTITION BY l_shipmode ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_shipmode) AS n FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS v FROM lineitem))
SELECT l_shipmode AS l_returnflag, CAST(fraction AS DOUBLE) AS fraction, v AS l_extendedprice FROM o, f WHERE i = {index}"""


@query("percentile_nearest_rank", _percentile_sql("greatest(0, least(n - 1, CAST(round_even(CAST(fraction AS DOUBLE) * n + 0.5, 0) AS BIGINT) - 1))"))
def percentile_nearest_rank(spark, sf):
    return ME.percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.5, 0.95, 1.0])


@query("percentile_scaled", _percentile_sql("least(n - 1, CAST(round_even(CAST(fraction AS DOUBLE) * (n - 1), 0) AS BIGINT))"))
def percentile_scaled(spark, sf):
    return ME.percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.5, 0.95, 1.0], ME.scaled_index)


@query("release_gates", f"""WITH {_BM25}, {_HITS}, g(position, name, threshold, direction) AS (VALUES (1, 'Recall@10 (packed context)', 0.8, '>='), (2, 'MRR', 0.55, '>='), (3, 'Citation Coverage', 0.85, '>='),
 (4, 'T2 classifier precision', 0.9, '>='), (5, 'T2 classifier recall', 0.85, '>='), (6, 'Relation Precision', 0.9, '>='), (7, 'Embedding cache hit rate', 0.9, '>='), (8, 'Context drop rate', 0.1, '<='),
 (9, 'Inbound-edge survival across move', 0.95, '>='), (10, 'TTFT p50', 1.2, '<='), (11, 'TTFT p95', 2.5, '<='), (12, '$/query p50 (uncached)', 0.02, '<='), (13, '$/query p95 (uncached)', 0.06, '<=')),
m AS (SELECT 'Recall@10 (packed context)' AS name, avg(CAST(coalesce(first_hit <= 10, false) AS INT)) AS value FROM hit WHERE scoreable
  UNION ALL SELECT 'MRR', avg(coalesce(1.0 / first_hit, 0.0)) FROM hit WHERE scoreable
  UNION ALL SELECT 'Embedding cache hit rate', count(label.doc_id) / count(*) FROM documents LEFT JOIN labels label USING (doc_id)
  UNION ALL SELECT 'Context drop rate', avg(CAST(toxic AS DOUBLE)) FROM labels)
SELECT name, direction, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'NOT MEASURED' WHEN direction = '>=' AND value >= threshold OR direction = '<=' AND value <= threshold THEN 'PASS' ELSE 'FAIL' END AS status
FROM g LEFT JOIN m USING (name)""")
def release_gates(spark, sf):
    """Gates measured on these tables: search quality, labelled share as cache hits, toxic share as drops."""
    quality = ME.recall_and_mrr(_hits(spark, sf)).select(F.explode(F.create_map(
        F.lit("Recall@10 (packed context)"), F.col("recall").cast("double"), F.lit("MRR"), F.col("mrr").cast("double"))).alias("name", "value"))
    labels = table(spark, sf, "labels")
    hits = table(spark, sf, "documents").select("doc_id").join(labels.select("doc_id", F.lit(1).alias("h")), "doc_id", "left").agg(
        F.lit("Embedding cache hit rate").alias("name"), (F.count("h") / F.count(F.lit(1))).alias("value"))
    drops = labels.agg(F.lit("Context drop rate").alias("name"), F.avg("toxic").alias("value"))
    out = ME.gates(quality.unionByName(hits).unionByName(drops))
    return out.select("name", "direction", F.round("value", 6).alias("value"), "status")


@query("decision_metrics", """
WITH c AS (SELECT count(*) AS total, count_if(toxic = 1) AS h, count_if(quality = 0) AS m FROM labels), e AS (SELECT count_if(event_type = 'error') AS bad, count(*) AS n FROM events)
SELECT 'Undetected-move rate' AS name, round(m / total, 6) AS value, m / total > 0.1 AS fires FROM c UNION ALL SELECT 'Header-only miss share', round(h / total, 6), h / total > 0.2 FROM c
UNION ALL SELECT 'Seed L1-overflow rate', round(bad / n, 6), bad / n > 0.05 FROM e UNION ALL SELECT 'TS/TSX TRACE resolution', NULL, NULL""")
def decision_metrics(spark, sf):
    """Ratios over counters that the label and event tables stand for; an unseen counter is unknown."""
    labels, events = table(spark, sf, "labels"), table(spark, sf, "events")
    count = lambda df, **named: df.agg(*[c.alias(n) for n, c in named.items()])
    l = labels.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("toxic") == 1).alias("h"), F.count_if(F.col("quality") == 0).alias("m"))
    e = events.agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count(F.lit(1)).alias("n"))
    rows = lambda df, pairs: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(c).alias("n")) for n, c in pairs])).alias("x")).select("x.*")
    counters = rows(l, (("move.undetected", "m"), ("move.total", "total"), ("cache.miss.header_only", "h"), ("cache.miss.total", "total"))).unionByName(
        rows(e, (("pack.seed_l1_overflow", "bad"), ("pack.seeds_total", "n"))))
    return ME.decisions(counters).select("name", F.round("value", 6).alias("value"), "fires")


# -- packing ----------------------------------------------------------------------------------------

def _blocks(spark, sf):
    """The full-text ranking as blocks: the best eight are seeds, the rest neighbours."""
    ranked = _fulltext(spark, sf)
    docs = _docs(spark, sf).select("uid", F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("rel_path"), F.lit(None).cast("string").alias("enclosing_signature"),
                                   F.concat(F.lit("document "), "uid").alias("signature"), F.col("text").alias("docstring"), F.col("text").alias("source_code"),
                                   F.array().cast("array<string>").alias("used_imports"))
    return ranked.join(docs, "uid").select("question_id", F.col("uid").cast("string").alias("uid"), F.when(F.col("rank") <= 8, "seed").otherwise("neighbor").alias("role"), "score",
                                           "rel_path", "enclosing_signature", "signature", "docstring", "source_code", "used_imports")


_LEX = r"""'(?s:"{3}.*?"{3})|(?s:''{3}.*?''{3})|"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|#[^\n]*|[A-Za-z_][A-Za-z_0-9]*|\d+\.?\d*|\s+|[^\n]'"""


def _cost_sql(text):
    return (f"CAST(coalesce(list_sum(list_transform(regexp_extract_all({text}, {_LEX}), lambda x: CASE WHEN regexp_full_match(x, '\\s+') "
            "THEN 1 + length(x) - length(replace(x, chr(10), '')) ELSE CAST(ceil(length(x) / 4.0) AS BIGINT) END)), 0) AS BIGINT)")


_HEADER = "concat('# ', source, '/', lang, '.txt :: document ', doc_id)"
_FIRST = "trim(split_part(trim(text, chr(10) || ' '), chr(10), 1))"
_MARK = "concat('# ⟨truncated: ', {0}, ' of ', len(ls), ' lines shown⟩')"
def _pack_sql(of: str, to: str = "") -> str:
    """Steps that pack the blocks of table `of`; the tables they make end in `to`."""
    return f"""room{to} AS (SELECT q, uid, hdr, ls, list_transform(ls, lambda l: 1 + {_cost_sql("l")}) AS lc, 1440 - 1 - {_cost_sql("hdr")} - 1 - {_cost_sql(_MARK.format("len(ls)"))} AS room FROM {of} WHERE seed AND full_cost > 1440),
fit{to} AS (SELECT *, len(list_filter(range(1, len(ls) + 1), lambda k: list_sum(lc[1:k]) <= room)) AS fits FROM room{to}),
kept{to} AS (SELECT *, CASE WHEN fits >= len(ls) THEN len(ls) ELSE greatest(1, coalesce(list_max(list_filter(range(1, fits + 1), lambda i: trim(ls[i + 1]) <> '')), 0)) END AS kept FROM fit{to}),
cut{to} AS MATERIALIZED (SELECT q, uid, {_cost_sql(f"concat(hdr, chr(10), array_to_string(ls[1:kept], chr(10)), chr(10), {_MARK.format('kept')})")} AS cut_cost FROM kept{to}),
s{to} AS MATERIALIZED (SELECT {of}.*, coalesce(cut_cost, 0) AS cut_cost, row_number() OVER (PARTITION BY {of}.q, seed ORDER BY score DESC, {of}.uid) AS i FROM {of} LEFT JOIN cut{to} USING (q, uid)),
seeds{to} AS (SELECT q, 0 AS i, 0::BIGINT AS used, '' AS uid, '' AS level, 0::BIGINT AS cost, 0 AS packed FROM (SELECT DISTINCT q FROM s{to})
  UNION ALL SELECT q, i, used + cost, uid, level, cost, packed + (level <> 'dropped')::INT FROM (SELECT s.q, s.i::INT AS i, used, s.uid, packed,
    CASE WHEN full_cost <= 1440 AND used + full_cost <= 3600 THEN 'full' WHEN packed = 0 THEN 'truncated' ELSE 'dropped' END AS level,
    CASE WHEN full_cost <= 1440 AND used + full_cost <= 3600 THEN full_cost WHEN packed = 0 THEN cut_cost ELSE 0 END AS cost FROM seeds{to} p JOIN s{to} s ON s.q = p.q AND s.seed AND s.i = p.i + 1)),
stubs{to} AS (SELECT q, 0 AS i, 0::BIGINT AS used, '' AS uid, '' AS level, 0::BIGINT AS cost FROM (SELECT DISTINCT q FROM s{to})
  UNION ALL SELECT q, i, used + cost, uid, CASE WHEN over THEN 'dropped' ELSE 'stub' END, cost FROM (SELECT s.q, s.i::INT AS i, used, s.uid, used + stub_cost > 2400 AS over,
    CASE WHEN used + stub_cost > 2400 THEN 0 ELSE stub_cost END AS cost FROM stubs{to} p JOIN s{to} s ON s.q = p.q AND NOT s.seed AND s.i = p.i + 1))"""


_BLOCK_SQL = f"""WITH RECURSIVE {_BM25}, b AS MATERIALIZED (SELECT item_id AS q, CAST(doc_id AS VARCHAR) AS uid, score, rank <= 8 AS seed, {_HEADER} AS hdr, string_split(text, chr(10)) AS ls,
    {_cost_sql(f"concat({_HEADER}, chr(10), text)")} AS full_cost,
    {_cost_sql(f"concat_ws(chr(10), {_HEADER}, concat('document ', doc_id), CASE WHEN {_FIRST} <> '' THEN concat('    ', chr(34), chr(34), chr(34), {_FIRST}, chr(34), chr(34), chr(34)) END)")} AS stub_cost
  FROM ft JOIN documents USING (doc_id))"""
_PACK_SQL = f"""{_BLOCK_SQL}, {_pack_sql("b")}
SELECT q AS question_id, uid, level, cost FROM seeds WHERE i > 0 UNION ALL SELECT q, uid, level, cost FROM stubs WHERE i > 0"""


@query("packed_levels", _PACK_SQL)
def packed_levels(spark, sf):
    """Each block's level and cost in a budget of 6,000 tokens."""
    return packing.pack(_blocks(spark, sf), available=6000).select("question_id", "uid", "level", F.col("cost").cast("bigint").alias("cost"))


@query("packed_context")
def packed_context(spark, sf):
    """Questions packed into 6,000 tokens, with handles and the whole rendered text's token count."""
    packed = packing.pack(_blocks(spark, sf), available=6000)
    return packed.select("question_id", F.col("position").cast("bigint").alias("position"), "handle", "uid", "role", "level", F.col("cost").cast("bigint").alias("cost"),
                         F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


@query("packing_report")
def packing_report(spark, sf):
    return packing.packing_report(packing.pack(_blocks(spark, sf), available=6000), 6000)


@query("retry_delta", f"""{_BLOCK_SQL}, {_pack_sql("b")},
first AS (SELECT q, uid, level FROM seeds WHERE i > 0 UNION ALL SELECT q, uid, level FROM stubs WHERE i > 0),
b2 AS MATERIALIZED (SELECT b.q, b.uid, CASE WHEN level = 'dropped' THEN max(score) OVER (PARTITION BY b.q) + 1 ELSE score END AS score, seed OR level = 'dropped' AS seed, hdr, ls, full_cost, stub_cost
  FROM b JOIN first USING (q, uid) WHERE b.q IN (SELECT q FROM first WHERE level = 'dropped')), {_pack_sql("b2", "2")},
second AS (SELECT q, uid, level, cost FROM seeds2 WHERE i > 0 UNION ALL SELECT q, uid, level, cost FROM stubs2 WHERE i > 0)
SELECT q AS question_id, uid, level, cost FROM second s WHERE level <> 'dropped' AND NOT EXISTS (SELECT 1 FROM first f WHERE f.q = s.q AND f.uid = s.uid AND f.level <> 'dropped')""")
def retry_delta(spark, sf):
    """What a second context adds when all that was dropped from the first is promoted."""
    blocks = _blocks(spark, sf)
    ready = cut(packing.rendered(blocks, packing.per_seed(6000)))
    first = cut(packing.fold(ready, 6000))
    plan = first.filter("handle is null").select("question_id", F.lit("promote").alias("action"), "uid")
    second = RY.repack(ready, RY.second_blocks(blocks, plan), 6000)
    return RY.delta(first, second).select("question_id", "uid", "level", F.col("cost").cast("bigint").alias("cost"))
