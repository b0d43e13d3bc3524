"""Graph tables, degrees, traversals, bounded walks, expansion, entity and interval look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from symtrail.operators import entities as E, graph as G, keyed, maintenance as M
from symtrail.plans import demo_graph as D
from symtrail.plans.catalog import query
from symtrail.plans.demo_graph import table

_WITH = "WITH " + D.SQL


@query("graph_symbols", _WITH + "SELECT uid, kind, name, qualified_name, rel_path, start_line FROM sym")
def graph_symbols(spark, sf):
    return D.build_symbols(spark, sf).drop("repo_id")


@query("graph_edges", _WITH + "SELECT src, tgt, kind, origin_path FROM edge")
def graph_edges(spark, sf):
    return D.build_edges(spark, sf).drop("repo_id").dropDuplicates(["src", "kind", "origin_path", "tgt"])


@query("graph_degree", _WITH + "SELECT uid, CAST(degree AS BIGINT) degree FROM deg")
def graph_degree(spark, sf):
    return G.degrees(D.symbols(spark, sf), D.edges(spark, sf)).withColumn("degree", F.col("degree").cast("bigint"))


@query("graph_degree_of_touched", _WITH + """
, batch AS (SELECT DISTINCT concat('customer', o_custkey, '.py') rel_path FROM orders WHERE o_orderstatus = 'P'),
own AS (SELECT uid FROM sym WHERE rel_path IN (SELECT rel_path FROM batch)),
touched AS (SELECT uid FROM own UNION SELECT tgt FROM edge WHERE src IN (SELECT uid FROM own)
            UNION SELECT src FROM edge WHERE tgt IN (SELECT uid FROM own))
SELECT uid, CAST(degree AS BIGINT) degree FROM deg WHERE uid IN (SELECT uid FROM touched)""")
def graph_degree_of_touched(spark, sf):
    """Degrees a batch can change: files of customers with a pending order, and their neighbours."""
    symbols, edges = D.symbols(spark, sf), D.edges(spark, sf)
    paths = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.lit(D.REPO).alias("repo_id"), F.concat(F.lit("customer"), "o_custkey", F.lit(".py")).alias("rel_path")).distinct()
    blank = symbols.withColumn("degree", F.lit(None).cast("int"))
    return G.refresh_degrees(blank, edges, paths).filter("degree is not null").select("uid", F.col("degree").cast("bigint"))


@query("graph_stats", _WITH + """
SELECT 'shop' repo_id, (SELECT count(DISTINCT rel_path) FROM sym) files, (SELECT count(*) FROM sym) symbols,
       (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)) vectors, (SELECT count(*) FROM edge) edges""")
def graph_stats(spark, sf):
    symbols = D.symbols(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("P:"), "vec_id").alias("uid"), F.col("embedding").alias("code_vec"))
    files = symbols.select("repo_id", "rel_path").distinct()
    return G.stats(files, symbols.join(vectors, "uid", "left"), D.edges(spark, sf))


@query("graph_max_epoch", """
SELECT lang repo_id, max(e) max_epoch FROM (
  SELECT lang, CAST(n_chars AS BIGINT) e FROM documents
  UNION ALL SELECT lang, CAST(d.doc_id AS BIGINT) FROM documents d JOIN labels USING (doc_id)) GROUP BY lang""")
def graph_max_epoch(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.select(F.col("lang").alias("repo_id"), F.col("n_chars").alias("epoch"))
    labelled = docs.join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("repo_id"), F.col("doc_id").alias("epoch"))
    return G.max_epoch(files, labelled)


# -- traversals: one question per part, customer, or supplier ---------------------------------------

def _shown(spark, sf, prefix, rule):
    symbols, edges = D.symbols(spark, sf), D.edges(spark, sf)
    entities = symbols.filter(F.col("uid").startswith(prefix)).select(F.col("uid").alias("question_id"), "uid")
    related = G.traverse(entities, symbols, edges, rule)
    out = G.shown(related, symbols)
    return out.select("question_id", "uid", "via", F.col("position").cast("bigint").alias("position"), "related_total")


def _shown_sql(prefix, found):
    return _WITH + f""", ent AS (SELECT uid question_id, uid FROM sym WHERE uid LIKE '{prefix}%'),
found AS ({found}),
one AS (SELECT question_id, uid, min(via) via FROM found WHERE uid <> question_id GROUP BY 1, 2),
placed AS (SELECT o.*, row_number() OVER (PARTITION BY question_id ORDER BY rel_path, start_line, uid) AS position,
                  count(*) OVER (PARTITION BY question_id) related_total FROM one o JOIN sym USING (uid))
SELECT question_id, uid, via, position, related_total FROM placed WHERE position <= 50"""


_IN = "SELECT question_id, e.src uid, '' via FROM ent JOIN edge e ON e.tgt = ent.uid WHERE e.kind IN ({kinds})"
_OUT = "SELECT question_id, e.tgt uid, '' via FROM ent JOIN edge e ON e.src = ent.uid WHERE e.kind IN ({kinds})"
_OVER = """SELECT question_id, e1.tgt base FROM ent JOIN edge e1 ON e1.src = ent.uid AND e1.kind = 'OVERRIDES'
  UNION SELECT question_id, e2.tgt FROM ent JOIN edge e1 ON e1.src = ent.uid AND e1.kind = 'OVERRIDES'
    JOIN edge e2 ON e2.src = e1.tgt AND e2.kind = 'OVERRIDES'
  UNION SELECT question_id, e3.tgt FROM ent JOIN edge e1 ON e1.src = ent.uid AND e1.kind = 'OVERRIDES'
    JOIN edge e2 ON e2.src = e1.tgt AND e2.kind = 'OVERRIDES' JOIN edge e3 ON e3.src = e2.tgt AND e3.kind = 'OVERRIDES'"""


@query("callers_with_dispatch", _shown_sql("P:", _IN.format(kinds="'CALLS','INVOKES_HOOK'") + f"""
  UNION ALL SELECT b.question_id, e.src, s.qualified_name FROM ({_OVER}) b JOIN edge e ON e.tgt = b.base
  JOIN sym s ON s.uid = b.base WHERE e.kind IN ('CALLS','INVOKES_HOOK')"""))
def callers_with_dispatch(spark, sf):
    """What calls each part, directly or through a part it overrides."""
    return _shown(spark, sf, "P:", "callers")


@query("callees", _shown_sql("C:", _OUT.format(kinds="'CALLS','INVOKES_HOOK'")))
def callees(spark, sf):
    return _shown(spark, sf, "C:", "callees")


@query("usages", _shown_sql("P:", _IN.format(
    kinds="'CALLS','IMPORTS','INVOKES_HOOK','RENDERS','DISPATCHES_TO','USES_SERIALIZER','HAS_FIELD','INHERITS'")))
def usages(spark, sf):
    return _shown(spark, sf, "P:", "usages")


@query("definitions", _shown_sql("C:", _IN.format(kinds="'DEFINES'")))
def definitions(spark, sf):
    return _shown(spark, sf, "C:", "definition")


@query("importers_of_members", _WITH + """
, edge2 AS (SELECT src, tgt, CASE WHEN kind = 'CALLS' AND src LIKE 'C:%' THEN 'DEFINES' WHEN kind = 'CALLS' THEN 'IMPORTS' ELSE kind END kind FROM edge),
ent AS (SELECT uid question_id, uid FROM sym WHERE uid LIKE 'P:%'),
target AS (SELECT question_id, uid FROM ent UNION SELECT question_id, tgt FROM ent JOIN edge2 ON src = uid AND kind = 'DEFINES'),
found AS (SELECT DISTINCT question_id, src uid FROM target JOIN edge2 ON tgt = uid AND kind = 'IMPORTS'),
placed AS (SELECT f.*, row_number() OVER (PARTITION BY question_id ORDER BY rel_path, start_line, uid) AS position,
                  count(*) OVER (PARTITION BY question_id) related_total FROM found f JOIN sym USING (uid) WHERE uid <> question_id)
SELECT question_id, uid, position, related_total FROM placed WHERE position <= 50""")
def importers_of_members(spark, sf):
    """What imports each part or what it defines, with calls re-labelled as definitions and imports."""
    symbols = D.symbols(spark, sf)
    kind = F.when((F.col("kind") == "CALLS") & F.col("src").startswith("C:"), "DEFINES").when(
        F.col("kind") == "CALLS", "IMPORTS").otherwise(F.col("kind"))
    edges = D.edges(spark, sf).withColumn("kind", kind)
    entities = symbols.filter("uid like 'P:%'").select(F.col("uid").alias("question_id"), "uid")
    out = G.shown(G.traverse(entities, symbols, edges, "imports"), symbols)
    return out.select("question_id", "uid", F.col("position").cast("bigint").alias("position"), "related_total")


@query("routes_both_ways", _WITH + """
, edge2 AS (SELECT src, tgt FROM edge WHERE kind = 'DEFINES'),
found AS (SELECT tgt question_id, src uid FROM edge2 WHERE tgt LIKE 'N:%' UNION SELECT src, tgt FROM edge2 WHERE src LIKE 'N:%'),
placed AS (SELECT f.*, row_number() OVER (PARTITION BY question_id ORDER BY rel_path, start_line, uid) AS position,
                  count(*) OVER (PARTITION BY question_id) related_total FROM found f JOIN sym USING (uid))
SELECT question_id, uid, position, related_total FROM placed WHERE position <= 50""")
def routes_both_ways(spark, sf):
    """Both ends of route edges per nation, with definitions standing for dispatches."""
    symbols = D.symbols(spark, sf)
    edges = D.edges(spark, sf).filter("kind = 'DEFINES'").withColumn("kind", F.lit("DISPATCHES_TO"))
    entities = symbols.filter("uid like 'N:%'").select(F.col("uid").alias("question_id"), "uid")
    out = G.shown(G.traverse(entities, symbols, edges, "routes"), symbols)
    return out.select("question_id", "uid", F.col("position").cast("bigint").alias("position"), "related_total")


def _level_sql(n: int) -> str:
    below = f"found{n - 1}" if n > 1 else "start"
    used = "0" if n == 1 else f"(SELECT count(*) FROM seen{n - 1} s WHERE s.question_id = r.question_id AND s.lvl > 0)"
    return f"""
hop{n} AS (SELECT f.question_id, e.src uid, f.uid parent FROM {below} f JOIN step e ON e.tgt = f.uid
  UNION SELECT f.question_id, e.src, f.uid FROM {below} f JOIN reach o ON o.uid = f.uid JOIN step e ON e.tgt = o.base),
new{n} AS (SELECT h.question_id, h.uid, min(parent) parent FROM hop{n} h
  WHERE NOT EXISTS (SELECT 1 FROM seen{n - 1} s WHERE s.question_id = h.question_id AND s.uid = h.uid) GROUP BY 1, 2),
rank{n} AS (SELECT r.*, s.qualified_name, row_number() OVER (PARTITION BY question_id ORDER BY rel_path, start_line, r.uid) + {used} AS position
  FROM new{n} r JOIN sym s ON s.uid = r.uid),
cut{n} AS (SELECT *, max(position > 50) OVER (PARTITION BY question_id) truncated FROM rank{n}),
all{n} AS (SELECT c.question_id, c.uid, {n} AS lvl, c.position, concat(c.qualified_name, '<', b.path) path, c.truncated
  FROM cut{n} c JOIN {below} b ON b.question_id = c.question_id AND b.uid = c.parent WHERE c.position <= 50),
found{n} AS (SELECT * FROM all{n} WHERE NOT truncated),
seen{n} AS (SELECT question_id, uid, lvl FROM seen{n - 1} UNION ALL SELECT question_id, uid, lvl FROM all{n})"""


@query("impact_walk", _WITH + """, step AS (SELECT DISTINCT src, tgt FROM edge WHERE kind IN ('CALLS', 'INVOKES_HOOK', 'DEFINES')),
ent AS (SELECT uid question_id, uid FROM sym WHERE uid LIKE 'P:%'),
o AS (SELECT DISTINCT src, tgt FROM edge WHERE kind = 'OVERRIDES'),
reach AS (SELECT src uid, tgt base FROM o UNION SELECT a.src, b.tgt FROM o a JOIN o b ON b.src = a.tgt
  UNION SELECT a.src, c.tgt FROM o a JOIN o b ON b.src = a.tgt JOIN o c ON c.src = b.tgt),
start AS (SELECT question_id, e.uid, qualified_name path FROM ent e JOIN sym USING (uid)),
seen0 AS (SELECT question_id, uid, 0 AS lvl FROM start),""" + ",".join(_level_sql(n) for n in (1, 2, 3, 4)) + """,
every AS (SELECT * FROM all1 UNION ALL SELECT * FROM all2 UNION ALL SELECT * FROM all3 UNION ALL SELECT * FROM all4)
SELECT question_id, uid, CAST(lvl AS BIGINT) AS level, CAST(position AS BIGINT) AS position, path,
       max(truncated) OVER (PARTITION BY question_id) truncated FROM every""")
def impact_walk(spark, sf):
    """What reaches each part through calls and definitions: depth 4, at most 50, with paths."""
    symbols, edges = D.symbols(spark, sf), D.edges(spark, sf)
    entities = symbols.filter("uid like 'P:%'").select(F.col("uid").alias("question_id"), "uid")
    out = G.impact(entities, symbols, edges, kinds=("CALLS", "INVOKES_HOOK", "DEFINES"))
    return out.select("question_id", "uid", F.col("level").cast("bigint").alias("level"), F.col("position").cast("bigint").alias("position"),
                      F.array_join("path", "<").alias("path"), "truncated")


@query("neighbourhood_expansion", _WITH + """, seed AS (
  SELECT concat('C:', o_custkey) question_id, concat('O:', o_orderkey) seed FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders) WHERE rn <= 8),
near AS (SELECT e.src seed, e.tgt uid, e.kind FROM edge e UNION ALL SELECT e.tgt, e.src, e.kind FROM edge e),
kept AS (SELECT s.seed, n.uid, n.kind, d.degree, row_number() OVER (PARTITION BY s.seed ORDER BY d.degree, n.uid, n.kind) rn
  FROM (SELECT DISTINCT seed FROM seed) s JOIN near n ON n.seed = s.seed AND n.uid <> s.seed JOIN deg d ON d.uid = n.uid WHERE d.degree <= 100),
sup AS (SELECT q.question_id, k.uid, k.kind, k.degree, count(DISTINCT q.seed) n FROM seed q JOIN kept k ON k.seed = q.seed AND k.rn <= 25 GROUP BY ALL),
sc AS (SELECT question_id, uid, round(sum(n * CASE kind WHEN 'CALLS' THEN 1.0 WHEN 'DEFINES' THEN 0.8 WHEN 'OVERRIDES' THEN 0.6 WHEN 'IMPORTS' THEN 0.4 ELSE 0.5 END)
  / ln(2.0 + degree), 9) score FROM sup GROUP BY question_id, uid, degree),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, uid) AS position FROM sc)
SELECT question_id, uid, round(CAST(score AS DOUBLE), 6) score, position FROM r WHERE position <= 60""")
def neighbourhood_expansion(spark, sf):
    """Each customer's eight dearest orders as seeds, expanded one hop."""
    from pyspark.sql import Window as W
    symbols, edges = D.symbols(spark, sf), D.edges(spark, sf)
    order = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    seeds = table(spark, sf, "orders").withColumn("rn", F.row_number().over(order)).filter("rn <= 8").select(
        F.concat(F.lit("C:"), "o_custkey").alias("question_id"), F.concat(F.lit("O:"), "o_orderkey").alias("uid"))
    out = G.expand(seeds, symbols, edges)
    return out.select("question_id", "uid", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


# -- entities ---------------------------------------------------------------------------------------

_CATALOG = """named AS (SELECT concat('P:', p_partkey) uid, replace(p_name, ' ', '_') AS name,
  concat(lower(replace(p_brand, '#', '')), '.', lower(p_type), p_size % 5, '.', replace(p_name, ' ', '_')) qualified_name FROM part),
asked AS (SELECT concat('Q:', p_partkey) question_id, CASE p_partkey % 3 WHEN 0 THEN qualified_name WHEN 1 THEN name
  ELSE regexp_replace(qualified_name, '^[^.]*\\.', '') END term FROM part JOIN named ON uid = concat('P:', p_partkey))"""


def _catalog(spark, sf):
    parts = table(spark, sf, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    qname = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("."), F.lower("p_type"), F.col("p_size") % 5, F.lit("."), name)
    symbols = parts.select(F.lit(D.REPO).alias("repo_id"), F.concat(F.lit("P:"), "p_partkey").alias("uid"), name.alias("name"), qname.alias("qualified_name"))
    term = F.when(F.col("p_partkey") % 3 == 0, qname).when(F.col("p_partkey") % 3 == 1, name).otherwise(
        F.regexp_replace(qname, r"^[^.]*\.", ""))
    questions = parts.select(F.lit(D.REPO).alias("repo_id"), F.concat(F.lit("Q:"), "p_partkey").alias("question_id"),
                             F.concat(F.lit("what calls `"), term, F.lit("` in the code")).alias("query"))
    return questions, symbols


@query("entity_resolution", "WITH " + _CATALOG + """,
hit AS (SELECT a.question_id, a.term, n.qualified_name, n.qualified_name = a.term exact FROM asked a JOIN named n
  ON n.name = regexp_extract(a.term, '[^.]*$') AND (n.qualified_name = a.term OR n.name = a.term OR n.qualified_name LIKE concat('%.', replace(a.term, '_', '\\_')) ESCAPE '\\')),
agg AS (SELECT question_id, term, count(*) n, count_if(exact) ne, count(DISTINCT qualified_name) nq FROM hit GROUP BY 1, 2)
SELECT question_id, a.term, CASE WHEN n IS NULL THEN 'unresolved' WHEN ne = 0 AND nq > 1 THEN 'ambiguous'
  WHEN (CASE WHEN ne > 0 THEN ne ELSE n END) > 8 THEN 'too_many' ELSE 'resolved' END verdict,
  CAST(CASE WHEN ne > 0 THEN ne ELSE n END AS BIGINT) candidates FROM asked a LEFT JOIN agg USING (question_id)""")
def entity_resolution(spark, sf):
    """A question per part names it in full, by leaf, or by suffix; repeated names are refused."""
    questions, symbols = _catalog(spark, sf)
    return E.resolve(questions, symbols).select("question_id", "term", "verdict", "candidates")


_TENANTS = _CATALOG.replace("concat('P:', p_partkey) uid,", "concat('P:', p_partkey) uid, p_partkey % 2 AS r,").replace(
    "concat('Q:', p_partkey) question_id,", "concat('Q:', p_partkey) question_id, p_partkey // 2 % 2 AS r,")


@query("entity_resolution_tenants", "WITH " + _TENANTS + """,
hit AS (SELECT a.question_id, a.term, n.qualified_name, n.qualified_name = a.term exact FROM asked a JOIN named n
  ON a.r = n.r AND n.name = regexp_extract(a.term, '[^.]*$') AND (n.qualified_name = a.term OR n.name = a.term OR n.qualified_name LIKE concat('%.', replace(a.term, '_', '\\_')) ESCAPE '\\')),
agg AS (SELECT question_id, term, count(*) n, count_if(exact) ne, count(DISTINCT qualified_name) nq FROM hit GROUP BY 1, 2)
SELECT question_id, CASE WHEN n IS NOT NULL THEN a.term END AS term, CASE WHEN n IS NULL THEN 'unresolved' WHEN ne = 0 AND nq > 1 THEN 'ambiguous'
  WHEN (CASE WHEN ne > 0 THEN ne ELSE n END) > 8 THEN 'too_many' ELSE 'resolved' END verdict,
  CAST(CASE WHEN ne > 0 THEN ne ELSE n END AS BIGINT) candidates FROM asked a LEFT JOIN agg USING (question_id)""")
def entity_resolution_tenants(spark, sf):
    """Parts in two repositories, and questions about them asked in either: names of the other one do not count."""
    questions, symbols = _catalog(spark, sf)
    key = lambda c: F.regexp_extract(c, "[0-9]+$", 0).cast("bigint")
    symbols = symbols.withColumn("repo_id", (key("uid") % 2).cast("string"))
    questions = questions.withColumn("repo_id", (F.floor(key("question_id") / 2) % 2).cast("string"))
    return E.resolve(questions, symbols).select("question_id", "term", "verdict", "candidates")


@query("entity_uids", "WITH " + _CATALOG + """,
hit AS (SELECT a.question_id, a.term, n.uid, n.qualified_name, n.qualified_name = a.term exact FROM asked a JOIN named n
  ON n.name = regexp_extract(a.term, '[^.]*$') AND (n.qualified_name = a.term OR n.name = a.term OR n.qualified_name LIKE concat('%.', replace(a.term, '_', '\\_')) ESCAPE '\\')),
agg AS (SELECT question_id, count(*) n, count_if(exact) ne, count(DISTINCT qualified_name) nq FROM hit GROUP BY 1)
SELECT h.question_id, h.uid, h.qualified_name FROM hit h JOIN agg USING (question_id)
WHERE (ne > 0 AND exact AND ne <= 8) OR (ne = 0 AND nq = 1 AND n <= 8)""")
def entity_uids(spark, sf):
    questions, symbols = _catalog(spark, sf)
    return E.entity_uids(E.resolve(questions, symbols), symbols)


# -- intervals and as-of -----------------------------------------------------------------------------

@query("innermost_interval", """
WITH iv AS (SELECT o_custkey, o_orderkey uid, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) s,
    date_diff('day', DATE '1990-01-01', CAST(max(l_shipdate) AS DATE)) e
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate),
pt AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hit AS (SELECT pt.o_custkey, p, uid, s, e, row_number() OVER (PARTITION BY pt.o_custkey, p ORDER BY s DESC, e, uid) rn
  FROM pt LEFT JOIN iv ON iv.o_custkey = pt.o_custkey AND s <= e AND s <= p AND p <= e)
SELECT o_custkey, CAST(p AS BIGINT) AS at, CAST(uid AS BIGINT) uid, CAST(s AS BIGINT) start_line, CAST(e AS BIGINT) end_line FROM hit WHERE rn = 1""")
def innermost_interval(spark, sf):
    """The latest-started order still open at each shipping date, per customer."""
    day = lambda c: F.datediff(F.col(c), F.lit("1990-01-01")).cast("bigint")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = items.join(orders, items.l_orderkey == orders.o_orderkey)
    spans = both.groupBy("o_custkey", F.col("o_orderkey").alias("uid"), day("o_orderdate").alias("start_line")).agg(
        F.max(day("l_shipdate")).alias("end_line"))
    points = both.select("o_custkey", day("l_shipdate").alias("at")).distinct()
    return keyed.innermost(points, spans, ["o_custkey"], "at", "start_line", "end_line", ["uid"])\
        .select("o_custkey", "at", "uid", "start_line", "end_line")


@query("as_of_event", """
WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), a AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'view')
SELECT a.event_id, a.user_id, v.event_id AS view_id FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.ts >= v.ts""")
def as_of_event(spark, sf):
    """The last view at or before every other event of the same user."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    rest = events.filter("event_type <> 'view'").drop("event_type")
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    return keyed.as_of(rest, views, ["user_id"], "ts", "ts", ["view_id"], hour, tie="view_id").select("event_id", "user_id", "view_id")


@query("overload_ordinal", """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS ordinal FROM lineitem""")
def overload_ordinal(spark, sf):
    """A running number within (part, supplier) in source order, bucketed so no pair is one task."""
    items = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    out = keyed.numbered(items, ["l_partkey", "l_suppkey"], F.floor(F.col("l_orderkey") / 1_000_000),
                         [F.col("l_orderkey"), F.col("l_linenumber")], "ordinal")
    return out.withColumn("ordinal", F.col("ordinal") - 1)
