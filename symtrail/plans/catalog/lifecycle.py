"""Snapshots, moves, merges, bursts and caches over tables that stand for file trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from symtrail import schema as SC
from symtrail.functions import paths as P, text as X
from symtrail.operators import maintenance as M, sessions as S
from symtrail.plans import code_corpus as C, demo_graph as D
from symtrail.plans.catalog import query
from symtrail.plans.demo_graph import table
from symtrail.session import shared_dir, table_schema
from symtrail.sources import parse
from symtrail.sources.snapshots import Snapshots, conform
from symtrail.streaming import bursts, quiet


def _path():
    return F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))


_PATH = "concat(lang, '/', source, '/', doc_id, '.txt')"


@query("reconcile_diff", f"""
WITH t AS (SELECT {_PATH} AS p, sha256(text || CASE WHEN toxic = 1 THEN 'x' ELSE '' END) AS h FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0),
k AS (SELECT {_PATH} AS p, sha256(text) AS h FROM documents JOIN labels USING (doc_id))
SELECT coalesce(t.p, k.p) AS rel_path, CASE WHEN k.h IS NULL THEN 'added' WHEN t.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM t FULL OUTER JOIN k ON t.p = k.p WHERE t.h IS DISTINCT FROM k.h""")
def reconcile_diff(spark, sf):
    """Labelled documents are stored; the tree lacks low-quality ones and has toxic ones edited."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    both = docs.join(labels, "doc_id", "left").select(F.lit("docs").alias("repo_id"), _path().alias("rel_path"), "text", "quality", "toxic")
    tree = both.filter("quality is null or quality <> 0").withColumn(
        "content_hash", X.content_hash(F.concat("text", F.when(F.col("toxic") == 1, "x").otherwise(""))))
    known = both.filter("quality is not null").withColumn("content_hash", X.content_hash(F.col("text")))
    return M.reconcile_diff(tree, known).select("rel_path", "change")


@query("poll_diff", """
WITH b AS (SELECT concat('u', user_id) AS p, max(event_id) AS m, count(*) AS s, max(event_id) % 3 <> 0 AS ok FROM events WHERE value < 40 GROUP BY user_id),
a AS (SELECT concat('u', user_id) AS p, max(event_id) AS m, count(*) AS s, min(event_id) % 4 <> 0 AS ok FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT * FROM (SELECT coalesce(a.p, b.p) AS rel_path, CASE WHEN coalesce(b.ok, false) AND NOT coalesce(a.ok, false) THEN 'removed'
  WHEN coalesce(a.ok, false) AND ((a.m, a.s) IS DISTINCT FROM (b.m, b.s) OR NOT coalesce(b.ok, false)) AND a.s IS DISTINCT FROM b.s THEN 'saved' END AS change FROM a FULL OUTER JOIN b ON a.p = b.p) WHERE change IS NOT NULL""")
def poll_diff(spark, sf):
    """Two stat snapshots of per-user files, one taken of cheap events and one of all but errors."""
    events = table(spark, sf, "events")
    def snap(df, allowed):
        return df.groupBy(F.lit("events").alias("repo_id"), F.concat(F.lit("u"), "user_id").alias("rel_path")).agg(
            F.max("event_id").alias("mtime_ns"), F.count(F.lit(1)).alias("size"), allowed.alias("allowed")).withColumn(
                "content_hash", F.col("size").cast("string"))
    before = snap(events.filter("value < 40"), F.max("event_id") % 3 != 0)
    after = snap(events.filter("event_type <> 'error'"), F.min("event_id") % 4 != 0)
    return M.poll_diff(before, after, before.select("repo_id", "rel_path", "content_hash")).drop("repo_id")


_MOVES = "SELECT event_type AS r, event_id AS seq, concat('f', user_id) AS o, concat('f', CAST(json_extract(props, '$.k') AS INTEGER)) AS n FROM events"


_COLLAPSED = f"""
WITH RECURSIVE m AS ({_MOVES}), t AS (SELECT r, o AS p, seq * 2 AS at_, CAST(NULL AS BIGINT) AS by_ FROM m UNION ALL SELECT r, n, seq * 2 + 1, seq FROM m),
l AS (SELECT p, at_, by_, lag(by_) OVER (PARTITION BY r, p ORDER BY at_) AS prev FROM t),
link AS MATERIALIZED (SELECT m.seq, m.o, m.n, l.prev FROM m JOIN l ON l.p = m.o AND l.at_ = m.seq * 2),
survive AS (SELECT arg_max(by_, at_) AS seq FROM t GROUP BY r, p HAVING arg_max(coalesce(by_, -1), at_) >= 0),
walk(seq, cur) AS (SELECT seq, seq FROM survive UNION ALL SELECT w.seq, k.prev FROM walk w JOIN link k ON k.seq = w.cur WHERE k.prev IS NOT NULL),
root AS (SELECT w.seq, k.o AS origin FROM walk w JOIN link k ON k.seq = w.cur WHERE k.prev IS NULL)
SELECT r AS repo_id, origin AS old_path, n AS new_path FROM root JOIN m USING (seq) WHERE origin <> n"""


def _moves(spark, sf, repo):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        repo.alias("repo_id"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), "user_id").alias("old_path"), F.concat(F.lit("f"), k).alias("new_path"))


@query("collapsed_moves", _COLLAPSED.replace("event_type AS r", "'events' AS r").replace("r AS repo_id, ", ""))
def collapsed_moves(spark, sf):
    """Every event moves a file from its user's name to the name in its properties."""
    return M.collapse_chains(_moves(spark, sf, F.lit("events"))).drop("repo_id")


@query("tenant_moves", _COLLAPSED)
def tenant_moves(spark, sf):
    """The same moves in one repository for each event type: equal paths of different repositories stay apart."""
    return M.collapse_chains(_moves(spark, sf, F.col("event_type")))


@query("undetected_moves", f"""
WITH RECURSIVE d AS (SELECT {_PATH} AS p, sha256(text) AS h, concat(lang, n_chars) AS g, doc_id IN (SELECT doc_id FROM labels) AS old FROM documents),
ids AS (SELECT p, old, unnest([h, g]) AS x FROM d), cand AS (SELECT DISTINCT o.p AS o, n.p AS n FROM ids o JOIN ids n USING (x) WHERE o.old AND NOT n.old),
olds AS MATERIALIZED (SELECT o, row_number() OVER (ORDER BY o) AS i FROM (SELECT DISTINCT o FROM cand)), ci AS MATERIALIZED (SELECT i, n FROM cand JOIN olds USING (o)),
st(i, used, got) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR UNION ALL SELECT i + 1, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, g FROM (
  SELECT st.i, st.used, (SELECT min(n) FROM ci WHERE ci.i = st.i + 1 AND NOT list_contains(st.used, n)) AS g FROM st WHERE st.i < (SELECT count(*) FROM olds)))
SELECT o AS old_path, got AS new_path FROM st JOIN olds USING (i) WHERE got IS NOT NULL""")
def undetected_moves(spark, sf):
    """Labelled documents deleted, the others added; equal texts, or equal language and length, match."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    ids = docs.select(_path().alias("rel_path"), "l", F.explode(F.array(F.sha2(F.col("text").cast("binary"), 256), F.concat("lang", "n_chars"))).alias("identity"))
    return M.undetected_moves(ids.filter("l is not null").drop("l"), ids.filter("l is null").drop("l"))


def _moved(k, qname, arity):
    return f"substr(sha1(concat('shop', chr(0), 'moved/m', {k}, '.py', chr(0), {qname}, chr(0), {arity}, chr(0), 0)), 1, 20)"


def _stayed(k, qname, arity):
    return f"substr(sha1(concat('shop', chr(0), 'shop/g', {k} % 20, '/m', {k}, '.py', chr(0), {qname}, chr(0), {arity}, chr(0), 0)), 1, 20)"


@query("uid_remaps", "WITH n AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS k, {tail} AS tail, {arity} AS arity FROM part WHERE {cond}" for tail, arity, cond in (
        ("''", 0, "true"), ("concat('.Part', p_partkey)", 0, "true"), ("concat('.Part', p_partkey, '.price')", 1, "true"),
        ("concat('.Part', p_partkey, '.weigh')", 1, "p_partkey % 3 = 0"), ("concat('.Part', p_partkey, '.base_weight')", 1, "p_partkey = 0"),
        ("concat('.make', p_partkey)", 1, "true"))) + f""")
SELECT {_stayed('k', "concat('shop.g', k % 20, '.m', k, tail)", 'arity')} AS old_uid, {_moved('k', "concat('moved.m', k, tail)", 'arity')} AS new_uid,
 concat('shop/g', k % 20, '/m', k, '.py') AS old_path, concat('moved/m', k, '.py') AS new_path FROM n""")
def uid_remaps(spark, sf):
    """Every module moves to one folder: the same bytes parsed at both paths give the uid pairs."""
    files = C.files(spark, sf)
    new_path = F.concat(F.lit("moved/"), F.regexp_extract("rel_path", "[^/]*$", 0))
    moves = files.select("repo_id", F.col("rel_path").alias("old_path"), new_path.alias("new_path"))
    parsed = lambda f: parse.symbols(parse.facts(f)).select("repo_id", "rel_path", "seq", "uid", "kind", "arity", "ordinal", "name")
    return M.remaps(moves, parsed(files), parsed(files.withColumn("rel_path", new_path))).drop("repo_id")


@query("symbol_upsert", """
WITH old AS (SELECT doc_id AS uid, lang, CAST(CASE WHEN n_chars % 2 = 0 THEN n_chars END AS BIGINT) AS size, 1::BIGINT AS epoch, 1::BIGINT AS created_epoch FROM documents),
new AS (SELECT CASE WHEN toxic = 1 THEN doc_id + 1000000 ELSE doc_id END AS uid, CASE WHEN quality = 1 THEN doc_id END AS size, 2::BIGINT AS epoch FROM labels)
SELECT uid, lang, coalesce(new.size, old.size) AS size, coalesce(new.epoch, old.epoch) AS epoch, coalesce(old.created_epoch, 2) AS created_epoch FROM old FULL OUTER JOIN new USING (uid)""")
def symbol_upsert(spark, sf):
    """Labels merged onto documents: nulls keep the old value, new rows get the batch epoch."""
    old = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "lang", F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).alias("size"),
                                               F.lit(1).cast("bigint").alias("epoch"), F.lit(1).cast("bigint").alias("created_epoch"))
    new = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("uid"),
                                            F.when(F.col("quality") == 1, F.col("doc_id")).alias("size"), F.lit(2).cast("bigint").alias("epoch"))
    return M.upsert(old, new, ["uid"], created=True, epoch=2)


# -- one incremental batch on the demo graph: files of customers with a pending order -----------------

_BATCH = "WITH " + D.SQL + """,
paths AS (SELECT DISTINCT concat('customer', o_custkey, '.py') AS p FROM orders WHERE o_orderstatus = 'P'),
s2 AS (SELECT s.*, CASE WHEN o.o_orderstatus IN ('P', 'O') AND rel_path IN (SELECT p FROM paths) THEN 2 ELSE 1 END AS epoch FROM sym s LEFT JOIN orders o ON s.uid = concat('O:', o_orderkey)),
e2 AS (SELECT e.*, CASE WHEN s2.epoch = 2 AND e.tgt <= 'P:5' THEN 2 ELSE 1 END AS epoch FROM edge e JOIN s2 ON s2.uid = e.src),
orphan AS (SELECT uid FROM s2 WHERE epoch < 2 AND rel_path IN (SELECT p FROM paths))"""


def _batch(spark, sf):
    orders = table(spark, sf, "orders")
    paths = orders.filter("o_orderstatus = 'P'").select(F.lit(D.REPO).alias("repo_id"), F.concat(F.lit("customer"), "o_custkey", F.lit(".py")).alias("rel_path")).distinct()
    fresh = orders.filter("o_orderstatus in ('P', 'O')").select(F.concat(F.lit("O:"), "o_orderkey").alias("uid"), F.lit(True).alias("_fresh"))
    inside = paths.withColumn("_in", F.lit(True))
    symbols = D.symbols(spark, sf).join(fresh, "uid", "left").join(inside, ["repo_id", "rel_path"], "left").withColumn(
        "epoch", F.when(F.col("_fresh") & F.col("_in"), 2).otherwise(1).cast("bigint")).drop("_fresh", "_in").withColumn("origin_path", F.col("rel_path"))
    edges = D.edges(spark, sf).join(symbols.select(F.col("uid").alias("src"), F.col("epoch").alias("_e")), "src").withColumn(
        "epoch", F.when((F.col("_e") == 2) & (F.col("tgt") <= "P:5"), 2).otherwise(1).cast("bigint")).drop("_e")
    files = symbols.groupBy("repo_id", "rel_path").agg(F.max("epoch").alias("epoch"))
    return M.Graph(files, symbols, edges), paths


@query("stale_edges_removed", _BATCH + """
SELECT src, tgt, kind FROM e2 WHERE NOT (epoch < 2 AND src IN (SELECT uid FROM s2 WHERE rel_path IN (SELECT p FROM paths)))""")
def stale_edges_removed(spark, sf):
    graph, paths = _batch(spark, sf)
    return M.without_stale_edges(graph.edges, graph.symbols, paths, 2).select("src", "tgt", "kind")


@query("orphans_removed", _BATCH + """
SELECT 'symbol' AS what, uid AS id FROM s2 WHERE uid NOT IN (SELECT uid FROM orphan)
UNION ALL SELECT 'edge', concat(src, '>', tgt, '>', kind) FROM e2 WHERE src NOT IN (SELECT uid FROM orphan) AND tgt NOT IN (SELECT uid FROM orphan)
UNION ALL SELECT 'file', rel_path FROM s2 GROUP BY rel_path HAVING NOT (max(epoch) < 2 AND rel_path IN (SELECT p FROM paths))""")
def orphans_removed(spark, sf):
    graph, paths = _batch(spark, sf)
    out = M.without_orphans(graph, paths, 2)
    row = lambda df, what, id_: df.select(F.lit(what).alias("what"), id_.alias("id"))
    return row(out.symbols, "symbol", F.col("uid")).unionByName(
        row(out.edges, "edge", F.concat_ws(">", "src", "tgt", "kind"))).unionByName(row(out.files, "file", F.col("rel_path")))


@query("relink_paths", _BATCH + """
SELECT DISTINCT c.rel_path FROM edge e JOIN orphan o ON o.uid = e.tgt JOIN s2 c ON c.uid = e.src WHERE c.rel_path NOT IN (SELECT p FROM paths)""")
def relink_paths(spark, sf):
    graph, paths = _batch(spark, sf)
    return M.outside_callers(graph, paths, 2).select("rel_path")


@query("edge_upsert", _BATCH + """
, n AS (SELECT concat('S:', l_suppkey) AS src, concat('P:', l_partkey) AS tgt, 'CALLS' AS kind, 'x.py' AS origin_path FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT src, concat('Z', tgt), kind, origin_path FROM edge WHERE kind = 'DEFINES' UNION SELECT src, tgt, kind, origin_path FROM edge WHERE kind = 'DEFINES'),
good AS (SELECT * FROM n WHERE src IN (SELECT uid FROM sym) AND tgt IN (SELECT uid FROM sym))
SELECT src, tgt, kind, origin_path, CAST(2 AS BIGINT) AS epoch FROM good
UNION ALL SELECT src, tgt, kind, origin_path, CAST(epoch AS BIGINT) FROM e2 WHERE (src, tgt, kind, origin_path) NOT IN (SELECT (src, tgt, kind, origin_path) FROM good)""")
def edge_upsert(spark, sf):
    """New edges merged by key: repeated ones take the new epoch, dangling ones are dropped."""
    graph, _ = _batch(spark, sf)
    repo = F.lit(D.REPO).alias("repo_id")
    calls = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(repo, F.concat(F.lit("S:"), "l_suppkey").alias("src"), F.concat(F.lit("P:"), "l_partkey").alias("tgt"),
                                                                         F.lit("CALLS").alias("kind"), F.lit("x.py").alias("origin_path"))
    defined = D.edges(spark, sf).filter("kind = 'DEFINES'").select("repo_id", "src", "tgt", "kind", "origin_path")
    new = calls.unionByName(defined).unionByName(defined.withColumn("tgt", F.concat(F.lit("Z"), "tgt")))
    return M.upsert_edges(graph.edges, new, graph.symbols, 2).drop("repo_id")


@query("remap_in_place", "WITH " + D.SQL + """,
m AS (SELECT concat('P:', p_partkey) AS o, CASE WHEN p_size > 25 THEN concat('Z:', p_partkey) ELSE concat('P:', p_partkey + 1) END AS n, concat(p_brand, '.py') AS op, concat('moved_', p_brand, '.py') AS np FROM part),
u AS (SELECT * FROM m WHERE n NOT IN (SELECT uid FROM sym)),
e AS (SELECT coalesce(a.n, src) AS src, coalesce(b.n, tgt) AS tgt, kind, origin_path FROM edge LEFT JOIN u a ON a.o = src LEFT JOIN u b ON b.o = tgt)
SELECT 'symbol' AS what, concat_ws('>', coalesce(u.n, uid), coalesce(u.np, rel_path)) AS id FROM sym LEFT JOIN u ON u.o = uid
UNION ALL SELECT 'edge', concat_ws('>', src, tgt, kind, CASE WHEN m.op = origin_path THEN m.np ELSE origin_path END) FROM e LEFT JOIN m ON m.n = e.src
UNION ALL SELECT 'file', coalesce((SELECT any_value(np) FROM m WHERE op = f.rel_path), f.rel_path) FROM (SELECT DISTINCT rel_path FROM sym) f""")
def remap_in_place(spark, sf):
    """Large parts get new uids and files; a uid that is taken is left alone."""
    symbols = D.symbols(spark, sf).withColumn("epoch", F.lit(1).cast("bigint")).withColumn("origin_path", F.col("rel_path"))
    edges = D.edges(spark, sf).withColumn("epoch", F.lit(1).cast("bigint"))
    files = symbols.select("repo_id", "rel_path", "epoch").distinct()
    key = F.col("p_partkey")
    mapping = table(spark, sf, "part").select(
        F.lit(D.REPO).alias("repo_id"), F.concat(F.lit("P:"), key).alias("old_uid"), F.when(F.col("p_size") > 25, F.concat(F.lit("Z:"), key)).otherwise(F.concat(F.lit("P:"), key + 1)).alias("new_uid"),
        F.concat("p_brand", F.lit(".py")).alias("old_path"), F.concat(F.lit("moved_"), "p_brand", F.lit(".py")).alias("new_path"))
    out = M.apply_remaps(M.Graph(files, symbols, edges), mapping, 2)
    row = lambda df, what, *cols: df.select(F.lit(what).alias("what"), F.concat_ws(">", *cols).alias("id"))
    return row(out.symbols, "symbol", "uid", "rel_path").unionByName(row(out.edges, "edge", "src", "tgt", "kind", "origin_path")).unionByName(
        row(out.files, "file", "rel_path"))


@query("merged_snapshot", "WITH " + D.SQL + """,
dead AS (SELECT uid FROM sym WHERE uid IN (SELECT concat('P:', p_partkey) FROM part WHERE p_size = 7)),
s AS (SELECT uid, CASE WHEN uid IN (SELECT concat('P:', p_partkey) FROM part WHERE p_size > 45) THEN concat(qualified_name, '_v2') ELSE qualified_name END AS q FROM sym WHERE uid NOT IN (SELECT uid FROM dead)),
e AS (SELECT DISTINCT src, tgt, kind, origin_path FROM edge WHERE src NOT IN (SELECT uid FROM dead) AND tgt NOT IN (SELECT uid FROM dead))
SELECT 'symbol' AS what, concat_ws('>', uid, q) AS id FROM s UNION ALL SELECT 'edge', concat_ws('>', src, tgt, kind, origin_path) FROM e""")
def merged_snapshot(spark, sf):
    """A store written whole, then twice by changes: large parts are renamed, and those of one size go with their
    edges.  Readers put the parts together."""
    store = Snapshots(spark, f"{shared_dir(spark)}/symtrail-stores/{uuid.uuid4().hex}")
    repo = F.lit(D.REPO).alias("repo_id")
    symbols = conform(D.symbols(spark, sf), SC.SYMBOLS)
    edges = conform(D.edges(spark, sf).withColumn("repo_id", repo), SC.EDGES).dropDuplicates(SC.EDGE_KEY)
    files = conform(symbols.select("repo_id", "rel_path").distinct(), SC.FILES)
    one = spark.createDataFrame([(D.REPO,)], "repo_id string")
    store.commit(M.Graph(files, symbols, edges), 1, one)
    parts = lambda condition: table(spark, sf, "part").filter(condition).select(F.concat(F.lit("P:"), "p_partkey").alias("uid"))
    large = parts("p_size > 45").withColumn("_large", F.lit(True))
    renamed = symbols.join(large, "uid", "left").withColumn(
        "qualified_name", F.when(F.col("_large"), F.concat("qualified_name", F.lit("_v2"))).otherwise(F.col("qualified_name"))).drop("_large")
    store.commit(M.Graph(files, renamed, edges), 2, one)
    now, dead = store.read(), parts("p_size = 7")
    left = now.edges.join(dead.withColumnRenamed("uid", "src"), "src", "left_anti").join(dead.withColumnRenamed("uid", "tgt"), "tgt", "left_anti")
    store.commit(M.Graph(now.files, now.symbols.join(dead, "uid", "left_anti"), left), 3, one)
    row = lambda df, what, *cols: df.select(F.lit(what).alias("what"), F.concat_ws(">", *cols).alias("id"))
    out = store.read()
    return row(out.symbols, "symbol", "uid", "qualified_name").unionByName(row(out.edges, "edge", "src", "tgt", "kind", "origin_path"))


# -- bursts -------------------------------------------------------------------------------------------

_BURST = """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 3600 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)"""


_FLUSHED = _BURST + """
, f AS (SELECT *, min(ts) OVER (PARTITION BY user_id, burst) AS flush_start FROM b)
SELECT user_id, flush_start, event_type AS path, count(*) AS writes, arg_max(event_id, (ts, event_id)) AS event_id FROM f GROUP BY user_id, flush_start, event_type"""


@query("debounced_flushes", _FLUSHED)
def debounced_flushes(spark, sf):
    """Saves per user gathered until an hour passes in silence; the last save per path wins."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("path"))
    return S.flushes(events, ["user_id"], "path", "ts", "event_id", 3600).drop("ts")


@query("quiet_flushes", _FLUSHED)
def quiet_flushes(spark, sf):
    """The same flushes from a stream with a timer per user that every event arms again."""
    base = f"{shared_dir(spark)}/symtrail-streams/{uuid.uuid4().hex}"
    events = spark.readStream.schema(table_schema(spark, f"{sf}/events.parquet")).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = quiet.run_once(spark, events, base, ["user_id"], F.col("event_type"), "ts", "event_id", 3600, "1 minute")
    kind = events.schema["ts"].dataType
    return out.select("user_id", F.col("flush_start").cast(kind).alias("flush_start"), F.col("slot").alias("path"), "writes", "event_id")


@query("streamed_bursts", _BURST + """
, s AS (SELECT user_id, min(ts) AS flush_start, max(ts) AS last_ts, count(*) AS writes, max(event_id) AS last_event FROM b GROUP BY user_id, burst)
SELECT user_id, flush_start, writes, last_event FROM s""")
def streamed_bursts(spark, sf):
    """The same bursts from a file stream with a watermark; those still open at its end are drained."""
    return bursts.run_once(spark, f"{sf}/events.parquet", "user_id", "ts", "1 hour", "1 minute")


# -- cache -----------------------------------------------------------------------------------------------

@query("cache_split", """
WITH d AS (SELECT doc_id, sha256(text) AS k, l.doc_id IS NOT NULL AS lab, toxic FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) l USING (doc_id)),
c AS (SELECT DISTINCT k FROM d WHERE lab)
SELECT lang, count(*) AS lookups, count_if(k IN (SELECT k FROM c)) AS hits, count_if(k NOT IN (SELECT k FROM c) AND n_chars % 2 = 0) AS header_only FROM documents JOIN d USING (doc_id) GROUP BY lang""")
def cache_split(spark, sf):
    """Labelled texts are cached; even-sized documents have an unchanged stored body."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uid"), "doc_id", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("cache_key"))
    docs = docs.withColumn("body_hash", F.col("cache_key"))
    cache = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("cache_key").distinct().select(
        F.lit("m").alias("model"), "cache_key", F.array(F.lit(1.0).cast("float")).alias("vector"))
    stored = docs.select("uid", F.when(F.col("n_chars") % 2 == 0, F.col("body_hash")).alias("body_hash"))
    out = M.cache_split(docs, cache, "m", stored)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"), F.count_if("header_only").alias("header_only"))


@query("safe_paths", r"""
SELECT page_id, regexp_replace(replace(p, '\', '/'), '^(\./|/)+', '') AS rel_path, p = '' OR regexp_matches(replace(p, '\', '/'), '^/|^[A-Za-z]:|(^|/)\.\.(/|$)') AS unsafe
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN './' || u WHEN 1 THEN '../' || u WHEN 2 THEN replace(u, '/', '\') ELSE '/' || u END AS p FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages))""")
def safe_paths(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 4
    path = (F.when(kind == 0, F.concat(F.lit("./"), bare)).when(kind == 1, F.concat(F.lit("../"), bare))
            .when(kind == 2, F.translate(bare, "/", "\\")).otherwise(F.concat(F.lit("/"), bare)))
    return table(spark, sf, "pages").select("page_id", path.alias("p")).select(
        "page_id", P.normalize(F.col("p")).alias("rel_path"), P.is_unsafe(F.col("p")).alias("unsafe"))
