"""Hashes, identifiers, tokens, redaction, routing, traces, mappings and vectors over text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from symtrail import constants as K
from symtrail.functions import paths as P, questions as Q, text as X, vectors as V
from symtrail.operators import frames as FR, packing
from symtrail.plans.catalog import query
from symtrail.plans.demo_graph import table, texts
from symtrail.session import stored


def _lit_list(words):
    return ", ".join("'" + w + "'" for w in words)


# -- hashes -------------------------------------------------------------------------------------

@query("content_hash", "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS content_hash FROM documents")
def content_hash(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("body_hash", r"""
SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t\r\f\v]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')), 1, 20) AS body_hash
FROM documents""")
def body_hash(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select("doc_id", X.body_hash(F.col("text")).alias("body_hash"))


@query("symbol_uid", """
SELECT l_orderkey, l_linenumber, substr(sha1(concat('shop', chr(0), concat('order', l_orderkey, '.py'), chr(0), concat('part', l_partkey), chr(0),
  CAST(l_quantity AS INTEGER), chr(0), l_linenumber)), 1, 20) AS uid FROM lineitem""")
def symbol_uid(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.symbol_uid(
        F.lit("shop"), F.concat(F.lit("order"), "l_orderkey", F.lit(".py")), F.concat(F.lit("part"), "l_partkey"),
        F.col("l_quantity").cast("int"), F.col("l_linenumber")).alias("uid"))


@query("cache_key", """
SELECT p_partkey, concat(substr(sha256(concat(p_brand, chr(0), CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, chr(0), p_name, chr(0),
  least(p_type, lower(p_brand)), chr(0), greatest(p_type, lower(p_brand)), chr(0), '2')), 1, 12), ':', substr(sha256(p_name), 1, 20)) AS cache_key FROM part""")
def cache_key(spark, sf):
    enclosing = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    header = X.header_hash(F.col("p_brand"), enclosing, F.col("p_name"), F.array("p_type", F.lower("p_brand")))
    return table(spark, sf, "part").select("p_partkey", X.cache_key(header, X.body_hash(F.col("p_name"))).alias("cache_key"))


# -- identifiers ----------------------------------------------------------------------------------

def _identifier():
    first, second = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    return F.concat(F.lower("p_type"), F.lit("_get"), F.initcap(first), F.initcap(second), F.col("p_size"), F.lit("XMLTo.HTTP"),
                    F.replace("p_brand", F.lit("#"), F.lit("-")))


_IDENT = """concat(lower(p_type), '_get', upper(left(split_part(p_name, ' ', 1), 1)), substr(split_part(p_name, ' ', 1), 2),
 upper(left(split_part(p_name, ' ', 2), 1)), substr(split_part(p_name, ' ', 2), 2), p_size, 'XMLTo.HTTP', replace(p_brand, '#', '-'))"""
_SPLIT = (r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[_\-./:]+', ' ', 'g'), "
          r"'([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' '), lambda x: x <> '')")


@query("split_identifier", f"SELECT p_partkey, array_to_string({_SPLIT.format('n')}, '|') AS parts FROM (SELECT p_partkey, {_IDENT} AS n FROM part)")
def split_identifier(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.split_identifier(_identifier()), "|").alias("parts"))


@query("tokenize_query", f"""
WITH raw AS (SELECT p_partkey, unnest([p_name || ' ' || n || '  ' || p_brand, n]) AS q, unnest([0, 1]) AS half FROM (SELECT p_partkey, p_name, p_brand, {_IDENT} AS n FROM part)),
term AS (SELECT p_partkey, half, t, i FROM (SELECT p_partkey, half, unnest(list_filter(string_split(q, ' '), lambda x: x <> '')) AS t,
  generate_subscripts(list_filter(string_split(q, ' '), lambda x: x <> ''), 1) AS i FROM raw)),
tok AS (SELECT p_partkey, half, i, 0 AS j, lower(t) AS token FROM term UNION ALL
  SELECT p_partkey, half, i, generate_subscripts({_SPLIT.format('t')}, 1), lower(unnest({_SPLIT.format('t')})) FROM term),
firsts AS (SELECT p_partkey, half, token, min(i * 1000 + j) AS ord FROM tok GROUP BY ALL)
SELECT p_partkey, half, string_agg(token, ' ' ORDER BY ord) AS tokens FROM firsts GROUP BY ALL""")
def tokenize_query(spark, sf):
    both = F.array(F.concat("p_name", F.lit(" "), _identifier(), F.lit("  "), "p_brand"), _identifier())
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(both).alias("half", "q"))
    return rows.select("p_partkey", "half", F.array_join(X.tokenize_query(F.col("q")), " ").alias("tokens"))


@query("search_text", f"""
WITH i AS (SELECT p_partkey, p_name, p_brand, {_IDENT} AS n FROM part), s AS (SELECT *, list_transform({_SPLIT.format('n')}, lambda x: lower(x)) AS p FROM i)
SELECT p_partkey, concat_ws(' ', n, p_brand || '.' || n, lower(n), array_to_string(p, ' '), array_to_string(p, ''), array_to_string(p, '_'),
  CASE WHEN p_partkey % 2 = 0 THEN p_name END) AS search_text FROM s""")
def search_text(spark, sf):
    doc = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.search_text(
        _identifier(), F.concat("p_brand", F.lit("."), _identifier()), doc).alias("search_text"))


@query("token_count", r"""
SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text,
  '(?s:"{3}.*?"{3})|(?s:''{3}.*?''{3})|"(?:\\.|[^"\\])*"|''(?:\\.|[^''\\])*''|#[^\n]*|[A-Za-z_][A-Za-z_0-9]*|\d+\.?\d*|\s+|[^\n]'),
  lambda x: CASE WHEN regexp_full_match(x, '\s+') THEN 1 + length(x) - length(replace(x, chr(10), '')) ELSE CAST(ceil(length(x) / 4.0) AS BIGINT) END)), 0) AS BIGINT) AS tokens
FROM documents""")
def token_count(spark, sf):
    return texts(spark, sf, "documents", "doc_id").select("doc_id", X.token_count(F.col("text")).cast("bigint").alias("tokens"))


# -- redaction -------------------------------------------------------------------------------------

@query("redaction", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text,
  '(?i)(\b[A-Za-z0-9_]*(?:secret|passw(?:or)?d|pwd|token|api[_-]?key|private[_-]?key|access[_-]?key|credential)[A-Za-z0-9_]*[''"]?\s*[:=]\s*[rbuf]?")([^''"\s]{7,}[0-9!@#$%^&*()+=~]|[^''"\s]*[0-9!@#$%^&*()+=~][^''"\s]{7,})"',
  '\1«redacted»:secret_assignment"', 'g'), '"[A-Za-z0-9+/=_-]{33,}"', '"«redacted»:high_entropy_literal"', 'g')) AS text_hash,
  text LIKE '%token = "%' AS has_token FROM documents""")
def redaction(spark, sf):
    """Every rule over whole documents; the text itself is compared by hash."""
    return texts(spark, sf, "documents", "doc_id").select(
        "doc_id", F.sha2(X.scrub(F.col("text")).cast("binary"), 256).alias("text_hash"), F.col("text").like('%token = "%').alias("has_token"))


# -- questions ----------------------------------------------------------------------------------------

#: Question shapes with the class, rule and terms they must get; `@` is the name asked about.
_SHAPES = (
    ("what eventually calls `@`", "STRUCTURAL", "impact", True),
    ("What breaks if @ changes", "STRUCTURAL", "impact", False),
    ("blast radius of changing `@`", "STRUCTURAL", "impact", True),
    ("what does @ call", "STRUCTURAL", "callees", False),
    ("who calls `@`", "STRUCTURAL", "callers", True),
    ("callers of @", "STRUCTURAL", "callers", False),
    ("where is `@` used", "STRUCTURAL", "usages", True),
    ("references to `@`", "STRUCTURAL", "usages", True),
    ("where is `@` defined", "STRUCTURAL", "definition", True),
    ("subclasses of `@`", "STRUCTURAL", "subclasses", True),
    ("which module imports `@`", "STRUCTURAL", "imports", True),
    ("which view handles `@`", "STRUCTURAL", "routes", True),
    ("how does `@` work", "SEMANTIC", "explanatory", True),
    ("`@` please", "SEMANTIC", None, True),
)


def _questions(spark, sf):
    name = F.concat(F.lit("mod_"), F.col("p_size"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")))
    shape = F.get(F.array(*[F.lit(s[0]) for s in _SHAPES]), (F.col("p_partkey") % len(_SHAPES)).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.replace(shape, F.lit("@"), name).alias("query"))


def _shape_sql(i):
    cases = " ".join(f"WHEN {n} THEN {'NULL' if s[i] is None else repr(s[i])}" for n, s in enumerate(_SHAPES))
    return f"CASE p_partkey % {len(_SHAPES)} {cases} END"


@query("question_routing", f"""
SELECT p_partkey AS question_id, {_shape_sql(1)} AS query_class, CASE WHEN p_partkey % {len(_SHAPES)} = {len(_SHAPES) - 1} THEN 'default' ELSE 'regex' END AS decided_by, {_shape_sql(2)} AS rule FROM part""")
def question_routing(spark, sf):
    return _questions(spark, sf).select("question_id", Q.route(F.col("query")).alias("r")).select("question_id", "r.*")


_ROUTE_CASE = " ".join(["WHEN regexp_matches(text, '(?i)" + p.replace("'", "''") + f"') THEN '{r}'" for r, p in K.STRUCTURAL_PATTERNS]
                       + ["WHEN regexp_matches(text, '(?i)" + p.replace("'", "''") + "') THEN 'explanatory'" for p in K.SEMANTIC_PATTERNS])


@query("conversation_routing", f"SELECT conv_id, turn, CASE {_ROUTE_CASE} END AS rule FROM conversations")
def conversation_routing(spark, sf):
    """The router over every turn of every conversation, whole texts."""
    return table(spark, sf, "conversations").select("conv_id", "turn", Q.route(F.col("text"))["rule"].alias("rule"))


@query("entity_terms", """
SELECT p_partkey AS question_id, concat('mod_', p_size, '.', replace(p_name, ' ', '_')) AS terms FROM part""")
def entity_terms(spark, sf):
    return _questions(spark, sf).select("question_id", F.array_join(Q.entity_terms(F.col("query")), "|").alias("terms"))


_STOP = _lit_list(K.STOP_WORDS)


@query("plain_word_terms", f"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), 1) AS i FROM benchmark),
k AS (SELECT item_id, word, max(i) AS i FROM w WHERE length(word) >= 3 AND lower(word) NOT IN ({_STOP}) GROUP BY ALL),
ok AS (SELECT item_id FROM benchmark WHERE NOT regexp_matches(text, '`[^`\\n]+`'))
SELECT item_id, string_agg(word, ' ' ORDER BY i DESC) AS terms FROM k JOIN ok USING (item_id) GROUP BY item_id""")
def plain_word_terms(spark, sf):
    """The last tier: plain words, last first, without question words."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(Q.entity_terms(F.col("text")), " ").alias("terms"))


# -- stack traces ----------------------------------------------------------------------------------------

def traces(spark, sf):
    """One pasted trace per order: Python for even orders, JavaScript for odd ones."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part, line = F.col("x.l_partkey"), F.col("x.l_linenumber")
    per = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("xs"))
    py = F.transform("xs", lambda x: F.concat(F.lit('  File "/srv/app/g'), x["l_suppkey"], F.lit("/m"), x["l_partkey"], F.lit('.py", line '),
                                              x["l_linenumber"] + 10, F.lit(", in run_"), x["l_partkey"], F.lit("\n    call()")))
    js = F.transform("xs", lambda x: F.concat(
        F.lit("    at "), F.when(x["l_linenumber"] % 2 == 0, F.concat(F.lit("async Object.load"), x["l_partkey"], F.lit(" (")))
        .otherwise(F.lit("")), F.lit("webpack://app/./src/g"), x["l_suppkey"], F.lit("/m"), x["l_partkey"], F.lit(".ts:"), x["l_linenumber"] + 10,
        F.lit(":"), x["l_suppkey"] + 1, F.when(x["l_linenumber"] % 2 == 0, ")").otherwise("")))
    text = F.when(F.col("l_orderkey") % 2 == 0, F.concat(
        F.lit("Traceback (most recent call last):\n"), F.array_join(py, "\n"), F.lit("\nValueError: bad "), "l_orderkey")).otherwise(
            F.concat(F.lit("TypeError: x"), "l_orderkey", F.lit(" is not a function\n"), F.array_join(js, "\n")))
    return per.select(F.col("l_orderkey").alias("question_id"), text.alias("query"))


@query("stack_frames", """
SELECT l_orderkey AS question_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS frame_no,
  CASE WHEN l_orderkey % 2 = 0 THEN concat('/srv/app/g', l_suppkey, '/m', l_partkey, '.py') ELSE concat('webpack://app/./src/g', l_suppkey, '/m', l_partkey, '.ts') END AS file_path,
  l_linenumber + 10 AS line_no, CASE WHEN l_orderkey % 2 = 0 THEN concat('run_', l_partkey) WHEN l_linenumber % 2 = 0 THEN concat('Object.load', l_partkey) END AS fn_name,
  CASE WHEN l_orderkey % 2 = 0 THEN 'python' ELSE 'javascript' END AS language, CASE WHEN l_orderkey % 2 = 1 THEN l_suppkey + 1 END AS col_no FROM lineitem""")
def stack_frames(spark, sf):
    return FR.frames_of(traces(spark, sf)).drop("raw")


@query("trace_messages", """
SELECT DISTINCT l_orderkey AS question_id, CASE WHEN l_orderkey % 2 = 0 THEN concat('ValueError: bad ', l_orderkey) ELSE concat('TypeError: x', l_orderkey, ' is not a function') END AS message,
 'TRACE' AS query_class FROM lineitem""")
def trace_messages(spark, sf):
    return traces(spark, sf).select("question_id", Q.error_message(F.col("query")).alias("message"), Q.route(F.col("query"))["query_class"].alias("query_class"))


@query("suffix_paths", r"""
WITH k AS (SELECT DISTINCT rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path FROM pages),
ks AS (SELECT path, array_to_string(list_slice(string_split(path, '/'), i, len(string_split(path, '/'))), '/') AS suffix FROM k, unnest(range(1, len(string_split(path, '/')) + 1)) t(i)),
kc AS (SELECT suffix, count(*) AS n, min(path) AS sole FROM ks GROUP BY suffix),
f AS (SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'app/srv/' WHEN 1 THEN '' ELSE 'x/' END,
  CASE WHEN page_id % 3 = 2 THEN regexp_replace(path, '^[^/]*/', '') ELSE path END) AS path
  FROM (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path FROM pages)),
fs AS (SELECT page_id, i, array_to_string(list_slice(string_split(path, '/'), i, len(string_split(path, '/'))), '/') AS suffix FROM f, unnest(range(2, len(string_split(path, '/')) + 1)) t(i)),
h AS (SELECT page_id, arg_min(n, i) AS n, arg_min(sole, i) AS sole FROM fs JOIN kc USING (suffix) GROUP BY page_id)
SELECT f.page_id, CASE WHEN f.path IN (SELECT path FROM k) THEN f.path WHEN h.n = 1 THEN h.sole ELSE f.path END AS rel_path FROM f LEFT JOIN h USING (page_id)""")
def suffix_paths(spark, sf):
    """Page paths recorded elsewhere matched to known paths by their longest unambiguous suffix."""
    bare = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/"))
    pages = table(spark, sf, "pages").select("page_id", bare.alias("path"), F.lit("web").alias("repo_id"))
    known = pages.select("repo_id", F.col("path").alias("rel_path")).distinct()
    third = F.col("page_id") % 3
    lead = F.when(third == 0, "app/srv/").when(third == 1, "").otherwise("x/")
    tail = F.when(third == 2, F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path"))
    asked = pages.select("page_id", "repo_id", F.concat(lead, tail).alias("file_path"))
    return FR.repo_relative(asked, known).select("page_id", "rel_path")


@query("frame_names", """
WITH sym AS (SELECT concat('P:', p_partkey) AS uid, replace(p_name, ' ', '_') || (p_partkey // 3) AS name, concat(lower(p_type), '.', replace(p_name, ' ', '_') || (p_partkey // 3)) AS q FROM part),
fr AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN concat('Object.', name) WHEN 1 THEN name ELSE q END AS fn,
  CASE l_linenumber % 3 WHEN 2 THEN q ELSE name END AS bare FROM lineitem JOIN sym ON uid = concat('P:', l_partkey)),
c AS (SELECT bare, count(*) AS n, min(uid) AS uid FROM (SELECT DISTINCT bare FROM fr) f JOIN sym s ON s.name = regexp_extract(bare, '[^.]*$') AND (bare NOT LIKE '%.%' OR s.q = bare OR ends_with(s.q, '.' || bare)) GROUP BY bare)
SELECT l_orderkey, l_linenumber, fn AS fn_name, coalesce(n, 0) AS n_named, CASE WHEN n = 1 THEN uid END AS uid FROM fr LEFT JOIN c USING (bare)""")
def frame_names(spark, sf):
    """Frames by function name: one symbol resolves, several refuse."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.floor(F.col("p_partkey") / 3))
    symbols = table(spark, sf, "part").select(F.concat(F.lit("P:"), "p_partkey").alias("uid"), F.lit("shop").alias("repo_id"), F.lit("function").alias("kind"),
                                              name.alias("name"), F.concat(F.lower("p_type"), F.lit("."), name).alias("qualified_name"), "p_partkey")
    third = F.col("l_linenumber") % 3
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    fn = F.when(third == 0, F.concat(F.lit("Object."), "name")).when(third == 1, F.col("name")).otherwise(F.col("qualified_name"))
    asked = items.join(symbols, "p_partkey").select("l_orderkey", "l_linenumber", "repo_id", fn.alias("fn_name"))
    return FR.by_name(asked, symbols).select("l_orderkey", "l_linenumber", "fn_name", "n_named",
                                             F.when(F.col("n_named") == 1, F.col("named_uid")).alias("uid"))


# -- source maps ---------------------------------------------------------------------------------------------

def _segments(items):
    """Line items as mapping deltas: each supplier is a map, each order a generated line."""
    return items.select(
        F.col("l_suppkey").alias("map_id"), F.col("l_orderkey").alias("gen_line"), F.col("l_linenumber").alias("seg"),
        F.array(F.col("l_linenumber").cast("bigint"), F.col("l_suppkey") % 3 - 1, F.col("l_partkey") - 500, F.col("l_quantity").cast("bigint") - 25).alias("deltas"))


@query("vlq_decode", """
SELECT l_suppkey AS map_id, l_orderkey AS gen_line, l_linenumber AS seg, concat_ws(',', l_linenumber, l_suppkey % 3 - 1, l_partkey - 500, CAST(l_quantity AS BIGINT) - 25) AS fields FROM lineitem""")
def vlq_decode(spark, sf):
    encoded = _segments(table(spark, sf, "lineitem")).withColumn("segment", V.vlq_encode(F.col("deltas")))
    return encoded.select("map_id", "gen_line", "seg", F.array_join(V.vlq_decode(F.col("segment")).cast("array<string>"), ",").alias("fields"))


@query("source_map_positions", """
SELECT l_suppkey AS map_id, l_orderkey AS gen_line, l_linenumber AS seg, sum(l_linenumber) OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber) AS gen_column,
  sum(l_suppkey % 3 - 1) OVER w AS source, sum(l_partkey - 500) OVER w + 1 AS line, sum(l_quantity - 25) OVER w AS "column"
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, CAST(max(l_quantity) AS BIGINT) AS l_quantity FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)""")
def source_map_positions(spark, sf):
    """Running sums over whole maps, from encoded segments."""
    items = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))
    encoded = stored(spark, f"mapping segments {sf}", lambda: _segments(items).select(
        "map_id", "gen_line", "seg", V.vlq_encode(F.col("deltas")).alias("segment")))
    out = FR.map_positions(encoded.select("map_id", "gen_line", "seg", V.vlq_decode(F.col("segment")).alias("fields")))
    return out.select("map_id", "gen_line", "seg", *[F.col(c).cast("bigint").alias(c) for c in ("gen_column", "source", "line", "column")])


@query("source_map_lookup", """
WITH p AS (SELECT l_suppkey % 10 AS map_id, l_orderkey AS gen_line, l_linenumber * 3 AS gen_column, max(l_partkey) AS line FROM lineitem GROUP BY ALL),
a AS (SELECT l_suppkey % 10 AS map_id, l_orderkey AS gen_line, CAST(l_quantity AS INTEGER) AS col_no, l_linenumber FROM lineitem)
SELECT a.map_id, a.gen_line + 1 AS line_no, a.l_linenumber, a.col_no, p.line FROM a ASOF LEFT JOIN p ON a.map_id = p.map_id AND a.gen_line = p.gen_line AND a.col_no - 1 >= p.gen_column""")
def source_map_lookup(spark, sf):
    """The segment in force at each generated position: an as-of join per (map, line)."""
    items = table(spark, sf, "lineitem")
    map_id = (F.col("l_suppkey") % 10).alias("map_id")
    positions = items.groupBy(map_id, F.col("l_orderkey").alias("gen_line"), (F.col("l_linenumber") * 3).alias("gen_column")).agg(
        F.max("l_partkey").alias("line"), F.lit(0).alias("source"), F.lit(0).alias("column"), F.lit(0).alias("seg"))
    asked = items.select(map_id, (F.col("l_orderkey") + 1).alias("line_no"), "l_linenumber", F.col("l_quantity").cast("int").alias("col_no"))
    return FR.original_positions(asked, positions).select("map_id", "line_no", "l_linenumber", "col_no", "line")


# -- paths -----------------------------------------------------------------------------------------------------

@query("module_names", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('pkg.g', p_size, '.m', p_partkey) WHEN 1 THEN concat('pkg.g', p_size) WHEN 2 THEN concat('app.g', p_size, '.route', p_partkey)
  ELSE concat('app.g', p_size, '.index') END AS module, CASE p_partkey % 4 WHEN 0 THEN concat('pkg.g', p_size, '.models.User') WHEN 1 THEN concat('pkg.g', p_size, '.models.User')
  WHEN 2 THEN concat('app.lib.u', p_partkey) ELSE concat('lib.u', p_partkey) END AS target FROM part""")
def module_names(spark, sf):
    """Paths to module names, and relative imports to absolute ones, in both languages."""
    kind = F.col("p_partkey") % 4
    path = (F.when(kind == 0, F.concat(F.lit("./pkg/g"), "p_size", F.lit("/m"), "p_partkey", F.lit(".py")))
            .when(kind == 1, F.concat(F.lit("/pkg\\g"), "p_size", F.lit("\\__init__.py")))
            .when(kind == 2, F.concat(F.lit("app/g"), "p_size", F.lit("/route"), "p_partkey", F.lit(".tsx")))
            .otherwise(F.concat(F.lit("app/g"), "p_size", F.lit("/index.d.ts"))))
    spec = F.when(kind == 2, F.concat(F.lit("../lib/u"), "p_partkey")).otherwise(F.concat(F.lit("@/lib/u"), "p_partkey"))
    rows = table(spark, sf, "part").select("p_partkey", kind.alias("kind"), path.alias("path"), spec.alias("spec"))
    target = F.when(F.col("kind") < 2, P.absolutize(F.lit(".models.User"), P.py_package(F.col("path")))).otherwise(P.ts_specifier(F.col("spec"), F.col("path")))
    return rows.select("p_partkey", P.module_name(P.normalize(F.col("path"))).alias("module"), target.alias("target"))


@query("git_renames", r"""
SELECT doc_id, n, concat('docs/', lang, '/', line, '.md') AS old_path, concat('moved/', doc_id, '-', n, '.md') AS new_path
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents) WHERE doc_id % 4 <> 3""")
def git_renames(spark, sf):
    """Porcelain rename lines with quoted, octal-escaped paths: every line of every text is one."""
    docs = texts(spark, sf, "documents", "doc_id").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), "line", F.lit(".md"))
    pairs = F.filter(F.split(F.hex(path.cast("binary")), "(?<=\\G..)"), lambda h: h != "")
    byte = lambda h: F.conv(h, 16, 10).cast("int")
    escape = lambda h: (F.when((byte(h) >= 128) | (byte(h) < 32), F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0")))
                        .when(byte(h).isin(34, 92), F.concat(F.lit("\\"), F.char(byte(h)))).otherwise(F.char(byte(h))))
    quoted = F.concat(F.lit('"'), F.array_join(F.transform(pairs, escape), ""), F.lit('"'))
    status = F.when(F.col("doc_id") % 4 == 3, "?? ").when(F.col("doc_id") % 2 == 0, "R  ").otherwise("RM ")
    lines = docs.select("doc_id", "n", F.concat(status, quoted, F.lit(" -> moved/"), "doc_id", F.lit("-"), "n", F.lit(".md")).alias("value"))
    return lines.select("doc_id", F.col("n").cast("bigint").alias("n"), P.git_rename(F.col("value")).alias("m")).filter("m is not null").select(
        "doc_id", "n", F.col("m.old").alias("old_path"), F.col("m.new").alias("new_path"))


# -- vectors ------------------------------------------------------------------------------------------------------

@query("hash_embedding", """
WITH h AS (SELECT doc_id, list_transform(range(0, 64), lambda i: CAST(('0x' || substr(sha256(concat(i // 8, chr(0), text)), (i % 8) * 8 + 1, 8)) AS BIGINT) / 4294967295.0 * 2 - 1) AS v FROM documents)
SELECT doc_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM h)""")
def hash_embedding(spark, sf):
    vector = V.hash_embedding(F.col("text"), 64)
    return texts(spark, sf, "documents", "doc_id").select("doc_id", vector.alias("v")).select(
        "doc_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


@query("zero_pad", "SELECT vec_id, CAST(1536 AS BIGINT) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def zero_pad(spark, sf):
    padded = table(spark, sf, "embeddings").select("vec_id", V.zero_pad(F.col("embedding")).alias("v"))
    return padded.select("vec_id", F.size("v").cast("bigint").alias("width"), F.round(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


# -- chunks -----------------------------------------------------------------------------------------------------------

@query("context_headers", """
SELECT p_partkey, concat('# ', p_brand, '.py', CASE WHEN p_size % 2 = 0 THEN concat(' :: class ', p_type) ELSE '' END, ' :: def ', replace(p_name, ' ', '_'), '()',
  CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), '# imports used: ', least(p_type, lower(p_brand)), ', ', greatest(p_type, lower(p_brand))) ELSE '' END) AS header FROM part""")
def context_headers(spark, sf):
    enclosing = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("class "), "p_type", F.lit(":")))
    signature = F.concat(F.lit("def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("():"))
    imports = F.when(F.col("p_partkey") % 3 == 0, F.array("p_type", F.lower("p_brand")))
    return table(spark, sf, "part").select("p_partkey", X.context_header(F.concat("p_brand", F.lit(".py")), enclosing, signature, imports).alias("header"))


@query("overflow_parts")
def overflow_parts(spark, sf):
    """Documents cut at line starts into parts of at most 1,200 tokens where lines allow it."""
    parts = packing.overflow_parts(F.col("text"), F.concat(F.lit("# "), "source"))
    return texts(spark, sf, "documents", "doc_id").select("doc_id", F.posexplode(parts).alias("part", "text")).select(
        "doc_id", "part", X.token_count(F.col("text")).alias("tokens"))
