"""Stack frames to symbols: source map, direct position, unique name, or an explicit refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from symtrail import constants as K
from symtrail.functions import paths as P, questions as Q, vectors as V
from symtrail.operators.keyed import answering_to, as_of, innermost, lookup, running_sums

#: Segments of one mapping summed by one task at a time.
SEGMENT_BUCKET = 4096


def frames_of(questions: DataFrame) -> DataFrame:
    """`question_id, frame_no, raw, file_path, line_no, fn_name, language, col_no`."""
    return questions.select("question_id", F.posexplode(Q.stack_frames(F.col("query"))).alias("frame_no", "f"))\
        .select("question_id", "frame_no", "f.*")


# -- paths ---------------------------------------------------------------------------------------

def repo_relative(frames: DataFrame, known: DataFrame, root: str | None = None) -> DataFrame:
    """Adds `rel_path`: the path under `root`, else the known file its longest naming suffix picks.

    The longest suffix that names any known file decides: one file resolves, several leave the path
    as it was.  Known paths are counted per suffix first, so a common file name is one row."""
    raw = F.translate(F.col("file_path"), "\\", "/")
    path = P.normalize(raw)
    if root:
        base = root.rstrip("/").replace("\\", "/") + "/"
        path = F.when(F.lower(raw).startswith(base.lower()), F.substring(raw, len(base) + 1, 1 << 20)).otherwise(path)
    asked = frames.withColumn("_path", path)
    distinct = asked.select("repo_id", "_path").filter("_path is not null").distinct()
    exact = known.select("repo_id", F.col("rel_path").alias("_path"), F.lit(True).alias("_is")).distinct()
    named = known.select("repo_id", "rel_path", F.explode(P.suffixes(F.col("rel_path"), 0)).alias("suffix"))\
        .groupBy("repo_id", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("only"))
    tries = distinct.select("repo_id", "_path", F.posexplode(P.suffixes(F.col("_path"), 1)).alias("pos", "suffix"))
    hits = lookup(tries, named, ["repo_id", "suffix"], "inner").groupBy("repo_id", "_path").agg(
        F.min_by(F.struct("n", "only"), "pos").alias("h"))
    solved = distinct.join(exact, ["repo_id", "_path"], "left").join(hits, ["repo_id", "_path"], "left").select(
        "repo_id", "_path", F.when(F.col("_is").isNotNull() | F.coalesce(F.col("h.n") != 1, F.lit(True)),
                                   F.col("_path")).otherwise(F.col("h.only")).alias("rel_path"))
    return lookup(asked, solved, ["repo_id", "_path"]).drop("_path")


# -- source maps -------------------------------------------------------------------------------------

def map_segments(maps: DataFrame) -> DataFrame:
    """`map_id, gen_line, seg, fields` of version-3 mappings; index maps (with sections) have none."""
    lines = maps.select("map_id", F.posexplode(F.split("mappings", ";")).alias("gen_line", "line"))
    segments = lines.filter("line <> ''").select(
        "map_id", "gen_line", F.posexplode(F.split("line", ",")).alias("seg", "segment"))
    return segments.select("map_id", "gen_line", "seg", V.vlq_decode(F.col("segment")).alias("fields"))


def map_positions(segments: DataFrame) -> DataFrame:
    """Absolute positions: source, line and column run over the whole map, the generated column
    restarts on each line.  A segment of one field maps to nothing (`source` is null)."""
    order = [F.col("gen_line"), F.col("seg")]
    field = lambda i: F.coalesce(F.get("fields", F.lit(i)), F.lit(0))
    has_source = F.size("fields") >= 4
    deltas = segments.select(
        "map_id", "gen_line", "seg", has_source.alias("has_source"), field(0).alias("d_col"),
        *[F.when(has_source, field(i)).otherwise(0).alias(f"d_{n}") for i, n in ((1, "source"), (2, "line"), (3, "column"))])
    bucket = F.struct("gen_line", F.floor(F.col("seg") / SEGMENT_BUCKET).alias("part"))
    whole = running_sums(deltas, ["map_id"], bucket, order,
                         {"source": "d_source", "line": "d_line", "column": "d_column"})
    lined = running_sums(whole, ["map_id", "gen_line"], F.floor(F.col("seg") / SEGMENT_BUCKET), [F.col("seg")],
                         {"gen_column": "d_col"})
    null = lambda c: F.when(F.col("has_source"), F.col(c))
    return lined.select("map_id", "gen_line", "seg", "gen_column", null("source").alias("source"),
                        (null("line") + 1).alias("line"), null("column").alias("column"))


def original_positions(lookups: DataFrame, positions: DataFrame) -> DataFrame:
    """The mapping in force at each 1-based generated `(line_no, col_no)`: the last segment starting
    at or before it on that line.  Unmapped positions get nulls.

    Equal positions are looked up once, so a frame that many traces share is one row of the ordered work."""
    asked = lookups.withColumn("gen_line", F.col("line_no") - 1).withColumn("_at", F.col("col_no") - 1)
    spots = asked.select("map_id", "gen_line", "_at").distinct()
    out = as_of(spots, positions.withColumn("gen_column", F.col("gen_column").cast("int")), ["map_id", "gen_line"], "_at",
                "gen_column", ["source", "line", "column"], lambda c: F.floor(c / 65536), tie="seg")
    return lookup(asked, out.drop("matched_at"), ["map_id", "gen_line", "_at"]).drop("gen_line", "_at")


def compiled_map_path(file_path, root: str | None = None):
    """Where the map of a compiled file lies in the repository, or null."""
    path = F.regexp_replace(F.translate(file_path, "\\", "/"), "^file://", "")
    build = F.nullif(F.regexp_extract(path, r"/(\.next/.*)$", 1), F.lit(""))
    if root:
        base = root.rstrip("/") + "/"
        build = F.coalesce(build, F.when(F.lower(path).startswith(base.lower()), F.substring(path, len(base) + 1, 1 << 20)))
    return F.concat(build, F.lit(".map"))


def source_path(source, map_path, source_root):
    """A map's source entry as a repository path; null when it lies outside."""
    raw = F.regexp_replace(source, r"\?.*$", "")
    bundled = r"^webpack://[^/]*/"
    packed = P.fold_dots(F.regexp_replace(raw, bundled, ""))
    folder = F.regexp_replace(map_path, r"[^/]*$", "")
    joined = F.when(F.coalesce(source_root, F.lit("")) == "", raw).otherwise(
        F.concat_ws("/", F.regexp_replace(source_root, "/+$", ""), raw))
    plain = P.fold_dots(F.concat(folder, F.regexp_replace(joined, "^file://", "")))
    out = F.when(raw.rlike(bundled), packed).otherwise(plain)
    return F.when((F.coalesce(source, F.lit("")) == "") | out.startswith(".."), None).otherwise(out)


# -- names --------------------------------------------------------------------------------------------

def by_name(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `n_named` and `named_uid`: how many non-module symbols a frame's function name fits.

    Distinct names are looked up, and counted per name, so a name many files share stays one row."""
    bare = Q.bare_function(F.col("fn_name"))
    asked = frames.withColumn("_fn", bare)
    names = asked.select("repo_id", "_fn").filter("_fn is not null").distinct().filter(~Q.is_mangled(P.leaf(F.col("_fn"))))
    code = symbols.filter("kind <> 'module'").select("repo_id", "uid", "name", "qualified_name")
    counts = answering_to(code, names, ["repo_id"], "_fn").groupBy("repo_id", "_fn").agg(
        F.count(F.lit(1)).alias("n_named"), F.min("uid").alias("named_uid"))
    return lookup(asked, counts, ["repo_id", "_fn"]).drop("_fn").withColumn("n_named", F.coalesce("n_named", F.lit(0)))


# -- the cascade -----------------------------------------------------------------------------------------

def resolve(frames: DataFrame, symbols: DataFrame, known: DataFrame, root: str | None = None,
            maps: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """Adds `uid, tier, confidence, badge` to each frame.

    `maps(repo_id, map_id, map_path, sources, source_root, stale)` has one row per source map, where
    `stale` lists source indexes whose embedded text differs from the tree."""
    library = P.is_library(F.col("file_path"))
    skipped = (Q.is_mangled(F.col("fn_name")) & F.col("file_path").isNull()) | library
    rows = frames.withColumn("_skip", skipped).withColumn("_k", F.struct("question_id", "frame_no"))
    spans = symbols.select("repo_id", "rel_path", "start_line", "end_line", "uid")

    def at(points, path, line, alias):
        asked = points.select("repo_id", "_k", F.col(path).alias("rel_path"), F.col(line).alias("_line"))\
            .filter("rel_path is not null and _line is not null")
        return innermost(asked, spans, ["repo_id", "rel_path"], "_line", "start_line", "end_line", ["uid"])\
            .select("_k", F.col("uid").alias(alias))

    placed = repo_relative(rows.filter("not _skip"), known, root)
    direct = at(placed, "rel_path", "line_no", "direct_uid")
    named = by_name(rows.filter("not _skip").select("_k", "repo_id", "fn_name"), symbols)
    out = rows.join(direct, "_k", "left").join(named.select("_k", "n_named", "named_uid"), "_k", "left")
    mapped_lib = F.lit(False)
    if maps is not None and positions is not None and root is not None:
        asked = rows.filter("not _skip and line_no >= 1 and col_no >= 1").withColumn(
            "map_path", compiled_map_path(F.col("file_path"), root)).join(
                maps.select("repo_id", "map_path", "map_id", "sources", "source_root", "stale"), ["repo_id", "map_path"])
        hit = original_positions(asked, positions).filter("source is not null")
        path = source_path(F.get("sources", F.col("source").cast("int")), F.col("map_path"), F.col("source_root"))
        hit = hit.withColumn("_src", path).withColumn("_outside", F.col("_src").isNull() | P.is_library(F.col("_src")))
        usable = hit.filter(~F.col("_outside") & ~F.array_contains("stale", F.col("source").cast("int")))
        via_map = at(usable, "_src", "line", "map_uid")
        out = out.join(via_map, "_k", "left").join(hit.select("_k", "_outside"), "_k", "left")
        mapped_lib = F.coalesce("_outside", F.lit(False))
    else:
        out = out.withColumn("map_uid", F.lit(None).cast("string"))
    tier = (F.when(F.col("_skip") | mapped_lib, "unresolved").when(F.col("map_uid").isNotNull(), "sourcemap")
            .when(F.col("direct_uid").isNotNull(), "direct").when(F.col("n_named") == 1, "name").otherwise("unresolved"))
    uid = (F.when(tier == "sourcemap", F.col("map_uid")).when(tier == "direct", F.col("direct_uid"))
           .when(tier == "name", F.col("named_uid")))
    confidence = F.when(tier.isin("sourcemap", "direct"), 1.0).when(tier == "name", K.NAME_MATCH_CONFIDENCE).otherwise(0.0)
    badges = F.create_map(*[F.lit(x) for kv in K.FRAME_BADGES.items() for x in kv])
    keep = [c for c in frames.columns]
    return out.select(*keep, uid.alias("uid"), tier.alias("tier"), confidence.alias("confidence"),
                      F.element_at(badges, tier).alias("badge"))


def trace_seeds(resolved: DataFrame) -> DataFrame:
    """Innermost frame first (Python prints it last), distinct: `question_id, uid, position, score`."""
    depth = F.when(F.col("language") == "python", -F.col("frame_no")).otherwise(F.col("frame_no") + (1 << 20))
    first = resolved.filter("uid is not null").groupBy("question_id", "uid").agg(F.min(depth).alias("at"))
    order = W.partitionBy("question_id").orderBy("at")
    n = F.count(F.lit(1)).over(W.partitionBy("question_id"))
    return first.select("question_id", "uid", F.row_number().over(order).alias("position"),
                        (3.0 - (F.row_number().over(order) - 1) / (n + 1)).alias("score"))


def fallback_query(questions: DataFrame, resolved: DataFrame) -> DataFrame:
    """The search text of traces with unresolved repository frames, or with nothing resolved."""
    open_ = F.col("uid").isNull()
    outside = P.is_library(F.col("file_path"))
    name = F.when(open_ & ~Q.is_mangled(F.col("fn_name")), F.struct("frame_no", "fn_name"))
    per = resolved.groupBy("question_id").agg(
        F.count_if(open_ & ~outside).alias("open"), F.count("uid").alias("hits"),
        F.sort_array(F.collect_list(name)).alias("names"))
    need = per.filter("open > 0 or hits = 0").join(questions.select("question_id", "query"), "question_id")
    message = F.nullif(Q.error_message(F.col("query")), F.lit(""))
    return need.select("question_id", F.concat_ws(" ", message, F.transform("names", lambda n: n["fn_name"])).alias("query"))
