"""Source trees, change signals, source maps and golden questions as DataFrames."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

from symtrail.functions import paths as P

SUFFIXES = "*.{py,pyi,ts,tsx,mts,cts}"
IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", ".pytest_cache", ".mypy_cache", "dist", "build", ".next")


def _relative(root: str):
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    return F.regexp_replace(path, "^" + os.path.abspath(root).replace(".", r"\.") + "/", "")


def scan(spark: SparkSession, root: str, repo_id: str, pattern: str = SUFFIXES) -> DataFrame:
    """`repo_id, rel_path, content, mtime_ns, size` of a tree's source files, read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    ignored = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in IGNORED) + ")/"
    rows = files.select(F.lit(repo_id).alias("repo_id"), _relative(root).alias("rel_path"), "content",
                        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))
    return rows.filter(~F.col("rel_path").rlike(ignored)).withColumn("rel_path", P.checked(F.col("rel_path")))


def tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """Paths git would list (ignore rules applied), or None outside a repository."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"],
                             capture_output=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    names = [n for n in out.decode("utf-8", "replace").split("\0") if n]
    return spark.createDataFrame([(n,) for n in names], "rel_path string")


def git_renames(spark: SparkSession, porcelain_path: str) -> DataFrame:
    """Moves read from saved `git status --porcelain -M` output."""
    lines = spark.read.text(porcelain_path)
    return lines.select(P.git_rename(F.col("value")).alias("m")).filter("m is not null").select(
        F.col("m.old").alias("old_path"), F.col("m.new").alias("new_path"))


def source_maps(spark: SparkSession, root: str, repo_id: str, files: DataFrame | None = None) -> DataFrame:
    """`repo_id, map_id, map_path, mappings, sources, source_root, stale` of the version-3 maps under a root.

    `stale` lists the sources whose embedded text differs from `files` (or is gone from it)."""
    # File listings skip folders that start with a dot, so the build folder is named as a root itself.
    build = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.next")
    exists = build.getFileSystem(spark._jsc.hadoopConfiguration()).exists(build)
    roots = [root, build.toString()] if exists else [root]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.map").load(roots)
    shape = "mappings string, sources array<string>, sourceRoot string, sourcesContent array<string>, sections array<string>"
    maps = raw.select(F.lit(repo_id).alias("repo_id"), _relative(root).alias("map_path"),
                      F.from_json(F.make_valid_utf8(F.col("content").cast("string")), shape).alias("m")).filter("m.mappings is not null and m.sections is null")
    out = maps.select("repo_id", F.sha1(F.col("map_path").cast("binary")).alias("map_id"), "map_path", "m.mappings", "m.sources",
                      F.col("m.sourceRoot").alias("source_root"), F.col("m.sourcesContent").alias("texts"))
    if files is None:
        return out.withColumn("stale", F.array().cast("array<int>")).drop("texts")
    from symtrail.functions import text as X
    from symtrail.operators.frames import source_path
    fold = lambda c: F.regexp_replace(c, "\r\n", "\n")
    one = out.filter("texts is not null").select("map_id", "map_path", "source_root", "sources", F.posexplode("texts").alias("i", "text")).filter("text is not null")
    named = one.withColumn("rel_path", source_path(F.get("sources", F.col("i")), F.col("map_path"), F.col("source_root")))
    now = files.filter(F.col("repo_id") == repo_id).select("rel_path", X.text_of(F.col("content")).alias("now"))
    stale = named.join(now, "rel_path", "left").filter(~fold(F.col("text")).eqNullSafe(F.col("now")) & F.col("rel_path").isNotNull())
    listed = stale.groupBy("map_id").agg(F.collect_set("i").alias("stale"))
    return out.drop("texts").join(listed, "map_id", "left").withColumn("stale", F.coalesce("stale", F.array().cast("array<int>")))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a golden file; a question without a class is a semantic one."""
    shape = ("questions array<struct<id:string,query:string,class:string,gold:array<array<string>>,"
             "expected_related:array<array<string>>,language:string>>")
    rows = spark.read.schema(shape).option("multiLine", "true").json(path).select(F.explode("questions").alias("q"))
    return rows.select(F.col("q.id").alias("question_id"), F.coalesce("q.class", F.lit("SEMANTIC")).alias("class"), "q.query", "q.gold",
                       F.col("q.expected_related").alias("expected_related"), "q.language")
