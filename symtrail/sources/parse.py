"""Source files to symbols and raw edges: one parser pass per file, then columns only.

The parser stage is a `mapInArrow` over files; a file is one row before and after it, so it needs no
shuffle.  Everything a row already holds (definitions, imports, references) is resolved inside the
row with array functions; only names of other files are left for the joins in `operators.resolve`.
"""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from symtrail import constants as K
from symtrail.functions import paths as P, text as X
from symtrail.session import spread

#: Parsing takes a millisecond or more per file, however short, so tasks follow the number of files.
FILES_PER_TASK = 10_000

#: Files after which what refers to itself is swept up.
FILES_PER_SWEEP = 100

_BOUND = pa.struct([("name", pa.string()), ("base", pa.string()), ("local", pa.int32()),
                    ("imported", pa.string())])
_DEF = pa.struct([
    ("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("arity", pa.int32()),
    ("ordinal", pa.int32()), ("parent", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()),
    ("source", pa.string()), ("enclosing", pa.string()), ("names", pa.list_(pa.string())),
    ("decorators", pa.list_(pa.string())), ("attributes", pa.list_(_BOUND)),
    ("start_line", pa.int32()), ("end_line", pa.int32())])
_REF = pa.struct([
    ("owner", pa.int32()), ("kind", pa.string()), ("mode", pa.string()), ("member", pa.string()),
    ("base", pa.string()), ("local", pa.int32()), ("imported", pa.string())])
_IMPORT = pa.struct([("module", pa.string()), ("name", pa.string())])
_FACTS = pa.schema([
    ("repo_id", pa.string()), ("rel_path", pa.string()), ("text", pa.string()),
    ("script", pa.bool_()), ("module", pa.string()), ("package", pa.string()), ("imports", pa.map_(pa.string(), _IMPORT)), ("defs", pa.list_(_DEF)), ("refs", pa.list_(_REF)),
    ("docstring", pa.string()), ("client", pa.bool_()), ("end_line", pa.int32())])

_DEF_DDL = ("path:string,name:string,kind:string,arity:int,ordinal:int,parent:int,signature:string,docstring:string,"
            "source:string,enclosing:string,names:array<string>,decorators:array<string>,"
            "attributes:array<struct<name:string,base:string,local:int,imported:string>>,"
            "start_line:int,end_line:int")
FACTS_DDL = (
    "repo_id string, rel_path string, text string, script boolean, module string, package string, imports map<string,struct<module:string,name:string>>, "
    f"defs array<struct<{_DEF_DDL}>>, refs array<struct<owner:int,kind:string,mode:string,member:string,"
    "base:string,local:int,imported:string>>, docstring string, client boolean, end_line int")


def _extract(batches):
    from symtrail.sources import python_facts, ts_facts

    for batch in batches:
        rows = []
        # Syntax trees go as soon as they are read; a collector that looks through them meanwhile costs a quarter of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            for k, row in enumerate(batch.to_pylist()):
                script = row["rel_path"].endswith(K.TS_SUFFIXES)
                facts = (ts_facts if script else python_facts).extract(row["text"])
                facts["imports"] = list(facts["imports"].items())
                rows.append({**row, **facts})
                if k % FILES_PER_SWEEP == 0:
                    gc.collect(0)
        finally:
            if collects:
                gc.enable()
        yield pa.RecordBatch.from_pylist(rows, schema=_FACTS)


def facts(files: DataFrame) -> DataFrame:
    """One row per parseable source file with what its syntax says."""
    wanted = files.filter(F.col("rel_path").rlike(r"\.(py|pyi|ts|tsx|mts|cts)$"))
    script = F.col("rel_path").rlike(K.TS_LIKE_PATH)
    # Names derived from the path go through the parser stage, so later lambdas read them as columns.
    texts = wanted.select("repo_id", P.checked(F.col("rel_path")).alias("rel_path"),
                          F.make_valid_utf8(F.col("content").cast("string")).alias("text")).select(
        "*", script.alias("script"), P.module_name(F.col("rel_path")).alias("module"),
        F.when(script, F.lit("")).otherwise(P.py_package(F.col("rel_path"))).alias("package"))
    return spread(texts, "repo_id", "rel_path", rows_per_task=FILES_PER_TASK).mapInArrow(_extract, FACTS_DDL)


def file_rows(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "rel_path", X.content_hash(X.text_of(F.col("content"))).alias("content_hash"),
                        X.language_of(F.col("rel_path")).alias("language"))


def _qualified(path):
    return F.concat_ws(".", F.nullif(F.col("module"), F.lit("")), path)


def _import_target(entry, resolved: bool):
    """An import as written (`resolved=False`) or as the absolute name it stands for."""
    spec = entry["module"]
    name = entry["name"]
    if resolved:
        spec = F.when(F.col("script"), P.ts_specifier(spec, F.col("rel_path")))\
            .otherwise(P.absolutize(spec, F.col("package")))
    return F.when(name.isNull(), spec).otherwise(F.concat_ws(".", spec, name))


def _named(parsed: DataFrame) -> DataFrame:
    """Adds what the names of a file stand for, each computed once a file: `_named`, the qualified names of its
    definitions, and `_stands`, the absolute names of its imports."""
    names = F.struct(F.transform("defs", lambda d: _qualified(d["path"])).alias("_named"),
                     F.transform_values("imports", lambda _, e: _import_target(e, True)).alias("_stands"))
    # Exploded from one value, so that no later lambda computes it again for each reference.
    return parsed.select("*", F.inline(F.array(names)))


def _target(bound):
    """The absolute name a bound text refers to, where the file says; else the text itself."""
    text, local = bound["base"], bound["local"]
    rest = F.regexp_replace(text, r"(?s)^[^.]*\.?", "")
    via = F.element_at(F.col("_stands"), bound["imported"])
    return (F.when(local >= 0, F.get(F.col("_named"), local))
            .when(bound["imported"].isNotNull(), F.concat_ws(".", via, F.nullif(rest, F.lit(""))))
            .otherwise(text))


def symbols(parsed: DataFrame) -> DataFrame:
    """The module symbol of each file and every definition in it, with identities."""
    imports = F.transform(F.map_values("imports"), lambda e: _import_target(e, False))
    script_module = F.struct(
        F.lit("").alias("path"), F.lit("module").alias("kind"), F.lit(0).alias("arity"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("module "), F.col("module")).alias("signature"), F.col("docstring"),
        F.col("text").alias("source"), F.lit(None).cast("string").alias("enclosing"),
        F.array_sort(F.array_distinct(imports)).alias("used_imports"),
        F.array().cast("array<string>").alias("decorators"), F.array().cast("array<string>").alias("bases"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attributes"),
        F.transform(F.filter("defs", lambda d: d["parent"] == -1), lambda d: d["signature"]).alias("members"),
        F.lit(1).alias("start_line"), F.col("end_line"))

    def definition(d, i):
        used = F.array_sort(F.array_distinct(F.transform(
            F.filter(d["names"], lambda n: F.map_contains_key(F.col("imports"), n)),
            lambda n: _import_target(F.element_at(F.col("imports"), n), False))))
        bases = F.transform(F.filter(F.col("refs"), lambda r: (r["kind"] == "INHERITS") & (r["owner"] == i)), _target)
        attributes = F.map_from_arrays(F.transform(d["attributes"], lambda a: a["name"]),
                                       F.transform(d["attributes"], _target))
        return F.struct(d["path"].alias("path"), d["kind"].alias("kind"), d["arity"].alias("arity"),
                        d["ordinal"].alias("ordinal"), d["signature"].alias("signature"),
                        d["docstring"].alias("docstring"), d["source"].alias("source"),
                        d["enclosing"].alias("enclosing"), used.alias("used_imports"),
                        d["decorators"].alias("decorators"), bases.alias("bases"),
                        attributes.alias("attributes"), F.transform(F.filter(
                            F.col("defs"), lambda m: m["parent"] == i), lambda m: m["signature"]).alias("members"),
                        d["start_line"].alias("start_line"),
                        d["end_line"].alias("end_line"))

    every = F.concat(F.array(script_module), F.transform("defs", definition))
    rows = _named(parsed).select("repo_id", "rel_path", "module", "client", F.posexplode(every).alias("seq", "d"))
    qname = F.when(F.col("d.path") == "", F.col("module")).otherwise(_qualified(F.col("d.path")))
    out = rows.select(
        "repo_id", "rel_path", "seq", F.col("rel_path").alias("origin_path"), qname.alias("qualified_name"),
        F.when((F.col("d.path") == "") & (F.col("module") == ""), F.col("rel_path"))
        .otherwise(P.leaf(qname)).alias("name"),
        F.col("d.arity").alias("arity"), F.col("d.ordinal").alias("ordinal"), F.col("d.kind").alias("kind"),
        F.col("d.signature").alias("signature"), F.col("d.docstring").alias("docstring"),
        F.col("d.source").alias("source_code"), F.col("d.enclosing").alias("enclosing_signature"),
        F.col("d.used_imports").alias("used_imports"), F.col("d.decorators").alias("decorators"),
        F.col("d.bases").alias("bases"), F.col("d.attributes").alias("attributes"),
        F.col("d.members").alias("members"),
        F.col("d.start_line").alias("start_line"), F.col("d.end_line").alias("end_line"),
        F.col("client").alias("is_client_component"))
    return out.withColumn("uid", X.symbol_uid(*[F.col(c) for c in (
        "repo_id", "rel_path", "qualified_name", "arity", "ordinal")]))


def raw_edges(parsed: DataFrame) -> DataFrame:
    """Edges as the file states them: a target uid inside the file, else a hint to resolve."""
    def uid(path, arity, ordinal):
        return X.symbol_uid(F.col("repo_id"), F.col("rel_path"), path, arity, ordinal)

    uids = F.struct(F.transform("defs", lambda d, i: uid(F.get("_named", i), d["arity"], d["ordinal"])).alias("_uids"),
                    uid(F.col("module"), F.lit(0), F.lit(0)).alias("_own"))
    parsed = _named(parsed).select("*", F.inline(F.array(uids)))

    def uid_at(i):
        return F.when(i < 0, F.col("_own")).otherwise(F.get("_uids", i))

    none = F.lit(None).cast("string")

    def edge(source, kind, target=none, hint=none, mode=F.lit("ref")):
        return F.struct(source.alias("source_uid"), kind.alias("kind"), target.alias("target_uid"),
                        hint.alias("target_hint"), mode.alias("mode"))

    defines = F.transform("defs", lambda d, i: edge(uid_at(d["parent"]), F.lit("DEFINES"), F.get("_uids", i)))
    imports = F.transform(
        F.array_distinct(F.map_values("_stands")), lambda t: edge(uid_at(F.lit(-1)), F.lit("IMPORTS"), none, t))

    def reference(r):
        bare = r["mode"] == "ref"
        inside = bare & (r["local"] >= 0)
        hint = F.concat_ws(".", _target(r), r["member"])
        hook = F.col("script") & bare & (r["kind"] == "CALLS") & P.leaf(r["base"]).rlike(K.HOOK_NAME)
        return edge(uid_at(r["owner"]), F.when(hook, "INVOKES_HOOK").otherwise(r["kind"]),
                    F.when(inside, uid_at(r["local"])), F.when(~inside, hint), r["mode"])

    in_urls = F.col("rel_path").rlike(r"(^|/)urls\.py$")
    refs = F.transform(F.filter("refs", lambda r: (r["kind"] != "DISPATCHES_TO") | in_urls), reference)
    stem = F.regexp_extract("rel_path", r"([^/]*?)(\.[^./]*)?$", 1)
    routed = F.when(stem.isin(*K.RENDERING_FILES), "RENDERS").when(stem.isin(*K.HANDLER_FILES), "DISPATCHES_TO")
    router = F.when(F.col("script") & routed.isNotNull(), F.transform(
        F.filter(F.arrays_zip("defs", "_uids"), lambda d: d["defs"]["kind"] == "function"),
        lambda d: edge(uid_at(F.lit(-1)), routed, d["_uids"])))
    rows = parsed.withColumn("_router", router).select(
        "repo_id", F.col("rel_path").alias("origin_path"),
        F.explode(F.concat(defines, imports, refs, F.coalesce("_router", F.array().cast(
            "array<struct<source_uid:string,kind:string,target_uid:string,target_hint:string,mode:string>>"
        )))).alias("e"))
    return rows.select("repo_id", "e.source_uid", "e.kind", "origin_path", "e.target_uid", "e.target_hint",
                       "e.mode").filter("source_uid is not null")


def hooks_invoked(raw: DataFrame, symbols_: DataFrame) -> DataFrame:
    """The sorted distinct hook names each symbol calls."""
    hooks = raw.filter("kind = 'INVOKES_HOOK' and target_hint is not null").select(
        "repo_id", F.col("source_uid").alias("uid"), P.leaf(F.col("target_hint")).alias("hook")).distinct()
    return hooks.join(symbols_.select("repo_id", "uid", "qualified_name"), ["repo_id", "uid"])\
        .groupBy("repo_id", "qualified_name").agg(F.sort_array(F.collect_set("hook")).alias("hooks"))
