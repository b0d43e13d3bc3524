"""Symbols to what is stored and embedded: scrubbed text, hashes, search text and the chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from symtrail.functions import text as X
from symtrail.operators.packing import overflow_parts


def class_body(signature, docstring, members):
    doc = F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit('    """'), docstring, F.lit('"""')))
    rows = F.nullif(F.array_join(F.transform(members, lambda m: F.concat(F.lit("    "), m)), "\n"), F.lit(""))
    return F.concat_ws("\n", signature, doc, rows)


def module_body(imports, members):
    lines = F.transform(F.array_sort(imports), lambda n: F.concat(F.lit("import "), n))
    head = F.when(F.size(imports) > 0, F.concat(lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, members), "\n")


def with_keys(symbols: DataFrame) -> DataFrame:
    """Adds `cache_key`, under which the vector of a chunk is kept."""
    return symbols.withColumn("cache_key", X.cache_key(F.col("header_hash"), F.col("body_hash")))


def with_chunks(symbols: DataFrame) -> DataFrame:
    """Scrub first, then hash, then build the chunk: a rule change must reach the hashes.

    A class chunk shows its members' signatures, a module chunk its imports and top level; only the
    first part of an oversized chunk is kept."""
    scrubbed = symbols
    for c in ("source_code", "signature", "docstring", "enclosing_signature"):
        scrubbed = scrubbed.withColumn(c, X.scrub(F.col(c)))
    scrubbed = scrubbed.withColumn("decorators", F.transform("decorators", X.scrub)).withColumn(
        "members", F.transform("members", X.scrub))
    col = F.col
    hashed = with_keys(scrubbed.withColumn("header_hash", X.header_hash(
        col("rel_path"), col("enclosing_signature"), col("signature"), col("used_imports"))).withColumn(
            "body_hash", X.body_hash(col("source_code")))).withColumn(
                "search_text", X.search_text(col("name"), col("qualified_name"), col("docstring")))
    body = (F.when(col("kind") == "class", class_body(col("signature"), col("docstring"), col("members")))
            .when(col("kind") == "module", module_body(col("used_imports"), col("members"))).otherwise(col("source_code")))
    header = X.context_header(col("rel_path"), col("enclosing_signature"), col("signature"), col("used_imports"))
    return hashed.withColumn("chunk_text", F.get(overflow_parts(body, header), F.lit(0)))
