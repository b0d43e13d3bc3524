"""Embedding providers and the content-addressed cache in front of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from symtrail import constants as K
from symtrail.functions import vectors as V
from symtrail.counters import Counters
from symtrail.operators.keyed import lookup
from symtrail.operators.maintenance import cache_split
from symtrail.session import cut


class EmbeddingUnavailable(RuntimeError):
    """The provider cannot be used; indexing goes on with cached vectors only."""


@dataclass
class HashProvider:
    """Deterministic vectors without meaning: for tests of the write path, never for search."""

    dimensions: int = K.EMBED_DIM
    name: str = "hash"
    semantic: bool = False
    local: bool = True

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.withColumn("vector", V.hash_embedding(F.col("text"), self.dimensions).cast("array<float>"))


@dataclass
class DisabledProvider:
    dimensions: int = K.EMBED_DIM
    name: str = "none"
    semantic: bool = False
    local: bool = True

    def embed(self, texts: DataFrame) -> DataFrame:
        raise EmbeddingUnavailable("no embedding provider is configured")


@dataclass
class BatchProvider:
    """Any model behind a function from a batch of texts to vectors, called once per Arrow batch."""

    function: Callable[[list[str]], list[list[float]]]
    dimensions: int
    name: str
    semantic: bool = True
    local: bool = True         # costs nothing to run, so a whole repository may be embedded again unasked

    def embed(self, texts: DataFrame) -> DataFrame:
        call = self.function

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(list(call(batch.tolist())), dtype="object")

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return texts.withColumn("vector", F.pandas_udf(run, T.ArrayType(T.FloatType()))("text"))


def embed_symbols(symbols: DataFrame, cache: DataFrame, provider, stored: DataFrame | None = None, counters: Counters | None = None):
    """`(uid -> vector, new cache rows)`; each cold key is embedded once.

    An unavailable provider degrades to what the cache holds.  Look-ups, hits and misses are counted on the
    rows as they are split, and so is a provider that was not there."""
    mine = cache.filter(F.col("dimensions") == provider.dimensions)
    split = cache_split(symbols, mine, provider.name, stored)
    if counters is not None:
        split = cut(counters.watch(split, {
            "cache.lookups": F.count(F.lit(1)), "cache.hits": F.count_if("hit"),
            "cache.miss.total": F.count_if(~F.col("hit")), "cache.miss.header_only": F.count_if("header_only")}))
    cold = split.filter("not hit").select("cache_key", F.coalesce("chunk_text", F.lit("")).alias("text"))\
        .dropDuplicates(["cache_key"])
    try:
        fresh = provider.embed(cold).select(F.lit(provider.name).alias("model"), "cache_key",
                                            F.lit(provider.dimensions).alias("dimensions"), "vector")
    except EmbeddingUnavailable:
        fresh = cache.limit(0)
        if counters is not None:
            counters.add("index.embedding_unavailable")
    new = split.filter("not hit").select("uid", "cache_key").join(fresh.select("cache_key", "vector"), "cache_key").select("uid", "vector")
    return split.filter("hit").select("uid", "vector").unionByName(new), fresh


# -- which model a repository was embedded with ------------------------------------------------------------

def embedder_key(repo_id: Column) -> Column:
    return F.concat(F.lit("index_embed_model:"), repo_id)


def _recorded(repos: DataFrame, meta: DataFrame) -> DataFrame:
    recorded = meta.select(F.col("key").alias("_key"), F.col("value").alias("recorded"))
    return lookup(repos.select("repo_id").distinct().withColumn("_key", embedder_key(F.col("repo_id"))), recorded, ["_key"]).drop("_key")


def vector_gate(repos: DataFrame, meta: DataFrame, provider) -> DataFrame:
    """`repo_id, recorded, usable, reason`: whether queries may use vectors, and why not when they may not.

    Vectors of two models share a column and no space, and vectors without meaning rank at random."""
    same = F.col("recorded").eqNullSafe(F.lit(provider.name))
    was = F.concat(F.lit("the index was embedded with "), F.coalesce("recorded", F.lit("no embedding model")),
                   F.lit(f", not {provider.name}: index again to use vector search"))
    semantic = F.lit(bool(provider.semantic))
    return _recorded(repos, meta).select(
        "repo_id", "recorded", (semantic & same).alias("usable"),
        F.when(~semantic, "no embedding model is configured").when(~same, was).otherwise("").alias("reason"))


def bootstrap_decision(repos: DataFrame, known: DataFrame, meta: DataFrame, provider) -> DataFrame:
    """`repo_id, action, note`: what brings a repository level with its tree at a start.

    `index` where no file is `known` (repo_id); `reembed` where another model wrote the vectors and the
    present one is local; else `reconcile`, with a note where vectors stay off because the model is billed."""
    held = known.select("repo_id").distinct().withColumn("_known", F.lit(True))
    rows = lookup(_recorded(repos, meta), held, ["repo_id"])
    stale = F.lit(bool(provider.semantic)) & ~F.col("recorded").eqNullSafe(F.lit(provider.name))
    fresh = F.col("_known").isNull()
    note = F.concat(F.lit("embedded with "), F.coalesce("recorded", F.lit("no embedding model")), F.lit("; vector search stays off until it is indexed again"))
    return rows.select(
        "repo_id", F.when(fresh, "index").when(stale & F.lit(bool(provider.local)), "reembed").otherwise("reconcile").alias("action"),
        F.when(~fresh & stale & ~F.lit(bool(provider.local)), note).otherwise("").alias("note"))
