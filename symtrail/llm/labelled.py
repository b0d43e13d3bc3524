"""Bounded samples of labelled documents, and the id hash that holds documents out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from symtrail.operators.metrics import seeded_sample
from symtrail.session import cut, small

#: Where a fit reads whole texts, longer ones do not serve as training rows (they are predicted like all others).
LONGEST_TRAINING_TEXT = 200_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def sample(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, per_class: bool = False) -> DataFrame:
    """At most `rows` (doc_id, label) pairs (of each class with `per_class`), the same on every run.

    Rows with a null id or label or of the held-out remainder are left out; of several labels of one
    document the greatest counts.  Documents are those with the least hash of their id, up to a threshold
    that is found by counting hashes, so no task takes `rows` of them from every other."""
    usable = labels.select("doc_id", F.col(label).alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    one = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    return cut(seeded_sample(one, rows, [F.col("doc_id")], strata=["label"] if per_class else None))


def with_label(docs: DataFrame, chosen: DataFrame, *columns: str, longest: int | None = LONGEST_TRAINING_TEXT) -> DataFrame:
    """`columns` (text among them) of the chosen documents with their label, one row each; `chosen` is a
    bounded sample.  Of several texts of one id that with the least MD5 counts."""
    own = docs.select("doc_id", *columns).filter(F.col("text").isNotNull())
    if longest is not None:
        own = own.filter(F.octet_length("text") <= longest)
    pairs = chosen.select("doc_id", "label")
    found = own.join(F.broadcast(pairs) if small(pairs) else pairs, "doc_id")
    best = F.min_by(F.struct(*columns), F.md5(F.col("text").cast("binary"))).alias("row")
    return found.groupBy("doc_id", "label").agg(best).select("doc_id", *[f"row.{c}" for c in columns], "label")
