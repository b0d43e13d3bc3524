"""Exact dedup by deterministic block naming, in DataFrame operations only.

The normalised text is cut into blocks of a fixed size.  A block's integer name is its hash bucket and
its place in the sorted distinct blocks of that bucket, so different blocks never share a name.  Adjacent
names are then named as pairs in the same way, level by level, until a document has one name; with the
length in bytes it is the document's identity.

Almost every bucket holds one block.  The ends of each sorted bucket (its least and greatest block) show
the others, and only their blocks are ranked and looked up, so a level needs one aggregation and text is
shuffled once, after blocks were combined inside each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from symtrail.session import cut

BLOCK_BYTES = 2048

#: Bits of a bucket; the other bits of a positive long hold the place in the bucket.
BUCKET_BITS = 54

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z (and nothing else) lower-cased; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _bucket(bits: int, *parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << bits) - 1))


def _blocks(data: Column, size: int) -> Column:
    """The blocks of binary `data`; none of empty data."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    cut_out = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substr(data, i * size + 1, F.lit(size)))
    return F.when(n > 0, cut_out).otherwise(F.array().cast("array<binary>"))


def _ranked(contents: DataFrame, keys: list[str], bits: int) -> DataFrame | None:
    """(keys, content, place) of all buckets of `contents` (keys, content) with more than one content."""
    ends = contents.groupBy(*keys).agg(F.min("content").alias("least"), F.max("content").alias("most"))
    mixed = cut(ends.filter("least != most").select(*keys))
    if mixed.isEmpty():
        return None
    members = contents.join(mixed, keys).select(*keys, "content").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("content")) - 1
    room = 1 << (63 - bits)
    return cut(members.withColumn("place", F.when(place < room, place).otherwise(F.raise_error(F.lit("a bucket of block names is full"))).cast("long")))


def _patched(slim: DataFrame, found: DataFrame) -> DataFrame:
    """`slim` with the places of `found` (row, position, place) added to its names."""
    places = found.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("position", "place"))).alias("places"))
    return cut(
        slim.join(places, "row", "left")
        .withColumn("names", F.when(F.col("places").isNull(), F.col("names")).otherwise(
            F.transform("names", lambda x, i: x + F.coalesce(F.try_element_at("places", i), F.lit(0).cast("long")))))
        .drop("places"))


def _paired(names: Column, bits: int) -> Column:
    """Names of adjacent pairs, as if every bucket held one pair; the odd last name pairs with null."""
    left = F.filter(names, lambda x, i: i % 2 == 0)
    right = F.filter(names, lambda x, i: i % 2 == 1)
    return F.zip_with(left, right, lambda a, b: F.shiftleft(_bucket(bits, a, b), 63 - bits))


def _folded(names: Column, steps: Column, bits: int) -> Column:
    """`names` after `steps` levels of pairing."""
    empty = F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))
    return F.when(steps <= 0, names).otherwise(F.aggregate(empty, names, lambda acc, _: _paired(acc, bits)))


def _levels(names: Column) -> Column:
    """Levels of pairing until one name is left."""
    return F.when(F.size(names) <= 1, F.lit(0)).otherwise(F.ceil(F.log2(F.size(names).cast("double")))).cast("int")


def _pairs(slim: DataFrame, bits: int) -> DataFrame:
    """(row, level, position, bucket, content) of all pairs on the way to one name."""
    by_level = slim.filter(F.size("names") > 1).select(
        "row", "names", F.explode(F.sequence(F.lit(1), _levels(F.col("names")))).alias("level"))
    at = by_level.select("row", "level", _folded(F.col("names"), F.col("level") - 1, bits).alias("names"))
    left = F.filter("names", lambda x, i: i % 2 == 0)
    right = F.filter("names", lambda x, i: i % 2 == 1)
    zipped = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return at.select("row", "level", F.posexplode(zipped).alias("position", "content")).withColumn(
        "bucket", _bucket(bits, F.col("content.a"), F.col("content.b")))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = BUCKET_BITS) -> DataFrame:
    """(doc_id, text_sha256, n_bytes, name): equal (n_bytes, name) if and only if normalised texts are equal."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("normal"))
    data = F.col("normal").cast("binary")
    row = F.struct(F.col("doc_id"), F.sha2(data, 256).alias("text_sha256"), F.octet_length("normal").alias("n_bytes")).alias("row")
    blocks = texts.select(row, _blocks(data, block_bytes).alias("blocks"))
    slim = cut(blocks.select("row", F.transform("blocks", lambda b: F.shiftleft(_bucket(bits, b), 63 - bits)).alias("names")))

    contents = texts.select(F.explode(_blocks(data, block_bytes)).alias("content")).withColumn("bucket", _bucket(bits, F.col("content")))
    ranked = _ranked(contents.select("bucket", "content"), ["bucket"], bits)
    if ranked is not None:
        placed = blocks.select("row", F.posexplode("blocks").alias("position", "content")).withColumn("bucket", _bucket(bits, F.col("content")))
        slim = _patched(slim, placed.join(ranked.filter("place > 0"), ["bucket", "content"]).select("row", "position", "place"))

    done = slim.filter("size(names) <= 1")
    rest = slim.filter("size(names) > 1")
    while True:
        pairs = _pairs(rest, bits)
        ranked = _ranked(pairs.select("level", "bucket", "content"), ["level", "bucket"], bits)
        if ranked is None:
            named = rest.withColumn("names", _folded(F.col("names"), _levels(F.col("names")), bits))
            break
        # names up to the first level with a shared bucket are right; those above follow from mended ones
        level = ranked.agg(F.min("level")).first()[0]
        shorter = rest.withColumn("names", _folded(F.col("names"), F.least(_levels(F.col("names")), F.lit(level)), bits))
        exact = ranked.filter((F.col("level") == level) & (F.col("place") > 0)).drop("level")
        found = pairs.filter(F.col("level") == level).drop("level").alias("p").join(
            exact.alias("r"), (F.col("p.bucket") == F.col("r.bucket")) & F.col("p.content").eqNullSafe(F.col("r.content")))
        shorter = _patched(shorter, found.select("p.row", "p.position", "r.place"))
        done = done.unionByName(shorter.filter("size(names) <= 1"))
        rest = shorter.filter("size(names) > 1")
    return done.unionByName(named).select("row.*", F.coalesce(F.try_element_at("names", F.lit(1)), F.lit(0).cast("long")).alias("name"))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = BUCKET_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs` (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; of equal texts the greatest doc_id stays.
    Null text counts as empty.  Rows that repeat the kept doc_id are all marked as kept; in a group whose
    ids are all null, keep_id is null and all are kept.  An empty table gives no rows; other columns are
    not read."""
    named = cut(identities(docs, block_bytes, bits))
    groups = named.groupBy("n_bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["n_bytes", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = BUCKET_BITS) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of equal texts the one with the greatest doc_id.

    Of rows that repeat both id and text one stays."""
    groups = cut(exact_groups(docs, block_bytes, bits))
    gone = groups.filter("not kept").select(F.struct("doc_id", "text_sha256").alias("symtrail gone")).distinct()
    key = "symtrail key"
    rows = docs.withColumn(key, F.struct(docs["doc_id"].alias("doc_id"), F.sha2(normalised(docs["text"]).cast("binary"), 256).alias("text_sha256")))
    rows = rows.join(gone, F.col(key).eqNullSafe(F.col("symtrail gone")), "left_anti")
    if not groups.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([key])
    return rows.drop(key)


SQL = """
with named as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') normal from documents),
groups as (select normal, max(doc_id) keep_id, count(*) group_size from named group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id kept, sha256(normal) text_sha256
from named join groups using (normal)
"""
