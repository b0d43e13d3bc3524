"""Column builders for vectors and source-map segments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from symtrail import constants as K


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    length = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: x / length)


def zero_pad(vector: Column, width: int = K.EMBED_DIM) -> Column:
    """Right-pad with zeros to `width`; a wider vector is an error, never truncated."""
    too_wide = F.raise_error(F.lit(f"vector wider than {width}"))
    return F.when(F.size(vector) > width, too_wide.cast("array<float>")).otherwise(
        F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(vector))))


def hash_embedding(text: Column, dimensions: int = K.EMBED_DIM) -> Column:
    """A deterministic unit vector from SHA-256 blocks of the text; it carries no meaning."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((dimensions + 7) // 8 - 1)), lambda i: F.sha2(
        F.concat(i.cast("string"), F.lit("\x00"), text).cast("binary"), 256))
    words = F.flatten(F.transform(blocks, lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda w: F.conv(F.substring(h, w * 8 + 1, F.lit(8)), 16, 10).cast("double"))))
    scaled = F.transform(F.slice(words, 1, dimensions),
                         lambda v: v / F.lit(float(0xFFFFFFFF)) * 2.0 - 1.0)
    return unit(scaled)


#: The characters that carry 5 bits on and those that end a field, and what base 32 writes for the same 5 bits.
_VLQ_LAST, _VLQ_MORE, _BASE_32 = K.VLQ_ALPHABET[:32], K.VLQ_ALPHABET[32:], "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def vlq_decode(segment: Column) -> Column:
    """Base64 VLQ fields of one mapping segment: 5 bits a character, the lowest bit is the sign.

    A field is a number in base 32 with its least digit first.  A character outside the alphabet ends a field and
    counts 31; a field that does not end is left out."""
    known = F.regexp_replace(segment, f"[^{K.VLQ_ALPHABET}]", _VLQ_LAST[-1])
    fields = F.regexp_extract_all(known, F.lit(f"[{_VLQ_MORE}]*[{_VLQ_LAST}]"), F.lit(0))
    digits = lambda f: F.reverse(F.translate(f, _VLQ_MORE + _VLQ_LAST, _BASE_32 * 2))
    numbers = F.transform(fields, lambda f: F.conv(digits(f), 32, 10).cast("bigint"))
    return F.transform(numbers, lambda n: F.when(n.bitwiseAND(F.lit(1)) == 1, -F.shiftright(n, 1)).otherwise(F.shiftright(n, 1)))


def vlq_encode(fields: Column) -> Column:
    """The inverse of `vlq_decode` (used to derive mapping tables from integer columns)."""
    numbers = F.transform(fields, lambda v: F.abs(v.cast("bigint")) * 2 + F.when(v < 0, 1).otherwise(0))
    digits = F.transform(numbers, lambda n: F.conv(n.cast("string"), 10, 32))
    return F.array_join(F.transform(digits, lambda d: F.concat(
        F.translate(F.reverse(F.substr(d, F.lit(2))), _BASE_32, _VLQ_MORE), F.translate(F.left(d, F.lit(1)), _BASE_32, _VLQ_LAST))), "")
