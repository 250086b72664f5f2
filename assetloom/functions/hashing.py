"""Content digests and framed composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(content, 256)


def _le(value: Column, width: int) -> Column:
    """Little-endian bytes of a non-negative integer."""
    digits = F.lpad(F.hex(value.cast("bigint")), width * 2, "0")
    pairs = [F.substring(digits, width * 2 - 2 * i - 1, 2) for i in range(width)]
    return F.unhex(F.concat(*pairs))


def frame(tag: int, value: Column) -> Column:
    """One length-prefixed field: tag byte, 8-byte length, bytes."""
    body = value.cast("binary")
    return F.concat(F.unhex(F.lit(f"{tag:02X}")), _le(F.octet_length(body), 8), body)


def cache_key(version: str, features: Column | str, recipe_hash: Column, quality: Column,
              ext: Column, input_hash: Column, schema_version: int = 1) -> Column:
    """Digest over framed fields, so no two field splits can collide.

    A missing quality takes its own tag and therefore never equals any number.
    """
    features = F.lit(features) if isinstance(features, str) else features
    level = F.when(quality.isNotNull(), frame(4, _le(quality, 1))).otherwise(
        frame(5, F.unhex(F.lit(""))))
    return F.sha2(F.concat(
        frame(0, _le(F.lit(schema_version), 4)),
        frame(1, F.lit(version)),
        frame(2, features),
        frame(3, F.unhex(recipe_hash)),
        level,
        frame(6, F.lower(ext)),
        frame(7, F.unhex(input_hash)),
    ), 256)
