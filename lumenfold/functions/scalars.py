"""Small scalar functions: keys, truncation, defaults, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.schemas import ERROR_CHARS, FAILED, INDEXED, PENDING


def status_or_pending(c: Column) -> Column:
    return F.when(c.isin(PENDING, INDEXED, FAILED), c).otherwise(F.lit(PENDING))


def clipped(c: Column, chars: int = ERROR_CHARS) -> Column:
    return F.substring(c, 1, chars)


def model_version(model_id: Column, version: Column) -> Column:
    return F.concat_ws(":", model_id, version)


def text_cache_key(model_id: Column, version: Column, file_name: Column, dim: Column) -> Column:
    return F.concat_ws(":", model_id, version, file_name, dim)


def thumbnail_key(media_id: Column, date_modified: Column, size_bytes: Column, pixels: int = 256) -> Column:
    return F.concat_ws(":", F.lit("photo-thumbnail"), media_id, date_modified, size_bytes, F.lit(pixels))


def content_uri(base: str, media_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), media_id)


def string_hash_hex(c: Column) -> Column:
    """Unsigned hex of the 31-polynomial hash over UTF-16 units, for media keys. Units come from the UTF-16 bytes."""
    raw = F.hex(F.encode(c, "UTF-16BE"))
    units = F.transform(F.regexp_extract_all(raw, F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    return F.lower(F.hex(F.aggregate(units, F.lit(0).cast("long"), lambda h, u: F.pmod(h * 31 + u, F.lit(1 << 32)))))


def per_second(count: Column, millis: Column) -> Column:
    return F.when(millis > 0, count * F.lit(1000.0) / millis)


def shown(c: Column, pattern: str, missing: str = "--") -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.format_string(pattern, c)), F.lit(missing))
