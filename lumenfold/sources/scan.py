"""Catalog scans of a source table. Predicates and columns reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_first(df: DataFrame, when: str = "date_modified", key: str = "media_id") -> DataFrame:
    return df.orderBy(F.desc(when), F.desc(key))


def full_scan(source: DataFrame, numbers: tuple[str, ...] = ()) -> DataFrame:
    """All rows, newest first; null numbers become 0."""
    return newest_first(source.withColumns({c: F.coalesce(c, F.lit(0).cast(source.schema[c].dataType)) for c in numbers}))


def latest(source: DataFrame) -> DataFrame:
    return newest_first(source).limit(1)


def newer_than(date_modified: int | Column, media_id: int | Column) -> Column:
    """Keyset predicate; both halves are pushed down."""
    return (F.col("date_modified") > date_modified) | ((F.col("date_modified") == date_modified) & (F.col("media_id") > media_id))


def sample(source: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash of the id: the same whatever the partitioning."""
    return source.orderBy(F.xxhash64("media_id", F.lit(seed)), "media_id").limit(n)


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("media_id"), "media_id", "left_semi")
