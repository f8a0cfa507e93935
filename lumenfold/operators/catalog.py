"""The catalog: change-detecting sync and upsert, state transitions, ordered reads and statistics.

All are joins and CASE expressions on media_id that give a new snapshot; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.scalars import clipped
from lumenfold.schemas import CATALOG_COLUMNS, FAILED, INDEXED, NO_OFFSET, PENDING, SCAN_COLUMNS
from lumenfold.sources.scan import newest_first


class SourceUnavailable(RuntimeError):
    """A full sync from a source that can't be read would delete the whole catalog."""


def last_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert-or-replace: the last row of a key wins; of rows with equal order the one whose other columns are greatest. max
    is a partial aggregate, so a hot key doesn't gather. Columns have to be comparable (no maps)."""
    others = [c for c in rows.columns if c not in key and c != order]
    return rows.groupBy(*key).agg(F.max(F.struct(order, *others)).alias("_last")).select(*key, "_last.*").select(*rows.columns)


def changed(model: str, old: str = "e", new: str = "s") -> Column:
    """New, or another time of change, size or model. Other metadata alone isn't a change."""
    same = F.col(f"{old}.date_modified").eqNullSafe(F.col(f"{new}.date_modified")) & F.col(f"{old}.size_bytes").eqNullSafe(F.col(f"{new}.size_bytes")) & F.col(f"{old}.model_version").eqNullSafe(F.lit(model))
    return F.col(f"{old}.media_id").isNull() | ~same


def _fresh(model: str) -> dict[str, Column]:
    return {"status": F.lit(PENDING), "vector_offset": F.lit(NO_OFFSET).cast("long"), "vector_dim": F.lit(0), "indexed_at": F.lit(0).cast("long"), "model_version": F.lit(model), "error": F.lit(None).cast("string"), "retry_count": F.lit(0)}


def _merged(scan: DataFrame, catalog: DataFrame, model: str, how: str) -> DataFrame:
    # a scan that names a row twice means its last state
    scan = last_of_each(scan, ["media_id"], "date_modified")
    j = scan.alias("s").join(catalog.alias("e"), F.col("s.media_id") == F.col("e.media_id"), how)
    fresh, seen = _fresh(model), F.col("s.media_id").isNotNull()
    is_new = seen & changed(model)
    row = {c: F.when(is_new, fresh[c] if c in fresh else F.col(f"s.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in CATALOG_COLUMNS}
    return j.select(*row.values(), is_new.alias("_changed"), seen.alias("_seen"))


def sync_full(scan: DataFrame, catalog: DataFrame, model: str, source_available: bool = True) -> DataFrame:
    """The catalog after a full scan: new and changed rows are pending anew, unchanged rows stay, absent ones go."""
    if not source_available:
        raise SourceUnavailable("refusing a full sync: the source can't be read")
    return _merged(scan.select(*SCAN_COLUMNS), catalog, model, "left").select(*CATALOG_COLUMNS)


def deleted_by_sync(scan: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.join(scan.select("media_id"), "media_id", "left_anti")


def upsert(scan: DataFrame, catalog: DataFrame, model: str) -> DataFrame:
    """The catalog after a partial scan: like sync_full, but rows the scan doesn't name stay. One join."""
    return _merged(scan.select(*SCAN_COLUMNS), catalog, model, "full").select(*CATALOG_COLUMNS)


def changed_rows(scan: DataFrame, catalog: DataFrame, model: str) -> DataFrame:
    return _merged(scan.select(*SCAN_COLUMNS), catalog, model, "left").where("_changed").select("media_id")


def _transition(catalog: DataFrame, updates: DataFrame, hit: Column, changes: dict[str, Column]) -> DataFrame:
    j = catalog.alias("e").join(updates.alias("u"), F.col("e.media_id") == F.col("u.media_id"), "left")
    on = F.col("u.media_id").isNotNull() & hit
    return j.select(*[F.when(on, changes[c]).otherwise(F.col(f"e.{c}")).alias(c) if c in changes else F.col(f"e.{c}") for c in CATALOG_COLUMNS])


def mark_indexed(catalog: DataFrame, items: DataFrame, model: str, indexed_at: int) -> DataFrame:
    """items: media_id, vector_offset, vector_dim. The error goes, the number of retries stays."""
    return _transition(catalog, items, F.lit(True), {"status": F.lit(INDEXED), "vector_offset": F.col("u.vector_offset"), "vector_dim": F.col("u.vector_dim"), "indexed_at": F.lit(indexed_at).cast("long"), "model_version": F.lit(model), "error": F.lit(None).cast("string")})


def mark_failed(catalog: DataFrame, failures: DataFrame) -> DataFrame:
    """failures: media_id, message."""
    return _transition(catalog, failures, F.lit(True), {"status": F.lit(FAILED), "error": clipped(F.col("u.message")), "retry_count": F.col("e.retry_count") + 1})


def reset_failed(catalog: DataFrame, media_id: int | None = None) -> DataFrame:
    on = F.col("status") == FAILED
    on = on if media_id is None else on & (F.col("media_id") == media_id)
    return catalog.withColumns({"error": F.when(on, F.lit(None).cast("string")).otherwise(F.col("error")), "status": F.when(on, F.lit(PENDING)).otherwise(F.col("status"))})


def cleared(table: DataFrame) -> DataFrame:
    return table.limit(0)


def pending(catalog: DataFrame, limit: int) -> DataFrame:
    return newest_first(catalog.where(F.col("status") == PENDING)).limit(limit)


def recent(catalog: DataFrame, limit: int) -> DataFrame:
    return newest_first(catalog.where(F.col("status") == INDEXED)).limit(limit).withColumn("score", F.lit(float("nan")))


def failed(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    rows = catalog.where(F.col("status") == FAILED).orderBy(F.desc("retry_count"), F.desc("date_modified"), F.desc("media_id"))
    return rows if limit is None else rows.limit(limit)


def by_offset(catalog: DataFrame) -> DataFrame:
    return catalog.where((F.col("status") == INDEXED) & (F.col("vector_offset") >= 0)).orderBy("vector_offset", "media_id")


def next_batch(catalog: DataFrame, in_flight: DataFrame, size: int) -> DataFrame:
    """The newest pending rows that aren't being worked on."""
    rows = catalog.where(F.col("status") == PENDING).join(in_flight.select("media_id"), "media_id", "left_anti")
    return newest_first(rows).limit(size)


def batches(rows: DataFrame, size: int) -> DataFrame:
    """batch_id by order of the rows. The order is global, so this is for the bounded lists that a batch job takes."""
    order = W.orderBy(F.desc("date_modified"), F.desc("media_id"))
    return rows.withColumn("batch_id", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def stats(catalog: DataFrame) -> DataFrame:
    """One pass; an unknown status counts in the total only."""
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return catalog.agg(F.count("*").alias("total"), n(INDEXED, "indexed"), n(PENDING, "pending"), n(FAILED, "failed"))


def fingerprint(catalog: DataFrame, file_length: int) -> DataFrame:
    rows = (F.col("status") == INDEXED) & (F.col("vector_offset") >= 0)
    return catalog.agg(F.count_if(rows).alias("indexed_record_count")).withColumn("vector_file_length", F.lit(file_length).cast("long"))
