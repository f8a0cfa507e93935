"""Audit of catalog rows against the vector file, the load filter, and offset assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.schemas import INDEXED
from lumenfold.sources.files import work_path

_BYTES, _MAX_INT = 4, 2**31 - 1


def _end() -> Column:
    return F.col("vector_offset") + F.col("vector_dim").cast("long") * _BYTES


def audit(catalog: DataFrame, file_length: int) -> DataFrame:
    """One row of counts. Duplicate offsets come from a two-level aggregate; out-of-range ends are compared as numbers."""
    rows = catalog.where(F.col("status") == INDEXED)
    out_of_range = _end() > file_length
    invalid = (F.col("vector_offset") < 0) | (F.col("vector_dim") <= 0) | (F.col("vector_offset") % _BYTES != 0) | out_of_range
    counts = rows.agg(F.count_if(F.col("vector_offset") >= 0).alias("indexed_vector_count"), F.count_if(invalid).alias("invalid_record_count"), F.count_if(out_of_range).alias("out_of_range_count"))
    twice = rows.where("vector_offset >= 0").groupBy("vector_offset").agg(F.count("*").alias("n")).where("n > 1")
    dups = twice.agg(F.count("*").alias("duplicate_offset_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_offset_rows"))
    both = counts.crossJoin(dups)  # one row each
    return both.withColumn("is_corrupt", (F.col("invalid_record_count") > 0) | (F.col("duplicate_offset_rows") > 0))


def valid_metadata(file_length: int) -> Column:
    o, d = F.col("vector_offset"), F.col("vector_dim").cast("long")
    return F.lit(file_length > 0) & (o >= 0) & (d > 0) & (o % _BYTES == 0) & (o / _BYTES <= _MAX_INT) & (d * _BYTES <= _MAX_INT) & (o <= F.lit(file_length) - d * _BYTES)


def loadable(catalog: DataFrame, file_length: int) -> DataFrame:
    return catalog.where(valid_metadata(file_length))


def skipped(catalog: DataFrame, file_length: int) -> DataFrame:
    return catalog.agg(F.count_if(valid_metadata(file_length)).alias("kept"), F.count_if(~F.coalesce(valid_metadata(file_length), F.lit(False))).alias("skipped"))


def assign_offsets(batch: DataFrame, base: int, dim: int, order: str = "media_id") -> DataFrame:
    """Offsets of a new batch in order. Rows are written by ranges of the order and numbered within each range, after the
    rows of the ranges before it; the driver holds one count per range."""
    if dim <= 0 or base < 0:
        raise ValueError(f"no offsets of dimension {dim} from byte {base}")
    spark = batch.sparkSession
    ranged = batch.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_range", F.spark_partition_id())
    path = work_path(spark, "offsets")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    before, starts = 0, [(-1, 0)]
    for k, n in sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect()):
        starts.append((k, before))
        before += n
    told = F.broadcast(spark.createDataFrame(starts, "_range int, _before long"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    placed = ranged.join(told, "_range").withColumn("vector_offset", F.lit(base) + place.cast("long") * dim * _BYTES)
    return placed.drop("_range", "_before").withColumn("vector_dim", F.lit(dim))
