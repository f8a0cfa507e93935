"""Indexing telemetry from batch rows: wall time, running counters, throughput, shares per image, the log's columns.

Windows are over a run's batches (one row per batch of images), partitioned by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.scalars import per_second

LOG_COLUMNS = ["timestamp_ms", "indexed", "pending", "failed", "batch_size", "e2e_ips", "infer_ips", "batch_ms", "work_ms", "wall_ms", "infer_ms", "prep_ms", "decode_ms", "tensor_ms", "write_ms", "backend", "status"]


def wall_times(batches: DataFrame, run: str = "run_id") -> DataFrame:
    """wall_ms: since the previous batch completed; of the first one, since its own start."""
    w = W.partitionBy(run).orderBy("completed_ms", "batch_id")
    return batches.withColumn("wall_ms", F.col("completed_ms") - F.coalesce(F.lag("completed_ms").over(w), F.col("started_ms")))


def throughput(batches: DataFrame) -> DataFrame:
    return batches.withColumn("e2e_ips", per_second(F.col("n"), F.col("wall_ms"))).withColumn("infer_ips", per_second(F.col("n"), F.col("infer_ms")))


def running(batches: DataFrame, indexed: int, pending: int, failed: int, retry: bool = False, run: str = "run_id") -> DataFrame:
    """Counters after each batch: n_ok and n_failed of it added to the start; pending never drops below 0."""
    w = W.partitionBy(run).orderBy("completed_ms", "batch_id").rowsBetween(W.unboundedPreceding, 0)
    ok, bad = F.sum("n_ok").over(w), F.sum("n_failed").over(w)
    taken = F.lit(pending) if retry else F.greatest(F.lit(pending) - ok - bad, F.lit(0))
    return batches.withColumns({"indexed": F.lit(indexed) + ok, "pending": taken, "failed": F.lit(failed) + bad - (ok + bad if retry else F.lit(0))})


def per_image(ms: Column, batch_size: Column) -> Column:
    return ms / F.greatest(batch_size, F.lit(1))


def work_ms(prepared: Column, after: Column) -> Column:
    """A batch's own time: preparing it, and everything behind that."""
    return prepared + after


def other_time(total: Column, *known: Column) -> Column:
    return F.greatest(F.lit(0.0), total - sum((F.coalesce(k, F.lit(0.0)) for k in known), F.lit(0.0)))


def batch_timings(images: DataFrame) -> DataFrame:
    """Decode and tensor milliseconds and the joined media keys of each batch, in order of place."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "media_key"))), lambda x: x["media_key"]), "+")
    return images.groupBy("batch_id").agg(F.sum("decode_ms").alias("decode_ms"), F.sum("tensor_ms").alias("tensor_ms"), keys.alias("media_keys"))


def log_lines(batches: DataFrame) -> DataFrame:
    """The log's columns as text: fractions with three digits, missing values empty."""
    fractions = {"e2e_ips", "infer_ips", "batch_ms", "work_ms", "wall_ms", "infer_ms", "prep_ms", "decode_ms", "tensor_ms", "write_ms"}
    shown = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c).cast("double"))) if c in fractions else F.col(c).cast("string")
    return batches.select(*[F.coalesce(shown(c), F.lit("")).alias(c) for c in LOG_COLUMNS])
