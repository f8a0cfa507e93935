"""Incremental ingestion: scan files arrive as a stream, each micro-batch is upserted into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.operators.catalog import last_of_each
from lumenfold.plans.store import Store
from lumenfold.schemas import SCAN


def upsert_stream(spark: SparkSession, folder: str, store: Store, model: str, checkpoint: str) -> StreamingQuery:
    """Drains what is there and stops (availableNow); the checkpoint is the anchor for the next run. A batch that is
    replayed after a failure changes nothing, as its commit is known by its number. Only buckets in which a row changes are
    written."""

    def take(batch: DataFrame, epoch: int) -> None:
        store.upsert(last_of_each(batch, ["media_id"], "date_modified"), model, key=(checkpoint, epoch))

    return spark.readStream.schema(SCAN).parquet(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Scan events per window and type, closed by the watermark. Timestamps without a zone are cast first."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
