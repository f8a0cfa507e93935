"""Settings as an append-only table of (key, value, place); the last value of a key counts. The scan anchor isn't one of
them: it belongs to the version of the store that holds the scanned rows (plans/store.py)."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.vectors import clamp_threshold
from lumenfold.operators.catalog import last_of_each
from lumenfold.schemas import MAX_THRESHOLD

SETTINGS = "key string, value string, place long"
DEFAULTS = {"threshold": 0.0, "preload_text": False, "preload_vectors": False}


class Settings:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/settings"

    def rows(self) -> DataFrame:
        try:
            return last_of_each(self.spark.read.schema(SETTINGS).parquet(self.path), ["key"], "place")
        except AnalysisException:
            return self.spark.createDataFrame([], SETTINGS)

    def get(self, key: str):
        found = self.rows().where(F.col("key") == key).first()
        return DEFAULTS.get(key) if found is None else json.loads(found["value"])

    def put(self, **values) -> None:
        """A threshold is kept within 0 and MAX_THRESHOLD."""
        if "threshold" in values:
            values["threshold"] = clamp_threshold(values["threshold"], MAX_THRESHOLD)
        place = self.rows().agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0] + 1
        self.spark.createDataFrame([(k, json.dumps(v), place) for k, v in values.items()], SETTINGS).coalesce(1).write.mode("append").parquet(self.path)
