"""Query-embedding cache: write-through with eviction of all but the newest, ordered load, and the in-memory LRU."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.vectors import from_blob
from lumenfold.operators.catalog import last_of_each
from lumenfold.schemas import CACHE_ROWS


def newest(cache: DataFrame, n: int = CACHE_ROWS) -> DataFrame:
    return cache.orderBy(F.desc("created_at"), "query_text").limit(n)


def put(cache: DataFrame, entries: DataFrame, n: int = CACHE_ROWS, per_model: bool = True) -> DataFrame:
    """Replaces by key, then keeps the n newest over all models. per_model False keys by the text alone."""
    return newest(last_of_each(cache.unionByName(entries), ["query_text", "model_key"] if per_model else ["query_text"], "created_at"), n)


def load(cache: DataFrame, model_key: str, n: int = CACHE_ROWS) -> DataFrame:
    """Readable entries of a model, newest first; blobs of a broken length are skipped."""
    return newest(cache.where((F.col("model_key") == model_key) & (F.length("embedding") % 4 == 0)), n).select("query_text", from_blob(F.col("embedding")).alias("embedding"), "created_at")


class QueryCache:
    """Least recently used entries by raw query text. Preload oldest first, so the newest are evicted last."""

    def __init__(self, entries: int = CACHE_ROWS):
        self.entries, self.held = entries, OrderedDict()

    def get(self, text: str) -> list[float] | None:
        if text in self.held:
            self.held.move_to_end(text)
        return self.held.get(text)

    def put(self, text: str, vector: list[float]) -> None:
        self.held[text] = vector
        self.held.move_to_end(text)
        while len(self.held) > self.entries:
            self.held.popitem(last=False)

    def preload(self, cache: DataFrame, model_key: str) -> None:
        for r in reversed(load(cache, model_key, self.entries).collect()):
            self.put(r["query_text"], list(r["embedding"]))
