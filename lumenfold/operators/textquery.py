"""Search by text: tokens, a text model, a unit vector, the query cache, then the exact search.

A table of texts is embedded by tasks: of the distinct texts, those the cache has for this model are taken from it, the
rest go through the model in Arrow batches, and what was embedded is added to the cache.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import Bpe, pieces_of, pretokenize
from lumenfold.functions.vectors import from_blob
from lumenfold.operators import catalog, search
from lumenfold.operators.cache import QueryCache
from lumenfold.operators.embed import normalized
from lumenfold.operators.sessions import SESSIONS
from lumenfold.schemas import RECENT_LIMIT, RESULT_LIMIT


class TextModel(Protocol):
    dim: int

    def open(self): ...

    def embed(self, session, ids: np.ndarray) -> np.ndarray: ...


class OnnxTextModel:
    """A text encoder through onnxruntime; it gets the token ids alone, no attention mask."""

    def __init__(self, path: str, input_name: str, output_name: str, dim: int, input_type: str = "INT64"):
        self.path, self.input_name, self.output_name, self.dim, self.dtype = path, input_name, output_name, dim, np.int32 if input_type == "INT32" else np.int64

    def open(self):
        import onnxruntime

        return onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])

    def embed(self, session, ids: np.ndarray) -> np.ndarray:
        return session.run([self.output_name], {self.input_name: ids.astype(self.dtype)})[0].reshape(len(ids), -1)


class TextSession:
    """One open text model, kept for a model key (folder and version) and opened anew for another. Queries are single
    short texts, so this runs on the driver."""

    def __init__(self, keep: Callable[[str, str, list[float]], None] | None = None) -> None:
        """keep(text, model key, vector) writes a new vector through to a persisted cache; an error there is only told."""
        self.key, self.model, self.session, self.cache, self.keep = None, None, None, QueryCache(), keep

    def preload(self, key: str, model: TextModel, bpe: Bpe, cache: DataFrame | None = None) -> None:
        if self.key != key:
            self.release()
            self.key, self.model, self.bpe, self.session = key, model, bpe, model.open()
            if cache is not None:
                self.cache.preload(cache, key)

    def release(self) -> None:
        self.key = self.model = self.session = None
        self.cache = QueryCache()

    def vector(self, text: str, normalize: bool = True) -> list[float]:
        """The query's vector; by the cache if the very same text was asked before."""
        held = self.cache.get(text)
        if held is None:
            if self.model is None:
                raise RuntimeError("no text model is loaded")
            out = np.asarray(self.model.embed(self.session, np.array([self.bpe.encode(pieces_of(text))])))
            if out.shape != (1, self.model.dim):
                raise ValueError(f"model gave shape {out.shape}, configuration says dimension {self.model.dim}")
            held = (normalized(out) if normalize else out.astype(np.float32))[0].tolist()
            self.cache.put(text, held)
            if self.keep is not None:
                try:
                    self.keep(text, self.key, held)
                except Exception as e:  # noqa: BLE001  the search goes on without it
                    warnings.warn(f"the query cache couldn't be written: {e}", stacklevel=2)
        return held


_NEW = pa.schema([("query_text", pa.string()), ("embedding", pa.binary())])


def _vectors(key: str, model: TextModel, bpe: Bpe, texts: list[str], pieces: list[list[str]], normalize: bool, batch: int) -> Iterator[pa.RecordBatch]:
    """A function of the module, so that tasks share the worker's sessions."""
    with SESSIONS.lease(f"text:{key}", model.open) as session:
        for i in range(0, len(texts), batch):
            out = np.asarray(model.embed(session, np.array([bpe.encode(p) for p in pieces[i : i + batch]])))
            if out.shape != (len(texts[i : i + batch]), model.dim) or not np.isfinite(out).all():
                raise ValueError(f"model gave shape {out.shape}, configuration says dimension {model.dim}, all finite")
            v = normalized(out) if normalize else out.astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(texts[i : i + batch]), pa.array([x.astype("<f4").tobytes() for x in v])], schema=_NEW)


def embed_new_texts(texts: DataFrame, cache: DataFrame, key: str, model: TextModel, bpe: Bpe, now: int, normalize: bool = True, batch: int = 64) -> DataFrame:
    """Rows for the cache (query_text, model_key, embedding, created_at): one for each distinct text that it lacks for this
    model. texts: query_text; null and blank ones have no vector."""
    known = cache.where((F.col("model_key") == key) & (F.length("embedding") % 4 == 0)).select("query_text")
    asked = texts.select("query_text").where(F.length(F.regexp_replace("query_text", r"(?U)\s", "")) > 0).distinct()
    new = asked.join(known, "query_text", "left_anti").select("query_text", pretokenize(F.col("query_text")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            yield from _vectors(key, model, bpe, some.column(0).to_pylist(), some.column(1).to_pylist(), normalize, batch)

    found = new.mapInArrow(run, "query_text string, embedding binary")
    return found.select("query_text", F.lit(key).alias("model_key"), "embedding", F.lit(now).cast("long").alias("created_at"))


def with_vectors(texts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """texts with q, the cached vector of this model; null for texts that have none."""
    held = cache.where((F.col("model_key") == key) & (F.length("embedding") % 4 == 0))
    held = catalog.last_of_each(held.select("query_text", "created_at", "embedding"), ["query_text"], "created_at")
    return texts.join(held.select("query_text", from_blob(F.col("embedding")).alias("q")), "query_text", "left")


def search_text(rows: DataFrame, vectors: DataFrame, session: TextSession, text: str, k: int = RESULT_LIMIT, threshold: float = 0.0) -> DataFrame:
    """Rows of the catalog, best first. A blank text gives the newest indexed rows, with a score of NaN."""
    if not text.strip():
        return catalog.recent(rows, RECENT_LIMIT)
    return search.search(rows, vectors, session.vector(text), k, threshold)
