"""Embedding as Arrow batches: a pluggable embedder, leased sessions per Python worker, batch- or record-wise failure.

A record without a tensor fails alone ("no image"), whatever the granularity, as it never reaches the model; so does one
for which the model gives a value that isn't finite. Other errors fail the record, or its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumenfold.operators.sessions import SESSIONS

OUT = "media_id long, batch_id long, embedding array<float>, error string"


class Embedder(Protocol):
    key: str
    dim: int

    def open(self): ...

    def embed(self, session, tensors: np.ndarray) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic vectors from the bytes of a tensor; for tests and dry runs."""

    def __init__(self, dim: int = 16, fails_below: float | None = None):
        self.dim, self.key, self.fails_below = dim, f"hash:{dim}", fails_below

    def open(self) -> None:
        return None

    def embed(self, session, tensors: np.ndarray) -> np.ndarray:
        if self.fails_below is not None and (tensors < self.fails_below).any():
            raise ValueError("unreadable image")
        seeds = [int.from_bytes(hashlib.sha256(t.tobytes()).digest()[:8], "little") for t in tensors]
        return np.stack([np.random.default_rng(s).standard_normal(self.dim) for s in seeds])


class OnnxEmbedder:
    """A model file through onnxruntime on the CPU; shape and dimension are checked."""

    def __init__(self, path: str, input_name: str, output_name: str, dim: int, shape: tuple[int, ...]):
        self.path, self.input_name, self.output_name, self.dim, self.shape, self.key = path, input_name, output_name, dim, shape, f"onnx:{path}"

    def open(self):
        import onnxruntime

        return onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])

    def embed(self, session, tensors: np.ndarray) -> np.ndarray:
        out = session.run([self.output_name], {self.input_name: tensors.reshape(-1, *self.shape).astype(np.float32)})[0]
        if out.shape[-1] != self.dim:
            raise ValueError(f"model gave dimension {out.shape[-1]}, configuration says {self.dim}")
        return out.reshape(len(tensors), self.dim)


def normalized(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), v).astype(np.float32)


def embed(images: DataFrame, embedder: Embedder, batch: int = 8, normalize: bool = True, granularity: str = "record") -> DataFrame:
    """media_id, batch_id, embedding or error. images: media_id, tensor. With granularity "batch" an error fails its batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = TaskContext.get().partitionId() << 33  # batches of all partitions differ
        for frame in frames:
            for at in range(0, len(frame), batch):
                both = frame.iloc[at : at + batch]
                without = both["tensor"].map(lambda t: t is None or len(t) == 0)
                some, rows = both[~without], [(m, None, "no image") for m in both["media_id"][without]]
                rows += _embedded(embedder, some, normalize, granularity)
                yield pd.DataFrame({"media_id": [r[0] for r in rows], "batch_id": done, "embedding": [r[1] for r in rows], "error": [r[2] for r in rows]})
                done += 1

    return images.select("media_id", "tensor").mapInPandas(run, OUT)


def _embedded(embedder: Embedder, some: pd.DataFrame, normalize: bool, granularity: str) -> list[tuple]:
    """media_id, vector, error of a batch. A function of the module, so that tasks share the worker's sessions."""
    if not len(some):
        return []
    with SESSIONS.lease(embedder.key, embedder.open) as session:
        try:
            return [(m, e, None) for m, e in zip(some["media_id"], _vectors(embedder, session, some, normalize), strict=True)]
        except Exception as whole:  # noqa: BLE001  whatever the model raises is the record's error
            rows: list[tuple] = []
            for k in range(len(some)):
                one = some.iloc[k : k + 1]
                try:
                    if granularity == "batch":
                        raise whole
                    rows.append((one["media_id"].iloc[0], _vectors(embedder, session, one, normalize)[0], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((one["media_id"].iloc[0], None, str(e)))
            return rows


def _vectors(embedder: Embedder, session, some: pd.DataFrame, normalize: bool) -> list[np.ndarray]:
    out = np.asarray(embedder.embed(session, np.stack([np.asarray(t, np.float32) for t in some["tensor"]])))
    if out.shape != (len(some), embedder.dim):
        raise ValueError(f"model gave shape {out.shape} for {len(some)} images of dimension {embedder.dim}")
    if not np.isfinite(out).all():
        raise ValueError("model gave a value that isn't finite")
    return list(normalized(out) if normalize else out.astype(np.float32))
