"""Packed vector blocks: top-k over binary matrices, with blocks that can't reach the top skipped.

A block is one row: the offset and ids of some thousands of vectors, their floats as one little-endian float32 buffer, and
the largest norm among them. Search multiplies the buffer as it is; no list is ever built. By Cauchy and Schwarz no score
in a block exceeds its largest norm times that of the query, so a block is skipped for a query whose k-th best score (or
threshold) lies above that. Blocks of a task are taken by falling norm, so the bound bites early.

Blocks come from a vector file (each is a byte range of it) or are packed from rows. Scores, ties and NaN are those of
operators/search.py, and so are the rows; a last row of each task (qid null) tells how much it has skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.vectors import DIGITS
from lumenfold.operators.search import QUERY_BLOCK, SCORES, SLACK, _best, top_k_by_group
from lumenfold.sources import vectorfile
from lumenfold.sources.files import work_path

PACKED = "n int, dim int, top_norm double, media_ids array<long>, offsets array<long>, matrix binary"
_PACKED = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("top_norm", pa.float64()), ("media_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("matrix", pa.binary())])
_FOUND = pa.schema([("qid", pa.int64()), ("media_id", pa.int64()), ("vector_offset", pa.int64()), ("score", pa.float64())])


def pack(vectors: DataFrame, rows: int = vectorfile.BLOCK) -> DataFrame:
    """Blocks of vectors (media_id, vector_offset, embedding); a null embedding or one with null floats is left out, each
    dimension has blocks of its own. Vectors sorted by norm before give blocks of like norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, offsets, parts = (list(x) for x in zip(*held.pop(dim), strict=True))
            v = np.concatenate(parts).reshape(-1, dim)
            top = float(np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)).max(initial=0.0))
            return pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int32()), pa.array([dim], pa.int32()), pa.array([np.inf if np.isnan(top) else top]), pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([np.concatenate(offsets)], pa.list_(pa.int64())), pa.array([v.tobytes()])], schema=_PACKED)

        sizes: dict[int, int] = {}
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<f4")
            dims = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(bounds), 0)
            ids, offsets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                on = np.flatnonzero(dims == dim)
                for i in range(0, len(on), rows):
                    some = on[i : i + rows]
                    held.setdefault(dim, []).append((ids[some], offsets[some], flat[bounds[some][:, None] + np.arange(dim)].reshape(-1)))
                    sizes[dim] = sizes.get(dim, 0) + len(some)
                    if sizes[dim] >= rows:
                        yield block(dim)
                        sizes[dim] = 0
        for dim in list(held):
            yield block(dim)

    fine = vectors.where(F.col("embedding").isNotNull() & F.col("media_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    return fine.select("media_id", "vector_offset", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, PACKED)


def file_blocks(spark: SparkSession, path: str, rows: int = vectorfile.BLOCK, ranges: int = vectorfile.ROWS) -> DataFrame:
    """The blocks of a vector file store, as byte ranges of it; all its vectors, whether a catalog row names them or not."""
    read = vectorfile.source(spark).option("shape", "blocks").option("block", rows).option("rows", ranges).load(path)
    steps = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("vector_offset") + i.cast("long") * F.col("dim") * vectorfile.FLOAT)
    return read.select("n", "dim", "top_norm", "media_ids", steps.alias("offsets"), "matrix")


def _scan(queries: list[tuple[int, list[float]]], k: int, threshold: float):
    by_dim: dict[int, list] = {}
    for qid, q in queries:
        by_dim.setdefault(len(q), []).append((qid, q))
    asked = {d: (np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.float64)) for d, some in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[str, np.ndarray]] = {}
        floor = {d: np.full(len(ids), threshold if threshold > 0 else -np.inf) for d, (ids, _) in asked.items()}
        seen = skipped = 0
        for batch in batches:
            for row in np.argsort(-batch.column(2).to_numpy(), kind="stable").tolist():
                dim = batch.column(1)[row].as_py()
                if dim not in asked:
                    continue
                ids, q = asked[dim]
                reach = np.linalg.norm(q, axis=1) * batch.column(2)[row].as_py()
                on = np.flatnonzero(~(reach + SLACK < floor[dim]))  # NaN is never skipped
                seen, skipped = seen + len(ids), skipped + len(ids) - len(on)
                if not len(on) or k <= 0:
                    continue
                v = np.frombuffer(batch.column(5)[row].as_buffer(), "<f4").reshape(-1, dim)
                media, offsets = batch.column(3)[row].values.to_numpy(), batch.column(4)[row].values.to_numpy()
                step = max(1, SCORES // len(on))
                for i in range(0, len(v), step):
                    s = np.round(q[on] @ v[i : i + step].astype(np.float64).T, DIGITS)
                    real = ~np.isnan(s) & (s >= floor[dim][on][:, None])
                    if k < s.shape[1]:  # ties with the k-th stay
                        real &= s >= -np.partition(np.where(real, -s, np.inf), k - 1, axis=1)[:, k - 1 : k]
                    at, x = np.nonzero(real)
                    if not len(at):
                        continue
                    found = {"at": on[at], "media_id": media[i + x], "vector_offset": offsets[i + x], "score": s[at, x]}
                    best[dim] = _best({n: np.concatenate([best[dim][n], y]) for n, y in found.items()} if dim in best else found, k)
                    full = np.bincount(best[dim]["at"], minlength=len(ids)) >= k
                    worst = np.full(len(ids), np.inf)
                    np.minimum.at(worst, best[dim]["at"], best[dim]["score"])
                    floor[dim] = np.where(full, np.maximum(floor[dim], worst), floor[dim])
        for dim, found in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0][found["at"]]), *[pa.array(found[n]) for n in ("media_id", "vector_offset", "score")]], schema=_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([seen]), pa.array([skipped]), pa.array([0.0])], schema=_FOUND)

    return run


def search_blocks(blocks: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The k best vectors of each query (qid, media_id, vector_offset, score, rank), and one row of the (query, block) pairs
    there were and that were skipped. queries: qid, q, where q may be null; they go by blocks of QUERY_BLOCK."""
    spark = blocks.sparkSession
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    path = work_path(spark, "block-search")
    for p in range(parts):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p) if parts > 1 else queries
        asked = [(r[0], list(r[1])) for r in some.select("qid", "q").collect() if r[1] is not None]
        blocks.select(*_PACKED.names).mapInArrow(_scan(asked, k, threshold), "qid long, media_id long, vector_offset long, score double").write.parquet(f"{path}/part={p}")
    found = spark.read.schema("qid long, media_id long, vector_offset long, score double").parquet(*[f"{path}/part={p}" for p in range(parts)])
    told = found.where("qid is null").agg(F.sum("media_id").alias("pairs"), F.sum("vector_offset").alias("skipped"))
    return top_k_by_group(found.where("qid is not null"), "qid", k), told
