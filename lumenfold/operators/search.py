"""Exact top-k by dot product: one query as SQL expressions, many as NumPy products over Arrow batches.

A vector whose dimension differs from the query's isn't compared. Scores are canonical (rounded double); equal scores
order by vector_offset, then media_id. One query plans as TakeOrderedAndProject: a bounded heap per task and a merge of
k rows each. Catalog columns join only the winners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.vectors import DIGITS, clamp_threshold, literal, passes, score
from lumenfold.schemas import PAGE_SIZE, RESULT_LIMIT
from lumenfold.operators.catalog import fingerprint
from lumenfold.operators.integrity import audit, loadable
from lumenfold.schemas import INDEXED
from lumenfold.sources.files import work_path


QUERY_BLOCK, SCORES = 10_000, 4_000_000
#: Above any rounding of a score at DIGITS, so a tie with the k-th best is never left out.
SLACK = 10.0 ** (1 - DIGITS)
#: Stands for a null id in arrays: nulls sort first, as in best_first().
NONE = np.iinfo(np.int64).min


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("vector_offset"), F.asc("media_id")]


def comparable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(F.size("embedding") == dim)


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """media_id, vector_offset, score of all comparable vectors; NaN scores are dropped."""
    return comparable(vectors, len(query)).select("media_id", "vector_offset", score(F.col("embedding"), literal(query)).alias("score")).where(~F.isnan("score"))


def filter_by_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    """Always on, even at or below 0."""
    return scores.where(F.col("score") >= threshold)


def top_k(vectors: DataFrame, query: list[float], k: int = RESULT_LIMIT, threshold: float = 0.0) -> DataFrame:
    """The threshold follows the limit: the order is the same key, so the rows are too, and scores are computed once."""
    best = scored(vectors, query).orderBy(*best_first()).limit(max(k, 0))
    return best.where(passes(F.col("score"), clamp_threshold(threshold)))


def search(catalog: DataFrame, vectors: DataFrame, query: list[float], k: int = RESULT_LIMIT, threshold: float = 0.0) -> DataFrame:
    """Winners with their catalog rows; at most k rows are joined. vectors of a store (Store.vectors()) are those that its
    catalog points at."""
    best = top_k(vectors, query, k, threshold)
    return catalog.drop("vector_offset").join(F.broadcast(best) if k <= RESULT_LIMIT else best, "media_id").orderBy(*best_first())


def compared(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.agg(F.count_if(F.size("embedding") == dim).alias("compared"))


def merge_partials(partials: DataFrame, k: int) -> DataFrame:
    return partials.orderBy(*best_first()).limit(k)


def top_k_by_group(rows: DataFrame, group: str, k: int) -> DataFrame:
    """Planned with a WindowGroupLimit before the shuffle."""
    w = W.partitionBy(group).orderBy(*best_first())
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, path: str) -> list[DataFrame]:
    """The query set as tables of about QUERY_BLOCK queries; a set of more is written under path, by hash of qid."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return [queries]
    blocks = -(-n // QUERY_BLOCK)
    numbered = queries.select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"))
    numbered.write.partitionBy("block").parquet(path)
    written = queries.sparkSession.read.schema(numbered.schema).parquet(path)
    return [written.where(F.col("block") == b).select("qid", "q") for b in range(blocks)]


def _block_by_block(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best rows of all queries. Of several blocks, each one's are written before the next is searched."""
    root = work_path(queries.sparkSession, "queries")
    blocks = _blocks(queries, f"{root}/queries")
    if len(blocks) == 1:
        return search(blocks[0])
    for b, some in enumerate(blocks):
        found = search(some)
        found.write.parquet(f"{root}/best/block={b}")
    return queries.sparkSession.read.schema(found.schema).parquet(*[f"{root}/best/block={b}" for b in range(len(blocks))])


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, media_id, score, rank. queries: a table of qid, q. Scores come from matrix products: one by one, as SQL expressions
    over lists, they cost some microseconds each."""
    return top_k_many_numpy(vectors, queries, k)


def _best(found: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The k best of each query, by query."""
    order = np.lexsort((found["media_id"], found["vector_offset"], -found["score"], found["at"]))
    at = found["at"][order]
    order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    return {name: x[order] for name, x in found.items()}


class _TopK:
    """The k best vectors of each query among those seen. Only scores that reach a query's k-th best so far are rounded and kept."""

    def __init__(self, queries: np.ndarray, k: int, rows: int):
        self.q, self.k, self.step = queries, k, max(1, min(rows, SCORES // len(queries)))
        self.floor, self.parts, self.pending = np.full(len(queries), -np.inf), [], 0

    def see(self, vectors: np.ndarray, media: np.ndarray, offsets: np.ndarray) -> None:
        for i in range(0, len(vectors), self.step):
            s = self.q @ vectors[i : i + self.step].T
            real = s >= (self.floor - SLACK)[:, None]  # NaN never is
            many = np.flatnonzero(np.count_nonzero(real, axis=1) > self.k)
            if len(many):  # ties with the k-th stay
                some = np.where(real[many], s[many], -np.inf)
                real[many] &= some >= np.partition(some, some.shape[1] - self.k, axis=1)[:, some.shape[1] - self.k, None] - SLACK
            at, x = np.nonzero(real)
            self.parts.append({"at": at, "media_id": media[i + x], "vector_offset": offsets[i + x], "score": np.round(s[at, x], DIGITS)})
            self.pending += len(at)
            if self.pending >= len(self.q) * self.k:
                self.best()

    def best(self) -> dict[str, np.ndarray]:
        found = _best({n: np.concatenate([p[n] for p in self.parts]) for n in self.parts[0]}, self.k)
        self.parts, self.pending = [found], 0
        worst = np.full(len(self.q), np.inf)
        np.minimum.at(worst, found["at"], found["score"])
        self.floor = np.where(np.bincount(found["at"], minlength=len(self.q)) >= self.k, worst, -np.inf)
        return found


def _top_k_block(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, rows: int) -> DataFrame:
    by_dim: dict[int, list[tuple[int, list[float]]]] = {}
    for qid, q in queries:
        by_dim.setdefault(len(q), []).append((qid, q))
    stacked = {d: (np.array([NONE if q[0] is None else q[0] for q in some], np.int64), np.array([q[1] for q in some], np.float64)) for d, some in by_dim.items()}

    def told(x: np.ndarray) -> pa.Array:
        return pa.array(x, mask=x == NONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {dim: _TopK(q, k, rows) for dim, (_, q) in stacked.items() if k > 0}
        for batch in batches:
            media, offsets = (pc.fill_null(batch.column(c), NONE).to_numpy() for c in (0, 1))
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # null components become NaN
            dims = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(bounds), -1)
            for dim, top in tops.items():
                fit = np.flatnonzero(dims == dim)
                top.see(flat[bounds[fit][:, None] + np.arange(dim)].astype(np.float64), media[fit], offsets[fit])
        for dim, top in tops.items():
            found = top.best() if top.parts else {"at": []}
            for i in range(0, len(found["at"]), 100_000):
                some = {n: v[i : i + 100_000] for n, v in found.items()}
                yield pa.RecordBatch.from_arrays([told(stacked[dim][0][some["at"]]), told(some["media_id"]), told(some["vector_offset"]), pa.array(some["score"])], names=["qid", "media_id", "vector_offset", "score"])

    narrow = vectors.select(*[F.col(c).cast("long").alias(c) for c in ("media_id", "vector_offset")], "embedding")
    found = narrow.mapInArrow(run, "qid long, media_id long, vector_offset long, score double")
    return top_k_by_group(found, "qid", k).select("qid", "media_id", "score", "rank")


def top_k_many_numpy(vectors: DataFrame, queries: DataFrame | list[tuple[int, list[float]]], k: int, rows: int = 8192) -> DataFrame:
    """The same rows by matrix products. queries: a table of qid, q, or a list of such pairs. Each task keeps its best k per
    query, so only those are shuffled; the driver and a task hold one block of queries, and SCORES scores."""
    if isinstance(queries, list):
        if len(queries) <= QUERY_BLOCK:
            return _top_k_block(vectors, queries, k, rows)
        queries = vectors.sparkSession.createDataFrame(queries, "qid long, q array<double>")
    return _block_by_block(queries, lambda some: _top_k_block(vectors, [(r[0], list(r[1])) for r in some.select("qid", "q").collect() if r[1] is not None], k, rows))


def page(results: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    return results.orderBy(*best_first()).offset(number * size).limit(size)


def pages_up_to(results: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    return results.orderBy(*best_first()).limit((number + 1) * size)


def with_page(results: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """For result lists, which are bounded."""
    return results.withColumn("page", F.floor((F.row_number().over(W.orderBy(*best_first())) - 1) / size).cast("long"))


def should_load_more(last_visible: int, shown: int, ahead: int = 12) -> bool:
    return last_visible >= shown - 1 - ahead


class CorruptIndex(RuntimeError):
    """Catalog and vectors don't agree; the index has to be built anew."""


class VectorCache:
    """A persisted snapshot of loadable vectors, reused while its fingerprint holds."""

    def __init__(self) -> None:
        self.fingerprint, self.vectors = None, None

    def get(self, vectors: DataFrame, fingerprint: tuple[int, int]) -> DataFrame:
        if self.fingerprint != fingerprint:
            self.invalidate()
            self.vectors, self.fingerprint = vectors.persist(), fingerprint
        return self.vectors

    def checked(self, catalog: DataFrame, vectors: DataFrame, file_length: int) -> DataFrame:
        """The loadable vectors of a catalog. Reused while its fingerprint holds; otherwise audited first. A corrupt catalog
        clears the cache and raises; so does a payload in which vectors are missing."""
        told = fingerprint(catalog, file_length).first()
        mark = (told["indexed_record_count"], told["vector_file_length"])
        if self.vectors is not None and self.fingerprint == mark:
            return self.vectors
        self.invalidate()
        if audit(catalog, file_length).first()["is_corrupt"]:
            raise CorruptIndex("duplicate or invalid vector rows")
        wanted = loadable(catalog.where(F.col("status") == INDEXED), file_length).select("media_id", "vector_offset", "vector_dim")
        whole = vectors.join(wanted, ["media_id", "vector_offset"]).where(F.size("embedding") == F.col("vector_dim")).drop("vector_dim")
        out = self.get(whole, mark)
        if out.count() != wanted.count():
            self.invalidate()
            raise CorruptIndex("the payload is incomplete")
        return out

    def warm(self, vectors: DataFrame, fingerprint: tuple[int, int], force: bool = False) -> int:
        if force:
            self.invalidate()
        return self.get(vectors, fingerprint).count()

    def invalidate(self) -> None:
        if self.vectors is not None:
            self.vectors.unpersist()
        self.fingerprint = self.vectors = None
