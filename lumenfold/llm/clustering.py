"""Centroid clustering (k-means in integers) with exponion search.

Each vector carries its centroid, an upper bound on the distance to it and a lower bound on that to any other. Once
centroids have moved, the bounds move with them. A vector whose upper bound is below its lower bound, or below half the
distance from its centroid to the nearest other one, keeps its centroid unseen. Any other takes its exact distance u and
scans only the centroids within 2 u + s of its centroid (s: from there to the nearest other), a prefix of that centroid's
sorted list of neighbours: no centroid outside is as near as its own, and the second nearest is inside, too. Radius and
bounds are kept a hair too wide and the skip is strict, so a tie is always seen; distances themselves are exact integers,
and the smaller number wins.

A round writes the vectors with their bounds as a table and sums each cluster by partial sums of tasks. Only centroids
(k times the dimension) and the sums of one round come to the driver.

Defined cases: vectors that are null, of another dimension, or hold null or non-finite components get no row; null ids
come last in the choice of centroids, rows that repeat an id are vectors of their own (least components first); with fewer
than k vectors there are fewer centroids, equal ones stand beside each other and the smaller number gets the vectors; an
empty table gives no rows; other columns are ignored. A component beyond most_of(dim), some 95 million at 64
dimensions, would not leave distances exact in a long and raises.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, staged

K, DIM, ROUNDS, SCALE = 16, 64, 3, 64
#: How much wider than exact a bound is kept; far above the rounding of square roots and of sums over rounds.
SLACK = 1e-9
STATE = "vec_id long, v array<long>, cluster int, distance long, upper double, lower double, scanned long"
_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float64()), ("lower", pa.float64()), ("scanned", pa.int64())])


def most_of(dim: int) -> int:
    """The largest component for which dim squared differences still sum to a long."""
    return math.isqrt((1 << 61) // max(dim, 1)) // 2


@dataclass
class Centroids:
    """Centroids of a round, how far each has moved since the last, and each one's neighbours by distance."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        d = np.sqrt(np.stack([squares(self.at, c) for c in self.at]).astype(np.float64))
        np.fill_diagonal(d, -1.0)  # itself first
        self.order = np.argsort(d, axis=1, kind="stable")[:, 1:]
        self.radius = np.take_along_axis(d, self.order, axis=1)
        self.nearest = self.radius[:, 0] if len(d) > 1 else np.full(len(d), np.inf)
        # the farthest that any other centroid has moved
        top = np.sort(self.moved)[::-1]
        self.others_moved = np.where(np.arange(len(d)) == self.moved.argmax(), top[1] if len(d) > 1 else 0.0, top[0])


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one centroid."""
    x = v - c
    return np.einsum("ij,ij->i", x, x)


def first_assignment(v: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance, and the squared distance of the second nearest, over all centroids."""
    all_d = np.stack([squares(v, x) for x in c.at], axis=1)
    a = all_d.argmin(axis=1)  # the smaller number of equal ones
    best = np.take_along_axis(all_d, a[:, None], axis=1)[:, 0]
    if len(c.at) == 1:
        return a, best, np.full(len(v), -1)
    np.put_along_axis(all_d, a[:, None], np.iinfo(np.int64).max, axis=1)
    return a, best, all_d.min(axis=1)


def exponion(v: np.ndarray, a: np.ndarray, u2: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like first_assignment(), given each vector's centroid and exact squared distance; also how many others were scanned.
    The second distance is -1 where no other centroid lies in the ball."""
    ball = (2 * np.sqrt(u2.astype(np.float64)) + np.where(np.isfinite(c.nearest[a]), c.nearest[a], 0)) * (1 + SLACK)
    best, best_d, second = a.copy(), u2.copy(), np.full(len(v), -1)
    scanned = np.zeros(len(v), np.int64)
    for j in range(c.order.shape[1]):
        on = np.flatnonzero(c.radius[a, j] <= ball)  # inclusive: a tie on the sphere is seen
        if not len(on):
            break
        for other in np.unique(c.order[a[on], j]):
            rows = on[c.order[a[on], j] == other]
            d = squares(v[rows], c.at[other])
            scanned[rows] += 1
            wins = (d < best_d[rows]) | ((d == best_d[rows]) & (other < best[rows]))
            loser = np.where(wins, best_d[rows], d)
            second[rows] = np.where((second[rows] < 0) | (loser < second[rows]), loser, second[rows])
            best[rows[wins]], best_d[rows[wins]] = other, d[wins]
    return best, best_d, second, scanned


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assign(c: Centroids, dim: int, first: bool, last: bool):
    up, down, most = 1 + SLACK, 1 - SLACK, most_of(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), dim)
            if first:
                if np.abs(v).max() > most:
                    raise ValueError(f"a component beyond {most}: distances would not be exact")
                a, d, second = first_assignment(v, c)
                upper, scanned = np.sqrt(d.astype(np.float64)) * up, np.full(len(v), len(c.at))
                lower = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(np.float64)) * down)
            else:
                a, d = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy()
                upper = (batch.column(4).to_numpy() + c.moved[a]) * up
                lower = np.maximum(batch.column(5).to_numpy() - c.others_moved[a], 0) * down
                scanned = batch.column(6).to_numpy().copy()
                bound = np.maximum(lower, c.nearest[a] / 2 * down)
                open_ = np.flatnonzero(upper >= bound)
                told = np.arange(len(v)) if last else open_
                for k in np.unique(a[told]):  # exact distances to the centroids they have
                    rows = told[a[told] == k]
                    d[rows] = squares(v[rows], c.at[k])
                scanned[told] += 1
                upper[open_] = np.sqrt(d[open_].astype(np.float64)) * up
                open_ = open_[upper[open_] >= bound[open_]]
                best, best_d, second, seen = exponion(v[open_], a[open_], d[open_], c)
                # nothing outside the ball is nearer than its radius less the distance to its middle
                outside = np.sqrt(d[open_].astype(np.float64)) + np.where(np.isfinite(c.nearest[a[open_]]), c.nearest[a[open_]], np.inf)
                second_d = np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(np.float64)))
                lower[open_] = np.minimum(second_d, outside) * down
                a[open_], d[open_] = best, best_d
                upper[open_] = np.sqrt(best_d.astype(np.float64)) * up
                scanned[open_] += seen
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a.astype(np.int32)), pa.array(d), pa.array(upper), pa.array(lower), pa.array(scanned)], schema=_STATE)

    return run


def _sums(k: int, dim: int):
    """cluster, place, n, total: what a task's vectors add to each component of each centroid."""
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, a = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
            n += np.bincount(a, minlength=k)
            for c in np.unique(a):
                total[c] += v[a == c].sum(axis=0)
        on = np.repeat(n > 0, dim)
        if on.any():
            columns = np.repeat(np.arange(k), dim), np.tile(np.arange(dim), k), np.repeat(n, dim), total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(x[on], f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _moved(c: Centroids, sums: list) -> Centroids:
    at = [list(map(int, row)) for row in c.at]
    for r in sums:
        at[r["cluster"]][r["place"]] = r["total"] // r["n"]  # exact: Python's integers round down
    new = np.array(at, np.int64)
    return Centroids(new, np.sqrt(((new - c.at) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK))


def integer_vectors(table: DataFrame, dim: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component) of each usable vector."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    usable = F.col("_x").isNotNull() & (F.size("_x") == dim) & ~F.exists("_x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("_x")).where(usable)
    most = 2.0 * most_of(dim)  # the assignment raises for what is cut to this
    return rows.select("vec_id", F.transform("_x", lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(most)), F.lit(-most)))).alias("v"))


def cluster_vectors(table: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """A written table of vec_id, v, cluster, distance, bounds and scanned (distances computed so far), and the centroids."""
    kept = staged(integer_vectors(table, dim, id_col, vector_col, scale), "integer-vectors")
    hashed = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256))
    starts = kept.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return table.sparkSession.createDataFrame([], STATE), np.zeros((0, dim), np.int64)
    c = Centroids(np.array([r["v"] for r in starts], np.int64), np.zeros(len(starts)))
    state, was = None, kept
    for r in range(rounds + 1):
        state = staged(was.mapInArrow(_assign(c, dim, r == 0, r == rounds), STATE), "assigned")
        discard(was)
        if r < rounds:
            partial = state.select("v", "cluster").mapInArrow(_sums(len(c.at), dim), "cluster int, place int, n long, total long")
            c, was = _moved(c, partial.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()), state
    return state, c.at


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r[0]: r[1] for r in state.groupBy("cluster").agg(F.sum("distance")).collect()}
    told = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Every vector against every centroid, round by round."""
    near = "SELECT x.row, x.vec_id, x.v, min_by(c.cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + c.cluster) AS cluster, min(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM x, {c} c GROUP BY ALL"
    mean = "SELECT cluster, list(m ORDER BY place) AS v FROM (SELECT cluster, place, (s - ((s % n) + n) % n) // n AS m FROM (SELECT cluster, place, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS e, generate_subscripts(v, 1) AS place FROM {a}) GROUP BY ALL)) GROUP BY cluster UNION ALL SELECT cluster, v FROM {c} WHERE cluster NOT IN (SELECT cluster FROM {a})"
    steps = ["x AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda e: isfinite(e))) = 64 AND len(embedding) = 64)", "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT 16))"]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        if r < ROUNDS:
            steps.append(f"c{r + 1} AS MATERIALIZED ({mean.format(a=f'a{r}', c=f'c{r}')})")
    last = f"SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"
    return f"WITH {', '.join(steps)} {last}"


ORACLE = {"op12": _oracle()}
