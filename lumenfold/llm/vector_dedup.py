"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction made of one code word from each of BLOCKS random spherical codes over a slice of the dimensions;
a vector passes the filters whose inner product with it exceeds CAP, or comes within MARGIN of its best one (a vector that
lies badly to all of them would else have one filter and miss its neighbours: on random vectors of 64 dimensions that
lifts the recall of pairs at a cosine of 0.93 from 0.66 to 0.998, for 34 filters a vector in place of 15). The list of those filters is decoded slice by
slice: a code word is only tried if the best words of the other slices could still lift the sum over the cap. The number
of code words is a parameter and never follows from the table: whether a pair is found depends on its two vectors alone, not
on how many others there are. Vectors join on (label, filter) and are verified in double precision, those within EDGE of the
threshold by a sum that no order of summation changes. A pair that shares several filters counts at the least one.

Equal vectors of a label are collapsed before, and counted by multiplicity. A bucket of more than CHUNK vectors is split
into chunks, and each pair of chunks is a group of its own, so no group grows with the data. A group gives a count for
each of its vectors and edges that span its components, never all pairs.

Vectors are divided by their largest component before their norm is taken, so none is too long or too short for that. What
travels to a bucket is the vector as it was given and the filters it shares with others.

Defined cases: null, zero and non-finite vectors and those of a null label link with nothing and stay; vectors of
different dimensions never link; rows that repeat a vec_id are links of each other if their vectors are; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import discard, staged
from lumenfold.llm.components import components

LEAST, BLOCKS, WORDS, CAP, MARGIN, CHUNK, SEED = 0.93, 3, 64, 0.46, 0.05, 512, 20240501
#: Groups of up to SMALL vectors are verified together, PAIRS pairs at a time.
SMALL, PAIRS = 16, 50_000
#: Beyond what products of matrices of any shape differ in.
EDGE = 1e-12
#: With WORDS and CAP, filters of up to VECTORS vectors hold few of them, with MOST_WORDS (134 million filters) of some 26 million.
VECTORS, MOST_WORDS = 50_000, 512


def words_for(vectors: int) -> int:
    """Code words of a slice at which filters hold as few of so many vectors as WORDS do of VECTORS. A hint for who calls
    link_vectors(): other words find other pairs, so it doesn't choose them itself."""
    return min(max(WORDS, math.ceil(WORDS * (vectors / VECTORS) ** (1 / BLOCKS))), MOST_WORDS)


def cap_for(words: int, cap: float, dim: int) -> float:
    """The cap at which a vector passes as many filters as with WORDS words: a cap's share of the sphere goes by this power."""
    return math.sqrt(1 - (1 - cap * cap) * (WORDS / words) ** (2 * BLOCKS / max(dim - 1, 2)))


@lru_cache(maxsize=16)
def codes(dim: int, n_words: int = WORDS) -> list[tuple[slice, np.ndarray]]:
    """A spherical code for each slice of the dimensions; word norms make every product a unit vector."""
    rng, edges = np.random.default_rng((SEED, dim)), np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        words = []
        while sum(map(len, words)) < n_words:  # rows of random rotations, so words of a block spread evenly
            q = np.linalg.qr(rng.standard_normal((b - a, b - a)))[0]
            words += [q, -q]
        out.append((slice(a, b), np.concatenate(words)[:n_words] / np.sqrt(len(edges) - 1)))
    return out


def filters(units: np.ndarray, cap: float, n_words: int = WORDS) -> list[np.ndarray]:
    """The ids of all filters whose inner product with each unit vector exceeds the cap, or its own best one less MARGIN."""
    scores, cap = [units[:, s] @ w.T for s, w in codes(units.shape[1], n_words)], cap_for(n_words, cap, units.shape[1])
    best = [x.max(axis=1) for x in scores]
    out = []
    for i in range(len(units)):
        ids, sums, rest = np.zeros(1, np.int64), np.zeros(1), sum(b[i] for b in best)
        need = min(cap, rest - MARGIN)
        for x, b in zip(scores, best, strict=True):
            rest -= b[i]
            total = sums[:, None] + x[i][None, :]
            on = total >= need - rest
            ids, sums = (ids[:, None] * n_words + np.arange(n_words)[None, :])[on], total[on]
        out.append(ids)
    return out


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, the vector (null where it can't link) and a 128-bit hash of label and direction."""
    import xxhash

    for batch in batches:
        labels, lists = batch.column(1).to_pylist(), batch.column(2)
        bounds, inner = lists.offsets.to_numpy(), lists.values
        flat = inner.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        dims = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(bounds), 0)
        s1, s2, able = np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64), np.zeros(len(labels), bool)
        for dim in np.unique(dims[dims > 0]).tolist():
            at = np.flatnonzero(dims == dim)
            v = flat[bounds[at][:, None] + np.arange(dim)]
            fine = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1) & np.array([labels[k] is not None for k in at])
            at, units = at[fine], unit_rows(v[fine]) + 0.0  # no negative zeros
            able[at] = True
            for k, u in zip(at.tolist(), units, strict=True):
                d = xxhash.xxh3_128_intdigest(labels[k].encode("utf-8", "surrogatepass") + b"\0" + u.tobytes())
                s1[k], s2[k] = (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.if_else(pa.array(able), lists, pa.nulls(len(labels), lists.type)), pa.array(s1), pa.array(s2)], names=["vec_id", "label", "vector", "s1", "s2"])


_EXPANDED = pa.schema([("node", pa.int64()), ("label", pa.string()), ("filters", pa.list_(pa.int64()))])


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows over their norms, in double precision; by their largest component first, so none is too long or too short."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _expand(cap: float, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                vectors = [np.array(v) for v in some.column(2).to_pylist()]
                got: list[list[int]] = [[]] * len(vectors)
                for dim in {len(v) for v in vectors}:
                    at = [k for k, v in enumerate(vectors) if len(v) == dim]
                    for k, f in zip(at, filters(unit_rows(np.stack([vectors[k] for k in at])), cap, n_words), strict=True):
                        got[k] = (f * 4096 + dim % 4096).tolist()
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(got, pa.list_(pa.int64()))], schema=_EXPANDED)

    return run


def _linked(scores: np.ndarray, least: float, x: np.ndarray, y: np.ndarray, at: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """scores >= least, whatever products they come from. x, y: the rows (of scores' sides, or by at) that they are of."""
    near = scores >= least
    for where in zip(*np.nonzero(np.abs(scores - least) <= EDGE), strict=True):
        a, b = where if at is None else (at[0][where], at[1][where])
        near[where] = math.fsum(x[a] * y[b]) >= least
    return near


def _block(bucket: int, nodes: np.ndarray, weight: np.ndarray, units: np.ndarray, lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[np.ndarray]:
    """Rows (node, n, other) of one pair of chunks: left and right are places in the group, the same for one chunk."""
    near = _linked(units[left] @ units[right].T, least, units[left], units[right])
    near &= nodes[left][:, None] != nodes[right][None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return []
    # a pair counts at its least common filter only
    if len(i) <= 64:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            near[x, y] = np.intersect1d(lists[left[x]], lists[right[y]], assume_unique=True)[0] == bucket
    else:
        own = [[lists[k][lists[k] < bucket] for k in side] for side in (left, right)]
        both = np.intersect1d(np.concatenate(own[0]), np.concatenate(own[1]))
        for at in range(0, len(both), 2048):
            some = both[at : at + 2048]
            marks = [np.stack([np.isin(some, f, assume_unique=True) for f in side]).astype(np.float32) for side in own]
            near &= marks[0] @ marks[1].T == 0
    if not near.any():
        return []
    one = left is right
    out = [np.stack([nodes[left], near @ weight[right], nodes[left]], axis=1)]
    if not one:
        out.append(np.stack([nodes[right], near.T @ weight[left], nodes[right]], axis=1))
    # least node of each component of this block, by propagation; each node gets an edge to it
    most = np.iinfo(np.int64).max
    l, r = nodes[left].copy(), nodes[right].copy()
    while True:
        r2 = np.minimum(r, np.where(near, l[:, None], most).min(axis=0))
        l2 = np.minimum(l, np.where(near, r2[None, :], most).min(axis=1))
        if one:
            l2 = r2 = np.minimum(l2, r2)
        if (l2 == l).all() and (r2 == r).all():
            break
        l, r = l2, r2
    for side, label in ((left, l), (right, r)):
        on = label != nodes[side]
        out.append(np.stack([nodes[side][on], np.zeros(on.sum(), np.int64), label[on]], axis=1))
        if one:
            break
    return out


def _small_groups(starts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, weight: np.ndarray, bucket: np.ndarray, units: np.ndarray | None, filters_of: tuple[np.ndarray, np.ndarray], least: float) -> list[np.ndarray]:
    """What _block() gives for groups of one chunk and up to SMALL vectors, for all of them at once."""
    f_at, f_all = filters_of
    out: list[tuple[int, int, int]] = []
    for n in np.unique(sizes[sizes > 1]).tolist():
        left, right = np.triu_indices(n, 1)
        own = starts[sizes == n]
        step = max(1, PAIRS // len(left))
        for at in range(0, len(own), step):
            some = own[at : at + step, None]
            i, j = (some + left).ravel(), (some + right).ravel()
            on = np.flatnonzero(_linked(np.einsum("ij,ij->i", units[i], units[j]), least, units, units, (i, j)))
            for x, y in zip(i[on].tolist(), j[on].tolist(), strict=True):
                common = set(f_all[f_at[x] : f_at[x + 1]].tolist()).intersection(f_all[f_at[y] : f_at[y + 1]].tolist())
                a, b = int(nodes[x]), int(nodes[y])
                if a != b and min(common) == bucket[x]:  # a pair counts at its least common filter only
                    out += [(a, int(weight[y]), a), (b, int(weight[x]), b), (max(a, b), 0, min(a, b))]
    return [np.array(out, np.int64)] if out else []


def _verify(least: float):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole (label, filter, lo, hi) groups from sorted rows; at most a batch and a group are held."""
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            key = _keys(t)
            cut = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            key = _keys(t)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [t.num_rows]])
            nodes, weight = t["node"].to_numpy(), t["weight"].to_numpy()
            bucket, chunk, lo, hi = (t[c].to_numpy() for c in ("filter", "chunk", "lo", "hi"))
            vectors, lists = t["vector"].combine_chunks(), t["filters"].combine_chunks()
            v_at, f_at = vectors.offsets.to_numpy(), lists.offsets.to_numpy()
            v_all, f_all = vectors.values.to_numpy(), lists.values.to_numpy()
            rows: list[np.ndarray] = []
            size, even = np.diff(starts), v_at[-1] - v_at[0] == t.num_rows * (v_at[1] - v_at[0]) and (np.diff(v_at) == v_at[1] - v_at[0]).all()
            every = unit_rows(v_all[v_at[0] : v_at[-1]].reshape(t.num_rows, -1)) if even else None
            small = (size <= SMALL) & (lo[starts[:-1]] == hi[starts[:-1]]) if even else np.zeros(len(size), bool)  # of one chunk
            rows += _small_groups(starts[:-1][small], size[small], nodes, weight, bucket, every, (f_at, f_all), least)
            for a, b in zip(starts[:-1][~small].tolist(), starts[1:][~small].tolist(), strict=True):
                if b - a < 2:
                    continue
                units = every[a:b] if even else unit_rows(v_all[v_at[a] : v_at[b]].reshape(b - a, -1))
                f = [f_all[f_at[k] : f_at[k + 1]] for k in range(a, b)]
                left = np.flatnonzero(chunk[a:b] == lo[a])
                right = left if lo[a] == hi[a] else np.flatnonzero(chunk[a:b] == hi[a])
                if len(left) and len(right):
                    rows += _block(int(bucket[a]), nodes[a:b], weight[a:b], units, f, left, right, least)
            if rows:
                got = np.concatenate(rows)
                got = got[(got[:, 1] > 0) | (got[:, 0] != got[:, 2])]
                yield pa.RecordBatch.from_arrays([pa.array(got[:, k]) for k in range(3)], schema=schema)

    return run


def _keys(t: pa.Table) -> np.ndarray:
    """One comparable value for each row's group; equal neighbours are of one group."""
    label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    out = np.empty(t.num_rows, dtype=[("a", "i8"), ("b", "i8"), ("c", "i8"), ("d", "i8")])
    out["a"], out["b"], out["c"], out["d"] = label, t["filter"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy()
    return out


def link_vectors(table: DataFrame, least: float = LEAST, cap: float = CAP, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", words: int = WORDS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row. words: code words of a slice, up to MOST_WORDS."""
    narrow = isinstance(table.schema[vector_col].dataType.elementType, T.FloatType)  # floats travel as they are
    vector = F.col(vector_col) if narrow else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    told = rows.mapInArrow(_told, f"vec_id long, label string, vector array<{'float' if narrow else 'double'}>, s1 long, s2 long")
    rows = staged(told.withColumn("row", F.monotonically_increasing_id()), "vectors")
    able = rows.where("vector is not null")
    same = staged(able.groupBy("s1", "s2").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id")), "equal-vectors")
    heads = able.join(same.select(F.col("node").alias("row"), "node", "weight"), "row").select("node", "label", "weight", "vector")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = staged(heads.repartition(parts, "node"), "distinct-vectors")
    passed = heads.select("node", "label", "vector").mapInArrow(_expand(cap, words), "node long, label string, filters array<long>")
    posts = staged(passed.select("node", "label", F.explode("filters").alias("filter")), "filters")
    sizes = posts.groupBy("label", "filter").agg(F.count("*").alias("c")).where("c > 1").withColumn("chunks", F.ceil(F.col("c") / CHUNK).cast("int"))
    # filters that a vector has for itself decide nothing, so only shared ones travel with it
    shared = staged(posts.join(sizes, ["label", "filter"]).select("node", "label", "filter", "chunks"), "shared-filters")
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    spread = shared.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select("node", "label", "filter", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    with_vectors = spread.join(heads.select("node", "weight", "vector").join(lists, "node"), "node")
    group = ["label", "filter", "lo", "hi"]
    dealt = with_vectors.repartition(parts, *group).sortWithinPartitions(*group, "node")
    found = staged(dealt.mapInArrow(_verify(least), "node long, n long, other long"), "vector-links")
    discard(heads, posts, shared)
    counts = found.where("node = other").groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = same.join(counts, "node", "left").join(labels.withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = groups.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    groups = groups.join(first, "comp").select("s1", "s2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = able.select("vec_id", "s1", "s2").join(groups, ["s1", "s2"]).select("vec_id", "n_links", "component_id")
    out = linked.union(rows.where("vector is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
