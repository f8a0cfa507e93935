"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of equal sets are collapsed first. The columns (n-grams) are split into blocks by hash, more of them than two sets of
that size class can differ in and still link. So two linked rows agree in at least one whole block, and the product only
needs the rows that agree in a block; a block of several n-grams is rarely alike by chance. Blocks that are empty in both
rows agree, too: there are some blocks to spare for that, and a row with more empty ones than those lists them as well.
Below BLOCKS_FROM a block would hold few n-grams, so single columns are used there: every set is written in one global
order of n-grams, frequent ones last, and two sets at the threshold share an n-gram among the first n - ceil(t n) + 1 of
each. Sizes out of ratio are discarded. Survivors get their full overlap count.

Columns with the same documents give the same pairs, so one of them stands for all (near copies share hundreds of them).
A column that many documents share would give the square of its length. So within a column (split by size class, whose
neighbours alone can link) candidates are first counted against one pivot only. Documents that link to the pivot are one
component and need no pair among themselves; Jaccard distance is a metric, so two documents whose distances to the
pivot differ by more than 1 - t can't link. More pivots follow, rows that have linked to none so
far and rows that have by turns, as long as that saves enough comparisons. Before sets are fetched, parity sketches rule out pairs
that differ in too many n-grams; that bound is exact, too. What is then still in different components is compared pair
by pair. No link between different components is lost.

The order of single columns only affects cost: n-grams that repeat within a batch of documents are counted over all
data, and the HOT most frequent (a fixed bound) are known to every task.

Defined cases: null and blank texts have no n-grams and link with nothing; a text of fewer than k words is one n-gram;
rows that repeat a doc_id are nodes of their own (its component is then the least over them); other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import MEMO_ENTRIES, discard, documents, memo, staged
from lumenfold.llm.components import components

HOT, BROADCAST_ROWS, SKETCH_BITS, BLOCKS_FROM = 1 << 17, 1_000_000, 1024, 0.85
#: Rounds of pivots end when they no longer save a QUIT-th of the comparisons that are left, or after ROUNDS of them.
ROUNDS, QUIT = 8, 5
#: Bits of the sketch that has room for a set of any size: twice its size, up to the next power of two.
LEAST_BITS, MOST_BITS = 256, 1 << 20
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word n-grams, ascending. Words: ASCII letters lower-cased, ASCII white space apart."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo("ngrams", "words", _WordHashes).__getitem__, words), np.uint64, len(words))
    n = max(len(h) - k + 1, 1)
    out = np.full(n, np.uint64(min(len(h), k)), np.uint64)
    for i in range(min(len(h), k)):
        out = _mixed(out * _M3 + h[i : i + n])
    return np.unique(out)


def _repeated(k: int):
    schema = pa.schema([("s", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                sets = [shingles(t, k) for t in batch.column(0).slice(i, 4096).to_pylist()]
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                on = n >= 4
                yield pa.RecordBatch.from_arrays([pa.array(s[on].view(np.int64)), pa.array(n[on])], schema=schema)

    return run


def _ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rare n-grams by hash, then hot ones by frequency."""
    if not len(hot):
        return s
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    late = s[is_hot]
    return np.concatenate([s[~is_hot], late[np.argsort(rank[at[is_hot]], kind="stable")]])


def _agreements(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the column blocks of a set, for its size class and the next one up, with which smaller sets share it."""
    ratio, mixed = math.log(den / num), np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s), dtype=np.uint64)])
    own, out = math.floor(math.log(len(s)) / ratio + 1e-9), []
    for g in (own, own + 1):
        # sizes here are below (den / num) ^ (g + 1); a link differs in at most that many n-grams
        differ = 2 * (math.floor(math.exp((g + 1) * ratio)) + 1) * (den - num) // (den + num)
        spare = 1 + differ // 16
        blocks = differ + 1 + spare
        block = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # ascending, as s is
        ends = np.searchsorted(block, np.arange(blocks, dtype=np.uint64), side="right")
        starts = np.concatenate([[0], ends[:-1]])
        label = np.arange(blocks, dtype=np.uint64) * _M1 + np.full(1, g + 1, np.uint64) * _M2
        hashes = _mixed((mixed[ends] - mixed[starts]) * _M3 + label)
        full = ends > starts
        out.append(hashes[full] if (~full).sum() <= spare else hashes)
    return np.concatenate(out)


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit i tells whether the set has an odd number of n-grams whose lowest bits are i."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(w: Column) -> Column:
    """A sketch of half the length: bits that are equal but for the highest one meet."""
    half = (F.size(w) / 2).cast("int")
    return F.zip_with(F.slice(w, F.lit(1), half), F.slice(w, half + 1, half), lambda u, v: u.bitwiseXOR(v))


def _room(n: int) -> int:
    return min(max(LEAST_BITS, 1 << max(2 * n - 1, 1).bit_length()), MOST_BITS)


def _incidence(k: int, num: int, den: int, hot, whole: bool):
    def listed(s: np.ndarray) -> np.ndarray:
        if whole or not len(s):
            return s
        return _agreements(s, num, den) if num >= BLOCKS_FROM * den else _ordered(s, *hot.value)[: len(s) - -(-num * len(s) // den) + 1]

    names = [("doc_id", pa.int64()), ("same", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]
    schema = pa.schema([*names, ("grams", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                n, s1, s2, grams, sketch, wide = [], [], [], [], [], []
                for text in some.column(1).to_pylist():
                    s = shingles(text, k)
                    raw = s.tobytes()
                    d = xxhash.xxh3_128_intdigest(raw)
                    n.append(len(s))
                    s1.append((d >> 64) - (1 << 63))
                    s2.append((d & (2**64 - 1)) - (1 << 63))
                    sketch.append([] if whole else _parity(s, SKETCH_BITS).tolist())
                    wide.append([] if whole else _parity(s, _room(len(s))).tolist())
                    grams.append(listed(s).view(np.int64))
                flat = pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.array(sketch, schema.field("sketch").type), pa.array(wide, schema.field("wide").type)], schema=schema)

    return run


_ROWS = "doc_id long, same long, n long, s1 long, s2 long, grams array<long>, sketch array<long>, wide array<long>"


class NgramJoin:
    """One join of docs with itself at Jaccard >= num / den over k-word n-grams."""

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same"))
        self.spark, self.k, self.num, self.den = docs.sparkSession, k, num, den
        self.hot, self.blocks = None, num >= BLOCKS_FROM * den
        if not self.blocks:
            self.hot = self._frequent()
        self.rows = staged(self.docs.mapInArrow(_incidence(k, num, den, self.hot, False), _ROWS).withColumn("row", F.monotonically_increasing_id()), "incidence")

    def _frequent(self):
        """The HOT most frequent n-grams, for every task."""
        top = self.docs.select("text").mapInArrow(_repeated(self.k), "s long, df long").groupBy("s").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "s").limit(HOT).toPandas()
        order = np.argsort(top["s"].to_numpy(np.int64).view(np.uint64), kind="stable")
        return self.spark.sparkContext.broadcast((top["s"].to_numpy(np.int64).view(np.uint64)[order], top["df"].to_numpy(np.int64)[order]))

    def _fits(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """row and all its n-grams, for the given rows, computed from their texts anew."""
        wanted = staged(self.rows.join(nodes, "row", "left_semi").select("row", "doc_id", "s1", "s2"), "wanted")
        ids = wanted.select("doc_id").distinct()
        few = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
        again = self.docs.join(few, self.docs["doc_id"].eqNullSafe(few["doc_id"]), "left_semi").mapInArrow(_incidence(self.k, self.num, self.den, self.hot, True), _ROWS)
        out = staged(again.select("s1", "s2", "grams").join(wanted.select("row", "s1", "s2"), ["s1", "s2"]).select("row", "grams"), "sets")
        discard(wanted)
        return out

    def _overlaps(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs: a, b, na, nb. Adds inter, the number of common n-grams, and bounds of the distance, lo and hi.

        inter is null where the sets differ in too much to link: an n-gram in one set alone flips one bit of the parity
        sketches, so their Hamming distance never exceeds the number of such n-grams. Sketches have two bits or more for
        each n-gram of a set; the longer of two is folded until both are of one length, which changes nothing in that.
        """
        sk = self.rows.select("row", "wide")
        x, y = sk.select(F.col("row").alias("a"), F.col("wide").alias("wa")), sk.select(F.col("row").alias("b"), F.col("wide").alias("wb"))
        met = pairs.join(x, "a").join(y, "b")
        for _ in range(math.ceil(math.log2(self.den / self.num))):
            met = met.withColumns({c: F.when(F.size(c) > F.size(other), _folded(F.col(c))).otherwise(F.col(c)) for c, other in (("wa", "wb"), ("wb", "wa"))})
        flips = F.aggregate(F.zip_with("wa", "wb", lambda u, v: F.bit_count(u.bitwiseXOR(v)).cast("long")), F.lit(0).cast("long"), lambda t, u: t + u)
        total = F.col("na") + F.col("nb")
        seen = staged(met.select("a", "b", "na", "nb", flips.alias("flips")), f"{name}-sketches")
        able = F.col("flips") * (self.den + self.num) <= total * (self.den - self.num)
        near = seen.where(able).drop("flips")
        sets = self._sets(near.select(F.col("a").alias("row")).union(near.select("b")).distinct())
        x, y = sets.select(F.col("row").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("row").alias("b"), F.col("grams").alias("gb"))
        got = near.join(x, "a").join(y, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("inter"))
        dist = 1 - F.col("inter") / (total - F.col("inter"))
        got = got.withColumn("lo", dist).withColumn("hi", dist)
        far = seen.where(~able).select("a", "b", "na", "nb", F.lit(None).cast("long").alias("inter"), (2 * F.col("flips") / (total + F.col("flips"))).alias("lo"), F.lit(1.0).alias("hi"))
        out = staged(got.union(far), name)
        discard(seen, sets)
        return out

    def _meets(self) -> Column:
        return F.col("inter") * self.den >= (F.col("na") + F.col("nb") - F.col("inter")) * self.num

    def _linked(self, pairs: DataFrame) -> DataFrame:
        return pairs.where(self._meets()).select("a", "b")

    def _distinct_columns(self, columns: DataFrame, name: str) -> DataFrame:
        """columns: s, g, row and others. Of columns with the same rows one stays: their pairs are the same. Single rows go."""
        marks = columns.groupBy("s", "g").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("row")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("f2"))
        chosen = marks.where("c > 1").groupBy("c", "f1", "f2").agg(F.min(F.struct("s", "g")).alias("k")).select("k.s", "k.g")
        out = staged(columns.join(chosen, ["s", "g"], "left_semi"), name)
        discard(columns)
        return out

    def members(self) -> DataFrame:
        """A written table of row, doc_id, same, n, label: label is the least row of its component, null for empty sets."""
        full = self.rows.where("n > 0")
        same = ["n", "s1", "s2"]
        reps = staged(full.groupBy(*same).agg(F.min("row").alias("rep")), "equal-sets")
        heads = full.select("row", "n", "grams").join(reps.select(F.col("rep").alias("row")), "row", "left_semi")
        posts = heads.select("row", "n", F.explode("grams").alias("s"))
        shared = posts.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
        ratio = float(np.log(self.den / self.num))
        size_class = F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9)
        # sets whose sizes are within the ratio are in the same class or in neighbouring ones
        kept = posts.join(shared, "s", "left_semi").withColumn("g", F.lit(0).cast("long") if self.blocks else size_class)
        both = staged(kept.select("s", "row", "n", "g" if self.blocks else F.explode(F.array("g", F.col("g") + 1)).alias("g")), "columns")
        both = self._distinct_columns(both, "distinct-columns")
        group, gap, eps = ["s", "g"], 1 - self.num / self.den, 1e-9
        links, live, seen, left = None, both.withColumn("met", F.lit(False)), [], None
        for r in range(ROUNDS):
            # by turns a row that has linked to no pivot yet, which may open a component, and one that has, to which more may
            # link; the pivot leaves its column afterwards
            one = F.struct("row", "n")
            pivots = live.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("met") == F.lit(r % 2 == 1), one)), F.min(one)).alias("p"))
            near = live.join(pivots.select(*group, F.col("p.row").alias("pivot"), F.col("p.n").alias("pn")), group)
            near = staged(near, f"near-{r}")
            asked = near.where((F.col("row") != F.col("pivot")) & self._fits(F.col("n"), F.col("pn"))).select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b"), F.when(F.col("row") < F.col("pivot"), F.col("n")).otherwise(F.col("pn")).alias("na"), F.when(F.col("row") < F.col("pivot"), F.col("pn")).otherwise(F.col("n")).alias("nb")).distinct()
            candidates = staged(asked, "candidates")
            counted = self._overlaps(candidates, f"overlaps-{r}")
            found = self._linked(counted)
            links = found if links is None else links.union(found)
            seen.append(counted)
            dist = counted.select("a", "b", F.col("lo").alias("dlo"), F.col("hi").alias("dhi"), self._meets().alias("linked"))
            # bounds of the distance to the pivot; where the sizes alone rule a link out they give the lower one
            joined = near.where("row <> pivot").join(dist, (F.least("row", "pivot") == F.col("a")) & (F.greatest("row", "pivot") == F.col("b")), "left")
            sizes, linked, was = 1 - F.least("n", "pn") / F.greatest("n", "pn"), F.coalesce("linked", F.lit(False)), live
            live = joined.select(*group, "row", "n", *[f"{x}{i}" for i in range(r) for x in ("lo", "hi")], F.coalesce("dlo", sizes).alias(f"lo{r}"), F.coalesce("dhi", F.lit(1.0)).alias(f"hi{r}"), (F.col("met") | linked).alias("met"), linked.alias("_now"))
            # the pivot has met every row of its column; one whose other rows are one alone, or all link to it, is done
            open_ = live.groupBy(*group).agg(F.bool_and("_now").alias("done"), F.count("*").alias("c")).where("not done and c > 1").select(*group)
            live = staged(live.join(open_, group, "left_semi").drop("_now"), f"live-{r}")
            discard(near, candidates, was)
            before, left = left, live.groupBy(*group).agg((F.count_if(~F.col("met")) * F.count("*")).cast("double").alias("w")).agg(F.sum("w")).first()[0] or 0
            if not left or (before is not None and left > before * (QUIT - 1) / QUIT):
                break
        rounds = r + 1
        labels = components(links)
        live = live.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        many = live.groupBy(*group).agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select(*group)
        was, live = live, self._distinct_columns(staged(live.join(many, group, "left_semi"), "live"), "live-distinct")
        discard(was, labels)
        # sketches join in, so that a pair which they rule out is never a row
        words = range(SKETCH_BITS // 64)
        sk = self.rows.select("row", *[F.get("sketch", F.lit(i)).alias(f"k{i}") for i in words])
        was, live = live, staged(live.join(sk, "row"), "live-sketches")
        discard(was)
        u, v = live.alias("u"), live.alias("v")
        on = [F.col("u.s") == F.col("v.s"), F.col("u.g") == F.col("v.g"), F.col("u.row") < F.col("v.row"), F.col("u.label") != F.col("v.label"), self._fits(F.col("u.n"), F.col("v.n"))]
        on += [F.col(f"{x}.lo{i}") - F.col(f"{y}.hi{i}") <= gap + eps for i in range(rounds) for x, y in ("uv", "vu")]
        flips = sum((F.bit_count(F.col(f"u.k{i}").bitwiseXOR(F.col(f"v.k{i}"))).cast("long") for i in words), F.lit(0).cast("long"))
        on += [flips * (self.den + self.num) <= (F.col("u.n") + F.col("v.n")) * (self.den - self.num)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        rest = staged(u.join(v, cond).select(F.col("u.row").alias("a"), F.col("v.row").alias("b"), F.col("u.n").alias("na"), F.col("v.n").alias("nb")).distinct(), "rest")
        discard(live)
        new = rest
        for counted in seen:  # pairs with a pivot have their counts
            new = new.join(counted.select("a", "b"), ["a", "b"], "left_anti")
        new = staged(new, "rest-new")
        counted = self._overlaps(new, "overlaps-rest")
        labels = components(links.union(self._linked(counted)))
        discard(rest, new, counted, *seen)
        groups = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("label", "rep").alias("label"))
        linked = full.select("row", "doc_id", "same", *same).join(groups, same).select("row", "doc_id", "same", "n", "label")
        out = staged(linked.union(self.rows.where("n = 0").select("row", "doc_id", "same", "n", F.lit(None).cast("long").alias("label"))), "members")
        discard(self.rows, reps, labels)
        return out


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (one row of each component), _same (hash of the text) for each row of docs."""
    m = NgramJoin(docs, k, num, den, id_col, text_col).members()
    best = m.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    joined = m.where("label is not null").join(best, "label").select("doc_id", "n", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("same").alias("_same"))
    out = joined.union(m.where("label is null").select("doc_id", "n", F.col("doc_id"), F.lit(True), "same"))
    return out.withColumnRenamed("n", "n_shingles")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: three words, Jaccard of 0.9 or more."""
    return near_duplicates(documents(spark, sf_dir), 3, 9, 10).select("doc_id", "n_shingles", "component_id")
