"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The raw model counts hashed unigrams and bigrams of every document; the target model those of good labelled documents.
A document's log weight is the log of the ratio of its probability in the two, the sum of log ratios over its n-grams.
Keeping the k largest of log weight + Gumbel noise is sampling k documents without replacement by importance; the noise
is a hash of the id, so reruns agree. k is the number of documents whose log weight reaches a cut, which is fitted on the
labelled rows so that few good ones are lost. The k-th largest key is found by histograms, not by sorting.

Fitted on at most SAMPLE labelled rows, chosen by hash of the id; everything else reads all documents. The driver holds
those rows and BUCKETS counts, both fixed sizes.

Defined cases: a null or blank text has no n-grams and is rejected; without good and bad labelled rows all documents with
n-grams stay; a doc_id with several labels takes the worst; of rows that repeat a labelled doc_id the one with the least
weight is fitted on; rows that repeat a doc_id share their noise, ties at the cut
stay together; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import MEMO_ENTRIES, documents, memo, staged

BUCKETS, SAMPLE, GOOD_COST = 1 << 14, 20_000, 4
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """32-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 32:
            self[word] = h
        return h


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of texts one after another, and how many each text has."""
    hashes = memo("quality", "words", _Hashes)
    words = [_TOKEN.findall(t) if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((x for w in words for x in map(hashes.__getitem__, w)), np.uint64, int(n.sum()))
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64) % BUCKETS
    one, two = mix(h + np.uint64(1)), mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) if len(h) else np.zeros(0, np.int64)
    # unigram i stands at 2 i, the bigram from i to i + 1 behind it; one that would cross texts repeats its unigram
    out = np.empty(2 * len(h), np.int64)
    out[0::2] = one
    if len(h):
        out[1:-1:2], out[-1] = two, one[-1]
        ends = (np.cumsum(n) - 1)[n > 0]
        out[2 * ends + 1] = one[ends]
    return out, 2 * n


def _counts(good: np.ndarray):
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                found, n = features(some.column(1).to_pylist())
                ids = some.column(0).fill_null(-(1 << 63)).to_numpy()
                on = good[np.minimum(np.searchsorted(good, ids), max(len(good) - 1, 0))] == ids if len(good) else np.zeros(len(ids), bool)
                raw += np.bincount(found, minlength=BUCKETS)
                target += np.bincount(found[np.repeat(on, n)], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], schema=schema)

    return run


def _weigh(ratio: np.ndarray):
    schema = pa.schema([("_id", pa.int64()), ("_same", pa.int64()), ("n_features", pa.int64()), ("log_weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                found, n = features(some.column(1).to_pylist())
                # summed within each text, so a weight doesn't depend on the batch
                weight = np.bincount(np.repeat(np.arange(len(n)), n), weights=ratio[found], minlength=len(n))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(n), pa.array(weight)], schema=schema)

    return run


def fit_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least cost, a lost good row costing GOOD_COST bad ones; the middle of the widest such gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.lexsort((good, scores))
    s, g = scores[order], good[order]
    cost = np.concatenate([[0], np.cumsum(np.where(g, GOOD_COST, -1))]) + (~g).sum()  # rejecting the first i
    gaps = np.diff(s, prepend=s[0] - 1, append=s[-1] + 1)
    best = np.flatnonzero(cost == cost.min())
    i = int(best[np.argmax(gaps[best])])
    return float(s[i] - gaps[i] / 2) if i < len(s) else np.inf


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest value, by histograms of ever narrower ranges; at most bins or few rows come to the driver."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while True:
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        n = inside.count()
        if lo == hi or n <= few:
            return lo if lo == hi else sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]
        width = (hi - lo) / bins
        rows = {r[0]: r[1:] for r in inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(rows, reverse=True):
            if k <= rows[b][0]:
                lo, hi = rows[b][1:]
                break
            k -= rows[b][0]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """A written table of _id, _same (hash of the text), n_features, log_weight for each row of docs, and the fitted cut."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_same"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    good = np.array(sorted(r["doc_id"] for r in known if r["quality"] == 1 and r["toxic"] == 0), np.int64)
    counts = rows.select("_id", "_text").mapInArrow(_counts(good), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for b, r, t in counts:
        raw[b] += r
        target[b] += t
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > BUCKETS else np.zeros(BUCKETS)
    scored = staged(rows.mapInArrow(_weigh(ratio), "_id long, _same long, n_features long, log_weight double"), "weights")
    marks = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"] == 1) for r in known], "_id long, good boolean")
    # a labelled id that repeats is judged by its least weight, whatever the order of rows
    pairs = scored.where("n_features > 0").join(marks, "_id").groupBy("_id", "good").agg(F.min("log_weight").alias("log_weight")).select("log_weight", "good").collect()
    cut = fit_cut(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], bool)) if pairs else -np.inf
    return scored, cut


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """_id, _same, n_features, log_weight, key, kept: a row for each row of docs."""
    scored, cut = score(docs, labels, id_col, text_col, sample)
    u = (F.pmod(F.xxhash64(F.lit(8), F.col("_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    able = keyed.where("n_features > 0")
    k = able.where(F.col("log_weight") >= float(cut)).count()
    least = kth_largest(able, "key", k) if k else float("inf")
    return keyed.withColumn("kept", (F.col("n_features") > 0) & (F.col("key") >= float(least)))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, log_weight, key, kept."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(F.col("_id").alias("doc_id"), "n_features", "log_weight", "key", "kept")
