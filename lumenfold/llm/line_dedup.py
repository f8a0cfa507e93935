"""Line dedup over levelled sorted runs of line hashes, with SQL functions only.

A run is a table of (h1, h2, n_docs), bucketed and sorted by hash: a line key's 128-bit hash and the number of documents
seen with it. All runs have the same buckets, so two of them, or a run and a batch, are joined by merging sorted buckets;
only a batch is ever shuffled. New documents come in batches. A batch counts its own keys and is merge-anti-joined with
each run, for the keys that the run already holds at the limit (those are decided; their counts needn't grow). What is
left becomes a run of level 0. Whenever a level has FANOUT runs they are compacted, by full outer merges that sum counts,
into one run of the next level. A key in at least min_docs documents, over all runs, loses its lines everywhere.

The frequent keys are joined to (document, key hash, place of the line) rows, never to text; a document gets the places
of its lines that go. A hot key is only ever counted after partial
aggregation and joined with one row, so a sort-merge join of it can be split by AQE. Texts are shuffled once, by doc_id.

Defined cases: a null or empty text is one empty line; the empty key is never dropped; a document's repeats of a line
count once; rows that repeat a doc_id are documents of their own; a document that loses all its lines keeps an empty
text; an empty table stays empty; other columns are kept as they are, names used inside can't clash with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import WHITESPACE, ascii_lower, delete_path, discard, documents, shuffle_partitions, staged, work_path

MIN_DOCS, MIN_CHARS, BATCHES, FANOUT = 10, 1, 4, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITESPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """h1, h2, pos, first: the 128-bit key hash and place of each of a document's lines that can be dropped. A document counts
    a key at the first of its lines with it."""
    keys = F.transform(_lines(text), line_key)
    told = F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(17), k).alias("h2"), i.alias("pos"))))
    return F.array_sort(F.array_compact(told))


def _marked(hashes: Column) -> Column:
    """Sorted hashes with first: whether the one before is of another key."""
    same = lambda x, y: (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])
    return F.transform(hashes, lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), F.when(i == 0, F.lit(True)).otherwise(~same(x, F.get(hashes, i - 1))).alias("first")))


_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Spark trusts the order of buckets of one file, so merges of runs don't sort them again."""
    was = spark.conf.get(_ORDERED)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, was)


class LineRuns:
    """The levels of runs; what a long-lived index would keep between batches. drop() gives their space back."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets, self.levels = shuffle_partitions(spark), [[]]
        self.compactions: list[int] = []  # the level of each run that a compaction wrote

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = work_path(self.spark, "line-run")
        counts.select("h1", "h2", "n_docs").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {name}")
        delete_path(self.spark, path)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged bucket by bucket, counts summed."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnRenamed("n_docs", "_more")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))
            return a.hint("merge").join(b, ["h1", "h2"], "full").select("h1", "h2", n.alias("n_docs"))

        return reduce(both, map(self.spark.table, names))

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def frequent(self) -> DataFrame:
        """Keys at the limit, over all runs."""
        return self._merged(self.runs()).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def add(self, keys: DataFrame) -> None:
        """Adds one batch of (h1, h2) rows, a row for each document and distinct key."""
        with _ordered_buckets(self.spark):
            left = keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
            for name in self.runs():
                decided = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
                left = left.hint("merge").join(decided, ["h1", "h2"], "left_anti")
            self.levels[0].append(self._write(left))
            level = 0
            while len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                merged = self._write(self._merged(old))
                self.levels[level] = []
                level += 1
                if level == len(self.levels):
                    self.levels.append([])
                self.levels[level].append(merged)
                self.compactions.append(level)
                for name in old:
                    self._drop(name)

    def drop(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = [[]]


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """All rows and columns; text without the common lines; _n_lines before, _n_dropped."""
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_same"), _hashes(F.col(text_col), min_chars).alias("_h"))
    hashed = staged(found.select("_id", "_same", F.explode(_marked(F.col("_h"))).alias("_h")).select("_id", "_same", "_h.*"), "line-keys")
    runs = LineRuns(docs.sparkSession, min_docs)
    for k in range(batches):
        runs.add(hashed.where("first").where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(batches)) == k).select("h1", "h2"))
    with _ordered_buckets(docs.sparkSession):
        frequent = staged(runs.frequent(), "frequent-lines")
    runs.drop()
    # a document's rows are found by id and text, so rows that repeat an id keep their own lines; equal rows lose the same
    hits = staged(hashed.join(frequent, ["h1", "h2"], "left_semi").groupBy("_id", "_same").agg(F.collect_set("pos").alias("_drop")), "line-hits")
    discard(hashed, frequent)
    d = docs.withColumn("_row_id", F.col(id_col)).withColumn("_row_same", F.xxhash64(text_col))
    # by merging at every size: a broadcast of what small inputs hit would only hide the shuffle that large ones need
    joined = d.join(hits.hint("merge"), d["_row_id"].eqNullSafe(hits["_id"]) & (d["_row_same"] == hits["_same"]), "left")
    lines = _lines(F.col(text_col))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_drop")  # by hash set, in order
    joined = joined.withColumn("_lines", lines)
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda i: F.get("_lines", i)))
    cleaned = joined.withColumn("_n_lines", F.size("_lines").cast("long")).withColumn("_kept", kept)
    cleaned = cleaned.withColumn("_n_dropped", F.col("_n_lines") - F.size("_kept")).withColumn(text_col, F.array_join("_kept", "\n"))
    return cleaned.select(*docs.columns, "_n_lines", "_n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {
    "op3": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, count(DISTINCT doc_id) AS n FROM k WHERE key <> '' GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n >= 10) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (n IS NULL OR n < 10), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
}
