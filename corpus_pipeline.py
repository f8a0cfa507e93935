"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, source mixing, packing.

Each stage reads what the one before it wrote. All but the last return the columns of documents: the first drops
documents it rejects, the second drops common lines, the third keeps one document of each near-duplicate group, the
fourth repeats or drops documents as the mix takes them. The last gives the packed pieces.

Rows are told apart by doc_id and a hash of their text, so of rows that repeat a doc_id each is judged by its own text.
Rows with equal doc_id and text (null ones, too) become a single row in the third stage, whatever their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, staged
from lumenfold.llm.line_dedup import drop_common_lines
from lumenfold.llm.mixing import mix
from lumenfold.llm.ngram_join import near_duplicates
from lumenfold.llm.packing import pack_documents
from lumenfold.llm.quality import resample

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same_rows(docs: DataFrame, told: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(told["_id"]) & (F.xxhash64(docs["text"]) == told["_same"])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("_id", "_same").distinct()
    return docs.join(kept, _same_rows(docs, kept), "left_semi").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_common_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = near_duplicates(docs).groupBy(F.col("doc_id").alias("_id"), "_same").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("_n"))
    kept = staged(told.where("kept").select("_id", "_same", "_n"), "kept-documents")
    once, more = kept.where("_n = 1"), kept.where("_n > 1")
    single = docs.join(once, _same_rows(docs, once), "left_semi").select(*COLUMNS)
    # equal rows may differ in other columns: the least stays
    equal = docs.join(more, _same_rows(docs, more)).groupBy("_id", "_same").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_d"))
    return single.union(equal.select(*[F.col(f"_d.{c}").alias(c) for c in COLUMNS]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix(docs).where("taken > 0").groupBy("_id", "_same", "_none", "_src").agg(F.sum(F.expr("cast(taken div size as int)")).cast("int").alias("_times"), F.count("*").alias("_n"))
    times = staged(taken, "taken-documents")
    source = docs["source"].cast("string")
    same = _same_rows(docs, times) & (source.isNull() == times["_none"]) & (F.coalesce(source, F.lit("")) == times["_src"])
    found = docs.join(times, same)
    single = found.where("_n = 1").select(*COLUMNS, "_times")
    # equal rows are taken together; they may differ in other columns: the least stands for all
    equal = found.where("_n > 1").groupBy("_id", "_same", "_none", "_src").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("_d"), F.first("_times").alias("_times"))
    both = single.union(equal.select(*[F.col(f"_d.{c}").alias(c) for c in COLUMNS], "_times"))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Hashing, tokenising and packing have no SQL; tests/llm compares the operators with brute-force
#: versions, and three stages on repeated rows with the rows they must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
