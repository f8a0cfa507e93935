"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is still in a group.

Rows that share neither length nor prefix with another are settled without their text being hashed whole: what repeats
sets bits of a bitmap of at most MOST_WORDS words, which tasks look up as they read. A bit may be set by another key; that
costs a row the hashing of its text and changes nothing. Text never leaves a task. Groups are sized by partial
aggregation; group facts are joined back by key, so a group of any size is only ever joined with one row (AQE can split
it).

Defined cases: null text counts as empty (it equals an empty text); the largest id stays, null ids come first in that
order; rows that repeat both id and text are one group in which each such row is marked by its id alone, so all rows
with the winning id stay; an empty table gives no rows; other columns may be carried through by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, documents, staged

#: Words of 64 bits: one for WORDS_FOR keys, some 24 MB at most as a broadcast table.
PREFIX_CHARS, MOST_WORDS, WORDS_FOR = 256, 1 << 20, 4


def _key() -> Column:
    return F.xxhash64("_len", "_pre")


def _word(words: int) -> Column:
    return F.pmod(F.shiftright("_key", 6), F.lit(words))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs: id, the carried columns, keep_id, group_size, kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c_{c}") for c in carry], text.alias("_text"), F.octet_length(text).alias("_len"))
    keyed = rows.withColumn("_pre", F.xxhash64(F.substring("_text", 1, prefix_chars)))
    lengths = rows.groupBy("_len").agg(F.count("*").alias("n")).where("n > 1").select("_len")
    # a prefix hash can only repeat within a repeated length
    again = staged(keyed.select("_len", "_pre").join(lengths, "_len", "left_semi").groupBy("_len", "_pre").agg(F.count("*").alias("n")).where("n > 1").select(_key().alias("_key")), "repeated-prefixes")
    words = min(MOST_WORDS, again.count() // WORDS_FOR + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_key"), F.lit(64)).cast("int"))
    bitmap = again.groupBy(_word(words).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    looked = keyed.withColumn("_key", _key()).withColumn("_word", _word(words)).join(F.broadcast(bitmap), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    refined = staged(looked.withColumn("_full", F.when(hit, F.sha2("_text", 256))).drop("_text", "_pre", "_key", "_word", "_bits"), "refined")
    discard(again)
    grouped = refined.where("_full is not null")
    facts = grouped.groupBy("_len", "_full").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    copies = grouped.join(facts, ["_len", "_full"])
    alone = refined.where("_full is null").withColumn("keep_id", F.col("_id")).withColumn("group_size", F.lit(1).cast("long"))
    both = copies.select(*alone.columns).unionByName(alone)
    return both.select(F.col("_id").alias(id_col), *[F.col(f"_c_{c}").alias(c) for c in carry], "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_groups(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op4": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
