"""Mixing sources to target weights by hash-threshold histograms, with SQL functions only.

Sources in code-point order (null last) weigh 5, 2, 1, repeating. Together they get as many words as all documents
hold; a source's target stops at MAX_REPEATS times its size and the excess goes to the others by weight. In closed form
a target is min(cap, weight * level): sources are taken by cap over weight until the level no longer fills them.

A source takes floor(target / size) whole passes and, for the rest, the documents whose hash lies below a threshold. The
threshold is found by histograms: words by source and leading hash digits, the bucket where the running sum passes the
rest, and again within that bucket alone, level by level, until single rows are left. So no documents are sorted, a
level reads a small part of the rows of the one before, and a histogram has at most 16^3 bars a source. The hash is that
of id and text, then that of the row's number, which tells equal rows apart; its levels run only where equal rows lie at
the threshold. The nearer side of the last row is taken.

Defined cases: a null or empty text has size 0 and is never taken; null is a source of its own; rows that repeat a
doc_id are taken by their own texts, equal rows as many as the target asks for; an empty table, or one without words,
takes nothing; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import WHITESPACE, discard, documents, staged

WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
#: Digits of the hash that each level looks at. The first 32 are of id and text.
DOCUMENT_DIGITS, ROW_DIGITS = (3, 6, 9, 32), (35, 38, 41, 48)


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+", -1))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """sizes: _none, _src, source_size, a row per source. Adds target. Its windows hold one row per source."""
    # a windowed rank over sources: their number, not that of the documents
    place = F.row_number().over(W.orderBy("_none", "_src")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_none", "_src")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = s.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    s = s.withColumn("_weights", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # the first source, by cap over weight, that the level doesn't fill sets the level for itself and all after it
    s = s.withColumn("_open", F.col("_cap") * F.col("_weights") >= F.col("_left") * F.col("_w"))
    first = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_none", "_src", "_left", "_weights"))).over(everything)
    s = s.withColumn("_first", first).withColumn("_filled", F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_none", "_src") < F.struct("_first.r", "_first._none", "_first._src"))
    level = (F.col("_w") * F.col("_first._left")).cast("double") / F.col("_first._weights")
    return s.select("_none", "_src", "source_size", F.when(F.col("_filled") | F.col("_first").isNull(), F.col("_cap").cast("double")).otherwise(level).alias("target"))


def _thresholds(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with _bar, a hash or the leading digits of one, and whether rows at it are taken once more, as all below are."""
    open_ = plan.select("_none", "_src", F.col("rest").alias("_want"), F.lit("").alias("_prefix"))
    spent = []
    for digits in (*DOCUMENT_DIGITS, *ROW_DIGITS):
        inside = slim.join(open_, ["_none", "_src"]).where(F.startswith(F.col("_hash"), F.col("_prefix")))
        bars = inside.groupBy("_none", "_src", F.substring("_hash", 1, digits).alias("_bar")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_rows"), F.first("_want").alias("_want"))
        w = W.partitionBy("_none", "_src").orderBy("_bar")
        bars = bars.withColumn("_upto", F.sum("_sum").over(w)).withColumn("_was", F.col("_upto") - F.col("_sum"))
        hit = staged(bars.where((F.col("_upto") >= F.col("_want")) & (F.col("_was") < F.col("_want"))), f"bars-{digits}")
        spent.append(hit)
        open_ = hit.select("_none", "_src", (F.col("_want") - F.col("_was")).alias("_want"), F.col("_bar").alias("_prefix"))
        if digits == DOCUMENT_DIGITS[-1] and hit.where("_rows > 1").isEmpty():
            break
    # when the row at the bar is left out, everything below it is in
    near = hit.select("_none", "_src", "_bar", (F.col("_upto") - F.col("_want") <= F.col("_want") - F.col("_was")).alias("_takes"))
    out = staged(plan.join(near, ["_none", "_src"], "left"), "mix-thresholds")
    discard(*spent)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_id, _same, _none, _src, size, source_size, target, taken: a row for each row of docs."""
    source, text = F.col(source_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    document = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_same"), source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_src"), word_count(F.col(text_col)).alias("size"), document.alias("_document"))
    row = F.lower(F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0"))
    slim = staged(slim.withColumn("_hash", F.concat("_document", row)).drop("_document"), "sizes")
    t = targets(slim.groupBy("_none", "_src").agg(F.sum("size").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    whole = staged(t.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-plan")
    plan = _thresholds(slim.where("size > 0"), whole)
    discard(whole)
    at = F.substring(F.col("_hash"), F.lit(1), F.length("_bar"))
    more = F.coalesce(F.when(F.col("_takes"), at <= F.col("_bar")).otherwise(at < F.col("_bar")), F.lit(False))
    return slim.join(plan, ["_none", "_src"]).select("_id", "_same", "_none", "_src", "size", "source_size", "target", (F.col("size") * (F.col("passes") + more.cast("long"))).alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = {
    "op7": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS BIGINT) AS w FROM d GROUP BY source),
-- sources are filled one after another, the one with the least room for its weight first, as long as it can't take its share
k AS (SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST) AS place FROM s),
fill AS (
  SELECT CAST(0 AS BIGINT) AS place, CAST((SELECT sum(source_size) FROM s) AS BIGINT) AS words, CAST((SELECT sum(w) FROM s) AS BIGINT) AS weights
  UNION ALL
  SELECT k.place, fill.words - 3 * k.source_size, fill.weights - k.w FROM fill JOIN k ON k.place = fill.place + 1
  WHERE 3 * k.source_size * fill.weights < fill.words * k.w),
level AS (SELECT place AS filled, words, weights FROM fill ORDER BY place DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN place <= filled THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * words AS DOUBLE) / weights END AS target FROM k, level),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
-- rows in the order of their hashes (equal rows in any); each ends at a running sum
r AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  size * (passes + CASE WHEN upto < rest OR (upto >= rest AND upto - size < rest AND upto - rest <= rest - (upto - size)) THEN 1 ELSE 0 END) AS taken
FROM r""",
}
