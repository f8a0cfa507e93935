"""Secret scans with multipart credential linking, with SQL functions only.

Base spans (assign, access, hex) are found by regular expressions over the whole text. The method adds weak candidates,
which say nothing alone: identifiers named as such, long mixed tokens and endpoints. Every part is placed by its start;
an interval join within a document's scopes (a range frame of SCOPE_CHARS to both sides, so no pairs are emitted) tells
which kinds of parts lie near. A weak identifier needs a secret near it, a weak secret an identifier or an endpoint, an
endpoint both an identifier and a secret. Candidates that a base span covers aren't added. A candidate may follow '=' or
'_' directly, as in env files (AWS_ACCOUNT_ID=...); only characters that could belong to it may not stand before it.

Spark's functions give matches but not places: a text is split by the same pattern, and a match starts after the summed
lengths of the pieces and matches before it. One shuffle, of parts alone; texts stay where they are read.

Defined cases: a null text is empty; a text without parts keeps its row, with counts of 0 and empty lists; rows that
repeat a doc_id are scanned separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import documents

SCOPE_CHARS = 400
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, least code points of the group that counts, that group, role. Order is that of spans with equal starts.
KINDS = (
    ("assign", ASSIGN, 6, 2, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 20, 0, "id"),
    ("hex", r"[0-9a-f]{24,}", 24, 0, "secret"),
    ("weak_id", r"(?<![A-Za-z0-9])(?i:(client|account|app|user)[_-]?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._-]+)", 6, 2, "id"),
    ("weak_secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}", 32, 0, "secret"),
    ("endpoint", r"\b(?:https?|wss?|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?", 8, 0, "endpoint"),
)
N_BASE = 3


def _parts(text: Column, kind: int) -> Column:
    """Of each match of a kind: length of the piece before it, its own length, and whether it counts."""
    _, pattern, least, group, _ = KINDS[kind]
    p = F.lit(pattern)
    before = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.char_length(x).cast("long"))
    judged = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.char_length(x) >= least) if group else F.transform(whole, lambda n: n >= least)
    rows = F.transform(F.arrays_zip(F.slice(before, F.lit(1), F.size(whole)).alias("gap"), whole.alias("n"), judged.alias("ok")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["ok"].alias("ok")))
    return F.when(F.rlike(text, p), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,n:bigint,ok:boolean>>"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE_CHARS) -> DataFrame:
    """_row, the id, and spans: an array of (start, kind number, end) in order, for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # numbered before the parts are exploded, so the parts of a row share its number
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("_row", "_id", F.explode_outer(F.concat(*[_parts(F.col("_text"), k) for k in range(len(KINDS))])).alias("_p"))
    flat = rows.select("_row", "_id", "_p.kind", "_p.i", "_p.gap", "_p.n", "_p.ok").repartition("_row")
    end = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy("_row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    # a match that is too short loses its kind but not its row, so no document goes
    placed = flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).withColumn("kind", F.when(F.col("ok"), F.col("kind")))
    near = W.partitionBy("_row").orderBy("start").rangeBetween(-scope, scope)
    has = lambda role: F.max(F.col("kind").isin([k for k, x in enumerate(KINDS) if x[4] == role])).over(near)
    # a base span may be longer than a scope
    covered = F.max(F.when(F.col("kind") < N_BASE, F.col("end"))).over(W.partitionBy("_row").orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    p = placed.withColumn("_id_near", has("id")).withColumn("_secret_near", has("secret")).withColumn("_end_near", has("endpoint")).withColumn("_covered", covered)
    names = [x[0] for x in KINDS]
    linked = (
        F.when(F.col("kind") == names.index("weak_id"), F.col("_secret_near"))
        .when(F.col("kind") == names.index("weak_secret"), F.col("_id_near") | F.col("_end_near"))
        .otherwise(F.col("_id_near") & F.col("_secret_near"))
    )
    told = (F.col("kind") < N_BASE) | (linked & (F.coalesce(F.col("_covered"), F.lit(0)) <= F.col("start")))
    return p.groupBy("_row").agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.when(told, F.struct("start", "kind", "end")))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x[0]) for x in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_spans(documents(spark, sf_dir))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < N_BASE)
    return found.select(F.col("_id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
