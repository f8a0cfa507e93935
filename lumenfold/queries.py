"""Registered queries on the driver's tables. MEDIA is a catalog derived from documents and embeddings, in SQL that
Spark and DuckDB share; oracles are written independently of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import imaging, scalars, text, vectors
from lumenfold.operators import cache, catalog, integrity, search, telemetry, textquery
from lumenfold.sources import files, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIM, ANCHOR = 64, (1704500000, 500)

MEDIA = """
SELECT d.doc_id AS media_id, concat('content://media/', CAST(d.doc_id AS STRING)) AS uri, d.source AS display_name, d.lang AS mime_type,
  CAST(d.doc_id % 4000 AS INT) AS width, CAST(d.doc_id % 3000 AS INT) AS height, d.n_chars AS size_bytes,
  CAST(1700000000 + (d.doc_id * 7919) % 1000003 AS BIGINT) AS date_added, CAST(1700000000 + (d.doc_id * 104729) % 503 AS BIGINT) AS date_modified,
  CASE WHEN d.doc_id % 10 = 7 THEN 'failed' WHEN e.vec_id IS NULL OR d.doc_id % 10 = 3 THEN 'pending' ELSE 'indexed' END AS status,
  CASE WHEN e.vec_id IS NULL OR d.doc_id % 10 IN (3, 7) THEN CAST(-1 AS BIGINT) ELSE CAST(e.vec_id * 256 AS BIGINT) END AS vector_offset,
  CASE WHEN e.vec_id IS NULL OR d.doc_id % 10 IN (3, 7) THEN 0 ELSE 64 END AS vector_dim,
  CASE WHEN e.vec_id IS NULL OR d.doc_id % 10 IN (3, 7) THEN CAST(0 AS BIGINT) ELSE CAST(1700000000000 + e.vec_id AS BIGINT) END AS indexed_at,
  'm:v1' AS model_version, CASE WHEN d.doc_id % 10 = 7 THEN 'decode error' END AS error,
  CAST(CASE WHEN d.doc_id % 10 = 7 THEN 1 + d.doc_id % 4 ELSE 0 END AS INT) AS retry_count
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
#: A scan that misses some rows, changes some and brings new ones.
SCAN = """
SELECT doc_id AS media_id, concat('content://media/', CAST(doc_id AS STRING)) AS uri, source AS display_name, lang AS mime_type, CAST(1 AS INT) AS width, CAST(2 AS INT) AS height,
  n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size_bytes, CAST(1700000000 + (doc_id * 7919) % 1000003 AS BIGINT) AS date_added,
  CAST(1700000000 + (doc_id * 104729) % 503 AS BIGINT) AS date_modified
FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT doc_id + 100000000, 'new', source, lang, 1, 2, n_chars, 0, 1700000999 FROM documents WHERE doc_id % 17 = 0"""


def _tables(spark: SparkSession, d: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{d}/{n}.parquet").createOrReplaceTempView(n)


def media(spark: SparkSession, d: str) -> DataFrame:
    _tables(spark, d, "documents", "embeddings")
    return spark.sql(MEDIA)


def scanned(spark: SparkSession, d: str) -> DataFrame:
    _tables(spark, d, "documents")
    return spark.sql(SCAN)


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with the offset they have in the catalog; rows that aren't indexed are left out."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("media_id"), "embedding", (F.col("vec_id") * 256).alias("vector_offset"))
    return e


def probe(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(spark.read.parquet(f"{d}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("media_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("date_modified"), "user_id", "event_type", "value")


EVENTS = "SELECT event_id AS media_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS date_modified, user_id, event_type, value FROM events"


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_M, _S, _E = f"WITH m AS ({MEDIA.replace('STRING', 'VARCHAR')}) ", f"WITH m AS ({MEDIA.replace('STRING', 'VARCHAR')}), s AS ({SCAN.replace('STRING', 'VARCHAR')}) ", f"WITH e AS ({EVENTS}) "
_SCORES = "sc AS (SELECT e.vec_id AS media_id, e.vec_id * 256 AS vector_offset, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE len(e.embedding) = len(q.embedding))"
_ORDER = "ORDER BY score DESC, vector_offset, media_id"


@register(f"WITH {_SCORES}, m AS ({MEDIA.replace('STRING', 'VARCHAR')}), t AS (SELECT * FROM sc {_ORDER} LIMIT 20) SELECT media_id, uri, display_name, status, score FROM t JOIN m USING (media_id) WHERE score >= 0.2")
def vector_topk_threshold(spark, d):
    return search.search(media(spark, d), stored(spark, d), probe(spark, d), 20, 0.2).select("media_id", "uri", "display_name", "status", "score")


@register(f"WITH {_SCORES} SELECT media_id, score FROM sc {_ORDER} LIMIT 2000")
def vector_topk_nothreshold(spark, d):
    return search.top_k(stored(spark, d), probe(spark, d)).select("media_id", "score")


_MULTI = "SELECT qid, media_id, score, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS media_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10"


def _queries(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@register(_MULTI)
def vector_topk_multi(spark, d):
    return search.top_k_many(stored(spark, d), _queries(spark, d), 10)


@register(_MULTI)
def vector_topk_batch_numpy(spark, d):
    return search.top_k_many_numpy(stored(spark, d), _queries(spark, d), 10)


@register(f"WITH {_SCORES} SELECT media_id, score FROM sc {_ORDER} LIMIT 25")
def vector_partial_merge(spark, d):
    parts = search.top_k_by_group(search.scored(stored(spark, d), probe(spark, d)).withColumn("part", F.col("media_id") % 4), "part", 25)
    return search.merge_partials(parts, 25).select("media_id", "score")


@register("SELECT count(*) FILTER (len(embedding) = 64) AS compared FROM embeddings")
def vector_compared_count(spark, d):
    return search.compared(stored(spark, d), DIM)


@register("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (2 * x::DOUBLE / (2 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))) ** 2))), 6) AS norm, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS squares FROM embeddings")
def vector_normalize_norms(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    twice = F.transform("embedding", lambda x: x.cast("double") * 2)
    return e.select("vec_id", F.round(F.sqrt(vectors.sum_of_squares(vectors.l2_normalize(twice))), 6).alias("norm"), F.round(vectors.sum_of_squares(F.col("embedding")), 5).alias("squares"))


@register(f"WITH {_SCORES} SELECT media_id, score FROM sc")
def vector_score_all(spark, d):
    return search.scored(stored(spark, d), probe(spark, d)).select("media_id", "score")


@register(f"WITH {_SCORES} SELECT media_id, score FROM sc WHERE score >= 0")
def vector_filter_threshold(spark, d):
    return search.filter_by_threshold(search.scored(stored(spark, d), probe(spark, d)), 0.0).select("media_id", "score")


@register(_M + "SELECT media_id, vector_offset, vector_dim FROM m WHERE vector_offset >= 0 AND vector_dim > 0 AND vector_offset % 4 = 0 AND vector_offset <= 100000 - vector_dim * 4")
def vector_valid_metadata(spark, d):
    return integrity.loadable(media(spark, d), 100000).select("media_id", "vector_offset", "vector_dim")


@register(_M + "SELECT count(*) FILTER (vector_offset >= 0 AND vector_dim > 0 AND vector_offset % 4 = 0 AND vector_offset <= 100000 - vector_dim * 4) AS kept, count(*) FILTER (NOT (vector_offset >= 0 AND vector_dim > 0 AND vector_offset % 4 = 0 AND vector_offset <= 100000 - vector_dim * 4)) AS skipped FROM m")
def vector_skipped_metadata(spark, d):
    return integrity.skipped(media(spark, d), 100000)


@register("SELECT vec_id AS media_id, 1024 + (row_number() OVER (ORDER BY vec_id) - 1) * 256 AS vector_offset, 64 AS vector_dim FROM embeddings")
def vector_offset_assign(spark, d):
    return integrity.assign_offsets(stored(spark, d).select("media_id"), 1024, DIM)


_NEWEST = "ORDER BY date_modified DESC, media_id DESC"


@register(_M + f"SELECT media_id, date_modified, status FROM m WHERE status = 'pending' {_NEWEST} LIMIT 50")
def photos_pending(spark, d):
    return catalog.pending(media(spark, d), 50).select("media_id", "date_modified", "status")


@register(_M + f"SELECT media_id, date_modified, 'NaN'::DOUBLE AS score FROM m WHERE status = 'indexed' {_NEWEST} LIMIT 600")
def photos_recent(spark, d):
    return catalog.recent(media(spark, d), 600).select("media_id", "date_modified", "score")


@register(_M + "SELECT media_id, retry_count, error FROM m WHERE status = 'failed' ORDER BY retry_count DESC, date_modified DESC, media_id DESC LIMIT 100")
def photos_failed(spark, d):
    return catalog.failed(media(spark, d), 100).select("media_id", "retry_count", "error")


@register(_M + "SELECT media_id, retry_count FROM m WHERE status = 'failed'")
def photos_all_failed(spark, d):
    return catalog.failed(media(spark, d)).select("media_id", "retry_count")


@register(_M + "SELECT media_id, vector_offset FROM m WHERE status = 'indexed' AND vector_offset >= 0")
def photos_by_offset(spark, d):
    return catalog.by_offset(media(spark, d)).select("media_id", "vector_offset")


@register(_M + "SELECT * FROM m WHERE media_id = 42")
def photos_point_read(spark, d):
    return media(spark, d).where("media_id = 42").limit(1)


@register(_M + "SELECT m.media_id, status FROM m WHERE media_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)")
def photos_multi_get(spark, d):
    ids = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 3 = 0").select(F.col("vec_id").alias("media_id"))
    return scan.by_ids(media(spark, d), ids).select("media_id", "status")


@register(_M + "SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed FROM m")
def photos_stats(spark, d):
    return catalog.stats(media(spark, d))


@register(_M + "SELECT count(*) FILTER (status = 'indexed' AND vector_offset >= 0) AS indexed_record_count, CAST(128000 AS BIGINT) AS vector_file_length FROM m")
def photos_fingerprint(spark, d):
    return catalog.fingerprint(media(spark, d), 128000)


@register(_M + "SELECT count(*) AS n FROM m")
def photos_count(spark, d):
    return media(spark, d).agg(F.count("*").alias("n"))


@register(_M + "SELECT count(*) > 0 AS present FROM m")
def photos_exists(spark, d):
    return media(spark, d).limit(1).agg((F.count("*") > 0).alias("present"))


_BAD = "SELECT * FROM (VALUES (-1, 256, 64), (-2, 256, 64), (-3, 2, 64), (-4, 99999744, 128)) AS t(media_id, vector_offset, vector_dim)"


@register(_M + f", r AS (SELECT media_id, vector_offset, vector_dim FROM m WHERE status = 'indexed' UNION ALL {_BAD}), dup AS (SELECT count(*) AS n FROM r WHERE vector_offset >= 0 GROUP BY vector_offset HAVING count(*) > 1) SELECT count(*) FILTER (vector_offset >= 0) AS indexed_vector_count, count(*) FILTER (vector_offset < 0 OR vector_dim <= 0 OR vector_offset % 4 <> 0 OR vector_offset + vector_dim * 4 > 100000000) AS invalid_record_count, count(*) FILTER (vector_offset + vector_dim * 4 > 100000000) AS out_of_range_count, (SELECT count(*) FROM dup) AS duplicate_offset_groups, CAST((SELECT coalesce(sum(n), 0) FROM dup) AS BIGINT) AS duplicate_offset_rows, true AS is_corrupt FROM r")
def index_integrity(spark, d):
    rows = media(spark, d).select("media_id", "vector_offset", "vector_dim", "status")
    bad = spark.sql(_BAD).select(F.col("media_id").cast("long"), F.col("vector_offset").cast("long"), "vector_dim", F.lit("indexed").alias("status"))
    return integrity.audit(rows.unionByName(bad), 100000000)


@register(_E + "SELECT media_id, date_modified, event_type FROM e")
def scan_full(spark, d):
    return scan.full_scan(events(spark, d), ("date_modified",)).select("media_id", "date_modified", "event_type")


@register(_E + f"SELECT media_id, date_modified FROM e {_NEWEST} LIMIT 1")
def scan_latest(spark, d):
    return scan.latest(events(spark, d)).select("media_id", "date_modified")


@register(_E + f"SELECT media_id, date_modified FROM e WHERE date_modified > {ANCHOR[0]} OR (date_modified = {ANCHOR[0]} AND media_id > {ANCHOR[1]})")
def scan_newer_than(spark, d):
    return events(spark, d).where(scan.newer_than(*ANCHOR)).select("media_id", "date_modified")


@register(_E + "SELECT count(*) AS n FROM e")
def scan_count(spark, d):
    return events(spark, d).agg(F.count("*").alias("n"))


@register()
def sample_seeded(spark, d):
    return scan.sample(media(spark, d), 20).select("media_id", "uri")


_STATE = "media_id, uri, size_bytes, date_modified, status, vector_offset, vector_dim, indexed_at, model_version, error, retry_count"
_SYNC = f"""{_S}, j AS (SELECT s.media_id AS sid, m.media_id AS mid, s.uri AS suri, s.size_bytes AS ssize, s.date_modified AS sdm, m.*, m.media_id IS NULL OR m.date_modified <> s.date_modified OR m.size_bytes <> s.size_bytes OR m.model_version <> 'm:v1' AS chg FROM s FULL JOIN m ON s.media_id = m.media_id)
SELECT coalesce(sid, mid) AS media_id, CASE WHEN sid IS NOT NULL AND chg THEN suri ELSE uri END AS uri, CASE WHEN sid IS NOT NULL AND chg THEN ssize ELSE size_bytes END AS size_bytes, CASE WHEN sid IS NOT NULL AND chg THEN sdm ELSE date_modified END AS date_modified,
CASE WHEN sid IS NOT NULL AND chg THEN 'pending' ELSE status END AS status, CASE WHEN sid IS NOT NULL AND chg THEN -1 ELSE vector_offset END AS vector_offset, CASE WHEN sid IS NOT NULL AND chg THEN 0 ELSE vector_dim END AS vector_dim, CASE WHEN sid IS NOT NULL AND chg THEN 0 ELSE indexed_at END AS indexed_at,
'm:v1' AS model_version, CASE WHEN sid IS NOT NULL AND chg THEN NULL ELSE error END AS error, CASE WHEN sid IS NOT NULL AND chg THEN 0 ELSE retry_count END AS retry_count FROM j"""


@register(_SYNC + " WHERE sid IS NOT NULL")
def sync_full(spark, d):
    return catalog.sync_full(scanned(spark, d), media(spark, d), "m:v1").select(*_STATE.split(", "))


@register(_SYNC)
def sync_upsert(spark, d):
    return catalog.upsert(scanned(spark, d), media(spark, d), "m:v1").select(*_STATE.split(", "))


@register(_S + "SELECT count(*) AS n FROM m WHERE media_id NOT IN (SELECT media_id FROM s)")
def sync_deleted_count(spark, d):
    return catalog.deleted_by_sync(scanned(spark, d), media(spark, d)).agg(F.count("*").alias("n"))


@register(_S + "SELECT s.media_id FROM s LEFT JOIN m USING (media_id) WHERE m.media_id IS NULL OR m.date_modified <> s.date_modified OR m.size_bytes <> s.size_bytes")
def sync_upsert_changed(spark, d):
    return catalog.changed_rows(scanned(spark, d), media(spark, d), "m:v1")


@register(_M + "SELECT media_id, CASE WHEN status = 'pending' THEN 'indexed' ELSE status END AS status, CASE WHEN status = 'pending' THEN media_id * 256 ELSE vector_offset END AS vector_offset, CASE WHEN status = 'pending' THEN 64 ELSE vector_dim END AS vector_dim, CASE WHEN status = 'pending' THEN 1800000000000 ELSE indexed_at END AS indexed_at, CASE WHEN status = 'pending' THEN 'm:v2' ELSE model_version END AS model_version, error, retry_count FROM m")
def mark_indexed(spark, d):
    m = media(spark, d)
    items = m.where("status = 'pending'").select("media_id", (F.col("media_id") * 256).alias("vector_offset"), F.lit(64).alias("vector_dim"))
    return catalog.mark_indexed(m, items, "m:v2", 1800000000000).select("media_id", "status", "vector_offset", "vector_dim", "indexed_at", "model_version", "error", "retry_count")


@register(_M + "SELECT media_id, CASE WHEN media_id % 5 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN media_id % 5 = 0 THEN repeat('x', 400) ELSE error END AS error, CAST(CASE WHEN media_id % 5 = 0 THEN retry_count + 1 ELSE retry_count END AS INT) AS retry_count FROM m")
def mark_failed(spark, d):
    m = media(spark, d)
    return catalog.mark_failed(m, m.where("media_id % 5 = 0").select("media_id", F.repeat(F.lit("x"), F.lit(500)).alias("message"))).select("media_id", "status", "error", "retry_count")


@register(_M + "SELECT media_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'failed' THEN error END AS error, retry_count FROM m")
def reset_failed(spark, d):
    return catalog.reset_failed(media(spark, d)).select("media_id", "status", "error", "retry_count")


@register(_M + "SELECT media_id, CASE WHEN status = 'failed' AND media_id = 17 THEN 'pending' ELSE status END AS status FROM m")
def reset_failed_one(spark, d):
    return catalog.reset_failed(media(spark, d), 17).select("media_id", "status")


@register(_M + "SELECT media_id, uri FROM m WHERE false")
def clear_index(spark, d):
    return catalog.cleared(media(spark, d)).select("media_id", "uri")


@register(_M + f", b AS (SELECT media_id, date_modified FROM m WHERE status = 'pending' AND media_id % 2 = 1 {_NEWEST} LIMIT 24) SELECT media_id, CAST(floor((row_number() OVER ({_NEWEST}) - 1) / 8) AS BIGINT) AS batch_id FROM b")
def pending_batch_exclude(spark, d):
    m = media(spark, d)
    return catalog.batches(catalog.next_batch(m, m.where("media_id % 2 = 0"), 24), 8).select("media_id", "batch_id")


@register(f"WITH {_SCORES} SELECT media_id, score FROM sc {_ORDER} LIMIT 60 OFFSET 60")
def page_slice(spark, d):
    return search.page(search.top_k(stored(spark, d), probe(spark, d)), 1).select("media_id", "score")


@register(f"WITH {_SCORES} SELECT media_id, score FROM sc {_ORDER} LIMIT 180")
def page_cumulative(spark, d):
    return search.pages_up_to(search.top_k(stored(spark, d), probe(spark, d)), 2).select("media_id", "score")


@register(f"WITH {_SCORES}, t AS (SELECT * FROM sc {_ORDER} LIMIT 2000) SELECT media_id, CAST(floor((row_number() OVER ({_ORDER}) - 1) / 60) AS BIGINT) AS page FROM t")
def page_number(spark, d):
    return search.with_page(search.top_k(stored(spark, d), probe(spark, d))).select("media_id", "page")


_CACHE = "SELECT text AS query_text, 'm:v1' AS model_key, CAST(1000 + item_id AS BIGINT) AS created_at FROM benchmark UNION ALL SELECT text, 'm:v2', CAST(2000 + conv_id * 10 + turn AS BIGINT) FROM conversations"


def _entries(spark, d):
    _tables(spark, d, "benchmark", "conversations")
    return spark.sql(_CACHE)


_LAST = f"WITH c AS ({_CACHE}), k AS (SELECT query_text, model_key, max(created_at) AS created_at FROM c GROUP BY ALL)"


@register(_LAST + " SELECT * FROM k ORDER BY created_at DESC, query_text LIMIT 100")
def cache_evict(spark, d):
    e = _entries(spark, d)
    return cache.put(e.where("model_key = 'm:v1'"), e.where("model_key = 'm:v2'"))


@register(_LAST + " SELECT query_text, created_at FROM k WHERE model_key = 'm:v1' ORDER BY created_at DESC, query_text LIMIT 100")
def cache_load(spark, d):
    e = catalog.last_of_each(_entries(spark, d), ["query_text", "model_key"], "created_at")
    return cache.load(e.withColumn("embedding", vectors.to_blob(F.array(F.lit(1.0).cast("float")))), "m:v1").select("query_text", "created_at")


def _batches(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("event_id") % 7).alias("run_id"), F.floor(F.col("event_id") / 56).cast("long").alias("batch_id"))
    n = e.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("n_ok"), F.count_if(F.col("event_type") == "error").alias("n_failed"))
    return n.withColumn("started_ms", 1000 + F.col("batch_id") * 700).withColumn("completed_ms", F.col("started_ms") + 500 + F.col("run_id")).withColumn("infer_ms", F.when(F.col("batch_id") % 3 == 0, 0).otherwise(F.col("n") * 5))


_BATCHES = "WITH b AS (SELECT event_id % 7 AS run_id, CAST(floor(event_id / 56) AS BIGINT) AS batch_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY ALL), t AS (SELECT *, 1000 + batch_id * 700 AS started_ms, 1500 + batch_id * 700 + run_id AS completed_ms, CASE WHEN batch_id % 3 = 0 THEN 0 ELSE n * 5 END AS infer_ms FROM b), w AS (SELECT *, completed_ms - coalesce(lag(completed_ms) OVER (PARTITION BY run_id ORDER BY completed_ms, batch_id), started_ms) AS wall_ms FROM t) "


@register(_BATCHES + "SELECT run_id, batch_id, wall_ms, CASE WHEN wall_ms > 0 THEN n * 1000.0::DOUBLE / wall_ms END AS e2e_ips, CASE WHEN infer_ms > 0 THEN n * 1000.0::DOUBLE / infer_ms END AS infer_ips FROM w")
def telemetry_wall(spark, d):
    return telemetry.throughput(telemetry.wall_times(_batches(spark, d))).select("run_id", "batch_id", "wall_ms", "e2e_ips", "infer_ips")


@register(_BATCHES + "SELECT run_id, batch_id, CAST(10 + sum(n_ok) OVER u AS BIGINT) AS indexed, CAST(greatest(500 - sum(n_ok + n_failed) OVER u, 0) AS BIGINT) AS pending, CAST(3 + sum(n_failed) OVER u AS BIGINT) AS failed FROM t WINDOW u AS (PARTITION BY run_id ORDER BY completed_ms, batch_id)")
def telemetry_running(spark, d):
    return telemetry.running(_batches(spark, d), 10, 500, 3).select("run_id", "batch_id", "indexed", F.col("pending").cast("long").alias("pending"), "failed")


@register(_BATCHES + "SELECT run_id, batch_id, infer_ms::DOUBLE / greatest(n, 1) AS infer_per_image, greatest(0, wall_ms - infer_ms)::DOUBLE AS other_ms, format('{:.3f}', wall_ms::DOUBLE) AS shown FROM w")
def telemetry_per_image(spark, d):
    w = telemetry.wall_times(_batches(spark, d))
    return w.select("run_id", "batch_id", telemetry.per_image(F.col("infer_ms").cast("double"), F.col("n")).alias("infer_per_image"), telemetry.other_time(F.col("wall_ms").cast("double"), F.col("infer_ms").cast("double")).alias("other_ms"), scalars.shown(F.col("wall_ms").cast("double"), "%.3f").alias("shown"))


@register(r"SELECT doc_id, regexp_extract_all(lower(text), '<\|startoftext\|>|<\|endoftext\|>|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+') AS pieces FROM documents")
def pretokenize(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.pretokenize(F.col("text")).alias("pieces"))


TOY = text.Bpe({"<|startoftext|>": 10, "<|endoftext|>": 11, "l": 0, "o": 1, "w": 2, "w</w>": 3, "lo": 4, "low</w>": 5, "e": 6, "r</w>": 7, "!</w>": 8, "low": 9}, {("l", "o"): 0, ("lo", "w</w>"): 1, ("lo", "w"): 2}, max_length=10)


@register()
def bpe_encode_texts(spark, d):
    """table, id, turn, ids: all texts of benchmark, conversations and documents, by the vocabulary of 49,408 entries."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        bpe = files.bpe_from_json(f.read())
    _tables(spark, d, "benchmark", "conversations", "documents")
    texts = spark.sql("SELECT 'benchmark' AS table, item_id AS id, CAST(NULL AS INT) AS turn, text FROM benchmark UNION ALL SELECT 'conversations', conv_id, CAST(turn AS INT), text FROM conversations UNION ALL SELECT 'documents', doc_id, NULL, text FROM documents")
    return texts.select("table", "id", "turn", text.bpe_encode(F.col("text"), bpe).alias("ids"))


_MEAN, _STD = (0.48, 0.45, 0.40), (0.25, 0.5, 0.125)


def _tensor(spark, d, layout):
    """Of each document an image of two by three pixels, made of its id."""
    ids = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("doc_id") * 7919 + i * 104729 + 40503) % (1 << 24)).cast("int"))
    rows = ids.select("doc_id", imaging.tensor(pixels, F.array(*map(F.lit, _MEAN)), F.array(*map(F.lit, _STD)), layout).alias("t"))
    return rows.select("doc_id", F.transform("t", lambda x: F.round(x, 6)).alias("tensor"), imaging.tensor_shape(layout, F.lit(1), F.lit(3), F.lit(3), F.lit(2)).alias("shape"))


_PLANES = "WITH p AS (SELECT doc_id, list_transform(range(0, 6), lambda i: (doc_id * 7919 + i * 104729 + 40503) % 16777216) AS px FROM documents), c AS (SELECT doc_id, " + ", ".join(f"list_transform(px, lambda v: round((((v >> {shift}) & 255)::DOUBLE / 255.0::DOUBLE - {m}::DOUBLE) / {sd}::DOUBLE, 6)) AS {n}" for n, shift, m, sd in zip("rgb", (16, 8, 0), _MEAN, _STD)) + " FROM p) "


@register(_PLANES + "SELECT doc_id, list_concat(list_concat(r, g), b) AS tensor, [1, 3, 3, 2]::BIGINT[] AS shape FROM c")
def tensor_nchw(spark, d):
    return _tensor(spark, d, "NCHW")


@register(_PLANES + "SELECT doc_id, flatten(list_transform(range(1, 7), lambda i: [r[i], g[i], b[i]])) AS tensor, [1, 3, 2, 3]::BIGINT[] AS shape FROM c")
def tensor_nhwc(spark, d):
    return _tensor(spark, d, "NHWC")


@register("SELECT vec_id, embedding, 256 AS bytes FROM embeddings")
def blob_roundtrip(spark, d):
    b = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", vectors.to_blob(F.col("embedding")).alias("blob"))
    return b.select("vec_id", vectors.from_blob(F.col("blob")).alias("embedding"), F.length("blob").alias("bytes"))


@register(_M + "SELECT media_id, retry_count, 'reindex' AS action FROM m WHERE status = 'failed'")
def retry_selection(spark, d):
    return catalog.failed(media(spark, d)).select("media_id", "retry_count", F.lit("reindex").alias("action"))


@register("SELECT event_id, CASE WHEN event_type IN ('pending', 'indexed', 'failed') THEN event_type ELSE 'pending' END AS status FROM events")
def status_default(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.status_or_pending(F.col("event_type")).alias("status"))


@register(_M + "SELECT media_id, 'photo-thumbnail:' || media_id || ':' || date_modified || ':' || size_bytes || ':256' AS thumbnail, 'content://x/' || media_id AS uri2, 'm:v1:t.onnx:512' AS text_key FROM m")
def keys_compose(spark, d):
    return media(spark, d).select("media_id", scalars.thumbnail_key(F.col("media_id"), F.col("date_modified"), F.col("size_bytes")).alias("thumbnail"), scalars.content_uri("content://x", F.col("media_id")).alias("uri2"), scalars.text_cache_key(F.lit("m"), F.lit("v1"), F.lit("t.onnx"), F.lit(512)).alias("text_key"))


@register("SELECT doc_id, substring(text, 1, 400) AS error, substring(text, 1, 120) AS message FROM documents")
def error_truncate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.clipped(F.col("text")).alias("error"), scalars.clipped(F.col("text"), 120).alias("message"))


@register(_M + "SELECT media_id, CAST(floor(vector_offset / 4.0) AS BIGINT) AS float_index, lower(to_hex(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(uri, ''), lambda c: ord(c)::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296))) AS media_key FROM m")
def media_keys(spark, d):
    return media(spark, d).select("media_id", vectors.float_index(F.col("vector_offset")).alias("float_index"), scalars.string_hash_hex(F.col("uri")).alias("media_key"))


_RETRY = "CAST(10 + sum(n_ok) OVER u AS BIGINT) AS indexed, CAST(500 AS BIGINT) AS pending, CAST(300 - sum(n_ok) OVER u AS BIGINT) AS failed"


@register(_BATCHES + f"SELECT run_id, batch_id, {_RETRY} FROM t WINDOW u AS (PARTITION BY run_id ORDER BY completed_ms, batch_id)")
def telemetry_retry(spark, d):
    return telemetry.running(_batches(spark, d), 10, 500, 300, retry=True).select("run_id", "batch_id", "indexed", F.col("pending").cast("long").alias("pending"), "failed")


_IMAGES = "SELECT CAST(floor(event_id / 8) AS BIGINT) AS batch_id, event_id AS place, 'k' || event_id AS media_key, user_id % 10 AS decode_ms, event_id % 5 AS tensor_ms FROM events"


@register(f"WITH i AS ({_IMAGES}) SELECT batch_id, CAST(sum(decode_ms) AS BIGINT) AS decode_ms, CAST(sum(tensor_ms) AS BIGINT) AS tensor_ms, string_agg(media_key, '+' ORDER BY place) AS media_keys, CAST(sum(decode_ms) + sum(tensor_ms) AS BIGINT) AS work_ms FROM i GROUP BY batch_id")
def telemetry_batch_timings(spark, d):
    _tables(spark, d, "events")
    return telemetry.batch_timings(spark.sql(_IMAGES)).withColumn("work_ms", telemetry.work_ms(F.col("decode_ms"), F.col("tensor_ms")))


_LOG_NULL = ", ".join(f"'' AS {c}" for c in ("prep_ms", "decode_ms", "tensor_ms", "write_ms"))


@register(_BATCHES + f"SELECT CAST(completed_ms AS VARCHAR) AS timestamp_ms, CAST(n_ok AS VARCHAR) AS indexed, '0' AS pending, CAST(n_failed AS VARCHAR) AS failed, CAST(n AS VARCHAR) AS batch_size, CASE WHEN wall_ms > 0 THEN format('{{:.3f}}', n * 1000.0::DOUBLE / wall_ms) ELSE '' END AS e2e_ips, CASE WHEN infer_ms > 0 THEN format('{{:.3f}}', n * 1000.0::DOUBLE / infer_ms) ELSE '' END AS infer_ips, format('{{:.3f}}', (completed_ms - started_ms)::DOUBLE) AS batch_ms, format('{{:.3f}}', (completed_ms - started_ms)::DOUBLE) AS work_ms, format('{{:.3f}}', wall_ms::DOUBLE) AS wall_ms, format('{{:.3f}}', infer_ms::DOUBLE) AS infer_ms, {_LOG_NULL}, 'cpu' AS backend, 'run ' || run_id AS status FROM w")
def telemetry_log_lines(spark, d):
    b = telemetry.throughput(telemetry.wall_times(_batches(spark, d))).withColumns({"timestamp_ms": F.col("completed_ms"), "indexed": F.col("n_ok"), "pending": F.lit(0), "failed": F.col("n_failed"), "batch_size": F.col("n"), "batch_ms": F.col("completed_ms") - F.col("started_ms"), "work_ms": F.col("completed_ms") - F.col("started_ms"), "backend": F.lit("cpu"), "status": F.concat(F.lit("run "), F.col("run_id").cast("string"))})
    return telemetry.log_lines(b.withColumns({c: F.lit(None).cast("double") for c in ("prep_ms", "decode_ms", "tensor_ms", "write_ms")}))


#: A scan that names rows up to three times, in any order.
_TWICE = f"{SCAN.replace('UNION ALL', ' UNION ALL SELECT doc_id, concat(' + chr(39) + 'again' + chr(39) + ', CAST(doc_id AS STRING)), source, lang, 1, 2, n_chars, 0, CAST(1700000000 + (doc_id * 31) % 997 AS BIGINT) FROM documents WHERE doc_id % 5 = 0 UNION ALL', 1)}"
_LAST = "l AS (SELECT media_id, max(struct_pack(a := date_modified, b := uri)) AS last FROM s GROUP BY media_id)"


@register(f"WITH m AS ({MEDIA.replace('STRING', 'VARCHAR')}), s AS ({_TWICE.replace('STRING', 'VARCHAR')}), {_LAST} SELECT coalesce(l.media_id, m.media_id) AS media_id, count(*) AS n_rows, max(CASE WHEN l.media_id IS NULL THEN m.date_modified ELSE l.last.a END) AS date_modified FROM l FULL JOIN m ON l.media_id = m.media_id GROUP BY ALL")
def sync_repeated_scan(spark, d):
    _tables(spark, d, "documents")
    out = catalog.upsert(spark.sql(_TWICE), media(spark, d), "m:v1")
    return out.groupBy("media_id").agg(F.count("*").alias("n_rows"), F.max("date_modified").alias("date_modified"))


@register(_M + "SELECT media_id, status, indexed_at, CASE WHEN status = 'indexed' THEN 'NaN'::DOUBLE END AS score FROM (SELECT * FROM m WHERE status = 'indexed' ORDER BY date_modified DESC, media_id DESC LIMIT 600)")
def text_blank_recent(spark, d):
    return textquery.search_text(media(spark, d), stored(spark, d), textquery.TextSession(), " \t\n").select("media_id", "status", "indexed_at", "score")
