"""Registered queries that go through stored state: vector files, the versioned store, packed blocks, model folders.

Each builds its state from the given tables in a new folder of the work directory, reads it back, and is held against SQL
over those tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import text
from lumenfold.operators import blocks, models, search
from lumenfold.plans import jobs
from lumenfold.plans.store import Store
from lumenfold.queries import _MULTI, DIM, MEDIA, SCAN, TOY, _queries, _SCORES, media, probe, register, scanned, stored
from lumenfold.schemas import SCAN_COLUMNS
from lumenfold.sources import files, vectorfile
from lumenfold.sources.files import work_path

_MEDIA, _SCAN = MEDIA.replace("STRING", "VARCHAR"), SCAN.replace("STRING", "VARCHAR")


class Given:
    """An embedder for images that are vectors already."""

    def __init__(self, dim: int):
        self.dim, self.key = dim, f"given:{dim}"

    def open(self) -> None:
        return None

    def embed(self, session, tensors: np.ndarray) -> np.ndarray:
        return tensors


class Counted:
    """A text model whose vector counts token ids by their remainder; for dry runs."""

    def __init__(self, dim: int):
        self.dim = dim

    def open(self) -> None:
        return None

    def embed(self, session, ids: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(x % self.dim, minlength=self.dim) for x in ids]).astype(np.float64)


@register("SELECT vec_id AS media_id, (row_number() OVER (ORDER BY vec_id) - 1) * 256 AS vector_offset, 64 AS vector_dim, embedding FROM embeddings")
def vector_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All vectors, appended to a vector file in order of their ids and read by ranges; offsets are those of the commit."""
    path = work_path(spark, "vector-file")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("media_id"), "embedding")
    vectorfile.append(e.repartitionByRange("media_id").sortWithinPartitions("media_id"), path, DIM)
    rows = vectorfile.source(spark).option("rows", 4096).load(path)
    return rows.select("media_id", "vector_offset", F.size("embedding").alias("vector_dim"), "embedding")


@register(f"WITH {_SCORES}, m AS ({_MEDIA}), t AS (SELECT sc.* FROM sc SEMI JOIN m ON sc.media_id = m.media_id ORDER BY score DESC, media_id LIMIT 200) SELECT media_id, uri, 'indexed' AS status, score FROM t JOIN m USING (media_id) WHERE score >= 0.1")
def index_then_search(spark: SparkSession, d: str) -> DataFrame:
    """From a scan of all documents through indexing and two commits to the search of the stored index."""
    store = Store(spark, work_path(spark, "index"))
    jobs.run_scan(store, media(spark, d), "m:v1")
    tensors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("media_id"), F.col("embedding").alias("tensor"))
    jobs.index_pending(store, tensors, Given(DIM), "m:v1", 1, batch=512, normalize=False)
    s = store.snapshot()
    ordered = s.vectors().withColumn("vector_offset", F.col("media_id"))  # ties by id: offsets hang on partitions
    return search.search(s.catalog(), ordered, probe(spark, d), 200, 0.1).select("media_id", "uri", "status", "score")


@register(f"WITH s AS ({_SCAN}), m AS ({_MEDIA}), j AS (SELECT coalesce(s.media_id, m.media_id) AS media_id, s.media_id IS NOT NULL AS seen, s.size_bytes AS sz, s.date_modified AS dm, m.*, m.media_id IS NULL OR m.date_modified <> s.date_modified OR m.size_bytes <> s.size_bytes AS chg FROM s FULL JOIN m ON s.media_id = m.media_id) SELECT media_id, CASE WHEN seen AND chg THEN sz ELSE size_bytes END AS size_bytes, CASE WHEN seen AND chg THEN dm ELSE date_modified END AS date_modified, 'pending' AS status FROM j")
def store_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Two upserts into a bucketed store, the second of a scan that misses rows, changes some and brings new ones."""
    store = Store(spark, work_path(spark, "store"), rows_per_bucket=20_000)
    store.upsert(media(spark, d).select(*SCAN_COLUMNS), "m:v1")
    store.upsert(scanned(spark, d), "m:v1")
    return store.catalog().select("media_id", "size_bytes", "date_modified", "status")


@register(_MULTI)
def vector_topk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of every twentieth vector, by packed blocks."""
    found, _ = blocks.search_blocks(blocks.pack(stored(spark, d)), _queries(spark, d), 10)
    return found.select("qid", "media_id", "score", "rank")


# every piece's letters as tokens of their own, between blanks; merges by rank, then ids by place in the list
_TOKENS = "regexp_extract_all(lower(text), '<\\|startoftext\\|>|<\\|endoftext\\|>|\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]+')"
_MERGED = f"list_transform({_TOKENS}, lambda p: replace(replace(replace(' ' || array_to_string(string_split(p, ''), '  ') || '</w> ', ' l  o ', ' lo '), ' lo  w</w> ', ' low</w> '), ' lo  w ', ' low '))"
_BODY = f"list_filter(list_transform(flatten(list_transform({_MERGED}, lambda s: string_split_regex(trim(s), ' +'))), lambda t: list_position(['l', 'o', 'w', 'w</w>', 'lo', 'low</w>', 'e', 'r</w>', '!</w>', 'low'], t) - 1), lambda i: i >= 0)"
_IDS = f"list_resize(list_concat(list_concat([10], list_slice({_BODY}, 1, 8)), [11]), 10, 0)::BIGINT[]"


@register(f"SELECT 'benchmark' AS origin, item_id AS id, CAST(NULL AS INT) AS turn, {_IDS} AS ids FROM benchmark UNION ALL SELECT 'conversations', conv_id, CAST(turn AS INT), {_IDS} FROM conversations UNION ALL SELECT 'documents', doc_id, NULL, {_IDS} FROM documents")
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    """All texts of three tables by a vocabulary of three merges, framed, cut and padded to ten ids."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    none = F.lit(None).cast("int")
    rows = read("benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), none.alias("turn"), "text")
    rows = rows.unionAll(read("conversations").select(F.lit("conversations"), "conv_id", F.col("turn").cast("int"), "text")).unionAll(read("documents").select(F.lit("documents"), "doc_id", none, "text"))
    return rows.select("origin", "id", "turn", text.bpe_encode(F.col("text"), TOY).alias("ids"))


@register(f"WITH t AS (SELECT conv_id, CAST(turn AS INT) AS turn, {_IDS} AS ids FROM conversations WHERE trim(text) <> '') SELECT conv_id, turn, [CAST(len(list_filter(ids, lambda i: i % 4 = j)) AS FLOAT) for j in [0, 1, 2, 3]] AS q FROM t")
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all conversation texts through the persisted query cache; each distinct text is embedded once."""
    store = Store(spark, work_path(spark, "text-vectors"))
    texts = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn").cast("int").alias("turn"), F.col("text").alias("query_text"))
    return jobs.embed_queries(store, texts, "m:v1", Counted(4), TOY, 1, normalize=False).where("q is not null").select("conv_id", "turn", "q")


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    """directory, n, and the text of a model.json for each source of documents; some can't be parsed, some lack a field."""
    n = spark.read.parquet(f"{d}/documents.parquet").where("source is not null").groupBy(F.col("source").alias("directory")).agg(F.count("*").alias("n"))
    name = F.col("directory")
    encoder = F.struct(F.concat(name, F.lit(".onnx")).alias("fileName"), F.lit("pixels").alias("inputName"), F.lit("vector").alias("outputName"), F.lit(256).alias("inputWidth"), F.lit(256).alias("inputHeight"))
    words = F.struct(F.concat(name, F.lit("-text.onnx")).alias("fileName"), F.lit("ids").alias("inputIdsName"), F.lit("vector").alias("outputName"), F.struct(F.lit("bpe").alias("type"), F.lit("tokenizer.json").alias("tokenizerFileName")).alias("tokenizer"))
    config = F.struct(name.alias("id"), name.alias("displayName"), F.when(F.col("n") % 5 != 1, F.lit("f")).alias("family"), F.lit("v1").alias("version"), (64 * (1 + F.col("n") % 3)).cast("int").alias("embeddingDim"), encoder.alias("imageEncoder"), F.when(F.col("n") % 2 == 0, words).alias("textEncoder"))
    return n.withColumn("value", F.when(F.col("n") % 7 == 0, F.lit("{ not json")).otherwise(F.to_json(config)))


@register("""
WITH n AS (SELECT source AS id, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT id, n, CASE WHEN n % 7 = 0 THEN 'malformed JSON' WHEN n % 5 = 1 THEN 'missing: family' END AS parse_error FROM n),
m AS (SELECT coalesce(f.id, t.id) AS id, f.parse_error, f.id IS NOT NULL AND f.parse_error IS NULL AS found,
  CASE WHEN n % 7 = 0 OR n IS NULL THEN coalesce(t.dim, 512) ELSE CAST(64 * (1 + n % 3) AS INT) END AS embedding_dim,
  f.id IS NOT NULL AND n % 4 <> 3 AS image_there, (n % 7 <> 0 AND n % 2 = 0) OR t.id IS NOT NULL AS has_text, n % 3 <> 0 AS text_there
  FROM f FULL JOIN (VALUES ('mobileclip2-s0', 512), ('src1', 256)) t(id, dim) ON f.id = t.id),
a AS (SELECT *, found AND image_there AS available, found AND image_there AND has_text AND text_there AS text_available FROM m)
SELECT id, embedding_dim, parse_error, available, text_available, CAST(row_number() OVER (ORDER BY available DESC, id) AS INT) AS place FROM a""")
def model_registry(spark: SparkSession, d: str) -> DataFrame:
    """Model folders, one for each source, written and scanned; merged with two templates, checked for their files, ranked."""
    rows, root = _model_rows(spark, d), work_path(spark, "models")
    rows.select("directory", "value").repartition("directory").write.partitionBy("directory").text(root)
    found = files.model_configs(spark, root, "part-*").withColumn("directory", F.regexp_replace("directory", "^directory=", ""))
    c = F.col("config")
    found = found.select(F.coalesce(c["id"], "directory").alias("id"), c["embeddingDim"].alias("embedding_dim"), c["textEncoder"]["fileName"].alias("text_encoder"), c["imageEncoder"]["fileName"].alias("image_file"), "found", "parse_error")
    templates = spark.createDataFrame([("mobileclip2-s0", 512, "t.onnx", "i.onnx"), ("src1", 256, "src1-text.onnx", "src1.onnx")], "id string, embedding_dim int, text_encoder string, image_file string")
    merged = models.with_fallback(models.merge_registry(templates, found))
    image, txt = models.required_files(F.col("image_file"), F.col("text_encoder"), F.lit("tokenizer.json"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    there = rows.select(F.col("directory").alias("id"), F.array_compact(F.array(F.when(F.col("n") % 4 != 3, F.concat("directory", F.lit(".onnx"))), F.when(F.col("n") % 3 != 0, F.concat("directory", F.lit("-text.onnx"))), F.lit("tokenizer.json"))).alias("present"))
    told = merged.withColumns({"image_files": image, "text_files": txt}).join(there, "id", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    ready = models.availability(told, F.col("present"))
    place = F.row_number().over(W.orderBy(F.desc("available"), "id"))
    return ready.select("id", "embedding_dim", "parse_error", "available", "text_available", place.alias("place"))


_BACKENDS = "SELECT CAST(floor(doc_id / 50) AS BIGINT) AS device, lang AS id, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL GROUP BY ALL"


@register(f"""
WITH b AS (SELECT device, CASE WHEN id = 'en' THEN 'cpu' WHEN id = 'de' THEN 'ort_nnapi' WHEN id = 'es' THEN 'nnapi_b' WHEN device % 3 = 0 THEN 'qnn_htp' ELSE 'cpu_b' END AS id, n FROM ({_BACKENDS}) WHERE id IN ('en', 'de', 'es', 'fr')),
x AS (SELECT *, id <> 'cpu' AND id <> 'cpu_b' AS accelerated, n % 3 <> 0 AS available, [CAST(n % 2 AS INT), CAST(1 + n % 5 AS INT)] AS preferred FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY accelerated DESC, id = 'qnn_htp' DESC, contains(id, 'nnapi') DESC, id) AS k FROM x WHERE available),
d AS (SELECT device, bool_or(starts_with(id, 'qnn')) AS qnn FROM x GROUP BY device)
SELECT d.device, CASE WHEN r.accelerated OR NOT qnn THEN r.id END AS id, CASE WHEN r.accelerated OR NOT qnn THEN CASE WHEN preferred[1] > 0 THEN preferred[1] ELSE preferred[2] END END AS batch,
  CASE WHEN qnn AND NOT coalesce(r.accelerated, false) THEN 'the accelerated backend is unavailable' WHEN r.id IS NULL THEN 'no backend is available' END AS error
FROM d LEFT JOIN r ON r.device = d.device AND k = 1""")
def backend_choice(spark: SparkSession, d: str) -> DataFrame:
    """The backend of each device, from those it lists: every fifty documents are a device, their languages its backends."""
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("documents")
    b = spark.sql(_BACKENDS).where(F.col("id").isin("en", "de", "es", "fr"))
    name = F.when(F.col("id") == "en", "cpu").when(F.col("id") == "de", "ort_nnapi").when(F.col("id") == "es", "nnapi_b").when(F.col("device") % 3 == 0, "qnn_htp").otherwise("cpu_b")
    listed = b.select("device", name.alias("id"), (~name.isin("cpu", "cpu_b")).alias("accelerated"), (F.col("n") % 3 != 0).alias("available"), F.array((F.col("n") % 2).cast("int"), (1 + F.col("n") % 5).cast("int")).alias("preferred_batch"))
    place = F.row_number().over(W.partitionBy("device").orderBy("id"))
    return models.choose_backends(listed.withColumn("place", place), "device")
