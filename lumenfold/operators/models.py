"""Model registry and backend choice over small tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MODEL, DEFAULT_BATCH, FALLBACK_DIM, FALLBACK_PIXELS = "mobileclip2-s0", 8, 512, 224


# fixed values: the backends of each build flavour, in order
BACKENDS = [("qnn", 0, "ort_qnn_pkg_cpu_auto_threads", "ORT CPU (QNN pkg)"), ("qnn", 1, "qnn_htp", "QNN HTP"), ("default", 0, "ort_cpu_auto_threads", "ORT CPU"), ("default", 1, "ort_nnapi_cpu_disabled", "ORT NNAPI")]


def backend_list(spark: SparkSession, flavour: str) -> DataFrame:
    """place, id, display_name of a flavour's backends; an unknown flavour has those of the default one."""
    known = flavour if any(b[0] == flavour for b in BACKENDS) else "default"
    return spark.createDataFrame([b[1:] for b in BACKENDS if b[0] == known], "place int, id string, display_name string").orderBy("place")


class NoBackend(RuntimeError):
    pass


def with_defaults(config: Column) -> Column:
    """Optional values of a parsed configuration; an attention mask name stays null when it is given as null."""
    image, text = config["imageEncoder"], config["textEncoder"]
    d = lambda c, v: F.coalesce(c, F.lit(v))
    floats = lambda c, v: F.coalesce(c, F.array(*[F.lit(x) for x in v]).cast("array<float>"))
    tok = text["tokenizer"]
    tokenizer = tok.withField("maxLength", d(tok["maxLength"], 77)).withField("bosToken", d(tok["bosToken"], "<|startoftext|>")).withField("eosToken", d(tok["eosToken"], "<|endoftext|>")).withField("padTokenId", d(tok["padTokenId"], 0))
    image = image.withField("channels", d(image["channels"], 3)).withField("layout", d(image["layout"], "NCHW")).withField("outputL2Normalize", d(image["outputL2Normalize"], True))
    image = image.withField("mean", floats(image["mean"], (0.48145466, 0.4578275, 0.40821073))).withField("std", floats(image["std"], (0.26862954, 0.26130258, 0.27577711)))
    text = F.when(text.isNotNull(), text.withField("inputDataType", d(text["inputDataType"], "INT64")).withField("outputL2Normalize", d(text["outputL2Normalize"], True)).withField("tokenizer", tokenizer))
    return config.withField("imageEncoder", image).withField("textEncoder", text)


def merge_registry(templates: DataFrame, discovered: DataFrame) -> DataFrame:
    """Templates and found configurations by id; a found one wins and borrows a missing text encoder."""
    t, f = templates.alias("t"), discovered.alias("f")
    j = t.join(f, F.col("t.id") == F.col("f.id"), "full")
    pick = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"t.{c}")).alias(c)
    return j.select(pick("id"), pick("embedding_dim"), pick("text_encoder"), pick("image_file"), F.coalesce(F.col("f.found"), F.lit(False)).alias("found"), F.col("f.parse_error").alias("parse_error"))


def with_fallback(merged: DataFrame) -> DataFrame:
    """An entry whose configuration couldn't be parsed keeps its template's values, or else takes the fallback ones; it
    stays in the list with its parse_error, and isn't available."""
    broken = F.col("parse_error").isNotNull()
    dim = F.when(broken, F.coalesce("embedding_dim", F.lit(FALLBACK_DIM))).otherwise(F.col("embedding_dim"))
    pixels = F.when(broken & F.col("image_file").isNull(), F.lit(FALLBACK_PIXELS))
    return merged.withColumns({"embedding_dim": dim, "image_pixels": pixels, "found": F.col("found") & ~broken})


def write_templates(spark: SparkSession, templates: dict[str, dict], root: str) -> list[str]:
    """Writes each template's model.json into a folder of its name where there is none yet; the names written."""
    path, conf, done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name, config in templates.items():
        to = path(f"{root.rstrip('/')}/{name}/model.json")
        fs = to.getFileSystem(conf)
        if not fs.exists(to):
            out = fs.create(to, False)
            out.write(bytearray(json.dumps(config, indent=2).encode()))
            out.close()
            done.append(name)
    return done


def required_files(image_file: Column, text_file: Column, tokenizer_file: Column, vocab: Column, merges: Column) -> tuple[Column, Column]:
    """Files that images and texts need: a text needs its encoder and one tokenizer file or vocabulary and merges."""
    tokenizer = F.when(tokenizer_file.isNotNull(), F.array(tokenizer_file)).otherwise(F.array(vocab, merges))
    return F.array_compact(F.array(image_file)), F.array_distinct(F.array_compact(F.concat(F.array(text_file), tokenizer)))


def availability(models: DataFrame, present: Column) -> DataFrame:
    """missing_image, missing_text, available, text_available. models: found, image_files, text_files."""
    m = models.withColumn("missing_image", F.array_except("image_files", present)).withColumn("missing_text", F.array_except("text_files", present))
    ok = F.col("found") & (F.size("missing_image") == 0)
    return m.withColumn("available", ok).withColumn("text_available", ok & F.col("text_encoder").isNotNull() & (F.size("missing_text") == 0))


def ranked(models: DataFrame) -> DataFrame:
    return models.orderBy(F.desc("available"), "id")


def chosen(models: DataFrame, wanted: str = DEFAULT_MODEL) -> DataFrame:
    """The wanted model, or else the first in ranking."""
    return models.orderBy(F.desc(F.col("id") == wanted), F.desc("available"), "id").limit(1)


def rank_backends(backends: DataFrame) -> DataFrame:
    """place keeps the order among equals."""
    return backends.orderBy(F.desc(F.col("id") == "qnn_htp"), F.desc(F.col("id").contains("nnapi")), "place")


def choose_backends(backends: DataFrame, device: str) -> DataFrame:
    """choose_backend() for each device of a table: device, id, batch, or error."""
    named = F.col("id")
    order = F.struct((~F.col("accelerated")).alias("a"), (named != "qnn_htp").alias("b"), (~named.contains("nnapi")).alias("c"), "place", named.alias("id"), "accelerated", "preferred_batch")
    best = backends.groupBy(device).agg(F.min(F.when(F.col("available"), order)).alias("b"), F.bool_or(named.startswith("qnn")).alias("qnn"))
    fails = F.when(F.col("qnn") & ~F.coalesce(F.col("b.accelerated"), F.lit(False)), F.lit("the accelerated backend is unavailable")).when(F.col("b").isNull(), F.lit("no backend is available"))
    batch = F.coalesce(F.get(F.filter("b.preferred_batch", lambda x: x > 0), F.lit(0)), F.lit(DEFAULT_BATCH))
    told = best.withColumn("error", fails)
    return told.select(device, F.when(F.col("error").isNull(), F.col("b.id")).alias("id"), F.when(F.col("error").isNull(), batch).alias("batch"), "error")


def choose_backend(backends: DataFrame) -> tuple[str, int]:
    """id and batch size. backends: place, id, accelerated, available, preferred_batch. A listed but unavailable QNN
    backend means no fallback to the CPU."""
    rows = rank_backends(backends).collect()  # a handful of rows
    best = next((r for r in rows if r["accelerated"] and r["available"]), None)
    if best is None:
        if any(r["id"].startswith("qnn") for r in rows):
            raise NoBackend("the accelerated backend is unavailable")
        best = next((r for r in rows if r["available"]), None)
    if best is None:
        raise NoBackend("no backend is available")
    return best["id"], next((b for b in best["preferred_batch"] or [] if b > 0), DEFAULT_BATCH)
