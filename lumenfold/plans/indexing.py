"""Indexing: the scan decision, and embedding of catalog rows into vectors and marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.catalog import mark_failed, mark_indexed
from lumenfold.operators.embed import OUT, Embedder, embed
from lumenfold.schemas import FAILED, PENDING
from lumenfold.sources import vectorfile
from lumenfold.sources.files import work_path

FULL, SKIP, INCREMENTAL = "full", "skip", "incremental"
#: A table of images (media_id, tensor), or what opens those of the given rows (media_id, uri).
Images = DataFrame | Callable[[DataFrame], DataFrame]


def plan_scan(forced: bool, table_rows: int, model_changed: bool, anchor: tuple[int, int] | None, source_rows: int, latest: tuple[int, int] | None, mode: str = "parity") -> str:
    """From one-row aggregates. Mode "parity" trusts equal counts, so a replaced row may be missed; "full" doesn't."""
    if forced or not table_rows or model_changed or anchor is None or mode == "full" or source_rows != table_rows:
        return FULL
    return SKIP if latest == anchor else INCREMENTAL


def one_image_each(images: DataFrame) -> DataFrame:
    """Of images that repeat a media_id the greatest tensor stays (a null one is the least)."""
    return images.groupBy("media_id").agg(F.max("tensor").alias("tensor"))


def embed_rows(todo: DataFrame, images: Images, embedder: Embedder, batch: int = 8, granularity: str = "record", normalize: bool = True) -> DataFrame:
    """media_id, batch_id, embedding or error of each row of todo, written, so a lost executor embeds nothing again. Rows
    without an image fail."""
    todo = todo.select("media_id", "uri")
    found = one_image_each(images(todo) if callable(images) else images.join(todo.select("media_id"), "media_id", "left_semi"))
    # the one join: a row without an image comes with a null tensor
    whole = todo.select("media_id").join(found, "media_id", "left")
    path = work_path(todo.sparkSession, "embedded")
    told = embed(whole, embedder, batch, normalize, granularity).withColumn("error", F.when(F.col("error") == "no image", F.lit("image not found")).otherwise(F.col("error")))
    told.write.parquet(path)
    done = todo.sparkSession.read.schema(OUT).parquet(path)
    done.staged_at = path
    return done


def place(done: DataFrame, todo: DataFrame, vector_file: str, dim: int) -> DataFrame:
    """Appends the vectors of embed_rows() to the vector file; media_id, error, vector_offset, vector_dim, and the state in
    which the row was seen. Only ids and places are joined."""
    seen = done.select("media_id", "error").join(todo.select("media_id", "date_modified", "size_bytes"), "media_id")
    ok = done.where("error is null")
    if ok.isEmpty():
        return seen.withColumns({"vector_offset": F.lit(None).cast("long"), "vector_dim": F.lit(None).cast("int")})
    job = vectorfile.append(ok, vector_file, dim)
    return seen.join(vectorfile.places(done.sparkSession, vector_file, job), "media_id", "left")


def marked(catalog: DataFrame, placed: DataFrame, model: str, now: int) -> DataFrame:
    """The catalog with what was placed; a row that has changed since it was seen stays as it is, and is pending anew."""
    same = ["media_id", "date_modified", "size_bytes"]
    still = placed.join(catalog.where(F.col("status").isin(PENDING, FAILED)).select(*same), same, "left_semi")
    good = still.where("error is null").select("media_id", "vector_offset", "vector_dim")
    bad = still.where("error is not null").select("media_id", F.col("error").alias("message"))
    return mark_failed(mark_indexed(catalog, good, model, now), bad)
