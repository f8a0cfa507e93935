"""Shared pieces: the shared working folder, staged tables, memos of Python workers and small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the class [\x20\x09-\x0D]: the white space of every contract here.
WHITESPACE = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session (tests) gets one; a cluster has to name one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lumenfold.work.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("lumenfold.work.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts lineage with a written table: a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing will read again; collects garbage, so that Spark's cleaner drops dead shuffles."""
    for t in tables:
        path = t.__dict__.get("staged_at") if t is not None else None
        if path:
            delete_path(t.sparkSession, path)
    gc.collect()
    for t in tables[:1]:
        if t is not None:
            t.sparkSession.sparkContext._jvm.System.gc()


#: Entries of a memo: with keys of up to 32 characters and short values, some 20 MB.
MEMO_ENTRIES = 100_000
_MEMOS: dict[str, dict[str, Any]] = {}


def memo(owner: str, name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers for one operator. Workers are reused: another operator's memos are dropped first."""
    if owner not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[owner] = {}
    held = _MEMOS[owner]
    if name not in held:
        held[name] = make()
    return held[name]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII values take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
