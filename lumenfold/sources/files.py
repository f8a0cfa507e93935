"""File sources: model configurations, tokenizer files, raw vector files, and the telemetry CSV sink."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import Bpe
from lumenfold.schemas import MODEL


def model_configs(spark: SparkSession, root: str, name: str = "model.json") -> DataFrame:
    """directory, config, parse_error for each folder's model.json. Unknown keys are ignored; missing required ones are errors."""
    raw = spark.read.text(f"{root}/*/{name}", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("directory"), "value")
    return parse_configs(raw)


def parse_configs(raw: DataFrame) -> DataFrame:
    parsed = raw.withColumn("config", F.from_json("value", MODEL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    required = ("id", "displayName", "family", "version", "embeddingDim", "imageEncoder")
    missing = F.array_compact(F.array(*[F.when(F.col(f"config.{c}").isNull(), F.lit(c)) for c in required]))
    error = F.when(F.col("config").isNull() | F.col("config._corrupt_record").isNotNull(), F.lit("malformed JSON")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return parsed.select("directory", "config", error.alias("parse_error"), F.lit(True).alias("found"))


def merges_from_lines(lines: list[str]) -> dict[tuple[str, str], int]:
    """Ranks count lines that are neither blank nor comments; lines without exactly two pieces use up a rank."""
    kept = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    return {(p[0], p[1]): rank for rank, p in enumerate(kept) if len(p) == 2}


def bpe_from_files(spark: SparkSession, vocab: str, merges: str, **options) -> Bpe:
    """Vocabulary JSON and merges text, each one small file; .gz is read as it is."""
    text = lambda path: spark.read.text(path, wholetext=True).first()[0]
    return Bpe(json.loads(text(vocab)), merges_from_lines(text(merges).split("\n")), **options)


def bpe_from_tokenizer_json(spark: SparkSession, path: str, **options) -> Bpe:
    return bpe_from_json(spark.read.text(path, wholetext=True).first()[0], **options)


def bpe_from_json(content: str, **options) -> Bpe:
    """Added tokens (the special strings) belong to the vocabulary, too."""
    parsed = json.loads(content)
    model, added = parsed["model"], {t["content"]: t["id"] for t in parsed.get("added_tokens") or []}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Bpe(added | model["vocab"], {(a, b): rank for rank, (a, b) in enumerate(pairs)}, **options)


def vocab_and_merges_from_bpe_lines(lines: list[str], keep: int = 49152 - 256 - 2) -> tuple[dict[str, int], list[str]]:
    """Vocabulary and merges of a plain merge list: the byte alphabet, the same with word ends, merged pairs, specials."""
    from lumenfold.functions.text import byte_alphabet

    merges = [x for x in lines[1 : keep + 1] if x.strip()]
    alphabet = sorted(byte_alphabet(), key=lambda c: (ord(c) > 255, ord(c)))
    words = [*alphabet, *(c + "</w>" for c in alphabet), *("".join(m.split()) for m in merges), "<|startoftext|>", "<|endoftext|>"]
    return {w: i for i, w in enumerate(words)}, merges


def file_length(spark: SparkSession, path: str) -> int:
    """Bytes under path; contents aren't read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; one of our own is made only where none is set (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lumenfold.work.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("lumenfold.work.dir", root)
    return f"{root.rstrip('/')}/lumenfold/{name}-{uuid.uuid4().hex}"


def write_csv_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log.write.mode(mode).option("header", True).option("nullValue", "").csv(path)
