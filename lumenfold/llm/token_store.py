"""Token-ID / binary output: documents encoded to id blocks, written in doc_id order and read back.

A store is a Parquet dataset whose rows are self-contained blocks of the range coder in token_codec (own model, own
checksum). Its files follow ascending doc_id: file k holds range k, blocks within a file are in order, and a block lists
the document fragments in it. Spark's committer writes it, so a lost executor leaves no half-written file, and any
storage that Spark reaches will do. Blocks decode alone, so reading parallelises freely.

Defined cases: a null text is empty; an empty text is the end id alone; null doc_ids come first; rows that repeat a
doc_id are separate documents next to each other; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import documents, shuffle_partitions, staged, work_path
from lumenfold.llm.token_codec import BLOCK_TOKENS, decode_blocks, encode_blocks
from lumenfold.llm.tokens import ROWS, encoder, in_chunks

#: Blocks coded in one lockstep run: bounds a task's memory to some 150 MB, whatever the partition holds.
LANES = 1024
#: Blocks encoded in one: their models should stay in a core's caches (decoding has more steps to share among its lanes).
ENCODED = 512
STORE = "part int, block long, start long, n_tokens int, docs array<struct<seq: long, doc_id: long, n: int, whole: boolean>>, coded binary"
_DOCS = pa.list_(pa.struct([("seq", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_())]))
_STORE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int32()), ("docs", _DOCS), ("coded", pa.binary())])


def _even(n: int, most: int = LANES) -> list[tuple[int, int]]:
    """Slices of n lanes of nearly equal length, none above most: a short one would cost as many steps as a long one."""
    parts = -(-n // most)
    cuts = [n * k // parts for k in range(parts + 1)] if n else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _writer(tokenizer: str, end_id: int, block_tokens: int, lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tail = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        buffer, held, seq, block, start = bytearray(), [], 0, 0, 0  # held: seq, doc_id, ids left to write, ids in all

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal buffer, block, start
            ids = np.frombuffer(bytes(buffer), "<u4")
            n = len(ids) if last else lanes * block_tokens
            blocks = [ids[i : min(i + block_tokens, n)] for i in range(0, n, block_tokens)]
            coded = [c for x, y in _even(len(blocks), min(lanes, ENCODED)) for c in encode_blocks(blocks[x:y])]
            rows, place = [], 0
            for b, c in zip(blocks, coded, strict=True):
                room, inside = len(b), []
                while room:
                    d = held[place]
                    take = min(room, d[2])
                    inside.append({"seq": d[0], "doc_id": d[1], "n": take, "whole": take == d[3]})
                    d[2] -= take
                    room -= take
                    place += d[2] == 0
                rows.append({"part": part, "block": block, "start": start, "n_tokens": len(b), "docs": inside, "coded": c})
                block, start = block + 1, start + len(b)
            del held[:place]
            buffer = bytearray(ids[n:].tobytes())
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_STORE)

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in in_chunks(texts):
                for name, got in zip(names[i:j], encoder(tokenizer).encode(texts[i:j]), strict=True):
                    n = len(got) // 4 + 1
                    held.append([seq, name, n, n])
                    buffer += got + tail
                    seq += 1
                # what is left for the last run is one to two runs long, and is split evenly
                while len(buffer) >= 8 * lanes * block_tokens:
                    yield from flush(False)
        yield from flush(True)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, lanes: int = LANES) -> None:
    """Encodes every whole text, appends end_id to each, and writes the blocks in ascending id order."""
    n = shuffle_partitions(docs.sparkSession)
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_writer(tokenizer, end_id, block_tokens, lanes), STORE)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _reader(with_ids: bool):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_()), ("crc", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _even(batch.num_rows):
                some = batch.slice(i, j - i)
                rows: list[tuple] = []
                for part, start, inside, ids in zip(some.column("part").to_pylist(), some.column("start").to_pylist(), some.column("docs").to_pylist(), decode_blocks(some.column("coded").to_pylist()), strict=True):
                    raw, at = ids.tobytes(), 0
                    for d in inside:
                        piece = raw[4 * at : 4 * (at + d["n"])]
                        rows.append((part, d["seq"], d["doc_id"], start + at, d["n"], d["whole"], zlib.crc32(piece)) + ((ids[at : at + d["n"]].tolist(),) if with_ids else ()))
                        at += d["n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def read_fragments(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes a store: one row per document and block, with its place in the file, CRC-32 and, if asked, its ids."""
    out = "part int, seq long, doc_id long, start long, n int, whole boolean, crc long" + ", ids array<long>" * with_ids
    return spark.read.schema(STORE).parquet(path).select("part", "start", "docs", "coded").mapInArrow(_reader(with_ids), out)


def _append(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0, v & 255] ^ table[1, v >> 8 & 255] ^ table[2, v >> 16 & 255] ^ table[3, v >> 24]


@lru_cache(maxsize=1)
def _appends() -> list[np.ndarray]:
    """By k, what 2**k zero bytes behind make of a CRC-32: a table for each byte of it (the map is linear over GF(2))."""
    columns, tables = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint32), []  # a zero bit behind
    for _ in range(3 + 48):
        table = np.zeros((4, 256), np.uint32)
        for c, column in enumerate(columns):
            bit = 1 << c % 8
            table[c // 8, bit : 2 * bit] = table[c // 8, :bit] ^ column
        columns = _append(table, columns)  # twice as many
        tables.append(table)
    return tables[3:]


def crc32_concat(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of each concatenation from those of its parts and their bytes; starts: where each one's parts begin."""
    ends = np.cumsum(sizes)
    last = np.append(starts[1:], len(sizes)) - 1
    behind, v = np.repeat(ends[last], np.diff(starts, append=len(sizes))) - ends, crcs.astype(np.uint32)
    for k, table in enumerate(_appends()):
        on = np.flatnonzero(behind >> k & 1)
        if len(on):
            v[on] = _append(table, v[on])
    return np.bitwise_xor.reduceat(v, starts)


@F.pandas_udf(T.LongType())
def _joined_crc(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    if not len(crcs):
        return pd.Series([], dtype="int64")
    starts = np.cumsum([0, *(len(c) for c in crcs.iloc[:-1])])
    return pd.Series(crc32_concat(np.concatenate(crcs.to_list()), np.concatenate(sizes.to_list()).astype(np.int64) * 4, starts).astype(np.int64))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the decoded blocks alone."""
    got = staged(read_fragments(spark, path), "token-fragments")
    whole = got.where("whole").select("part", "doc_id", "start", F.col("n").cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = (
        got.where("not whole")
        .groupBy("part", "seq")
        .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum(F.col("n").cast("long")).alias("n_tokens"), F.sort_array(F.collect_list(F.struct(F.col("start").alias("at"), "n", "crc"))).alias("parts"))
        .select("part", "doc_id", "start", "n_tokens", _joined_crc("parts.crc", "parts.n").alias("ids_crc32"))
    )
    totals = spark.read.schema(STORE).parquet(path).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).collect()  # a row per file
    base, rows = 0, []
    for r in sorted(totals):
        rows.append((r["part"], base))
        base += r["n"]
    return whole.unionByName(cut).join(spark.createDataFrame(rows, "part int, base long"), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from a store of all documents."""
    import public_tokenizers

    path = work_path(spark, "token-store")
    write_store(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_documents(spark, path)
