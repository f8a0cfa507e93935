"""Vector files as a Spark data source: read by byte ranges, appended with a commit protocol.

    spark.read.format("vector_file").option("dim", 512).load("import/*.bin")      # headerless files
    spark.read.format("vector_file").load(store)                                 # what this source has written
    df.select("media_id", "embedding").write.format("vector_file").mode("append").option("dim", 512).save(store)

A file is little-endian float32 values without a header. A store is one logical file: each task appends a part of its own
(values, and beside them the int64 media ids in the same order), and a commit lists the parts in a numbered entry of
log/. A vector's offset is its place in the concatenation of all listed parts, so offsets come from the commit messages
alone, and what a killed task or a failed job has written is in no entry and takes no address (files that an abort couldn't
reach, of tasks killed later, go with vacuum()). Two writers can append at
once: the second takes the next number, and its parts follow. An overwrite is an entry that starts at 0 again.

Every FOLD entries, one file repeats what the log says so far, so planning reads a bounded number of them.

A scan is cut into ranges of ROWS vectors, a task each; a task holds a block of BLOCK vectors at a time. Shapes:
`rows` (file, media_id, vector_offset, embedding), `blocks` (a packed block per row, see operators/blocks.py) and `places`
(media_id, vector_offset, vector_dim; of a store, read from the ids alone).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumenfold.sources.storage import link_new, opened

ROWS, BLOCK, FLOAT, ID, FOLD = 1 << 17, 1 << 13, 4, 8, 64
SHAPES = {
    "rows": "file string, media_id long, vector_offset long, embedding array<float>",
    "blocks": "file string, vector_offset long, n int, dim int, top_norm double, media_ids array<long>, matrix binary",
    "places": "media_id long, vector_offset long, vector_dim int",
}


def check_append(dim: int, rows: int, floats: int) -> None:
    """What may be appended to a vector file: a dimension, a count, and floats for all rows."""
    if dim <= 0 or rows < 0 or floats < dim * rows:
        raise ValueError(f"can't append {rows} rows of dimension {dim} from {floats} floats")


@dataclass
class Span(InputPartition):
    """rows vectors of a file from number first on; the file's first vector lies at byte base of the logical file."""

    file: str
    base: int
    first: int
    rows: int
    dim: int
    ids: str | None


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def entries(path: str) -> list[dict]:
    """The log of a store since its last overwrite, in order; each entry tells its base, dimension and parts."""
    fs, root = opened(path)
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(f"{root}/log", allow_not_found=True)) if i.base_name[:12].isdigit())

    def read(name: str):
        with fs.open_input_stream(f"{root}/log/{name}") as f:
            return json.loads(f.read())

    folded = max((n for n in names if n.endswith(".folded")), default=None)
    out: list[dict] = read(folded) if folded else []
    for name in names:
        if name.endswith(".json") and (folded is None or name[:12] > folded[:12]):
            entry = read(name)
            out = [entry] if entry["reset"] else [*out, entry]
    return out


def length(path: str) -> int:
    """Bytes of a store's logical file."""
    told = entries(path)
    return told[-1]["base"] + told[-1]["bytes"] if told else 0


class VectorFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.shape = options["path"].rstrip("/"), options.get("shape", "rows")
        self.rows, self.block = int(options.get("rows", ROWS)), int(options.get("block", BLOCK))
        self.dim, self.job = int(options.get("dim", 0)), options.get("job")

    def _files(self) -> Iterator[tuple[str, int, int, int, str | None]]:
        """file, base, vectors, dimension, ids of each file."""
        told = entries(self.path)
        if told or not self.dim:
            _, root = opened(self.path)
            for e in told:
                at = e["base"]
                for p in e["parts"]:
                    if self.job in (None, e["job"]):
                        yield f"{root}/parts/{e['job']}/{p['name']}.f32", at, p["rows"], e["dim"], f"{root}/parts/{e['job']}/{p['name']}.ids"
                    at += p["rows"] * e["dim"] * FLOAT
            return
        folder, _, name = self.path.rpartition("/")
        fs, where = opened(folder if "*" in name else self.path)
        import fnmatch

        info = fs.get_file_info(where)
        listed = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(where))
        for i in sorted(listed, key=lambda i: i.path):
            if i.type == pafs.FileType.File and ("*" not in name or fnmatch.fnmatch(i.base_name, name)):
                yield i.path, 0, i.size // (self.dim * FLOAT), self.dim, None

    def partitions(self) -> Sequence[InputPartition]:
        if self.rows <= 0 or self.block <= 0 or self.dim < 0:
            raise ValueError("rows, block and dim have to be positive")
        out = [Span(f, base, i, min(self.rows, n - i), dim, ids) for f, base, n, dim, ids in self._files() for i in range(0, n, self.rows)]
        return out or [Span("", 0, 0, 0, 1, None)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        values = fs.open_input_file(span.file) if span.rows and self.shape != "places" else None
        ids = fs.open_input_file(span.ids) if span.rows and span.ids else None
        for at in range(span.first, span.first + span.rows, self.block):
            n = min(self.block, span.first + span.rows - at)
            names = pa.array(np.frombuffer(_exactly(ids, n * ID, at * ID), "<i8")) if ids else pa.nulls(n, pa.int64())
            start = span.base + at * span.dim * FLOAT
            offsets = pa.array(start + np.arange(n, dtype=np.int64) * span.dim * FLOAT)
            if self.shape == "places":
                yield pa.record_batch([names, offsets, pa.array(np.full(n, span.dim, np.int32))], names=["media_id", "vector_offset", "vector_dim"])
                continue
            raw = _exactly(values, n * span.dim * FLOAT, at * span.dim * FLOAT)
            v = np.frombuffer(raw, "<f4")
            if self.shape == "blocks":
                yield packed(span.file, start, v.reshape(n, span.dim), names, raw)
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * span.dim, span.dim, dtype=np.int32)), pa.array(v))
                yield pa.record_batch([pa.array([span.file] * n, pa.string()), names, offsets, lists], names=["file", "media_id", "vector_offset", "embedding"])


def _exactly(f, size: int, at: int) -> bytes:
    data = f.read_at(size, at)
    if len(data) != size:
        raise ValueError(f"a vector file ends at {at + len(data)}, its log says {at + size}")
    return data


def packed(file: str, start: int, v: np.ndarray, ids: pa.Array, raw: bytes) -> pa.RecordBatch:
    norms = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    top = float(np.max(norms, initial=0.0))
    return pa.record_batch(
        [pa.array([file]), pa.array([start]), pa.array([len(v)], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([top if not math.isnan(top) else math.inf]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([bytes(raw)], pa.binary())],
        names=["file", "vector_offset", "n", "dim", "top_norm", "media_ids", "matrix"],
    )


class VectorFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dim, self.reset = options["path"].rstrip("/"), int(options.get("dim", 0)), overwrite
        self.job = options.get("job") or uuid.uuid4().hex
        check_append(self.dim, 0, 0)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = opened(self.path)
        folder = f"{root}/parts/{self.job}"
        fs.create_dir(folder, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # an attempt has files of its own
        try:
            rows = self._write(fs, f"{folder}/{name}", iterator)
        except BaseException:
            for kind in ("f32", "ids"):
                if fs.get_file_info(f"{folder}/{name}.{kind}").type == pafs.FileType.File:
                    fs.delete_file(f"{folder}/{name}.{kind}")
            raise
        return Part(name, rows)

    def _write(self, fs: pafs.FileSystem, stem: str, iterator: Iterator[pa.RecordBatch]) -> int:
        rows = 0
        with fs.open_output_stream(f"{stem}.f32") as values, fs.open_output_stream(f"{stem}.ids") as ids:
            for batch in iterator:
                lists, media = batch.column(batch.schema.get_field_index("embedding")), batch.column(batch.schema.get_field_index("media_id"))
                flat = lists.flatten()
                check_append(self.dim, batch.num_rows, len(flat))
                if media.null_count or lists.null_count or flat.null_count or (np.diff(lists.offsets.to_numpy()) != self.dim).any():
                    raise ValueError(f"every row needs a media_id and {self.dim} floats")
                values.write(flat.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                ids.write(media.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                rows += batch.num_rows
        return rows

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        parts = sorted(({"name": m.name, "rows": m.rows} for m in messages if isinstance(m, Part) and m.rows), key=lambda p: p["name"])
        listed = {f"{p['name']}.{kind}" for p in parts for kind in ("f32", "ids")}
        for i in fs.get_file_info(pafs.FileSelector(f"{root}/parts/{self.job}", allow_not_found=True)):
            if i.base_name not in listed:  # empty parts, and those of attempts that were killed
                fs.delete_file(i.path)
        while True:
            told = entries(self.path)
            if any(e["job"] == self.job for e in told):
                return
            base = 0 if self.reset or not told else told[-1]["base"] + told[-1]["bytes"]
            number = _last_number(fs, root) + 1
            entry = {"number": number, "job": self.job, "reset": self.reset, "base": base, "dim": self.dim, "bytes": sum(p["rows"] for p in parts) * self.dim * FLOAT, "parts": parts}
            if link_new(fs, f"{root}/log/{number:012d}.json", json.dumps(entry).encode()):
                if number % FOLD == 0:
                    link_new(fs, f"{root}/log/{number:012d}.folded", json.dumps([e for e in entries(self.path) if e["number"] <= number]).encode())
                return

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        if fs.get_file_info(f"{root}/parts/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/parts/{self.job}")


def _last_number(fs: pafs.FileSystem, root: str) -> int:
    names = (i.base_name for i in fs.get_file_info(pafs.FileSelector(f"{root}/log", allow_not_found=True)))
    return max((int(n[:12]) for n in names if n[:12].isdigit()), default=0)


class VectorFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_file"

    def schema(self) -> str:
        return SHAPES[self.options.get("shape", "rows")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return VectorFileReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VectorFileWriter(dict(self.options), overwrite)


def source(spark: SparkSession):
    """A reader of the registered format."""
    spark.dataSource.register(VectorFileSource)
    return spark.read.format("vector_file")


def append(vectors: DataFrame, path: str, dim: int, overwrite: bool = False) -> str:
    """Appends media_id and embedding to a store; the name of the append, by which places() finds its rows."""
    vectors.sparkSession.dataSource.register(VectorFileSource)
    job = uuid.uuid4().hex
    rows = vectors.select("media_id", "embedding")
    rows.write.format("vector_file").mode("overwrite" if overwrite else "append").option("dim", dim).option("job", job).save(path)
    return job


def places(spark: SparkSession, path: str, job: str | None = None) -> DataFrame:
    """media_id, vector_offset, vector_dim of a store, or of one append; vectors aren't read."""
    reader = source(spark).option("shape", "places")
    return (reader.option("job", job) if job else reader).load(path)


def vacuum(path: str) -> list[str]:
    """Deletes the parts of appends that no entry lists any more; nothing may be writing. The names of the appends."""
    fs, root = opened(path)
    live = {e["job"] for e in entries(path)}
    gone = [i for i in fs.get_file_info(pafs.FileSelector(f"{root}/parts", allow_not_found=True)) if i.type == pafs.FileType.Directory and i.base_name not in live]
    for i in gone:
        fs.delete_dir(i.path)
    return sorted(i.base_name for i in gone)
