"""Small files beside tables: create-if-absent, listings, and the file systems that tasks open.

The driver reaches whatever Spark reaches, through Hadoop's file systems. Tasks of the vector file source open files by
range with pyarrow, which has to know the storage (local, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def link_new(fs: pafs.FileSystem, path: str, data: bytes) -> bool:
    """Writes a small file where there is none, whole or not at all; False if there was one. Exclusive on local file systems
    (a hard link) and where a rename refuses an existing target (HDFS); object stores need one writer at a time."""
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            os.link(draft, path)
            return True
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            return False
        fs.move(draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        if fs.get_file_info(draft).type != pafs.FileType.NotFound:
            fs.delete_file(draft)


class HadoopFiles:
    """The same for the driver, by Spark's own file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def size(self, path: str) -> int:
        """Bytes under a path."""
        fs, where = self._at(path)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def read(self, path: str) -> bytes:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        fs, where = self._at(path)
        out = fs.create(where, True)
        out.write(bytearray(data))
        out.close()

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def publish(self, path: str, value: Any) -> bool:
        """JSON, written where there is no file yet; False if another was first. Readers see all of it or nothing."""
        draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        self.write(draft, json.dumps(value).encode())
        try:
            fs, where = self._at(path)
            if fs.getScheme() == "file":
                os.link(self.jvm.fs.Path(draft).toUri().getPath(), where.toUri().getPath())
            else:  # a rename that refuses an existing target
                none = self.jvm.fs.Options.Rename.NONE
                options = self.jvm_array(none)
                self.jvm.fs.FileContext.getFileContext(where.toUri(), self.conf).rename(self.jvm.fs.Path(draft), where, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.delete(draft)

    def jvm_array(self, *items):
        from pyspark import SparkContext

        gateway = SparkContext._gateway
        out = gateway.new_array(self.jvm.fs.Options.Rename, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out
