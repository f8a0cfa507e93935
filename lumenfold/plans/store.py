"""The index as a store: versions of a bucketed catalog, an appended vector file, and the query cache.

A version is a manifest, manifest/<number>.json, that names everything else: the folder and row count of each catalog
bucket (a hash of media_id), the vector file, the folders of the query cache, the model, the scan anchor and the last
number of each stream. What a manifest names is never changed in place, so a reader sees one version whole.

A change reads a version, writes the buckets it touches into a folder of their own, and publishes the next number, which
succeeds once. If another change was first, it is made again from the newer version, so none is lost; if the two touch
no bucket in common, what was written is published as it is. Buckets hold about ROWS_PER_BUCKET rows whatever the size of
the catalog, so a change writes in proportion to its own rows. Vectors are appended before the catalog points at them: a
crash leaves a part of the file that no row names.

Exclusive publishing needs a local file system or one whose rename refuses an existing target, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.catalog import changed_rows, upsert
from lumenfold.plans.leases import Lease, StaleLease
from lumenfold.schemas import CATALOG, INDEXED, NO_OFFSET, PENDING, QUERY_CACHE, SCHEMA_VERSION, VECTORS
from lumenfold.sources import vectorfile
from lumenfold.sources.storage import HadoopFiles

ROWS_PER_BUCKET, TRIES = 100_000, 50
EMPTY = {"version": 0, "schema": SCHEMA_VERSION, "buckets": 1, "catalog": {}, "vectors": None, "cache": [], "model": None, "anchor": None, "keys": {}, "fences": {}}


class NewerSchema(RuntimeError):
    """The store was written by a later release."""


class Conflict(RuntimeError):
    """Other changes were first, time and again."""


def _to_2(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Schema 2 tells cached vectors apart by model, so what has no model key goes; absent state gets its sentinels."""
    filled = {"status": F.lit(PENDING), "vector_offset": F.lit(NO_OFFSET).cast("long"), "vector_dim": F.lit(0), "indexed_at": F.lit(0).cast("long"), "retry_count": F.lit(0)}
    return {"catalog": tables["catalog"].withColumns({c: F.coalesce(c, v) for c, v in filled.items()}), "query_cache": tables["query_cache"].limit(0)}


#: By the schema number of a manifest, what makes its tables those of the next number.
UPGRADES: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = {1: _to_2}


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("media_id"), F.lit(buckets)).cast("int")


@dataclass
class Edit:
    """What a change does: rows of the buckets it names (all of them, if it names none), and new values of the manifest.
    expect: about how many rows a whole catalog will have. alone: rows of a bucket depend on that bucket only."""

    rows: DataFrame | None = None
    buckets: list[int] | None = None
    expect: int | None = None
    alone: bool = False
    values: dict[str, Any] = field(default_factory=dict)


class Snapshot:
    """One version, read-only."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest
        if manifest["schema"] > SCHEMA_VERSION:
            raise NewerSchema(f"schema {manifest['schema']}, known up to {SCHEMA_VERSION}")

    version, schema, buckets, model, keys = (property(lambda self, k=k: self.manifest[k]) for k in ("version", "schema", "buckets", "model", "keys"))

    @property
    def anchor(self) -> tuple[int, int] | None:
        held = self.manifest["anchor"]
        return None if held is None else tuple(held)

    @property
    def vector_file(self) -> str:
        return f"{self.store.root}/{self.manifest['vectors'] or 'vectors/first'}"

    def row_count(self) -> int:
        return sum(n for _, n in self.manifest["catalog"].values())

    def _tables(self, buckets: Iterable[int] | None) -> dict[str, DataFrame]:
        held = self.manifest["catalog"]
        paths = [f"{self.store.root}/{held[b][0]}/bucket={b}" for b in (held if buckets is None else map(str, buckets)) if b in held]
        caches = [f"{self.store.root}/{c}" for c in self.manifest["cache"]]
        read = lambda paths, schema: self.store.spark.read.schema(schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], schema)
        tables = {"catalog": read(paths, CATALOG), "query_cache": read(caches, QUERY_CACHE)}
        for n in range(self.schema, SCHEMA_VERSION):
            tables = UPGRADES[n](tables)
        return tables

    def catalog(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The catalog, or the named buckets of it."""
        return self._tables(buckets)["catalog"]

    def query_cache(self) -> DataFrame:
        return self._tables([])["query_cache"]

    def stored_vectors(self, shape: str = "rows") -> DataFrame:
        """The vector file, replaced and orphaned vectors too."""
        return vectorfile.source(self.store.spark).option("shape", shape).load(self.vector_file)

    def vectors(self) -> DataFrame:
        """media_id, vector_offset, embedding of indexed rows: each has the vector its catalog row points at."""
        live = self.catalog().where(F.col("status") == INDEXED).select("media_id", "vector_offset")
        return self.stored_vectors().select(*VECTORS.names).join(live, ["media_id", "vector_offset"], "left_semi")


class Store:
    def __init__(self, spark: SparkSession, root: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.root, self.rows_per_bucket, self.files = spark, root.rstrip("/"), rows_per_bucket, HadoopFiles(spark)

    def _manifest_file(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.root}/manifest") if n[:12].isdigit() and n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that is still there."""
        v = max(self.versions(), default=0) if version is None else version
        return Snapshot(self, {**EMPTY, **json.loads(self.files.read(self._manifest_file(v)))} if v else dict(EMPTY))

    def version(self) -> int:
        return self.snapshot().version

    def catalog(self) -> DataFrame:
        return self.snapshot().catalog()

    def vectors(self) -> DataFrame:
        return self.snapshot().vectors()

    def _write(self, rows: DataFrame, buckets: int, touched: int) -> tuple[str, dict[str, list]]:
        """A new folder with a task for each touched bucket; its buckets and their row counts."""
        folder = f"catalog/{uuid.uuid4().hex}"
        told = rows.select(*CATALOG.names).withColumn("bucket", bucket_of(buckets))
        told.repartition(touched, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        counts = self.spark.read.schema("media_id long, bucket int").parquet(f"{self.root}/{folder}").groupBy("bucket").count() if self._has_rows(folder) else None
        return folder, {str(r["bucket"]): [folder, r["count"]] for r in counts.collect()} if counts is not None else {}

    def _has_rows(self, folder: str) -> bool:
        return any(n.startswith("bucket=") for n in self.files.names(f"{self.root}/{folder}"))

    def migrate(self) -> None:
        """Writes a store of an older schema anew in this one."""
        if self.snapshot().schema < SCHEMA_VERSION:
            self._change(lambda s: Edit(s.catalog(), expect=s.row_count(), values={"cache": []}) if s.schema < SCHEMA_VERSION else None)

    def change(self, edit: Callable[[Snapshot], Edit | None], key: tuple[str, int] | None = None, lease: Lease | None = None) -> int:
        """The version that holds the change. edit gets the newest version and is asked again if another change was first.
        key: a stream and a number; numbers up to the last one committed for that stream change nothing."""
        self.migrate()
        return self._change(edit, key, lease)

    def _change(self, edit: Callable[[Snapshot], Edit | None], key: tuple[str, int] | None = None, lease: Lease | None = None) -> int:
        for _ in range(TRIES):
            base = self.snapshot()
            if key is not None and base.keys.get(key[0], -1) >= key[1]:
                return base.version
            todo = edit(base)
            if todo is None:
                return base.version
            buckets, folder, written = base.buckets, None, {}
            if todo.rows is not None:
                if todo.buckets is None:
                    n = base.row_count() if todo.expect is None else todo.expect
                    buckets = max(1, -(-n // self.rows_per_bucket))
                folder, written = self._write(todo.rows, buckets, buckets if todo.buckets is None else max(len(todo.buckets), 1))
            now = base
            while True:
                held = dict(now.manifest["catalog"])
                if todo.rows is not None:
                    held = written if todo.buckets is None else {b: x for b, x in held.items() if int(b) not in set(todo.buckets)} | written
                if lease is not None and now.manifest["fences"].get(lease.name, 0) > lease.token:
                    raise StaleLease(lease.name)
                new = {**now.manifest, "version": now.version + 1, "schema": SCHEMA_VERSION, "buckets": buckets, "catalog": held, **todo.values}
                if key is not None:
                    new["keys"] = {**new["keys"], key[0]: key[1]}
                if lease is not None:
                    new["fences"] = {**new["fences"], lease.name: lease.token}
                if self.files.publish(self._manifest_file(new["version"]), new):
                    return new["version"]
                now = self.snapshot()
                if not self._apart(base, now, todo, key):
                    break
            if folder:
                self.files.delete(f"{self.root}/{folder}")
        raise Conflict(f"{TRIES} other changes were first")

    @staticmethod
    def _apart(base: Snapshot, now: Snapshot, todo: Edit, key: tuple[str, int] | None) -> bool:
        """Whether a change made from base holds for now as well."""
        same = all(base.manifest[k] == now.manifest[k] for k in ("schema", "buckets", "vectors", "model", "anchor"))
        if not same or not todo.alone or todo.buckets is None or (key is not None and now.keys.get(key[0], -1) >= key[1]):
            return False
        return all(base.manifest["catalog"].get(str(b)) == now.manifest["catalog"].get(str(b)) for b in todo.buckets)

    def upsert(self, scan: DataFrame, model: str, key: tuple[str, int] | None = None, lease: Lease | None = None, **values: Any) -> int:
        """Upserts scanned rows; only buckets in which a row changes are written. A catalog that has outgrown its buckets is
        dealt anew."""

        def edit(base: Snapshot) -> Edit:
            named = scan.select(bucket_of(base.buckets).alias("b")).distinct()
            held = base.catalog(r["b"] for r in named.collect())
            touched = sorted(r["b"] for r in changed_rows(scan, held, model).select(bucket_of(base.buckets).alias("b")).distinct().collect())
            if not touched:
                return Edit(values={"model": model, **values})
            n = base.row_count()
            if n > 2 * base.buckets * self.rows_per_bucket or not n:
                return Edit(upsert(scan, base.catalog(), model), expect=n or scan.count(), values={"model": model, **values})
            some = scan.where(bucket_of(base.buckets).isin(touched))
            return Edit(upsert(some, base.catalog(touched), model), touched, alone=not values, values={"model": model, **values})

        return self.change(edit, key, lease)

    def commit(self, catalog: DataFrame, key: tuple[str, int] | None = None, lease: Lease | None = None, expected: int | None = None, **values: Any) -> int:
        """A whole catalog, made from version `expected`; Conflict if that isn't the newest any more. Without expected the
        newest is replaced whatever it holds."""

        def edit(base: Snapshot) -> Edit:
            if expected is not None and base.version != expected:
                raise Conflict(f"made from version {expected}, the newest is {base.version}")
            return Edit(catalog, expect=max(base.row_count(), 1), values=values)

        return self.change(edit, key, lease)

    def vacuum(self, keep: int = 10) -> None:
        """Forgets all but the newest versions and what only they name. Nothing may be reading those or writing."""
        versions = sorted(self.versions())
        kept = [self.snapshot(v).manifest for v in versions[-keep:]]
        named = {x[0] for m in kept for x in m["catalog"].values()} | {c for m in kept for c in m["cache"]} | {m["vectors"] or "vectors/first" for m in kept}
        for folder in ("catalog", "query_cache", "vectors"):
            for n in self.files.names(f"{self.root}/{folder}"):
                if f"{folder}/{n}" not in named:
                    self.files.delete(f"{self.root}/{folder}/{n}")
        for v in versions[:-keep]:
            self.files.delete(self._manifest_file(v))
