"""The index from scan to search: vector files, the store, leases, resumable indexing, text vectors, packed blocks."""

import json
import math
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.functions import imaging
from lumenfold.functions.text import Bpe
from lumenfold.operators import blocks, catalog, integrity, search
from lumenfold.operators.embed import HashEmbedder, OnnxEmbedder, embed
from lumenfold.operators.sessions import SessionPool
from lumenfold.operators.textquery import OnnxTextModel, TextSession, search_text
from lumenfold.plans import jobs
from lumenfold.plans.leases import AlreadyRunning, Lease, StaleLease, single_flight
from lumenfold.plans.store import Conflict, Edit, NewerSchema, Store
from lumenfold.sources import vectorfile
from lumenfold.streaming.ingest import upsert_stream
from tiny_onnx import INT32, image_model, text_model

TOY = {"<|startoftext|>": 10, "<|endoftext|>": 11, "l": 0, "o": 1, "w": 2, "w</w>": 3, "lo": 4, "low</w>": 5, "e": 6, "r</w>": 7, "!</w>": 8, "low": 9}


def toy_bpe():
    return Bpe(TOY, {("l", "o"): 0, ("lo", "w</w>"): 1, ("lo", "w"): 2}, max_length=8)


def scan(spark, ids, dm=100, size=10):
    return spark.createDataFrame([(i, f"u{i}", "n", "m", 1, 1, size, 5, dm + i) for i in ids], schemas.SCAN)


def images(spark, ids):
    return spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in ids], "media_id long, tensor array<float>")


def test_vector_files(spark, tmp_path):
    """Ranges of a headerless file are tasks of their own; a store reads back what was appended, and nothing else."""
    v = np.arange(5000 * 3, dtype="<f4").reshape(-1, 3)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(v.tobytes() + b"xx")
    (tmp_path / "in" / "b.bin").write_bytes(v[:7].tobytes())
    (tmp_path / "in" / "c.txt").write_bytes(b"other")
    df = vectorfile.source(spark).option("dim", 3).option("rows", 700).option("block", 100).load(f"{tmp_path}/in/*.bin")
    assert df.rdd.getNumPartitions() == 8 + 1
    most = df.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    got = sorted((os.path.basename(r["file"]), r["vector_offset"], r["embedding"]) for r in df.collect())
    assert most == 700 and got == sorted([("a.bin", i * 12, x.tolist()) for i, x in enumerate(v)] + [("b.bin", i * 12, x.tolist()) for i, x in enumerate(v[:7])])

    path = str(tmp_path / "store")
    first = spark.range(0, 1000, 1, 5).select(F.col("id").alias("media_id"), F.array(*[F.col("id").cast("float") + i for i in range(4)]).alias("embedding"))
    assert vectorfile.length(path) == 0
    a = vectorfile.append(first, path, 4)
    b = vectorfile.append(first.where("media_id < 9").withColumn("media_id", F.col("media_id") + 5000), path, 4)
    assert vectorfile.length(path) == 1009 * 16
    rows = vectorfile.source(spark).option("rows", 64).load(path).collect()
    assert sorted(r["vector_offset"] for r in rows) == [i * 16 for i in range(1009)]
    assert all(r["embedding"] == [float(r["media_id"] % 5000 + i) for i in range(4)] for r in rows)
    told = {r["media_id"]: r["vector_offset"] for r in vectorfile.places(spark, path, b).collect()}
    assert told == {r["media_id"]: r["vector_offset"] for r in rows if r["media_id"] >= 5000} and vectorfile.places(spark, path, a).count() == 1000

    # the audit of a catalog made from it is clean
    state = vectorfile.places(spark, path).select("media_id", "vector_offset", "vector_dim", F.lit("indexed").alias("status"))
    assert integrity.audit(state, vectorfile.length(path)).first()["is_corrupt"] is False
    # a failed job, and attempts that were killed, leave no bytes and take no address
    for bad in (first.withColumn("embedding", F.when(F.col("media_id") < 990, F.col("embedding"))), first.withColumn("embedding", F.slice("embedding", 1, 3)), first.withColumn("media_id", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="append|media_id"):
            vectorfile.append(bad, path, 4)
    vectorfile.vacuum(path)  # of tasks that outlived their job
    assert vectorfile.length(path) == 1009 * 16 and set(os.listdir(f"{path}/parts")) == {a, b}
    writer = vectorfile.VectorFileWriter({"path": path, "dim": "4", "job": "j"}, False)
    os.makedirs(f"{path}/parts/j")
    for name in ("killed.f32", "killed.ids"):
        open(f"{path}/parts/j/{name}", "wb").write(b"half")
    writer.commit([vectorfile.Part("none", 0), None])
    assert os.listdir(f"{path}/parts/j") == [] and vectorfile.length(path) == 1009 * 16
    writer.commit([])  # told twice, as a driver that retries would
    assert len(vectorfile.entries(path)) == 3
    # an overwrite starts at 0; the old parts go later
    vectorfile.append(first.where("media_id < 3"), path, 4, overwrite=True)
    assert vectorfile.length(path) == 48 and vectorfile.source(spark).load(path).count() == 3
    assert set(vectorfile.vacuum(path)) == {a, b, "j"} and vectorfile.source(spark).load(path).count() == 3
    assert vectorfile.source(spark).load(str(tmp_path / "nothing")).count() == 0
    for bad in ((0, 1, 4), (4, -1, 4), (4, 2, 7)):
        with pytest.raises(ValueError):
            vectorfile.check_append(*bad)
    open(next(f"{path}/parts/{j}/{n}" for j in os.listdir(f"{path}/parts") for n in os.listdir(f"{path}/parts/{j}") if n.endswith("f32")), "r+b").truncate(3)
    with pytest.raises(Exception, match="ends at"):
        vectorfile.source(spark).load(path).collect()


def test_folded_log(tmp_path, monkeypatch):
    """Every few entries the log is repeated in one file; reading starts there and sees the same, over an overwrite, too."""
    monkeypatch.setattr(vectorfile, "FOLD", 3)
    path, want, base = str(tmp_path / "f"), [], 0
    for n in range(1, 11):
        writer = vectorfile.VectorFileWriter({"path": path, "dim": "2", "job": f"j{n}"}, overwrite=n == 5)
        os.makedirs(f"{path}/parts/j{n}")
        for kind in ("f32", "ids"):
            open(f"{path}/parts/j{n}/p.{kind}", "wb").write(bytes(8 * n))
        writer.commit([vectorfile.Part("p", n)])
        want, base = ([], 0) if n == 5 else (want, base)
        want.append((n, base, 8 * n))
        base += 8 * n
        assert [(e["number"], e["base"], e["bytes"]) for e in vectorfile.entries(path)] == want and vectorfile.length(path) == base
    assert sorted(n for n in os.listdir(f"{path}/log") if n.endswith("folded")) == [f"{n:012d}.folded" for n in (3, 6, 9)]
    for n in range(1, 10):
        os.remove(f"{path}/log/{n:012d}.json")
    assert vectorfile.length(path) == base


def test_scan_index_commit_search(spark, tmp_path):
    """One path from scan to search, with an image that repeats, one that is null, one that is missing."""
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=3)
    assert jobs.run_scan(store, scan(spark, range(7)), "m:v1") == "full"
    pictures = images(spark, [0, 1, 2, 3]).union(images(spark, [1])).union(spark.createDataFrame([(1, [9.0, 9.0, 9.0, 9.0]), (4, None), (5, [])], "media_id long, tensor array<float>"))
    told = jobs.index_pending(store, pictures, HashEmbedder(4), "m:v1", 7, batch=3, granularity="batch")
    assert (told["n"], told["n_ok"], told["n_failed"]) == (7, 4, 3)
    rows = {r["media_id"]: (r["status"], r["error"]) for r in store.catalog().collect()}
    assert len(rows) == store.catalog().count() == 7
    assert {i for i, r in rows.items() if r == ("indexed", None)} == {0, 1, 2, 3} and {rows[i] for i in (4, 5, 6)} == {("failed", "image not found")}
    q = store.vectors().where("media_id = 2").first()["embedding"]
    found = search.search(store.catalog(), store.vectors(), q, 3).collect()
    assert found[0]["media_id"] == 2 and found[0]["score"] == pytest.approx(1) and len(found) == 3
    s = store.snapshot()
    length = vectorfile.length(s.vector_file)
    assert length == 4 * 16 and integrity.audit(s.catalog(), length).first()["is_corrupt"] is False
    cache = search.VectorCache()
    assert cache.checked(s.catalog(), s.vectors(), length).count() == 4 and cache.warm(s.vectors(), (4, length), force=True) == 4
    cache.invalidate()
    # a changed row is pending again; its old vector stays in the file and out of the search
    store.upsert(scan(spark, [2], size=11), "m:v1")
    assert store.vectors().count() == 3 and store.snapshot().stored_vectors().count() == 4
    assert 2 not in {r["media_id"] for r in search.search(store.catalog(), store.vectors(), q, 9).collect()}
    jobs.index_pending(store, pictures, HashEmbedder(4), "m:v1", 8)
    assert store.vectors().where("media_id = 2").first()["vector_offset"] == 64
    jobs.retry_failed(store, images(spark, [4, 6]), HashEmbedder(4), "m:v1", 9, media_id=4)
    state = {r["media_id"]: (r["status"], r["retry_count"]) for r in store.catalog().collect()}
    assert state[4] == ("indexed", 1) and state[5] == state[6] == ("failed", 1)
    # a row that changes while it is embedded is left pending
    base = store.snapshot()

    def meanwhile(todo):
        store.upsert(scan(spark, [6], size=99), "m:v1")
        return images(spark, [5, 6])

    jobs.retry_failed(store, meanwhile, HashEmbedder(4), "m:v1", 10)
    state = {r["media_id"]: r["status"] for r in store.catalog().collect()}
    assert state[6] == "pending" and state[5] == "indexed" and store.version() > base.version
    assert jobs.rebuild_if_corrupt(store, scan(spark, range(3)), "m:v1", 10**6) is False and jobs.rebuild_if_corrupt(store, scan(spark, range(3)), "m:v1", 16)
    assert {r["status"] for r in store.catalog().collect()} == {"pending"} and store.vectors().count() == 0 and store.snapshot().anchor == (102, 2)
    store.vacuum(keep=1)
    assert store.catalog().count() == 3 and store.versions() == [store.version()]


def test_model_faults(spark):
    class Nan(HashEmbedder):
        def embed(self, session, tensors):
            out = super().embed(session, tensors)
            out[tensors[:, 0] == 1] = math.nan
            return out

    rows = {r["media_id"]: (r["embedding"] is None, r["error"]) for r in embed(images(spark, range(3)).coalesce(1), Nan(4)).collect()}
    assert rows[1][0] and "finite" in rows[1][1] and not rows[0][0] and not rows[2][0]
    df = spark.createDataFrame([(1, None, 1, 1), (2, [], 0, 0), (3, [5], None, 1), (4, [0xFF, 0xFF00], 2, 1), (5, [1, 2, 3], 2, 1)], "id int, px array<int>, w int, h int")
    got = {r["id"]: r["o"] for r in df.select("id", imaging.resize(F.col("px"), F.col("w"), F.col("h"), 4, 2).alias("o")).collect()}
    assert got[1] is got[2] is got[3] is got[5] is None and len(got[4]) == 8
    for layout in ("NCHW", "NHWC"):
        t = {r["id"]: r["t"] for r in df.select("id", imaging.tensor(F.col("px"), F.array(), F.array(), layout).alias("t")).collect()}
        assert t[1] is None and t[2] == [] and len(t[5]) == 9
    # of a resize: an even stretch of one grey pixel, and halves of two
    grey = spark.createDataFrame([([0x7F808080, 0x7F808080], 2, 1)], "px array<int>, w int, h int")
    assert set(grey.select(imaging.resize(F.col("px"), F.col("w"), F.col("h"), 5, 3).alias("o")).first()["o"]) == {0x7F808080}


def test_two_writers(spark, tmp_path):
    """Upserts made from one version both survive, in turn and at once; a commit from an old version is refused."""
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=2)
    store.upsert(scan(spark, [1, 2]), "m:v1")
    asked = []

    def slow(base):
        asked.append(base.version)
        if len(asked) == 1:
            store.upsert(scan(spark, [3]), "m:v1")  # another is first
        return Edit(catalog.upsert(scan(spark, [4]), base.catalog(), "m:v1"))

    store.change(slow)
    assert asked == [1, 2] and sorted(r["media_id"] for r in store.catalog().collect()) == [1, 2, 3, 4]
    errors = []

    def one(i):
        try:
            store.upsert(scan(spark, [100 + i, 200 + i]), "m:v1")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.catalog().count() == 12
    old = store.version()
    store.upsert(scan(spark, [7]), "m:v1")
    with pytest.raises(Conflict):
        store.commit(store.snapshot(old).catalog(), expected=old)
    v = store.version()
    assert store.upsert(scan(spark, [8]), "m:v1", key=("stream", 3)) == v + 1 == store.upsert(scan(spark, [9]), "m:v1", key=("stream", 3)) and store.upsert(scan(spark, [9]), "m:v1", key=("stream", 2)) == v + 1
    assert not store.catalog().where("media_id = 9").count() and store.snapshot(old).catalog().count() == 12


def test_leases(spark, tmp_path):
    root, now = str(tmp_path / "s"), [1000.0]
    store = Store(spark, root)
    with single_flight(spark, root, "index") as held:
        with pytest.raises(AlreadyRunning), single_flight(spark, root, "index"):
            pass
        with single_flight(spark, root, "scan"):
            pass
        store.upsert(scan(spark, [1]), "m:v1", lease=held)
    dead = Lease(spark, root, "index", ttl=60, clock=lambda: now[0]).take()  # given back, so free; its driver dies
    with pytest.raises(AlreadyRunning):
        Lease(spark, root, "index", ttl=60, clock=lambda: now[0] + 59).take()
    after = Lease(spark, root, "index", ttl=60, clock=lambda: now[0] + 61).take()
    assert after.token == dead.token + 1
    store.upsert(scan(spark, [2]), "m:v1", lease=after)
    with pytest.raises(StaleLease):  # the dead one was only slow
        store.upsert(scan(spark, [3]), "m:v1", lease=dead)
    with pytest.raises(StaleLease):
        dead.renew()
    after.renew()
    assert sorted(r["media_id"] for r in store.catalog().collect()) == [1, 2]
    # two at once: one wins
    after.give_back()
    won, both = [], [Lease(spark, root, "index") for _ in range(2)]
    both[0]._last = both[1]._last = lambda: after.token
    for x in both:
        try:
            won.append(x.take().token)
        except AlreadyRunning:
            pass
    assert won == [after.token + 1]


def test_upserts_write_what_changed(spark, tmp_path):
    """The bytes of a small upsert stay the same when the catalog is four times as large."""
    wrote = {}
    for n in (2000, 8000):
        store = Store(spark, str(tmp_path / f"s{n}"), rows_per_bucket=100)
        rows = spark.range(n).select(F.col("id").alias("media_id"), F.lit("u").alias("uri"), F.lit("n").alias("display_name"), F.lit("m").alias("mime_type"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(10).cast("long").alias("size_bytes"), F.lit(5).cast("long").alias("date_added"), F.col("id").alias("date_modified"))
        store.upsert(rows, "m:v1")
        before = store.files.size(f"{store.root}/catalog")
        assert store.snapshot().buckets == n // 100
        store.upsert(rows.where("media_id < 5").withColumn("size_bytes", F.lit(11).cast("long")), "m:v1")
        wrote[n] = store.files.size(f"{store.root}/catalog") - before
        assert store.catalog().count() == n and store.catalog().where("size_bytes = 11").count() == 5 and store.snapshot().row_count() == n
        v = store.files.size(f"{store.root}/catalog")
        store.upsert(rows.where("media_id < 500"), "m:v1")  # the other rows of it are as they were
        assert store.files.size(f"{store.root}/catalog") - v < 8 * wrote[n]
        store.upsert(rows.where("media_id between 5 and 400"), "m:v1")
        assert store.catalog().count() == n
        v = store.files.size(f"{store.root}/catalog")
        store.upsert(rows.where("media_id between 5 and 400"), "m:v1")
        assert store.files.size(f"{store.root}/catalog") == v
    assert wrote[8000] < 1.3 * wrote[2000]
    # a catalog that outgrows its buckets is dealt anew
    store.upsert(rows.withColumn("media_id", F.col("media_id") + 10**6).union(rows.withColumn("media_id", F.col("media_id") + 2 * 10**6)), "m:v1")
    store.upsert(rows.where("media_id = 1").withColumn("size_bytes", F.lit(3).cast("long")), "m:v1")
    assert store.catalog().count() == 24_000 and store.snapshot().buckets == 240


def test_stream_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=2)
    for n, ids in enumerate(([1, 2], [2, 3])):
        scan(spark, ids, size=10 + n).write.parquet(str(tmp_path / "scan" / f"d{n}"))
        upsert_stream(spark, str(tmp_path / "scan" / "*"), store, "m:v1", str(tmp_path / "ck")).awaitTermination()
    assert {r["media_id"]: r["size_bytes"] for r in store.catalog().collect()} == {1: 10, 2: 11, 3: 11}
    v = store.version()
    upsert_stream(spark, str(tmp_path / "scan" / "*"), store, "m:v1", str(tmp_path / "ck")).awaitTermination()
    assert store.version() == v


def test_resumable_indexing(spark, tmp_path):
    """Stopped halfway, a run goes on without embedding a row twice; progress is told while it runs."""

    class Counting(HashEmbedder):
        """Leaves a file for every image it embeds; fails, as a lost driver would, where it is told to."""

        def __init__(self, folder, dim=4):
            super().__init__(dim)
            self.folder, self.key = str(folder), f"counting:{folder}"

        def embed(self, session, tensors):
            for t in tensors:
                with open(f"{self.folder}/{os.getpid()}", "a") as f:
                    f.write(f"{t[0]:.0f}\n")
            return super().embed(session, tensors)

        def seen(self):
            return sorted(int(x) for name in os.listdir(self.folder) for x in open(f"{self.folder}/{name}"))

    store, ck = Store(spark, str(tmp_path / "s"), rows_per_bucket=10), str(tmp_path / "ck")
    jobs.run_scan(store, scan(spark, range(40)), "m:v1")
    (tmp_path / "seen").mkdir()
    model, told, calls = Counting(tmp_path / "seen"), [], []
    listener = jobs.IndexProgress(store, ck, told.append)
    spark.streams.addListener(listener)

    def opened(todo):
        calls.append(todo.count())
        if len(calls) == 3:
            raise RuntimeError("the driver is lost")
        return images(spark, range(38))

    try:
        with pytest.raises(Exception, match="the driver is lost"):
            jobs.index_stream(store, opened, model, "m:v1", 7, ck, rows=10).awaitTermination()
        half = {r["status"]: r["count"] for r in store.catalog().groupBy("status").count().collect()}
        assert half["pending"] == 40 - sum(calls[:2]) and len(model.seen()) == len(set(model.seen()))
        jobs.index_stream(store, opened, model, "m:v1", 7, ck, rows=10).awaitTermination()
        jobs.index_stream(store, opened, model, "m:v1", 7, ck, rows=10).awaitTermination()  # nothing left
    finally:
        import time

        time.sleep(1)
        spark.streams.removeListener(listener)
    assert model.seen() == list(range(38)) and jobs.progress(store, ck).agg(F.sum("n"), F.sum("n_failed")).first()[:] == (40, 2)
    state = {r["status"]: r["count"] for r in store.catalog().groupBy("status").count().collect()}
    assert state == {"indexed": 38, "failed": 2} and store.vectors().count() == 38
    assert told[-1] == {"indexed": 38, "failed": 2, "pending": 0, "batches": 4} and any(0 < t["pending"] < 40 for t in told)


def test_scan_job(spark, tmp_path):
    """Full, nothing, and incremental scans; the anchor moves with the catalog or not at all."""
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=3)
    assert jobs.run_scan(store, scan(spark, []), "m:v1") == "full" and store.snapshot().anchor is None
    assert jobs.run_scan(store, scan(spark, range(5)), "m:v1") == "full" and store.snapshot().anchor == (104, 4)
    v = store.version()
    assert jobs.run_scan(store, scan(spark, range(5)), "m:v1") == "skip" and store.version() == v
    # one goes, one comes: equal counts take the short way, and the row that went stays (mode "full" finds it)
    assert jobs.run_scan(store, scan(spark, [1, 2, 3, 4, 5]), "m:v1") == "incremental" and store.snapshot().anchor == (105, 5)
    assert sorted(r["media_id"] for r in store.catalog().collect()) == [0, 1, 2, 3, 4, 5]
    assert jobs.run_scan(store, scan(spark, [1, 2, 3, 4, 5]), "m:v1") == "full" and store.catalog().count() == 5
    assert jobs.run_scan(store, scan(spark, [1, 2, 3, 4, 5]), "m:v1", mode="full") == "full"
    assert jobs.run_scan(store, scan(spark, [1, 2, 3, 4, 5]), "m:v2") == "full" and {r["model_version"] for r in store.catalog().collect()} == {"m:v2"}
    assert jobs.run_scan(store, scan(spark, [1, 2, 3, 4, 5]), "m:v2", forced=True) == "full"
    # a crash between scan and commit leaves both as they were
    before, publish = store.snapshot(), store.files.publish
    store.files.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        jobs.run_scan(store, scan(spark, [1, 2, 3, 4, 9]), "m:v2")
    store.files.publish = publish
    assert store.snapshot().manifest == before.manifest and store.catalog().where("media_id = 9").count() == 0
    assert jobs.run_scan(store, scan(spark, [1, 2, 3, 4, 9]), "m:v2") == "incremental" and store.snapshot().anchor == (109, 9)


def test_migration(spark, tmp_path):
    """A store of schema 1 reads as schema 2: absent state filled, the cache without model keys gone."""
    root = str(tmp_path / "s")
    store = Store(spark, root, rows_per_bucket=2)
    store.upsert(scan(spark, range(5)), "m:v1")
    old = store.snapshot().manifest
    for folder in {x[0] for x in old["catalog"].values()}:
        for name in os.listdir(f"{root}/{folder}"):
            if name.startswith("bucket="):
                spark.read.parquet(f"{root}/{folder}/{name}").drop("retry_count", "error", "vector_dim").write.parquet(f"{root}/catalog/old/{name}")
    spark.createDataFrame([("q", bytearray(8), 1)], "query_text string, embedding binary, created_at long").write.parquet(f"{root}/query_cache/old")
    first = {**old, "version": 2, "schema": 1, "catalog": {b: ["catalog/old", n] for b, (_, n) in old["catalog"].items()}, "cache": ["query_cache/old"]}
    assert store.files.publish(f"{root}/manifest/{2:012d}.json", first)
    s = store.snapshot()
    assert s.schema == 1 and s.query_cache().count() == 0 and s.catalog().columns == schemas.CATALOG_COLUMNS
    assert {(r["retry_count"], r["vector_dim"], r["error"]) for r in s.catalog().collect()} == {(0, 0, None)} and s.catalog().count() == 5
    store.upsert(scan(spark, [9]), "m:v1")
    s = store.snapshot()
    assert s.schema == schemas.SCHEMA_VERSION and s.catalog().count() == 6 and s.manifest["cache"] == [] and "catalog/old" not in {x[0] for x in s.manifest["catalog"].values()}
    assert store.files.publish(f"{root}/manifest/{s.version + 1:012d}.json", {**s.manifest, "version": s.version + 1, "schema": 99})
    with pytest.raises(NewerSchema):
        store.catalog()


def test_sessions():
    """Leases bound what a worker holds; release waits for the last lease."""
    open_now, most = set(), []

    def opened(name):
        def run():
            open_now.add(name)
            most.append(len(open_now))
            return name

        return run

    pool = SessionPool(bound=2)
    for k in "abcabcab":
        with pool.lease(k, opened(k), open_now.discard) as s:
            assert s == k and k in open_now
    assert max(most) == 2 and pool.most == 2 and len(pool.held) == 2
    one = SessionPool(bound=1)
    with one.lease("x", opened("x"), open_now.discard), one.lease("x", opened("x"), open_now.discard):
        assert one.opened == 1
        one.release("x")
        assert "x" in open_now
        with pytest.raises(TimeoutError), one.lease("y", opened("y"), open_now.discard, wait=0.05):
            pass
    assert "x" not in open_now and not one.held
    got = []
    with one.lease("x", opened("x"), open_now.discard):
        t = threading.Thread(target=lambda: one.lease("y", opened("y"), open_now.discard).__enter__() and got.append("y"))
        t.start()
        t.join(0.2)
        assert got == []
    t.join(5)
    assert got == ["y"] and "x" not in open_now and one.most == 1


def test_two_models_in_one_worker(spark, tmp_path):
    """Image models that take turns in reused workers stay within the bound."""

    class Noted(HashEmbedder):
        def __init__(self, name):
            super().__init__(4)
            self.key = f"noted:{name}:{tmp_path.name}"

        def embed(self, session, tensors):
            from lumenfold.operators.sessions import SESSIONS

            out = super().embed(session, tensors)
            out[:, 0] = len(SESSIONS.held)
            return out

    for k in range(4):
        rows = embed(images(spark, range(6)).coalesce(1), Noted(k), normalize=False).collect()
        assert max(r["embedding"][0] for r in rows) <= 2
    # the session of a worker is opened once, not for each task
    (tmp_path / "opened").mkdir()

    class Opened(HashEmbedder):
        key, folder = f"opened:{tmp_path.name}", str(tmp_path / "opened")

        def open(self):
            with open(f"{self.folder}/{os.getpid()}", "a") as f:
                f.write("x")

    for _ in range(3):
        embed(images(spark, range(6)).coalesce(1), Opened(4)).count()
    assert all(len(open(f"{Opened.folder}/{n}").read()) == 1 for n in os.listdir(Opened.folder))


def test_text_vectors(spark, tmp_path):
    """A table of texts through a real model: a second run embeds nothing, a new text only itself; the driver's session
    writes through to the same cache."""
    table = np.random.default_rng(1).standard_normal((12, 3)).astype(np.float32)
    (tmp_path / "t.onnx").write_bytes(text_model(table))
    (tmp_path / "t32.onnx").write_bytes(text_model(table, INT32))
    bpe, store = toy_bpe(), Store(spark, str(tmp_path / "s"))
    model = OnnxTextModel(str(tmp_path / "t.onnx"), "ids", "vector", 3)
    texts = spark.createDataFrame([(1, "low"), (2, "low lower!"), (3, "low"), (4, None), (5, "  "), (6, "LOW")], "qid long, query_text string")
    want = lambda t: (lambda v: v / np.linalg.norm(v))(table[bpe.encode(__import__("lumenfold.functions.text", fromlist=["x"]).pieces_of(t))].mean(axis=0).astype(np.float64))
    out = {r["qid"]: (r["query_text"], r["q"]) for r in jobs.embed_queries(store, texts, "m:v1", model, bpe, 5, batch=2).collect()}
    assert len(out) == 6 and out[4][1] is None and out[5][1] is None
    assert all(np.allclose(q, want(t), atol=1e-6) for t, q in out.values() if q is not None) and out[1][1] == out[3][1]
    assert store.snapshot().query_cache().count() == 3

    class Broken(OnnxTextModel):
        def embed(self, session, ids):
            raise RuntimeError("must not be asked")

    broken, v = Broken(str(tmp_path / "t.onnx"), "ids", "vector", 3), store.version()
    again = {r["qid"]: (r["query_text"], r["q"]) for r in jobs.embed_queries(store, texts, "m:v1", broken, bpe, 6).collect()}
    assert again == out and store.version() == v
    with pytest.raises(Exception, match="must not be asked"):
        jobs.embed_queries(store, texts, "m:v2", broken, bpe, 6).collect()
    # the same by int32 ids, for another model key
    model32 = OnnxTextModel(str(tmp_path / "t32.onnx"), "ids", "vector", 3, "INT32")
    assert np.allclose({r["qid"]: r["q"] for r in jobs.embed_queries(store, texts, "m:v3", model32, bpe, 7).collect()}[2], out[2][1])
    # the driver's session
    session = TextSession(keep=jobs.write_through(store, lambda: 9))
    session.preload("m:v1", model, bpe, store.snapshot().query_cache())
    assert session.vector("low") == pytest.approx(out[1][1]) and store.snapshot().query_cache().where("created_at = 9").count() == 0
    session.vector("lower")
    held = store.snapshot().query_cache().where("created_at = 9").collect()
    assert [(r["query_text"], r["model_key"]) for r in held] == [("lower", "m:v1")] and np.frombuffer(held[0]["embedding"], "<f4").tolist() == session.vector("lower")
    fails = TextSession(keep=lambda *a: (_ for _ in ()).throw(OSError("full")))
    fails.preload("m:v1", model, bpe)
    with pytest.warns(UserWarning, match="full"):
        assert len(fails.vector("low")) == 3
    jobs.evict(store, 4)
    kept = store.snapshot().query_cache().collect()
    assert len(kept) == 4 and ("lower", 9) in {(r["query_text"], r["created_at"]) for r in kept}
    # from text to photos
    rows = spark.createDataFrame([(i, "u", "n", "m", 1, 1, 1, 1, i, "indexed", i * 12, 3, 1, "m:v1", None, 0) for i in range(2)], schemas.CATALOG)
    vectors = spark.createDataFrame([(0, 0, [float(x) for x in want("low")]), (1, 12, [float(-x) for x in want("low")])], "media_id long, vector_offset long, embedding array<float>")
    assert [r["media_id"] for r in search_text(rows, vectors, session, "low", 2, 0.5).collect()] == [0]


def test_onnx_images(spark, tmp_path):
    (tmp_path / "i.onnx").write_bytes(image_model(3, 2, 2))
    rng = np.random.default_rng(2)
    t = rng.standard_normal((5, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(t)] + [(9, [1.0])], "media_id long, tensor array<float>")
    got = {r["media_id"]: r for r in embed(df.coalesce(1), OnnxEmbedder(str(tmp_path / "i.onnx"), "pixels", "vector", 3, (3, 2, 2)), batch=2, normalize=False).collect()}
    assert all(np.allclose(got[i]["embedding"], t[i].reshape(3, 4).mean(axis=1), atol=1e-6) for i in range(5)) and got[9]["error"]
    wrong = embed(df.limit(1), OnnxEmbedder(str(tmp_path / "i.onnx"), "pixels", "vector", 4, (3, 2, 2))).first()
    assert wrong["embedding"] is None and "dimension 3" in wrong["error"]


@pytest.mark.parametrize("threshold", [0.0, 0.6])
def test_blocks(spark, tmp_path, threshold):
    """Packed blocks find the rows that list columns do, ties and NaN as well, and skip blocks of short vectors."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 8)) * np.repeat([3.0, 1.0, 0.01], 1000)[:, None]
    rows = [(i, i * 32, np.round(x, 2).tolist()) for i, x in enumerate(v)] + [(5000 + i, 10**6 + i, [1.0] * 8) for i in range(30)]
    rows += [(9000, 1, None), (9001, 2, [math.nan] * 8), (9002, 3, [1.0] * 5), (9003, 4, [0.0] * 8), (9004, 5, [])]
    df = spark.createDataFrame(rows, "media_id long, vector_offset long, embedding array<float>").coalesce(3)
    queries = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(6)] + [(6, [1.0] * 8), (7, [1.0] * 5), (8, None), (9, [0.0] * 8)], "qid long, q array<double>")
    packed = blocks.pack(df, 128)
    assert packed.agg(F.sum("n")).first()[0] == 3000 + 30 + 3 and packed.agg(F.max("n")).first()[0] <= 128 + 128
    found, told = blocks.search_blocks(packed, queries, 20, threshold)
    key = lambda r: (r["qid"], r["rank"], r["media_id"], r["score"])
    want = search.top_k_many(df, queries.where("q is not null"), 20)
    want = want.where(F.col("score") >= threshold) if threshold else want
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
    t = told.first()
    assert t["pairs"] > 0 and 0 < t["skipped"] < t["pairs"]
    # blocks of a vector file are byte ranges of it
    live = df.where("media_id < 6000")
    vectorfile.append(live, str(tmp_path / "f"), 8)
    stored, _ = blocks.search_blocks(blocks.file_blocks(spark, str(tmp_path / "f"), 100, 1000), queries.where("qid < 7"), 5)
    plain = search.top_k_many_numpy(vectorfile.source(spark).load(str(tmp_path / "f")), queries.where("qid < 7"), 5)
    assert sorted(map(key, stored.collect())) == sorted(map(key, plain.collect()))
    assert blocks.search_blocks(packed.limit(0), queries, 3)[0].count() == 0 and blocks.search_blocks(packed, queries, 0)[0].count() == 0


def test_search_of_a_saved_index_in_json(spark, tmp_path):
    """A manifest is plain JSON that names what a version holds."""
    store = Store(spark, str(tmp_path / "s"), rows_per_bucket=2)
    jobs.run_scan(store, scan(spark, range(5)), "m:v1")
    names = sorted(os.listdir(tmp_path / "s" / "manifest"))
    told = json.loads((tmp_path / "s" / "manifest" / [n for n in names if n.endswith(".json") and not n.startswith(".")][-1]).read_text())
    assert told["version"] == 1 and sum(n for _, n in told["catalog"].values()) == 5 and told["anchor"] == [104, 4] and told["model"] == "m:v1"
