"""Jobs around the index: scan, index, retry, rebuild, text queries. Each commits to the store by a change that is made
again if another was first, so jobs may run side by side; under a lease (plans/leases.py) only one of a name does."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lumenfold.functions.text import Bpe
from lumenfold.operators.cache import newest
from lumenfold.operators.catalog import sync_full
from lumenfold.operators.embed import Embedder
from lumenfold.operators.integrity import audit
from lumenfold.operators.textquery import TextModel, embed_new_texts, with_vectors
from lumenfold.plans.indexing import FULL, INCREMENTAL, Images, embed_rows, marked, place, plan_scan
from lumenfold.plans.leases import AlreadyRunning, Lease, StaleLease, single_flight
from lumenfold.plans.store import Edit, Snapshot, Store, bucket_of
from lumenfold.schemas import FAILED, PENDING, QUERY_CACHE, SCAN_COLUMNS
from lumenfold.sources.files import work_path
from lumenfold.sources.scan import newer_than

__all__ = ["AlreadyRunning", "Lease", "StaleLease", "single_flight"]
PROGRESS = "batch long, n long, n_ok long, n_failed long, version long"


class Rebuilt(RuntimeError):
    """The index was rebuilt while rows were embedded; they are pending anew."""


def run_scan(store: Store, source: DataFrame, model: str, forced: bool = False, mode: str = "parity", lease: Lease | None = None) -> str:
    """Scans a source as plan_scan() says: all of it, what is newer than the anchor, or nothing. The anchor (the newest row)
    is part of the commit that holds the scanned rows, so a crash leaves both as they were. Returns the decision."""
    rows = source.select(*SCAN_COLUMNS).withColumn("date_modified", F.coalesce("date_modified", F.lit(0).cast("long")))
    n, top = rows.agg(F.count("*"), F.max(F.struct("date_modified", "media_id"))).first()
    latest = None if top is None else (top[0], top[1])
    base = store.snapshot()
    decision = plan_scan(forced, base.row_count(), base.model not in (None, model), base.anchor, n, latest, mode)
    values = {"model": model} | ({"anchor": list(latest)} if latest else {})
    if decision == FULL:
        store.change(lambda s: Edit(sync_full(rows, s.catalog(), model), expect=n, values=values), lease=lease)
    elif decision == INCREMENTAL:
        store.upsert(rows.where(newer_than(*base.anchor)), model, lease=lease, anchor=values.get("anchor"))
    return decision


def index_rows(store: Store, todo: Callable[[Snapshot], DataFrame], images: Images, embedder: Embedder, model: str, now: int, batch: int = 8, granularity: str = "record", normalize: bool = True, key: tuple[str, int] | None = None, lease: Lease | None = None) -> dict[str, int]:
    """Embeds the rows that todo picks from the catalog, appends their vectors and marks the rows: one job, one commit.
    Counts of what was done; a key that was committed before does nothing."""
    base = store.snapshot()
    if key is not None and base.keys.get(key[0], -1) >= key[1]:
        return {"n": 0, "n_ok": 0, "n_failed": 0, "version": base.version}
    rows = todo(base)
    done = embed_rows(rows, images, embedder, batch, granularity, normalize)
    n, n_ok = done.agg(F.count("*"), F.count_if(F.col("error").isNull())).first()
    path = work_path(store.spark, "placed")
    placed = place(done, rows, base.vector_file, embedder.dim)
    placed.write.parquet(path)
    placed = store.spark.read.schema(placed.schema).parquet(path)

    def edit(s: Snapshot) -> Edit | None:
        if s.vector_file != base.vector_file:
            raise Rebuilt("the vector file was replaced")
        touched = sorted(r[0] for r in placed.select(bucket_of(s.buckets)).distinct().collect())
        return Edit(marked(s.catalog(touched), placed, model, now), touched, alone=True) if touched else Edit()

    version = store.change(edit, key, lease)
    for gone in (done.staged_at, path):
        store.files.delete(gone)
    return {"n": n, "n_ok": n_ok, "n_failed": n - n_ok, "version": version}


def index_pending(store: Store, images: Images, embedder: Embedder, model: str, now: int, **options: Any) -> dict[str, int]:
    """All pending rows in one job."""
    return index_rows(store, lambda s: s.catalog().where(F.col("status") == PENDING), images, embedder, model, now, **options)


def retry_failed(store: Store, images: Images, embedder: Embedder, model: str, now: int, media_id: int | None = None, **options: Any) -> dict[str, int]:
    """All failed rows, or one, go straight to indexing; a success keeps the number of retries, a failure adds one."""
    on = F.col("status") == FAILED
    return index_rows(store, lambda s: s.catalog().where(on if media_id is None else on & (F.col("media_id") == media_id)), images, embedder, model, now, **options)


def index_stream(store: Store, images: Images, embedder: Embedder, model: str, now: int, checkpoint: str, rows: int = 100_000, lease: Lease | None = None, **options: Any) -> StreamingQuery:
    """Indexes the pending rows in micro-batches of about `rows`, each a commit and a row of progress, and stops.

    The ids that are pending at the start are written under the checkpoint, a file for each micro-batch. Started again with
    the same checkpoint after a stop or crash, it goes on behind the last batch that was committed: only rows that are
    still pending are embedded. A table of images is scanned for each micro-batch; give a function that opens the batch's
    own where it is large.
    """
    todo = f"{checkpoint.rstrip('/')}/todo"
    if "_SUCCESS" not in store.files.names(todo):
        pending = store.catalog().where(F.col("status") == PENDING).select("media_id")
        pending.repartition(max(1, -(-pending.count() // rows)), "media_id").write.mode("overwrite").parquet(todo)

    def take(some: DataFrame, number: int) -> None:
        ids = some.select("media_id")

        def still(s: Snapshot) -> DataFrame:
            held = s.catalog(r[0] for r in ids.select(bucket_of(s.buckets)).distinct().collect())
            return held.where(F.col("status") == PENDING).join(ids, "media_id", "left_semi")

        told = index_rows(store, still, images, embedder, model, now, key=(checkpoint, number), lease=lease, **options)
        if told["n"]:
            line = store.spark.createDataFrame([(number, told["n"], told["n_ok"], told["n_failed"], told["version"])], PROGRESS)
            line.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}/progress/batch={number}")

    stream = store.spark.readStream.schema("media_id long").option("maxFilesPerTrigger", 1).parquet(todo)
    return stream.writeStream.queryName(f"index-{uuid.uuid4().hex}").foreachBatch(take).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").trigger(availableNow=True).start()


def progress(store: Store, checkpoint: str) -> DataFrame:
    """batch, n, n_ok, n_failed, version of each micro-batch that index_stream() has committed."""
    root = f"{checkpoint.rstrip('/')}/progress"
    batches = [n for n in store.files.names(root) if "_SUCCESS" in store.files.names(f"{root}/{n}")]
    return store.spark.read.schema(PROGRESS).parquet(*[f"{root}/{n}" for n in batches]) if batches else store.spark.createDataFrame([], PROGRESS)


class IndexProgress(StreamingQueryListener):
    """Tells the totals after each micro-batch of an index stream: add it to spark.streams before the start.

    told gets indexed, failed, pending and batches so far."""

    def __init__(self, store: Store, checkpoint: str, told: Callable[[dict[str, int]], None]):
        self.store, self.checkpoint, self.told = store, checkpoint, told

    def onQueryStarted(self, event) -> None:
        self._tell()

    def onQueryProgress(self, event) -> None:
        self._tell()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell()

    def _tell(self) -> None:
        done = progress(self.store, self.checkpoint).agg(F.count("*").alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_ok", "n_failed")]).first()
        todo = self.store.spark.read.parquet(f"{self.checkpoint.rstrip('/')}/todo").count()
        self.told({"indexed": done["n_ok"], "failed": done["n_failed"], "pending": max(todo - done["n"], 0), "batches": done["batches"]})


def rebuild(store: Store, scan: DataFrame, model: str, lease: Lease | None = None) -> int:
    """Everything is pending anew: an empty catalog, a new vector file, no query cache, a full scan."""
    rows = scan.select(*SCAN_COLUMNS)
    top = rows.agg(F.max(F.struct("date_modified", "media_id"))).first()[0]
    values = {"vectors": f"vectors/{uuid.uuid4().hex}", "cache": [], "model": model, "anchor": None if top is None else [top[0], top[1]]}
    return store.change(lambda s: Edit(sync_full(rows, s.catalog([]), model), expect=rows.count(), values=values), lease=lease)


def rebuild_if_corrupt(store: Store, scan: DataFrame, model: str, file_length: int) -> bool:
    """Audits the catalog before a scan; tells whether it was rebuilt."""
    corrupt = bool(audit(store.catalog(), file_length).first()["is_corrupt"])
    if corrupt:
        rebuild(store, scan, model)
    return corrupt


def embed_queries(store: Store, texts: DataFrame, key: str, model: TextModel, bpe: Bpe, now: int, keep: int | None = None, **options: Any) -> DataFrame:
    """texts (query_text and more) with q, their vectors. Texts that the cache lacks are embedded and added to it in one
    commit, so a second run embeds nothing; then, with keep, the cache is cut to its newest rows."""
    folder = f"query_cache/{uuid.uuid4().hex}"
    new = embed_new_texts(texts, store.snapshot().query_cache(), key, model, bpe, now, **options)
    new.write.parquet(f"{store.root}/{folder}")
    written = store.spark.read.schema(QUERY_CACHE).parquet(f"{store.root}/{folder}")
    if written.isEmpty():
        store.files.delete(f"{store.root}/{folder}")
    else:
        store.change(lambda s: Edit(values={"cache": [*s.manifest["cache"], folder]}))
    out = with_vectors(texts, store.snapshot().query_cache(), key)
    if keep is not None:
        evict(store, keep)
    return out


def evict(store: Store, keep: int) -> None:
    """Cuts the query cache to its newest rows over all models, in a folder of its own; readers of older versions keep theirs."""

    def edit(s: Snapshot) -> Edit | None:
        if s.query_cache().count() <= keep:
            return None
        folder = f"query_cache/{uuid.uuid4().hex}"
        newest(s.query_cache(), keep).write.parquet(f"{store.root}/{folder}")
        return Edit(values={"cache": [folder]})

    store.change(edit)


def write_through(store: Store, now: Callable[[], int]) -> Callable[[str, str, list[float]], None]:
    """What a TextSession calls with each vector that it has computed: the vector goes to the store's query cache."""
    import numpy as np

    def keep(text: str, key: str, vector: list[float]) -> None:
        folder = f"query_cache/{uuid.uuid4().hex}"
        row = (text, key, bytearray(np.asarray(vector, "<f4").tobytes()), now())
        store.spark.createDataFrame([row], QUERY_CACHE).coalesce(1).write.parquet(f"{store.root}/{folder}")
        store.change(lambda s: Edit(values={"cache": [*s.manifest["cache"], folder]}))

    return keep


def batch_progress(done: DataFrame) -> DataFrame:
    """One row for each batch of embed()'s result: n, n_ok, n_failed; the input of the running counters."""
    return done.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
