"""Goldens for the catalog, search, audit, tokeniser, tensors, planner, caches and ingestion."""

import itertools
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold import schemas
from lumenfold.functions import imaging, scalars, text, vectors
from lumenfold.operators import cache, catalog, embed, integrity, search, telemetry
from lumenfold.plans.indexing import FULL, INCREMENTAL, SKIP, plan_scan
from lumenfold.queries import TOY
from lumenfold.sources import files, scan


def rows(spark, items, model="m:v1"):
    data = [(i, f"u{i}", None, None, 0, 0, size, 0, dm, status, -1, 0, 0, model, "e" if status == "failed" else None, retry) for i, dm, size, status, retry in items]
    return spark.createDataFrame(data, schemas.CATALOG)


def scanned(spark, items):
    return spark.createDataFrame([(i, f"u{i}", None, None, 0, 0, size, 0, dm) for i, dm, size in items], schemas.SCAN)


def test_sync_and_upsert(spark):
    old = rows(spark, [(1, 100, 10, "indexed", 0), (2, 100, 10, "failed", 2), (3, 100, 10, "indexed", 0), (4, 100, 10, "pending", 0)])
    new = scanned(spark, [(1, 100, 10), (2, 100, 11), (4, 101, 10), (5, 100, 10)])
    full = {r["media_id"]: r for r in catalog.sync_full(new, old, "m:v1").collect()}
    assert {k: v["status"] for k, v in full.items()} == {1: "indexed", 2: "pending", 4: "pending", 5: "pending"}
    assert full[2]["retry_count"] == 0 and full[2]["error"] is None
    assert catalog.deleted_by_sync(new, old).count() == 1
    up = catalog.upsert(new, old, "m:v1")
    assert up.count() == 5 and catalog.changed_rows(new, old, "m:v1").count() == 3
    assert catalog.changed_rows(new, up, "m:v1").count() == 0
    assert {r["status"] for r in catalog.sync_full(new, old, "m:v2").collect()} == {"pending"}
    with pytest.raises(catalog.SourceUnavailable):
        catalog.sync_full(new, old, "m:v1", source_available=False)


def test_failure_then_success(spark):
    old = rows(spark, [(1, 1, 1, "failed", 2)])
    bad = catalog.mark_failed(old, spark.createDataFrame([(1, "x" * 500)], "media_id long, message string"))
    r = bad.first()
    assert (r["retry_count"], len(r["error"])) == (3, 400)
    ok = catalog.mark_indexed(bad, spark.createDataFrame([(1, 0, 4)], "media_id long, vector_offset long, vector_dim int"), "m:v1", 9).first()
    assert (ok["status"], ok["error"], ok["retry_count"]) == ("indexed", None, 3)


def test_top_k(spark):
    v = [(10, 0, [1.0, 0, 0, 0]), (11, 16, [0.6, 0.8, 0, 0]), (12, 32, [0.0] * 4), (13, 48, [-1.0, 0, 0, 0]), (14, 64, [1.0, 0, 0]), (15, 76, [0.6, 0, 0.8, 0]), (16, 92, [math.nan] * 4)]
    df = spark.createDataFrame([(i, o, [float(x) for x in e]) for i, o, e in v], "media_id long, vector_offset long, embedding array<float>")
    ids = lambda k, t: [r[0] for r in search.top_k(df, [1.0, 0, 0, 0], k, t).collect()]
    assert ids(3, 0) == [10, 11, 15] and ids(10, 0) == [10, 11, 15, 12, 13] and ids(10, 0.6) == [10, 11, 15] and ids(1, 0.5) == [10] and ids(0, 0) == []
    assert search.compared(df, 4).first()[0] == 6
    many = search.top_k_many_numpy(df, [(1, [1.0, 0, 0, 0])], 3).orderBy("rank").collect()
    assert [r["media_id"] for r in many] == [10, 11, 15]
    assert "TakeOrderedAndProject" in search.top_k(df, [1.0, 0, 0, 0], 3)._jdf.queryExecution().executedPlan().toString()


def test_bpe_of_tables(spark, tmp_path, monkeypatch):
    import json

    import public_tokenizers

    from lumenfold.queries import QUERIES

    monkeypatch.setattr(text, "MEMO", 3, raising=False)
    texts = [None, "", " \n", "Hello, WORLD 123!! it's", "größer 日本語 été ñandú", "x" * 3000 + " y", "the quick brown fox " * 400, "<|endoftext|> a_b <|StartOfText|>", "a\u200bb ²½ İ"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "Hi there"), (1, 1, "x", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "some words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["table"], r["id"], r["turn"]): r["ids"] for r in QUERIES["bpe_encode_texts"](spark, str(tmp_path)).collect()}
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    letters = text.byte_alphabet()

    def brute(t):
        kind = lambda c: "L" if unicodedata.category(c)[0] == "L" else "N" if unicodedata.category(c)[0] == "N" else " " if c.isspace() else "o"
        ids = []
        for part in re.split(r"(<\|startoftext\|>|<\|endoftext\|>)", t.lower()):
            whole = part in ("<|startoftext|>", "<|endoftext|>")
            for p in [part] if whole else ["".join(g) for k, g in itertools.groupby(part, kind) if k != " "]:
                w = [letters[b] for b in p.encode()]
                w[-1:] = [w[-1] + "</w>"] if w else []
                while pairs := [(rank[x], i) for i, x in enumerate(zip(w, w[1:])) if x in rank]:
                    i = min(pairs)[1]
                    w[i : i + 2] = [w[i] + w[i + 1]]
                ids += [model["vocab"][x] for x in w if x in model["vocab"]]
        start, end = 49406, 49407
        return ([start, *ids][:76] + [end] + [0] * 77)[:77]

    assert len(got) == 12 and got["conversations", 1, 1] is None and got["documents", 7, None] == brute("some words") and got["conversations", 1, 0] == brute("Hi there")
    for i, t in enumerate(texts):
        assert got["benchmark", i, None] == (None if t is None else brute(t)), t
    bpe = text.Bpe(TOY.vocab, TOY.merges)
    assert [bpe.piece(p) for p in ("low", "lo", "w", "o", "low")] == [[5], [4], [3], [], [5]] or len(bpe.memo) <= 3
    assert len(bpe.memo) <= 3


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "SCORES", 60, raising=False)
    v = [(i, (i * 37 % 90) * 16, [float(i * m % 5 - 2) for m in (1, 3, 7, 11)][: 3 if i % 10 == 9 else 4]) for i in range(90)] + [(900, 0, None), (901, 8, [math.nan] * 4)]
    q = [(100 + i, [float(i * m % 7 - 3) for m in (2, 3, 5, 9)][: 3 if i % 4 == 3 else 4]) for i in range(23)]
    df, queries = spark.createDataFrame(v, "media_id long, vector_offset long, embedding array<float>"), spark.createDataFrame(q, "qid long, q array<float>")
    want = []
    for qid, x in q:
        scores = sorted((-sum(a * b for a, b in zip(x, e, strict=True)), o, i) for i, o, e in v if e is not None and i < 900 and len(e) == len(x))
        want += [(qid, i, -s, rank + 1) for rank, (s, _, i) in enumerate(scores[:4])]
    for got in (search.top_k_many(df, queries, 4), search.top_k_many_numpy(df, queries, 4), search.top_k_many_numpy(df, q, 4)):
        assert sorted((r["qid"], r["rank"]) for r in got.collect()) == sorted((a, d) for a, _, _, d in want)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_many_multiplies_matrices(spark):
    """No pair is a row; null ids, null queries and ties at the k-th place come out as in SQL."""
    v = [(i if i % 7 else None, i % 5 * 8 if i % 11 else None, [float(i % 3), float(i % 4)] if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(v, "media_id long, vector_offset long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.5]), (2, [-1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "qid long, q array<double>")
    got = search.top_k_many(df, queries, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "zip_with" not in plan
    want = []
    for qid, q in ((1, (1.0, 0.5)), (2, (-1.0, 2.0)), (4, (0.0, 0.0))):
        best = sorted((-(q[0] * e[0] + q[1] * e[1]), -1 if o is None else o, -1 if m is None else m) for m, o, e in v if e)[:7]
        want += [(qid, None if m < 0 else m, -s + 0.0, rank + 1) for rank, (s, _, m) in enumerate(best)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert search.top_k_many(df, queries, 0).count() == 0


def test_integrity(spark):
    data = [(1, 0, 4, "indexed"), (2, 16, 4, "indexed"), (3, 16, 4, "indexed"), (4, 48, 8, "indexed"), (5, 2, 4, "indexed"), (6, -1, 0, "indexed"), (7, -1, 0, "pending")]
    df = spark.createDataFrame(data, "media_id long, vector_offset long, vector_dim int, status string")
    r = integrity.audit(df, 64).first()
    assert (r["indexed_vector_count"], r["invalid_record_count"], r["duplicate_offset_groups"], r["duplicate_offset_rows"], r["is_corrupt"]) == (5, 3, 1, 2, True)
    assert [x[0] for x in integrity.loadable(df.where("vector_offset >= 0"), 64).orderBy("media_id").collect()] == [1, 2, 3]
    assert integrity.audit(df.limit(0), 64).first()["is_corrupt"] is False


def test_offsets_by_ranges(spark):
    ids = [i * 7919 % 1009 for i in range(500)] + [5, 5, 5]
    out = integrity.assign_offsets(spark.createDataFrame([(i,) for i in ids], "media_id long"), 1024, 64)
    assert sorted((r["vector_offset"], r["media_id"]) for r in out.collect()) == [(1024 + k * 256, i) for k, i in enumerate(sorted(ids))]
    assert out.columns == ["media_id", "vector_offset", "vector_dim"] and "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert integrity.assign_offsets(spark.createDataFrame([], "media_id long"), 0, 64).count() == 0


def test_vectors_and_scalars(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    blob = df.select(vectors.from_blob(vectors.to_blob(F.col("v")))).first()[0]
    assert list(blob) == [3.0, 4.0]
    assert spark.range(1).select(vectors.from_blob(F.lit(b"abc"))).first()[0] is None
    assert spark.range(1).select(scalars.string_hash_hex(F.lit("hello"))).first()[0] == format(99162322, "x")
    assert spark.range(1).select(scalars.shown(F.lit(None).cast("double"), "%.2f")).first()[0] == "--"


def test_tokeniser(spark):
    assert TOY.encode(["low", "lower", "!"]) == [10, 5, 9, 6, 7, 8, 11, 0, 0, 0] and TOY.piece("lox") == [4]
    assert text.Bpe(TOY.vocab, TOY.merges, max_length=5).encode(["low", "lower", "!"]) == [10, 5, 9, 6, 11]
    got = spark.createDataFrame([("Don't  café 2024 ½ a b <|startoftext|>x!! 日本語",)], "t string").select(text.pretokenize(F.col("t"))).first()[0]
    assert list(got) == ["don", "'", "t", "café", "2024", "½", "a", "b", "<|startoftext|>", "x", "!!", "日本語"]
    a = text.byte_alphabet()
    assert len(set(a)) == 256 and a[0xAD] == "Ń" and a[0x20] == "Ġ"
    assert files.merges_from_lines(["#v", "a b", "", "bad", "c d"]) == {("a", "b"): 0, ("c", "d"): 2}


def test_images(spark):
    df = spark.createDataFrame([([-65536, 128],)], "p array<int>")
    zero, one = F.array(F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    nchw = [round(x, 6) for x in df.select(imaging.tensor(F.col("p"), zero, one)).first()[0]]
    assert nchw == [1, 0, 0, 0, 0, 0.501961]
    same = df.select(imaging.resize(F.col("p"), F.lit(2), F.lit(1), 2, 1)).first()[0]
    assert list(same) == [-65536, 128]


def test_planner_and_cache(spark):
    assert plan_scan(False, 0, False, (1, 1), 5, (1, 1)) == FULL and plan_scan(False, 5, False, (1, 1), 5, (1, 1)) == SKIP
    assert plan_scan(False, 5, False, (1, 1), 5, (2, 1)) == INCREMENTAL and plan_scan(False, 5, False, (1, 1), 6, (2, 1)) == FULL
    c = spark.range(1, 102).select(F.col("id").cast("string").alias("query_text"), F.lit("m").alias("model_key"), F.lit(b"").alias("embedding"), F.col("id").alias("created_at"))
    kept = cache.put(c.limit(0), c)
    assert kept.count() == 100 and kept.agg(F.min("created_at")).first()[0] == 2
    lru = cache.QueryCache(2)
    for k in "ab":
        lru.put(k, [1.0])
    lru.get("a")
    lru.put("c", [1.0])
    assert lru.get("b") is None and lru.get("a") == [1.0]
    keyset = spark.createDataFrame([(5, 100), (6, 100), (1, 101), (9, 99)], "media_id long, date_modified long").where(scan.newer_than(100, 5))
    assert sorted(r[0] for r in keyset.collect()) == [1, 6]


def test_telemetry(spark):
    b = spark.createDataFrame([(0, 1, 8, 1000, 1500, 0), (0, 2, 8, 1500, 2100, 0)], "run_id long, batch_id long, n long, started_ms long, completed_ms long, infer_ms long")
    got = telemetry.throughput(telemetry.wall_times(b)).orderBy("batch_id").collect()
    assert [r["wall_ms"] for r in got] == [500, 600] and round(got[1]["e2e_ips"], 3) == 13.333 and got[0]["infer_ips"] is None


def test_settings(spark, tmp_path):
    from lumenfold.plans.settings import Settings

    s = Settings(spark, str(tmp_path))
    assert s.get("threshold") == 0.0 and s.get("other") is None
    s.put(threshold=0.9, preload_text=True)
    s.put(threshold=-1.0)
    assert (s.get("threshold"), s.get("preload_text")) == (0.0, True)
    s.put(threshold=0.9)
    assert s.get("threshold") == 0.5


def test_batch_progress(spark):
    from lumenfold.operators.embed import HashEmbedder, embed
    from lumenfold.plans import jobs

    images = spark.createDataFrame([(i, [float(i)] * 4) for i in range(5)], "media_id long, tensor array<float>")
    done = embed(images.repartition(3), HashEmbedder(4, fails_below=2.0), batch=2)
    rows = jobs.batch_progress(done).collect()
    assert sum(r["n"] for r in rows) == 5 and max(r["n"] for r in rows) <= 2 and sum(r["n_failed"] for r in rows) == 2
    whole = jobs.batch_progress(embed(images.coalesce(1), HashEmbedder(4, fails_below=2.0), batch=5, granularity="batch")).collect()
    assert [(r["n"], r["n_ok"]) for r in whole] == [(5, 0)]


def test_vector_cache(spark):
    from lumenfold.operators.search import CorruptIndex, VectorCache

    rows = spark.createDataFrame([(i, "u", "n", "m", 1, 1, 1, 1, i, "indexed", i * 16, 4, 1, "m:v1", None, 0) for i in range(5)], schemas.CATALOG)
    stored = spark.createDataFrame([(i, i * 16, [1.0] * 4) for i in range(5)], schemas.VECTORS)
    cache, length = VectorCache(), 5 * 16
    vectors = cache.checked(rows, stored, length)
    assert vectors.count() == 5 and cache.checked(rows, stored, length) is vectors
    with pytest.raises(CorruptIndex):
        cache.checked(rows, stored.where("media_id > 2"), length + 4)
    with pytest.raises(CorruptIndex):
        cache.checked(rows, stored, 16)
    assert cache.vectors is None


def test_text_query(spark):
    from lumenfold.functions.text import Bpe, pieces_of, pretokenize
    from lumenfold.operators.textquery import TextSession, search_text

    class Model:
        dim, opened, asked = 2, 0, []

        def open(self):
            Model.opened += 1

        def embed(self, session, ids):
            Model.asked.append(ids.tolist())
            return np.array([[3.0, 4.0]])

    bpe = Bpe({"<|startoftext|>": 10, "<|endoftext|>": 11, "l": 0, "o": 1, "w</w>": 3, "lo": 4, "low</w>": 5}, {("l", "o"): 0, ("lo", "w</w>"): 1}, max_length=5)
    session = TextSession()
    with pytest.raises(RuntimeError):
        session.vector("low")
    for _ in range(2):
        session.preload("m:v1", Model(), bpe)
    assert session.vector("LOW") == session.vector("LOW") == pytest.approx([0.6, 0.8]) and Model.opened == 1 and Model.asked == [[[10, 5, 11, 0, 0]]]
    rows = spark.createDataFrame([(i, "u", "n", "m", 1, 1, 1, 1, i, "indexed", i * 8, 2, 1, "m:v1", None, 0) for i in range(3)], schemas.CATALOG)
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.6, 0.8], 8), (2, [0.0, 1.0], 16)], "media_id long, embedding array<float>, vector_offset long")
    assert [r["media_id"] for r in search_text(rows, vectors, session, "LOW", 2).collect()] == [1, 2]
    assert [r["media_id"] for r in search_text(rows, vectors, session, "  ").collect()] == [2, 1, 0]
    session.preload("m:v2", Model(), bpe)
    assert Model.opened == 2 and session.cache.get("LOW") is None
    odd = ["Don't  café 2024 ½ a\u00a0b <|startoftext|>x!! 日本語", "", "\t\u2003a_b\x85c"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(pretokenize(F.col("t")).alias("p")).collect()
    assert [list(r["p"]) for r in got] == [pieces_of(t) for t in odd]


def test_model_entries(spark, tmp_path):
    import json

    from lumenfold.operators import models
    from lumenfold.sources import files

    assert models.write_templates(spark, {"a": {"id": "a"}, "b": {"id": "b"}}, str(tmp_path)) == ["a", "b"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "model.json").write_text("{ not json")
    assert models.write_templates(spark, {"a": {"id": "x"}, "b": {}}, str(tmp_path)) == [] and json.loads((tmp_path / "a" / "model.json").read_text()) == {"id": "a"}
    configs = {r["directory"]: r["parse_error"] for r in files.model_configs(spark, str(tmp_path)).collect()}
    assert configs["c"] == "malformed JSON" and configs["a"].startswith("missing: displayName")
    s = "id string, embedding_dim int, text_encoder string, image_file string"
    t = spark.createDataFrame([("known", 256, None, "i.onnx")], s)
    f = spark.createDataFrame([("known", None, None, None, True, "malformed JSON"), ("odd", None, None, None, True, "malformed JSON"), ("fine", 64, "t", "j.onnx", True, None)], s + ", found boolean, parse_error string")
    got = {r["id"]: (r["embedding_dim"], r["image_pixels"], r["found"]) for r in models.with_fallback(models.merge_registry(t, f)).collect()}
    assert got == {"known": (256, None, False), "odd": (512, 224, False), "fine": (64, None, True)}
    assert [r["id"] for r in models.backend_list(spark, "qnn").collect()] == ["ort_qnn_pkg_cpu_auto_threads", "qnn_htp"]
    assert [r["id"] for r in models.backend_list(spark, "other").collect()][1] == "ort_nnapi_cpu_disabled"
    rows = spark.createDataFrame([("b", True), ("a", False)], "id string, available boolean")
    assert models.chosen(rows, "a").first()["id"] == "a" and models.chosen(rows, "none").first()["id"] == "b"


def test_file_length(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(b"x" * 10)
    assert files.file_length(spark, str(tmp_path / "v.bin")) == 10


def test_backends_by_device(spark):
    """Each device of a table gets what choose_backend() gives for its own list, errors too."""
    from lumenfold.operators import models

    qnn, nnapi, cpu = ("qnn_htp", True, [0, 4]), ("ort_nnapi", True, [2]), ("ort_cpu", False, None)
    devices = {1: [(qnn, True), (cpu, True)], 2: [(qnn, False), (cpu, True)], 3: [(nnapi, False), (cpu, True)], 4: [(nnapi, False), (cpu, False)], 5: [(cpu, True), (nnapi, True), (qnn, True)], 6: [(cpu, True), (nnapi, True), (qnn, False)]}
    rows = [(d, place, i, fast, there, batch) for d, listed in devices.items() for place, ((i, fast, batch), there) in enumerate(listed)]
    table = spark.createDataFrame(rows, "device int, place int, id string, accelerated boolean, available boolean, preferred_batch array<int>")
    got = {r["device"]: (r["id"], r["batch"], r["error"]) for r in models.choose_backends(table, "device").collect()}
    for d in devices:
        try:
            want = (*models.choose_backend(table.where(F.col("device") == d)), None)
        except models.NoBackend as e:
            want = (None, None, str(e))
        assert got[d] == want, d
    assert got[2][2] and got[4][2] and got[3] == ("ort_cpu", 8, None) and got[6][0] == "ort_nnapi"
