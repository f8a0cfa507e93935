"""Tokeniser and model files, the sample, the log, and image files against plain versions."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.text import byte_alphabet
from lumenfold.operators import models, telemetry
from lumenfold.queries import QUERIES, media
from lumenfold.sources import files, images, scan


def test_bpe_from_files(spark, tmp_path):
    """Blank lines and comments take no rank, malformed lines take one; .gz is read as it is."""
    vocab = {"a": 1, "b": 2, "ab": 3, "ab</w>": 4, "<|startoftext|>": 8, "<|endoftext|>": 9, "b</w>": 5}
    (tmp_path / "vocab.json").write_text(json.dumps(vocab))
    merges = "#version: 0.2\n\na b\nthree of them\nab b</w>\na b</w>\n"
    (tmp_path / "merges.txt").write_text(merges)
    with gzip.open(tmp_path / "merges.txt.gz", "wt") as f:
        f.write(merges)
    for name in ("merges.txt", "merges.txt.gz"):
        bpe = files.bpe_from_files(spark, str(tmp_path / "vocab.json"), str(tmp_path / name), max_length=6)
        assert bpe.merges == {("a", "b"): 0, ("ab", "b</w>"): 2, ("a", "b</w>"): 3} and bpe.vocab == vocab
        assert bpe.encode(["ab", "b"]) == [8, 4, 5, 9, 0, 0]


def test_vocabulary_of_merge_lines(spark, tmp_path):
    """The byte alphabet, the same with word ends, the merged pairs, the two specials: in that order, from a packed file."""
    lines = ["#version", "a b", "", "ab c</w>", "d e", "f g"]
    with gzip.open(tmp_path / "bpe.txt.gz", "wt") as f:
        f.write("\n".join(lines))
    read = spark.read.text(str(tmp_path / "bpe.txt.gz"), wholetext=True).first()[0].split("\n")
    vocab, merges = files.vocab_and_merges_from_bpe_lines(read, keep=4)
    letters = [c for c in sorted(byte_alphabet()) if ord(c) < 256] + [c for c in sorted(byte_alphabet()) if ord(c) > 255]
    want = [*letters, *(c + "</w>" for c in letters), "ab", "abc</w>", "de", "<|startoftext|>", "<|endoftext|>"]
    assert merges == ["a b", "ab c</w>", "d e"] and vocab == {w: i for i, w in enumerate(want)} and len(letters) == 256


def test_model_defaults(spark):
    least = {"id": "m", "displayName": "M", "family": "f", "version": "1", "embeddingDim": 8, "imageEncoder": {"fileName": "i", "inputName": "x", "outputName": "y", "inputWidth": 4, "inputHeight": 4}}
    text = {"fileName": "t", "inputIdsName": "ids", "outputName": "y", "tokenizer": {"type": "bpe"}}
    full = {**least, "imageEncoder": {**least["imageEncoder"], "channels": 1, "layout": "NHWC", "mean": [0.5], "std": [2.0], "outputL2Normalize": False}, "textEncoder": {**text, "inputDataType": "INT32", "attentionMaskName": None, "outputL2Normalize": False, "tokenizer": {"type": "bpe", "maxLength": 5, "bosToken": "<b>", "eosToken": "<e>", "padTokenId": 7}}, "unknown": [1]}
    rows = spark.createDataFrame([("a", json.dumps(least)), ("b", json.dumps({**least, "textEncoder": text})), ("c", json.dumps(full))], "directory string, value string")
    got = {r["directory"]: r["c"].asDict(True) for r in files.parse_configs(rows).select("directory", models.with_defaults(F.col("config")).alias("c")).collect()}
    image = got["a"]["imageEncoder"]
    assert (image["channels"], image["layout"], image["outputL2Normalize"]) == (3, "NCHW", True) and image["mean"] == pytest.approx([0.48145466, 0.4578275, 0.40821073]) and image["std"] == pytest.approx([0.26862954, 0.26130258, 0.27577711])
    assert got["a"]["textEncoder"] is None
    t = got["b"]["textEncoder"]
    assert (t["inputDataType"], t["outputL2Normalize"], t["attentionMaskName"]) == ("INT64", True, None) and t["tokenizer"] == {"type": "bpe", "tokenizerFileName": None, "vocabFileName": None, "mergesFileName": None, "maxLength": 77, "bosToken": "<|startoftext|>", "eosToken": "<|endoftext|>", "padTokenId": 0}
    c = got["c"]
    assert c["imageEncoder"]["mean"] == [0.5] and c["imageEncoder"]["layout"] == "NHWC" and c["imageEncoder"]["channels"] == 1 and c["textEncoder"]["tokenizer"]["maxLength"] == 5 and c["textEncoder"]["inputDataType"] == "INT32"


def test_sample(spark):
    """The rows with the least 64-bit hashes of id and seed, whatever the partitions."""
    import xxhash

    rank = lambda i, seed: (lambda h: h - (1 << 64) * (h >> 63))(xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest())
    ids = [i * 7919 % 5003 for i in range(1500)]
    df = spark.createDataFrame([(i,) for i in ids], "media_id long")
    for seed, parts in ((42, 1), (42, 5), (7, 3)):
        got = [r[0] for r in scan.sample(df.repartition(parts), 25, seed).collect()]
        assert sorted(got) == sorted(sorted(ids, key=lambda i: (rank(i, seed), i))[:25])
    assert scan.sample(df, 0).count() == 0 and scan.sample(df.limit(3), 10).count() == 3
    every = [r[0] for r in media(spark, "/root/testdata/sf0.001").select("media_id").collect()]
    asked = {r["media_id"] for r in QUERIES["sample_seeded"](spark, "/root/testdata/sf0.001").collect()}
    assert asked == set(sorted(every, key=lambda i: (rank(i, 42), i))[:20])


def test_log_file(spark, tmp_path):
    b = spark.createDataFrame([(0, 1, 8, 1000, 1500, 0), (0, 2, 8, 1500, 2100, 40)], "run_id long, batch_id long, n long, started_ms long, completed_ms long, infer_ms long")
    told = telemetry.throughput(telemetry.wall_times(b)).withColumns({"timestamp_ms": F.col("completed_ms"), "indexed": F.col("n"), "pending": F.lit(0), "failed": F.lit(0), "batch_size": F.col("n"), "batch_ms": F.col("wall_ms"), "work_ms": F.lit(None).cast("double"), "backend": F.lit("cpu"), "status": F.lit("a, \"b\"")})
    lines = telemetry.log_lines(told.withColumns({c: F.lit(None).cast("double") for c in ("prep_ms", "decode_ms", "tensor_ms", "write_ms")}))
    assert len(lines.columns) == 17
    for _ in range(2):
        files.write_csv_log(lines.coalesce(1), str(tmp_path / "log"))
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "log")).orderBy("timestamp_ms").collect()
    assert len(got) == 4 and got[0]["infer_ips"] is None and got[3]["e2e_ips"] == "13.333" and got[0]["prep_ms"] is None and got[0].asDict().keys() == set(lines.columns)
    files.write_csv_log(lines.limit(1), str(tmp_path / "log"), "overwrite")
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 1


def png(path, pixels, alpha=False):
    """A PNG written by hand: rows of RGB or RGBA."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    """Pixels of real files, one of which can't be decoded; from there to tensors of the model's size."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (3, 2, 3)), rng.integers(0, 256, (2, 4, 4))
    png(tmp_path / "a.png", a)
    png(tmp_path / "b.png", b, alpha=True)
    (tmp_path / "c.png").write_bytes(b"not an image")
    got = {r["uri"].rpartition("/")[2]: r for r in images.image_pixels(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png", "c.png"} and got["c.png"]["pixels"] is None and got["c.png"]["width"] is None
    assert (got["a.png"]["width"], got["a.png"]["height"]) == (2, 3)
    packed = lambda p: [int(np.array([(int(x[3]) if len(x) > 3 else 255) << 24 | int(x[0]) << 16 | int(x[1]) << 8 | int(x[2])], np.uint32).view(np.int32)[0]) for x in p.reshape(-1, p.shape[2])]
    assert got["a.png"]["pixels"] == packed(a) and got["b.png"]["pixels"] == packed(b)
    none = F.array().cast("array<double>")
    t = {r["uri"].rpartition("/")[2]: r["tensor"] for r in images.image_tensors(images.image_pixels(spark, str(tmp_path)), 2, 3, none, none).collect()}
    assert t["c.png"] is None and np.allclose(np.array(t["a.png"]).reshape(3, 3, 2), a.transpose(2, 0, 1) / 255) and len(t["b.png"]) == 18
