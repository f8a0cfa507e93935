"""Small fixtures with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from lumenfold.llm import exact_dedup, line_dedup, mixing, ngram_join, packing, quality, secrets, token_codec, token_store, vector_dedup, warc
from lumenfold.llm.components import components
from lumenfold.llm.tokens import UnitEncoder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1, 300)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (3, "one"), (4, "ONE"), (5, base), (6, base), (7, base + " extra"), (8, text(2, 5000)), (9, "é è\n\n  x  y\tz <|endoftext|>"), (10, "two words"), (None, base)]
    rows += [(20 + i, f"Shared Line \nown {i}\n\nshared line") for i in range(12)]
    rows += [(50 + i, " ".join(w if j != 7 * i else f"edit{i}" for j, w in enumerate(base.split()))) for i in range(12)]
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}" if i != 9 else None, "clash", 1, "x") for i, t in rows], "doc_id long, text string, source string, n string, row long, label string")


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 50257, n).astype("<u4") for n in (1, 2, 700)] + [np.array([5] * 900, "<u4"), np.array([2**32 - 1, 0, 7], "<u4"), (rng.zipf(1.3, 2000) % 300).astype("<u4")]
    coded = token_codec.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_codec.decode_blocks(coded), strict=True))
    assert len(coded[3]) < 100 and token_codec.encode_blocks([]) == [] and token_codec.decode_blocks([]) == []
    long = [(rng.zipf(1.2, 2048) % 900).astype("<u4") for _ in range(40)] + [np.arange(4096, dtype="<u4")[::-1] * 1000, np.full(4096, 7, "<u4"), np.tile(np.arange(3, dtype="<u4"), 1000)]
    assert all((a == b).all() for a, b in zip(long, token_codec.decode_blocks(token_codec.encode_blocks(long)), strict=True))
    broken = bytearray(coded[2])
    broken[-40] ^= 8
    with pytest.raises(token_codec.BadBlock):
        token_codec.decode_blocks([bytes(broken)])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_equal_whole_texts(name):
    e = UnitEncoder(public_tokenizers.path(name))
    texts = ["", " ", "  a", "a  b", "a   b ", "x\n y\n\n z", "don't it's", "\t\tq  r", "Á B", "a \x01 b", "日本 語 <|endoftext|> z", "tail ", text(4, 50), " \nfoo  \n bar"]
    texts += ["x Hello, WORLD!! it's x'S ÉTÉ, straße; ÿ. ß e\u0301te\u0301, I\u0307 ZZ&&& a_b c\nD. E,\n'S", "x " + "q" * 5000 + ". x", "<|ENDOFTEXT|> a <|endoftext|>, b\u200b ×÷ x²,"]
    assert e.by_stem
    assert e.encode(texts) == [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_of_random_texts(name):
    """Line ends inside units, contractions, letters on the edge of the plain ranges, and words beyond one call."""
    e, rng = UnitEncoder(public_tokenizers.path(name)), random.Random(5)
    assert e.by_unit and e.by_stem
    pieces = [*" \n\n \n'sTté,.Ééß-_1a日 \t’\x01 ſ&<|endoftext|>", "ing", "wh", "d.\nA", "don't", "\r\n", "Ġ", "«", " a", " B", "été,", " Zu\n", "×", "÷"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)]
    texts.append(" ".join("".join(rng.choices("abcdeéß", k=6)) for _ in range(9000)))
    assert e.encode(texts) == e._raw(texts)
    assert e.encode(texts) == e._raw(texts)  # now from what it remembers


def test_crc32_concat():
    draw = random.Random(5)
    whole = [[draw.randbytes(draw.choice([0, 1, 4, 300, 8192, 65537])) for _ in range(draw.randint(1, 6))] for _ in range(60)]
    parts = [p for w in whole for p in w]
    starts = np.cumsum([0, *(len(w) for w in whole[:-1])])
    got = token_store.crc32_concat(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), starts)
    assert got.tolist() == [zlib.crc32(b"".join(w)) for w in whole]


@pytest.mark.parametrize("lanes", [token_store.LANES, 3])
def test_token_store(spark, docs, tmp_path, lanes):
    """With 3 lanes of 64 ids a task flushes many times, and long documents span flushes."""
    path, name = str(tmp_path / "store"), public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, path, name, 2, block_tokens=64, lanes=lanes)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    tk, start = UnitEncoder(name).tokenizer, 0
    want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        ids = np.array(tk.encode(w[1] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (w[0], start, len(ids), zlib.crc32(ids))
        start += len(ids)
    token_store.write_store(docs.limit(0), str(tmp_path / "none"), name, 2)
    assert token_store.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_warc(spark, tmp_path):
    big = "<html>é\r\n\r\nWARC/1.1\r\n" + "y" * 1200
    rows = [(1, "http://www.a.com/x", big), (2, "https://b.org:80/p?q", big), (3, None, big), (4, "http://a.com/x", None), (5, "http://a.com/\r\nx", ""), (6, "http://a.com/x", "short"), (7, "http://a.com/x", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    caps = warc.scan_archives(spark, str(tmp_path / "w"))
    warc.write_index(caps, str(tmp_path / "i"))
    found = {r["page_id"]: r for r in warc.lookup(spark, str(tmp_path / "i"), caps.select("urlkey", "page_id")).collect()}
    assert {k: (v["record_type"], v["refers_to"]) for k, v in found.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), **{k: ("response", None) for k in (4, 5, 6, 7)}}
    assert all(found[i]["payload_digest"] == hashlib.sha1((h or "").encode()).hexdigest() and found[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in rows)
    assert found[1]["urlkey"] == "com,a,www)/x" and found[2]["urlkey"] == "org,b:80)/p?q"
    again = {r["page_id"]: r for r in warc.read_records(warc.lookup(spark, str(tmp_path / "i"), caps.select("urlkey", "page_id"), asked=2)).collect()}
    assert {k: v.asDict() for k, v in again.items()} == {k: {c: v for c, v in r.asDict().items() if c != "urlkey"} for k, r in found.items()}
    warc.write_archives(pages.limit(0), str(tmp_path / "w0"))
    assert warc.scan_archives(spark, str(tmp_path / "w0")).count() == 0


def test_warc_repeats_and_damage(spark, tmp_path):
    """Null and repeated page_ids, clashing columns, records over 16 MB, small parts and blocks; a damaged record is an error."""
    import glob
    import gzip

    big = "<p>" + "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9000, 6_000_000)))
    rows = [(None, "http://a.b/", "z" * 1500), (None, "http://a.b/", "z" * 1500), (4, "http://a.b/", "z" * 1500), (4, "http://a.b/", "z" * 1500), (4, "http://a.b/", "other"), (9, "http://c.d/", big), (10, "http://c.d/", big + "!")]
    rows += [(100 + i, f"http://h{i % 7}.org/{i}", None) for i in range(2500)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, part int, file string")
    warc.write_archives(pages, str(tmp_path / "w"))
    caps = warc.staged(warc.scan_archives(spark, str(tmp_path / "w")), "caps")
    assert caps.count() == len(rows)
    warc.write_index(caps, str(tmp_path / "i"), part_lines=400)
    found = warc.read_records(warc.lookup(spark, str(tmp_path / "i"), caps.select("urlkey", "page_id").union(spark.createDataFrame([("no,such)/", 5), ("", None), ("~~~", 1)], "urlkey string, page_id long")), asked=100))
    tell = lambda df: sorted((str(r["page_id"]), r["payload_digest"], r["record_type"], str(r["refers_to"]), r["offset"]) for r in df.collect())
    assert tell(found) == tell(caps)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in caps.where("payload_bytes = 1500").collect())
    assert kinds == [("4", "response", None)] * 2 + [("None", "revisit", 4)] * 2
    file = next(f for f in glob.glob(str(tmp_path / "w" / "part-*")) if b"urn:page:4>" in gzip.open(f).read())
    data = bytearray(open(file, "rb").read())
    at, n = next((at, n) for at, n, heads, _, _ in warc.parse_archive(bytes(data)) if heads["WARC-Record-ID"] == "<urn:page:4>")
    data[at + n // 2] ^= 255
    with pytest.raises(ValueError):
        list(warc.parse_archive(bytes(data)))
    with pytest.raises(ValueError):
        next(warc.parse_archive(bytes(data[at : at + n])))


def test_quality_order(spark):
    """Labelled ids that repeat with other texts: the result doesn't hang on the order of rows."""
    rows = [(i % 40, text(i, 12) if i % 3 else text(i, 12).upper().replace(" ", "!! ")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    told = []
    for some in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        out = quality.resample(spark.createDataFrame(some, "doc_id long, text string").repartition(3), labels)
        told.append(sorted((r["_id"], r["_same"], r["kept"], round(r["key"], 9)) for r in out.collect()))
    assert told[0] == told[1] == told[2] and 0 < sum(r[2] for r in told[0]) < 80


def test_long_documents_of_common_lines(spark):
    """Ten times the lines take about ten times as long, not a hundred times."""
    import time

    took = {}
    for n in (2_000, 20_000):
        body = "\n".join(f"line {k}" if k % 5 else f"Line {k % 7} " for k in range(n))
        rows = [(i, f"own {i}\n{body}\nown {i}") for i in range(12)] + [(99, None), (100, "line 1\n\nother")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = line_dedup.drop_common_lines(df, batches=1)
        began = time.perf_counter()
        got = {r["doc_id"]: (r["text"], r["_n_lines"], r["_n_dropped"]) for r in out.collect()}
        took[n] = time.perf_counter() - began
        assert got[3] == ("own 3\nown 3", n + 2, n) and got[99] == ("", 1, 0) and got[100] == ("\nother", 3, 1)
    assert took[20_000] < 25 * took[2_000] + 5


def test_line_dedup(spark, docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    rows = [(r[0], (r[1] or "").split("\n")) for r in docs.select("doc_id", "text").collect()]
    seen = {}
    for k, (_, ls) in enumerate(rows):
        for x in {key(x) for x in ls} - {""}:
            seen.setdefault(x, set()).add(k)
    bad = {x for x, d in seen.items() if len(d) >= 10}
    want = sorted(((i is not None, i or 0), len(ls), sum(key(x) in bad for x in ls), "\n".join(x for x in ls if key(x) not in bad)) for i, ls in rows)
    out = line_dedup.drop_common_lines(docs)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["_n_lines"], r["_n_dropped"], r["text"]) for r in out.collect())
    assert "shared line" in bad and got == want and out.columns[: len(docs.columns)] == docs.columns
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0


def test_line_runs(spark):
    """Nine batches with a fan-out of 2 reach level 3; keys at the limit are told from counts over all runs."""
    rng = np.random.default_rng(11)
    batches = [(rng.zipf(1.5, 200) % 60).tolist() for _ in range(9)]
    runs = line_dedup.LineRuns(spark, min_docs=25, fanout=2)
    for b in batches:
        runs.add(spark.createDataFrame([(int(k), int(k) * 7) for k in b], "h1 long, h2 long"))
        level_sizes = [len(x) for x in runs.levels]
        assert max(level_sizes) < 2
    assert runs.compactions == [1, 1, 2, 1, 1, 2, 3] and [len(x) for x in runs.levels] == [1, 0, 0, 1]
    plan = runs.frequent()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    count = {k: sum(b.count(k) for b in batches) for b in batches for k in b}
    assert {r["h1"] for r in runs.frequent().collect()} == {k for k, n in count.items() if n >= 25}
    runs.drop()


def test_exact_dedup(docs):
    rows = [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]
    want = []
    for i, t in rows:
        g = [j for j, u in rows if u == t]
        keep = max((j for j in g if j is not None), default=None)
        want.append((str(i), str(keep), len(g), i == keep))
    got = [(str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(got) == sorted(want) and exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_shuffles_no_text(spark, monkeypatch):
    """With a bitmap so small that every bit is set, results are the same; no exchange carries a text."""
    base = text(5, 400)
    rows = [(i, base + str(i % 5) if i % 2 else base[: i % 9] * 3) for i in range(60)] + [(100 + i, "z" * i) for i in range(40)] + [(200, None), (201, "")]
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id long, text string, _len string, n int, _word string")
    told = lambda: sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(df, prefix_chars=50).collect())
    want = sorted((i, max(j for j, u in rows if (u or "") == (t or "")), sum((u or "") == (t or "") for _, u in rows)) for i, t in rows)
    assert told() == want
    monkeypatch.setattr(exact_dedup, "MOST_WORDS", 1)
    plans, stage = [], exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda d, name: (plans.append(d._jdf.queryExecution().executedPlan().toString()), stage(d, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert told() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    refined = plans[-1]
    assert "BroadcastHashJoin" in refined and "SortMergeJoin" not in refined.split("BroadcastExchange")[0]


def test_secrets(spark):
    t = ["password = hunter22 and AKIA" + "A" * 16, None, "", "secret: token: abcdefgh", 'Api_Key="abc"; PASSWD:"a+b/c=" ' + "0af" * 9, "client_id: web-client-77 then password=longenough", "client_id: web-client-77", "x" * 3000 + " é token=ABCDEF"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    kinds = [("assign", re.compile(secrets.ASSIGN, re.A), 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]
    names = [k[0] for k in secrets.KINDS]
    got = {r["_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.find_spans(df).collect()}
    for i, x in enumerate(t):
        base = sorted((m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(kinds) for m in p.finditer(x or "") if len(m.group(g)) >= least)
        assert [s for s in got[i] if s[1] < 3] == base
    assert names.index("weak_id") in {s[1] for s in got[5]} and not got[6]
    assert secrets.find_spans(df.limit(0)).count() == 0


def linked_spans(text, scope):
    """Brute force: (kind, start, end) of base spans and linked candidates, by scanning characters and comparing all pairs."""
    mixed = lambda x: len(x) >= 32 and any(c.isdigit() for c in x) and any(c.isupper() for c in x) and any(c.islower() for c in x)
    value = r"""["']?\x20*[:=]\x20*["']?"""
    found = []
    for kind, p, least, group in [
        ("assign", r"(?i:password|passwd|secret|token|api_?key)" + value + r"([A-Za-z0-9+/_.=-]+)", 6, 1),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
        ("weak_id", r"(?i:(?<![a-z0-9])(?:client|account|app|user)[_-]?id)" + value + r"([A-Za-z0-9._-]+)", 6, 1),
        ("endpoint", r"\b(?:https?|wss?|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?", 8, 0),
    ]:
        found += [(m.start(), kind, m.end()) for m in re.finditer(p, text, re.A) if len(m.group(group)) >= least]
    for m in re.finditer(r"([A-Za-z0-9+/]+)={0,2}", text):
        found += [(m.start(), "weak_secret", m.end())] if mixed(m.group(1)) else []
    roles = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
    out = []
    for start, kind, end in found:
        near = {roles[k] for s, k, _ in found if abs(s - start) <= scope}
        told = {"weak_id": "secret" in near, "weak_secret": bool(near & {"id", "endpoint"}), "endpoint": {"id", "secret"} <= near}.get(kind, True)
        if told and (kind in ("assign", "access", "hex") or not any(k in ("assign", "access", "hex") and s <= start < e for s, k, e in found)):
            out.append((start, kind, end))
    return sorted(out)


def test_secret_links(spark):
    key, access, token = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzKEY1", "AKIA" + "Q" * 16, "aB3" * 12
    t = [
        f"AWS_ACCESS_KEY_ID={access}\nAWS_SECRET_ACCESS_KEY={key}\n",
        f"AWS_ACCOUNT_ID=123456789012\nSIGNING_KEY={key}",
        f"export OAUTH_CLIENT_ID=web-client-77 OAUTH_KEY='{key}'",
        f"DATABASE_URL=postgres://db.internal:5432/x\nUSER_ID=service-9\nDB_KEY={token}==",
        f"pre_{token} https://a.example:8443/v1 app-id: abcdef1",
        f"key = {key} at https://a.example",
        f"AWS_SECRET_ACCESS_KEY={key}",
        f"AWS_ACCOUNT_ID=123456789012{' ' * 380}K={token}",
        f"AWS_ACCOUNT_ID=123456789012{' ' * 420}K={token}",
        "myaccount_id=abcdefgh token=abcdefgh",
        "token=" + "x." * 300 + f"{token}._{token} client_id=abcdefgh",
        f"é CLIENT_ID=abcdefgh\n-{token}\n{'k' * 40}={token}={token} s3://bucket.a/b",
        "x=" + "A" * 40 + " user_id=abcdefgh https://b.example",
        "",
    ]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    names = [k[0] for k in secrets.KINDS]
    got = {r["_id"]: [(s["start"], names[s["kind"]], s["end"]) for s in r["spans"]] for r in secrets.find_spans(df).collect()}
    for i, x in enumerate(t):
        assert sorted(got[i]) == linked_spans(x, secrets.SCOPE_CHARS), x
    told = [[(k, t[i][a:b]) for a, k, b in got[i]] for i in range(len(t))]
    assert told[0] == [("access", access), ("weak_secret", key)]
    assert told[1] == [("weak_id", "ACCOUNT_ID=123456789012"), ("weak_secret", key)]
    assert told[2] == [("weak_id", "CLIENT_ID=web-client-77"), ("weak_secret", key)]
    assert [k for k, _ in told[3]] == ["endpoint", "weak_id", "weak_secret"] and not told[6] and not told[8]


def test_packing(spark, docs):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 400).tolist()
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(400)) and max(sum(lengths[i] for i in b) for b in bins) <= 100
    assert len(bins) <= -(-sum(lengths) // 100) + 2
    assert packing.best_two_fit([60, 30, 25, 15], 100)[0:1] == [[0, 1]] or len(packing.best_two_fit([60, 30, 25, 15], 100)) == 2
    from lumenfold.llm.common import staged

    pieces = staged(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 0, 128, with_ids=True), "p")
    packed = packing.pack(pieces, 128)
    got = packed.orderBy("sequence_id", "offset").collect()
    for a, b in zip(got, got[1:], strict=False):
        assert b["offset"] == (a["offset"] + a["length"] if a["sequence_id"] == b["sequence_id"] else 0) and b["offset"] + b["length"] <= 128
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.assemble(packed).collect()}
    assert sum(whole.values()) == sum(r["length"] for r in got) and packing.pack(pieces.limit(0)).count() == 0


def test_pieces_of_tokens(spark, docs):
    """piece, start, length and ids_crc32 of every document against the tokenizer."""
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    tk, want = Tokenizer.from_file(name), []
    long = spark.createDataFrame([(70, text(8, 9000)), (71, "x" * 30_000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(long)
    for i, t in both.collect():
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(i), k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    packed = packing.pack_documents(both).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(want)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 2048 and [o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)][:-1]]).tolist() for s in by.values())


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by: dict = {}
    for r in docs.collect():
        by[r["source"]] = by.get(r["source"], 0) + n(r["text"])
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight, left, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(by.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = left - sum(fixed.values())
        aim = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if aim[s] > 3 * by[s]]
        if not over:
            break
        fixed |= {s: 3 * by[s] for s in over}
    aim |= fixed
    assert sorted(round(r["target"], 6) for r in out) == sorted(round(aim[r["source"]], 6) for r in docs.collect())
    assert all(r["taken"] <= 3 * r["size"] for r in out) and len(out) == docs.count()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_equal_rows(spark):
    """Rows that can't be told apart are split at the threshold: taken words come within a row of the target."""
    rows = [(None, text(1, 8), "a")] * 50 + [(5, text(2, 8), "b")] * 40 + [(5, text(3, 30), "b")] + [(i, text(i, 9), "c") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).groupBy("_src").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(out) == 3 and all(abs(r["taken"] - r["target"]) <= r["most"] for r in out)


def test_mixing_sql(spark, docs, tmp_path):
    """The SQL and the operator agree on repeated, null and blank rows."""
    import duckdb

    docs.unionByName(docs.where("doc_id in (5, 8, 22)")).unionByName(docs.where("doc_id is null")).select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.ORACLE["op7"]).fetchall()
    got = [tuple(r) for r in mixing.op7_mix_sources(spark, str(tmp_path)).collect()]
    tell = lambda rows: sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in rows)
    assert tell(got) == tell(want)


def test_quality(spark):
    good, bad = [text(i, 60) for i in range(60)], [text(i, 60).upper().replace(" ", "!! ") for i in range(40)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 100, 2)] + [(2, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["_id"] for r in quality.resample(df, labels).collect() if r["kept"]}
    assert len(kept & set(range(60))) >= 58 and len(kept & set(range(60, 100))) <= 2 and not kept & {500, 501}
    assert quality.resample(df.limit(0), labels).count() == 0
    assert quality.resample(df, labels.limit(0)).where("kept").count() == 100
    values = spark.range(5000).select(F.pmod(F.hash("id"), F.lit(997)).cast("double").alias("v"))
    assert quality.kth_largest(values, "v", 777, 16, 50) == sorted((r[0] for r in values.collect()), reverse=True)[776]


def test_quality_brute_force(spark):
    """Models, weights, noise and the sample, computed in plain Python; with ties, repeated ids and clashing columns."""
    import struct

    import xxhash

    rows = [(i, text(100 + i, 3 + 5 * (i % 9)) if i % 3 else text(100 + i, 40).upper().replace(" ", "!! ")) for i in range(90)] + [(7, text(107, 3)), (7, "other words here"), (None, "no id"), (200, None), (201, "x " * 3000)]
    df = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, key string, log_weight double")
    marks = [(i, int(i % 3 > 0), 0) for i in range(0, 60)]
    got = quality.resample(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    whole = 1 << 64

    def plain(t):  # unigrams and bigrams by their own rule: multiplicative hashes of CRC-32s of tokens
        tokens = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", t or "")]
        bucket = lambda x: (x % whole * 0x9E3779B97F4A7C15 % whole >> 50) % quality.BUCKETS
        ones = [bucket(h + 1) for h in tokens]
        twos = [bucket(a * 0xC2B2AE3D27D4EB4F + b) for a, b in zip(tokens, tokens[1:])]
        return ones + twos + ones[-1:]  # the last token counts twice, as it opens no bigram

    feats = {t: plain(t) for _, t in rows}
    assert all(sorted(quality.features([t])[0].tolist()) == sorted(f) for t, f in feats.items())
    good = {i for i, q, _ in marks if q}
    raw, target = [1] * quality.BUCKETS, [1] * quality.BUCKETS
    for i, t in rows:
        for f in feats[t]:
            raw[f] += 1
            target[f] += i in good
    scarce = sum(target) <= quality.BUCKETS
    ratio = [0.0 if scarce else math.log(a / sum(target)) - math.log(b / sum(raw)) for a, b in zip(target, raw, strict=True)]

    def noise(i):
        h = xxhash.xxh64(struct.pack("<i", 8), seed=42).intdigest()
        h = h if i is None else xxhash.xxh64(struct.pack("<q", i), seed=h).intdigest()
        return -math.log(-math.log(((h & ((1 << 52) - 1)) + 0.5) / (1 << 52)))

    want = sorted(((i is not None, i or 0), len(feats[t]), round(sum(ratio[f] for f in feats[t]), 6), round(sum(ratio[f] for f in feats[t]) + noise(i), 6)) for i, t in rows)
    assert sorted(((r["_id"] is not None, r["_id"] or 0), r["n_features"], round(r["log_weight"], 6), round(r["key"], 6)) for r in got) == want
    able = sorted((r["key"] for r in got if r["n_features"]), reverse=True)
    kept = [r for r in got if r["kept"]]
    assert 0 < len(kept) < len(able) and min(r["key"] for r in kept) > able[len(kept)] and all(r["n_features"] for r in kept)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, docs, k, num, den):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in label}
    got = ngram_join.near_duplicates(docs, k, num, den).collect()
    name = lambda v: -1 if v is None else v
    real = sorted((name(r[0]), len(s)) for r, s in zip(rows, sets, strict=True))
    assert sorted((name(r["doc_id"]), r["n_shingles"]) for r in got) == real
    mine = {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None and r["component_id"] is not None}
    assert {(rows[i][0], least[label[i]]) for i in range(len(rows)) if rows[i][0] is not None and None not in [rows[j][0] for j in range(len(rows)) if label[j] == label[i]]} <= mine
    assert ngram_join.near_duplicates(docs.limit(0), k, num, den).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(100 + i, (v + 0.2 * rng.standard_normal(64)).tolist(), 1) for i, v in enumerate(base)] + [(200 + i, base[0].tolist(), 1) for i in range(5)]
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] * 64, 1), (303, base[0].tolist(), None), (304, base[0].tolist(), 2), (305, [1.0, None], 1), (306, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_dedup.link_vectors(df).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, s in rows if i < 300}
    links = {i: {j for j in x if j != i and x[i] @ x[j] >= 0.93} for i in x}
    found = sum(got[i]["n_links"] for i in x)
    assert all(got[i]["n_links"] <= len(links[i]) for i in x) and found >= 0.9 * sum(map(len, links.values()))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(300, 307)) and got[204]["component_id"] == 0
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_any_length(spark):
    """Huge, tiny and subnormal vectors link by their directions; repeated vec_ids and ties keep one component."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1e200], 1), (3, [3e-200, 3e-200], 1), (4, [5e-324, 5e-324], 1), (5, [1.0, -1.0], 1), (6, [1e-200, -1e-200], 1), (6, [2.0, -2.0], 1), (7, [1e308, 0.0], 2), (8, [1e-308, 0.0], 2)]
    got = sorted(tuple(r) for r in vector_dedup.link_vectors(spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, node string")).collect())
    assert got == sorted([(1, 3, 1, True), *[(i, 3, 1, False) for i in (2, 3, 4)], (5, 2, 5, True), (6, 2, 5, False), (6, 2, 5, False), (7, 1, 7, True), (8, 1, 7, False)])


def test_vectors_in_chunks(spark, monkeypatch):
    """Dense clusters in buckets of many chunks, floats as given: links and components of brute force."""
    monkeypatch.setattr(vector_dedup, "CHUNK", 8)
    rng = np.random.default_rng(12)
    middles = rng.standard_normal((4, 64))
    x = np.concatenate([m + s * rng.standard_normal((50, 64)) for m, s in zip(middles, (0.05, 0.15, 0.2, 0.6), strict=True)]).astype(np.float32)
    x = np.concatenate([x, x[:7], x[60:62] * 3])
    df = spark.createDataFrame([(i * 3 % 211, v.tolist(), "a" if i % 50 else "b", i) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string, weight int")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    ids, label = [i * 3 % 211 for i in range(len(x))], ["a" if i % 50 else "b" for i in range(len(x))]
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], 10**9).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.link_vectors(df).collect()}
    total, found = near.sum(), sum(n for n, _ in got.values())
    assert total > 3000 and 0.97 * total <= found <= total
    assert sum(got[i] == (near[k].sum(), comp[k]) for k, i in enumerate(ids)) >= 0.95 * len(ids)


@pytest.mark.parametrize("vectors", [1_000, 5_000_000, 10**9])
def test_filter_recall(vectors):
    """Random and near pairs share a filter, however many code words there are, and the filters of a vector stay few."""
    n_words, rng = vector_dedup.words_for(vectors), np.random.default_rng(2)
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other = rng.standard_normal((300, 64))
    other -= (other * a).sum(axis=1)[:, None] * a
    b = 0.935 * a + math.sqrt(1 - 0.935**2) * other / np.linalg.norm(other, axis=1)[:, None]
    fa, fb = vector_dedup.filters(a, vector_dedup.CAP, n_words), vector_dedup.filters(b, vector_dedup.CAP, n_words)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(fa, fb, strict=True)]) >= 0.9
    assert np.mean([len(x) for x in fa]) < 400


def test_links_whatever_the_size(spark, monkeypatch):
    """More rows, of which words_for() would take more words, change no link between the others."""
    monkeypatch.setattr(vector_dedup, "VECTORS", 100)
    rng = np.random.default_rng(5)
    a = rng.standard_normal((150, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other = rng.standard_normal((150, 64))
    other -= (other * a).sum(axis=1)[:, None] * a
    b = 0.935 * a + math.sqrt(1 - 0.935**2) * other / np.linalg.norm(other, axis=1)[:, None]
    few = [(i, v.tolist(), "x") for i, v in enumerate(np.concatenate([a, b]))]
    many = [(1000 + i, v.tolist(), "y") for i, v in enumerate(rng.standard_normal((1500, 64)))]
    # a high cap leaves each vector few filters, so that some pairs are missed
    links = [{r["vec_id"]: r["n_links"] for r in vector_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), cap=0.9).where("vec_id < 1000").collect()} for rows in (few, few + many)]
    assert links[0] == links[1] and 0 < sum(links[0].values()) < 300


def test_links_at_the_threshold():
    """A pair at the very threshold links in a group of any size."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        u = vector_dedup.unit_rows(rng.standard_normal((24, 64)))
        nodes, ones, least = np.arange(24), np.ones(24, np.int64), math.fsum(u[3] * u[17])
        whole = vector_dedup._block(7, nodes, ones, u, [np.array([7])] * 24, nodes, nodes, least)
        pairs = {tuple(sorted(x)) for x in zip(*np.nonzero(vector_dedup._linked(u @ u.T, least, u, u)), strict=True)}
        two = np.array([3, 17])
        alone = vector_dedup._small_groups(np.array([0]), np.array([2]), two, np.ones(2, np.int64), np.array([7, 7]), u[two], (np.array([0, 1, 2]), np.array([7, 7])), least)
        assert (3, 17) in pairs and whole and alone[0].tolist() == [[3, 1, 3], [17, 1, 17], [17, 0, 3]]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(e).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100}


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    start = docs_in = spark.read.parquet(f"{folder}/documents.parquet")
    from lumenfold.llm.common import staged

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs_in, folder), "t")
        assert out.columns == start.columns and out.count() > 0, name
        docs_in = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_in, folder)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert packed.where("piece = 0").count() == docs_in.count()


def test_pipeline_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    a, b, bad = text(1, 80), text(2, 80), text(3, 80).upper().replace(" ", "!! ")
    row = lambda i, t, lang="en", source="s0": (i, t, lang, source, len(t or ""))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda df: sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "", r["text"] is None) for r in df.collect())
    key = lambda i, t: ((i is not None, i or 0), t or "", t is None)
    # 1: equal rows; 2: a copy of 1 and a text of its own; 3, null: blank, repeated, null id
    docs = [row(1, a, "en"), row(1, a, "de"), row(1, a, "en"), row(2, a), row(2, b), row(2, b), row(3, None), row(3, None), row(3, ""), row(None, text(4, 80)), row(None, text(4, 80)), row(None, text(5, 80))]
    out = corpus_pipeline.dedup_documents(spark, frame(docs), "")
    want = [key(1, a), key(2, b), key(3, None), key(3, ""), key(None, text(4, 80)), key(None, text(5, 80))]
    assert told(out) == sorted(want) and {r["lang"] for r in out.where("doc_id = 1").collect()} == {"de"} and out.columns == corpus_pipeline.COLUMNS

    rows = [row(i, text(10 + i, 60)) for i in range(60)] + [row(i, text(10 + i, 60).upper().replace(" ", "!! ")) for i in range(60, 100)]
    rows += [row(5, bad), row(300, a), row(300, bad), row(300, a), row(None, bad), row(None, b)]
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(10, 100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = told(corpus_pipeline.classify(spark, frame(rows), str(tmp_path)))
    assert not [k for k in kept if k[1] == bad] and kept.count(key(300, a)) == 2 and key(None, b) in kept and key(5, text(15, 60)) in kept

    rows = [row(1, a, source="x"), row(1, a, source="y"), row(2, b, source="y"), row(3, a + b, source=None)]
    taken = [r["taken"] // r["size"] for r in mixing.mix(frame(rows)).where("size > 0").collect()]
    assert corpus_pipeline.mix_sources(spark, frame(rows), "").count() == sum(taken)


def test_pipeline_stages(spark, tmp_path):
    """Line dedup and packing as stages against plain versions; every stage on empty tables."""
    from collections import Counter

    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [(i, f"Own {i}\n COMMON line\n\ncommon LINE\nrare {i % 7}", "en", f"s{i % 2}", 1) for i in range(14)] + [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, "common line", "de", None, 11), (None, "x\ncommon line", "de", "s1", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    left = lambda t: "\n".join(x for x in (t or "").split("\n") if seen[key(x)] < 10)
    want = Counter((i, left(t), lang, s, len(left(t))) for i, t, lang, s, _ in rows)
    out = corpus_pipeline.dedup_lines(spark, frame, "")
    assert Counter(tuple(r) for r in out.select(*corpus_pipeline.COLUMNS).collect()) == want and seen["common line"] >= 10
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
    packed = corpus_pipeline.pack_sequences(spark, frame, "").collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed) == Counter((i, len(ids(t)), zlib.crc32(ids(t))) for i, t, *_ in rows)
    assert len({r["sequence_id"] for r in packed}) == 1 and sorted(r["offset"] for r in packed)[0] == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name
