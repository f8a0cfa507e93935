"""WARC archives of pages, and a two-level index of their captures.

Writing: records are built with SQL functions, compressed to a gzip member each, and written by Spark's text sink (its
line separator, a zero byte, is the last byte of a member), so archives are plain .warc.gz files on any storage Spark
reaches, committed as a whole. html is shuffled once, into archives of ARCHIVE_BYTES at most. Indexing: each archive is
scanned, its digests are verified, and captures are sorted by reversed-host URL key into compressed blocks of BLOCK_LINES
lines, PART_LINES to a part; the sparse directory has the first key of each block. Looking up: binary search over the
parts' first keys, then over that part's directory, then in the blocks that can hold the key; only those are unpacked.
read_records() then reads the bytes of the records found, and no others, in tasks of one archive each.

Defined cases: null html is an empty payload, a null url is kept as no target; line breaks in a url are percent-encoded;
null page_ids are allowed; rows that repeat a page_id and its payload are each written; a damaged record is an error, in
a scan as in a range read; empty tables give empty archives.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, shuffle_partitions, staged, work_path

ARCHIVE_BYTES, BLOCK_LINES, PART_LINES, DEDUP_BYTES, DATE = 32 << 20, 1000, 200_000, 1000, "2024-01-01T00:00:00Z"
#: Keys that a task looks up at most.
ASKED = 200_000
_ENTRY = "urlkey string, url string, page_id long, file string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
_BLOCK = "part int, block int, first_key string, first_id long, lines int, packed binary"


def url_key(url: Column) -> Column:
    """Reversed host, then path: http://www.a.com:80/x?y becomes com,a,www:80)/x?y; null gives an empty key."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#:]*)", 1))
    rest = F.regexp_replace(bare, r"^[^/?#:]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(rest, r"^(:\d+)?", 0), F.lit(")"), F.regexp_replace(rest, r"^:\d+", ""))


def with_revisits(pages: DataFrame, least_bytes: int = DEDUP_BYTES, parts: int | None = None) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for responses), dealt by row into parts.

    Groups of equal payloads are found on ids and digests alone; html is shuffled once, into the partitions written.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1("html"))
    p = p.withColumn("row_key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "payload_bytes", "payload_digest"))
    slim = staged(p.where(F.col("payload_bytes") >= least_bytes).select("row_key", "page_id", "payload_bytes", "payload_digest"), "payloads")
    same = ["payload_bytes", "payload_digest"]
    groups = slim.groupBy(*same).agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = slim.join(groups, same).where(~F.col("page_id").eqNullSafe(F.col("last_id"))).select("row_key", F.col("last_id").alias("refers_to")).distinct()
    # Spark deals a join out to no fewer than its shuffle partitions, and would shuffle html again for that
    n = max(parts or 0, shuffle_partitions(pages.sparkSession))
    # the hashed side is the revisits of one partition of pages, without their payloads
    return p.repartition(n, "row_key").join(revisits.repartition(n, "row_key").hint("shuffle_hash"), "row_key", "left").drop("row_key")


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per page; a page that equals a later one becomes a revisit without a body."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body"), F.lit("\r\n\r\n"), F.col("body"), F.lit("\r\n\r"),
    )
    records = with_revisits(pages, parts=1 + int(total) // ARCHIVE_BYTES).withColumn("body", body).select(record.alias("value"))
    # bytes pass the cast unchanged
    records.mapInArrow(_compress, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member for each record, without its last byte, which is 0 below 16 MB; a longer one gets an empty member behind."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            out = [_member(r.encode("utf-8") + b"\n") for r in batch.column(0).slice(i, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] if m[-1] == 0 else (m + _member(b""))[:-1] for m in out], pa.binary())], names=["value"])


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and declared payload length of one unpacked record."""
    end = data.find(b"\r\n\r\n")
    first, *rest = data[: max(end, 0)].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    heads = dict(x.split(": ", 1) for x in rest)
    body = data[end + 4 : end + 4 + int(heads["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    declared, kind, digest = int(http.rpartition(b"Content-Length: ")[2]), heads["WARC-Type"], heads["WARC-Payload-Digest"].removeprefix("sha1:")
    if len(data) != end + 4 + len(body) + 4 or (kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != declared)):
        raise ValueError(f"payload of the record at byte {at} is damaged")
    return heads, payload, declared


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, int]]:
    """Offset, length, headers, payload and declared payload length of each record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop, record = at, []
        while stop < len(data):  # one member, and an empty one that may follow
            z, begin = zlib.decompressobj(31), stop
            got = []
            while not z.eof:
                if stop >= len(data):
                    raise ValueError(f"record at byte {at} is cut off")
                try:
                    got.append(z.decompress(view[stop : stop + 65536]))
                except zlib.error as e:
                    raise ValueError(f"record at byte {at} is damaged: {e}") from e
                stop = min(stop + 65536, len(data)) - len(z.unused_data)
            if record and any(got):
                stop = begin
                break
            record += got
        yield at, stop - at, *parse_record(b"".join(record), at)
        at = stop


_number = lambda urn: None if urn is None or urn == "<urn:page:none>" else int(urn[10:-1])
_FIELDS = ["url", "page_id", "file", "offset", "length", "record_type", "payload_bytes", "payload_digest", "refers_to"]


def _entry(file: str, at: int, n: int, heads: dict[str, str], declared: int) -> tuple:
    return heads.get("WARC-Target-URI"), _number(heads["WARC-Record-ID"]), file, at, n, heads["WARC-Type"], declared, heads["WARC-Payload-Digest"].removeprefix("sha1:"), _number(heads.get("WARC-Refers-To"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            rows = [_entry(path, at, n, heads, declared) for at, n, heads, _, declared in parse_archive(bytes(data))]
            if rows:
                yield pd.DataFrame(rows, columns=_FIELDS).astype({"page_id": "Int64", "refers_to": "Int64"})


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """One capture per record, with the URL key and the byte range of the record in its archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    got = files.mapInPandas(_scan, _ENTRY.removeprefix("urlkey string, "))
    return got.select(url_key(F.col("url")).alias("urlkey"), *got.columns)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, block, held = TaskContext.get().partitionId(), 0, []
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("first_id", pa.int64()), ("lines", pa.int32()), ("packed", pa.binary())])

    def cut(n: int) -> dict:
        nonlocal block
        some, block = held[:n], block + 1
        del held[:n]
        packed = zlib.compress("\n".join(json.dumps(x) for x in some).encode())
        return {"part": part, "block": block - 1, "first_key": some[0][0], "first_id": some[0][2], "lines": len(some), "packed": packed}

    for batch in batches:
        held += [list(r.values()) for r in batch.to_pylist()]
        rows = [cut(BLOCK_LINES) for _ in range(len(held) // BLOCK_LINES)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([cut(len(held))], schema=schema)


def write_index(captures: DataFrame, path: str, part_lines: int = PART_LINES) -> None:
    """Sorted, compressed blocks. The directory is the table's first_key and first_id columns, read without the blocks.

    captures should be a written table, as it is counted first. Equal keys may lie in several parts.
    """
    keys, n = ["urlkey", "page_id", "file", "offset"], 1 + captures.count() // part_lines
    captures.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_pack, _BLOCK).write.parquet(path)


def _order(key: str, page_id: int | None) -> tuple[str, int]:
    return key, -1 << 63 if page_id is None or pd.isna(page_id) else int(page_id)


def _may_hold(firsts: list[tuple[str, int]], want: tuple[str, int]) -> range:
    """Places of the sorted ranges, told by their first keys, that can hold a key: the one before its equals, and those."""
    return range(max(bisect.bisect_left(firsts, want) - 1, 0), bisect.bisect_right(firsts, want))


def _blocks_of(directory: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one part that can hold the wanted keys."""
    directory = directory.sort_values("block")
    firsts, blocks = [_order(k, i) for k, i in zip(directory["first_key"], directory["first_id"], strict=True)], directory["block"].tolist()
    rows = [(part, blocks[at], salt, k, i) for part, salt, k, i in wanted[["part", "salt", "urlkey", "page_id"]].itertuples(index=False) for at in _may_hold(firsts, _order(k, i))] if blocks else []
    return pd.DataFrame(rows, columns=["part", "block", "salt", "urlkey", "page_id"]).astype({"page_id": "Int64"})


def _lines_of(blocks: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The lines of one block that match the wanted keys."""
    rows = []
    for packed in blocks["packed"]:
        lines = [json.loads(x) for x in zlib.decompress(bytes(packed)).decode().split("\n")]
        keys = [_order(x[0], x[2]) for x in lines]
        for want in {_order(k, i) for k, i in zip(wanted["urlkey"], wanted["page_id"], strict=True)}:
            rows += lines[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRY.split(", ")])
    return out.astype({c: "Int64" for c in ("page_id", "offset", "length", "payload_bytes", "refers_to")})


def lookup(spark: SparkSession, index: str, wanted: DataFrame, asked: int = ASKED) -> DataFrame:
    """Captures of the wanted (urlkey, page_id) pairs. The driver holds one key per part, nothing else.

    Wanted keys of a part are dealt out to as many tasks as they need, each with that part's directory, and so are those
    of a block. A block that no key can be in is never read by a task.
    """
    blocks = spark.read.schema(_BLOCK).parquet(index)
    tops = sorted((*_order(r["k"][0], r["k"][1]), r["part"]) for r in blocks.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("k")).collect())
    if not tops:
        return spark.createDataFrame([], _ENTRY)
    starts, parts = [t[:2] for t in tops], [t[2] for t in tops]

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([[parts[at] for at in _may_hold(starts, _order(k, i))] for k, i in zip(key, page_id, strict=True)])

    keys = wanted.select("urlkey", F.col("page_id").cast("long").alias("page_id")).distinct()
    keys = staged(keys.withColumn("part", F.explode(parts_of("urlkey", "page_id"))), "wanted-keys")
    tasks = keys.groupBy("part").agg(F.ceil(F.count("*") / asked).cast("int").alias("salts"))
    salted = staged(keys.join(tasks, "part").withColumn("salt", F.pmod(F.xxhash64("urlkey", "page_id"), F.col("salts")).cast("int")).drop("salts"), "salted-keys")
    directory = blocks.select("part", "block", "first_key", "first_id").join(tasks, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    at = directory.groupBy("part", "salt").cogroup(salted.groupBy("part", "salt")).applyInPandas(_blocks_of, "part int, block int, salt int, urlkey string, page_id long")
    at = staged(at, "wanted-blocks")
    discard(keys, salted)
    # read once more, so that Spark can tell the two uses apart
    holding = spark.read.schema(at.schema).parquet(at.staged_at).select("part", "block", "salt").distinct()
    hit = blocks.select("part", "block", "packed").join(holding, ["part", "block"])
    return hit.groupBy("part", "block", "salt").cogroup(at.groupBy("part", "block", "salt")).applyInPandas(_lines_of, _ENTRY)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Range reads, one open archive at a time."""
    from pyarrow import fs

    name, source = None, None
    for batch in batches:
        rows = []
        for file, at, n in batch[["file", "offset", "length"]].itertuples(index=False):
            if file != name:
                system, path = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if not file.startswith("file://") else file)
                name, source = file, system.open_input_file(path)
            _, _, heads, _, declared = next(parse_archive(source.read_at(int(n), int(at))))
            rows.append(_entry(file, int(at), int(n), heads, declared))
        if rows:
            yield pd.DataFrame(rows, columns=_FIELDS).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_records(captures: DataFrame) -> DataFrame:
    """The captures, told from the records themselves: each is read by its byte range, unpacked and verified, in tasks.

    A task's rows are in order of file and offset. Paths are opened with pyarrow.fs, which has to know the storage of the
    archives (here that of spark.checkpoint.dir).
    """
    n = shuffle_partitions(captures.sparkSession)
    dealt = captures.select("file", "offset", "length").repartition(n, "file").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(_read, _ENTRY.removeprefix("urlkey string, "))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from records found by the index and read by range."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives, index = work_path(spark, "warc"), work_path(spark, "warc-index")
    write_archives(pages, archives)
    captures = staged(scan_archives(spark, archives), "captures")
    write_index(captures, index)
    discard(captures)
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    found = lookup(spark, index, pages.select(url_key(target).alias("urlkey"), F.col("page_id").cast("long").alias("page_id")))
    return read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op2": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, url FROM pages),
g AS (SELECT page_id, url, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS last_id FROM g WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g LEFT JOIN m USING (h)""",
}
