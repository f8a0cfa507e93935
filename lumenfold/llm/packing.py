"""Best-two-fit packing of tokenised documents into sequences of at most `size` tokens.

Documents longer than a sequence are cut into full pieces and a rest. Pieces (ids of documents, lengths, checksums; no
text) are dealt by hash to bins of about PIECES_A_TASK, each packed on its own: a sequence starts with the longest piece
left, takes the longest that still fits until none does, and then, if a gap is left, its smallest piece makes way for
the two unpacked pieces that fill the wider gap most tightly, if they fill more of it. Where that takes
more sequences than the tokens need, it is tried again with small pieces kept back to fill the tightest gaps last, and
the better of the two stays. A task wastes at most a few sequences, so the number of sequences doesn't depend on the number of tasks to any extent that matters.

Defined cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed once each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import documents, staged
from lumenfold.llm.tokens import ROWS, encoder, in_chunks

#: In the second try, pieces up to a SMALL_PART-th of a sequence wait until the longer ones are packed.
SIZE, PIECES_A_TASK, SMALL_PART = 2048, 20_000, 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, end_id: int, size: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], "<u4").tobytes()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in in_chunks(texts):
                rows = []
                for name, got in zip(names[i:j], encoder(tokenizer).encode(texts[i:j]), strict=True):
                    ids = got + tail
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Whole texts as pieces of at most size tokens, the end id included."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end_id, size, with_ids), PIECES + ", ids binary" * with_ids)


class _Shelf:
    """Indexes by a number from 0 to size; the set of numbers in use is one integer, so a neighbour is a bit scan away."""

    def __init__(self, size: int):
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.used = 0

    def put(self, n: int, i: int) -> None:
        self.at[n].append(i)
        self.used |= 1 << n

    def take(self, n: int) -> int:
        i = self.at[n].pop()
        if not self.at[n]:
            self.used &= ~(1 << n)
        return i

    def most(self, upto: int) -> int:
        """The largest number in use up to upto; 0 if there is none."""
        return max((self.used & ((2 << upto) - 1)).bit_length() - 1, 0) if upto > 0 else 0

    def least(self, n: int) -> int:
        """The smallest number in use from n on; 0 if there is none."""
        up = self.used >> n
        return n + (up & -up).bit_length() - 1 if up else 0


def _tighter(left: _Shelf, room: int, best: int) -> tuple[int, int] | None:
    """Lengths of two unpacked pieces that together fill room best, and more of it than best."""
    pair, a = None, left.most(room - 1)
    while a and 2 * a >= best:
        b = left.most(min(room - a, a))
        if b == a and len(left.at[a]) < 2:
            b = left.most(a - 1)
        if b and a + b > best:
            best, pair = a + b, (a, b)
            if best == room:
                break
        a = left.most(a - 1)
    return pair


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes into lengths (each from 1 to size)."""
    bins = _fit(lengths, size, 0)
    if len(bins) * size - sum(lengths) < size:  # no packing has fewer
        return bins
    return min(bins, _fit(lengths, size, size // SMALL_PART), key=len)


def _fit(lengths: list[int], size: int, wait: int) -> list[list[int]]:
    """Pieces of a length up to wait are kept back until the longer ones are packed."""
    left, small = _Shelf(size), _Shelf(size)
    for i, n in enumerate(lengths):
        (left if n > wait else small).put(n, i)
    bins: list[list[int]] = []
    gaps = _Shelf(size)
    while left.used:
        n = left.most(size)
        inside, gap = [(n, left.take(n))], size - n
        while n := left.most(gap):
            inside.append((n, left.take(n)))
            gap -= n
        if gap and len(inside) > 1 and left.used:
            out = min(inside)
            if pair := _tighter(left, gap + out[0], out[0]):
                inside.remove(out)
                left.put(*out)
                inside += [(x, left.take(x)) for x in pair]
                gap += out[0] - sum(pair)
        gaps.put(gap, len(bins))
        bins.append([i for _, i in inside])
    while small.used:  # longest first, into the tightest gap
        n = small.most(size)
        gap = gaps.least(n)
        k = gaps.take(gap) if gap else len(bins)
        if not gap:
            gap = size
            bins.append([])
        bins[k].append(small.take(n))
        gaps.put(gap - n, k)
    return bins


def _pack(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = [b for b in batches if len(b)]
        if not held:
            return
        p = pd.concat(held, ignore_index=True)
        lengths = p["length"].to_numpy()
        seq, off = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for k, inside in enumerate(best_two_fit(lengths.tolist(), size)):
            at = np.array(inside)
            seq[at] = (TaskContext.get().partitionId() << 32) + k
            off[at] = np.cumsum(lengths[at]) - lengths[at]
        yield p.assign(sequence_id=seq, offset=off)

    return run


def pack(pieces: DataFrame, size: int = SIZE, per_task: int = PIECES_A_TASK) -> DataFrame:
    """pieces with sequence_id and offset. pieces should be a written table, as it is counted first."""
    n = 1 + pieces.count() // per_task
    # rows that repeat are dealt apart by their place in the table, so a text that repeats often spreads too
    dealt = pieces.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))
    return dealt.mapInPandas(_pack(size), f"{pieces._jdf.schema().toDDL()}, sequence_id long, offset long")


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary, little-endian unsigned 32-bit), from pieces that carry ids; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(documents(spark, sf_dir))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(staged(cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 0), "pieces"))
