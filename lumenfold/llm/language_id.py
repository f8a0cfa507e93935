"""Language ID by hyperdimensional profiles: random letter vectors, bound into n-grams, bundled, compared by cosine.

Every letter has a random vector of DIM signs, drawn from a generator seeded with its code point; what parts words is a
letter of its own. A trigram stands around each letter of a text: the vector of the letter before it rotated by two, its
own rotated by one, and that of the letter behind it, multiplied component by component. A text's profile is the sum of
its trigrams, a language's prototype the sum of the profiles of its learning documents. The prediction is the language
whose prototype has the greatest cosine with the profile.

A batch is bundled as a matrix product of its counts (texts by trigrams) and the trigrams' vectors. All sums are exact
integers, so they don't depend on how rows are batched. Very long texts are read in pieces that overlap by a letter.

Learning reads about LEARN documents of each language, taken by a hash of id and text (their number varies around LEARN
as a binomial does); a language with fewer gives all. Tasks sum them, so no task or driver holds texts; the prototypes
are languages times DIM numbers, and more than LANGUAGES of them raise, as such a column doesn't hold languages.

Defined cases: a null text or one without letters is `und` with score 0, as is any text if nothing could be learned; of
equal cosines the language whose name comes first wins; a null id is neither held out nor learned from; rows that repeat
are predicted alike; an empty table gives no rows; other columns are ignored. Letters are what Unicode calls so, each
lower-cased on its own where that is a single letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import documents, memo, shuffle_partitions

DIM, LEARN, LANGUAGES, SEED, UNKNOWN = 1024, 2000, 4096, 11, "und"
#: Texts and letters of one matrix product, characters of a piece, and trigrams expanded at a time.
TEXTS, LETTERS, PIECE, BLOCK = 128, 1 << 17, 1 << 20, 8192
#: Prototypes are scaled to this length and rounded, so that dot products are sums of integers.
LENGTH = 1 << 20


@lru_cache(maxsize=4096)
def letter_vector(code: int, dim: int) -> np.ndarray:
    """The signs of a letter; code 0 is what parts words."""
    return np.random.default_rng((SEED, code)).integers(0, 2, dim, np.int8) * 2 - 1


class Letters:
    """Lower-cased letters by code point, 0 for what isn't one; filled in pages of 256 as texts need them."""

    def __init__(self) -> None:
        self.table, self.known = np.zeros(0x110000, np.int32), np.zeros(0x1100, bool)

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        pages = np.flatnonzero(np.bincount(codes >> 8, minlength=1))
        for page in pages[~self.known[pages]].tolist():
            for code in range(page << 8, (page + 1) << 8):
                c = chr(code)
                if c.isalpha():
                    low = c.lower()
                    self.table[code] = ord(low) if len(low) == 1 else code
            self.known[page] = True
        return self.table[codes]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts by number, with their letters, as many as one product takes; each piece has a neighbour on both ends."""
    letters = memo("language", "letters", Letters)
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            left, right = max(at - 1, 0), at + PIECE + 1
            x = letters.of(text[left:right])
            ends = ([] if left < at else [0]), ([] if right <= len(text) else [0])
            x = np.concatenate([np.array(ends[0], np.int32), x, np.array(ends[1], np.int32)])
            rows.append(i)
            parts.append(x)
            size += len(x)
            if size >= LETTERS or len(rows) >= TEXTS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _trigrams(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (three codes a row), and for each letter of the parts the number of its part and its trigram."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    whole, part = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
    seen = np.zeros(int(whole.max(initial=0)) + 1, bool)
    seen[0] = seen[whole] = True
    codes = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    local = number[whole]
    on = local > 0
    on[ends - sizes] = on[ends - 1] = False  # neighbours only
    own = np.flatnonzero(on)
    a, b, c, part = local[own - 1], local[own], local[own + 1], part[own]
    n = len(codes)
    joined = (a * n + b) * n + c
    if n**3 <= 1 << 22:
        seen = np.zeros(n**3, bool)
        seen[joined] = True
        distinct = np.flatnonzero(seen)
        number = np.empty(n**3, np.int32)
        number[distinct] = np.arange(len(distinct))
        which = number[joined]
    else:
        distinct, which = np.unique(joined, return_inverse=True)
    return np.stack([codes[distinct // (n * n)], codes[distinct // n % n], codes[distinct % n]], axis=1), part, which


def expand(trigrams: np.ndarray, dim: int) -> np.ndarray:
    """The sign vectors of trigrams."""
    codes, place = np.unique(trigrams, return_inverse=True)
    base = np.stack([letter_vector(int(c), dim) for c in codes])
    a, b, c = place.reshape(trigrams.shape).T
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def profiles(texts: list[str | None], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The profile of each text (exact integers, as doubles), and how many letters it has."""
    out, n = np.zeros((len(texts), dim)), np.zeros(len(texts), np.int64)
    for rows, parts in _pieces(texts):
        trigrams, part, which = _trigrams(parts)
        size = np.bincount(part, minlength=len(parts))
        if not len(trigrams):
            continue
        counts = np.bincount(part * len(trigrams) + which, minlength=len(parts) * len(trigrams)).reshape(len(parts), -1).astype(np.float32)
        total = np.zeros((len(parts), dim), np.float32)  # exact: a part has far fewer than 2 ** 24 letters
        for i in range(0, len(trigrams), BLOCK):
            total += counts[:, i : i + BLOCK] @ expand(trigrams[i : i + BLOCK], dim).astype(np.float32)
        np.add.at(out, rows, total)
        np.add.at(n, rows, size)
    return out, n


def _learn(dim: int):
    """lang, place, total: the sum of the profiles that a task has seen of each language."""
    schema = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                found, _ = profiles(some.column(1).to_pylist(), dim)
                of = np.array(some.column(0).to_pylist(), object)
                for lang in set(of.tolist()):
                    total[lang] = total.get(lang, 0) + found[of == lang].sum(axis=0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v.astype(np.int64))], schema=schema)

    return run


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def prototypes(docs: DataFrame, dim: int = DIM, learn: int = LEARN) -> tuple[list[str], np.ndarray]:
    """Languages in order of their names, and their prototypes. docs: doc_id, text, lang."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang: not a column of languages")
    if not sizes:
        return [], np.zeros((0, dim))
    share = docs.sparkSession.createDataFrame([(r["lang"], learn / r["n"]) for r in sizes], "lang string, _share double")
    u = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    taken = rows.join(F.broadcast(share), "lang").where(u < F.col("_share")).select("lang", "text")
    sums = taken.repartition(shuffle_partitions(docs.sparkSession), F.xxhash64("text")).mapInArrow(_learn(dim), "lang string, place int, total long")
    found: dict[str, np.ndarray] = {}
    for lang, place, total in sums.groupBy("lang", "place").agg(F.sum("total")).collect():
        found.setdefault(lang, np.zeros(dim))[place] = total
    langs = sorted((lang for lang, v in found.items() if v.any()), key=lambda x: x.encode())
    return langs, np.stack([found[x] for x in langs]) if langs else np.zeros((0, dim))


def _predict(langs: list[str], model: np.ndarray, dim: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_letters", pa.int64())])
    unit = np.rint(model / np.linalg.norm(model, axis=1, keepdims=True) * LENGTH) if langs else model
    length = np.linalg.norm(unit, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                found, n = profiles(some.column(2).to_pylist(), dim)
                names, score = [UNKNOWN] * len(n), np.zeros(len(n))
                if langs:
                    size = np.sqrt((found * found).sum(axis=1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cosine = np.round(found @ unit.T / size[:, None] / length, 9)
                    known = (n > 0) & (size > 0)
                    best = np.where(known[:, None], cosine, 0).argmax(axis=1)
                    names = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score = np.where(known, np.clip(cosine[np.arange(len(n)), best], 0, 1), 0)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names), pa.array(score), pa.array(n)], schema=schema)

    return run


def identify(docs: DataFrame, dim: int = DIM, learn: int = LEARN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_letters of each row. docs: doc_id, text, lang."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, model = prototypes(rows, dim, learn)
    told = rows.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "text")
    return told.mapInArrow(_predict(langs, model, dim), "doc_id long, held_out boolean, lang_pred string, score double, n_letters long")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_letters."""
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
