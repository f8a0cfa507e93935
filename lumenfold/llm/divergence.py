"""Source divergence audit: how the terms of each source of a language depart from the language and from each other.

Counts become integers p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), and two of them differ by
f = floor((p - q)^2 / (p + q)), so sums are exact whatever their order. Texts are counted once, by (lang, source, term):
tasks count on UTF-8 bytes, whose lower() knows A-Z alone, and give up their counts whenever they hold ENTRIES terms.

Pairs of sources are sparse: a term that neither has gives the same f, that of the two baselines (count 0). So a pair's
sum is V times that, plus corrections for what one of them has (taken from histograms of its p, not from its terms), plus
corrections for the terms that both have. Each is summed by partial aggregation; no term of count 0 is ever a row.

The largest values of a group are found by radix selection: histograms over DIGIT bits of the value, from the top, narrow
each group's k-th value; its ties are refined by histograms over the UTF-8 byte at which they first differ, until FEW are
left. Only rows at or above the threshold are ever ordered.

What is told of the groups goes to every task if there are at most GROUPS of them, else rows and groups are shuffled. That
isn't left to Spark: it goes by the size of files, in which names compress to little, and has broadcast the terms themselves.

Defined cases: null text, lang and source are ''; a group without terms has all its pairs, of which those with value 0 tie
by name; a language without kept terms has pairs of value 0; rows that repeat are documents of their own; a term is as
long as its run of characters; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, documents, staged

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Values lie below 2 ** WIDTH, as p - q <= SCALE and f <= p - q.
DIGIT, WIDTH, FEW, SALTS = 8, 32, 1024, 16
ENTRIES, PIECE, GROUPS = 200_000, 1 << 20, 20_000
#: A term, and what parts terms, in UTF-8: every byte of another character lies above ASCII.
TERM, BETWEEN = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
GROUP = ["lang", "source"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a lower-cased text; of a long one in pieces that end between terms."""
    start = 0
    while start < len(text):
        cut = BETWEEN.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield TERM.findall(text, start, end)
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for group, counts in n.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([group[0]] * len(counts)), pa.array([group[1]] * len(counts)), terms, pa.array(list(counts.values())), pa.array([docs[group][w] for w in counts])], schema=_COUNTS)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            group = (lang, source)
            if group not in n:
                n[group], docs[group] = Counter(), Counter()
            counts, before, seen = n[group], len(n[group]), set()
            for words in pieces(text.as_py().lower()):
                counts.update(words)
                seen.update(words)
            docs[group].update(seen)
            held += len(counts) - before
            if held > ENTRIES:
                yield from told()
                n, docs, held = {}, {}, 0
    yield from told()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, n_docs of every term, kept or not. docs: lang, source, text."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in GROUP], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    partial = rows.mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    return partial.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def smoothed(count: Column, size: Column) -> Column:
    """p of a count where N + 2 V = size; exact whatever the counts, as the product is a decimal."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, size.cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _with_groups(rows: DataFrame, told: DataFrame, by: list[str], n: int) -> DataFrame:
    """rows with what is told of their groups, of which there are n."""
    return rows.join(F.broadcast(told) if n <= GROUPS else told.hint("merge"), by)


def _cumulated(hist: DataFrame, by: list[str], digit: Column) -> DataFrame:
    """The digit of each group at which the running count (_n, in the digit's order) reaches _need; _need less what is before it."""
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(digit).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return hist.withColumn("_before", before).where("_before < _need and _before + _n >= _need").withColumn("_need", F.col("_need") - F.col("_before")).drop("_n", "_before")


def _first_difference(a: Column, b: Column) -> Column:
    """The 0-based place of the first byte in which two different strings differ, or at which the shorter ends."""
    x, y = a.cast("binary"), b.cast("binary")
    shorter = F.least(F.octet_length(a), F.octet_length(b))
    unlike = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1)))
    return F.coalesce(F.get(unlike, F.lit(0)) - 1, shorter)


def radix_top(rows: DataFrame, by: list[str], value: str, item: str, k: int, few: int = FEW) -> DataFrame:
    """The k rows of each group with the largest values, the least items (UTF-8 bytes) among equal ones; their rank is added.

    rows: read more than once, so a written table; values from 0 below 2 ** WIDTH, items not null and unlike within a group.
    """
    sizes = staged(rows.groupBy(*by).agg(F.least(F.lit(k).cast("long"), F.count("*")).alias("_need")), "group-sizes")
    n, state = sizes.count(), sizes.withColumn("_high", F.lit(0).cast("long"))
    for shift in range(WIDTH - DIGIT, -1, -DIGIT):
        inside = _with_groups(rows, state, by, n).where(F.shiftright(value, shift + DIGIT) == F.col("_high"))
        hist = inside.groupBy(*by, "_need", "_high", F.shiftright(value, shift).bitwiseAND((1 << DIGIT) - 1).alias("_digit")).agg(F.count("*").alias("_n"))
        state = _cumulated(hist, by, F.desc("_digit")).select(*by, "_need", (F.col("_high") * (1 << DIGIT) + F.col("_digit")).alias("_high"))
    state = staged(state, "thresholds")
    reached = _with_groups(rows, state, by, n)
    sure, ties = [reached.where(F.col(value) > F.col("_high")).select(*rows.columns)], reached.where(F.col(value) == F.col("_high")).select(*rows.columns, "_need")
    tables = [sizes, state]
    while True:
        spans = ties.groupBy(*by).agg(F.min(item).alias("_a"), F.max(item).alias("_b"), F.count("*").alias("_n"), F.min("_need").alias("_need")).where(F.col("_n") > F.greatest(F.lit(few), "_need"))
        spans = staged(spans.select(*by, "_need", _first_difference(F.col("_a"), F.col("_b")).alias("_at")), "tie-spans")
        tables.append(spans)
        if spans.isEmpty():
            break
        byte = F.conv(F.hex(F.substr(F.col(item).cast("binary"), F.col("_at") + 1, F.lit(1))), 16, 10).cast("int")
        placed = _with_groups(ties.drop("_need"), spans, by, n).withColumn("_digit", F.when(F.octet_length(item) > F.col("_at"), byte).otherwise(-1))
        pick = _cumulated(placed.groupBy(*by, "_need", "_digit").agg(F.count("*").alias("_n")), by, F.asc("_digit")).select(*by, "_need", F.col("_digit").alias("_pick"))
        split = _with_groups(placed.drop("_need"), pick, by, n)
        sure.append(staged(split.where("_digit < _pick").select(*rows.columns), "ties-taken"))
        ties = staged(split.where("_digit = _pick").select(*rows.columns, "_need").unionByName(ties.join(spans, by, "left_anti")), "ties-left")
        tables += [sure[-1], ties]
    last = ties.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(item))).where("_place <= _need").select(*rows.columns)
    for s in sure:
        last = last.unionByName(s)
    best = staged(last.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), item))), "top-terms")
    discard(*tables)
    return best


def _pairs(kept: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """lang, a, b, value for each two sources a < b of a language. kept: lang, source, term, p; facts: n rows of lang, source, v, p0."""
    left = facts.withColumn("_salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    right = facts.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    two = staged(left.join(right.hint("merge"), ["lang", "_salt"]).where("source <> other").select("lang", "source", "other", "v", "p0", "q0"), "source-pairs")
    base = apart(F.col("p0"), F.col("q0"))
    ends = [F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    neither = two.where("source < other").select("lang", *ends, (F.col("v") * base).alias("value"))
    hist = kept.groupBy(*GROUP, "p").agg(F.count("*").alias("m"))
    one = two.join(hist.hint("merge"), GROUP).select("lang", *ends, (F.col("m") * (apart(F.col("p"), F.col("q0")) - base)).alias("value"))
    x = _with_groups(kept, facts.drop("v"), GROUP, n)
    y = x.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = x.join(y.hint("merge"), ["lang", "term"]).where("source < other").select("lang", *ends, (apart(p, q) - apart(p, q0) - apart(p0, q) + base).alias("value"))
    out = staged(neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair-sums")
    discard(two)
    return out


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, few: int = FEW) -> DataFrame:
    """lang, source, part, item, value, rank. docs: lang, source, text."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP])
    groups = staged(named.distinct(), "source-groups")
    within = W.partitionBy("lang", "term")
    counts = term_counts(docs.select(*[F.col(c).cast("string").alias(c) for c in GROUP], F.col("text").cast("string").alias("text")))
    told = counts.withColumns({"lang_n": F.sum("n").over(within), "lang_docs": F.sum("n_docs").over(within)})
    terms = staged(told.where(F.col("lang_docs") >= min_docs).select(*GROUP, "term", "n", "lang_n"), "kept-terms")
    by_lang = terms.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_size"))
    facts = groups.join(terms.groupBy(*GROUP).agg(F.sum("n").alias("size")), GROUP, "left").join(by_lang, "lang", "left")
    facts = facts.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("size", "v", "lang_size")})
    facts = facts.withColumns({"size": F.col("size") + 2 * F.col("v"), "lang_size": F.col("lang_size") + 2 * F.col("v")})
    facts = staged(facts.withColumn("p0", F.when(F.col("v") > 0, smoothed(F.lit(0).cast("long"), F.col("size"))).otherwise(F.lit(1).cast("long"))), "source-facts")
    n = facts.count()
    sized = staged(_with_groups(terms, facts, GROUP, n).select(*GROUP, "term", smoothed(F.col("n"), F.col("size")).alias("p"), smoothed(F.col("lang_n"), F.col("lang_size")).alias("q")), "term-shares")
    discard(groups, terms)
    sums = _pairs(sized.drop("q"), facts.select(*GROUP, "v", "p0"), n)
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    above = staged(sized.where("p > q").select(*GROUP, F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")), "terms-above")
    best = radix_top(above, GROUP, "value", "item", top, few)
    discard(facts, sized, above)
    out = [*GROUP, "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(best.withColumn("part", F.lit("term")).select(*out))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return divergence(documents(spark, sf_dir).select("lang", "source", "text"))


#: Every term of every group, with its count or 0, compared one by one.
ORACLE = {
    "op13": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
x AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
  1 + (1000000000::HUGEINT * (lang_n + 2)) // (sum(lang_n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q FROM x),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT g.lang, g.source, h.source AS item, coalesce(two.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN two ON two.lang = g.lang AND two.source = g.source AND two.item = h.source),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
a AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM a)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
