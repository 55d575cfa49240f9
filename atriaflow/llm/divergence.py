"""Divergence of the sources of a language by pair tasks over sorted (term id, count) arrays.

Terms are counted exactly in numpy steps per task, then summed. A language keeps the terms of at least `least` of its documents; kept terms get ids, and each
(language, source) group its counts as arrays sorted by id, cut into segments of about SEGMENT terms by a hash of the term. Each unordered pair of
groups co-groups its two arrays, segment by segment: a galloping intersection finds what both have, the rest is one-sided, and what neither has is
priced in closed form from the number of terms. One price holds for both ways.

price(count) = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the group's counts of kept terms, V the number of kept terms of the language; a pair's price of
a term is floor((p - q)^2 / (p + q)). All in whole numbers: quotients by long division in steps of 1000, so that a group may have 9 * 10^15 terms.

Defined cases: null text, lang or source is empty; a text without terms makes a group without terms; a repeated row is another document; a language that keeps no term has
only pairs of value 0; a language with one source has no pairs; very long texts are counted whole; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, renewed, row_of, steps, stored, text_arrays

LEAST_DOCS = 10
TOP_TERMS = 10
#: Terms of a segment, on average.
SEGMENT = 1 << 16
#: Bytes of text that one step counts.
COUNT_BYTES = 8 << 20
SCALE = 10**9

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(raw: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, pa.Array]:
    """The terms of rows lo..hi in order: their rows, and the terms themselves."""
    data, rows = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
    letter = _LETTER[data]
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    edge = rows[:-1][rows[:-1] < len(data)]
    starts[edge] = letter[edge]
    at = np.flatnonzero(starts)
    # letters alone, put together: a term begins where so many letters came before it
    before = np.cumsum(letter)
    ends = np.append(before[at] - 1, before[-1] if len(data) else 0).astype(np.int64)
    kept = _LOWER[data[letter]]
    terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(kept)))
    return row_of(np.searchsorted(at, rows)), terms


def _counts(batches):
    """Texts -> per step, group and term the occurrences and the documents with it."""
    for batch in batches:
        raw, offs = text_arrays(batch["text"])
        groups = pa.StructArray.from_arrays([batch["lang"], batch["source"]], ["lang", "source"])
        for lo, hi in steps(offs, COUNT_BYTES):
            row, terms = _terms(raw, offs, lo, hi)
            if not len(row):
                continue
            coded = terms.dictionary_encode()
            term, n_terms = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups[lo:hi].to_pylist()], dtype=np.int64)
            # once per document and term, then once per group and term
            each, n = np.unique(row * n_terms + term, return_counts=True)
            key, at = np.unique(group[each // n_terms] * n_terms + each % n_terms, return_inverse=True)
            total, docs = np.bincount(at, weights=n), np.bincount(at)
            pairs = list(names)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([x for x, _ in pairs], pa.string()).take(pa.array(key // n_terms)), "source": pa.array([x for _, x in pairs], pa.string()).take(pa.array(key // n_terms)),
                "term": coded.dictionary.take(pa.array(key % n_terms)).cast(pa.string()), "n": pa.array(total.astype(np.int64)), "docs": pa.array(docs.astype(np.int64)),
            })


def price(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), by long division."""
    whole, left = np.divmod(np.asarray(count, dtype=np.int64) + 2, np.int64(max(total, 1)))
    for _ in range(3):
        step, left = np.divmod(left * 1000, np.int64(max(total, 1)))
        whole = whole * 1000 + step
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def gallop(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the ids that both sorted arrays have: the shorter array's ids are looked up in the longer one."""
    if len(a) > len(b):
        y, x = gallop(b, a)
        return x, y
    at = np.searchsorted(b, a)
    hit = at < len(b)
    hit[hit] = b[at[hit]] == a[hit]
    return np.flatnonzero(hit), at[hit]


def _priced(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one segment of a pair: the prices of the terms that either side has, and how many these are."""
    lang, a, b, _ = (x.as_py() for x in key)
    sides, totals = [], []
    for side in (left, right):
        sides.append(tuple(side[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if side.num_rows else np.zeros(0, np.int64) for c in ("ids", "counts")))
        totals.append(side["mine"][0].as_py() if side.num_rows else None)
    # a side without a row in this segment: its total is what the other side's pair row says
    total_a = totals[0] if totals[0] is not None else right["other"][0].as_py()
    total_b = totals[1] if totals[1] is not None else left["other"][0].as_py()
    (ids_a, n_a), (ids_b, n_b) = sides
    x, y = gallop(ids_a, ids_b)
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[x] = only_b[y] = False
    p, q, none = price(n_a, total_a), price(n_b, total_b), np.zeros(1, np.int64)
    value = apart(p[x], q[y]).sum() + apart(p[only_a], price(none, total_b)).sum() + apart(price(none, total_a), q[only_b]).sum()
    return pa.table({
        "lang": pa.array([lang], pa.string()), "a": pa.array([a], pa.string()), "b": pa.array([b], pa.string()),
        "value": pa.array([int(value)], pa.int64()), "terms": pa.array([len(ids_a) + len(ids_b) - len(x)], pa.int64()),
    })


def _price(count: str | Column, total: str) -> Column:
    count = F.col(count) if isinstance(count, str) else count
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", whole(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(F.col(total))) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part ('pair' or 'term'), item, value, rank."""
    own = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    sums = own.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term")
    counts = stored(sums.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "lang_n").withColumn("id", F.monotonically_increasing_id()), "kept")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    terms = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "terms")
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(size, "lang", "left")
    v, n = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0))
    groups = stored(groups.select("lang", "source", v.alias("v"), (n + 2 * v).alias("total"), (F.coalesce("lang_total", F.lit(0)) + 2 * v).alias("lang_total")), "groups")

    # the pairs, and the arrays that each of them wants
    a = groups.select("lang", F.col("source").alias("a"), "v", F.col("total").alias("total_a"))
    b = groups.select(F.col("lang").alias("l"), F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = stored(a.join(b, (F.col("lang") == F.col("l")) & (F.col("a") < F.col("b"))).drop("l"), "pairs")
    cut = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / SEGMENT)).cast("int")
    arrays = terms.join(groups.select("lang", "source", "v"), ["lang", "source"]).groupBy("lang", "source", cut.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("s"))
    arrays = stored(arrays.select(F.col("lang").alias("l"), "source", "segment", F.transform("s", lambda x: x["id"]).alias("ids"), F.transform("s", lambda x: x["n"]).alias("counts")), "arrays")

    def side(name: str, mine: str, other: str) -> DataFrame:
        met = pairs.join(arrays, (F.col("lang") == F.col("l")) & (F.col(name) == F.col("source")))
        return met.select("lang", "a", "b", "segment", "ids", "counts", F.col(mine).alias("mine"), F.col(other).alias("other"))

    keys = ["lang", "a", "b", "segment"]
    met = side("a", "total_a", "total_b").groupBy(*keys).cogroup(renewed(side("b", "total_b", "total_a")).groupBy(*keys))
    priced = met.applyInArrow(_priced, "lang string, a string, b string, value long, terms long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    both = pairs.join(priced, ["lang", "a", "b"], "left")
    nil = F.lit(0).cast("long")
    absent = (F.col("v") - F.coalesce("terms", nil)) * _apart(_price(nil, "total_a"), _price(nil, "total_b"))
    value = F.when(F.col("v") == 0, nil).otherwise(F.coalesce("value", nil) + absent)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = both.select("lang", value.alias("value"), ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    both = both.withColumn("rank", ranked)

    # what a group has more of than its language
    p, q = _price("n", "total"), _price("lang_n", "lang_total")
    more = terms.join(groups, ["lang", "source"]).withColumns({"p": p, "q": q}).filter("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", ranked).filter(F.col("rank") <= top)
    return both.unionByName(more).withColumn("rank", F.col("rank").cast("int"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS own, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT own, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT own) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, source, o.term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * l.v))::BIGINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2) // (l.n + 2 * l.v))::BIGINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
