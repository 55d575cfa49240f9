"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 60-bit hash. Sizes are summed by (source, first BITS bits); the cumulative histogram names, for each source,
the bucket in which its budget runs out. Only the rows of that boundary bucket are summed again by the next BITS bits, and
so on (at most LEVELS passes over a light table), until the bucket is one hash value. Rows below the threshold are taken: a comparison,
no sort. Beyond a source's own size the thresholds are nested: all rows once, and those below a second threshold twice.

Between the two ends of the last bucket the nearer to the budget is chosen. The histograms have 2^BITS rows per source at
most and are reduced by map-side sums, so a hot source costs no more than others.

Defined cases: null text has size 0 (taken 0 in words, the row counts as taken once or twice as the rest); a null source is
a source, the last; rows that repeat id and text share a hash and are taken together; with all sizes 0 every target is 0; empty tables
give empty results; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, n_words, stored, unused

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
CAP = 2.0
BITS = 12
LEVELS = 5


def row_hash() -> Column:
    """60 bits of the MD5 of id and text; the same in any engine."""
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) with target: shares of share * total by weight, none above cap * its size.

    Water filling without a loop: a source is capped once level * weight reaches its cap. In the order of cap/weight, the level
    after capping the first j is (budget - their caps) / (weights of the rest); the true level is the largest of these.
    One row per source, so the windows are over the list of sources, not over data.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level rises while sources are capped that are above their caps, and falls with the first that is not, ties among them too
    ranked = ranked.withColumn("level", level)
    return ranked.withColumn("target", F.least(F.col("most"), F.max("level").over(every) * F.col("weight"))).select("source", "source_size", "target")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows(source, size, hash), budgets(source, budget): the hash below which each source's rows fill its budget best."""
    state = budgets.withColumn("prefix", F.lit(0).cast("long")).withColumn("left", F.col("budget").cast("double"))
    for level in range(LEVELS):
        above, below = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        inside = rows if level == 0 else rows.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", above) == F.col("prefix"))).select(*rows.columns)
        bins = inside.groupBy("source", F.shiftright("hash", below).alias("bin")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("size").over(run)).withColumn("from", F.col("upto") - F.col("size"))
        joined = bins.withColumnRenamed("source", "s").join(state, F.col("s").eqNullSafe(F.col("source")))
        # the boundary bin: the first whose cumulative size passes what is left; without one, all of this level is taken
        cut = joined.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bin", "from", "upto"))).alias("cut"), F.max("bin").alias("last"))
        state = state.alias("a").join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        hit = F.col("cut").isNotNull()
        state = state.select(
            "source", "budget",
            F.when(hit, F.col("cut.bin")).otherwise(F.coalesce(F.col("last") + 1, F.shiftleft("prefix", BITS))).alias("prefix"),
            F.when(hit, F.col("left") - F.col("cut.from")).otherwise(F.lit(0.0)).alias("left"),
            F.when(hit, F.col("cut.upto") - F.col("cut.from")).alias("boundary"),
        )
        if level < LEVELS - 1:
            state = stored(state.drop("boundary"), f"thresholds{level}")
    # the last bin is one hash value: take it if that comes nearer
    return state.select("source", (F.col("prefix") + F.when(F.col("boundary") - F.col("left") < F.col("left"), 1).otherwise(0)).alias("threshold"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, hash, size, source, source_size, target, times (0, 1 or 2)."""
    rows = stored(docs.select("doc_id", "source", n_words("text").alias("size"), row_hash().alias("hash")), "sizes")
    totals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    whole = F.col("target") >= F.col("source_size")
    cuts = thresholds(rows, totals.select("source", F.when(whole, F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("budget")))
    plan = stored(totals.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "threshold"), "plan")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("times", (F.when(whole, 1).otherwise(0) + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int")).drop("threshold")


def keep_mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """docs as often as the mix takes them (0, 1 or 2 rows each); all columns are kept."""
    hash_, times, copy = unused(docs, 3)
    keyed = docs.withColumn(hash_, row_hash())
    taken = stored(mix(docs, weights, share, cap).filter("times > 0").groupBy(F.col("hash").alias(hash_)).agg(F.max("times").alias(times)), "taken")
    return keyed.join(taken, hash_).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("times")).cast("long").alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w FROM s),
-- round k: the sources that are capped so far; the rest share what is left by weight
c AS (
  SELECT 0 AS k, source, source_size, w, false AS capped, 1.5 * sum(source_size) OVER () * w / sum(w) OVER () AS target FROM r
  UNION ALL
  SELECT k + 1, source, source_size, w, capped OR target > 2 * source_size,
    CASE WHEN capped OR target > 2 * source_size THEN 2.0 * source_size ELSE
      (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped OR target > 2 * source_size THEN 2.0 * source_size ELSE 0 END) OVER ()) * w
        / sum(CASE WHEN capped OR target > 2 * source_size THEN 0 ELSE w END) OVER () END
  FROM c WHERE k < 60),
t AS (SELECT source, source_size, target FROM c WHERE k = 60),
h AS (
  SELECT d.source, d.hash, sum(d.size) AS size, any_value(t.source_size) AS source_size, any_value(t.target) AS target,
    any_value(CASE WHEN t.target >= t.source_size THEN t.target - t.source_size ELSE t.target END) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
x AS (SELECT *, upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size)) AS hit FROM u)
SELECT d.doc_id, d.size, x.source_size, round(x.target, 6) AS target,
  (d.size * ((x.target >= x.source_size)::INT + x.hit::INT))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.hash = x.hash"""
