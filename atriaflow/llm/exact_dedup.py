"""Exact deduplication through a minimal perfect hash over the distinct digests of the history.

The history's digests are dealt to regions of about REGION_KEYS keys. Within a region, small buckets of keys get a
displacement ("pilot") that sends every key of the bucket to a free slot of the region, until the region's m keys fill
its slots 0..m-1 (hash and displace). A region whose keys cannot be parted, as two of them agree in what its hash uses, takes the next
seed, which mixes in further bits of the digest. A slot holds its full digest and the locator of its winner. A lookup computes
bucket -> pilot -> slot with integer columns, then compares the whole digest with the slot's: equal digests are
members, whose repeats go; others are no members, and are grouped among themselves.

A table that is its own input (`group_exact`) takes the rows with the larger half of the id range for its history, as of equal texts the
row with the largest id stays: what the history holds wins. Members count the copies they have among the other rows; nonmembers are grouped.

Nothing is collected: regions are built side by side, the index is a table (pilots and slots), and copies meet only
as partial aggregates. Every join that has a hot digest's rows on one side has a stored table with one row per
key on the other, so that Spark's skew join can split it.

Defined cases: null text counts as empty; a null doc_id loses against any doc_id; of rows that repeat both doc_id and
text one stays; empty tables give empty results; other columns pass through and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, unused

REGION_KEYS = 4096
BUCKET_KEYS = 4
#: Seeds that a region tries; equal digests alone can exhaust them.
SEEDS = 256
#: Hex digits of the digest where the 28-bit words of the two hashes, and of what a seed adds to them, start.
_HASH_AT = ((22, 36), (29, 43))


def digest_of(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit("")).cast("binary"), 256)


def _word(at: int) -> Column:
    """28 bits of the hex digest, from hex digit at."""
    return F.conv(F.substring("digest", at, 7), 16, 10).cast("long")


def _keys(df: DataFrame, regions: int, per_region: int) -> DataFrame:
    return df.withColumn("region", _word(1) % regions).withColumn("bucket", _word(8) % per_region)


def _fill(group: pa.Table) -> pa.Table:
    """Pilots and slots of one region, and the seed that they are of. A key's slot is (f1 + (pilot div m) * f2 + pilot) mod m."""
    m, digests, bucket = len(group), group["digest"].to_pylist(), group["bucket"].to_numpy()
    words = [[np.array([int(d[a - 1 : a + 6], 16) for d in digests], dtype=np.int64) for a in at] for at in _HASH_AT]
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    buckets = sorted((order[p:q] for p, q in zip(bounds[:-1], bounds[1:])), key=len, reverse=True)
    for seed in range(SEEDS):
        f1, f2 = ((low + seed * high) % m for low, high in words)
        if (placed := _place(f1, f2, buckets, m)) is not None:
            for name, values in (("slots", np.full(m, m)), ("seed", np.full(m, seed)), ("pilot", placed[0]), ("slot", placed[1])):
                group = group.append_column(name, pa.array(values, pa.int64()))
            return group
    raise ValueError("the history repeats a digest")


def _place(f1: np.ndarray, f2: np.ndarray, buckets: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pilots and slots of m keys, largest bucket first; None if two keys of a bucket have the same hashes."""
    free = np.ones(m, dtype=bool)
    slot, pilot = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    shift = np.arange(m)
    for own in buckets:
        if len(own) == 1:
            at = int(np.argmax(free))
            pilot[own], slot[own], free[at] = (at - int(f1[own[0]])) % m, at, False
            continue
        if len(np.unique(f1[own] * m + f2[own])) < len(own):
            return None
        for turn in range(m):
            base = (f1[own] + turn * f2[own]) % m
            if len(np.unique(base)) < len(own):
                continue
            open_ = np.logical_and.reduce([free[(x + shift) % m] for x in base])
            if open_.any():
                d = int(np.argmax(open_))
                pilot[own], slot[own] = turn * m + d, (base + d) % m
                free[slot[own]] = False
                break
        else:
            return None
    return pilot, slot


class Index:
    """A minimal perfect hash over a history: tables pilots(region, bucket, slots, seed, pilot) and slots(region, slot, digest, ...)."""

    def __init__(self, table: DataFrame, regions: int, per_region: int, carried: list[str]):
        self.regions, self.per_region, self.carried = regions, per_region, carried
        # both sides of a lookup join are plain tables, so that Spark can split the rows of a hot digest
        self.pilots = stored(table.groupBy("region", "bucket").agg(*(F.first(c).alias(c) for c in ("slots", "seed", "pilot"))), "pilots")
        self.slots = table.select("region", "slot", F.col("digest").alias("slot_digest"), *carried)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows(digest, ...) with the slot's columns where the slot's digest is the row's, else nulls."""
        f1, f2 = ((_word(low) + F.col("seed") * _word(high)) % F.col("slots") for low, high in _HASH_AT)
        at = F.expr("pilot DIV slots")
        keyed = _keys(rows, self.regions, self.per_region).join(self.pilots, ["region", "bucket"], "left")
        keyed = keyed.withColumn("slot", (f1 + at * f2 + F.col("pilot") % F.col("slots")) % F.col("slots"))
        found = keyed.join(self.slots, ["region", "slot"], "left")
        member = F.coalesce(F.col("slot_digest") == F.col("digest"), F.lit(False))
        return found.select(*rows.columns, *[F.when(member, F.col(c)).alias(c) for c in self.carried])


def build_index(history: DataFrame, carried: list[str]) -> Index:
    """history: one row per distinct digest, with the columns that a slot is to hold."""
    history = stored(history.select("digest", *carried), "digests")
    regions = max(1, history.count() // REGION_KEYS)
    per_region = max(1, REGION_KEYS // BUCKET_KEYS)
    keyed = _keys(history, regions, per_region)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return Index(stored(keyed.groupBy("region").applyInArrow(_fill, f"{kinds}, slots long, seed long, pilot long, slot long"), "index"), regions, per_region, carried)


def winners(rows: DataFrame) -> DataFrame:
    """rows(doc_id, row, digest): one row per digest with its winner (largest doc_id, then largest row) and count."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size"))


def resolve(rows: DataFrame, history: DataFrame, taken: bool = False) -> DataFrame:
    """rows(doc_id, row, digest) with keep_id, group_size and kept, where the rows of history (same columns) came before.

    Rows whose digest the history has go, whoever has the larger id; the rest are grouped separately. group_size counts the
    rows and those of the history. With `taken`, the history is a part of rows, and its winners stay.
    """
    found = stored(build_index(winners(history), ["winner", "group_size"]).lookup(rows), "found")
    member, new = found.filter("winner IS NOT NULL"), found.filter("winner IS NULL").drop("winner", "group_size")
    copies = stored(member.groupBy("digest").agg(F.count("*").alias("copies")), "copies")
    grouped = stored(winners(new), "new")
    size = F.col("copies") if taken else F.col("group_size") + F.col("copies")
    stays = F.col("winner.row") == F.col("row")
    old = member.join(copies, "digest").withColumn("group_size", size).withColumn("kept", stays if taken else F.lit(False))
    both = old.drop("copies").unionByName(new.join(grouped, "digest").withColumn("kept", stays))
    return both.select("doc_id", "digest", F.col("winner.doc_id").alias("keep_id"), "group_size", "kept")


def light(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a row number of its own for each row, stored so that the numbers stay."""
    return stored(docs.select(docs["doc_id"].alias("doc_id"), digest_of(docs["text"]).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digested")


def group_exact(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. History are the rows with the larger half of the ids."""
    rows = light(docs)
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    history = rows.filter(F.lit(False) if most is None else F.col("doc_id") > (least + most - 1) // 2)
    return resolve(rows, history, taken=True).withColumnRenamed("digest", "text_sha256")


def keep_exact(docs: DataFrame) -> DataFrame:
    """docs without its exact repeats: of equal texts the row with the largest doc_id stays; all columns are kept."""
    id_, digest = unused(docs, 2)
    stay = group_exact(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(digest))
    keyed = docs.withColumn(digest, digest_of(docs["text"])).withColumn(id_, docs["doc_id"])
    kept = keyed.join(stay, keyed[digest].eqNullSafe(stay[digest]) & keyed[id_].eqNullSafe(stay[id_]), "left_semi")
    return kept.dropDuplicates([id_, digest]).drop(id_, digest)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_exact(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
