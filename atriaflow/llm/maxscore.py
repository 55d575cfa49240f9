"""Exact top-k inner products of integer vectors by MaxScore, shard by shard.

A term is a component of the query that is not 0; its posting list is the column of that component in a shard, in row order, and its bound the
most that it can add to any score of the shard (entries of the other sign only lower a score). A query has a threshold: the k-th score
that it reached in the first shard, which the k-th of all shards can't fall below. Its terms are put in descending order of their bounds; those at the end
that together stay below the threshold are non-essential: a row that only they raise can't compete. Each block of queries traverses the
columns of its essential terms; what is still competitive (sum so far + bounds of the rest >= threshold) probes the others, a few at a time,
until it is scored or out. Shards and blocks are bounded by cells, tasks by (shard, wave of blocks); the best of the shards are merged.

Defined cases: vectors that are null, or hold a null or a component that is not finite, take no part; an empty vector scores 0 with all; of vectors of
unequal lengths the shorter counts as filled with 0; components are whole numbers that stop at the ends of a long, and so do scores; products beyond 2^53 are
taken with Python's integers. A row is what a query leaves out as its own: another row with the same id is a candidate. Rows without an id come last among
ties, and are never queries. Repeated rows are each a candidate, and repeated queries each have their results. An empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import renewed, stored

#: Cells of a shard, so that a shard's matrix is at most 8 MB (or one row).
SHARD_CELLS = 1 << 20
#: Shards whose queries a task holds beside one shard.
WAVE = 16
#: Queries that are scored in one product, and non-essential terms that are probed in one step.
ROWS, PROBE = 128, 8

_SHARD = "part int, nth int, width int, ids array<long>, cells binary, asks array<int>, queries binary"
_HIT = "part int, nth int, place int, query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: float, is_query: Column) -> DataFrame:
    """id, x array<long>, asks: the vectors that take part, with components floor(scale * x)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = df.filter(df[vector].isNotNull() & F.coalesce(fine, F.lit(False)))
    return own.select(
        F.col(vec_id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("x"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )


def _shards(batches):
    """Rows of a partition -> shards of at most SHARD_CELLS cells (at least one row each)."""
    from pyspark import TaskContext

    part, nth = TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, np.ndarray, bool]] = []
    width = 0

    def pack():
        cells = np.zeros((len(held), width), dtype="<i8")
        for i, (_, x, _) in enumerate(held):
            cells[i, : len(x)] = x
        asks = [i for i, (ident, _, ask) in enumerate(held) if ask and ident is not None]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "width": pa.array([width], pa.int32()),
            "ids": pa.array([[ident for ident, _, _ in held]], pa.list_(pa.int64())), "cells": pa.array([cells.tobytes()], pa.binary()), "asks": pa.array([asks], pa.list_(pa.int32())),
            "queries": pa.array([cells[asks].tobytes()], pa.binary()),
        })

    for batch in batches:
        lists = batch["x"]
        offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for i, (ident, ask) in enumerate(zip(batch["id"].to_pylist(), batch["asks"].to_pylist())):
            x = flat[offs[i] : offs[i + 1]]
            if held and (len(held) + 1) * max(width, len(x)) > SHARD_CELLS:
                yield pack()
                held, width, nth = [], 0, nth + 1
            held.append((ident, x.copy(), ask))
            width = max(width, len(x))
    if held:
        yield pack()


def matrix(cells: bytes, rows: int, width: int) -> np.ndarray:
    return (np.frombuffer(cells, dtype="<i8") if cells else np.zeros(0, "<i8")).reshape(rows, width)


class Shard:
    """The matrix of a shard, one column per term, and what a term can add at most."""

    def __init__(self, row: dict):
        cells = matrix(row["cells"], len(row["ids"]), row["width"])
        self.part, self.nth, self.ids, self.width = row["part"], row["nth"], row["ids"], row["width"]
        self.order = np.array([(ident is None, ident or 0) for ident in self.ids], dtype=[("none", bool), ("id", "<i8")])
        self.cells = cells
        self.high = [max(0, int(x)) for x in cells.max(axis=0)]
        self.low = [min(0, int(x)) for x in cells.min(axis=0)]
        self._columns: dict[bool, np.ndarray] = {}

    def columns(self, exact: bool) -> np.ndarray:
        if exact not in self._columns:
            self._columns[exact] = np.ascontiguousarray(self.cells.T).astype(np.float64 if exact else object)
        return self._columns[exact]

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Of rows, the places of the k with the highest scores, ties to the smaller id."""
        by = self.order[rows]
        return np.lexsort((by["id"], by["none"], ~scores))[:k]


def _search(block: dict, floors: list, shard: Shard, k: int):
    """(place in the block, row, score) of what each query of a block finds in a shard."""
    asks = np.array(block["asks"], dtype=np.int64)
    q = matrix(block["queries"], len(asks), block["width"])
    width = min(block["width"], shard.width)
    q = q[:, :width]
    most = [max(abs(int(a)), abs(int(b))) for a, b in zip(q.max(axis=0), q.min(axis=0))] if len(q) else []
    exact = sum(a * max(h, -m) for a, h, m in zip(most, shard.high, shard.low)) < 2**53
    kind = np.float64 if exact else object
    columns = shard.columns(exact)[:width]
    q = q.astype(kind)
    high, low = np.array(shard.high[:width], dtype=kind), np.array(shard.low[:width], dtype=kind)
    bounds = np.where(q > 0, q * high, q * low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ranked = np.take_along_axis(bounds, order, axis=1)
    # rest[j]: what the terms from place j of the order on can add
    rest = np.zeros((len(q), width + 1), dtype=kind)
    rest[:, :-1] = np.cumsum(ranked[:, ::-1], axis=1)[:, ::-1]
    own = block["part"] == shard.part and block["nth"] == shard.nth
    for lo in range(0, len(q), ROWS):
        part = np.zeros((min(ROWS, len(q) - lo), width), dtype=kind)
        first = []
        for i in range(len(part)):
            floor = floors[lo + i]
            # the least number of terms whose rest stays below the threshold: the essential ones
            n = width if floor is None else int(np.argmax(rest[lo + i] < floor)) if rest[lo + i][-1] < floor else width
            terms = order[lo + i, :n]
            part[i, terms] = q[lo + i, terms]
            first.append(n)
        sums = part @ columns
        for i, n in enumerate(first):
            floor, scores = floors[lo + i], sums[i]
            if floor is None:
                rows = np.arange(len(scores)) if len(scores) <= k + 1 else np.flatnonzero(scores >= (np.partition(scores, -k - 1)[-k - 1] if exact else sorted(scores)[-k - 1]))
            else:
                rows = np.flatnonzero(scores + rest[lo + i, n] >= floor)
            if own:
                rows = rows[rows != asks[lo + i]]
            scores = scores[rows]
            while n < width and len(rows):
                terms = order[lo + i, n : n + PROBE]
                scores = scores + q[lo + i, terms] @ columns[np.ix_(terms, rows)]
                n += len(terms)
                alive = scores + rest[lo + i, n] >= floor
                rows, scores = rows[alive], scores[alive]
            scores = (scores if exact else np.clip(scores, -(2**63), 2**63 - 1)).astype(np.int64)
            for at in shard.best(rows, scores, k):
                yield lo + i, int(rows[at]), int(scores[at])


def _searched(k: int, seed: bool):
    """The function of a co-group: blocks of queries (one wave) meet the shards of one partition."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _HIT.split(", ")}
        blocks = left.to_pylist()
        for at in range(right.num_rows):
            shard = Shard(right.slice(at, 1).to_pylist()[0])
            for block in blocks:
                floors = [None] * len(block["asks"]) if seed else block["floors"] or [None] * len(block["asks"])
                for place, row, score in _search(block, floors, shard, k):
                    values = (block["part"], block["nth"], place, block["query_ids"][place], shard.ids[row], score)
                    for c, v in zip(out, values):
                        out[c].append(v)
        kinds = dict(part=pa.int32(), nth=pa.int32(), place=pa.int32())
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def _met(blocks: DataFrame, shards: DataFrame, parts: int, k: int, seed: bool) -> DataFrame:
    """Every block with every shard: shards go to each wave of blocks, blocks to each partition of shards."""
    waves = -(-parts // WAVE)
    left = blocks.withColumn("wave", F.floor(F.col("part") / WAVE).cast("int")).withColumn("to", F.explode(F.array(F.lit(0)) if seed else F.sequence(F.lit(0), F.lit(parts - 1))))
    right = shards.drop("asks", "queries").withColumn("to", F.col("part")).withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    return left.groupBy("to", "wave").cogroup(renewed(right).groupBy("to", "wave")).applyInArrow(_searched(k, seed), _HIT)


def top_k(vectors: DataFrame, k: int) -> DataFrame:
    """vectors(id, x array<long>, asks boolean) -> query_id, rank, vec_id, score: for each row that asks, its k best among all other rows."""
    size = vectors.agg(F.sum(F.greatest(F.size("x"), F.lit(1))).alias("cells")).first()["cells"] or 0
    parts = max(1, -(-size // SHARD_CELLS))
    shards = stored(vectors.repartition(parts).mapInArrow(_shards, _SHARD), "shards")
    query_ids = F.transform("asks", lambda i: F.get("ids", i)).alias("query_ids")
    blocks = shards.filter(F.size("asks") > 0).select("part", "nth", "width", query_ids, "asks", "queries")
    # the thresholds: what each query reaches in the first shard
    seeds = _met(blocks, shards.filter("part = 0 AND nth = 0"), parts, k, True)
    floors = seeds.groupBy("part", "nth", "place").agg(F.count("*").alias("n"), F.min("score").alias("low")).groupBy("part", "nth").agg(F.array_sort(F.collect_list(F.struct("place", F.when((F.col("n") == k) & (F.col("low") > -(2**63)), F.col("low")).alias("low")))).alias("found"))
    floors = floors.select("part", "nth", F.map_from_arrays(F.transform("found", lambda x: x["place"]), F.transform("found", lambda x: x["low"])).alias("found"))
    every = F.transform(F.sequence(F.lit(0), F.size("asks") - 1), lambda i: F.try_element_at(F.col("found"), i))
    # the places without a threshold take the best k of each shard
    blocks = stored(blocks.join(floors, ["part", "nth"], "left").withColumn("floors", every).drop("found"), "blocks")
    hits = _met(blocks, shards, parts, k, False)
    best = F.row_number().over(Window.partitionBy("part", "nth", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return hits.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(whole_vectors(table, "vec_id", "embedding", 64, F.col("vec_id") % 20 == 0), 20)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.own AS asked, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON c.own <> q.own WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id ASC NULLS LAST) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20"""
