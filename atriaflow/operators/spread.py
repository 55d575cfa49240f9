"""Spread of a region of a map: nearest-neighbour and pairwise distances."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.operators.spatial import nn_join
from atriaflow.shared import stored

#: Points of a block, rows of it whose distances are made at once (so that they stay in a core's cache), points of a run that bounds leave out together, and
#: parts into which a pass cuts the distances.
BLOCK, TILE, RUN, PARTS = 2048, 8, 32, 2048
_BITS = 10


def _along_curve(at: dict[str, Column]) -> Column:
    """The place on a Z-curve of a point with coordinates in [0, 1]: blocks of consecutive points are small boxes."""
    whole = {c: F.least(F.floor(x * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("int") for c, x in at.items()}
    bits = [F.shiftleft(F.shiftright(whole[c], b).bitwiseAND(1), 3 * b + i) for b in range(_BITS) for i, c in enumerate(at)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _boxes(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates of each `size` consecutive points."""
    at = np.arange(0, points.shape[1], size)
    return np.minimum.reduceat(points, at, axis=1), np.maximum.reduceat(points, at, axis=1)


def _tiles(batch: pa.RecordBatch, i: int, low: float = 0.0, high: float = np.inf):
    """The distances of the pairs of row i, a few rows of the first block at a time; of a block with itself each pair once.

    With bounds, runs of points whose box cannot have such a distance from the box of the rows are left out.
    """
    a, b = (np.array([batch[f"{side}_{c}"][i].values.to_numpy(zero_copy_only=False) for c in "xyz"]) for side in "ab")
    same, n = batch["same"][i].as_py(), b.shape[1]
    bounded = low > 0 or high < np.inf
    if bounded:
        (a_lo, a_hi), (b_lo, b_hi), run = _boxes(a, TILE), _boxes(b, RUN), np.arange(n) // RUN
    for t, lo in enumerate(range(0, a.shape[1], TILE)):
        rows, columns, cut = a[:, lo : lo + TILE], b, None
        if bounded:
            gap = np.maximum(0, np.maximum(b_lo - a_hi[:, t : t + 1], a_lo[:, t : t + 1] - b_hi))
            wide = np.maximum(b_hi - a_lo[:, t : t + 1], a_hi[:, t : t + 1] - b_lo)
            cut = ((np.sqrt((gap**2).sum(axis=0)) <= high) & (np.sqrt((wide**2).sum(axis=0)) >= low))[run]
            columns = b[:, cut]
        d = rows[0][:, None] - columns[0]
        d *= d
        for c in (1, 2):
            x = rows[c][:, None] - columns[c]
            x *= x
            d += x
        np.sqrt(d, out=d)
        if same:
            at = np.arange(n) if cut is None else np.flatnonzero(cut)
            d = d[at[None, :] > np.arange(lo, lo + len(d))[:, None]]
        yield d.ravel()


def _parts(d: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of [0, reach) in which a distance lies, and the part of that part."""
    x = d * (PARTS / reach)
    first = np.minimum(x.astype(np.int64), PARTS - 1)
    return first, np.clip(((x - first) * PARTS).astype(np.int64), 0, PARTS - 1)


def _survey(batches):
    """Per pair of blocks: sum and largest of its distances, and how many lie in each part."""
    for batch in batches:
        total, most, parts, counts = [], [], [], []
        for i, reach in enumerate(batch["reach"].to_pylist()):
            n, s, m = np.zeros(PARTS, np.int64), 0.0, 0.0
            for d in _tiles(batch, i):
                n += np.bincount(_parts(d, reach)[0], minlength=PARTS)
                s, m = s + float(d.sum()), max(m, float(d.max(initial=0.0)))
            at = np.flatnonzero(n)
            total.append(s)
            most.append(m)
            parts.append(at)
            counts.append(n[at])
        whole = pa.list_(pa.int64())
        yield pa.RecordBatch.from_pydict({
            "map_id": batch["map_id"], "total": pa.array(total), "most": pa.array(most), "parts": pa.array(parts, whole), "counts": pa.array(counts, whole),
        })


def _inside(values: bool):
    """Per pair of blocks, of the distances in the wanted part (``p1``; with values also ``p2``): how many there are in each part of it, or of each value."""

    def run(batches):
        for batch in batches:
            row, key, n = [], [], []
            for i, (reach, p1, low, high) in enumerate(zip(*(batch[c].to_pylist() for c in ("reach", "p1", "low", "high")))):
                for d in _tiles(batch, i, low, high):
                    first, second = _parts(d, reach)
                    hit = first == p1
                    if values:
                        hit &= second == batch["p2"][i].as_py()
                    each, count = np.unique(d[hit] if values else second[hit], return_counts=True)
                    row += [i] * len(each)
                    key += each.tolist()
                    n += count.tolist()
            rows = pa.array(row, pa.int64())
            made = {"key": pa.array(key, pa.float64()), "n": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_pydict({c: batch[c].take(rows) for c in (["map_id", "p1", "p2"] if values else ["map_id", "p1"])} | made)

    return run


def _box_distance(far: bool) -> Column:
    """The least (or largest) distance that a pair of points of boxes a and b can have."""

    def gap(c: str) -> Column:
        ab, ba = F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.col(f"a_lo{c}") - F.col(f"b_hi{c}")
        return F.greatest(F.abs(F.col(f"b_hi{c}") - F.col(f"a_lo{c}")), F.abs(F.col(f"a_hi{c}") - F.col(f"b_lo{c}"))) if far else F.greatest(ab, ba, F.lit(0.0))

    return F.sqrt(sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0)))


def region_spread(scalars: DataFrame, vertices: DataFrame, lo: float, hi: float) -> DataFrame:
    """Spread of the vertices whose own value lies in [lo, hi]: largest nearest-neighbour distance, and largest, mean and
    median pairwise distance; zeros for a map with none (or one).

    The mean asks for every distance once: the region's points go along a Z-curve to blocks of BLOCK, a row is a pair of blocks, whose distances are made, summed
    and counted by parts inside the task; pairs of points never are rows. The median is exact: the counts name the part of the distances that holds it, and
    only pairs of blocks whose boxes allow such a distance are looked at again, for the parts of that part, and for the values in the last one.
    """
    placed = vertices.select("map_id", "vertex_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    inside = scalars.filter(F.col("value").between(lo, hi)).select("map_id", "vertex_id")
    region = stored(inside.join(placed, ["map_id", "vertex_id"]), "region")
    near = nn_join(region, region, ["map_id"], k=2).filter("near_id <> vertex_id").groupBy("map_id", "vertex_id").agg(F.min("distance").alias("nn")).groupBy("map_id").agg(F.max("nn").alias("max_nn"))
    extent = region.groupBy("map_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).filter("n > 1")
    wide = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"])
    diagonal = F.sqrt(sum(((F.col(f"hi{c}") - F.col(f"lo{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    reach = F.when(diagonal > 0, diagonal * (1 + 1e-9)).otherwise(1.0).alias("reach")
    extent = extent.select("map_id", "n", *[f"lo{c}" for c in "xyz"], F.when(wide > 0, wide).otherwise(1.0).alias("wide"), reach)
    extent = stored(extent, "extent")
    curve = _along_curve({c: (F.col(c) - F.col(f"lo{c}")) / F.col("wide") for c in "xyz"})
    block = F.floor((F.row_number().over(Window.partitionBy("map_id").orderBy(curve, "vertex_id")) - 1) / BLOCK)
    blocks = region.join(extent, "map_id").withColumn("block", block).groupBy("map_id", "block")
    blocks = blocks.agg(*[F.collect_list(c).alias(c) for c in "xyz"], F.first("reach").alias("reach"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    blocks = stored(blocks, "blocks")

    def side(s: str, columns: list[str]) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("map_id", "block", *columns)])

    box = [f"{n}{c}" for c in "xyz" for n in ("lo", "hi")]
    pairs = side("a", [*box, "reach"]).join(side("b", box), F.expr("a_map_id = b_map_id AND a_block <= b_block")).drop("b_map_id").withColumnsRenamed({"a_map_id": "map_id", "a_reach": "reach"})
    pairs = pairs.select("map_id", "a_block", "b_block", "reach", (F.col("a_block") == F.col("b_block")).alias("same"), _box_distance(False).alias("least"), _box_distance(True).alias("most"))

    def with_points(some: DataFrame) -> DataFrame:
        """Pairs of blocks with the points of both; dealt to all cores, as a pair is little data and much work."""
        a, b = (side(s, list("xyz")).withColumnRenamed(f"{s}_map_id", "map_id") for s in "ab")
        return some.join(a, ["map_id", "a_block"]).join(b, ["map_id", "b_block"]).repartition(4 * some.sparkSession.sparkContext.defaultParallelism)

    kind = scalars.schema["map_id"].dataType.simpleString()
    survey = stored(with_points(pairs).mapInArrow(_survey, f"map_id {kind}, total double, most double, parts array<long>, counts array<long>"), "survey")
    sums = survey.groupBy("map_id").agg(F.sum("total").alias("total"), F.max("most").alias("max_distance")).join(extent, "map_id")
    n = F.col("n") * (F.col("n") - 1) / 2
    sums = sums.select("map_id", "max_distance", "reach", n.cast("long").alias("n_pairs"), (F.col("total") / n).alias("mean_distance"))

    def middle(counts: DataFrame, state: DataFrame, keys: list[str], part: str, name: str) -> DataFrame:
        """state(rank within keys) with the part that holds the rank, and the rank within that part."""
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(part))
        placed = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        held = state.join(placed, keys).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        kept = [c for c in state.columns if c != "rank"]
        return held.select(*kept, (F.col("rank") - F.col("before")).alias("rank"), F.col(part).alias(name))

    ranks = sums.select("map_id", F.posexplode(F.array(F.floor((F.col("n_pairs") - 1) / 2), F.floor(F.col("n_pairs") / 2))).alias("which", "rank"))
    parts = survey.select("map_id", F.explode(F.arrays_zip("parts", "counts")).alias("p")).groupBy("map_id", F.col("p.parts").alias("part")).agg(F.sum("p.counts").alias("n"))
    state = stored(middle(parts, ranks, ["map_id"], "part", "p1"), "first")

    def straddling(wanted: list[str], low: Column, high: Column) -> DataFrame:
        """Pairs of blocks that can have a distance in the wanted part."""
        asked = state.select("map_id", *wanted).distinct()
        slack = F.col("reach") * 1e-9
        met = pairs.join(asked, "map_id").withColumns({"low": low - slack, "high": high + slack})
        return with_points(met.filter((F.col("least") <= F.col("high")) & (F.col("most") >= F.col("low"))))

    step = F.col("reach") / PARTS
    counts = straddling(["p1"], F.col("p1") * step, (F.col("p1") + 1) * step).mapInArrow(_inside(False), f"map_id {kind}, p1 long, key double, n long")
    counts = counts.groupBy("map_id", "p1", "key").agg(F.sum("n").alias("n"))
    state = stored(middle(counts, state, ["map_id", "p1"], "key", "p2").withColumn("p2", F.col("p2").cast("long")), "second")
    low = (F.col("p1") + F.col("p2") / PARTS) * step
    values = straddling(["p1", "p2"], low, low + step / PARTS).mapInArrow(_inside(True), f"map_id {kind}, p1 long, p2 long, key double, n long")
    values = values.groupBy("map_id", "p1", "p2", "key").agg(F.sum("n").alias("n"))
    median = middle(values, state, ["map_id", "p1", "p2"], "key", "distance").groupBy("map_id").agg(F.avg("distance").alias("median_distance"))

    out = scalars.select("map_id").distinct().join(sums, "map_id", "left").join(median, "map_id", "left").join(near, "map_id", "left")
    return out.select("map_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("max_nn", "max_distance", "mean_distance", "median_distance")])
