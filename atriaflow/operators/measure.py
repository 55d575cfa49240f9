"""Ranges, statistics and areas per map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.functions.columns import finite
from atriaflow.operators.spatial import nn_join
from atriaflow.schema import PRIMARY_ORDER


def scalar_range(scalars: DataFrame) -> DataFrame:
    """A1: least, largest and number of finite values per map and field; nulls where there are none."""
    v = finite(F.col("value"))
    return scalars.groupBy("map_id", "name").agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count(v).alias("n_valid"))


def scalar_statistics(scalars: DataFrame) -> DataFrame:
    """A2: least, largest, mean and population standard deviation of finite values."""
    v = finite(F.col("value"))
    return scalars.groupBy("map_id", "name").agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_value"))


def surface_area(triangles: DataFrame) -> DataFrame:
    """A3: total area per map in cm2."""
    return triangles.groupBy("map_id").agg((F.sum("area") / 100).alias("area_cm2"))


#: An interval: label, lower and upper edge.
Interval = tuple[str, float, float]


def _interval_sums(grouped, intervals: list[Interval], v: Column, weight: str):
    """One conditional sum per interval, half-open but for intervals that end at the largest edge of all."""
    top = max((hi for _, _, hi in intervals), default=0.0)
    inside = lambda lo, hi: (v >= lo) & ((v <= hi) if hi == top else (v < hi))
    sums = [F.struct(F.lit(label).alias("label"), (F.coalesce(F.sum(F.when(inside(lo, hi), F.col(weight))), F.lit(0.0)) / 100).alias("area_cm2")) for label, lo, hi in intervals]
    return grouped.agg(F.array(*sums).alias("rows"))


def areas_for_intervals(faces: DataFrame, intervals: list[Interval], value: str = "face_value", weight: str = "area", keys: tuple = ("map_id",)) -> DataFrame:
    """A4: area (cm2) of the faces whose value lies in [lo, hi); the upper edge counts too where hi is the largest of all.

    Every interval is a conditional sum of one pass, combined before the shuffle.
    """
    sums = _interval_sums(faces.groupBy(*keys), intervals, F.col(value), weight)
    return sums.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.label", "r.area_cm2")


def relative_areas(faces: DataFrame, intervals: list[Interval], stats: DataFrame) -> DataFrame:
    """A5: intervals in percent of the map's largest value; stats(map_id, max_value)."""
    keyed = faces.join(stats.select("map_id", "max_value"), "map_id")
    keyed = keyed.withColumn("share", F.when(F.col("max_value") != 0, F.col("face_value") / F.col("max_value") * 100))
    return _interval_sums(keyed.groupBy("map_id"), intervals, F.col("share"), "area").select("map_id", F.explode("rows").alias("r")).select("map_id", "r.label", "r.area_cm2")


def area_histogram(faces: DataFrame, lo: float, hi: float, step: float) -> DataFrame:
    """Per bin of width step in [lo, hi] the area in percent of the map's total, and the share of area at or above the bin."""
    n = int(round((hi - lo) / step))
    v = F.col("face_value")
    bin_ = F.when((v >= lo) & (v <= hi), F.least(F.floor((v - lo) / step), F.lit(n - 1))).cast("int")
    sums = faces.groupBy("map_id", bin_.alias("bin")).agg(F.sum("area").alias("area"))
    total = sums.groupBy("map_id").agg(F.sum("area").alias("total"))
    grid = total.select("map_id", "total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    shares = grid.join(sums, ["map_id", "bin"], "left").select("map_id", "bin", (F.coalesce("area", F.lit(0.0)) / F.col("total") * 100).alias("area_pct"))
    return survival(shares)


def survival(hist: DataFrame) -> DataFrame:
    """survival = sum of the shares of this bin and all above it; a map has as many rows as bins."""
    above = Window.partitionBy("map_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("survival", F.sum("area_pct").over(above) / 100)


def delta_stats(delta: DataFrame, max_distance: float | None = None) -> DataFrame:
    """Per pair, number, least, largest, mean and median of finite deltas, and how many were masked by distance."""
    d = finite(F.col("delta"))
    far = F.col("distance") > max_distance if max_distance is not None else F.lit(False)
    return delta.groupBy("pair_id").agg(F.count(d).alias("n"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), F.count_if(far).alias("n_masked"))


def channel_stats(samples: DataFrame) -> DataFrame:
    """Least, largest and mean of the finite samples of each channel of each window."""
    v = finite(F.col("value"))
    return samples.groupBy("data_uri", "channel").agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.count(v).alias("n"))


def mean_value(scalars: DataFrame) -> DataFrame:
    """Mean of the values that are there."""
    return scalars.groupBy("map_id", "name").agg(F.avg(finite(F.col("value"))).alias("mean_value"))


def low_value_area(strict_faces: DataFrame, lo: float = 0.0, hi: float = 0.5) -> DataFrame:
    """Area (cm2) of faces with lo < value < hi, both strict; faces with a missing corner do not count (how="strict")."""
    v = F.col("face_value")
    return strict_faces.groupBy("map_id").agg((F.coalesce(F.sum(F.when((v > lo) & (v < hi), F.col("area"))), F.lit(0.0)) / 100).alias("low_area_cm2"))


def equal_width_intervals(scalars: DataFrame, n: int) -> DataFrame:
    """N intervals of equal width between each map's least and largest value: map_id, bin, lo, hi."""
    r = scalars.groupBy("map_id").agg(F.min(finite(F.col("value"))).alias("least"), F.max(finite(F.col("value"))).alias("most"))
    step = (F.col("most") - F.col("least")) / n
    return r.select("map_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"), "least", "most").select("map_id", "bin", (F.col("least") + F.col("bin") * step).alias("lo"), (F.col("least") + (F.col("bin") + 1) * step).alias("hi"))


def value_histogram(scalars: DataFrame, n: int) -> DataFrame:
    """How many values of a map fall into each of n equal bins; the largest value is in the last."""
    v = finite(F.col("value"))
    r = scalars.groupBy("map_id").agg(F.min(v).alias("least"), F.max(v).alias("most"))
    keyed = scalars.withColumn("v", v).filter("v IS NOT NULL").join(r, "map_id")
    bin_ = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * n), F.lit(n - 1))).otherwise(F.lit(0))
    return keyed.groupBy("map_id", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def point_summary(values: DataFrame) -> DataFrame:
    """Rows, finite values and their median per map; values(map_id, value)."""
    v = finite(F.col("value"))
    return values.groupBy("map_id").agg(F.count("*").alias("n_rows"), F.count(v).alias("n_finite"), F.median(v).alias("median_value"))


def peak_site(scalars: DataFrame) -> DataFrame:
    """The vertex of each map's largest value, the lowest id on a tie."""
    v = finite(F.col("value"))
    best = scalars.filter(v.isNotNull()).groupBy("map_id", "name").agg(F.min(F.struct((-F.col("value")).alias("down"), "vertex_id")).alias("b"))
    return best.select("map_id", "name", F.col("b.vertex_id").alias("vertex_id"), (-F.col("b.down")).alias("value"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by a combined minimum rather than a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def primary_scalar(fields: DataFrame) -> DataFrame:
    """The primary field of each map: by the fixed order of kinds, else the first registered; fields(map_id, name, kind, position)."""
    prio = F.lit(len(PRIMARY_ORDER))
    for i, kind in reversed(list(enumerate(PRIMARY_ORDER))):
        prio = F.when(F.col("kind") == kind, i).otherwise(prio)
    return fields.groupBy("map_id").agg(F.min(F.struct(prio.alias("prio"), "position", "name")).alias("b")).select("map_id", F.col("b.name").alias("name"))


def normalise(scalars: DataFrame) -> DataFrame:
    """Values scaled to 0..1 per map and field; a constant field stays as it is."""
    v = finite(F.col("value"))
    r = scalars.groupBy("map_id", "name").agg(F.min(v).alias("least"), F.max(v).alias("most"))
    scaled = F.when(F.col("most") != F.col("least"), (F.col("value") - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(F.col("value"))
    return scalars.join(r, ["map_id", "name"]).withColumn("value", scaled).drop("least", "most")


def display_condition(scalars: DataFrame, norm: bool = False) -> DataFrame:
    """Values above mean + 2 population deviations become missing; all-negative fields change sign; optionally percent of the largest."""
    v = finite(F.col("value"))
    s = scalars.groupBy("map_id", "name").agg((F.avg(v) + 2 * F.stddev_pop(v)).alias("limit"), (F.max(v) < 0).alias("down"))
    kept = scalars.join(s, ["map_id", "name"]).withColumn("value", F.when(v <= F.col("limit"), F.when(F.col("down"), -v).otherwise(v))).drop("limit", "down")
    if norm:
        top = kept.groupBy("map_id", "name").agg(F.max("value").alias("top"))
        kept = kept.join(top, ["map_id", "name"]).withColumn("value", F.when(F.col("top") != 0, F.col("value") / F.col("top") * 100)).drop("top")
    return kept


def colour_class(scalars: DataFrame, edges: list[float], relative: bool = False, clip_below: bool = True, clip_above: bool = True) -> DataFrame:
    """The colour interval of each value and the place within it.

    relative scales data and edges to 0..1. Outside the edges a value gets the end interval (clipped) or none. The first closed interval
    that holds the value counts.
    """
    lo, hi = float(edges[0]), float(edges[-1])
    value: Column = finite(F.col("value"))
    own = [float(e) for e in edges]
    if relative:
        r = scalars.groupBy("map_id", "name").agg(F.min(value).alias("least"), F.max(value).alias("most"))
        scalars = scalars.join(r, ["map_id", "name"])
        value = F.when(F.col("most") > F.col("least"), (value - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(F.when(value.isNotNull(), F.lit(0.0)))
        own = [(e - lo) / (hi - lo) for e in own]
    out = scalars.withColumn("v", value)
    v, n = F.col("v"), len(own) - 1
    klass = F.when(v.isNull(), None).when(v < own[0], F.lit(0) if clip_below else None).when(v > own[-1], F.lit(n - 1) if clip_above else None)
    for i in range(n):
        klass = klass.when(v <= own[i + 1], F.lit(i))
    steps = F.array(*[F.lit(e) for e in own])
    out = out.withColumn("interval", klass.cast("int"))
    at, to = F.get(steps, F.col("interval")), F.get(steps, F.col("interval") + 1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("v") - at, to - at)))
    return out.withColumn("t", F.when(F.col("interval").isNotNull(), t)).drop("v", *(["least", "most"] if relative else []))
