"""Nearest neighbours by grid cells, and what follows from them: map deltas, masks, interpolation, coverage.

``nn_join`` never pairs all points of a map. Points fall into cubic cells of a side of their own for each map, from its extent and
number of points; a left point meets the right points of its 27 surrounding cells in an equi-join on (keys, cell), and a k-th
distance of at most the side is final. The other left points (far from the surface, or where it is thin) descend through boxes: of the boxes of
a map's coarse cells those stay that can hold one of the k nearest, then those of the fine cells inside, then the points in these.
Two passes whatever the distances; bounded searches (max_distance) need the first alone and are exact.
Ties go to the lowest right id. Null and non-finite coordinates take no part. The k nearest are kept by a rank filter, which Spark
applies in the tasks before the shuffle too. Joins of points ask for shuffles: Spark takes sizes from compressed files and would else
send points of many times that size through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.functions.columns import finite

#: Coarse cells along an axis of a map's extent, and fine cells along an axis of a coarse one.
COARSE, FINE = 8, 8


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in "xyz"}).dropna(subset=["x", "y", "z"])


def _cell(c: str, h: Column | float) -> Column:
    return F.floor(F.col(c) / h).cast("long")


def _squared(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [(p - q) * (p - q) for p, q in pairs])


def _ranked(met: DataFrame, keys: list[str], left_id: str, k: int, carried: list[str]) -> DataFrame:
    """The k rows of least __d2 of each left point, with their rank, and the carried columns of the left point."""
    if k == 1:
        best = met.groupBy(*keys, left_id).agg(F.min(F.struct("__d2", "__rid")).alias("b"), *[F.first(c).alias(c) for c in carried])
        return best.select(*keys, left_id, F.col("b.__rid").alias("__rid"), F.sqrt("b.__d2").alias("distance"), F.lit(1).alias("rank"), *carried)
    near = Window.partitionBy(*keys, left_id).orderBy("__d2", "__rid")
    return met.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select(*keys, left_id, "__rid", F.sqrt("__d2").alias("distance"), "rank", *carried)


def _pass(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, k: int, carried: list[str]) -> DataFrame:
    """For each left point the k nearest right points of its 27 cells of side __h."""
    h = F.col("__h")
    around = reduce(lambda a, c: a.withColumn(f"c{c}", F.explode(F.array(*[_cell(c, h) + F.lit(d) for d in (-1, 0, 1)]))), "xyz", left)
    cells = right.select(*keys, "__rid", "rx", "ry", "rz", *[_cell(f"r{c}", h).alias(f"c{c}") for c in "xyz"])
    met = around.join(cells.hint("merge"), [*keys, "cx", "cy", "cz"])
    return _ranked(met.withColumn("__d2", _squared([(F.col(c), F.col(f"r{c}")) for c in "xyz"])), keys, left_id, k, carried)


def _boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """Number and extent of the right points of each cell."""
    return points.groupBy(*by).agg(F.count("*").alias("__n"), *[f(f"r{c}").alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


def _reachable(met: DataFrame, keys: list[str], left_id: str) -> DataFrame:
    """Of the boxes that a left point met, those that can hold one of its __want nearest points.

    The boxes whose farthest corners lie nearest hold enough points together: nothing beyond the last of these corners can be wanted.
    """
    nearest = _squared([(F.greatest(F.col(f"lo{c}"), F.least(F.col(f"hi{c}"), F.col(c))), F.col(c)) for c in "xyz"])
    farthest = reduce(lambda a, b: a + b, [F.greatest(F.abs(F.col(c) - F.col(f"lo{c}")), F.abs(F.col(c) - F.col(f"hi{c}"))) ** 2 for c in "xyz"])
    own = Window.partitionBy(*keys, left_id)
    met = met.withColumns({"__near": nearest, "__far": farthest})
    met = met.withColumn("__held", F.sum("__n").over(own.orderBy("__far").rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("__limit", F.min(F.when(F.col("__held") >= F.col("__want"), F.col("__far"))).over(own))
    return met.filter(F.col("__near") <= F.col("__limit") * (1 + 1e-9) + 1e-12)


def _descend(open_: DataFrame, right: DataFrame, keys: list[str], left_id: str, k: int) -> DataFrame:
    """For each left point the k nearest right points, by way of the boxes of coarse and fine cells."""
    n = COARSE * FINE
    fine = {c: F.when(F.col("__side") > 0, F.least(F.floor((F.col(f"r{c}") - F.col(f"__o{c}")) / F.col("__side") * n), F.lit(n - 1))).otherwise(0).cast("int") for c in "xyz"}
    number = lambda cell, per: reduce(lambda a, b: a * per + b, [cell[c] for c in "xyz"])
    placed = right.select(*keys, "__rid", "rx", "ry", "rz", number({c: (fine[c] / FINE).cast("int") for c in "xyz"}, COARSE).alias("__coarse"), number(fine, n).alias("__fine"))
    point = [*keys, left_id, "x", "y", "z", "__want"]
    first = _reachable(open_.select(*point).join(_boxes(placed, [*keys, "__coarse"]).hint("merge"), keys), keys, left_id).select(*point, "__coarse")
    second = _reachable(first.join(_boxes(placed, [*keys, "__coarse", "__fine"]).hint("merge"), [*keys, "__coarse"]), keys, left_id).select(*keys, left_id, "x", "y", "z", "__fine")
    met = second.join(placed.drop("__coarse").hint("merge"), [*keys, "__fine"])
    return _ranked(met.withColumn("__d2", _squared([(F.col(c), F.col(f"r{c}")) for c in "xyz"])), keys, left_id, k, [])


def nn_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str = "vertex_id", right_id: str = "vertex_id", k: int = 1, max_distance: float | None = None) -> DataFrame:
    """The k nearest right points of each left point within its keys: keys, left_id, right_id (as ``near_id``), distance, rank.

    left(keys, left_id, x, y, z), right(keys, right_id, x, y, z). With max_distance, neighbours farther away are left out.
    """
    left = _clean(left).select(*keys, left_id, *"xyz")
    right = _clean(right).select(*keys, F.col(right_id).alias("__rid"), *[F.col(c).alias(f"r{c}") for c in "xyz"])
    if max_distance is not None:
        h = F.lit(max(float(max_distance), 1e-9))
        found = _pass(left.withColumn("__h", h), right.withColumn("__h", h), keys, left_id, k, []).filter(F.col("distance") <= max_distance)
        return found.withColumnRenamed("__rid", "near_id")
    side = F.greatest(*[F.max(f"r{c}") - F.min(f"r{c}") for c in "xyz"])
    # on a surface, a ball of this radius holds some three times k points
    h = side * F.sqrt(F.lit(1.7 * max(k, 2)) / F.count("*"))
    maps = right.groupBy(*keys).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("__want"), side.alias("__side"), F.when(h > 0, h).otherwise(1.0).alias("__h"), *[F.min(f"r{c}").alias(f"__o{c}") for c in "xyz"])
    left, right = left.join(maps.hint("shuffle_hash"), keys), right.join(maps.drop("__want").hint("shuffle_hash"), keys)
    near = _pass(left, right.drop("__side", *[f"__o{c}" for c in "xyz"]), keys, left_id, k, ["__h", "__want"])
    if k == 1:
        near = near.filter(F.col("distance") <= F.col("__h"))
    else:
        near = near.withColumn("__have", F.count_if(F.col("distance") <= F.col("__h")).over(Window.partitionBy(*keys, left_id))).filter("__have >= __want")
    near = near.select(*keys, left_id, "__rid", "distance", "rank")
    open_ = left.join(near.select(*keys, left_id).hint("merge"), [*keys, left_id], "left_anti")
    return near.unionByName(_descend(open_, right, keys, left_id, k)).withColumnRenamed("__rid", "near_id")


def compare_maps(pairs: DataFrame, vertices: DataFrame, scalars: DataFrame, scalar_name: str, max_distance: float | None = None) -> DataFrame:
    """Each vertex of map a meets the nearest vertex of map b; delta = a - b; beyond max_distance both are null.

    pairs(pair_id, map_a, map_b) -> pair_id, vertex_id, a_value, b_value, distance, delta.
    """
    field = scalars.filter(F.col("name") == scalar_name).select("map_id", "vertex_id", finite(F.col("value")).alias("value"))
    placed = vertices.select("map_id", "vertex_id", "x", "y", "z").join(field, ["map_id", "vertex_id"], "left")
    a = pairs.join(placed, pairs["map_a"] == placed["map_id"]).select("pair_id", "vertex_id", "x", "y", "z", F.col("value").alias("a_value"))
    b = pairs.join(placed, pairs["map_b"] == placed["map_id"]).select("pair_id", "vertex_id", "x", "y", "z", F.col("value").alias("b_value"))
    near = nn_join(a, b, ["pair_id"])
    out = a.select("pair_id", "vertex_id", "a_value").join(near.select("pair_id", "vertex_id", "near_id", "distance"), ["pair_id", "vertex_id"], "left")
    out = out.join(b.select("pair_id", F.col("vertex_id").alias("near_id"), "b_value"), ["pair_id", "near_id"], "left")
    far = F.col("distance") > (F.lit(float("inf")) if max_distance is None else F.lit(float(max_distance)))
    b_value = F.when(~F.coalesce(far, F.lit(False)), F.col("b_value"))
    return out.select("pair_id", "vertex_id", "a_value", b_value.alias("b_value"), "distance", (F.col("a_value") - b_value).alias("delta"))


def project_points(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """The mesh vertex nearest to each acquisition point, with its place and normal there."""
    near = nn_join(points, vertices, ["map_id"], "point_index", "vertex_id").select("map_id", "point_index", F.col("near_id").alias("vertex_id"), "distance")
    own = vertices.select("map_id", "vertex_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *[c for c in ("nx", "ny", "nz") if c in vertices.columns])
    return near.join(own, ["map_id", "vertex_id"])


def confidence_mask(scalars: DataFrame, points: DataFrame, vertices: DataFrame, distance: float | None) -> DataFrame:
    """Values farther than `distance` from every projected point become null; maps without points pass through."""
    if distance is None:
        return scalars
    sites = project_points(points, vertices).select("map_id", "vertex_id").distinct().join(vertices, ["map_id", "vertex_id"])
    close = nn_join(vertices, sites, ["map_id"], max_distance=distance).select("map_id", "vertex_id", F.lit(True).alias("close"))
    measured = sites.select("map_id").distinct().withColumn("measured", F.lit(True))
    both = scalars.join(measured, "map_id", "left").join(close, ["map_id", "vertex_id"], "left")
    return both.withColumn("value", F.when(F.col("measured").isNull() | F.col("close"), F.col("value"))).drop("measured", "close")


def default_sigma(points: DataFrame, id_col: str = "point_index") -> DataFrame:
    """Per map the median of positive nearest-neighbour distances, 1 if there are none."""
    near = nn_join(points, points, ["map_id"], id_col, id_col, k=2).filter(F.col("near_id") != F.col(id_col)).groupBy("map_id", id_col).agg(F.min("distance").alias("d"))
    median = near.filter("d > 0").groupBy("map_id").agg(F.median("d").alias("sigma"))
    return points.select("map_id").distinct().join(median, "map_id", "left").select("map_id", F.coalesce("sigma", F.lit(1.0)).alias("sigma"))


def _cyclic(value: Column, lo: Column, cycle: Column) -> tuple[Column, Column]:
    angle = (value - lo) / cycle * F.lit(6.283185307179586)
    return F.cos(angle), F.sin(angle)


def gaussian_interpolate(vertices: DataFrame, field: DataFrame, sigma: float | None = None, distance_threshold: float | None = None, cycle_length: float | None = None, k: int = 16) -> DataFrame:
    """Kernel mean over the k nearest measured points, w = exp(-d^2 / 2 sigma^2), at every vertex.

    field(map_id, point_index, x, y, z, value). cycle_length: None linear; 0 the range of the values; above 0 the cycle in
    which values wrap (results lie in [min, min + cycle)). No weight, or a nearest point beyond the threshold, gives null.
    """
    field = field.withColumn("value", finite(F.col("value").cast("double"))).dropna(subset=["value"])
    widths = default_sigma(field) if sigma is None else field.select("map_id").distinct().withColumn("sigma", F.lit(float(sigma)))
    near = nn_join(vertices, field, ["map_id"], "vertex_id", "point_index", k=k)
    met = near.join(field.select("map_id", F.col("point_index").alias("near_id"), "value"), ["map_id", "near_id"]).join(widths, "map_id")
    met = met.withColumn("w", F.exp(-F.col("distance") * F.col("distance") / (2 * F.col("sigma") * F.col("sigma"))))
    if cycle_length is None or cycle_length < 0:
        mean = F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w"))
        out = met.groupBy("map_id", "vertex_id").agg(mean.alias("value"), F.sum("w").alias("total"), F.min("distance").alias("nearest"))
    else:
        spans = field.groupBy("map_id").agg(F.min("value").alias("lo"), (F.max("value") - F.min("value") if cycle_length == 0 else F.lit(float(cycle_length))).alias("cycle"))
        met = met.join(spans, "map_id")
        c, s = _cyclic(F.col("value"), F.col("lo"), F.when(F.col("cycle") > 0, F.col("cycle")).otherwise(F.lit(1.0)))
        out = met.groupBy("map_id", "vertex_id").agg(
            F.sum(F.col("w") * c).alias("c"), F.sum(F.col("w") * s).alias("s"), F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("linear"),
            F.first("lo").alias("lo"), F.first("cycle").alias("cycle"), F.sum("w").alias("total"), F.min("distance").alias("nearest"),
        )
        turned = F.col("lo") + F.pmod(F.atan2("s", "c") / F.lit(6.283185307179586), F.lit(1.0)) * F.col("cycle")
        out = out.withColumn("value", F.when(F.col("cycle") > 0, turned).otherwise(F.col("linear")))
    fine = F.col("total") > 0
    if distance_threshold is not None:
        fine = fine & (F.col("nearest") <= distance_threshold)
    return vertices.select("map_id", "vertex_id").join(out, ["map_id", "vertex_id"], "left").select("map_id", "vertex_id", F.when(fine, F.col("value")).alias("value"), "nearest")


def resample(scalars: DataFrame, src_vertices: DataFrame, dst_vertices: DataFrame) -> DataFrame:
    """Every field and mask of one mesh on the vertices of another, by nearest vertex."""
    near = nn_join(dst_vertices, src_vertices, ["map_id"]).select("map_id", "vertex_id", "near_id")
    return near.join(scalars.withColumnRenamed("vertex_id", "near_id"), ["map_id", "near_id"]).drop("near_id")


def coverage(vertices: DataFrame, cloud: DataFrame, radius: float, id_col: str = "point_index") -> DataFrame:
    """Distance from each mesh vertex to the nearest point of a cloud: median, maximum and share within radius, per map."""
    near = nn_join(vertices, cloud, ["map_id"], "vertex_id", id_col)
    return near.groupBy("map_id").agg(F.count("*").alias("n"), F.median("distance").alias("median_distance"), F.max("distance").alias("max_distance"), F.avg((F.col("distance") <= radius).cast("double")).alias("share_within"))


def ablation_area(triangles: DataFrame, vertices: DataFrame, tags: DataFrame, radius: float = 5.0) -> DataFrame:
    """Area (cm2) of triangles whose centroid lies within radius of an RF tag; 0 for maps without tags.

    tags(map_id, placed_id, type, x, y, z); triangles carry their area in mm2.
    """
    corner = triangles.select("map_id", "tri_id", "area", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    centre = corner.join(vertices.select("map_id", "vertex_id", *"xyz"), ["map_id", "vertex_id"]).groupBy("map_id", "tri_id").agg(F.first("area").alias("area"), *[F.avg(c).alias(c) for c in "xyz"])
    near = nn_join(centre, tags.filter("type = 'ablation'"), ["map_id"], "tri_id", "placed_id", max_distance=radius)
    covered = triangles.join(near.select("map_id", "tri_id"), ["map_id", "tri_id"], "left_semi").groupBy("map_id").agg((F.sum("area") / 100).alias("covered_cm2"))
    return triangles.select("map_id").distinct().join(covered, "map_id", "left").select("map_id", F.coalesce("covered_cm2", F.lit(0.0)).alias("covered_cm2"))
