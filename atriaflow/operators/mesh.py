"""Meshes as tables: corner joins, areas, normals, edges, compaction, the cotangent Laplacian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def corners(triangles: DataFrame) -> DataFrame:
    """One row per triangle corner: map_id, tri_id, corner (0..2), vertex_id."""
    return triangles.select("map_id", "tri_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vertex_id"))


def with_corner_columns(triangles: DataFrame, vertices: DataFrame, cols: list[str]) -> DataFrame:
    """Per triangle, the named vertex columns of its corners as ``<col>0..2``: one join of the exploded corners, regrouped."""
    met = corners(triangles).join(vertices.select("map_id", "vertex_id", *cols), ["map_id", "vertex_id"], "left")
    picked = [F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for c in cols for k in range(3)]
    ids = [F.max(F.when(F.col("corner") == k, F.col("vertex_id"))).alias(f"v{k}") for k in range(3)]
    return met.groupBy("map_id", "tri_id").agg(*ids, *picked)


def face_values(triangles: DataFrame, scalars: DataFrame, how: str = "available") -> DataFrame:
    """Face value = mean of its corners' values; ``available`` ignores missing ones, ``strict`` wants all three."""
    corner = triangles.select("map_id", "tri_id", "area", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    met = corner.join(scalars.select("map_id", "vertex_id", "name", "value"), ["map_id", "vertex_id"])
    mean = F.avg("value") if how == "available" else F.when(F.count("value") == 3, F.avg("value"))
    return met.groupBy("map_id", "tri_id", "name").agg(mean.alias("face_value"), F.max("area").alias("area"))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _edge(frm: int, to: int) -> list[Column]:
    return [F.col(f"{c}{to}") - F.col(f"{c}{frm}") for c in "xyz"]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def triangle_areas(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """M1: triangles with area (mm2), half the length of the cross product of two edges."""
    met = with_corner_columns(triangles, vertices, ["x", "y", "z"])
    n = _cross(_edge(0, 1), _edge(0, 2))
    return met.select("map_id", "tri_id", "v0", "v1", "v2", (F.sqrt(_dot(n, n)) / 2).alias("area"))


def vertex_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """M2: area-weighted unit normals, and at_edge: whether a face uses the vertex (so true for every row here)."""
    met = with_corner_columns(triangles, vertices, ["x", "y", "z"])
    n = _cross(_edge(0, 1), _edge(0, 2))
    spread = met.select("map_id", *[c.alias(x) for c, x in zip(n, ("nx", "ny", "nz"))], F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    total = spread.groupBy("map_id", "vertex_id").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return total.select("map_id", "vertex_id", *[F.when(size > 0, F.col(c) / size).otherwise(F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")], F.lit(True).alias("at_edge"))


def mesh_edges(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """M3: undirected edges, each once, with their length: map_id, a < b, length."""
    pairs = triangles.select("map_id", F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))])).alias("e"))
    pairs = pairs.select("map_id", "e.a", "e.b").filter("a <> b").distinct()
    at = lambda k: vertices.select("map_id", F.col("vertex_id").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"])
    met = pairs.join(at("a"), ["map_id", "a"]).join(at("b"), ["map_id", "b"])
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    return met.select("map_id", "a", "b", F.sqrt(_dot(d, d)).alias("length"))


def compact_vertices(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices that a triangle uses, numbered anew without gaps in the order of their ids, and the triangles on them."""
    used = corners(triangles).select("map_id", "vertex_id").distinct()
    kept = vertices.join(used, ["map_id", "vertex_id"], "left_semi")
    kept = kept.withColumn("new_id", (F.row_number().over(Window.partitionBy("map_id").orderBy("vertex_id")) - 1).cast("int"))
    renamed = with_corner_columns(triangles, kept, ["new_id"])
    rest = [c for c in triangles.columns if c not in ("map_id", "tri_id", "v0", "v1", "v2")]
    new = renamed.select("map_id", "tri_id", *[F.col(f"new_id{k}").alias(f"v{k}") for k in range(3)])
    if rest:
        new = new.join(triangles.select("map_id", "tri_id", *rest), ["map_id", "tri_id"])
    return kept.withColumn("vertex_id", F.col("new_id")).drop("new_id"), new


def cotangent_laplacian(triangles: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8: entries(map_id, i, j, value) of the cotangent Laplacian, diagonal included, and mass(map_id, vertex_id, mass)."""
    met = with_corner_columns(triangles, vertices, ["x", "y", "z"])
    n = _cross(_edge(0, 1), _edge(0, 2))
    met = met.withColumn("twice", F.sqrt(_dot(n, n)))
    weights = []
    for at, p, q in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):  # the angle at a corner weighs the edge opposite to it
        cot = F.when(F.col("twice") > 0, _dot(_edge(at, p), _edge(at, q)) / F.col("twice")).otherwise(F.lit(0.0)) / 2
        weights += [F.struct(F.col(f"v{p}").alias("i"), F.col(f"v{q}").alias("j"), cot.alias("w")), F.struct(F.col(f"v{q}").alias("i"), F.col(f"v{p}").alias("j"), cot.alias("w"))]
    off = met.select("map_id", F.explode(F.array(*weights)).alias("e")).groupBy("map_id", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum("e.w").alias("value"))
    diagonal = off.groupBy("map_id", "i").agg((-F.sum("value")).alias("value")).select("map_id", "i", F.col("i").alias("j"), "value")
    mass = met.select("map_id", (F.col("twice") / 6).alias("third"), F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).groupBy("map_id", "vertex_id").agg(F.sum("third").alias("mass"))
    return off.unionByName(diagonal), mass


def synthetic_maps(spark: SparkSession, n_maps: int, resolution: int, sigma: float = 15.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ellipsoids (vertices, triangles, scalars) with a Gaussian score field 100 exp(-d^2 / 2 sigma^2) around a pole; closed form."""
    n = int(resolution)
    ids = spark.range(n_maps * n * n).select((F.col("id") / (n * n)).cast("long").alias("map_id"), (F.col("id") % (n * n)).cast("int").alias("vertex_id"))
    u = (F.col("vertex_id") % n) / F.lit(float(n)) * F.lit(6.283185307179586)
    v = (F.floor(F.col("vertex_id") / n) + 0.5) / F.lit(float(n)) * F.lit(3.141592653589793)
    vertices = ids.select("map_id", "vertex_id", (30 * F.cos(u) * F.sin(v)).alias("x"), (25 * F.sin(u) * F.sin(v)).alias("y"), (35 * F.cos(v)).alias("z"))
    row, col = F.floor(F.col("vertex_id") / n), F.col("vertex_id") % n
    nxt = row * n + (col + 1) % n
    quads = ids.withColumn("row", row).filter(F.col("row") < n - 1).select("map_id", "vertex_id", nxt.cast("int").alias("right"))
    two = F.array(F.struct(F.col("vertex_id").alias("v0"), F.col("right").alias("v1"), (F.col("vertex_id") + n).alias("v2")), F.struct(F.col("right").alias("v0"), (F.col("right") + n).alias("v1"), (F.col("vertex_id") + n).alias("v2")))
    triangles = quads.select("map_id", F.posexplode(two).alias("half", "t"), "vertex_id").select("map_id", (F.col("vertex_id") * 2 + F.col("half")).alias("tri_id"), "t.v0", "t.v1", "t.v2")
    d2 = F.col("x") ** 2 + F.col("y") ** 2 + (F.col("z") - 35) ** 2
    scalars = vertices.select("map_id", "vertex_id", F.lit("pacemap_score").alias("name"), (100 * F.exp(-d2 / (2 * sigma * sigma))).alias("value"))
    return vertices, triangle_areas(triangles, vertices), scalars
