"""Queries over meshes and points in space, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriaflow.functions import vocab
from atriaflow.operators import geodesic, measure, mesh, report, spatial, spread
from atriaflow.plans import standins as st
from atriaflow.plans.standins import GRID, SPACE

QUERIES: dict = {}
SQL: dict[str, str] = {}

EDGES = [(-1000.0, 0.0), (0.0, 2500.0), (2500.0, 5000.0), (5000.0, 10000.0)]
LABELS = [f"{int(a)}..{int(b)}" for a, b in EDGES]
CASES = lambda v: " ".join(f"WHEN {v} >= {a} AND {v} {'<=' if b == 10000.0 else '<'} {b} THEN '{lab}'" for (a, b), lab in zip(EDGES, LABELS))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.simpleString() == "double"})


def intervals(edges=EDGES) -> list:
    return [(f"{int(a)}..{int(b)}", a, b) for a, b in edges]


@query("j12_face_values", f"WITH {GRID} SELECT map_id, tri_id, round(face_value, 6) AS face_value, round(area, 6) AS area FROM t")
def j12(spark, d):
    return rounded(mesh.face_values(st.grid_triangles(spark, d), st.grid_scalars(spark, d)).select("map_id", "tri_id", "face_value", "area"))


@query("a1_scalar_range", f"""WITH {GRID} SELECT map_id, 'activation_time' AS name, min(value) AS min_value, max(value) AS max_value, count(value) AS n_valid FROM v GROUP BY
map_id""")
def a1(spark, d):
    return measure.scalar_range(st.grid_scalars(spark, d))


@query("a2_scalar_statistics", f"""WITH {GRID} SELECT map_id, 'activation_time' AS name, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value,
round(stddev_pop(value), 6) AS std_value FROM v GROUP BY map_id""")
def a2(spark, d):
    return rounded(measure.scalar_statistics(st.grid_scalars(spark, d)))


@query("a3_surface_area", f"WITH {GRID} SELECT map_id, round(sum(area) / 100, 6) AS area_cm2 FROM t GROUP BY map_id")
def a3(spark, d):
    return rounded(measure.surface_area(st.grid_triangles(spark, d)))


@query("a4_interval_areas", f"""WITH {GRID}, l AS (SELECT unnest({LABELS!r}) AS label),
k AS (SELECT map_id, CASE {CASES('face_value')} END AS label, area FROM t),
g AS (SELECT DISTINCT map_id FROM t)
SELECT g.map_id, l.label, round(coalesce(sum(area), 0) / 100, 6) AS area_cm2 FROM g CROSS JOIN l LEFT JOIN k ON k.map_id = g.map_id AND k.label =
l.label GROUP BY ALL""")
def a4(spark, d):
    faces = mesh.face_values(st.grid_triangles(spark, d), st.grid_scalars(spark, d))
    return rounded(measure.areas_for_intervals(faces, intervals()))


_REL = [(0.0, 25.0), (25.0, 50.0), (50.0, 100.0)]


@query("a5_relative_areas", f"""WITH {GRID}, x AS (SELECT map_id, max(value) AS top FROM v GROUP BY map_id),
k AS (SELECT t.map_id, face_value / top * 100 AS share, area FROM t JOIN x USING (map_id)),
g AS (SELECT DISTINCT map_id FROM t), l AS (SELECT * FROM (VALUES ('0..25', 0, 25), ('25..50', 25, 50), ('50..100', 50, 100)) q(label, lo, hi))
SELECT g.map_id, l.label, round(coalesce(sum(area), 0) / 100, 6) AS area_cm2
FROM g CROSS JOIN l LEFT JOIN k ON k.map_id = g.map_id AND share >= lo AND (share < hi OR (hi = 100 AND share = hi)) GROUP BY ALL""")
def a5(spark, d):
    s = st.grid_scalars(spark, d)
    faces = mesh.face_values(st.grid_triangles(spark, d), s)
    return rounded(measure.relative_areas(faces, intervals(_REL), measure.scalar_statistics(s)))


@query("a6_area_histogram", f"""WITH {GRID}, b AS (SELECT map_id, CASE WHEN face_value BETWEEN -1000 AND 10000 THEN least(floor((face_value + 1000) /
1000), 10)::INT END AS bin, sum(area) AS area FROM t GROUP BY ALL),
w AS (SELECT map_id, sum(area) AS total FROM b GROUP BY map_id), g AS (SELECT map_id, total, unnest(range(11))::INT AS bin FROM w),
h AS (SELECT g.map_id, g.bin, coalesce(area, 0) / total * 100 AS pct FROM g LEFT JOIN b ON b.map_id = g.map_id AND b.bin = g.bin)
SELECT map_id, bin, round(pct, 6) AS area_pct, round(sum(pct) OVER (PARTITION BY map_id ORDER BY bin DESC) / 100, 6) AS survival FROM h""")
def a6(spark, d):
    faces = mesh.face_values(st.grid_triangles(spark, d), st.grid_scalars(spark, d))
    return rounded(measure.area_histogram(faces, -1000.0, 10000.0, 1000.0))


@query("a25_low_value_area", f"""WITH {GRID} SELECT map_id, round(coalesce(sum(CASE WHEN face_value > 0 AND face_value < 2000 THEN area END), 0) / 100, 6) AS low_area_cm2 FROM t
GROUP BY map_id""")
def a25(spark, d):
    return rounded(measure.low_value_area(mesh.face_values(st.grid_triangles(spark, d), st.grid_scalars(spark, d), "strict"), 0.0, 2000.0))


@query("a25_mean_value", f"WITH {GRID} SELECT map_id, 'activation_time' AS name, round(avg(value), 6) AS mean_value FROM v GROUP BY map_id")
def a25m(spark, d):
    return rounded(measure.mean_value(st.grid_scalars(spark, d)))


@query("a26_equal_width_intervals", f"""WITH {GRID}, r AS (SELECT map_id, min(value) AS a, max(value) AS b FROM v GROUP BY map_id) SELECT map_id, bin::INT AS bin, round(a + bin * ((b - a) /
8), 6) AS lo, round(a + (bin + 1) * ((b - a) / 8), 6) AS hi FROM r, range(8) q(bin)""")
def a26i(spark, d):
    return rounded(measure.equal_width_intervals(st.grid_scalars(spark, d), 8))


@query("a26_value_histogram", f"""WITH {GRID}, r AS (SELECT map_id, min(value) AS a, max(value) AS b FROM v GROUP BY map_id) SELECT v.map_id, least(floor((value - a) / (b - a) * 24),
23)::INT AS bin, count(*) AS n FROM v JOIN r USING (map_id) GROUP BY ALL""")
def a26h(spark, d):
    return measure.value_histogram(st.grid_scalars(spark, d), 24)


@query("m1_triangle_areas", f"WITH {GRID} SELECT map_id, tri_id, v0, v1, v2, round(area, 6) AS area FROM t")
def m1(spark, d):
    return rounded(st.grid_triangles(spark, d))


@query("m2_vertex_normals", f"""WITH {GRID}, e AS (SELECT map_id, unnest([v0, v1, v2]) AS vertex_id, nx, ny, nz FROM t), s AS (SELECT map_id,
vertex_id, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM e GROUP BY ALL)
SELECT map_id, vertex_id, round(nx / sqrt(nx^2+ny^2+nz^2), 6) + 0.0 AS nx, round(ny / sqrt(nx^2+ny^2+nz^2), 6) + 0.0 AS ny, round(nz /
sqrt(nx^2+ny^2+nz^2), 6) + 0.0 AS nz, true AS at_edge FROM s""")
def m2(spark, d):
    out = rounded(mesh.vertex_normals(st.grid_triangles(spark, d), st.grid_vertices(spark, d)))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("nx", "ny", "nz")})


_EDGE_SQL = "e AS (SELECT DISTINCT map_id, least(p, q) AS a, greatest(p, q) AS b FROM (SELECT map_id, v0 AS p, v1 AS q FROM t UNION ALL SELECT map_id, v1, v2 FROM t UNION ALL SELECT map_id, v0, v2 FROM t)), el AS (SELECT e.map_id, e.a, e.b, sqrt((p.x-q.x)^2+(p.y-q.y)^2+(p.z-q.z)^2) AS length FROM e JOIN v p ON p.k = e.map_id * 900 + a JOIN v q ON q.k = e.map_id * 900 + b)"


@query("m3_mesh_edges", f"WITH {GRID}, {_EDGE_SQL} SELECT map_id, a, b, round(length, 6) AS length FROM el")
def m3(spark, d):
    return rounded(mesh.mesh_edges(st.grid_triangles(spark, d), st.grid_vertices(spark, d)))


def _cot(at: int, p: int, q: int) -> str:
    dot = "+".join(f"({c}{p}-{c}{at})*({c}{q}-{c}{at})" for c in "xyz")
    return f"SELECT map_id, v{p} AS i, v{q} AS j, ({dot}) / (2 * area) / 2 AS w FROM t UNION ALL SELECT map_id, v{q}, v{p}, ({dot}) / (2 * area) / 2 FROM t"


@query("m8_cotangent_laplacian", f"""WITH {GRID}, w AS ({_cot(0, 1, 2)} UNION ALL {_cot(1, 2, 0)} UNION ALL {_cot(2, 0, 1)}), o AS (SELECT map_id, i,
j, sum(w) AS value FROM w GROUP BY ALL)
SELECT map_id, i, j, round(value, 6) + 0.0 AS value FROM o UNION ALL SELECT map_id, i, i, round(-sum(value), 6) + 0.0 FROM o GROUP BY map_id, i""")
def m8(spark, d):
    return rounded(mesh.cotangent_laplacian(st.grid_triangles(spark, d), st.grid_vertices(spark, d))[0]).withColumn("value", F.col("value") + 0.0)


@query("j13_compact_vertices", f"""WITH {GRID}, u AS (SELECT DISTINCT map_id, unnest([v0, v1, v2]) AS vertex_id FROM t WHERE tri_id % 7 = 0), k AS
(SELECT *, map_id * 900 + vertex_id AS kk, (row_number() OVER (PARTITION BY map_id ORDER BY vertex_id) - 1)::INT AS new_id FROM u)
SELECT t.map_id, tri_id, a.new_id AS v0, b.new_id AS v1, c.new_id AS v2 FROM t JOIN k a ON a.kk = t.map_id * 900 + v0 JOIN k b ON b.kk = t.map_id *
900 + v1 JOIN k c ON c.kk = t.map_id * 900 + v2 WHERE tri_id % 7 = 0""")
def j13(spark, d):
    some = st.grid_triangles(spark, d).filter("tri_id % 7 = 0").drop("area")
    return mesh.compact_vertices(st.grid_vertices(spark, d), some)[1]


@query("p12_normalise", f"""WITH {GRID} SELECT map_id, vertex_id, 'activation_time' AS name, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS
value FROM v WINDOW w AS (PARTITION BY map_id)""")
def p12(spark, d):
    return rounded(measure.normalise(st.grid_scalars(spark, d)).select("map_id", "vertex_id", "name", "value"))


@query("p13_display_condition", f"""WITH {GRID} SELECT map_id, vertex_id, 'activation_time' AS name, CASE WHEN value <= avg(value) OVER w + 2 * stddev_pop(value) OVER w THEN CASE WHEN
max(value) OVER w < 0 THEN -value ELSE value END END AS value FROM v WINDOW w AS (PARTITION BY map_id)""")
def p13(spark, d):
    return measure.display_condition(st.grid_scalars(spark, d)).select("map_id", "vertex_id", "name", "value")


@query("p22_colour_class", f"""WITH {GRID} SELECT map_id, vertex_id, CASE WHEN value < 0 THEN 0 WHEN value <= 2500 THEN 0 WHEN value <= 5000 THEN 1 WHEN value <= 9000 THEN 2
END::INT AS interval, round(CASE WHEN value < 0 THEN 0 WHEN value <= 2500 THEN value / 2500 WHEN value <= 5000 THEN (value - 2500) / 2500 WHEN value
<= 9000 THEN (value - 5000) / 4000 END, 8) AS t FROM v""")
def p22(spark, d):
    return rounded(measure.colour_class(st.grid_scalars(spark, d), [0.0, 2500.0, 5000.0, 9000.0], clip_above=False).select("map_id", "vertex_id", "interval", "t"), 8)


@query("w5_peak_site", f"""WITH {GRID} SELECT map_id, 'activation_time' AS name, arg_min(vertex_id, (-value, vertex_id)) AS vertex_id, max(value) AS value FROM v GROUP BY
map_id""")
def w5(spark, d):
    return measure.peak_site(st.grid_scalars(spark, d))


@query("p2_classify_primary", """WITH s AS (SELECT c_nationkey::BIGINT AS map_id, CASE WHEN c_nationkey % 2 = 0 THEN -(c_custkey % 100)::DOUBLE ELSE c_acctbal END AS value FROM
customer) SELECT map_id, CASE WHEN coalesce(min(value) >= -100 AND min(value) < 0 AND max(value) <= 0, false) THEN 'pacemap_score' ELSE
'activation_time' END AS kind, CASE WHEN coalesce(min(value) >= -100 AND min(value) < 0 AND max(value) <= 0, false) THEN -1 ELSE 1 END::INT AS sign
FROM s WHERE abs(value) < 10000 GROUP BY map_id""")
def p2(spark, d):
    s = st.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("map_id"), F.when(F.col("c_nationkey") % 2 == 0, -(F.col("c_custkey") % 100).cast("double")).otherwise(F.col("c_acctbal")).alias("value"))
    return vocab.classify_primary(s)


@query("j1_compare_maps", f"""WITH {SPACE}, d AS (SELECT a.map_id AS pair_id, a.vertex_id, a.value AS a_value, b.vertex_id AS bid, b.value AS bv,
sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) AS dist FROM p a JOIN p b ON a.map_id = b.map_id AND NOT a.odd AND b.odd),
k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, vertex_id ORDER BY dist, bid) AS r FROM d)
SELECT pair_id, vertex_id, round(a_value, 5) AS a_value, CASE WHEN dist <= 10 THEN round(bv, 5) END AS b_value, round(dist, 5) AS distance, CASE WHEN
dist <= 10 THEN round(a_value - bv, 5) END AS delta FROM k WHERE r = 1""")
def j1(spark, d):
    return rounded(_delta(spark, d, 10.0), 5)


def _delta(spark, d, far):
    p = st.space(spark, d)
    own = p.withColumn("map_id", F.col("map_id") * 2 + F.col("odd").cast("long"))
    pairs = p.select("map_id").distinct().select(F.col("map_id").alias("pair_id"), (F.col("map_id") * 2).alias("map_a"), (F.col("map_id") * 2 + 1).alias("map_b"))
    return spatial.compare_maps(pairs, own, own.withColumn("name", F.lit("v")), "v", far)


@query("a8_delta_stats", f"""WITH {SPACE}, d AS (SELECT a.map_id AS pair_id, a.vertex_id, a.value AS av, b.vertex_id AS bid, b.value AS bv,
sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) AS dist FROM p a JOIN p b ON a.map_id = b.map_id AND NOT a.odd AND b.odd),
k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, vertex_id ORDER BY dist, bid) AS r FROM d), e AS (SELECT pair_id, dist, CASE WHEN dist <= 10
THEN av - bv END AS x FROM k WHERE r = 1)
SELECT pair_id, count(x) AS n, round(min(x), 5) AS min_delta, round(max(x), 5) AS max_delta, round(avg(x), 5) AS mean_delta, round(median(x), 5) AS
median_delta, count(*) FILTER (dist > 10) AS n_masked FROM e GROUP BY pair_id""")
def a8(spark, d):
    return rounded(measure.delta_stats(_delta(spark, d, 10.0), 10.0), 5)


_NEAR = "d AS (SELECT a.map_id, a.vertex_id AS pid, b.vertex_id AS vid, a.value AS pv, sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) AS dist FROM p a JOIN p b ON a.map_id = b.map_id AND a.odd AND NOT b.odd), k AS (SELECT *, row_number() OVER (PARTITION BY map_id, pid ORDER BY dist, vid) AS r FROM d)"


@query("j2_project_points", f"WITH {SPACE}, {_NEAR} SELECT map_id, pid AS point_index, vid AS vertex_id, round(dist, 5) AS distance FROM k WHERE r = 1")
def j2(spark, d):
    points, vertices = _points_vertices(spark, d)
    return rounded(spatial.project_points(points, vertices).select("map_id", "point_index", "vertex_id", "distance"), 5)


def _points_vertices(spark, d):
    p = st.space(spark, d)
    return p.filter("odd").withColumnRenamed("vertex_id", "point_index"), p.filter("NOT odd")


@query("j3_confidence_mask", f"""WITH {SPACE}, {_NEAR}, u AS (SELECT DISTINCT p.* FROM k JOIN p ON p.map_id = k.map_id AND p.vertex_id = k.vid WHERE r = 1),
m AS (SELECT a.map_id, a.vertex_id, a.value, min(sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2)) AS dist FROM p a LEFT JOIN u b ON a.map_id = b.map_id
WHERE NOT a.odd GROUP BY ALL)
SELECT map_id, vertex_id, CASE WHEN dist <= 8 OR dist IS NULL THEN round(value, 5) END AS value FROM m""")
def j3(spark, d):
    points, vertices = _points_vertices(spark, d)
    return rounded(spatial.confidence_mask(vertices.select("map_id", "vertex_id", "value"), points, vertices.drop("value"), 8.0).select("map_id", "vertex_id", "value"), 5)


_KNN = "d AS (SELECT a.map_id, a.vertex_id, b.vertex_id AS pid, b.value AS pv, sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) AS dist FROM p a JOIN p b ON a.map_id = b.map_id AND b.odd AND NOT a.odd), k AS (SELECT *, row_number() OVER (PARTITION BY map_id, vertex_id ORDER BY dist, pid) AS r FROM d)"


@query("j4_gaussian_interpolate", f"""WITH {SPACE}, {_KNN}, g AS (SELECT map_id, vertex_id, sum(exp(-(dist * dist) / 800) * pv) / sum(exp(-(dist * dist) / 800)) AS value, min(dist) AS
nearest FROM k WHERE r <= 16 GROUP BY ALL) SELECT map_id, vertex_id, CASE WHEN nearest <= 15 THEN round(value, 5) END AS value, round(nearest, 5) AS
nearest FROM g""")
def j4(spark, d):
    points, vertices = _points_vertices(spark, d)
    return rounded(spatial.gaussian_interpolate(vertices, points, 20.0, 15.0), 5)


@query("j5_cyclic_interpolate", f"""WITH {SPACE}, {_KNN}, r AS (SELECT map_id, min(value) AS lo, max(value) - min(value) AS cl FROM p WHERE odd GROUP
BY map_id),
g AS (SELECT k.map_id, vertex_id, lo, cl, sum(exp(-(dist * dist) / 800) * cos((pv - lo) / cl * 6.283185307179586)) AS c, sum(exp(-(dist * dist) /
800) * sin((pv - lo) / cl * 6.283185307179586)) AS s, min(dist) AS nearest FROM k JOIN r ON r.map_id = k.map_id WHERE k.r <= 16 GROUP BY ALL)
SELECT map_id, vertex_id, round(lo + (atan2(s, c) / 6.283185307179586 - floor(atan2(s, c) / 6.283185307179586)) * cl, 5) AS value, round(nearest, 5)
AS nearest FROM g""")
def j5(spark, d):
    points, vertices = _points_vertices(spark, d)
    return rounded(spatial.gaussian_interpolate(vertices, points, 20.0, None, 0.0), 5)


@query("j6_resample", f"WITH {SPACE}, {_KNN} SELECT map_id, vertex_id, round(pv, 5) AS value FROM k WHERE r = 1")
def j6(spark, d):
    p = st.space(spark, d)
    return rounded(spatial.resample(p.filter("odd").select("map_id", "vertex_id", "value"), p.filter("odd"), p.filter("NOT odd")), 5)


@query("a7_default_sigma", f"""WITH {SPACE}, d AS (SELECT a.map_id, a.vertex_id, min(sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2)) AS dist FROM p a JOIN p b ON a.map_id = b.map_id AND
a.vertex_id <> b.vertex_id GROUP BY ALL) SELECT map_id, round(median(dist), 5) AS sigma FROM d WHERE dist > 0 GROUP BY map_id""")
def a7(spark, d):
    return rounded(spatial.default_sigma(st.space(spark, d), "vertex_id"), 5)


@query("a18_coverage", f"""WITH {SPACE}, {_KNN} SELECT map_id, count(*) AS n, round(median(dist), 5) AS median_distance, round(max(dist), 5) AS max_distance, round(avg((dist <=
12)::INT), 5) AS share_within FROM k WHERE r = 1 GROUP BY map_id""")
def a18(spark, d):
    points, vertices = _points_vertices(spark, d)
    return rounded(spatial.coverage(vertices, points, 12.0), 5)


@query("j18_ablation_area", f"""WITH {GRID}, g AS (SELECT v.map_id, vertex_id AS placed_id, x, y, z FROM v WHERE vertex_id % 97 = 5),
b AS (SELECT t.map_id, tri_id, area, (x0+x1+x2)/3 AS x, (y0+y1+y2)/3 AS y, (z0+z1+z2)/3 AS z FROM t),
h AS (SELECT DISTINCT b.map_id, tri_id FROM b JOIN g ON g.map_id = b.map_id AND sqrt((g.x-b.x)^2+(g.y-b.y)^2+(g.z-b.z)^2) <= 3.1)
SELECT b.map_id, round(coalesce(sum(CASE WHEN h.tri_id IS NOT NULL THEN area END), 0) / 100, 5) AS covered_cm2 FROM b LEFT JOIN h ON h.map_id =
b.map_id AND h.tri_id = b.tri_id GROUP BY b.map_id""")
def j18(spark, d):
    v = st.grid_vertices(spark, d)
    tags = v.filter("vertex_id % 97 = 5").select("map_id", F.col("vertex_id").alias("placed_id"), F.lit("ablation").alias("type"), "x", "y", "z")
    return rounded(spatial.ablation_area(st.grid_triangles(spark, d), v, tags, 3.1), 5)


@query("a9_region_spread", f"""WITH {SPACE}, q AS (SELECT * FROM p WHERE value BETWEEN 0.05 AND 0.4), d AS (SELECT a.map_id, a.vertex_id AS a,
b.vertex_id AS b, sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) AS d FROM q a JOIN q b ON a.map_id = b.map_id AND a.vertex_id <> b.vertex_id),
s AS (SELECT map_id, max(d) AS mx, avg(d) AS av, median(d) AS md FROM d WHERE a < b GROUP BY map_id), n AS (SELECT map_id, max(d) AS nn FROM (SELECT
map_id, a, min(d) AS d FROM d GROUP BY ALL) GROUP BY map_id)
SELECT m.map_id, round(coalesce(nn, 0), 5) AS max_nn, round(coalesce(mx, 0), 5) AS max_distance, round(coalesce(av, 0), 5) AS mean_distance,
round(coalesce(md, 0), 5) AS median_distance FROM (SELECT DISTINCT map_id FROM p) m LEFT JOIN s USING (map_id) LEFT JOIN n USING (map_id)""")
def a9(spark, d):
    p = st.space(spark, d)
    return rounded(spread.region_spread(p.select("map_id", "vertex_id", "value"), p, 0.05, 0.4), 5)


# ---- solvers: no SQL form; tests/ holds them against closed forms -------------------------------------------


def _sources(spark, d):
    return st.grid_vertices(spark, d).filter("vertex_id IN (0, 445)").select("map_id", "vertex_id")


def _paths_sql(sources: str, what: str) -> str:
    """Relaxation until nothing changes, by recursion over one row per vertex."""
    return f"""WITH RECURSIVE {GRID}, {_EDGE_SQL}, w AS (SELECT map_id, a, b, length FROM el UNION ALL SELECT map_id, b, a, length FROM el),
d(map_id, vertex_id, distance, source) USING KEY (map_id, vertex_id) AS (
  SELECT map_id, vertex_id, 0.0::DOUBLE, vertex_id FROM v WHERE {sources} AND map_id IN (SELECT map_id FROM t)
  UNION
  SELECT n.map_id, n.b, n.distance, n.source FROM (
    SELECT d.map_id, w.b, min(d.distance + w.length) AS distance, arg_min(d.source, (d.distance + w.length, d.source)) AS source FROM d JOIN w ON
w.map_id = d.map_id AND w.a = d.vertex_id GROUP BY d.map_id, w.b) n
  LEFT JOIN recurring.d o ON o.map_id = n.map_id AND o.vertex_id = n.b WHERE o.distance IS NULL OR n.distance < o.distance - 1e-9)
{what}"""


@query("m4_shortest_paths", _paths_sql("vertex_id IN (0, 445)", "SELECT map_id, vertex_id, round(distance, 6) AS distance FROM d"))
def m4(spark, d):
    edges = mesh.mesh_edges(st.grid_triangles(spark, d), st.grid_vertices(spark, d))
    return rounded(geodesic.shortest_paths(edges, _sources(spark, d))).select("map_id", "vertex_id", "distance")


@query("m6_nearest_source", _paths_sql("vertex_id IN (0, 445)", """, dq AS (SELECT map_id, vertex_id, round(distance, 6) AS dist, vertex_id IN (0, 445) AS source FROM d),
up AS (SELECT a.map_id, a.vertex_id, arg_min(b.vertex_id, (b.dist, b.vertex_id)) AS parent FROM dq a JOIN w ON w.map_id = a.map_id AND w.a = a.vertex_id JOIN dq b ON b.map_id = w.map_id AND b.vertex_id = w.b
  WHERE NOT a.source AND (b.source OR (b.dist, b.vertex_id) < (a.dist, a.vertex_id)) GROUP BY ALL),
lab AS (SELECT map_id, vertex_id, vertex_id AS source FROM dq WHERE source UNION ALL SELECT up.map_id, up.vertex_id, lab.source FROM lab JOIN up ON up.map_id = lab.map_id AND up.parent = lab.vertex_id)
SELECT map_id, vertex_id, source FROM lab"""))
def m6(spark, d):
    edges = mesh.mesh_edges(st.grid_triangles(spark, d), st.grid_vertices(spark, d))
    return geodesic.nearest_source(edges, rounded(geodesic.shortest_paths(edges, _sources(spark, d)).select("map_id", "vertex_id", "distance")), _sources(spark, d))


@query("m7_heat_geodesic")
def m7(spark, d):
    return rounded(geodesic.heat_geodesic(st.grid_vertices(spark, d), st.grid_triangles(spark, d), _sources(spark, d)), 4)


@query("m9_heat_interpolate")
def m9(spark, d):
    v = st.grid_vertices(spark, d)
    field = v.filter("vertex_id % 11 = 3").select("map_id", "vertex_id", "value")
    field = field.unionByName(field.filter("vertex_id % 2 = 0").withColumn("value", F.col("value") + 5))
    return rounded(geodesic.heat_interpolate(v, st.grid_triangles(spark, d), field), 4)


@query("m10_conduction_directions")
def m10(spark, d):
    return rounded(geodesic.conduction_directions(st.grid_vertices(spark, d)), 4)


@query("m5_geodesic_delta", _paths_sql("vertex_id % 13 = 4", """SELECT d.map_id, d.vertex_id, round(distance, 6) AS distance, round(CASE WHEN
distance <= 6 THEN b.value * 0.5 END, 6) AS b_value, round(a.value - CASE WHEN distance <= 6 THEN b.value * 0.5 END, 6) AS delta
FROM d JOIN v a ON a.map_id = d.map_id AND a.vertex_id = d.vertex_id JOIN v b ON b.map_id = d.map_id AND b.vertex_id = d.source"""))
def m5(spark, d):
    v = st.grid_vertices(spark, d)
    edges = mesh.mesh_edges(st.grid_triangles(spark, d), v)
    b = v.filter("vertex_id % 13 = 4").select("map_id", "vertex_id", (F.col("value") * 0.5).alias("b_value"))
    return rounded(geodesic.geodesic_delta(edges, v.select("map_id", "vertex_id", F.col("value").alias("a_value")), b, 6.0))


@query("a12_report_table", f"""WITH {GRID}, i AS (SELECT DISTINCT map_id * 2 AS map_id FROM v), s AS (SELECT map_id, min(value) AS min_value,
max(value) AS max_value, avg(value) AS mean_value, stddev_pop(value) AS std_value FROM v GROUP BY map_id),
a AS (SELECT t.map_id, sum(area) / 100 AS area_cm2, coalesce(sum(area) FILTER (face_value >= -1000 AND face_value < 2500), 0) / 100 AS low,
coalesce(sum(area) FILTER (face_value BETWEEN 2500 AND 10000), 0) / 100 AS high,
  coalesce(sum(area) FILTER (face_value / max_value * 100 BETWEEN 0 AND 50), 0) / 100 AS half FROM t JOIN s USING (map_id) GROUP BY t.map_id)
SELECT i.map_id, round(area_cm2, 4) AS area_cm2, round(min_value, 4) AS min_value, round(max_value, 4) AS max_value, round(mean_value, 4) AS
mean_value, round(std_value, 4) AS std_value, round(low, 4) AS "low (abs)", round(high, 4) AS "high (abs)", round(half, 4) AS "half (rel)",
CASE WHEN area_cm2 IS NOT NULL AND i.map_id % 3 = 0 THEN 'LA' END AS atrium, NULL::VARCHAR AS part, area_cm2 IS NOT NULL AS found FROM i LEFT JOIN a
USING (map_id) LEFT JOIN s USING (map_id)""")
def a12(spark, d):
    scalars, triangles = st.grid_scalars(spark, d), st.grid_triangles(spark, d)
    faces, stats = mesh.face_values(triangles, scalars), measure.scalar_statistics(scalars)
    absolute = measure.areas_for_intervals(faces, [("low", -1000.0, 2500.0), ("high", 2500.0, 10000.0)])
    relative = measure.relative_areas(faces, [("half", 0.0, 50.0)], stats)
    attributes = scalars.select("map_id").distinct().filter("map_id % 3 = 0").select("map_id", F.create_map(F.lit("atrium"), F.lit("LA")).alias("attributes"))
    ids = scalars.select((F.col("map_id") * 2).alias("map_id"))
    return report.report_table(ids, measure.surface_area(triangles), stats, absolute, relative, ["low", "high"], ["half"], attributes, ["atrium", "part"])


# ---- made surfaces, as many as there are suppliers ----------------------------------------------------------


@query("m11_synthetic_maps", """WITH n AS (SELECT count(*) AS n FROM supplier), g AS (SELECT m AS map_id, k AS vertex_id, (k % 12) / 12.0 *
6.283185307179586 AS u, (k // 12 + 0.5) / 12.0 * 3.141592653589793 AS w FROM n, range(n) a(m), range(144) b(k)),
s AS (SELECT map_id, 100 * exp(-((30 * cos(u) * sin(w))^2 + (25 * sin(u) * sin(w))^2 + (35 * cos(w) - 35)^2) / 450) AS v FROM g)
SELECT map_id, count(*) AS n_vertices, 264::BIGINT AS n_triangles, round(max(v), 5) AS most, count(*) FILTER (v >= 50) AS n_high FROM s GROUP BY 1""")
def m11(spark, d):
    vertices, triangles, scalars = mesh.synthetic_maps(spark, st.table(spark, d, "supplier").count(), 12)
    n = triangles.groupBy("map_id").agg(F.count("*").alias("n_triangles"))
    values = scalars.groupBy("map_id").agg(F.count("*").alias("n_vertices"), F.round(F.max("value"), 5).alias("most"), F.count_if(F.col("value") >= 50).alias("n_high"))
    return values.join(n, "map_id")
