"""Mesh, point and signal tables derived from the given tables, in Spark and (as common table expressions) in SQL.

Grid meshes: customers in key order are laid out on 30 x 30 grids, 900 to a map. Points in space: the first numbers of each
embedding. Signals: events of a user in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atriaflow.operators import mesh
from atriaflow.shared import scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, vertex_id, x, y, z, value."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.floor(key / 900).cast("long").alias("map_id"), (key % 900).cast("int").alias("vertex_id"),
        (key % 30).cast("double").alias("x"), F.floor((key % 900) / 30).cast("double").alias("y"), ((key * 7 % 5) * F.lit(0.3)).alias("z"),
        F.col("c_acctbal").alias("value"),
    )


def grid_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, tri_id, v0, v1, v2, area: two triangles per square whose four corners are there."""
    v = grid_vertices(spark, sf_dir)
    n = v.groupBy("map_id").agg(F.count("*").alias("n"))
    at = F.col("vertex_id")
    square = v.join(n, "map_id").filter((at % 30 < 29) & (at + 31 < F.col("n")))
    two = F.array(F.struct(at.alias("v0"), (at + 1).alias("v1"), (at + 30).alias("v2")), F.struct((at + 1).alias("v0"), (at + 31).alias("v1"), (at + 30).alias("v2")))
    flat = square.select("map_id", at.alias("at"), F.posexplode(two).alias("half", "t")).select("map_id", (F.col("at") * 2 + F.col("half")).alias("tri_id"), "t.v0", "t.v1", "t.v2")
    return mesh.triangle_areas(flat, v)


def grid_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, vertex_id, name, value."""
    return grid_vertices(spark, sf_dir).select("map_id", "vertex_id", F.lit("activation_time").alias("name"), "value")


GRID = """
v AS (SELECT c_custkey AS k, (c_custkey // 900)::BIGINT AS map_id, (c_custkey % 900)::INT AS vertex_id, (c_custkey % 30)::DOUBLE AS x,
  ((c_custkey % 900) // 30)::DOUBLE AS y, (c_custkey * 7 % 5) * 0.3::DOUBLE AS z, c_acctbal AS value FROM customer),
n AS (SELECT map_id, count(*) AS n FROM v GROUP BY map_id),
t0 AS (SELECT v.map_id, v.k, v.k + h AS k0, v.k + CASE WHEN h = 0 THEN 1 ELSE 31 END AS k1, v.k + 30 AS k2, v.vertex_id * 2 + h AS tri_id, vertex_id + h AS v0, CASE WHEN h = 0 THEN vertex_id + 1 ELSE vertex_id + 31 END AS v1, vertex_id + 30 AS v2
  FROM v JOIN n ON v.map_id = n.map_id, (VALUES (0), (1)) q(h) WHERE vertex_id % 30 < 29 AND vertex_id + 31 < n),
c AS (SELECT t0.map_id, t0.tri_id, t0.v0, t0.v1, t0.v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, d.x AS x2, d.y AS y2, d.z AS z2, a.value AS f0, b.value AS f1, d.value AS f2
  FROM t0 JOIN v a ON a.k = k0 JOIN v b ON b.k = k1 JOIN v d ON d.k = k2),
t AS (SELECT *, (f0 + f1 + f2) / 3 AS face_value,
  (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS nx, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS ny, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS nz,
  sqrt(((y1-y0)*(z2-z0) - (z1-z0)*(y2-y0))^2 + ((z1-z0)*(x2-x0) - (x1-x0)*(z2-z0))^2 + ((x1-x0)*(y2-y0) - (y1-y0)*(x2-x0))^2) / 2 AS area FROM c)"""


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, vertex_id, x, y, z, value, odd."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("map_id"), F.col("vec_id").alias("vertex_id"), (e(0) * 100).alias("x"), (e(1) * 100).alias("y"), (e(2) * 100).alias("z"), e(3).alias("value"), (F.col("vec_id") % 2 == 1).alias("odd"))


SPACE = """
p AS (SELECT label::BIGINT AS map_id, vec_id AS vertex_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z,
  embedding[4]::DOUBLE AS value, vec_id % 2 = 1 AS odd FROM embeddings)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_uri, sample_idx, t (seconds of 2024), channel, value."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("data_uri"), (F.row_number().over(own) - 1).cast("int").alias("sample_idx"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6).alias("t"), F.col("event_type").alias("channel"), "value",
    )


SIGNALS = """
s AS (SELECT user_id::VARCHAR AS data_uri, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS sample_idx,
  (epoch_us(ts) - 1704067200000000) / 1e6 AS t, event_type AS channel, value FROM events)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id (supplier), point_index (order), name, kind, unit, value: line items as long measurements."""
    kind = F.when(F.col("l_returnflag") == "A", "voltage_bipolar").when(F.col("l_returnflag") == "N", "voltage_unipolar").otherwise("activation_time")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("map_id"), F.col("l_orderkey").alias("point_index"), F.concat("l_returnflag", "l_linestatus").alias("name"), kind.alias("kind"), F.when(F.col("l_linestatus") == "F", "mV").otherwise("V").alias("unit"), F.col("l_quantity").alias("value"))
    return rows.groupBy("map_id", "point_index", "name", "kind", "unit").agg(F.max("value").alias("value"))


LONG = """
m AS (SELECT l_suppkey AS map_id, l_orderkey AS point_index, l_returnflag || l_linestatus AS name,
  CASE l_returnflag WHEN 'A' THEN 'voltage_bipolar' WHEN 'N' THEN 'voltage_unipolar' ELSE 'activation_time' END AS kind,
  CASE l_linestatus WHEN 'F' THEN 'mV' ELSE 'V' END AS unit, max(l_quantity) AS value FROM lineitem GROUP BY ALL)"""


def points_of(long: DataFrame) -> DataFrame:
    """map_id, point_index, measurements: the map form of long measurements."""
    entry = F.struct(F.col("name"), F.struct("value", "kind", "unit").alias("m"))
    return long.groupBy("map_id", "point_index").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("measurements"))
