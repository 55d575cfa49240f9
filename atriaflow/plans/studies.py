"""Queries over study exports that Spark writes as texts from the given tables, with the SQL that gives what they must read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atriaflow.operators import link
from atriaflow.plans import standins as st
from atriaflow.plans.standins import GRID, SIGNALS
from atriaflow.sources import exports, studies

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def joined(df: DataFrame, keys: list[str], order: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """The lines of each key in order, as one text ``rows``."""
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("__line"))))
    return df.groupBy(*keys).agg(F.array_join(rows["__line"], sep).alias("rows"))


def text(*cols: str | Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


# ---- S2 --------------------------------------------------------------------------------------------------


def _volumes(spark, d):
    """A text of two volumes per map of the grid: the surface with values and status, and one without polygons."""
    v, t = st.grid_vertices(spark, d), st.grid_triangles(spark, d)
    a = joined(v, ["map_id"], ["vertex_id"], text("x", "y", "z"), "\n").withColumnRenamed("rows", "a")
    b = joined(t, ["map_id"], ["tri_id"], text(F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1)).withColumnRenamed("rows", "b")
    c = joined(v, ["map_id"], ["vertex_id"], F.col("value").cast("string"), " ").withColumnRenamed("rows", "c")
    e = joined(v, ["map_id"], ["vertex_id"], (F.col("vertex_id") % 3).cast("string"), " ").withColumnRenamed("rows", "e")
    whole = a.join(b, "map_id").join(c, "map_id").join(e, "map_id")
    value = F.concat(
        F.lit('<?xml version="1.0"?>\n<DIF><DIFHeader/><DIFBody><Volumes number="2"><Volume name="chamber '), F.col("map_id").cast("string"), F.lit('"><Vertices number="1">'), "a", F.lit('</Vertices><Polygons number="1">'), "b",
        F.lit("</Polygons><Map_data>"), "c", F.lit("</Map_data><Map_status>"), "e", F.lit('</Map_status><Translation>1 2 3</Translation><Labels><Label color="1"> apex </Label></Labels></Volume><Volume name="empty"><Vertices>1 2 3</Vertices></Volume></Volumes></DIFBody></DIF>'),
    )
    return whole.select(F.concat(F.lit("dif/"), F.col("map_id").cast("string")).alias("file"), value.alias("value"))


@query("s2_dif_vertices", f"""WITH {GRID} SELECT 'dif/' || map_id AS file, 0 AS volume, vertex_id, x, y, round(z, 6) AS z, value, vertex_id % 3 = 0 AS valid FROM v WHERE map_id IN
(SELECT map_id FROM t)""")
def s2_vertices(spark, d):
    return studies.read_dif(_volumes(spark, d))[1].select("file", "volume", "vertex_id", "x", "y", F.round("z", 6).alias("z"), "value", "valid")


@query("s2_dif_triangles", f"""WITH {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY tri_id) - 1 AS i FROM t) SELECT 'dif/' || map_id AS file, 0 AS volume,
i::INT AS tri_id, v0::INT AS v0, v1::INT AS v1, v2::INT AS v2 FROM r""")
def s2_triangles(spark, d):
    return studies.read_dif(_volumes(spark, d))[2]


@query("s2_dif_volumes", f"""WITH {GRID} SELECT DISTINCT 'dif/' || map_id AS file, 0 AS volume, 'chamber ' || map_id AS name, 'apex' AS labels, 2.0::DOUBLE AS shift_y FROM t""")
def s2_volumes(spark, d):
    return studies.read_dif(_volumes(spark, d))[0].select("file", "volume", "name", F.array_join("labels", ",").alias("labels"), F.get("translation", F.lit(1)).alias("shift_y"))


@query("s2_dif_names", f"""WITH {GRID}, m AS (SELECT DISTINCT map_id FROM t) SELECT 'dif/' || map_id AS file, k AS volume, CASE k WHEN 0 THEN 'chamber ' || map_id ELSE 'empty'
END AS name FROM m, (VALUES (0), (1)) q(k)""")
def s2_names(spark, d):
    return studies.volume_names(_volumes(spark, d))


# ---- S3, S4, S5: a study per nation, a map per customer, a point per order -------------------------------


def _named_points(spark, d):
    c = st.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("study"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("map_name"))
    o = st.table(spark, d, "orders").join(c, "o_custkey")
    key = F.col("o_orderkey")
    return o.select("study", "map_name", "o_custkey", "o_orderkey", (key % 1000).alias("x"), (key % 77).alias("y"), (F.col("o_custkey") % 50).alias("z"), F.col("o_totalprice").alias("price"))


_CATALOGUE_CTE = """p AS (SELECT c_nationkey AS study, 'm' || c_custkey AS map_name, o_custkey, o_orderkey, o_totalprice AS price,
  (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1)::INT AS point_index FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _catalogues(spark, d):
    p = _named_points(spark, d)
    tags = F.when(F.col("o_orderkey") % 3 == 0, F.lit('<Tags Count="3">4 25 x 99</Tags>')).otherwise(F.lit('<Tags Count="0"/>'))
    point = F.concat(F.lit('<Point Id="'), F.col("o_orderkey").cast("string"), F.lit('" Position3D="'), text("x", "y", "z"), F.lit('">'), tags, F.lit("</Point>"))
    maps = p.groupBy("study", "map_name").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", point.alias("s")))).alias("points"))
    one = F.concat(F.lit('<Map Name="'), "map_name", F.lit('" FileNames="'), "map_name", F.lit('.mesh"><CartoPoints Count="'), F.size("points").cast("string"), F.lit('">'), F.array_join(F.transform("points", lambda r: r["s"]), ""), F.lit("</CartoPoints></Map>"))
    whole = joined(maps.select("study", "map_name", one.alias("s")), ["study"], ["map_name"], F.col("s"))
    table = '<TagsTable Count="2"><Tag ID="4" Full_Name="Scar" Short_Name="S"/><Tag ID="25" Full_Name="" Short_Name="own"/></TagsTable>'
    value = F.concat(F.lit('<?xml version="1.0"?>\n<Study name="study '), F.col("study").cast("string"), F.lit(f'"><Maps Count="1">{table}'), "rows", F.lit("</Maps></Study>"))
    return whole.select(F.concat(F.lit("cat/"), F.col("study").cast("string"), F.lit(".xml")).alias("file"), value.alias("value"))


@query("s3_catalogue_maps", f"""WITH {_CATALOGUE_CTE} SELECT 'cat/' || study || '.xml' AS file, 'study ' || study AS study_name, map_name, map_name || '.mesh' AS mesh_file,
count(*)::INT AS number_of_points FROM p GROUP BY ALL""")
def s3_maps(spark, d):
    return studies.read_catalogue(_catalogues(spark, d))[0]


@query("s3_catalogue_points", f"""WITH {_CATALOGUE_CTE} SELECT 'cat/' || study || '.xml' AS file, map_name, point_index, (o_orderkey % 1000)::DOUBLE
AS x, (o_orderkey % 77)::DOUBLE AS y, (o_custkey % 50)::DOUBLE AS z,
CASE WHEN o_orderkey % 3 = 0 THEN 'Scar;own;99' ELSE '' END AS tags FROM p""")
def s3_points(spark, d):
    return studies.read_catalogue(_catalogues(spark, d))[1].withColumn("tags", F.array_join("tags", ";"))


def _point_texts(spark, d):
    """Lists of points, point texts (every seventh is not there) and electrode texts: declared ones, and ones that only their name gives to a point."""
    p = _named_points(spark, d)
    key = F.col("o_orderkey").cast("string")
    entry = F.concat(F.lit('<Point ID="'), key, F.lit('" File_Name="'), F.col("map_name"), F.lit("_P"), key, F.lit('_Point_Export.xml"/>'))
    lists = joined(p, ["map_name"], ["o_orderkey"], entry).select(F.concat(F.lit("x/"), "map_name", F.lit("_Points_Export.xml")).alias("file"), F.concat(F.lit("<Points>"), "rows", F.lit("</Points>")).alias("value"))
    cs = F.concat("map_name", F.lit("_P"), key, F.lit("_CS_CONNECTOR_Eleclectrode_Positions_OnAnnotation.txt"))
    body = F.concat(
        F.lit('<Point ID="'), key, F.lit('"><Annotations StartTime="'), key, F.lit('" Reference_Annotation="2000" Map_Annotation="'), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 90).cast("string")).otherwise(""),
        F.lit('"/><WOI From="-50" To="75.5"/><Voltages Unipolar="1.5" Bipolar="'), F.col("price").cast("string"), F.lit('"/><Positions><Connector CS_CONNECTOR="'), cs, F.lit('"/><Connector CS_CONNECTOR="s_Sensor_Positions_OnAnnotation.txt"/></Positions></Point>'),
    )
    details = p.filter("o_orderkey % 7 <> 0").select(F.concat(F.lit("x/"), "map_name", F.lit("_P"), key, F.lit("_Point_Export.xml")).alias("file"), body.alias("value"))
    head = "Eleclectrode_Positions_2.0\nElectrode#\tTime\tX\tY\tZ\n"
    row = lambda n, x: F.concat(F.lit(f"{n}\t0\t"), text(x, "y", "z", sep="\t"))
    one = p.filter("o_orderkey % 4 = 0").select(F.concat(F.lit("x/"), cs).alias("file"), F.concat(F.lit(head), row(1, "x"), F.lit("\n"), row(2, "z"), F.lit("\nshort\t1\n")).alias("value"))
    other = p.filter("o_orderkey % 4 < 2").select(F.explode(F.array(F.lit("CS_CONNECTOR"), F.lit("NAVISTAR_CONNECTOR"))).alias("k"), "map_name", key.alias("o"), F.concat(F.lit(head), row(1, "y")).alias("value"))
    other = other.select(F.concat(F.lit("x/"), "map_name", F.lit("_"), "k", F.lit("_Eleclectrode_Positions_OnAnnotation_"), "o", F.lit(".txt")).alias("file"), "value")
    return lists, details, studies.read_electrodes(one.unionByName(other))


@query("s4_points", f"""WITH {_CATALOGUE_CTE}, k AS (SELECT *, o_orderkey % 7 <> 0 AS there FROM p)
SELECT map_name, point_index, o_orderkey AS source_id, CASE WHEN there THEN o_orderkey END AS start_time, CASE WHEN there THEN 2000.0::DOUBLE END AS
reference_annotation, CASE WHEN there AND o_orderkey % 2 = 0 THEN (o_orderkey % 90)::DOUBLE END AS map_annotation,
CASE WHEN there THEN -50.0::DOUBLE END AS woi_from, CASE WHEN there THEN 75.5::DOUBLE END AS woi_to, CASE WHEN there THEN 1.5::DOUBLE END AS
unipolar_voltage, CASE WHEN there THEN price END AS bipolar_voltage,
CASE WHEN NOT there THEN NULL WHEN o_orderkey % 4 = 0 THEN concat_ws(' ', o_orderkey % 1000, o_orderkey % 77, o_custkey % 50, o_custkey % 50,
o_orderkey % 77, o_custkey % 50) WHEN o_orderkey % 4 = 1 THEN concat_ws(' ', o_orderkey % 77, o_orderkey % 77, o_custkey % 50) END AS cs,
CASE WHEN there AND o_orderkey % 4 < 2 THEN concat_ws(' ', o_orderkey % 77, o_orderkey % 77, o_custkey % 50) END AS roving,
CASE WHEN NOT there THEN '' WHEN o_orderkey % 4 < 2 THEN 'CS_CONNECTOR,NAVISTAR_CONNECTOR' ELSE 'CS_CONNECTOR' END AS connectors FROM k""")
def s4(spark, d):
    whole = lambda c: F.array_join(F.transform(F.try_element_at("electrodes", F.lit(c)), lambda x: x.cast("int").cast("string")), " ")
    out = studies.read_points(*_point_texts(spark, d))
    return out.select(*[c for c in out.columns if c not in ("electrodes", "connectors")], whole("CS").alias("cs"), whole("ROVING").alias("roving"), F.array_join("connectors", ",").alias("connectors"))


@query("s5_backfill_positions", f"""WITH {_CATALOGUE_CTE}, k AS (SELECT *, point_index % 4 = 0 AS own, point_index % 5 <> 4 AS known FROM p)
SELECT map_name, point_index, CASE WHEN own THEN -1.0 ELSE (o_orderkey % 1000)::DOUBLE END AS x, CASE WHEN own THEN -2.0 ELSE (o_orderkey %
77)::DOUBLE END AS y, CASE WHEN known AND o_orderkey % 3 = 0 THEN 'Scar;own;99' WHEN known THEN '' END AS tags FROM k WHERE own OR known""")
def s5(spark, d):
    catalogue = studies.read_catalogue(_catalogues(spark, d))[1]
    bare = [F.when(F.col("point_index") % 4 == 0, F.lit(v)).alias(c) for c, v in (("x", -1.0), ("y", -2.0), ("z", -3.0))]
    points = catalogue.select("map_name", "point_index", *bare)
    out = studies.backfill_positions(points, catalogue.filter("point_index % 5 <> 4"))
    return out.select("map_name", "point_index", "x", "y", F.array_join("tags", ";").alias("tags"))


# ---- S7, S9, S12: a text per user, a row per event -------------------------------------------------------


def _force_texts(spark, d):
    s = st.samples(spark, d)
    rows = joined(s, ["data_uri"], ["sample_idx"], text("sample_idx", F.col("sample_idx") * 20, "value", F.lit(1.5), F.lit(-2)))
    head = "ContactForce.txt_2.0\nIntervalNonGraph\n0 1 2\nIntervalNonGraph\t3\n9 11.5 12 13\nx\nIndex\tTime\tForceValue\tAxialAngle\tLateralAngle\n"
    return rows.select(F.col("data_uri").alias("file"), F.concat(F.lit(head), "rows", F.lit("\n")).alias("value"))


@query("s7_force_samples", f"""WITH {SIGNALS}, c(channel, unit) AS (VALUES ('ForceValue', 'g'), ('AxialAngle', 'deg'), ('LateralAngle', 'deg'))
SELECT data_uri AS file, sample_idx, (sample_idx * 20)::DOUBLE AS t, c.channel, CASE c.channel WHEN 'ForceValue' THEN value WHEN 'AxialAngle' THEN
1.5 ELSE -2.0 END AS value, unit FROM s, c""")
def s7(spark, d):
    return studies.read_force(_force_texts(spark, d))[1]


@query("s7_force_windows", f"""WITH {SIGNALS} SELECT data_uri AS file, CASE WHEN count(*) > 1 THEN 50.0::DOUBLE END AS sample_rate, 11.5::DOUBLE AS force, 12.0::DOUBLE AS
axial_angle, 13.0::DOUBLE AS lateral_angle FROM s GROUP BY 1""")
def s7_windows(spark, d):
    return studies.read_force(_force_texts(spark, d))[0]


_PHASES = "CASE channel WHEN 'click' THEN 'Expiration' WHEN 'view' THEN 'UNKNOWN' WHEN 'error' THEN 'odd' ELSE 'INSPIRATION' END"


@query("s9_point_cloud", f"""WITH {SIGNALS}, k AS (SELECT *, sample_idx % 86400 AS sec FROM s)
SELECT data_uri AS file, sample_idx, (sec - min(sec) OVER (PARTITION BY data_uri))::DOUBLE AS t, value AS trn_x, 1.0::DOUBLE AS trn_y, 2.0::DOUBLE AS
trn_z, -value AS raw_x, NULL::DOUBLE AS raw_y, 5.0::DOUBLE AS raw_z,
CASE channel WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.0 WHEN 'error' THEN NULL ELSE 2.0 END::DOUBLE AS respiration FROM k""")
def s9(spark, d):
    s = st.samples(spark, d)
    sec = F.col("sample_idx") % 86400
    clock = F.concat(F.lpad(F.floor(sec / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(sec % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((sec % 60).cast("string"), 2, "0"), F.lit(".000"))
    rows = joined(s, ["data_uri"], ["sample_idx"], F.concat_ws(",", clock, F.col("value").cast("string"), F.lit("1"), F.lit(" 2"), (-F.col("value")).cast("string"), F.lit(""), F.lit("5"), F.expr(_PHASES)))
    head = "Export Data Element:,Model Point Cloud\nExport from Segment:,N/A\n\nTime,trn_x,trn_y,trn_z,raw_x,raw_y,raw_z,respiration_phase\n"
    return studies.read_point_cloud(rows.select(F.col("data_uri").alias("file"), F.concat(F.lit(head), "rows", F.lit("\nEOF")).alias("value")))


@query("s12_dxl_waveforms", f"""WITH {SIGNALS}, k AS (SELECT *, user_id % 2 = 0 AS ref FROM (SELECT *, data_uri::BIGINT AS user_id FROM s))
SELECT CASE WHEN ref THEN 'dxl/' || data_uri || '/Wave_refs.csv' ELSE 'dxl/' || data_uri || '/wave_rov.csv' END AS file, (sample_idx + 1)::INT AS
row_no, CASE WHEN ref THEN 'reference' ELSE 'bipolar' END AS role, channel, CASE WHEN NOT ref THEN sample_idx::VARCHAR END AS point_id,
'g' || sample_idx % 3 AS freeze_group, sample_idx + 0.5 AS start_time, 4.0::DOUBLE AS sample_rate, i AS sample_idx, i / 4.0 AS t, CASE i WHEN 0 THEN
value WHEN 2 THEN -1.0 END AS value FROM k, (VALUES (0), (1), (2)) q(i)""")
def s12(spark, d):
    s = st.samples(spark, d)
    row = F.concat_ws(",", "channel", F.col("sample_idx").cast("string"), F.concat(F.lit("g"), (F.col("sample_idx") % 3).cast("string")), (F.col("sample_idx") + 0.5).cast("string"), F.col("value").cast("string"), F.lit(""), F.lit("-1"), F.lit(""))
    rows = joined(s, ["data_uri"], ["sample_idx"], row)
    head = "St. Jude\nSample rate:,4\nWaveform samples exported:,3\nTrace,(Point #),Freeze Grp #,startTime (abs),0,1,2,\n"
    name = F.when(F.col("data_uri").cast("long") % 2 == 0, "/Wave_refs.csv").otherwise("/wave_rov.csv")
    texts = rows.select(F.concat(F.lit("dxl/"), "data_uri", name).alias("file"), F.concat(F.lit(head), "rows", F.lit("\nEOF\nafter,the,end")).alias("value"))
    none = rows.select(F.concat(F.lit("dxl/"), "data_uri", F.lit("/wave_refs2.csv")).alias("file"), F.lit("Waveform samples exported:,0\n").alias("value"))
    return studies.read_dxl_waveforms(texts.unionByName(none)).drop("map_sample")


# ---- S10, S11: a text per supplier, a point per line item ------------------------------------------------


_ITEMS = "i AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1)::INT AS point_index FROM lineitem)"


def _items(spark, d):
    return st.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


@query("s10_dxl_points", f"""WITH {_ITEMS} SELECT 'dxl/' || l_suppkey || '/Map.csv' AS file, point_index, l_orderkey::VARCHAR AS source_id,
l_quantity AS x, 1.0::DOUBLE AS y, l_tax AS z,
CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_suppkey % 3 = 0 THEN 'voltage_unipolar' WHEN l_suppkey % 3 = 1 THEN 'cfe_mean_uni' ELSE 'New value'
END || '=' || l_linenumber END AS value, CASE WHEN l_linenumber < 5 THEN l_linenumber::DOUBLE END AS adjusted,
CASE WHEN l_linenumber > 2 THEN (l_linenumber - 3)::DOUBLE END AS force, CASE WHEN l_returnflag = 'A' THEN 'g1' END AS freeze_group, 'dxl/' ||
l_suppkey AS source_folder, 'D2' AS electrode FROM i WHERE l_returnflag <> 'R' OR l_linenumber <> 1""")
def s10(spark, d):
    n = F.col("l_linenumber")
    place = F.when((F.col("l_returnflag") == "R") & (n == 1), "").otherwise(F.col("l_quantity").cast("string"))
    row = F.concat_ws(",", F.col("l_orderkey").cast("string"), place, F.lit("1"), F.col("l_tax").cast("string"), n.cast("string"), F.when(F.col("l_returnflag") == "N", "0").otherwise("1.0"), F.when(n < 5, n.cast("string")).otherwise("10000"), (n - 3).cast("string"), F.lit("7"), F.lit("8"), F.lit("9"), F.lit("D2"), F.when(F.col("l_returnflag") == "A", " g1").otherwise(""), F.lit("tick"), F.lit("tack"))
    rows = joined(_items(spark, d), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], row)
    kind = F.when(F.col("l_suppkey") % 3 == 0, "PP_uni").when(F.col("l_suppkey") % 3 == 1, "CFEmean_uni").otherwise("News_bi")
    column = F.when(F.col("l_suppkey") % 3 == 0, "P-P").otherwise("New value")
    head = F.concat(F.lit("Export\nData starts in row,5\nMap type:,"), kind, F.lit("\nMap name:,x\ty\n(Point #),surface x,surface y,surface z,"), column, F.lit(","), column, F.lit(" valid,adjTime (ms),force (g),roving x,roving y,roving z,Electrodes,Freeze Grp #,Rov Tick\n"))
    texts = rows.select(F.concat(F.lit("dxl/"), F.col("l_suppkey").cast("string"), F.lit("/Map.csv")).alias("file"), F.concat(head, "rows", F.lit("\n\n")).alias("value"))
    out = studies.read_dxl_points(texts)
    own = F.get(F.filter(F.map_entries("measurements"), lambda e: ~e["key"].isin("annotation_time", "contact_force")), F.lit(0))
    value = lambda c: F.try_element_at("measurements", F.lit(c))["value"]
    return out.select("file", "point_index", "source_id", "x", "y", "z", F.concat(own["key"], F.lit("="), own["value"]["value"].cast("int").cast("string")).alias("value"), value("annotation_time").alias("adjusted"), value("contact_force").alias("force"), F.try_element_at("annotations", F.lit("freeze_group")).alias("freeze_group"), F.try_element_at("annotations", F.lit("source_folder")).alias("source_folder"), F.array_join(F.map_keys("electrodes"), ",").alias("electrode"))


@query("s10_map_names", """WITH f AS (SELECT p_brand AS map_key, p_partkey, CASE WHEN p_size % 10 > 0 THEN p_brand || CASE WHEN p_brand LIKE '%3' THEN '-' || p_size % 3 ELSE '' END END AS declared FROM part)
SELECT map_key, CASE WHEN count(DISTINCT declared) = 1 THEN min(declared) ELSE min('p' || p_partkey) END AS map_name FROM f GROUP BY map_key""")
def s10_names(spark, d):
    """A point export for each part; the files of a brand are a map, which takes the name that they declare."""
    p = st.table(spark, d, "part")
    name = F.when(F.col("p_size") % 10 > 0, F.concat(F.lit("Map name:,VoXel\t "), "p_brand", F.when(F.col("p_brand").endswith("3"), F.concat(F.lit("-"), (F.col("p_size") % 3).cast("string"))).otherwise(""))).otherwise("Map name:,")
    text = F.concat(F.lit("Export\nData starts in row,5\nMap type:,PP_bi\n"), name, F.lit("\nMap name:,late\n(Point #)\nMap name:,too late\n"))
    files = p.select(F.concat_ws("/", F.lit("dxl"), "p_brand", F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".csv"))).alias("file"), text.alias("value"))
    told = studies.read_map_names(files)
    stem = F.regexp_replace(studies.base_name("file"), r"\.[^.]*$", "")
    return link.operator_map_name(told.select(F.element_at(F.split("file", "/"), -2).alias("map_key"), F.col("map_name").alias("declared"), stem.alias("stem")))


@query("s11_archive_points", f"""WITH {_ITEMS} SELECT l_suppkey::VARCHAR AS file, point_index, l_quantity AS x, l_tax AS y, 3.0::DOUBLE AS z,
l_discount AS bipolar, CASE WHEN l_linenumber <> 2 THEN l_linenumber::DOUBLE END AS correlation,
CASE WHEN l_returnflag <> 'A' THEN 12.5 END AS force, 'activation_time,' || CASE WHEN l_returnflag <> 'A' THEN 'contact_force,' ELSE '' END || CASE
WHEN l_linenumber <> 2 THEN 'correlation,' ELSE '' END || 'voltage_bipolar' AS measured, l_tax AS electrode_y FROM i""")
def s11(spark, d):
    row = F.concat_ws(",", F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"), F.lit("3"), F.col("l_discount").cast("string"), F.lit("-5"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber").cast("string")).otherwise(""), F.when(F.col("l_returnflag") == "A", "-1").otherwise("12.5"), F.lit("1"), F.col("l_tax").cast("string"), F.lit("2"))
    rows = joined(_items(spark, d), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], row)
    head = "x,y,z,pp,correctedLAT,correlationCoefficient,force,locChA_x,locChA_y,locChA_z\n"
    out = studies.read_archive_points(rows.select(F.col("l_suppkey").cast("string").alias("file"), F.concat(F.lit(head), "rows").alias("value")))
    value = lambda c: F.try_element_at("measurements", F.lit(c))["value"]
    return out.select("file", "point_index", "x", "y", "z", value("voltage_bipolar").alias("bipolar"), value("correlation").alias("correlation"), value("contact_force").alias("force"), F.array_join(F.array_sort(F.map_keys("measurements")), ",").alias("measured"), F.get(F.try_element_at("electrodes", F.lit("A")), F.lit(1)).alias("electrode_y"))


# ---- S18, S21 --------------------------------------------------------------------------------------------


@query("s18_study_tree", f"""WITH {_CATALOGUE_CTE}, a AS (SELECT study, count(*) AS n_points, count(DISTINCT map_name) AS n_maps FROM p GROUP BY 1)
SELECT 'study ' || study AS name, 'carto' AS vendor, n_maps, n_points, (SELECT count(*) FROM supplier WHERE s_nationkey = study) AS n_placed,
n_points AS n_keys FROM a""")
def s18(spark, d):
    p = _named_points(spark, d).withColumn("study_name", F.concat(F.lit("study "), F.col("study").cast("string")))
    maps = p.select("study_name", F.lit("carto").alias("vendor"), "map_name").distinct()
    placed = st.table(spark, d, "supplier").select(F.concat(F.lit("study "), F.col("s_nationkey").cast("string")).alias("study_name"), F.lit("ablation").alias("type"), F.col("s_suppkey").alias("placed_no"))
    tree = studies.study_tree(maps, p.select("study_name", "map_name", F.col("o_orderkey").alias("point_index"), "x", "y", "z"), placed)
    count = lambda df, name: df.groupBy("study_id").agg(F.count("*").alias(name))
    points = tree["points"].groupBy("study_id").agg(F.count("*").alias("n_points"), F.count_distinct("point_id").alias("n_keys"))
    out = tree["studies"].join(count(tree["maps"], "n_maps"), "study_id").join(points, "study_id").join(count(tree["placed_points"], "n_placed"), "study_id", "left")
    return out.select("name", "vendor", "n_maps", "n_points", F.coalesce("n_placed", F.lit(0)).alias("n_placed"), "n_keys")


@query("s21_export_raw", f"""WITH {GRID}, w AS (SELECT DISTINCT user_id FROM events)
SELECT v.map_id, count(*) AS n_vertices, (SELECT count(*) FROM t WHERE t.map_id = v.map_id) AS n_faces, round(sum(x + y), 3) AS place, round(sum(CASE
WHEN vertex_id % 7 <> 0 THEN value END), 2) AS total, count(*) FILTER (vertex_id % 7 = 0) AS n_missing,
(SELECT count(*) FROM w WHERE CASE WHEN user_id % 3 = 0 THEN user_id % 5 = v.map_id % 5 ELSE user_id = v.map_id END) AS n_windows,
'mesh,fields,waveforms' AS included FROM v GROUP BY v.map_id""")
def s21(spark, d):
    v, t = st.grid_vertices(spark, d), st.grid_triangles(spark, d)
    maps = v.select("map_id").distinct().withColumns({"study_id": F.col("map_id") % 5, "map_name": F.concat(F.lit("m"), F.col("map_id").cast("string"))})
    scalars = v.select("map_id", F.lit("act").alias("name"), "vertex_id", F.when(F.col("vertex_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    u = st.table(spark, d, "events").select("user_id").distinct()
    waves = u.select(F.col("user_id").alias("waveform_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("map_id"), (F.col("user_id") % 5).alias("study_id"), F.lit("u").alias("data_uri"))
    none = v.filter("false")
    documents = studies.export_raw(maps, v, t, scalars, none.withColumn("point_index", F.lit(0)), none.withColumnRenamed("map_id", "study_id").withColumns({"placed_id": F.lit(0), "type": F.lit("")}), waves, "mesh,fields,waveforms")
    kind = "vertices ARRAY<STRUCT<vertex_id: INT, x: DOUBLE, y: DOUBLE>>, faces ARRAY<STRUCT<tri_id: INT>>, scalar_fields ARRAY<STRUCT<value: DOUBLE>>, waveforms ARRAY<STRUCT<waveform_id: BIGINT>>, included ARRAY<STRING>"
    j = documents.select("map_id", F.from_json("document", kind).alias("j")).select("map_id", "j.*")
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, e: a + F.coalesce(f(e), F.lit(0.0)))
    n = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    return j.select("map_id", n("vertices").alias("n_vertices"), n("faces").alias("n_faces"), F.round(total("vertices", lambda e: e["x"] + e["y"]), 3).alias("place"), F.round(total("scalar_fields", lambda e: e["value"]), 2).alias("total"), F.size(F.filter("scalar_fields", lambda e: e["value"].isNull())).cast("long").alias("n_missing"), n("waveforms").alias("n_windows"), F.array_join("included", ",").alias("included"))
