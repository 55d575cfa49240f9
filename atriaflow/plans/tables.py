"""Queries over listings, attributes, links, signals and cohorts, with the SQL that they are held against."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from atriaflow.functions import columns, vocab
from atriaflow.operators import link, measure, report
from atriaflow.plans import standins as st
from atriaflow.plans.meshes import rounded
from atriaflow.plans.standins import LONG, SIGNALS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _maps(spark, d):
    """customers as maps of studies (nations), orders as their points."""
    return st.table(spark, d, "customer").select(F.col("c_custkey").alias("map_id"), F.col("c_nationkey").cast("long").alias("study_id"), F.col("c_name").alias("map_name"), "c_mktsegment")


def _points(spark, d):
    return st.table(spark, d, "orders").select(F.col("o_custkey").alias("map_id"), F.col("o_orderkey").alias("point_index"), "o_totalprice")


@query("a10_list_maps", """SELECT c_nationkey::BIGINT AS study_id, c_custkey AS map_id, c_name AS map_name, count(o_orderkey) AS n_points FROM customer LEFT JOIN orders ON
o_custkey = c_custkey GROUP BY ALL""")
def a10(spark, d):
    return report.list_maps(_maps(spark, d), _points(spark, d))


@query("a10_studies_and_maps", """SELECT n_nationkey::BIGINT AS study_id, n_name AS study_name, c_custkey AS map_id, c_name AS map_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def a10_all(spark, d):
    n = st.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("study_id"), F.col("n_name").alias("study_name"))
    return report.list_studies_and_maps(n, _maps(spark, d), _points(spark, d))


@query("w1_page", "SELECT o_custkey AS map_id, o_orderkey AS point_index FROM orders ORDER BY o_custkey, o_orderkey LIMIT 200 OFFSET 100")
def w1(spark, d):
    return report.page(_points(spark, d).select("map_id", "point_index"), ["map_id", "point_index"], 200, 100)


@query("a11_page_header", f"""WITH {LONG}, n AS (SELECT map_id, name, arg_min(unit, (point_index, unit)) AS unit, count(*) AS n_values FROM m WHERE point_index % 2 = 0 AND map_id % 10 > 0 GROUP BY ALL)
SELECT p.map_id, n_points, name, unit, coalesce(n_values, 0) AS n_values FROM (SELECT map_id, count(DISTINCT point_index) AS n_points FROM m GROUP BY map_id) p LEFT JOIN n USING (map_id)""")
def a11(spark, d):
    """Measurements of every second point, none of every tenth map."""
    long = st.measurements(spark, d)
    return report.page_header(long.filter("point_index % 2 = 0 AND map_id % 10 > 0"), long.select("map_id", "point_index").distinct())


@query("a11_signal_header", """SELECT user_id % 7 AS study_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS channels, 1::BIGINT AS n_rates FROM events GROUP BY 1""")
def a11s(spark, d):
    w = st.table(spark, d, "events").select((F.col("user_id") % 7).alias("study_id"), F.array("event_type").alias("channels"), F.lit(1000.0).alias("sample_rate"))
    return report.signal_header(w)


_ATTRIBUTES = """'{"meta":' || props || ',"tags":["' || event_type || '",' || user_id % 5 || ',{"in":[' || user_id % 3 || ',"' || user_id % 2 || '"]}],"done":' ||
CASE WHEN user_id % 2 = 0 THEN 'true' ELSE '"true"' END || ',"name":"7","none":null}'"""
_WANTED = {"meta": {"k": 7}, "tags": [{"in": ["1"]}, "click"]}


@query("p14_filter_by_attributes", f"""SELECT event_id, 'nested' AS filter FROM events WHERE json_contains({_ATTRIBUTES}, '{json.dumps(_WANTED)}')
UNION ALL SELECT event_id, 'flag' FROM events WHERE json_contains({_ATTRIBUTES}, '{{"done": true, "none": null}}') UNION ALL SELECT event_id, 'kind' FROM events WHERE
json_contains({_ATTRIBUTES}, '{{"tags": [2], "name": "7"}}')""")
def p14(spark, d):
    e = st.table(spark, d, "events").withColumn("attributes", F.expr(_ATTRIBUTES))
    filters = {"nested": _WANTED, "flag": {"done": "TRUE", "none": None}, "kind": {"tags": [2], "name": "7"}, "neither": {"name": 7}}
    parts = [report.filter_by_attributes(e, f).select("event_id", F.lit(n).alias("filter")) for n, f in filters.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("p15_set_attributes", """SELECT c_custkey AS map_id, CASE WHEN c_custkey % 3 = 0 THEN 'VIP' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'yes' END AS
extra, 'none' AS note FROM customer""")
def p15(spark, d):
    m = _maps(spark, d)
    old = m.select("map_id", F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"))
    new = m.filter("map_id % 3 = 0").select("map_id", F.create_map(F.lit("segment"), F.lit("VIP"), F.lit("extra"), F.lit("yes")).alias("attributes"))
    out = report.with_defaults(report.set_attributes(old, new), {"note": "none"})
    return out.select("map_id", *[F.try_element_at("attributes", F.lit(k)).alias(k) for k in ("segment", "extra", "note")])


@query("p16_select_maps", "SELECT p_partkey AS map_id, p_name AS map_name FROM part WHERE p_size >= 5 AND regexp_matches(p_name, '(?i)RED')")
def p16(spark, d):
    m = st.table(spark, d, "part").select(F.col("p_partkey").alias("map_id"), F.col("p_name").alias("map_name"), F.col("p_size").alias("number_of_points"))
    return report.select_maps(m, "RED").select("map_id", "map_name")


#: Map names, study names and what the naming rules make of them: atrium, part ("" is the whole chamber), type.
_NAMES = [
    ("1-LA Sinus anterior wall", "s", "LA", "anterior wall", "activation-SR"),
    ("RA ant", "s", "RA", "lateral wall", None),
    ("VT induction post inf", "s", "LV", "posterior inferior wall", "VT"),
    ("Vera alles", "s", "LA", "", None),
    ("Vera Dach", "s", "LA", "roof", None),
    ("reRA PaceMap septal wall", "s", "RA", "septal wall", "pacemapping"),
    ("Left atrium AFib floor", "s", "LA", "floor", "AFIB"),
    ("map_PW", "RA study", "RA", "posterior wall", None),
    ("Flutter isthmus", "s", None, "isthmus", "flutter"),
    ("LPV isolation", "LA", "LA", None, "PV-isolation"),
    ("RE-LA inferior", "s", "LA", "inferior wall", "reannotation"),
    ("Lateral full", "s", None, "", None),
    ("bipolar lateral wall", "s", None, "lateral wall", "voltage"),
    ("right_atri ic-pattern sep", "s", "RA", "septal wall", "pacemapping"),
    ("plain", "s", None, None, None),
    ("vera 3", "s", "LA", None, None),
]
_NAMES_CTE = "w AS (SELECT i, name, study, atrium, part, map_type FROM (VALUES " + ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else f"'{x}'" for x in r)]) + ")" for i, r in enumerate(_NAMES)) + ") q(i, name, study, atrium, part, map_type))"


def _named(spark, d):
    """parts as maps with one of the names each."""
    at = (F.col("p_partkey") % len(_NAMES)).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in _NAMES]), at)
    return st.table(spark, d, "part").select(F.col("p_partkey").alias("map_id"), pick(0).alias("map_name"), pick(1).alias("study_name"), "p_size")


@query("p17_tag_by_name", f"""WITH {_NAMES_CTE} SELECT p_partkey AS map_id, name AS map_name, atrium, part, map_type FROM part JOIN w ON i = p_partkey % {len(_NAMES)}""")
def p17(spark, d):
    return vocab.tag_by_name(_named(spark, d)).select("map_id", "map_name", "atrium", "part", "map_type")


_NO_PM = "map_type IN ('AFIB', 'flutter', 'VT', 'voltage', 'activation-SR')"


@query("p24_build_attributes", f"""WITH {_NAMES_CTE}, k AS (SELECT p_partkey AS map_id, w.*, p_size % 2 = 0 AS data, name ILIKE 'vera%' AS vera, CASE
WHEN p_size % 3 = 0 THEN 'roof' END AS place FROM part JOIN w ON i = p_partkey % {len(_NAMES)})
SELECT map_id, atrium, CASE WHEN part = '' THEN 'full' WHEN part IS NOT NULL THEN part WHEN vera THEN place END AS part, CASE WHEN map_type =
'pacemapping' OR {_NO_PM} THEN map_type WHEN data AND NOT vera THEN 'pacemapping' ELSE map_type END AS type,
CASE WHEN map_type = 'pacemapping' THEN 'true' WHEN {_NO_PM} THEN 'false' WHEN data AND NOT vera THEN 'true' END AS pacemap FROM k""")
def p24(spark, d):
    maps = _named(spark, d)
    verdict = maps.select("map_id", (F.col("p_size") % 2 == 0).alias("is_pacemap"))
    regions = maps.filter("p_size % 3 = 0").select("map_id", F.lit("roof").alias("region"))
    out = report.build_attributes(vocab.tag_by_name(maps), verdict, regions)
    return out.select("map_id", *[F.try_element_at("attributes", F.lit(c)).alias(c) for c in ("atrium", "part", "type", "pacemap")])


#: File stems and what they say: group key, polarity, part, type tokens, kind.
_STEMS = [
    ("Endo_Voltage_Pre-bi", "Endo_Voltage_Pre", "bipolar", "endo", "voltage,pre", "voltage_bipolar"),
    ("VT-bpolar", "VT", "bipolar", None, "vt", "voltage_bipolar"),
    ("PreMap-unpolar", "PreMap", "unipolar", None, "premap", "voltage_unipolar"),
    ("Epi Stim unipol", "Epi Stim", "unipolar", "epi", "stim", "voltage_unipolar"),
    ("Contact_Mapping_Model_bi_remap", "Contact_Mapping_Model_bi_remap", "bipolar", None, "remap", "voltage_bipolar"),
    ("uni epi endo", "uni epi endo", "unipolar", "endo", "", "voltage_unipolar"),
    ("deepuni", "deep", "unipolar", None, "deepuni", "voltage_unipolar"),
    ("chamber", "chamber", None, None, "", "voltage_bipolar"),
]
_STEMS_CTE = "w AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else f"'{x}'" for x in r)]) + ")" for i, r in enumerate(_STEMS)) + ") q(i, stem, group_key, polarity, part, type_tokens, kind))"


@query("p18_describe_files", f"WITH {_STEMS_CTE} SELECT p_partkey, w.* EXCLUDE (i) FROM part JOIN w ON i = p_partkey % {len(_STEMS)}")
def p18(spark, d):
    stem = F.get(F.array(*[F.lit(r[0]) for r in _STEMS]), (F.col("p_partkey") % len(_STEMS)).cast("int"))
    out = vocab.describe_files(st.table(spark, d, "part").select("p_partkey", stem.alias("stem")))
    return out.withColumn("type_tokens", F.array_join("type_tokens", ","))


@query("p18_dxl_quantity", """WITH w(i, map_type, kind, name) AS (VALUES (0, 'PP_bi', 'voltage_bipolar', 'voltage_bipolar'), (1, 'PP_unipolar',
'voltage_unipolar', 'voltage_unipolar'), (2, 'CFEmean_bi', 'cfe_mean', 'cfe_mean'),
(3, 'CFEmean-uni', 'cfe_mean', 'cfe_mean_uni'), (4, 'LAT', 'activation_time', 'activation_time'), (5, 'Odd_uni', 'unknown', 'column_uni'), (6, 'PP',
'unknown', 'column')) SELECT p_partkey, map_type, kind, name FROM part JOIN w ON i = p_partkey % 7""")
def p18_dxl(spark, d):
    types = ["PP_bi", "PP_unipolar", "CFEmean_bi", "CFEmean-uni", "LAT", "Odd_uni", "PP"]
    p = st.table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, types)), (F.col("p_partkey") % 7).cast("int")).alias("map_type"))
    kind, name = vocab.dxl_quantity(F.col("map_type"), F.lit("column"))
    return p.select("p_partkey", "map_type", kind.alias("kind"), name.alias("name"))


@query("p19_channels", """WITH w(i, raw, name, id, pair, unit) AS (VALUES (0, 'M1(11)', 'M1', '11', NULL, 'unknown'), (1, 'c12x', 'c12x', NULL, NULL,
'mm'), (2, 'CS 1-2', 'CS 1-2', NULL, 'CS 1,CS 2', 'unknown'), (3, 'totalForce_0', 'totalForce_0', NULL, NULL, 'g'),
(4, 'c3_forceTimeIntegral', 'c3_forceTimeIntegral', NULL, NULL, 'g*s'), (5, 'totalForce_ds', 'totalForce_ds', NULL, NULL, 'unknown'), (6, 'tx_1',
'tx_1', NULL, NULL, 'mm'), (7, 'ablDuration', 'ablDuration', NULL, NULL, 's'), (8, 'odd force', 'odd force', NULL, NULL, 'unknown'))
SELECT p_partkey, raw, name, id, pair, unit FROM part JOIN w ON i = p_partkey % 9""")
def p19(spark, d):
    raws = ["M1(11)", "c12x", "CS 1-2", "totalForce_0", "c3_forceTimeIntegral", "totalForce_ds", "tx_1", "ablDuration", "odd force"]
    p = st.table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, raws)), (F.col("p_partkey") % 9).cast("int")).alias("raw"))
    return p.select("p_partkey", "raw", columns.split_channel(F.col("raw"))["name"].alias("name"), columns.split_channel(F.col("raw"))["id"].alias("id"), F.array_join(columns.unipoles(F.col("raw")), ",").alias("pair"), columns.channel_unit(F.col("raw")).alias("unit"))


@query("p23_finite", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_totalprice END AS value FROM orders")
def p23(spark, d):
    odd = F.when(F.col("o_orderkey") % 3 == 0, float("nan")).when(F.col("o_orderkey") % 5 == 0, float("-inf")).otherwise(F.col("o_totalprice"))
    return st.table(spark, d, "orders").select("o_orderkey", columns.finite(odd).alias("value"))


@query("p11_apply_status", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value FROM orders")
def p11(spark, d):
    valid = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True)
    return st.table(spark, d, "orders").select("o_orderkey", columns.apply_status(F.col("o_totalprice"), valid).alias("value"))


def _coloured(spark, d):
    """suppliers as maps, parts of an order as vertices, four named columns of which one never has a value."""
    i = st.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("map_id"), F.monotonically_increasing_id().alias("row"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    cols = [("Bipolar", F.col("l_quantity")), ("LAT", -F.col("l_quantity")), ("Paso", -F.col("l_discount") * 100), ("Empty", F.lit(10000.0)), ("bipolar", F.lit(1.0))]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("position"), v.cast("double").alias("value")) for k, (c, v) in enumerate(cols)])
    return i.select("map_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vertex_id"), F.explode(each).alias("c")).select("map_id", "vertex_id", "c.*")


def _mesh_lexicon(spark):
    return spark.createDataFrame([("mesh", "bipolar", "voltage_bipolar", "mV"), ("mesh", "paso", "pacemap_score", "%")], "domain string, token string, kind string, unit string")


@query("p3_register_columns", """WITH c AS (SELECT l_suppkey AS map_id, l_orderkey * 10 + l_linenumber AS vertex_id, l_quantity AS q, l_discount *
100 AS s FROM lineitem), n(source, name, kind) AS (VALUES ('column:Bipolar', 'voltage_bipolar', 'voltage_bipolar'),
('column:LAT', 'LAT', 'unknown'), ('column:Paso', 'pacemap_score', 'pacemap_score'), ('column:bipolar', 'bipolar', 'voltage_bipolar'))
SELECT map_id, name, kind, source, count(*) AS n, round(sum(CASE source WHEN 'column:Bipolar' THEN q WHEN 'column:LAT' THEN -q WHEN 'column:Paso'
THEN s ELSE 1 END), 3) AS total FROM c, n GROUP BY ALL""")
def p3(spark, d):
    out = vocab.register_columns(_coloured(spark, d), _mesh_lexicon(spark), "mesh")
    return out.groupBy("map_id", "name", "kind", "source").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def _fields(spark, d):
    """fields(map_id, name, kind, position): the kinds of an order's line items, as fields of a map."""
    i = st.table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "pacemap_score").when(F.col("l_returnflag") == "N", "voltage_bipolar").otherwise("correlation")
    return i.select(F.col("l_orderkey").alias("map_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), kind.alias("kind"), F.col("l_linenumber").alias("position")).groupBy("map_id", "name", "position").agg(F.min("kind").alias("kind"))


_FIELDS_CTE = "f AS (SELECT l_orderkey AS map_id, l_linenumber AS position, min(CASE l_returnflag WHEN 'A' THEN 'pacemap_score' WHEN 'N' THEN 'voltage_bipolar' ELSE 'correlation' END) AS kind FROM lineitem GROUP BY ALL)"


@query("p5_legacy_scalar", f"WITH {_FIELDS_CTE} SELECT map_id, 'f' || min(position) AS name FROM f WHERE kind = 'pacemap_score' GROUP BY 1")
def p5(spark, d):
    aliases = spark.createDataFrame([("act", "activation_time", 0), ("act", "pacemap_score", 1), ("vol", "voltage_bipolar", 0)], "alias string, kind string, priority int")
    return vocab.legacy_scalar(_fields(spark, d), aliases, "act")


@query("p6_primary_scalar", f"""WITH {_FIELDS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY CASE kind WHEN 'activation_time'
THEN 0 WHEN 'pacemap_score' THEN 1 WHEN 'voltage_bipolar' THEN 2 WHEN 'voltage_unipolar' THEN 3 ELSE 9 END, position) AS k FROM f)
SELECT map_id, 'f' || position AS name FROM r WHERE k = 1""")
def p6(spark, d):
    return measure.primary_scalar(_fields(spark, d)).select("map_id", "name")


@query("p4_resolve", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'voltage_bipolar' WHEN 'PROMO' THEN 'activation_time' ELSE 'unknown' END AS kind, CASE p_type WHEN
'ECONOMY' THEN 'voltage_bipolar' WHEN 'PROMO' THEN 'activation_time' ELSE p_type END AS field_name FROM part""")
def p4(spark, d):
    lex = spark.createDataFrame([("part", " economy", "voltage_bipolar", "mV"), ("part", "Promo", "activation_time", "ms")], "domain string, token string, kind string, unit string")
    return vocab.resolve(st.table(spark, d, "part"), "p_type", lex, "part").select("p_partkey", "kind", "field_name")


@query("p7_measured_field", f"""WITH {LONG}, f AS (SELECT map_id, point_index, coalesce(max(value) FILTER (name = 'AF'), arg_min(value, name) FILTER (kind = 'AF')) AS value FROM m
GROUP BY ALL) SELECT * FROM f WHERE value IS NOT NULL""")
def p7(spark, d):
    p = st.points_of(st.measurements(spark, d)).withColumns({c: F.lit(0.0) for c in "xyz"})
    return vocab.measured_field(p, "AF").select("map_id", "point_index", "value")


@query("p10_standard_unit", f"""WITH {LONG} SELECT map_id, point_index, name, CASE WHEN kind = 'activation_time' THEN NULL WHEN unit = 'V' THEN value * 1000 ELSE value END AS
standard, CASE WHEN kind = 'activation_time' THEN 'unit not supported: ' || unit END AS note FROM m""")
def p10(spark, d):
    from atriaflow.schema import UNIT_FACTORS

    factors = spark.createDataFrame(UNIT_FACTORS, "quantity string, unit string, factor double")
    return columns.to_standard_unit(st.measurements(spark, d), factors, "value", "kind", "unit").select("map_id", "point_index", "name", "standard", "note")


@query("p21_deidentify", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '[redacted]' WHEN c_custkey % 4 = 1 THEN 'study/12' ELSE
'map of study/' || c_custkey || '.' END AS note, 'study/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '/x' ELSE '' END AS study_name,
CASE WHEN c_custkey % 2 = 0 THEN '[redacted]' END AS "operator", 'deidentified' AS mode FROM customer""")
def p21(spark, d):
    c = st.table(spark, d, "customer")
    key = F.col("c_custkey")
    note = F.when(key % 4 == 0, F.concat(F.lit("C:\\maps\\"), "c_name")).when(key % 4 == 1, F.lit("study/12")).otherwise(F.concat(F.lit("map of "), "c_name", F.lit(".")))
    rows = c.select("c_custkey", note.alias("note"), F.concat("c_name", F.when(key % 3 == 0, "/x").otherwise("")).alias("study_name"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("operator"))
    return report.deidentify(rows, c.select(key.alias("study_id"), F.col("c_name").alias("name")), ["c_custkey"], ["note", "study_name"])


@query("j14_new_studies", "SELECT o_orderkey AS map_id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j14(spark, d):
    batch = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("map_id"), F.col("o_custkey").alias("study_id"))
    return link.new_studies(batch, st.table(spark, d, "supplier").select(F.col("s_suppkey").alias("study_id")), ["study_id"]).select("map_id")


@query("j11_waveforms_for_maps", """WITH w AS (SELECT user_id AS w_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS w_map, user_id % 25 AS
w_study FROM (SELECT DISTINCT user_id FROM events))
SELECT c_custkey AS map_id, w_id FROM customer JOIN w ON w_map = c_custkey OR (w_map IS NULL AND w_study = c_nationkey)""")
def j11(spark, d):
    u = st.table(spark, d, "events").select("user_id").distinct()
    w = u.select(F.col("user_id").alias("w_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("map_id"), (F.col("user_id") % 25).alias("study_id"))
    return link.waveforms_for_maps(_maps(spark, d).select("map_id", "study_id"), w).select("map_id", "w_id")


@query("j15_merge_point_sets", f"""WITH {LONG}, k AS (SELECT point_index, name, arg_max(value, map_id) AS value FROM m GROUP BY ALL)
SELECT point_index, string_agg(name || '=' || value::INT::VARCHAR, ',' ORDER BY name) AS merged FROM k GROUP BY point_index""")
def j15(spark, d):
    files = st.points_of(st.measurements(spark, d)).select(F.lit(1).cast("long").alias("map_id"), F.col("map_id").alias("file_no"), "point_index", F.col("point_index").cast("string").alias("source_id"), *[F.lit(0.0).alias(c) for c in "xyz"], "measurements")
    merged = link.merge_point_sets(files)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("measurements")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"].cast("int").cast("string"))), ",")
    return merged.select(F.col("source_id").cast("long").alias("point_index"), text.alias("merged"))


@query("j16_group_polarity", """WITH s AS (SELECT p_brand || '/' || p_type AS g, p_partkey AS f, p_size % 3 AS shape FROM part), c AS (SELECT g,
count(DISTINCT shape) AS n FROM s GROUP BY g)
SELECT f AS file_id, CASE WHEN n = 1 THEN lower(g) ELSE lower(g) || '#' || f::VARCHAR END AS map_key FROM s JOIN c USING (g)""")
def j16(spark, d):
    p = st.table(spark, d, "part")
    files = p.select(F.col("p_partkey").alias("file_id"), F.concat_ws("/", "p_brand", "p_type").alias("group_key"))
    shape = p.select(F.col("p_partkey").alias("file_id"), F.lit(0).alias("vertex_id"), (F.col("p_size") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return link.group_polarity(files, shape).select("file_id", "map_key")


@query("j17_operator_map_name", """SELECT p_brand AS map_key, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE min(p_name) END AS map_name FROM part GROUP BY p_brand""")
def j17(spark, d):
    return link.operator_map_name(st.table(spark, d, "part").select(F.col("p_brand").alias("map_key"), F.col("p_type").alias("declared"), F.col("p_name").alias("stem")))


@query("j19_window_points", """SELECT 'w' || (l_suppkey % 50)::VARCHAR AS base_name, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS points FROM (SELECT DISTINCT
l_suppkey % 50 AS l_suppkey, l_orderkey FROM lineitem) GROUP BY 1""")
def j19(spark, d):
    p = st.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("w"), "l_orderkey").distinct()
    out = link.window_points(p.select(F.concat(F.lit("dir/w"), F.col("w").cast("string")).alias("file"), F.col("l_orderkey").cast("string").alias("point_id")))
    return out.select("base_name", F.array_join("points", ",").alias("points"))


@query("j20_select_markers", """SELECT s_suppkey AS placed_id, s_nationkey::BIGINT AS study_id FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer) AND s_suppkey IN
(SELECT l_suppkey FROM lineitem WHERE l_suppkey % 3 = 0)""")
def j20(spark, d):
    placed = st.table(spark, d, "supplier").select(F.col("s_suppkey").alias("placed_id"), F.col("s_nationkey").cast("long").alias("study_id"))
    own = link.select_markers(placed, _maps(spark, d))
    asked = st.table(spark, d, "lineitem").filter("l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("placed_id"))
    return link.select_markers(placed, _maps(spark, d), asked.join(own, "placed_id", "left_semi")).select("placed_id", "study_id")


@query("a13_signal_properties", f"""WITH {LONG}, k AS (SELECT DISTINCT map_id, name, kind, unit FROM m), p AS (SELECT DISTINCT map_id, point_index FROM m)
SELECT k.map_id, k.name, count(*) AS n_points, count(m.value) AS n_values, round(sum(m.value), 4) AS total FROM k JOIN p ON k.map_id = p.map_id LEFT
JOIN m ON m.map_id = p.map_id AND m.point_index = p.point_index AND m.name = k.name AND m.unit = k.unit GROUP BY ALL""")
def a13(spark, d):
    long = st.measurements(spark, d)
    out = link.signal_properties(long, long.select("map_id", "point_index").distinct())
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return out.select("map_id", "name", F.size("vector").cast("long").alias("n_points"), F.size(F.filter("vector", lambda x: x.isNotNull())).cast("long").alias("n_values"), F.round(total, 4).alias("total"))


@query("u2_unseen", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def u2(spark, d):
    return report.unseen(st.table(spark, d, "orders").select("o_orderkey"), st.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("u3_with_missing", """SELECT DISTINCT o_custkey * 2 AS map_id, c_name AS name, c_name IS NOT NULL AS found FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2""")
def u3(spark, d):
    ids = _points(spark, d).select((F.col("map_id") * 2).alias("map_id"))
    return report.with_missing(ids, _maps(spark, d).select("map_id", F.col("map_name").alias("name")))


@query("u1_union_vendors", """SELECT 'a' AS vendor, c_custkey AS map_id, c_acctbal AS value, c_mktsegment AS segment FROM customer UNION ALL SELECT 'b', s_suppkey, s_acctbal, NULL
FROM supplier""")
def u1(spark, d):
    a = st.table(spark, d, "customer").select(F.lit("a").alias("vendor"), F.col("c_custkey").alias("map_id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("segment"))
    b = st.table(spark, d, "supplier").select(F.lit("b").alias("vendor"), F.col("s_suppkey").alias("map_id"), F.col("s_acctbal").alias("value"))
    return report.union_vendors(a, b)


@query("a24_channel_stats", f"""WITH {SIGNALS} SELECT data_uri, channel, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, count(*) AS n FROM s
GROUP BY ALL""")
def a24(spark, d):
    return rounded(measure.channel_stats(st.samples(spark, d)))


@query("w2_decimate", f"""WITH {SIGNALS}, k AS (SELECT *, row_number() OVER (PARTITION BY data_uri, channel ORDER BY sample_idx) - 1 AS nth, ceil(count(*) OVER (PARTITION BY
data_uri, channel) / 5.0)::INT AS step FROM s) SELECT data_uri, sample_idx, channel, round(value, 4) AS value FROM k WHERE nth % step = 0""")
def w2(spark, d):
    return report.decimate(st.samples(spark, d), 5).select("data_uri", "sample_idx", "channel", "value")


@query("w2_annotated_channels", f"""WITH {SIGNALS}, k AS (SELECT *, row_number() OVER (PARTITION BY data_uri, channel ORDER BY sample_idx) - 1 AS nth, ceil(count(*) OVER (PARTITION BY
data_uri, channel) / 5.0)::INT AS step FROM s) SELECT data_uri, sample_idx, channel, round(value, 4) AS value FROM k WHERE nth % step = 0 AND (channel = 'click' OR (channel = 'view' AND data_uri::BIGINT % 2 = 0))""")
def w2_annotated(spark, d):
    """Points that name the channel click, and in every second window view too."""
    s = st.samples(spark, d)
    points = s.select("data_uri", F.create_map(F.lit("map"), F.lit("click"), F.lit("reference"), F.when(F.col("data_uri").cast("long") % 2 == 0, "view").otherwise("")).alias("mapping_channels"))
    return report.decimate(s, 5, points=points).select("data_uri", "sample_idx", "channel", "value")


@query("w3_slice_ms", f"WITH {SIGNALS} SELECT data_uri, sample_idx, channel, value FROM s WHERE sample_idx >= 3 AND sample_idx < 12")
def w3(spark, d):
    s = st.samples(spark, d)
    w = s.groupBy("data_uri").agg(F.lit(100.0).alias("sample_rate"), F.count("*").alias("n_samples"))
    return report.slice_ms(s, w, 30.0, 120.0).select("data_uri", "sample_idx", "channel", "value")


@query("s19_sample_rate", f"""WITH {SIGNALS}, k AS (SELECT data_uri, sample_idx * 0.0017 - lag(sample_idx * 0.0017) OVER (PARTITION BY data_uri ORDER BY sample_idx) AS dt FROM s)
SELECT data_uri, round(1 / median(dt)) AS sample_rate FROM k WHERE dt > 0 GROUP BY data_uri""")
def s19(spark, d):
    from atriaflow.sources.signals import infer_sample_rate

    return infer_sample_rate(st.samples(spark, d).withColumn("t", F.col("sample_idx") * 0.0017))


@query("s17_read_samples", f"""WITH {SIGNALS} SELECT data_uri, sample_idx, channel, value FROM s WHERE channel IN ('click', 'view') AND t BETWEEN 100000 AND 900000
UNION ALL SELECT data_uri, sample_idx, channel, value FROM s WHERE data_uri IN ('7', '11')""")
def s17(spark, d):
    """A store of all signals, read by channel and time, and by window."""
    from atriaflow.sources import signals

    path = st.scratch(spark, "signals")
    signals.write_samples(st.samples(spark, d), path)
    by_time = signals.read_samples(spark, path, ["click", "view"], (100000.0, 900000.0))
    return by_time.unionByName(signals.read_samples(spark, path, uris=["7", "11"])).select("data_uri", "sample_idx", "channel", "value")


@query("j8_value_at", f"""WITH {SIGNALS}, q AS (SELECT data_uri, data_uri || ':' || k AS point_id, k * 400000.0 AS rel_t FROM (SELECT DISTINCT data_uri FROM s), range(8) r(k)),
k AS (SELECT point_id, q.data_uri, channel, sample_idx, value, row_number() OVER (PARTITION BY point_id, channel ORDER BY abs(t - rel_t), sample_idx) AS r FROM s JOIN q ON s.data_uri = q.data_uri)
SELECT point_id, channel, CASE WHEN channel = 'click' AND data_uri::BIGINT % 2 = 0 THEN -1.0 ELSE value END AS value, CASE WHEN channel =
'click' AND data_uri::BIGINT % 2 = 0 THEN NULL ELSE sample_idx END AS sample_idx FROM k WHERE r = 1
UNION ALL
SELECT point_id, 'click', -1.0, NULL FROM q WHERE data_uri::BIGINT % 2 = 0 AND data_uri NOT IN (SELECT data_uri FROM s WHERE channel = 'click')""")
def j8(spark, d):
    s = st.samples(spark, d)
    at = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    points = s.select("data_uri").distinct().select("data_uri", at).select(F.concat_ws(":", "data_uri", F.col("k").cast("string")).alias("point_id"), "data_uri", (F.col("k") * 400000.0).alias("rel_t"))
    declared = points.filter("cast(data_uri AS long) % 2 = 0").select("data_uri", F.lit("click").alias("channel"), F.lit(-1.0).alias("value")).distinct()
    return link.value_at(points, s, declared)


@query("j7_force_for_points", """WITH e AS (SELECT *, user_id % 20 AS study_id, user_id % 3 AS map_id, epoch_us(ts) / 1e6 AS moment FROM events),
w AS (SELECT study_id, CASE WHEN user_id % 2 = 0 THEN map_id END AS map_id, event_id AS data_uri, moment AS lo, moment + 3600 AS hi, CASE WHEN event_type = 'view' THEN event_id + 1 END AS of_point FROM e
WHERE event_type IN ('signup', 'view')), p AS (SELECT study_id, map_id, event_id AS point_id, moment FROM e WHERE event_type = 'click'),
b AS (SELECT p.study_id, p.point_id, data_uri, of_point IS NOT NULL AS direct FROM p JOIN w ON p.study_id = w.study_id AND (w.map_id IS NULL OR w.map_id = p.map_id) AND
  CASE WHEN of_point IS NULL THEN moment BETWEEN lo AND hi ELSE point_id = of_point END),
m AS (SELECT study_id, point_id, count(*) AS n, min(data_uri) AS data_uri, bool_or(direct) AS direct FROM b GROUP BY ALL)
SELECT p.study_id, p.map_id, p.point_id, m.data_uri, m.direct FROM p LEFT JOIN m ON m.point_id = p.point_id AND m.study_id = p.study_id AND m.n = 1""")
def j7(spark, d):
    """Windows of a stretch of time, and windows that name their point (the event before it, if both lie in one study)."""
    e = st.table(spark, d, "events").withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "study_id": F.col("user_id") % 20, "map_id": F.col("user_id") % 3})
    w = e.filter("event_type IN ('signup', 'view')").select("study_id", F.when(F.col("user_id") % 2 == 0, F.col("map_id")).alias("map_id"), F.col("event_id").alias("data_uri"), F.col("at").alias("start_time"), F.lit(0.0).alias("first"), F.lit(3600.0).alias("last"), F.when(F.col("event_type") == "view", F.col("event_id") + 1).alias("of_point"))
    p = e.filter("event_type = 'click'").select("study_id", "map_id", F.col("event_id").alias("point_id"), "at")
    return link.force_for_points(p, w, 600.0).select("study_id", "map_id", "point_id", "data_uri", "direct")


_COHORT = "d AS (SELECT lang AS region, quality = 1 AS good, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id))"


_FITTED = """f AS (SELECT quality + 1 AS ref, CASE WHEN lang IN ('en', 'fr') THEN 'LA' ELSE 'RA' END AS atrium, CASE doc_id % 4 WHEN 0 THEN 'posterior wall' WHEN 1 THEN 'anterior wall' WHEN 2 THEN 'lateral wall'
ELSE 'roof' END AS part, toxic = 1 AS multi, CASE WHEN n_chars % 7 > 0 THEN n_chars / 10.0 END AS sigma, n_chars % 50 AS reach FROM documents JOIN labels USING (doc_id)),
d AS (SELECT ref, multi, sigma, CASE WHEN atrium = 'LA' AND part LIKE '%posterior%' THEN 'LA post' WHEN atrium = 'LA' AND part LIKE '%anterior%' THEN 'LA ant' WHEN atrium = 'RA' AND part LIKE
'%posterior%' THEN 'RA post' WHEN atrium = 'RA' AND part LIKE '%lateral%' THEN 'RA lat' ELSE atrium || ' ' || part END AS region FROM f WHERE reach >= 5)"""


@query("a22_cohort_summary", f"""WITH {_FITTED} SELECT ref AS ref_catheters, region, count(*) AS n_all, count(*) FILTER (NOT multi) AS n_focal, count(*) FILTER (multi) AS n_excluded,
round(quantile_cont(sigma, 0.5), 6) AS median_all, round(quantile_cont(sigma, 0.25), 6) AS q1_all, round(quantile_cont(sigma, 0.75), 6) AS q3_all,
round(quantile_cont(sigma, 0.5) FILTER (NOT multi), 6) AS median_focal, round(quantile_cont(sigma, 0.25) FILTER (NOT multi), 6) AS q1_focal, round(quantile_cont(sigma, 0.75) FILTER (NOT
multi), 6) AS q3_focal, round(quantile_cont(sigma, 0.5) - quantile_cont(sigma, 0.5) FILTER (NOT multi), 6) AS delta, grouping(ref) * 2 + grouping(region) AS level
FROM d GROUP BY GROUPING SETS ((ref, region), (ref), (region), ())""")
def a22(spark, d):
    both = st.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(st.table(spark, d, "labels"), "doc_id")
    part = F.element_at(F.array(*map(F.lit, ("posterior wall", "anterior wall", "lateral wall", "roof"))), (F.col("doc_id") % 4 + 1).cast("int"))
    maps = both.select(
        (F.col("quality") + 1).alias("ref_catheters"), F.when(F.col("lang").isin("en", "fr"), "LA").otherwise("RA").alias("atrium"), part.alias("part"), (F.col("toxic") == 1).alias("is_multifocal"),
        F.when(F.col("n_chars") % 7 > 0, F.col("n_chars") / 10.0).alias("sigma"), (F.col("n_chars") % 50).alias("max_geodesic_dist"),
    )
    return rounded(report.cohort_summary(maps))


def _cohort(spark, d):
    both = st.table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(st.table(spark, d, "labels"), "doc_id")
    return both.select(F.col("lang").alias("region"), (F.col("quality") == 1).alias("good"), F.col("n_chars").cast("double").alias("v"))


_A23 = """r AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY v) + (count(*) OVER (PARTITION BY region, v) - 1) / 2.0 AS rk FROM d),
x AS (SELECT region, sum(t * t * t - t) AS ties FROM (SELECT region, v, count(*) AS t FROM d GROUP BY ALL) GROUP BY region),
s AS (SELECT region, count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n2, sum(rk) FILTER (good) - (count(*) FILTER (good)) * (count(*)
FILTER (good) + 1) / 2.0 AS u FROM r GROUP BY region),
z AS (SELECT s.*, ties, (u - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s JOIN x ON s.region IS NOT DISTINCT FROM x.region
WHERE n1 >= 2 AND n2 >= 2)"""
#: The normal tail: a sum of rectangles in the middle of small steps.
_TAIL = "list_sum([exp(-((z + (i + 0.5) / 2000) ** 2) / 2) FOR i IN range(0, 24000)]) / 2000 / sqrt(2 * pi())"


@query("a23_mann_whitney", f"""WITH {_COHORT}, {_A23} SELECT region, n1, n2, u, round(z, 6) AS z, round({_TAIL}, 6) AS p FROM z""")
def a23(spark, d):
    return report.mann_whitney(_cohort(spark, d), ["region"], "good", "v").select("region", "n1", "n2", "u", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("a23_small_samples", f"""WITH RECURSIVE d AS (SELECT lang || ':' || source AS region, quality = 1 AS good, n_chars::DOUBLE + doc_id % 97 / 100.0 AS v FROM documents JOIN labels USING (doc_id)), {_A23},
w AS (SELECT DISTINCT n1, n2, 0 AS i, 0 AS k, 0 AS total, 1::HUGEINT AS ways FROM z WHERE ties = 0 AND least(n1, n2) <= 8
  UNION ALL
  SELECT n1, n2, i + 1, k + take, total + take * (i + 1), sum(ways)::HUGEINT FROM w, range(2) t(take) WHERE i < n1 + n2 AND k + take <= n1 AND n1 - k - take <= n1 + n2 - i - 1 GROUP BY ALL),
c AS (SELECT n1, n2, total - n1 * (n1 + 1) / 2.0 AS reached, ways FROM w WHERE i = n1 + n2),
e AS (SELECT region, sum(ways) FILTER (reached >= u) / sum(ways) AS p FROM z JOIN c ON z.n1 = c.n1 AND z.n2 = c.n2 GROUP BY region)
SELECT z.region, n1, n2, u, ties = 0 AND least(n1, n2) <= 8 AS exact, round(coalesce(e.p, {_TAIL}), 6) AS p FROM z LEFT JOIN e ON z.region = e.region""")
def a23_small(spark, d):
    """Groups by language and source: most are small, and their law is counted out."""
    both = st.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(st.table(spark, d, "labels"), "doc_id")
    rows = both.select(F.concat_ws(":", "lang", "source").alias("region"), (F.col("quality") == 1).alias("good"), (F.col("n_chars") + F.col("doc_id") % 97 / 100.0).alias("v")).filter("region IS NOT NULL")
    return report.mann_whitney(rows, ["region"], "good", "v").select("region", "n1", "n2", "u", "exact", F.round("p", 6).alias("p"))


_PROFILE = "SELECT l_suppkey AS map_id, floor(l_quantity / 2) * 2 + 1 AS bin, round(avg(l_discount * 100), 6) AS mean_score, count(*) AS n FROM lineitem WHERE l_quantity <= 40 GROUP BY ALL HAVING count(*) >= 3"


@query("a19_decay_profile", f"""WITH b AS ({_PROFILE}), e AS (SELECT l_suppkey AS map_id FROM lineitem WHERE l_quantity <= 40 GROUP BY 1 HAVING count(*) >= 20), f AS (SELECT map_id
FROM b GROUP BY 1 HAVING count(*) >= 4) SELECT * FROM b WHERE map_id IN (SELECT map_id FROM e) AND map_id IN (SELECT map_id FROM f)""")
def a19(spark, d):
    return rounded(_profile(spark, d))


def _profile(spark, d):
    return report.decay_profile(st.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("map_id"), F.col("l_quantity").alias("distance"), (F.col("l_discount") * 100).alias("score")))


@query("a20_fit_decay")
def a20(spark, d):
    return report.fit_decay(_profile(spark, d))


@query("a28_point_summary", f"WITH {LONG} SELECT map_id, count(*) AS n_rows, count(value) AS n_finite, median(value) AS median_value FROM m GROUP BY map_id")
def a28(spark, d):
    return measure.point_summary(st.measurements(spark, d))


@query("a16_detect_pacemap", """WITH k AS (SELECT l_suppkey AS map_id, CASE WHEN l_linenumber = 7 THEN -10000 WHEN l_suppkey % 4 = 0 THEN l_quantity
WHEN l_suppkey % 4 = 1 THEN 1 - l_quantity WHEN l_suppkey % 4 = 2 THEN -l_quantity ELSE l_quantity + 9500 END AS v FROM lineitem),
r AS (SELECT map_id, min(v) FILTER (v > -9999) AS lo, max(v) FILTER (v > -9999) AS hi FROM k GROUP BY 1), f AS (SELECT map_id, CASE WHEN hi < 0 THEN
-hi ELSE lo END AS lo, CASE WHEN hi < 0 THEN -lo ELSE hi END AS hi FROM r)
SELECT map_id, CASE WHEN lo > 9000 THEN false ELSE lo >= 0 AND hi <= 100 END AS is_pacemap FROM f""")
def a16(spark, d):
    # maps of 1..50, of -49..0 (its largest value is no negative one, so it stays), of -50..-1 and of sentinels
    q, key = F.col("l_quantity"), F.col("l_suppkey") % 4
    value = F.when(F.col("l_linenumber") == 7, -10000.0).when(key == 0, q).when(key == 1, 1 - q).when(key == 2, -q).otherwise(q + 9500)
    return report.detect_pacemap(st.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("map_id"), value.alias("value")))


@query("p20_ms_to_sample", "SELECT l_orderkey, l_linenumber, round_even(l_quantity * 500 / 1000.0, 0)::BIGINT AS sample FROM lineitem")
def p20(spark, d):
    return st.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", columns.ms_to_sample(F.col("l_quantity"), F.lit(500)).alias("sample"))


@query("w6_first_by", """SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY 1""")
def w6(spark, d):
    return measure.first_by(st.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey"], ["l_linenumber"])


@query("p1_mask_sentinels", "SELECT o_orderkey, CASE WHEN abs(o_totalprice) < 100000 THEN o_totalprice END AS value FROM orders")
def p1(spark, d):
    return st.table(spark, d, "orders").select("o_orderkey", columns.mask_sentinels(F.col("o_totalprice"), 100000.0).alias("value"))


@query("a21_check_rates", """WITH f AS (SELECT user_id AS map_id, event_type AS file, max(event_id % 3) AS k, count(DISTINCT event_id % 3) FILTER
(event_id % 3 > 0) AS n FROM events GROUP BY ALL), c AS (SELECT user_id AS map_id, count(DISTINCT event_id % 3) FILTER (event_id % 3 > 0) AS n_rates
FROM events GROUP BY 1),
v AS (SELECT map_id, count(DISTINCT k) AS n_shapes FROM f GROUP BY 1) SELECT c.map_id, n_rates, n_shapes, concat_ws('; ', CASE WHEN n_rates > 1 THEN
'several sample rates' END, CASE WHEN n_shapes > 1 THEN 'files of different vertex counts' END) AS issues FROM c JOIN v ON v.map_id = c.map_id""")
def a21(spark, d):
    e = st.table(spark, d, "events")
    windows = e.select(F.col("user_id").alias("map_id"), ((F.col("event_id") % 3) * 500.0).alias("sample_rate"))
    files = e.groupBy(F.col("user_id").alias("map_id"), F.col("event_type").alias("file")).agg(F.max(F.col("event_id") % 3).alias("n_vertices"))
    return link.check_rates(windows, files)


@query("a27_ablation_table", """WITH k AS (SELECT *, s_nationkey % 3 AS kind FROM supplier)
SELECT s_nationkey::BIGINT AS study_id, s_suppkey AS placed_id, s_acctbal AS x, s_acctbal AS duration, NULL::DOUBLE AS force, CASE kind WHEN 0 THEN 'lesion_index' END AS index_name,
CASE kind WHEN 0 THEN s_suppkey / 2.0 END AS index FROM k WHERE s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0""")
def a27(spark, d):
    """Studies with one family of indices, with two, with none."""
    key, kind = F.col("s_suppkey"), F.col("s_nationkey") % 3
    numbers = F.create_map(F.lit("duration_s"), F.col("s_acctbal").cast("string"), F.lit("average_force_g"), F.lit("bad"))
    lesion, rf = F.create_map(F.lit("lesion_index"), (key / 2).cast("string")), F.create_map(F.lit("rf_index"), F.lit("1"))
    attributes = F.when(kind == 0, F.map_concat(numbers, lesion)).when(kind == 1, F.map_concat(numbers, lesion, rf)).otherwise(numbers)
    placed = st.table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("long").alias("study_id"), key.alias("placed_id"), F.when(key % 3 == 0, "label").otherwise("ablation").alias("type"),
        F.col("s_acctbal").alias("x"), F.lit(1.0).alias("y"), F.when(key % 7 != 0, F.lit(2.0)).alias("z"), attributes.alias("attributes"),
    )
    return link.ablation_table(placed).select("study_id", "placed_id", "x", "duration", "force", "index_name", "index")


@query("w4_beat_window", f"""WITH {SIGNALS}, b AS (SELECT data_uri, t FROM s WHERE sample_idx = 5) SELECT s.data_uri, s.sample_idx, s.channel, round((s.t - b.t) * 1000, 3) AS
rel_ms FROM s JOIN b ON b.data_uri = s.data_uri WHERE abs((s.t - b.t) * 1000) <= 86400000""")
def w4(spark, d):
    s = st.samples(spark, d)
    beats = s.filter("sample_idx = 5").select(F.col("data_uri").alias("point_id"), "data_uri", F.col("t").alias("reference_t"), (F.col("t") + 1).alias("map_t"))
    return report.beat_window(beats, s, 86400000.0).select("data_uri", "sample_idx", "channel", F.round("rel_ms", 3).alias("rel_ms"))


@query("p15_get_attributes", """SELECT a.c_custkey * 2 AS map_id, b.c_mktsegment AS segment FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey * 2""")
def p15g(spark, d):
    m = _maps(spark, d)
    kept = m.select("map_id", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("map_name")).alias("attributes"))
    out = report.get_attributes(kept, m.select((F.col("map_id") * 2).alias("map_id")), ["segment"])
    return out.select("map_id", F.try_element_at("attributes", F.lit("segment")).alias("segment"))


@query("a17_centroid_region", f"""WITH {st.SPACE}, q AS (SELECT map_id % 3 AS study_id, map_id, vertex_id, CASE WHEN vertex_id % 5 = 0 THEN 0 ELSE x
+ (map_id % 4 - 2) * 12 END AS x, y + (map_id % 3 - 1) * 9 AS y, z - (vertex_id % 2) * 25 + CASE map_id % 3 WHEN 2 THEN 25 ELSE 0 END AS z FROM p),
c AS (SELECT study_id, map_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM q WHERE x <> 0 AND y <> 0 AND z <> 0 GROUP BY ALL)
SELECT study_id, map_id, CASE WHEN x - 1 > 15 THEN 'lateral wall' WHEN x - 1 < -10 AND y > 5 THEN 'roof' WHEN x - 1 < -10 AND y < 0 THEN
'septal wall' WHEN y > 5 AND z > 5 THEN 'anterior wall' WHEN y < -5 AND z < -8 THEN 'posterior inferior wall' END AS region FROM c""")
def a17(spark, d):
    m, v = F.col("map_id"), F.col("vertex_id")
    p = st.space(spark, d).select((m % 3).alias("study_id"), "map_id", F.when(v % 5 == 0, 0.0).otherwise(F.col("x") + (m % 4 - 2) * 12).alias("x"), (F.col("y") + (m % 3 - 1) * 9).alias("y"), (F.col("z") - (v % 2) * 25 + F.when(m % 3 == 2, 25).otherwise(0)).alias("z"))
    ref = p.select("study_id").distinct().select("study_id", F.lit(1.0).alias("rx"), F.lit(0.0).alias("ry"), F.lit(0.0).alias("rz"))
    return report.centroid_region(p, ref).select("study_id", "map_id", "region")


@query("p8_point_annotations", """WITH r AS (SELECT o_custkey AS map_id, o_orderkey AS point_index, (o_orderkey % 250 - 100)::DOUBLE AS diff FROM
orders), g AS (SELECT map_id, bool_or(diff < 0) AS negative FROM r GROUP BY map_id)
SELECT r.map_id, point_index, CASE WHEN r.map_id % 2 = 0 THEN 'pacemap_score' ELSE 'activation_time' END AS kind, CASE WHEN r.map_id % 2 = 1 THEN
diff WHEN NOT (negative AND diff > 0) AND abs(diff) <= 100 THEN abs(diff) END AS value FROM r JOIN g ON g.map_id = r.map_id""")
def p8(spark, d):
    raw = _points(spark, d).select("map_id", "point_index", F.lit(100).alias("reference"), (F.col("point_index") % 250).alias("map_annotation"))
    verdicts = raw.select("map_id").distinct().withColumn("kind", F.when(F.col("map_id") % 2 == 0, "pacemap_score").otherwise("activation_time"))
    return vocab.decode_point_annotations(raw, verdicts)


@query("p9_annotation_bag", """SELECT o_orderkey AS point_index, CASE WHEN o_custkey % 4 <> 0 THEN (o_orderkey % 250)::VARCHAR END AS reference, CASE WHEN o_orderkey % 2 = 0 THEN
(o_orderkey // 2)::VARCHAR ELSE (o_orderkey / 2.0)::DOUBLE::VARCHAR END AS woi FROM orders""")
def p9(spark, d):
    key = F.col("point_index")
    bag = vocab.point_annotations(["reference", "woi"], F.when(F.col("map_id") % 4 == 0, -10000).otherwise(key % 250), key / 2.0)
    out = _points(spark, d).select("point_index", bag.alias("bag"))
    return out.select("point_index", *[F.try_element_at("bag", F.lit(k)).alias(k) for k in ("reference", "woi")])


# ---- signals bound to points ----------------------------------------------------------------------------


def _wanted(spark, d):
    """orders as points that name a channel for each of two roles, and customers' windows with channels of that name (or two)."""
    o = st.table(spark, d, "orders")
    key = F.col("o_orderkey")
    roles = F.array(F.struct(F.lit("bipolar").alias("role"), F.concat(F.lit(" M1"), F.lit("  2")).alias("wanted")), F.struct(F.lit("reference").alias("role"), F.lit("Ref").alias("wanted")))
    points = o.select((F.col("o_custkey") % 20).alias("study_id"), key.alias("point_id"), F.concat(F.lit("g"), (key % 500).cast("string")).alias("freeze_group"), F.explode(roles).alias("r")).select("study_id", "point_id", "freeze_group", "r.*")
    name = F.when(key % 3 == 0, F.array(F.lit("m1 2"), F.lit("M1  2"))).when(key % 3 == 1, F.array(F.lit("M1 2"), F.lit("x"))).otherwise(F.array(F.lit("y")))
    own = o.select((F.col("o_custkey") % 20).alias("study_id"), key.alias("point_id"), F.lit(None).cast("string").alias("freeze_group"), F.concat(F.lit("w"), key.cast("string")).alias("data_uri"), F.explode(name).alias("channel"))
    groups = o.select((F.col("o_custkey") % 20).alias("study_id"), (key % 500).alias("g")).distinct()
    shared = groups.filter("g % 2 = 0").select("study_id", F.lit(None).cast("long").alias("point_id"), F.concat(F.lit("g"), F.col("g").cast("string")).alias("freeze_group"), F.concat_ws("-", F.lit("ref"), "study_id", "g").alias("data_uri"), F.lit("REF").alias("channel"))
    return points, own.unionByName(shared)


@query("j9_bind_signals", """SELECT o_custkey % 20 AS study_id, o_orderkey AS point_id, 'bipolar' AS role, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 1
END::BIGINT AS n, CASE o_orderkey % 3 WHEN 1 THEN 'w' || o_orderkey END AS data_uri, CASE o_orderkey % 3 WHEN 1 THEN 'M1 2' END AS channel FROM
orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_custkey % 20, o_orderkey, 'reference', 1::BIGINT, 'ref-' || o_custkey % 20 || '-' || o_orderkey % 500, 'REF' FROM orders WHERE
o_orderkey % 500 % 2 = 0""")
def j9(spark, d):
    return link.bind_signals(*_wanted(spark, d))


@query("j10_signal_arrays", f"""WITH {SIGNALS}, c AS (SELECT data_uri, channel, count(*) AS n, string_agg(value::VARCHAR, ',' ORDER BY sample_idx) AS
trace FROM s GROUP BY ALL)
SELECT data_uri AS point_id, channel AS role, trace FROM c WHERE channel <> 'error'""")
def j10(spark, d):
    s = st.samples(spark, d).withColumn("value", F.col("value").cast("double"))
    b = s.select("data_uri", "channel").distinct()
    rate = F.when(F.col("channel") != "error", 1000.0)
    bindings = b.select(F.col("data_uri").alias("point_id"), F.col("channel").alias("role"), "data_uri", "channel", rate.alias("sample_rate"), F.lit(10).alias("n_samples"), F.when(F.col("channel") == "view", 1e-7).otherwise(0.0).alias("start_time"), (F.col("channel") == F.lit("click")).alias("primary"))
    some = bindings.filter("primary").select("point_id").distinct()
    bindings = bindings.join(some, "point_id", "left_semi").unionByName(bindings.join(some, "point_id", "left_anti").withColumn("primary", F.col("channel") != "error"))
    out = link.signal_arrays(bindings, s)
    return out.select("point_id", "role", F.array_join(F.transform("trace", lambda x: x.cast("string")), ",").alias("trace"))


@query("a14_surface_slots", """WITH f AS (SELECT c_custkey AS map_id, c_acctbal AS v, c_custkey % 5 AS k FROM customer)
SELECT map_id, 0 AS vertex_id, CASE WHEN k = 1 THEN -abs(v) ELSE CASE WHEN k <> 4 THEN v * 1000 END END AS act, CASE WHEN k <> 2 THEN v / 1000 END AS
bip, NULL::DOUBLE AS uni, CASE WHEN k = 3 THEN NULL ELSE v * 1000 END AS imp, NULL::DOUBLE AS frc,
CASE k WHEN 4 THEN 'lat: unsupported unit ' || chr(39) || 'samples' || chr(39) ELSE '' END || CASE WHEN k = 4 THEN ';' ELSE '' END ||
'no voltage_unipolar;no contact_force' AS notes, CASE WHEN k = 4 THEN 'corr,lat' ELSE 'corr' END AS rest FROM f""")
def a14(spark, d):
    c = st.table(spark, d, "customer")
    v, k = F.col("c_acctbal"), F.col("c_custkey") % 5
    one = lambda name, kind, unit, position, valid=True: F.struct(F.lit(name).alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"), F.lit(position).alias("position"), (F.lit(valid) if isinstance(valid, bool) else valid).alias("valid"))
    fields = F.array(one("lat", F.when(k == 1, "pacemap_score").otherwise("activation_time"), F.when(k == 1, "%").when(k == 4, "samples").otherwise("s"), 0), one("bi", "voltage_bipolar", "uV", 1, k != 2), one("z", "impedance", "kΩ", 2, k != 3), one("corr", "correlation", "", 3))
    scalars = c.select(F.col("c_custkey").alias("map_id"), F.lit(0).alias("vertex_id"), v.alias("value"), F.explode(fields).alias("f")).select("map_id", "vertex_id", "value", "f.*")
    slots, notes = link.surface_slots(scalars, _unit_factors(spark))
    out = slots.join(notes, "map_id", "left")
    return out.select("map_id", "vertex_id", "act", "bip", "uni", "imp", "frc", F.array_join("notes", ";").alias("notes"), F.array_join(F.array_sort(F.map_keys("rest")), ",").alias("rest"))


def _unit_factors(spark):
    from atriaflow.schema import UNIT_FACTORS

    return spark.createDataFrame(UNIT_FACTORS, "quantity string, unit string, factor double")


@query("a15_electric_table", """SELECT o_custkey AS map_id, o_orderkey AS point_index, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS bipolar,
2.0::DOUBLE AS unipolar, CASE WHEN o_orderkey % 3 <> 0 THEN 2000.0::DOUBLE END AS reference,
CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 3 <> 0 THEN 2000 ELSE 0 END - 35.0 ELSE 2010.0 END::DOUBLE AS map_annotation, -50.0::DOUBLE
AS woi_from, NULL::DOUBLE AS woi_to, 'CS,ROVING' AS electrodes,
CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 10.0::DOUBLE END AS lat_ms FROM orders""")
def a15(spark, d):
    o = st.table(spark, d, "orders")
    key = F.col("o_orderkey")
    m = lambda v: F.struct(v.alias("value"), F.lit("k").alias("kind"), F.lit("u").alias("unit"))
    measured = F.map_filter(F.map_from_arrays(F.array(F.lit("voltage_bipolar"), F.lit("voltage_unipolar"), F.lit("pacemap_score")), F.array(m(F.when(key % 2 == 0, F.col("o_totalprice"))), m(F.lit(2.0)), m(F.when(key % 4 == 0, F.lit(-35.0))))), lambda k, v: v["value"].isNotNull())
    notes = F.map_filter(F.map_from_arrays(F.array(F.lit("reference"), F.lit("map"), F.lit("woi_from")), F.array(F.when(key % 3 != 0, "2000"), F.lit("2010"), F.lit("-50"))), lambda k, v: v.isNotNull())
    place = F.map_from_arrays(F.array(F.lit("ROVING"), F.lit("CS")), F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))))
    return link.electric_table(o.select(F.col("o_custkey").alias("map_id"), key.alias("point_index"), measured.alias("measurements"), notes.alias("annotations"), place.alias("electrodes"), F.when(key % 5 != 0, 1000.0).alias("sample_rate")))


@query("w8_ordered", "SELECT c_nationkey, c_name, c_custkey FROM customer ORDER BY ALL")
def w8(spark, d):
    return report.ordered(st.table(spark, d, "customer").select("c_nationkey", "c_name", "c_custkey"), ["c_nationkey", "c_name"])


@query("s16_signal_store", f"""WITH {SIGNALS} SELECT data_uri, channel, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE channel IN ('click', 'view') AND t BETWEEN 1000
AND 1500000 GROUP BY ALL""")
def s16(spark, d):
    """Every sample twice, as a rescan brings them, written once and read back by channel and time."""
    from atriaflow.sources import signals

    s = st.samples(spark, d)
    path = st.scratch(spark, "signals")
    signals.write_samples(s.unionByName(s), path)
    return signals.read_samples(spark, path, ["click", "view"], (1000.0, 1500000.0)).groupBy("data_uri", "channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
