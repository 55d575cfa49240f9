"""Readers of study exports: volumes, catalogues, points, forces, point clouds, signals; study trees and raw exports.

Readers take files(file, value) with the whole text of a file, as `exports.whole_files` gives them.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.functions.columns import finite
from atriaflow.functions.vocab import dxl_quantity
from atriaflow.sources.lines import before, behind, comma_cells, file_lines, filled, first_index, first_of, last_index, strict


def base_name(file: str | Column) -> Column:
    return F.element_at(F.split(file, r"[/\\]"), -1)


def numbers(text: str | Column) -> Column:
    """The numbers of a text, apart by white space; null for a null text."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def cell(cells: Column, header: Column, name: str | Column) -> Column:
    """The trimmed cell under a header's first column of this name; null without the column or the cell, or if empty."""
    at = F.array_position(header, F.lit(name) if isinstance(name, str) else name).cast("int")
    value = F.trim(F.get(cells, at - 1))
    return F.when((at > 0) & (value != ""), value)


# ---- volumes ---------------------------------------------------------------------------------------------

_VOLUME = "`_name` STRING, Vertices STRING, Polygons STRING, Normals STRING, Map_data STRING, Map_status STRING, Color_high_low STRING, Rotation STRING, Scaling STRING, Translation STRING, Labels STRUCT<Label: ARRAY<STRING>>"


def volume_names(files: DataFrame) -> DataFrame:
    """File, volume and name of each volume, without decoding it."""
    opened = F.regexp_extract_all("value", F.lit(r"<Volume\b([^>]*)>"), F.lit(1))
    each = files.select("file", F.posexplode(opened).alias("volume", "attributes"))
    return each.select("file", "volume", F.trim(F.regexp_extract("attributes", r'\bname="([^"]*)"', 1)).alias("name")).filter("name <> ''")


def read_dif(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Volumes, vertices (with normal, value, valid) and triangles (0-based) of volume texts; volumes without vertices or polygons are left out.

    A value is valid where the status is 0; without a status, valid is null.
    """
    each = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Volume[\s>].*?</Volume>"), F.lit(0))).alias("volume", "xml"))
    v = each.select("file", "volume", F.from_xml("xml", _VOLUME).alias("v")).select("file", "volume", "v.*").filter("Vertices IS NOT NULL AND Polygons IS NOT NULL")
    labels = F.filter(F.transform(F.coalesce("Labels.Label", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    volumes = v.select("file", "volume", F.coalesce("_name", F.lit("")).alias("name"), labels.alias("labels"), *[numbers(c).alias(c.lower()) for c in ("Rotation", "Scaling", "Translation", "Color_high_low")])
    wide = v.select("file", "volume", *[numbers(c).alias(c) for c in ("Vertices", "Polygons", "Normals", "Map_data", "Map_status")])

    def at(c: str, k: int) -> Column:
        return F.get(c, F.col("i") * 3 + k)

    def thirds(c: str) -> Column:
        n = F.floor(F.size(c) / 3).cast("int")
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))

    vertices = wide.select("*", thirds("Vertices").alias("i"))
    vertices = vertices.select(
        "file", "volume", F.col("i").alias("vertex_id"), *[at("Vertices", k).alias(c) for k, c in enumerate("xyz")],
        *[at("Normals", k).alias(f"n{c}") for k, c in enumerate("xyz")], F.get("Map_data", F.col("i")).alias("value"), (F.get("Map_status", F.col("i")) == 0).alias("valid"),
    )
    triangles = wide.select("*", thirds("Polygons").alias("i")).select("file", "volume", F.col("i").alias("tri_id"), *[(at("Polygons", k) - 1).cast("int").alias(f"v{k}") for k in range(3)])
    return volumes, vertices, triangles


# ---- catalogue and points --------------------------------------------------------------------------------

_CATALOGUE = (
    "`_name` STRING, Maps STRUCT<TagsTable: STRUCT<Tag: ARRAY<STRUCT<`_ID`: STRING, `_Full_Name`: STRING, `_Short_Name`: STRING>>>,"
    " Map: ARRAY<STRUCT<`_Name`: STRING, `_FileNames`: STRING, CartoPoints: STRUCT<`_Count`: STRING, Point: ARRAY<STRUCT<`_Position3D`: STRING, Tags: STRING>>>>>>"
)


def read_catalogue(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: maps (file, study_name, map_name, mesh_file, number_of_points) and their points (position, names of tags) of catalogue texts.

    A tag has its full name, else its short one; an id that the table does not define stays a number, other words in a list of tags go.
    """
    root = files.filter(F.col("value").contains("<Study")).select("file", F.from_xml("value", _CATALOGUE).alias("s"))
    table = F.transform(F.coalesce("s.Maps.TagsTable.Tag", F.array()), lambda t: F.named_struct(F.lit("id"), t["_ID"].try_cast("int"), F.lit("name"), F.coalesce(F.nullif(t["_Full_Name"], F.lit("")), F.nullif(t["_Short_Name"], F.lit("")), t["_ID"])))
    maps = root.select("file", F.col("s._name").alias("study_name"), table.alias("table"), F.explode("s.Maps.Map").alias("m"))
    points = maps.select("file", F.col("m._Name").alias("map_name"), "table", F.posexplode("m.CartoPoints.Point").alias("point_index", "p"))
    place = numbers("p._Position3D")
    ids = F.filter(F.transform(F.split(F.coalesce("p.Tags", F.lit("")), r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    named = F.transform(ids, lambda i: F.coalesce(F.get(F.filter("table", lambda t: t["id"] == i), F.lit(0))["name"], i.cast("string")))
    return (
        maps.select("file", "study_name", F.col("m._Name").alias("map_name"), F.col("m._FileNames").alias("mesh_file"), F.col("m.CartoPoints._Count").try_cast("int").alias("number_of_points")),
        points.select("file", "map_name", "point_index", *[F.get(place, F.lit(k)).alias(c) for k, c in enumerate("xyz")], named.alias("tags")),
    )


#: Connectors in the order in which they are looked for, and what they hold.
CONNECTORS = [("CS_CONNECTOR", "CS"), ("MAGNETIC_20_POLE_A_CONNECTOR", "20A"), ("MEC_CONNECTOR", "ROVING"), ("NAVISTAR_CONNECTOR", "ROVING"), ("DX_CONNECTOR", "DX")]
_POINT = (
    "Annotations STRUCT<`_StartTime`: STRING, `_Reference_Annotation`: STRING, `_Map_Annotation`: STRING>, WOI STRUCT<`_From`: STRING, `_To`: STRING>,"
    " Voltages STRUCT<`_Unipolar`: STRING, `_Bipolar`: STRING>"
)


def read_electrodes(files: DataFrame) -> DataFrame:
    """Base, coordinates (x, y, z of each electrode one after another) of electrode position texts; two header lines, then rows of five cells or more."""
    rows = file_lines(files).select("file", F.posexplode(F.slice("lines", F.lit(3), F.size("lines"))).alias("line_no", "line")).withColumn("c", F.split(F.trim("line"), "\t")).filter(F.size("c") >= 5)
    xyz = F.array(*[F.get("c", F.lit(k)).cast("double") for k in (2, 3, 4)])
    both = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", xyz.alias("xyz")))).alias("rows"))
    return both.select(base_name("file").alias("base"), F.flatten(F.transform("rows", lambda r: r["xyz"])).alias("coordinates"))


def read_points(lists: DataFrame, details: DataFrame, electrodes: DataFrame) -> DataFrame:
    """One row per point of the lists: annotations, window of interest, voltages, electrodes by class of connector, connectors.

    lists(file, value) are the ``<map>_Points_Export.xml`` texts, details the point texts that they name, electrodes(base, coordinates).
    Positions that a point declares win over files that only their name gives to it; a point without a text keeps a row of nulls.
    """
    listed = lists.select(F.regexp_replace(base_name("file"), r"_Points_Export\.xml$", "").alias("map_name"), F.posexplode(F.from_xml("value", "Point ARRAY<STRUCT<`_ID`: BIGINT, `_File_Name`: STRING>>").getField("Point")).alias("point_index", "p"))
    listed = listed.select("map_name", "point_index", F.col("p._ID").alias("source_id"), F.col("p._File_Name").alias("base"))
    told = details.select(base_name("file").alias("base"), "value", F.from_xml("value", _POINT).alias("d"))
    number = lambda c: F.col(c).try_cast("double")
    start = F.when(F.col("d.Annotations").isNotNull(), F.coalesce(F.col("d.Annotations._StartTime").try_cast("long"), F.lit(0)))
    points = listed.join(told, "base", "left").select(
        "map_name", "point_index", "source_id", start.alias("start_time"), number("d.Annotations._Reference_Annotation").alias("reference_annotation"), number("d.Annotations._Map_Annotation").alias("map_annotation"),
        number("d.WOI._From").alias("woi_from"), number("d.WOI._To").alias("woi_to"), number("d.Voltages._Unipolar").alias("unipolar_voltage"), number("d.Voltages._Bipolar").alias("bipolar_voltage"), "value",
    )
    pair = r'(\w+)="([^"]*Eleclectrode_Positions[^"]*OnAnnotation[^"]*)"'
    names, bases = (F.regexp_extract_all("value", F.lit(pair), F.lit(k)) for k in (1, 2))
    declared = points.select("map_name", "point_index", F.posexplode(F.arrays_zip(names.alias("connector"), bases.alias("base"))).alias("nth", "x")).select("map_name", "point_index", "nth", "x.connector", base_name("x.base").alias("base")).filter("base NOT LIKE '%Sensor\\_Positions%'")
    kind = F.lit("OTHER")
    for connector, name in reversed(CONNECTORS):
        kind = F.when(F.upper("connector").contains(connector), name).otherwise(kind)
    by_name = points.filter("start_time IS NOT NULL").select("map_name", "point_index", "start_time", F.posexplode(F.array(*[F.lit(c) for c, _ in CONNECTORS[:4]])).alias("nth", "connector"))
    by_name = by_name.withColumn("base", F.concat_ws("_", "map_name", "connector", F.lit("Eleclectrode_Positions_OnAnnotation"), F.concat(F.col("start_time").cast("string"), F.lit(".txt")))).drop("start_time")
    both = declared.withColumn("rank", 1000 - F.col("nth")).unionByName(by_name.withColumn("rank", 10_000 + F.col("nth"))).withColumn("kind", kind)
    found = both.join(electrodes, "base").groupBy("map_name", "point_index", "kind").agg(F.min(F.struct("rank", "coordinates", "connector")).alias("b"))
    placed = found.groupBy("map_name", "point_index").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.col("b.coordinates").alias("c"))))).alias("electrodes"),
        F.array_sort(F.collect_set(F.when(F.col("b.rank") >= 10_000, F.col("b.connector")))).alias("by_name"),
    )
    own = declared.groupBy("map_name", "point_index").agg(F.array_sort(F.collect_set("connector")).alias("declared"))
    none = F.array().cast("array<string>")
    out = points.drop("value").join(placed, ["map_name", "point_index"], "left").join(own, ["map_name", "point_index"], "left")
    return out.withColumn("connectors", F.array_union(F.coalesce("declared", none), F.coalesce("by_name", none))).drop("declared", "by_name")


def backfill_positions(points: DataFrame, catalogue: DataFrame) -> DataFrame:
    """points(map_name, point_index, x, y, z) with the catalogue's position where they have none, and its tags; points without any position go."""
    known = catalogue.select("map_name", "point_index", *[F.col(c).alias(f"c{c}") for c in "xyz"], "tags")
    met = points.join(known, ["map_name", "point_index"], "left")
    placed = F.col("x").isNotNull()
    return met.withColumns({c: F.when(placed, F.col(c)).otherwise(F.col(f"c{c}")) for c in "xyz"}).drop("cx", "cy", "cz").filter("x IS NOT NULL")


# ---- signals ---------------------------------------------------------------------------------------------


def read_force(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (file, sample_rate, instantaneous values) and samples (g, deg, deg) of contact-force texts; t is in ms.

    The rate is 1000 / median step, if every step is positive; the instantaneous values stand in the line after the last ``IntervalNonGraph``.
    A text without the header or its columns, and rows that are not all numbers, are errors.
    """
    own = file_lines(files).withColumn("at", first_index("lines", lambda x: F.lower(F.trim(x)).startswith("index\t")))
    own = own.withColumn("at", strict(F.col("at"), F.col("at").isNotNull(), "no force columns"))
    own = own.select("file", F.transform(F.split(F.trim(F.get("lines", F.col("at"))), r"\s+"), F.lower).alias("names"), before("lines", F.col("at")).alias("top"), F.transform(filled(behind("lines", F.col("at"))), numbers).alias("rows"))
    named = reduce(lambda a, b: a & b, [F.array_contains("names", c) for c in ("time", "forcevalue", "axialangle", "lateralangle")])
    fits = F.forall("rows", lambda v: (F.size(v) == F.size("names")) & F.forall(v, lambda x: x.isNotNull()))
    own = own.withColumn("rows", strict(F.col("rows"), named & fits & (F.size("rows") > 0), "malformed force rows"))
    value = lambda v, name: F.get(v, (F.array_position("names", name) - 1).cast("int"))
    times = F.transform("rows", lambda v: value(v, "time"))
    own = own.withColumn("t", times).withColumn("steps", F.array_sort(F.zip_with(F.slice("t", F.lit(2), F.size("t")), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda b, a: b - a)))
    n = F.size("steps")
    median = (F.get("steps", F.floor((n - 1) / 2).cast("int")) + F.get("steps", F.floor(n / 2).cast("int"))) / 2
    told = last_index("top", lambda x: x.startswith("IntervalNonGraph"))
    told = numbers(F.get("top", told + 1))
    told = F.when(F.size(told) >= 4, told)
    windows = own.select("file", F.when(F.get("steps", F.lit(0)) > 0, 1000 / median).alias("sample_rate"), *[F.get(told, F.lit(k)).alias(c) for k, c in enumerate(("force", "axial_angle", "lateral_angle"), 1)])
    rows = own.select("file", "names", F.posexplode("rows").alias("sample_idx", "v"))
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), value(F.col("v"), c.lower()).alias("value"), F.lit(u).alias("unit")) for c, u in (("ForceValue", "g"), ("AxialAngle", "deg"), ("LateralAngle", "deg"))])
    samples = rows.select("file", "sample_idx", value(F.col("v"), "time").alias("t"), F.explode(channels).alias("c")).select("file", "sample_idx", "t", "c.*")
    return windows, samples


#: Phase of respiration, its code.
RESPIRATION = {"UNKNOWN": 0.0, "EXPIRATION": 1.0, "INSPIRATION": 2.0}


def read_point_cloud(files: DataFrame) -> DataFrame:
    """Positions in both frames, seconds from the first position, and the code of the respiration phase (another text is null)."""
    own = file_lines(files).withColumn("at", first_index("lines", lambda x: x.startswith("Time,"))).filter("at IS NOT NULL")
    cells = F.transform(F.filter(behind("lines", F.col("at")), lambda x: ~x.rlike(r"^\s*(EOF.*)?$")), lambda x: F.split(x, ","))
    own = own.select("file", F.transform(F.split(F.get("lines", F.col("at")), ","), lambda x: F.trim(x)).alias("h"), cells.alias("rows"))

    def day(c: Column) -> Column:
        clock = F.split(cell(c, F.col("h"), "Time"), ":")
        return F.get(clock, F.lit(0)).try_cast("double") * 3600 + F.get(clock, F.lit(1)).try_cast("double") * 60 + F.get(clock, F.lit(2)).try_cast("double")

    rows = own.withColumn("first", F.array_min(F.transform("rows", day))).select("file", "h", "first", F.posexplode("rows").alias("sample_idx", "c"))
    phases = F.create_map(*[F.lit(x) for kv in RESPIRATION.items() for x in kv])
    axes = [cell(F.col("c"), F.col("h"), f"{frame}_{a}").try_cast("double").alias(f"{frame}_{a}") for frame in ("trn", "raw") for a in "xyz"]
    return rows.select("file", "sample_idx", (day(F.col("c")) - F.col("first")).alias("t"), *axes, F.try_element_at(phases, F.upper(cell(F.col("c"), F.col("h"), "respiration_phase"))).alias("respiration"))


def _items(*items: tuple[Column | str, Column]) -> Column:
    return F.array(*[F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.alias("v")) for k, v in items])


def _mapped(items: str | Column) -> Column:
    """A map of the items (key, value) whose value is there."""
    return F.map_from_entries(F.filter(items, lambda e: e["v"].isNotNull()))


def _entries(*items: tuple[Column | str, Column]) -> Column:
    return _mapped(_items(*items))


def _measured(value: Column, kind: Column | str, unit: str, there: Column | None = None) -> Column:
    there = value.isNotNull() if there is None else there & value.isNotNull()
    return F.when(there, F.struct(value.alias("value"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(unit).alias("unit")))


#: Columns of a point export that are read by name, beside the value column and its valid flag.
_DXL_TEXTS = ["(Point #)", "Freeze Grp #", "Rov trace", "Ref trace", "Ref2 trace", "Electrodes"]
_DXL_NUMBERS = [*[f"{of} {a}" for of in ("surface", "roving") for a in "xyz"], "adjTime (ms)", "force (g)", "refTime (abs)", "Ref Tick", "left curtain (ms)", "right curtain (ms)"]


def read_dxl_points(files: DataFrame) -> DataFrame:
    """Points of point exports: the value column is the one with a ``<name> valid`` sibling and counts where that is set.

    ``Data starts in row,N`` names the header's row, ``Map type:`` the quantity. Values of 9000 and more in ms columns, negative forces and rows without a surface
    position count as missing; other columns are annotations. What the header says (places of columns, quantity) is found once a file; then the cells, the numbers
    and the maps of a row are three steps, each of which reads what the one before it has made.
    """
    top = F.slice("lines", 1, 80)
    told = lambda key: F.trim(F.regexp_extract(first_of(top, lambda x: F.lower(x).startswith(key)), r"^[^,]*,\s*([^,]*)", 1))
    own = file_lines(files).withColumn("first_row", told("data starts in row").try_cast("int")).withColumn("map_type", F.coalesce(told("map type:"), F.lit("")))
    own = own.withColumn("first_row", strict(F.col("first_row"), F.col("first_row").isNotNull(), "no row of data named"))
    own = own.select("file", "first_row", "map_type", F.get("lines", F.col("first_row") - 1).alias("header"), F.slice("lines", F.col("first_row") + 1, F.size("lines")).alias("body"))
    own = own.withColumn("h", F.transform(F.split("header", ","), lambda x: F.trim(x)))
    named = F.get(F.filter("h", lambda x: F.array_contains("h", F.concat(x, F.lit(" valid")))), F.lit(0))
    own = own.withColumn("value_column", F.coalesce(named, F.lit("P-P")))
    kind, name = dxl_quantity(F.col("map_type"), F.col("value_column"))
    column = {c: f"c{i}" for i, c in enumerate([*_DXL_TEXTS, *_DXL_NUMBERS])}
    place = lambda c: F.nullif(F.array_position("h", F.lit(c) if isinstance(c, str) else c), F.lit(0)).cast("int") - 1
    places = {**{column[c]: place(c) for c in column}, "value": place(F.col("value_column")), "valid": place(F.concat("value_column", F.lit(" valid")))}
    own = own.select("file", "body", name.alias("name"), kind.alias("kind"), F.regexp_extract("file", r"^(.*)[/\\]", 1).alias("folder"), *[at.alias(f"at_{c}") for c, at in places.items()])

    rows = own.select(*[c for c in own.columns if c != "body"], F.posexplode("body").alias("point_index", "line")).filter(F.trim("line") != "")
    kept = ["file", "point_index", "name", "kind", "folder"]
    rows = rows.select(*kept, *[f"at_{c}" for c in places], F.split("line", ",").alias("c"))
    cells = rows.select(*kept, F.col("at_valid").isNull().alias("all_valid"), *[F.trim(F.get("c", F.col(f"at_{c}"))).alias(c) for c in places])
    numeric = {*[column[c] for c in _DXL_NUMBERS], "value"}
    there = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    cells = cells.select(*kept, (F.col("all_valid") | F.coalesce(F.col("valid").isin("1", "1.0"), F.lit(False))).alias("valid"), *[F.col(c).try_cast("double").alias(c) if c in numeric else there(c) for c in places if c != "valid"])
    cells = cells.select(*kept, "valid", *[finite(F.col(c)).alias(c) if c in numeric else F.col(c) for c in places if c != "valid"])

    of = lambda c: F.col(column[c])
    ms = lambda c: F.when(F.abs(of(c)) < 9000, of(c))
    at, tick = F.when(of("refTime (abs)") > 0, of("refTime (abs)")), F.when(of("Ref Tick") >= 0, of("Ref Tick"))
    measured = _items(
        (F.col("name"), _measured(F.col("value"), F.col("kind"), "", F.col("valid"))),
        ("annotation_time", _measured(ms("adjTime (ms)"), "activation_time", "ms")),
        ("contact_force", _measured(of("force (g)"), "contact_force", "g", of("force (g)") >= 0)),
    )
    annotations = _items(
        ("reference_adjustment_ms", ms("adjTime (ms)").cast("string")), ("start_time", at.cast("string")), ("reference_time", at.cast("string")),
        ("woi_from", ms("left curtain (ms)").cast("string")), ("woi_to", ms("right curtain (ms)").cast("string")),
        ("freeze_group", of("Freeze Grp #")), ("bipolar_channel", of("Rov trace")), ("reference_channel", of("Ref trace")), ("reference_2_channel", of("Ref2 trace")),
        ("reference_sample_zero_based", tick.cast("string")), ("source_folder", F.col("folder")),
    )
    roving = [of(f"roving {a}") for a in "xyz"]
    electrodes = _items((F.coalesce(of("Electrodes"), F.lit("rov")), F.when(reduce(lambda a, b: a & b, [r.isNotNull() for r in roving]), F.array(*roving))))
    made = F.struct(of("(Point #)").alias("source_id"), *[of(f"surface {a}").alias(a) for a in "xyz"], measured.alias("measurements"), electrodes.alias("electrodes"), annotations.alias("annotations"))
    # as a generator's row: a filter does not go below it, where it would split and read the line again for each of its terms
    out = cells.select("file", "point_index", F.inline(F.array(made))).dropna(subset=["x", "y", "z"])
    return out.select("file", "point_index", "source_id", "x", "y", "z", *[_mapped(c).alias(c) for c in ("measurements", "electrodes", "annotations")])


def read_map_names(files: DataFrame) -> DataFrame:
    """The operator's name of a point export's map (file, map_name): what follows the last tab of ``Map name:``, among the lines above the data; null without one."""
    own = file_lines(files)
    start = F.regexp_extract(first_of(F.slice("lines", 1, 80), lambda x: F.lower(x).startswith("data starts in row") & x.contains(",")), r"^[^,]*,\s*(\d+)\s*(?:,.*)?$", 1).try_cast("int")
    line = first_of(before("lines", F.least(F.coalesce(start, F.size("lines")), F.lit(200))), lambda x: F.lower(x).startswith("map name:"))
    return own.select("file", F.nullif(F.trim(F.element_at(F.split(F.trim(F.regexp_extract(line, r"^[^,]*,(.*)$", 1)), "\t"), -1)), F.lit("")).alias("map_name"))


#: Column of an archive's point table, quantity.
ARCHIVE_COLUMNS = {"pp": "voltage_bipolar", "unipoleMaxPP": "voltage_unipolar", "correctedLAT": "activation_time", "correlationCoefficient": "correlation", "snr": "snr"}


def read_archive_points(files: DataFrame) -> DataFrame:
    """Points of an archive's point table: up to five measurements, a force that is not negative, and electrodes A, B and C."""
    own = file_lines(files).select("file", F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda x: F.trim(x)).alias("h"), behind("lines", F.lit(0)).alias("body"))
    rows = own.select("file", "h", F.posexplode("body").alias("point_index", "line")).filter("trim(line) <> ''").withColumn("c", F.split("line", ","))
    number = lambda name: finite(cell(F.col("c"), F.col("h"), name).try_cast("double"))
    measured = [(kind, _measured(number(c), kind, "")) for c, kind in ARCHIVE_COLUMNS.items()]
    measured.append(("contact_force", _measured(number("force"), "contact_force", "g", number("force") >= 0)))
    places = [(x, F.when(F.array_contains("h", f"locCh{x}_x"), F.array(*[number(f"locCh{x}_{a}") for a in "xyz"]))) for x in "ABC"]
    return rows.select("file", "point_index", *[number(a).alias(a) for a in "xyz"], _entries(*measured).alias("measurements"), _entries(*places).alias("electrodes"))


#: Stem of a signal file, role of its rows; stems that begin with wave_ecg are ecg.
WAVE_ROLES = {"wave_rov": "bipolar", "wave_uni_distal": "unipolar_1", "wave_uni_proximal": "unipolar_2", "wave_refs": "reference", "wave_ref": "reference", "wave_refs2": "reference_2"}


def read_dxl_waveforms(files: DataFrame) -> DataFrame:
    """Samples of row-wise signal texts, one window a row: file, row_no, role, channel, point_id, freeze_group, start_time, map_sample, sample_rate, sample_idx, t, value.

    A declared number of samples of 0 means an empty file. Errors: a rate that is missing or not positive, sample columns that are not 0, 1, 2 and so on or not as many as
    declared, rows that end early, a start time or a sample that is no number (empty samples are missing). Rows of references name no point. map_sample is the
    roving time in samples, if it lies within the row. Cells may be quoted.
    """
    own = file_lines(files).select("file", F.transform("lines", comma_cells).alias("rows"))
    key = lambda c: F.lower(F.get(c, F.lit(0)))
    told = lambda name: F.get(F.element_at(F.filter("rows", lambda c: (key(c) == name) & (F.size(c) > 1)), -1), F.lit(1))
    said = lambda name: F.when(F.exists("rows", lambda c: (key(c) == name) & (F.size(c) > 1)), told(name))
    own = own.withColumns({"rate": said("sample rate:").try_cast("double"), "declared": said("waveform samples exported:").try_cast("int"), "at": first_index("rows", lambda c: F.get(c, F.lit(0)) == "Trace")})
    own = own.filter("declared IS NULL OR declared > 0").withColumn("header", F.get("rows", F.col("at"))).withColumn("body", behind("rows", F.col("at")))
    own = own.withColumn("first", F.array_position("header", "0").cast("int"))
    columns = F.slice("header", F.greatest("first", F.lit(1)), F.size("header"))
    columns = F.when(F.element_at(columns, -1) == "", F.slice(columns, F.lit(1), F.size(columns) - 1)).otherwise(columns)
    own = own.withColumn("columns", columns).withColumn("n", F.size("columns"))
    counted = F.transform(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1), lambda i: i.cast("string")) == F.col("columns")
    # files that declare no samples are no errors, whichever of the conditions Spark looks at first
    none = F.coalesce(F.col("declared") <= 0, F.lit(False))
    own = own.withColumn("body", strict(F.col("body"), none | F.coalesce((F.col("rate") > 0) & (F.col("rate") < float("inf")), F.lit(False)), "no valid sample rate"))
    own = own.withColumn("body", strict(F.col("body"), none | F.coalesce(F.col("at").isNotNull() & (F.col("first") > 0) & counted, F.lit(False)), "no sample columns from 0 on"))
    own = own.withColumn("body", strict(F.col("body"), none | F.coalesce(F.col("declared") == F.col("n"), F.lit(True)), "another number of samples than declared"))
    ended = F.coalesce(first_index("body", lambda c: F.get(c, F.lit(0)) == "EOF"), F.size("body"))
    stem = F.lower(F.regexp_replace(base_name("file"), r"\.[^.]*$", ""))
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WAVE_ROLES.items() for x in kv]), stem), F.when(stem.startswith("wave_ecg"), "ecg"), F.lit("unknown"))
    own = own.select("file", role.alias("role"), "rate", "header", "first", "n", before("body", ended).alias("body"))
    # outer, so that no filter on the array is pushed down and makes all that leads to it once more
    rows = own.select("file", "role", "rate", "header", "first", "n", F.posexplode_outer("body").alias("row", "c")).filter(F.exists("c", lambda x: x != ""))
    rows = rows.withColumn("c", strict(F.col("c"), F.size("c") >= F.col("first") - 1 + F.col("n"), "a signal row ends early"))
    text = lambda name: cell(F.col("c"), F.col("header"), name)
    start = text("startTime (abs)").try_cast("double")
    samples = F.slice("c", F.col("first"), F.col("n"))
    right = start.isNotNull() & F.forall(samples, lambda x: (x == "") | x.try_cast("double").isNotNull())
    tick = text("rovTime (wave samples)").try_cast("double")
    rows = rows.select(
        "file", (F.col("row") + 1).alias("row_no"), "role", text("Trace").alias("channel"), F.when(~F.col("role").startswith("reference"), text("(Point #)")).alias("point_id"), text("Freeze Grp #").alias("freeze_group"),
        start.alias("start_time"), F.when((tick >= 0) & (tick < F.col("n")), tick).alias("map_sample"), F.col("rate").alias("sample_rate"), strict(samples, right, "a start time or sample that is no number").alias("samples"),
    )
    rows = rows.select(*[c for c in rows.columns if c != "samples"], F.posexplode_outer("samples").alias("sample_idx", "s"))
    return rows.select("*", (F.col("sample_idx") / F.col("sample_rate")).alias("t"), F.col("s").try_cast("double").alias("value")).drop("s")


# ---- study trees and raw exports -------------------------------------------------------------------------


def study_tree(maps: DataFrame, points: DataFrame, placed: DataFrame) -> dict[str, DataFrame]:
    """The tables of a study tree with surrogate keys: hashes of the natural keys, so that a repeated import gives the same.

    maps(study_name, vendor, map_name), points(study_name, map_name, point_index, ...), placed(study_name, type, placed_no, ...).
    """
    study, own = F.xxhash64("study_name"), F.xxhash64("study_name", "map_name")
    return {
        "studies": maps.groupBy("study_name").agg(F.min("vendor").alias("vendor")).select(study.alias("study_id"), F.col("study_name").alias("name"), "vendor"),
        "maps": maps.select(study.alias("study_id"), own.alias("map_id"), "map_name").distinct(),
        "attributes": maps.select(study.alias("study_id"), own.alias("map_id"), F.lit("{}").alias("attributes")).distinct(),
        "points": points.withColumns({"study_id": study, "map_id": own, "point_id": F.xxhash64("study_name", "map_name", "point_index")}).drop("study_name", "map_name"),
        "placed_points": placed.withColumns({"study_id": study, "placed_id": F.xxhash64("study_name", "type", "placed_no")}).drop("study_name"),
    }


def persist_study(tree: dict[str, DataFrame], path: str, replace: bool = False) -> None:
    """Append the studies that are not there yet to one table each below path; with `replace`, studies that are there give way."""
    spark = next(iter(tree.values())).sparkSession
    try:
        there = spark.read.parquet(f"{path}/studies").select("study_id").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = None
    # the list of studies comes last: an import that was broken off is taken up again
    for name in [*(n for n in tree if n != "studies"), "studies"]:
        new = tree[name] if there is None or replace else tree[name].join(there, "study_id", "left_anti")
        new.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic").partitionBy("study_id").parquet(f"{path}/{name}")


COMPONENTS = ("mesh", "fields", "points", "markers", "waveforms")


def raw_components(include: Iterable[str] | str | None) -> set[str]:
    """The parts of an export: all without a choice, none for an empty one; other names are an error."""
    if include is None:
        return set(COMPONENTS)
    chosen = {x.strip() for x in (include.split(",") if isinstance(include, str) else include) if x.strip()}
    if chosen - set(COMPONENTS):
        raise ValueError("unknown components: " + ", ".join(sorted(chosen - set(COMPONENTS))))
    return chosen


def export_raw(maps: DataFrame, vertices: DataFrame, triangles: DataFrame, scalars: DataFrame, points: DataFrame, placed: DataFrame, waveforms: DataFrame, include: Iterable[str] | str | None = None) -> DataFrame:
    """map_id and the JSON document of each map, with the chosen parts; numbers that are not finite are null.

    Windows are those of the map and those of its study that name no map.
    """
    chosen = raw_components(include)

    def listed(df: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
        kinds = dict(df.dtypes)
        row = F.struct(*order, *[(finite(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in fields if c not in order])
        return df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias(name))

    out = maps.select("map_id", "study_id", "map_name")
    parts: list[str] = []
    wanted = [
        ("mesh", vertices, "map_id", ["vertex_id"], ["x", "y", "z"], "vertices"),
        ("mesh", triangles, "map_id", ["tri_id"], ["v0", "v1", "v2"], "faces"),
        ("fields", scalars, "map_id", ["name", "vertex_id"], ["value"], "scalar_fields"),
        ("points", points, "map_id", ["point_index"], ["x", "y", "z"], "points"),
        ("markers", placed, "study_id", ["placed_id"], ["type", "x", "y", "z"], "placed_points"),
    ]
    for part, df, key, order, fields, name in wanted:
        if part in chosen:
            out = out.join(listed(df, key, order, fields, name), key, "left")
            parts.append(name)
    if "waveforms" in chosen:
        own = waveforms.filter("map_id IS NOT NULL").select("map_id", "waveform_id", "data_uri")
        loose = maps.select("map_id", "study_id").join(waveforms.filter("map_id IS NULL").drop("map_id"), "study_id").select("map_id", "waveform_id", "data_uri")
        out = out.join(listed(own.unionByName(loose), "map_id", ["waveform_id"], ["data_uri"], "waveforms"), "map_id", "left")
        parts.append("waveforms")
    head = F.struct(F.col("map_id").alias("id"), "study_id", F.col("map_name").alias("name"))
    included = F.array(*[F.lit(c) for c in COMPONENTS if c in chosen]).cast("array<string>")
    document = F.struct(F.lit("1.0").alias("schema_version"), F.lit("raw").alias("representation"), F.lit(0).alias("index_base"), included.alias("included"), head.alias("map"), *parts)
    return out.select("map_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
