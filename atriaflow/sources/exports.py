"""Readers of vendor exports: meshes, signal windows, matrix CSV, placed points, manifests.

A file is one row until its rows are exploded: what stands where is looked up in the array of its lines (`lines`), and nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atriaflow.sources.lines import before, behind, comma_cells, file_lines, filled, first_index, section, strict, whole_files  # noqa: F401


def _cells(c: Column) -> Column:
    return F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.try_cast("double"))


#: Fixed value: what the first line of a mesh text holds.
MESH_VERSION = "#TriangulatedMeshVersion2.0"


def _section_rows(files: DataFrame, name: str) -> DataFrame:
    """file, id, v of the rows ``id = numbers`` of a section of mesh texts, and the names of its last comment line."""
    own = file_lines(files).withColumn("lines", strict(F.col("lines"), F.get("lines", F.lit(0)).contains(MESH_VERSION), f"no {MESH_VERSION}"))
    own = own.select("file", section("lines", name).alias("body"))
    comment = F.element_at(F.filter("body", lambda x: x.rlike(r"^\s*;")), -1)
    names = F.when(F.exists("body", lambda x: x.rlike(r"^\s*;")), F.split(F.trim(F.regexp_replace(comment, r"^\s*;\s*", "")), r"\s+"))
    # what is the same for all rows of a file comes before the explode, else it would be made again for each of them
    own = own.select("file", names.alias("names"), "body")
    rows = own.select("file", "names", F.explode(F.filter("body", lambda x: x.rlike(r"^\s*\d+\s*="))).alias("line"))
    return rows.select("file", "names", F.regexp_extract("line", r"^\s*(\d+)\s*=", 1).cast("int").alias("id"), _cells(F.regexp_replace("line", r"^\s*\d+\s*=", "")).alias("v"))


def _named_values(rows: DataFrame, stem: str, column: str) -> DataFrame:
    """A row per value: file, vertex_id, its column's name (``<stem>_<n>`` if the names are not as many as the values), position, value."""
    each = rows.select("file", F.col("id").alias("vertex_id"), "names", F.size("v").alias("n"), F.posexplode("v").alias("position", "value"))
    name = F.when(F.size("names") == F.col("n"), F.get("names", F.col("position"))).otherwise(F.concat(F.lit(f"{stem}_"), F.col("position").cast("string")))
    return each.select("file", "vertex_id", name.alias(column), "position", "value")


def read_mesh(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, triangles and named colour columns of triangulated mesh texts.

    A section starts at ``[Name]`` (case ignored); its last comment line names the columns, or ``color_<n>`` do. Rows are ``id = numbers``.
    -10000 in a colour is missing; triangles of negative groups (the seventh number) are left out. A text of another version is an error.
    """
    at = lambda i: F.get("v", F.lit(i))
    vertices = _section_rows(files, "VerticesSection").select("file", F.col("id").alias("vertex_id"), *[at(i).alias(c) for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))])
    triangles = _section_rows(files, "TrianglesSection").filter(F.coalesce(at(6), F.lit(0.0)) >= 0).select("file", F.col("id").alias("tri_id"), *[at(i).cast("int").alias(f"v{i}") for i in range(3)])
    colours = _named_values(_section_rows(files, "VerticesColorsSection"), "color", "column")
    return vertices, triangles, colours.withColumn("value", F.when(F.col("value") != -10000, F.col("value")))


def read_mesh_flags(files: DataFrame) -> DataFrame:
    """The flags of the attributes section that are set (above 0): file, vertex_id, flag; the section's last comment names them, or ``flag_<n>`` do."""
    return _named_values(_section_rows(files, "VerticesAttributesSection"), "flag", "flag").filter("value > 0").select("file", "vertex_id", "flag")


def read_ecg_windows(files: DataFrame) -> DataFrame:
    """Samples in mV of window texts: version, gain, channel names, then integer rows; a short last row is dropped, another is an error."""
    own = file_lines(files)
    gain = F.regexp_extract(F.get("lines", F.lit(1)), r"([0-9.eE+-]+)\s*$", 1).try_cast("double")
    own = own.select("file", gain.alias("gain"), F.split(F.trim(F.get("lines", F.lit(2))), r"\s+").alias("names"), F.transform(filled(behind("lines", F.lit(2))), _cells).alias("rows"))
    fits = lambda v: F.size(v) == F.size("names")
    whole = F.when(~fits(F.element_at(F.col("rows"), -1)), F.slice("rows", F.lit(1), F.size("rows") - 1)).otherwise(F.col("rows"))
    own = own.withColumn("rows", F.when(F.size("rows") > 0, whole))
    rows = own.select("file", "gain", "names", F.posexplode(strict(F.col("rows"), F.coalesce(F.forall("rows", fits), F.lit(True)), "malformed row")).alias("sample_idx", "v"))
    long = rows.select("file", "sample_idx", "gain", F.explode(F.arrays_zip(F.col("names").alias("channel"), F.col("v").alias("cell"))).alias("c"))
    return long.select("file", "sample_idx", F.col("c.channel").alias("channel"), (F.col("c.cell") * F.col("gain")).alias("value"))


def read_dws(files: DataFrame, keep_derived: bool = False) -> DataFrame:
    """Matrix CSV with a preamble: the header is the first line that starts with ``t_dws,``; null rows and EOF are dropped; waveforms leave out
    ``_ds``/``_ps`` columns. A file without a header is an error."""
    own = file_lines(files)
    own = own.withColumn("at", first_index("lines", lambda x: x.startswith("t_dws,")))
    own = own.withColumn("at", strict(F.col("at"), F.col("at").isNotNull(), "no sample matrix"))
    values = lambda x: F.transform(F.split(x, ","), lambda c: F.trim(c).try_cast("double"))
    matrix = F.filter(F.transform(F.filter(behind("lines", F.col("at")), lambda x: ~x.rlike(r"^\s*(EOF.*)?$")), values), lambda v: F.exists(v, lambda c: c.isNotNull()))
    own = own.select("file", F.split(F.get("lines", F.col("at")), ",").alias("names"), matrix.alias("matrix"))
    rows = own.select("file", "names", F.posexplode("matrix").alias("sample_idx", "v"))
    long = rows.select("file", "sample_idx", F.get("v", F.lit(0)).alias("t"), F.explode(F.arrays_zip(F.col("names").alias("channel"), F.col("v").alias("value"))).alias("c")).select("file", "sample_idx", "t", "c.channel", "c.value").filter("channel NOT LIKE 't\\_%'")
    return long if keep_derived else long.filter("NOT channel RLIKE '_(ds|ps)$'")


#: What file names hold whose matrix keeps every column; the point cloud has a reader of its own.
TIMESERIES = ["contact_force", "electrode_locations", "contact_index", "magnetic_location"]
POINT_CLOUD = "model_point_cloud"


def dws_kind(file: str | Column = "file") -> Column:
    """Which reader a matrix file takes, by its name: point_cloud, timeseries or waveforms."""
    name = F.lower(F.element_at(F.split(file, r"[/\\]"), -1))
    series = reduce(lambda a, b: a | b, [name.contains(k) for k in TIMESERIES])
    return F.when(name.contains(POINT_CLOUD), "point_cloud").when(series, "timeseries").otherwise("waveforms")


def read_preamble(files: DataFrame) -> DataFrame:
    """``Key: value`` lines before the header, one row each; lines of catheters and electrodes are none."""
    own = file_lines(files)
    top = before("lines", F.coalesce(first_index("lines", lambda x: x.startswith("t_dws,")), F.size("lines")))
    told = F.filter(top, lambda x: x.contains(":") & (F.trim(x) != "") & ~F.trim(x).rlike(r"^(Catheter|Electrode)\["))
    rows = own.select("file", F.explode(told).alias("line"))
    return rows.select("file", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).filter("key <> ''")


#: Fixed value: the head of the table of channels.
CHANNEL_TABLE = "channel,catheter name,electrode name"


def read_channel_map(files: DataFrame) -> DataFrame:
    """The table of channels inside a matrix file: file, channel, catheter, electrode, visible; it ends where the numbering does."""
    own = file_lines(files)
    body = behind("lines", first_index("lines", lambda x: x.startswith(CHANNEL_TABLE)))
    cells = F.transform(body, comma_cells)
    rows = own.select("file", cells.alias("cells")).select("file", F.explode(before("cells", F.coalesce(first_index("cells", lambda c: ~F.get(c, F.lit(0)).rlike(r"^\d+$")), F.size("cells")))).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    return rows.select("file", at(0).alias("channel"), F.coalesce(at(1), F.lit("")).alias("catheter"), at(2).alias("electrode"), (at(3) == "1").alias("visible"))


def read_placed_points(files: DataFrame, sep: str, kind: str) -> DataFrame:
    """Marker tables by column name ([a-z0-9] only): without x, y and z no rows; rows with bad numbers are skipped; other columns are kept; only the first section."""
    own = file_lines(files)
    first = before("lines", F.coalesce(first_index("lines", lambda x: F.trim(x) == ""), F.size("lines")))
    own = own.select("file", first.alias("lines"))
    names = F.transform(F.split(F.get("lines", F.lit(0)), sep), lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    rows = own.withColumn("names", names).select("file", "names", F.posexplode(behind("lines", F.lit(0))).alias("placed_id", "line"))
    cells = F.slice(F.concat(F.split("line", sep), F.array_repeat(F.lit(""), F.size("names"))), F.lit(1), F.size("names"))
    rows = rows.withColumn("m", F.map_filter(F.map_from_arrays("names", cells), lambda k, v: F.trim(v) != ""))
    xyz = {c: F.try_element_at("m", F.lit(c)).try_cast("double") for c in "xyz"}
    rows = rows.select("file", "placed_id", F.lit(kind).alias("type"), *[v.alias(c) for c, v in xyz.items()], F.map_filter("m", lambda k, v: ~k.isin("x", "y", "z")).alias("attributes"))
    return rows.dropna(subset=["x", "y", "z"])


#: What a marker table's file name holds, in the order in which it is asked, and for that: the begin of its header, the type of its points, the columns of
#: x, y and z, of the id, of the label, and its other columns with their names as attributes.
MARKER_TABLES = {
    "duo_automark": (
        "t_dws,t_secs,", "ablation_pfa", ("AutoMark Location X", "AutoMark Location Y", "AutoMark Location Z"), "ID", None,
        {"Actual Burst Count": "actual_burst_count", "Expected Burst Count": "expected_burst_count", "Average Force": "avg_force", "Max Force": "max_force", "Therapy Setting": "therapy_setting", "Duration": "duration"},
    ),
    "automark_data": ("RF Episode,", "ablation", ("NavX ABL-D X (mm)", "NavX ABL-D Y (mm)", "NavX ABL-D Z (mm)"), "Lesion ID", None, {"RF Episode": "rf_episode", "Lesion ID": "lesion_id"}),
    "lesions": ("Text,Type,", "marker", ("x", "y", "z"), "Text", "Text", {"Type": "marker_type", "Diameter": "diameter", "Annotation": "annotation"}),
    "labels": ("Text,Type,", "landmark", ("x", "y", "z"), "Text", "Text", {"Type": "marker_type", "Diameter": "diameter", "Annotation": "annotation"}),
}


def read_marker_tables(files: DataFrame) -> DataFrame:
    """Marker tables by the names of their files: file, placed_id, type, x, y, z, source_id, label, attributes; other files give no rows.

    A table is the block under its first header, up to an empty line or the next header. Rows without numbers for x, y and z are skipped. The first column whose
    name holds Power is ``power`` of an ablation, and R, G and B are the ``color`` of markers and landmarks.
    """
    name = F.lower(F.element_at(F.split("file", r"[/\\]"), -1))
    variant = reduce(lambda w, k: w.when(name.contains(k), k), list(MARKER_TABLES)[1:], F.when(name.contains("duo_automark"), "duo_automark"))
    own = file_lines(files).withColumn("variant", variant).filter("variant IS NOT NULL")
    pick = lambda f: reduce(lambda w, k: w.when(F.col("variant") == k, f(MARKER_TABLES[k])), MARKER_TABLES, F)
    own = own.withColumn("prefix", pick(lambda t: F.lit(t[0])))
    own = own.withColumn("at", first_index("lines", lambda x: F.startswith(x, F.col("prefix")))).filter("at IS NOT NULL")
    own = own.select("file", "variant", "prefix", comma_cells(F.get("lines", F.col("at"))).alias("h"), behind("lines", F.col("at")).alias("lines"))
    block = before("lines", F.coalesce(first_index("lines", lambda x: (F.trim(x) == "") | F.startswith(x, F.col("prefix"))), F.size("lines")))
    rows = own.select("file", "variant", "h", F.posexplode(block).alias("placed_id", "line")).withColumn("c", comma_cells(F.col("line")))
    cell = lambda n: F.nullif(F.get("c", F.array_position("h", n).cast("int") - 1), F.lit(""))  # noqa: E731  no column: place -1, no cell
    text = lambda n: F.when(F.array_contains("h", n), cell(n))
    xyz = [pick(lambda t, i=i: text(t[2][i]).try_cast("double")).alias(c) for i, c in enumerate("xyz")]
    power = F.get(F.filter("h", lambda x: x.contains("Power")), F.lit(0))
    colour = F.concat_ws(",", *[F.regexp_replace(text(c), r"\.0*$", "") for c in "RGB"])
    more = {"automark_data": [("power", F.nullif(F.get("c", F.array_position("h", power).cast("int") - 1), F.lit("")))]} | dict.fromkeys(("lesions", "labels"), [("color", F.when(F.size(F.split(colour, ",")) == 3, colour))])
    entries = lambda k, t: F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in [(n, text(c)) for c, n in t[5].items()] + more.get(k, [])]), lambda e: e["v"].isNotNull())
    attributes = reduce(lambda w, k: w.when(F.col("variant") == k, F.map_from_entries(entries(k, MARKER_TABLES[k]))), MARKER_TABLES, F)
    label = pick(lambda t: text(t[4]) if t[4] else F.lit(None).cast("string"))
    out = rows.select("file", "placed_id", pick(lambda t: F.lit(t[1])).alias("type"), *xyz, pick(lambda t: text(t[3])).alias("source_id"), label.alias("label"), attributes.alias("attributes"))
    return out.dropna(subset=["x", "y", "z"])


def detect_vendor(files: DataFrame) -> DataFrame:
    """files(export, path, head): mesh files mean carto, DIF or DxL marks in a head mean ensite, else unknown."""
    mesh = F.max(F.lower("path").endswith(".mesh"))
    other = F.max(F.coalesce(F.col("head").rlike(r"<DIF|Map type:|Data starts in row"), F.lit(False)))
    return files.groupBy("export").agg(F.when(mesh, "carto").when(other, "ensite").otherwise("unknown").alias("vendor"))


def import_manifest(files: DataFrame) -> DataFrame:
    """Per export number of files, of meshes and signal files, and signal bytes; files(export, path, length), contents unread."""
    signal = F.lower("path").rlike(r"(ecg|wave|force|egm).*\.(txt|csv)$")
    return files.groupBy("export").agg(F.count("*").alias("n_files"), F.count_if(F.lower("path").endswith(".mesh")).alias("n_meshes"), F.count_if(signal).alias("n_signal_files"), F.coalesce(F.sum(F.when(signal, F.col("length"))), F.lit(0)).alias("signal_bytes"))


def plan_maps(maps: DataFrame, shapes: DataFrame, min_points: int = 5) -> DataFrame:
    """maps(export, map_name, n_points) with whether they are taken (enough points), and what is wrong: files of differing vertex counts.

    shapes(export, map_name, n_vertices[, path]): one row per file of a map; with paths, the map's ``files`` in order and their vertex counts.
    """
    told = [F.array_sort(F.collect_list(F.struct("path", "n_vertices"))).alias("files")] if "path" in shapes.columns else []
    n = shapes.groupBy("export", "map_name").agg(F.count_distinct("n_vertices").alias("n_shapes"), *told)
    issue = F.when(F.col("n_shapes") > 1, "files of different vertex counts")
    return maps.join(n, ["export", "map_name"], "left").select("export", "map_name", "n_points", (F.col("n_points") >= min_points).alias("included"), issue.alias("issue"), *(["files"] if told else []))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Export (first folder below root), path and length of every file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.when(F.col("path").startswith(whole + "/"), F.substring("path", len(whole) + 2, 2**31 - 1))
    return found.withColumn("export", F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise(""))


def export_points(points: DataFrame, points_long: DataFrame, names: list[str], annotations: list[str]) -> DataFrame:
    """One row per point: a column per measurement, ``annotation_<k>`` columns, and its tags joined with ``;``.

    points(map_id, point_index, annotations map, tags array), points_long(map_id, point_index, name, value).
    """
    wide = points_long.groupBy("map_id", "point_index").pivot("name", names).agg(F.first("value"))
    notes = [F.try_element_at("annotations", F.lit(k)).alias(f"annotation_{k}") for k in annotations]
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ";").alias("tags")
    return points.join(wide, ["map_id", "point_index"], "left").select("map_id", "point_index", *names, *notes, tags)


def extract_meshes(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices of the asked maps; maps without any keep one row of nulls."""
    return ids.select("map_id").distinct().join(vertices, "map_id", "left")


def mesh_summary(vertices: DataFrame, triangles: DataFrame, scalars: DataFrame) -> DataFrame:
    """Number of vertices and triangles and the field names of each map."""
    v = vertices.groupBy("map_id").agg(F.count("*").alias("n_vertices"))
    t = triangles.groupBy("map_id").agg(F.count("*").alias("n_triangles"))
    s = scalars.groupBy("map_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("fields"))
    return v.join(t, "map_id", "left").join(s, "map_id", "left").select("map_id", "n_vertices", F.coalesce("n_triangles", F.lit(0)).alias("n_triangles"), "fields")
