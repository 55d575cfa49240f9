"""Points, windows, forces and signals put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.functions.columns import finite

#: Seconds of a time bucket of the interval join.
BUCKET_SECONDS = 10.0


def _same(left: DataFrame, columns: dict[str, str]) -> Column:
    """Equality of columns of left with others, nulls alike."""
    return reduce(lambda x, y: x & y, [left[a].eqNullSafe(F.col(b)) for a, b in columns.items()])


def force_for_points(points: DataFrame, windows: DataFrame, bucket: float = BUCKET_SECONDS) -> DataFrame:
    """The one force window of each point; points with several (or none) get none.

    points(study_id, map_id, point_id, at), windows(study_id, map_id, data_uri, start_time, first, last[, of_point]). A window that names a point
    (``of_point``) is that point's, whatever its time; any other is a candidate when its time range holds the point. Windows of another map do not count; unmapped
    ones do. Two equi-joins: by the point's id, and by time buckets, so that a point meets only windows of its own bucket.
    Adds data_uri, start_time and ``direct`` (the window named the point: its samples are relative to it already).
    """
    if "of_point" not in windows.columns:
        windows = windows.withColumn("of_point", F.lit(None).cast("string"))
    w = windows.select(F.col("study_id").alias("w_study"), F.col("map_id").alias("w_map"), "data_uri", "start_time", "first", "last", F.col("of_point").cast("string").alias("of_point"))
    here = (points["study_id"] == F.col("w_study")) & (points["map_id"].eqNullSafe(F.col("w_map")) | F.col("w_map").isNull())
    named = points.join(w.filter("of_point IS NOT NULL"), here & (points["point_id"].cast("string") == F.col("of_point"))).withColumn("direct", F.lit(True))
    lo, hi = F.col("start_time") + F.col("first"), F.col("start_time") + F.col("last")
    spread = w.filter("of_point IS NULL").withColumns({"lo": lo, "hi": hi}).withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    timed = points.join(spread, here & points["at"].between(F.col("lo"), F.col("hi")) & (F.floor(points["at"] / bucket) == F.col("slot"))).withColumn("direct", F.lit(False))
    found = ["study_id", "map_id", "point_id", "data_uri", "start_time", "direct"]
    met = named.select(*found).unionByName(timed.select(*found))
    one = met.groupBy("study_id", "map_id", "point_id").agg(F.count("*").alias("n"), F.min(F.struct("data_uri", "start_time", "direct")).alias("w")).filter("n = 1")
    one = one.select(F.col("study_id").alias("s"), F.col("map_id").alias("m"), F.col("point_id").alias("p"), "w.*")
    return points.join(one, _same(points, {"study_id": "s", "map_id": "m", "point_id": "p"}), "left").drop("s", "m", "p")


#: Seconds of a trace that one task sorts.
TRACE_SECONDS = 3600.0


def nearest_samples(points: DataFrame, samples: DataFrame, seconds: float = TRACE_SECONDS) -> DataFrame:
    """Per point and channel of its window the nearest sample in time, the first on a tie: point_id, data_uri, channel, sample_idx, value.

    An as-of join: what each point asks of each channel and the samples are one table, sorted by time within stretches of a trace; each question takes the
    last sample before it and the first after it. The last and first samples of the stretches, carried over those without, answer for what lies beyond. No sample
    meets a point: rows are at most samples + questions.
    """
    slot = lambda c: F.floor(F.col(c) / seconds)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = samples.select(
        "data_uri", "channel", slot("t").alias("slot"), none(points.schema["point_id"].dataType, "point_id"), F.col("t").cast("double").alias("t"),
        F.col("sample_idx").cast("long").alias("sample_idx"), "value", F.lit(False).alias("asks"),
    )
    asked = points.join(own.select("data_uri", "channel").distinct(), "data_uri").select(
        "data_uri", "channel", slot("rel_t").alias("slot"), "point_id", F.col("rel_t").cast("double").alias("t"),
        none("long", "sample_idx"), none(own.schema["value"].dataType, "value"), F.lit(True).alias("asks"),
    )
    both = own.unionByName(asked)
    key = ["data_uri", "channel"]
    first = F.when(~F.col("asks"), F.struct("t", "sample_idx", "value"))
    last = F.when(~F.col("asks"), F.struct("t", (-F.col("sample_idx")).alias("sample_idx"), "value"))
    # samples at a point's own time come before it in both directions
    up, down = (Window.partitionBy(*key, "slot").orderBy(t, "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow) for t in (F.col("t"), F.col("t").desc()))
    held = both.withColumns({"before": F.max(last).over(up)}).withColumns({"after": F.min(first).over(down)}).filter("asks")
    edges = both.groupBy(*key, "slot").agg(F.min(first).alias("first"), F.max(last).alias("last"))
    back, on = (Window.partitionBy(*key).orderBy(s).rowsBetween(Window.unboundedPreceding, -1) for s in (F.col("slot"), F.col("slot").desc()))
    edges = edges.select(*key, "slot", F.max("last").over(back).alias("earlier"), F.min("first").over(on).alias("later"))

    def near(s: str, sign: int) -> Column:
        at, place, value = (F.col(f"{s}.{c}") for c in ("t", "sample_idx", "value"))
        return F.when(F.col(s).isNotNull(), F.struct(F.abs(at - F.col("t")).alias("dt"), (sign * place).alias("sample_idx"), value.alias("value")))

    best = F.least(near("before", -1), near("after", 1), near("earlier", -1), near("later", 1))
    return held.join(edges, [*key, "slot"]).select("point_id", "data_uri", "channel", best.alias("b")).select("point_id", "data_uri", "channel", F.col("b.sample_idx").alias("sample_idx"), "b.value")


def value_at(points: DataFrame, samples: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Per point and channel, the declared instantaneous value, else that of the nearest sample (the first on a tie).

    points(point_id, data_uri, rel_t), samples(data_uri, sample_idx, t, channel, value), declared(data_uri, channel, value).
    """
    best = nearest_samples(points, samples).withColumn("sample_idx", F.col("sample_idx").cast(samples.schema["sample_idx"].dataType))
    if declared is None:
        return best.select("point_id", "channel", "value", "sample_idx")
    told = points.select("point_id", "data_uri").join(declared.withColumnRenamed("value", "told"), "data_uri")
    out = best.join(told.drop("data_uri"), ["point_id", "channel"], "full")
    return out.select("point_id", "channel", F.coalesce("told", "value").alias("value"), F.when(F.col("told").isNull(), F.col("sample_idx")).alias("sample_idx"))


def bind_signals(points: DataFrame, channels: DataFrame) -> DataFrame:
    """For each point and role the one window channel of its identity; ambiguous ones have none, with the number of candidates in ``n``.

    points(point_id, study_id, freeze_group, role, wanted), channels(data_uri, study_id, point_id, freeze_group, channel). A channel that names a point belongs to
    it; one that names no point belongs to all points of its freeze group, for reference roles. Names are compared trimmed and case-folded.
    """
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    a = points.select("study_id", "point_id", "freeze_group", "role", key(F.col("wanted")).alias("name"))
    b = channels.select("study_id", "point_id", "freeze_group", "data_uri", "channel", key(F.col("channel")).alias("name")).distinct()
    own = a.drop("freeze_group").join(b.filter("point_id IS NOT NULL").drop("freeze_group"), ["study_id", "point_id", "name"])
    group = a.filter(F.col("role").startswith("reference")).join(b.filter("point_id IS NULL").drop("point_id"), ["study_id", "freeze_group", "name"]).drop("freeze_group")
    met = own.unionByName(group).groupBy("study_id", "point_id", "role").agg(F.count("*").alias("n"), F.min(F.struct("data_uri", "channel")).alias("b"))
    return met.select("study_id", "point_id", "role", "n", *[F.when(F.col("n") == 1, F.col(f"b.{c}")).alias(c) for c in ("data_uri", "channel")])


def signal_arrays(bindings: DataFrame, samples: DataFrame) -> DataFrame:
    """Per point and role the trace as an array in sample order; only windows of the primary window's rate, length and start (1e-6 s).

    bindings(point_id, role, data_uri, channel, sample_rate, n_samples, start_time, primary boolean[, map_id]). All positive rates of a map (of the whole
    table without map_id) have to be the same: mixed ones are an error when the traces are read. A point whose primary window has no positive rate has no traces; a window without
    a start time fits no other window.
    """
    keys = ["map_id"] if "map_id" in bindings.columns else []
    rates = bindings.filter("sample_rate > 0 AND NOT isnan(sample_rate) AND sample_rate < double('inf')").groupBy(*keys).agg(F.min("sample_rate").alias("rate"), F.max("sample_rate").alias("other"))
    mixed = F.concat(F.lit("mixed sample rates: "), F.col("rate").cast("string"), F.lit(" and "), F.col("other").cast("string"))
    strict = F.when(F.col("rate") < F.col("other"), F.raise_error(mixed)).otherwise(F.col("rate"))
    rates = F.broadcast(rates.select(strict.alias("rate"))) if not keys else rates.select(*keys, strict.alias("rate"))
    first = bindings.filter("primary").groupBy("point_id").agg(F.min(F.struct("sample_rate", "n_samples", "start_time", "data_uri")).alias("p"))
    rated = bindings.join(rates, keys) if keys else bindings.join(rates, F.col("sample_rate") == F.col("rate"))
    fit = rated.join(first, "point_id").filter("sample_rate = rate AND p.sample_rate = rate AND n_samples = p.n_samples AND (data_uri = p.data_uri OR abs(start_time - p.start_time) < 1e-6)")
    traces = fit.select("point_id", "role", "data_uri", "channel").join(samples, ["data_uri", "channel"]).groupBy("point_id", "role")
    traces = traces.agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("s"))
    return traces.select("point_id", "role", F.transform("s", lambda x: x["value"]).alias("trace"))


def check_rates(windows: DataFrame, files: DataFrame) -> DataFrame:
    """Per map the number of positive sample rates and of vertex counts of its files, and what is wrong with them.

    windows(map_id, sample_rate), files(map_id, file, n_vertices).
    """
    rates = windows.groupBy("map_id").agg(F.count_distinct(F.when(F.col("sample_rate") > 0, F.col("sample_rate"))).alias("n_rates"))
    shapes = files.groupBy("map_id").agg(F.count_distinct("n_vertices").alias("n_shapes"))
    both = rates.join(shapes, "map_id", "full").select("map_id", F.coalesce("n_rates", F.lit(0)).alias("n_rates"), F.coalesce("n_shapes", F.lit(0)).alias("n_shapes"))
    return both.withColumn("issues", F.concat_ws("; ", F.when(F.col("n_rates") > 1, "several sample rates"), F.when(F.col("n_shapes") > 1, "files of different vertex counts")))


def waveforms_for_maps(maps: DataFrame, waveforms: DataFrame) -> DataFrame:
    """Windows of the map, and unmapped windows of its study: two equi-joins, not an OR."""
    w = waveforms.withColumnRenamed("map_id", "w_map").withColumnRenamed("study_id", "w_study")
    own = maps.join(w, maps["map_id"] == w["w_map"])
    loose = maps.join(w.filter("w_map IS NULL"), maps["study_id"] == w["w_study"])
    return own.unionByName(loose)


def window_points(points: DataFrame) -> DataFrame:
    """For each window file its points, ordered by numeric id; points(file, point_id)."""
    base = F.element_at(F.split("file", "/"), -1)
    rows = F.array_sort(F.collect_list(F.struct(F.col("point_id").try_cast("long").alias("n"), F.col("point_id").alias("id"))))
    return points.groupBy(base.alias("base_name")).agg(F.transform(rows, lambda r: r["id"]).alias("points"))


def select_markers(placed: DataFrame, maps: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The markers of the maps' studies, or those listed; a listed marker of another study is an error."""
    own = placed.join(maps.select("study_id").distinct(), "study_id", "left_semi")
    if ids is None:
        return own
    chosen = own.join(ids.select("placed_id").distinct(), "placed_id", "left_semi")
    missing = ids.select("placed_id").distinct().join(own, "placed_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("markers that do not belong to the study were asked for")
    return chosen


def new_studies(batch: DataFrame, studies: DataFrame, keys: list[str]) -> DataFrame:
    """What is not there yet."""
    return batch.join(studies.select(*keys).distinct(), keys, "left_anti")


def merge_point_sets(points: DataFrame) -> DataFrame:
    """Points of one map's files merged by id: the first file gives place and order, later files add or overwrite measurements.

    points(map_id, file_no, point_index, source_id, x, y, z, measurements); rows without an id never merge.
    """
    entries = points.select("map_id", "file_no", "point_index", F.coalesce("source_id", F.concat(F.lit("#"), F.col("file_no").cast("string"), F.lit(":"), F.col("point_index").cast("string"))).alias("key"), "source_id", "x", "y", "z", "measurements")
    head = entries.groupBy("map_id", "key").agg(F.min(F.struct("file_no", "point_index", "source_id", "x", "y", "z")).alias("h"))
    long = entries.select("map_id", "key", "file_no", F.explode("measurements").alias("name", "m"))
    last = long.groupBy("map_id", "key", "name").agg(F.max_by("m", "file_no").alias("m"))
    merged = last.groupBy("map_id", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "m")))).alias("measurements"))
    return head.join(merged, ["map_id", "key"], "left").select("map_id", F.col("h.point_index").alias("point_index"), F.col("h.source_id").alias("source_id"), "h.x", "h.y", "h.z", "measurements")


def group_polarity(files: DataFrame, vertices: DataFrame) -> DataFrame:
    """Files of one group key (case-folded) with identical vertices form one map; others stay apart.

    files(file_id, group_key), vertices(file_id, vertex_id, x, y, z) -> file_id, group_key, map_key.
    """
    rows = vertices.select("file_id", F.xxhash64("vertex_id", "x", "y", "z").cast("decimal(38,0)").alias("h"))
    shape = rows.groupBy("file_id").agg(F.sum("h").alias("sum_h"), F.count("*").alias("n"))
    keyed = files.join(shape, "file_id", "left").withColumn("folded", F.lower("group_key"))
    same = keyed.groupBy("folded").agg(F.count_distinct("sum_h", "n").alias("shapes"))
    return keyed.join(same, "folded").select("file_id", "group_key", F.when(F.col("shapes") == 1, F.col("folded")).otherwise(F.concat_ws("#", "folded", F.col("file_id").cast("string"))).alias("map_key"))


def operator_map_name(files: DataFrame) -> DataFrame:
    """The one name that a map's files declare, else the least file stem; files(map_key, declared, stem)."""
    n = files.groupBy("map_key").agg(F.count_distinct("declared").alias("names"), F.min("declared").alias("declared"), F.min("stem").alias("stem"))
    return n.select("map_key", F.when(F.col("names") == 1, F.col("declared")).otherwise(F.col("stem")).alias("map_name"))


def signal_properties(points_long: DataFrame, points: DataFrame) -> DataFrame:
    """For each (name, kind, unit) of a map a vector over all its points, in index order, null where a point lacks it.

    One group per map: its points in order with what each measured; the vectors are looked up in them.
    """
    key = F.struct("name", "kind", "unit")
    own = points_long.groupBy("map_id", "point_index").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col("value").alias("v")))).alias("m"))
    every = points.select("map_id", "point_index").join(own, ["map_id", "point_index"], "left")
    before = lambda a, b: F.when(a["point_index"] < b["point_index"], -1).when(a["point_index"] > b["point_index"], 1).otherwise(0)
    maps = every.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("point_index", "m")), before).alias("rows"))
    kinds = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(F.map_keys(r["m"]), F.array()))))
    each = maps.select("map_id", "rows", F.explode(kinds).alias("k"))
    return each.select("map_id", "k.name", "k.kind", "k.unit", F.transform("rows", lambda r: F.try_element_at(r["m"], F.col("k"))).alias("vector"))


#: Kind, its slot in the standard surface table.
SLOTS = {"activation_time": "act", "pacemap_score": "act", "voltage_bipolar": "bip", "voltage_unipolar": "uni", "impedance": "imp", "contact_force": "frc"}


def surface_slots(scalars: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per vertex the standard slots act, bip, uni, imp, frc in standard units, masked, and the other fields in the map ``rest``; and per map the notes on gaps.

    scalars(map_id, vertex_id, name, kind, unit, position, value, valid), factors(quantity, unit, factor). A slot takes the first field of its kind; a pace score is
    -|score|; a field whose unit has no factor stays in ``rest`` under its name, with a note.
    """
    slot = F.try_element_at(F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv]), F.col("kind"))
    fields = scalars.groupBy("map_id", "name", "kind", "unit").agg(F.min("position").alias("position")).withColumn("slot", slot)
    known = factors.select(F.col("quantity").alias("kind"), "unit", "factor")
    fields = fields.join(known, ["kind", "unit"], "left").withColumn("nth", F.when(F.col("slot").isNotNull(), F.row_number().over(Window.partitionBy("map_id", "slot").orderBy("position"))))
    fields = fields.withColumn("slot", F.when((F.col("nth") == 1) & F.col("factor").isNotNull(), F.col("slot")))
    keyed = scalars.drop("position", "kind", "unit").join(fields.select("map_id", "name", "kind", "slot", "factor"), ["map_id", "name"])
    value = F.when(F.coalesce("valid", F.lit(True)), F.when(F.col("kind") == "pacemap_score", -F.abs("value")).otherwise(F.col("value")) * F.coalesce("factor", F.lit(1.0)))
    keyed = keyed.withColumn("v", value)
    names = list(dict.fromkeys(SLOTS.values()))
    picked = [F.max(F.when(F.col("slot") == s, F.col("v"))).alias(s) for s in names]
    rest = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("slot").isNull(), F.struct("name", "v")))))
    out = keyed.groupBy("map_id", "vertex_id").agg(*picked, rest.alias("rest"))
    gaps = fields.groupBy("map_id").agg(
        F.collect_set("kind").alias("kinds"),
        F.array_sort(F.collect_list(F.when((F.col("nth") == 1) & F.col("factor").isNull(), F.concat("name", F.lit(": unsupported unit '"), F.coalesce("unit", F.lit("")), F.lit("'"))))).alias("odd"),
    )
    wanted = [F.when(~F.arrays_overlap("kinds", F.array(*[F.lit(k) for k, x in SLOTS.items() if x == s])), F.lit("no " + next(k for k, x in SLOTS.items() if x == s))) for s in names]
    return out, gaps.select("map_id", F.concat("odd", F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("notes"))


def electric_table(points: DataFrame) -> DataFrame:
    """Per point voltages, annotations, window of interest, electrode names, and the activation in ms at the declared rate.

    On a pace map the map annotation is reference - |score| (reference 0 if missing), and there is no activation.
    """
    m = lambda n: F.try_element_at("measurements", F.lit(n))["value"]
    a = lambda n: F.try_element_at("annotations", F.lit(n)).try_cast("double")
    pace = m("pacemap_score").isNotNull()
    mapped = F.when(pace, F.coalesce(a("reference"), F.lit(0.0)) - F.abs(m("pacemap_score"))).otherwise(a("map"))
    lat = F.when(~pace & (F.col("sample_rate") > 0), (a("map") - a("reference")) * 1000 / F.col("sample_rate"))
    return points.select(
        "map_id", "point_index", m("voltage_bipolar").alias("bipolar"), m("voltage_unipolar").alias("unipolar"), a("reference").alias("reference"), mapped.alias("map_annotation"),
        a("woi_from").alias("woi_from"), a("woi_to").alias("woi_to"), F.array_join(F.array_sort(F.map_keys("electrodes")), ",").alias("electrodes"), lat.alias("lat_ms"),
    )


#: Column of the ablation table, attribute of a marker.
ABLATION = {
    "duration": "duration_s", "force": "average_force_g", "temperature": "max_temperature_c", "power": "max_power_w", "base_impedance": "base_impedance_ohm", "impedance_drop": "impedance_drop_ohm",
    "fti": "force_time_integral",
}
#: Attributes that hold an index; each is a family of its own.
INDEX_FAMILIES = ["rf_index", "ablation_index", "lesion_index"]


def _ablated(placed: DataFrame) -> Column:
    return (F.col("type") == "ablation") & reduce(lambda a, b: a & b, [finite(F.col(c)).isNotNull() for c in "xyz"])


def ablation_table(placed: DataFrame) -> DataFrame:
    """RF markers with a finite position and their numbers; others are left out.

    placed(study_id, placed_id, type, x, y, z, attributes map). The index of one vendor is not that of another: ``index_name`` and ``index`` are there only if the study's markers
    hold exactly one family.
    """
    own = placed.filter(_ablated(placed))
    number = lambda c: finite(F.try_element_at("attributes", F.lit(c)).try_cast("double"))
    held = [F.max(F.map_contains_key("attributes", F.lit(f))).alias(f) for f in INDEX_FAMILIES]
    studies = own.groupBy("study_id").agg(*held).select(F.col("study_id").alias("s"), F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in INDEX_FAMILIES])).alias("families"))
    met = own.join(studies, F.col("study_id").eqNullSafe(F.col("s")), "left").withColumn("index_name", F.when(F.size("families") == 1, F.get("families", F.lit(0))))
    value = reduce(lambda w, f: w.when(F.col("index_name") == f, number(f)), INDEX_FAMILIES, F)
    return met.select("study_id", "placed_id", "x", "y", "z", *[number(key).alias(c) for c, key in ABLATION.items()], "index_name", value.alias("index"))


def ablation_counts(placed: DataFrame) -> DataFrame:
    """Per study the markers of the ablation table, those that are left out (other types, PFA among them, and positions that are not finite), and its families of indices."""
    families = F.array_compact(F.array(*[F.when(F.max(_ablated(placed) & F.coalesce(F.map_contains_key("attributes", F.lit(f)), F.lit(False))), F.lit(f)) for f in INDEX_FAMILIES]))
    taken = F.coalesce(_ablated(placed), F.lit(False))
    return placed.groupBy("study_id").agg(F.count_if(taken).alias("n_markers"), F.count_if(~taken).alias("n_excluded"), F.array_join(families, ",").alias("families"))
