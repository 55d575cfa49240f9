"""Listings, reports and cohort tables."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.functions.columns import finite, ms_to_sample


def list_maps(maps: DataFrame, points: DataFrame) -> DataFrame:
    """A10: maps of each study with their number of points (0 without any)."""
    n = points.groupBy("map_id").agg(F.count("*").alias("n_points"))
    return maps.join(n, "map_id", "left").select("study_id", "map_id", "map_name", F.coalesce("n_points", F.lit(0)).alias("n_points"))


def list_studies_and_maps(studies: DataFrame, maps: DataFrame, attributes: DataFrame) -> DataFrame:
    """A10: every map that has attributes, with its study, in order of study and map: studies(study_id, study_name), maps(map_id, study_id, map_name), attributes(map_id)."""
    own = maps.join(attributes.select("map_id").distinct(), "map_id", "left_semi").join(studies.select("study_id", "study_name"), "study_id")
    return own.select("study_id", "study_name", "map_id", "map_name").orderBy("study_id", "map_id")


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page in order; limit 0 means all."""
    out = df.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def page_header(points_long: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """For each measurement name of a map its first unit by point and number of values, and (with points) the number of all points of the map.

    Maps without measurements keep a row without a name."""
    unit = F.min(F.struct("point_index", "unit"))
    names = points_long.groupBy("map_id", "name").agg(unit.alias("u"), F.count("*").alias("n_values")).select("map_id", "name", F.col("u.unit").alias("unit"), "n_values")
    if points is None:
        return names
    return points.groupBy("map_id").agg(F.count("*").alias("n_points")).join(names, "map_id", "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))


def signal_header(waveforms: DataFrame) -> DataFrame:
    """Per study the channels and sample rates that occur."""
    c = waveforms.select("study_id", "sample_rate", F.explode("channels").alias("channel"))
    return c.groupBy("study_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.count_distinct("sample_rate").alias("n_rates"))


def report_table(ids: DataFrame, areas: DataFrame, stats: DataFrame, absolute: DataFrame, relative: DataFrame, labels: list[str], relative_labels: list[str], attributes: DataFrame, attribute_names: list[str]) -> DataFrame:
    """One row per requested map: area, min/max/mean/std of its values, a column "<interval> (abs)" or "(rel)" per interval, and its attributes.

    Numbers are rounded to 4; maps that are not found keep a row of nulls. areas(map_id, area_cm2), stats(map_id, min_value, max_value, mean_value,
    std_value), absolute and relative(map_id, label, area_cm2), attributes(map_id, attributes map<string,string>).
    """
    wide = [df.groupBy("map_id").pivot("label", names).agg(F.first("area_cm2")).withColumnsRenamed({n: f"{n} ({mark})" for n in names}) for df, names, mark in ((absolute, labels, "abs"), (relative, relative_labels, "rel"))]
    own = attributes.select("map_id", *[F.try_element_at("attributes", F.lit(n)).alias(n) for n in attribute_names])
    parts = [areas, stats.select("map_id", "min_value", "max_value", "mean_value", "std_value"), *wide, own]
    out = reduce(lambda a, b: a.join(b, "map_id", "left"), parts, ids.select("map_id").distinct())
    out = out.withColumn("found", F.col("area_cm2").isNotNull())
    numbers = [f.name for f in out.schema if f.dataType.simpleString() == "double"]
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 4) for c in numbers})


def _holds(value: Column, want) -> Column:
    """Whether a variant contains a JSON value: objects by key, lists when each wanted entry is in some entry, scalars when kind and value are the same."""
    kind = F.schema_of_variant(value)
    if isinstance(want, dict):
        own = F.try_variant_get(value, "$", "map<string,variant>")
        return reduce(lambda a, b: a & b, [_holds(F.try_element_at(own, F.lit(k)), v) for k, v in want.items()], own.isNotNull())
    if isinstance(want, (list, tuple)):
        own = F.try_variant_get(value, "$", "array<variant>")
        has = lambda entry: F.exists(own, lambda x: F.coalesce(_holds(x, entry), F.lit(False)))
        return reduce(lambda a, b: a & b, map(has, want), own.isNotNull())
    if want is None:
        return kind == "VOID"
    if isinstance(want, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(want))
    if isinstance(want, (int, float)):
        same = F.try_variant_get(value, "$", "double") == F.lit(float(want))
        if isinstance(want, int) and abs(want) < 2**63:
            same = same & (F.try_variant_get(value, "$", "bigint") == F.lit(want))
        return ~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & same
    return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(want))


def filter_by_attributes(maps: DataFrame, filters: dict) -> DataFrame:
    """Maps whose JSON attributes contain the given ones: nested objects and lists too, numbers told apart from strings.

    A filter's own "true"/"false" mean booleans (those inside nested values stay strings); no filter means all maps; attributes that are missing or no JSON match no other.
    """
    if not filters:
        return maps
    wanted = {k: v.lower() == "true" if isinstance(v, str) and v.lower() in ("true", "false") else v for k, v in filters.items()}
    return maps.filter(F.coalesce(_holds(F.try_parse_json("attributes"), wanted), F.lit(False)))


def set_attributes(maps: DataFrame, updates: DataFrame) -> DataFrame:
    """Attribute maps with updates laid over them, the later of two values winning; maps(map_id, attributes map), updates alike."""
    both = maps.join(updates.select("map_id", F.col("attributes").alias("new")), "map_id", "full")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce("attributes", none), F.coalesce("new", none)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return both.select("map_id", F.map_concat(kept, new).alias("attributes"))


def get_attributes(maps: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The named attributes of the asked maps; a missing map has null."""
    return ids.select("map_id").distinct().join(maps, "map_id", "left").select("map_id", F.map_filter("attributes", lambda k, v: k.isin(keys)).alias("attributes"))


def with_defaults(maps: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Attributes filled up with the defaults of the catalogue."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    missing = F.map_filter(base, lambda k, v: ~F.map_contains_key("attributes", k))
    return maps.withColumn("attributes", F.map_concat("attributes", missing))


def select_maps(maps: DataFrame, regex: str | None = None, min_points: int = 5, ids: list[int] | None = None) -> DataFrame:
    """Maps with enough points whose name matches (case ignored), or those listed."""
    if ids is not None:
        return maps.filter(F.col("map_id").isin(ids))
    out = maps.filter(F.col("number_of_points") >= min_points)
    return out.filter(F.col("map_name").rlike(f"(?i){regex}")) if regex else out


def detect_pacemap(scalars: DataFrame) -> DataFrame:
    """Is the map a pace map, from its data: valid values (> -9999), flipped if all are negative; least > 9000 says no; else 0..100. Null without data."""
    v = F.when((F.col("value") > -9999) & ~F.isnan("value"), F.col("value"))
    r = scalars.groupBy("map_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    down = F.col("hi") < 0
    lo, hi = F.when(down, -F.col("hi")).otherwise(F.col("lo")), F.when(down, -F.col("lo")).otherwise(F.col("hi"))
    return r.select("map_id", F.when(lo > 9000, F.lit(False)).otherwise((lo >= 0) & (hi <= 100)).alias("is_pacemap"))


#: Shifts of a map's centre from its study's reference, in mm, beyond which it lies in a region.
LATERAL_DX, SEPTAL_DX, FRONT_DY, BACK_DY, FRONT_DZ, BACK_DZ = 15.0, -10.0, 5.0, -5.0, 5.0, -8.0


def centroid_region(points: DataFrame, reference: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """The region in which a map's centroid lies, by its shift from the study's reference centroid; null if none fits.

    points(study_id, map_id, x, y, z), reference(study_id, rx, ry, rz). Points with a missing coordinate (zero counts as missing) are left out.
    """
    whole = reduce(lambda a, b: a & b, [finite(F.col(c)).isNotNull() & ((F.col(c) != 0) | F.lit(not zero_is_missing)) for c in "xyz"])
    centre = points.groupBy("study_id", "map_id").agg(*[F.avg(F.when(whole, F.col(c))).alias(f"c{c}") for c in "xyz"])
    d = centre.join(reference, "study_id", "left").select("study_id", "map_id", *[(F.col(f"c{c}") - F.col(f"r{c}")).alias(f"d{c}") for c in "xyz"])
    dx, dy, dz = F.col("dx"), F.col("dy"), F.col("dz")
    label = F.when(dx > LATERAL_DX, "lateral wall").when((dx < SEPTAL_DX) & (dy > FRONT_DY), "roof").when((dx < SEPTAL_DX) & (dy < 0), "septal wall")
    label = label.when((dy > FRONT_DY) & (dz > FRONT_DZ), "anterior wall").when((dy < BACK_DY) & (dz < BACK_DZ), "posterior inferior wall")
    return d.withColumn("region", label)


#: Types of map that are no pace maps whatever their data say.
NO_PACEMAP = ["AFIB", "flutter", "VT", "voltage", "activation-SR"]


def build_attributes(tagged: DataFrame, verdict: DataFrame, regions: DataFrame) -> DataFrame:
    """map_id and attributes (atrium, part, type, pacemap), of those that are known.

    tagged: P17 over the maps. The data's verdict (A16) makes a pace map where the name gives no other type; "vera" maps ignore it, and they
    alone take the region of the coordinates (A17), if their name has none; a name of the whole chamber is "full".
    """
    met = tagged.join(verdict, "map_id", "left").join(regions.select("map_id", F.col("region").alias("place")), "map_id", "left")
    vera = F.coalesce(F.upper("map_name").rlike(r"\bVERA\b"), F.lit(False))
    kind = F.coalesce(F.col("map_type"), F.lit(""))
    by_data = ~kind.isin(*NO_PACEMAP) & F.coalesce("is_pacemap", F.lit(False)) & ~vera
    pace = F.when((kind == "pacemapping") | by_data, F.lit(True)).when(kind.isin(*NO_PACEMAP), F.lit(False))
    part = F.when(F.col("part") == "", "full").otherwise(F.coalesce("part", F.when(vera, F.col("place"))))
    values = {"atrium": F.col("atrium"), "part": part, "type": F.when(by_data, "pacemapping").otherwise(F.col("map_type")), "pacemap": pace.cast("string")}
    entries = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    return met.select("map_id", F.map_filter(entries, lambda k, v: v.isNotNull()).alias("attributes"))


def decay_profile(df: DataFrame, bin_width: float = 2.0, max_dist: float = 40.0, keys: tuple = ("map_id",)) -> DataFrame:
    """Mean score and count per distance bin (its centre) within max_dist; bins of 3 rows or more, keys with 20 rows and 4 bins or more."""
    near = df.filter((F.col("distance") <= max_dist) & finite(F.col("score")).isNotNull())
    bins = near.groupBy(*keys, (F.floor(F.col("distance") / bin_width) * bin_width + bin_width / 2).alias("bin")).agg(F.avg("score").alias("mean_score"), F.count("*").alias("n")).filter("n >= 3")
    rows = near.groupBy(*keys).agg(F.count("*").alias("rows"))
    enough = bins.groupBy(*keys).agg(F.count("*").alias("bins")).join(rows, list(keys)).filter("rows >= 20 AND bins >= 4").select(*keys)
    return bins.join(enough, list(keys), "left_semi")


#: Bounds of amplitude, width and offset of a decay.
DECAY_A, DECAY_SIGMA, DECAY_B = (0.0, 100.0), (0.1, 40.0), (0.0, 100.0)


def _fit_bounded(g: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Squared error, a and b of the least-squares line a g + b within the bounds: the free one, or one on an edge with the other free."""
    spread = float(((g - g.mean()) ** 2).sum())
    a = float(((g - g.mean()) * (y - y.mean())).sum()) / spread if spread > 0 else 0.0
    tries = [(a, float(y.mean() - a * g.mean()))]
    tries += [(e, float(y.mean() - e * g.mean())) for e in DECAY_A]
    tries += [(float((g * (y - e)).sum() / (g * g).sum()) if (g * g).sum() > 0 else 0.0, e) for e in DECAY_B]
    tries = [(float(np.clip(p, *DECAY_A)), float(np.clip(q, *DECAY_B))) for p, q in tries]
    return min((float(((p * g + q - y) ** 2).sum()), p, q) for p, q in tries)


def _fit_decay(group: pd.DataFrame) -> pd.DataFrame:
    d, y = group["bin"].to_numpy(dtype=float), group["mean_score"].to_numpy(dtype=float)

    def best(sigmas: np.ndarray) -> tuple[float, float, float, float]:
        fits = ((*_fit_bounded(np.exp(-(d**2) / (2 * s * s)), y), s) for s in np.clip(sigmas, *DECAY_SIGMA))
        sse, a, b, s = min(fits)
        return sse, float(s), a, b

    found = best(np.geomspace(*DECAY_SIGMA, 120))
    for width in (0.1, 0.01, 0.001, 0.0001):
        found = min(found, best(found[1] * np.linspace(1 - width, 1 + width, 41)))
    sse, s, a, b = found
    total = float(((y - y.mean()) ** 2).sum())
    return pd.DataFrame({"map_id": [group["map_id"].iloc[0]], "amplitude": [a], "sigma": [s], "offset": [b], "r2": [1 - sse / total if total > 0 else 0.0], "n_bins": [len(d)], "n_vertices": [int(group["n"].sum())]})


def fit_decay(profile: DataFrame) -> DataFrame:
    """A exp(-d^2 / 2 sigma^2) + B fitted to each map's bins (a handful of rows): sigma on a refined grid, A and B by least squares in bounds."""
    return profile.groupBy("map_id").applyInPandas(_fit_decay, "map_id long, amplitude double, sigma double, offset double, r2 double, n_bins int, n_vertices long")


#: Atrium, what the part's name holds, and the label of the region.
REGIONS = [("LA", "posterior", "LA post"), ("LA", "anterior", "LA ant"), ("RA", "posterior", "RA post"), ("RA", "lateral", "RA lat")]


def region_label(atrium: str = "atrium", part: str = "part") -> Column:
    """The region of a map; atrium and part themselves where no label fits."""
    named = reduce(lambda w, r: w.when((F.col(atrium) == r[0]) & F.col(part).contains(r[1]), r[2]), REGIONS, F)
    return named.otherwise(F.concat_ws(" ", atrium, part))


def cohort_summary(maps: DataFrame, least_distance: float = 5.0) -> DataFrame:
    """Sigma of fitted maps by reference and region, with and without multifocal maps; also by reference, by region and over all.

    maps(atrium, part, ref_catheters, is_multifocal, max_geodesic_dist, sigma): maps that reach less far than least_distance are fragments and do
    not count. n counts maps, medians and quartiles (exact, linear) the sigmas that are there; delta is median of all - median of the focal ones. ``level`` tells
    the grouping sets apart (0: reference and region, 1: reference, 2: region, 3: all).
    """
    sigma = finite(F.col("sigma").cast("double"))
    multi = F.coalesce("is_multifocal", F.lit(False)).alias("multi")
    whole = maps.filter(F.col("max_geodesic_dist") >= least_distance).select("ref_catheters", region_label().alias("region"), multi, sigma.alias("sigma"))
    focal = F.when(~F.col("multi"), F.col("sigma"))
    quarter = lambda v, q: F.percentile(v, F.lit(q))
    stats = [f(v, q).alias(f"{n}_{s}") for v, s in ((F.col("sigma"), "all"), (focal, "focal")) for f, q, n in ((quarter, 0.5, "median"), (quarter, 0.25, "q1"), (quarter, 0.75, "q3"))]
    sets = whole.groupingSets([["ref_catheters", "region"], ["ref_catheters"], ["region"], []], "ref_catheters", "region")
    out = sets.agg(F.count("*").alias("n_all"), F.count_if(~F.col("multi")).alias("n_focal"), F.count_if("multi").alias("n_excluded"), *stats, F.grouping_id().cast("int").alias("level"))
    return out.withColumn("delta", F.col("median_all") - F.col("median_focal"))


def _normal_tail(z: Column) -> Column:
    """P(Z >= z) of the normal law: a power series near 0, a continued fraction beyond."""
    size = F.abs(z)
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    # sum of z^(2k+1) / (1 * 3 * ... * (2k+1))
    term = lambda s, k: s["term"] * z * z / (2 * k + 1)
    add = lambda s, k: F.struct(term(s, k).alias("term"), (s["sum"] + term(s, k)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(size.alias("term"), size.alias("sum")), add, lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), size, lambda s, k: size + k / s)
    upper = F.when(size < 3, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z >= 0, upper).otherwise(1 - upper)


@lru_cache(maxsize=64)
def _rank_sums(n1: int, n2: int) -> np.ndarray:
    """In how many ways U = 0, 1, ..., n1 n2 comes about: the coefficients of a product of quotients (1 - q^(n+i)) / (1 - q^i), in whole numbers."""
    m, n = sorted((n1, n2))
    ways = np.zeros(m * n + 1, dtype=object)
    ways[0] = 1
    for i in range(1, m + 1):
        if n + i < len(ways):
            ways[n + i :] = ways[n + i :] - ways[: -(n + i)]
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])
    return ways


def _exact_tail(n1: int, n2: int, u: int) -> float:
    """P(U >= u) of two samples without ties."""
    return float(sum(int(w) for w in _rank_sums(n1, n2)[u:]) / math.comb(n1 + n2, n1))


#: The smaller sample up to which the law of U is counted out, if there are no ties.
EXACT = 8


def mann_whitney(values: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """U of the rows with group = true over those with false ("greater") and its p; groups of at least 2 and 2; missing values do not count.

    p is exact when there are no ties and one of the samples has at most EXACT values, else that of the normal approximation with continuity and tie
    correction. Ranks come from counts of equal values: one row per (by, value), so the window runs over distinct values.
    """
    v = finite(F.col(value).cast("double"))
    counts = values.withColumn("__v", v).filter(F.col("__v").isNotNull() & F.col(group).isNotNull()).groupBy(*by, "__v").agg(F.count("*").alias("t"), F.count_if(F.col(group)).alias("t1"))
    before = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    t, t1 = F.col("t"), F.col("t1")
    sums = ranked.groupBy(*by).agg(F.sum(t1).alias("n1"), F.sum(t - t1).alias("n2"), F.sum(F.col("rank") * t1).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    out = sums.filter("n1 >= 2 AND n2 >= 2").withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    out = out.withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2.0 - 0.5, sd)).withColumn("exact", (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT))

    @F.pandas_udf("double")
    def counted(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
        # a group's law, for the few groups that ask for it
        return pd.Series([None if a != a or a is None else _exact_tail(int(a), int(b), int(c)) for a, b, c in zip(n1, n2, u)], dtype="float64")

    asked = [F.when(F.col("exact"), F.col(c)) for c in ("n1", "n2", "u")]
    return out.select(*by, "n1", "n2", "u", "z", "exact", F.when(F.col("exact"), counted(*asked)).otherwise(_normal_tail(F.col("z"))).alias("p"))


def annotated_channels(points: DataFrame) -> DataFrame:
    """The channels that the points of a window name, each once: points(data_uri, mapping_channels map<role, channel>)."""
    each = points.select("data_uri", F.explode(F.map_values("mapping_channels")).alias("channel"))
    return each.filter("channel <> ''").distinct()


def decimate(samples: DataFrame, max_samples: int = 400, keys: tuple = ("data_uri", "channel"), points: DataFrame | None = None, channels: list[str] | None = None) -> DataFrame:
    """Every step-th sample of each trace, step = ceil(n / max_samples), values to 4 decimals.

    Only the named channels; without names, those that the windows' points name (`annotated_channels`), if points are given; else all.
    """
    if channels:
        samples = samples.filter(F.col("channel").isin(channels))
    elif points is not None:
        samples = samples.join(annotated_channels(points), ["data_uri", "channel"], "left_semi")
    n = samples.groupBy(*keys).agg(F.ceil(F.count("*") / max_samples).alias("step"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("sample_idx")) - 1
    return samples.withColumn("at", at).join(n, list(keys)).filter("at % step = 0").select(*samples.columns).withColumn("value", F.round("value", 4))


def slice_ms(samples: DataFrame, windows: DataFrame, start_ms: float, end_ms: float) -> DataFrame:
    """The samples from start_ms to end_ms of each window (rounded to samples, clamped); windows(data_uri, sample_rate, n_samples)."""
    lo = F.greatest(F.lit(0), ms_to_sample(F.lit(float(start_ms)), F.col("sample_rate")))
    hi = F.least(F.col("n_samples"), ms_to_sample(F.lit(float(end_ms)), F.col("sample_rate")))
    return samples.join(windows.select("data_uri", lo.alias("lo"), hi.alias("hi")), "data_uri").filter("sample_idx >= lo AND sample_idx < hi").drop("lo", "hi")


def beat_window(points: DataFrame, samples: DataFrame, half_window_ms: float = 250.0) -> DataFrame:
    """Samples around each point's reference annotation: t relative to it, |t| <= half window; points(point_id, data_uri, reference_t, map_t).

    Samples are laid out in time buckets as long as a window, so a point meets those of the two or three buckets that its window touches.
    """
    width = max(2 * half_window_ms / 1000, 1e-3)
    edge = lambda sign: F.floor((F.col("reference_t") + sign * half_window_ms / 1000) / width + sign * 1e-6)
    asked = points.withColumn("slot", F.explode(F.sequence(edge(-1), edge(1))))
    met = asked.join(samples.withColumn("slot", F.floor(F.col("t") / width)), ["data_uri", "slot"]).drop("slot").withColumn("rel_ms", (F.col("t") - F.col("reference_t")) * 1000)
    return met.filter(F.abs("rel_ms") <= half_window_ms).withColumn("map_offset_ms", (F.col("map_t") - F.col("reference_t")) * 1000)


def ordered(df: DataFrame, cols: list[str]) -> DataFrame:
    """A listing in order."""
    return df.orderBy(*cols)


def union_vendors(*tables: DataFrame) -> DataFrame:
    """Tables of several vendors as one, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def unseen(bundles: DataFrame, jobs: DataFrame, key: str = "path") -> DataFrame:
    """Bundles that no job has taken."""
    return bundles.join(jobs.select(key).distinct(), key, "left_anti")


def with_missing(ids: DataFrame, found: DataFrame, key: str = "map_id") -> DataFrame:
    """Every requested id with what was found for it, and whether anything was."""
    return ids.select(key).distinct().join(found.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


#: Columns whose value goes whatever it is.
REDACTED_KEYS = ["operator", "notes", "comment", "comments", "patient", "patient_id", "patient_name", "date_of_birth", "dob", "source_path", "mesh_file", "data_uri", "file", "filename", "path"]
REDACTED = "[redacted]"
#: Columns that may hold a slash without being a path.
NAME_KEYS = ["study_name", "name"]


def names_in(texts: DataFrame, names: DataFrame, row: list[str]) -> DataFrame:
    """Of texts(row, t), the names(name, ...) that occur in each: row, t, name, ...; each once.

    Seeds: every name is known by one part of fixed length, the one that fewest names have, and its place in the name. A text's parts of that length
    (one row per place, whatever the lengths of names) meet the seeds in an equi-join, and where one is met the whole name is compared.
    """
    least = names.agg(F.min(F.length("name"))).first()[0]
    if not least:
        return texts.select(*row, "t", *[F.lit(None).cast(f.dataType).alias(f.name) for f in names.schema]).limit(0)
    width = min(SEED, least)

    def parts(c: str) -> Column:
        return F.when(F.length(c) >= width, F.transform(F.sequence(F.lit(1), F.length(c) - width + 1), lambda i: F.substring(c, i, F.lit(width))))

    each = names.select("name", F.posexplode(parts("name")).alias("offset", "seed"))
    rare = each.join(each.groupBy("seed").agg(F.count_distinct("name").alias("names")), "seed")
    seeds = rare.groupBy("name").agg(F.min(F.struct("names", "offset", "seed")).alias("s")).select("name", "s.offset", "s.seed")
    places = texts.select(*row, "t", F.posexplode(parts("t")).alias("at", "seed"))
    met = places.join(seeds, "seed").filter((F.col("at") >= F.col("offset")) & (F.substring("t", F.col("at") - F.col("offset") + 1, F.length("name")) == F.col("name")))
    return met.select(*row, "t", "name").distinct().join(names, "name")


#: Signs of a seed (fewer where a name is shorter).
SEED = 8


def deidentify(df: DataFrame, studies: DataFrame, key: list[str], text_cols: list[str], enabled: bool = True) -> DataFrame:
    """Redacted columns go, texts that look like a path (a slash or backslash) too, and known study names become ``study/<id>``; rows carry the mode.

    studies(study_id, name) can be a large table: names are found in texts by seeds (`names_in`), and a text is rewritten by the names it holds alone, longest first.
    key: columns that tell the rows of df apart.
    """
    if not enabled:
        return df.withColumn("mode", F.lit("open"))
    gone = [c for c in df.columns if c.strip().lower() in REDACTED_KEYS]
    texts = [c for c in text_cols if c not in gone]
    names = studies.filter("name <> ''").select("name", F.col("study_id").cast("string").alias("study_id")).distinct()
    each = df.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("t")) for c in texts])).alias("x")).select(*key, "x.c", "x.t").filter("t IS NOT NULL")
    held = names_in(each, names, [*key, "c"])
    found = held.groupBy(*key, "c", "t").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("n"), "name", "study_id"))).alias("names"))
    clean = found.select(*key, "c", F.aggregate("names", F.col("t"), lambda text, x: F.replace(text, x["name"], F.concat(F.lit("study/"), x["study_id"]))).alias("clean"))
    wide = clean.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("c", "clean"))).alias("__clean"))
    out = df.join(wide, key, "left")

    def cleaned(c: str) -> Column:
        named = F.coalesce(F.try_element_at("__clean", F.lit(c)), F.col(c))
        if c.strip().lower() in NAME_KEYS:
            return named
        path = F.col(c).rlike(r"[/\\\\]") & ~F.trim(c).rlike(r"^study/\d+$")
        return F.when(path, F.lit(REDACTED)).otherwise(named)

    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(REDACTED)) for c in gone} | {c: cleaned(c) for c in texts}).drop("__clean").withColumn("mode", F.lit("deidentified"))
