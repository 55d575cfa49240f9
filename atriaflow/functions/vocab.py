"""Vocabulary and conditioning of exported quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atriaflow.functions.columns import mask_sentinels


def classify_primary(scalars: DataFrame) -> DataFrame:
    """What the overloaded primary slot of each map holds: map_id, kind, sign. values are masked first.

    -100 <= least < 0 and largest <= 0 mean a pace score stored with its sign flipped; anything else is an activation time.
    """
    v = mask_sentinels(F.col("value"))
    r = scalars.groupBy("map_id").agg(F.min(v).alias("least"), F.max(v).alias("most"))
    score = F.coalesce((F.col("least") >= -100) & (F.col("least") < 0) & (F.col("most") <= 0), F.lit(False))
    return r.select("map_id", F.when(score, "pacemap_score").otherwise("activation_time").alias("kind"), F.when(score, -1).otherwise(1).alias("sign"))


def decoded(scalars: DataFrame) -> DataFrame:
    """P2 applied: scalars with name and value decoded by their map's verdict."""
    verdict = classify_primary(scalars)
    return scalars.join(verdict, "map_id").select("map_id", "vertex_id", F.col("kind").alias("name"), (mask_sentinels(F.col("value")) * F.col("sign")).alias("value"))


def resolve(df: DataFrame, token: str, lexicon: DataFrame, domain: str) -> DataFrame:
    """Kind, unit and field name of vendor tokens: trimmed and case-folded lookup, ``unknown`` on a miss."""
    lex = lexicon.filter(F.col("domain") == domain).select(F.lower(F.trim("token")).alias("__token"), F.col("kind").alias("__kind"), F.col("unit").alias("__unit"))
    met = df.join(lex, F.lower(F.trim(F.col(token))) == F.col("__token"), "left")
    kind = F.coalesce("__kind", F.lit("unknown"))
    return met.withColumn("kind", kind).withColumn("unit", F.coalesce("__unit", F.lit("unknown"))).withColumn("field_name", F.when(kind == "unknown", F.col(token)).otherwise(kind)).drop("__token", "__kind", "__unit")


def legacy_scalar(fields: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """P5: the field that an old name means in each map: the first kind of the alias list that the map carries.

    fields(map_id, name, kind, position), aliases(alias, kind, priority).
    """
    wanted = aliases.filter(F.col("alias") == name.lower()).select("kind", "priority")
    return fields.join(wanted, "kind").groupBy("map_id").agg(F.min(F.struct("priority", "position", "name")).alias("b")).select("map_id", F.col("b.name").alias("name"))


def register_columns(colours: DataFrame, lexicon: DataFrame, domain: str) -> DataFrame:
    """Named mesh columns as fields. colours(map_id, column, position, vertex_id, value).

    Columns without any value are left out. A declared column has its kind's name; of two that claim a name the first declared one
    wins, and the loser keeps its vendor token. An all-negative score column is flipped.
    """
    v = mask_sentinels(F.col("value"))
    stats = colours.groupBy("map_id", "column", "position").agg(F.count(v).alias("n"), F.max(v).alias("most")).filter("n > 0")
    named = resolve(stats, "column", lexicon, domain)
    claim = Window.partitionBy("map_id", "field_name").orderBy("position")
    named = named.withColumn("rank", F.row_number().over(claim))
    sign = F.when((F.col("kind") == "pacemap_score") & (F.col("most") <= 0), -1).otherwise(1)
    fields = named.select("map_id", "column", "kind", "unit", F.when(F.col("rank") == 1, F.col("field_name")).otherwise(F.col("column")).alias("name"), sign.alias("sign"))
    return colours.join(fields, ["map_id", "column"]).select("map_id", "vertex_id", "name", "kind", "unit", (v * F.col("sign")).alias("value"), F.concat(F.lit("column:"), "column").alias("source"))


def measured_field(points: DataFrame, name: str) -> DataFrame:
    """The value of a quantity at the points: by name, else the first measurement of that kind; points without it are left out."""
    by_kind = F.get(F.filter(F.map_values("measurements"), lambda m: m["kind"] == name), F.lit(0))["value"]
    value = F.coalesce(F.try_element_at("measurements", F.lit(name))["value"], by_kind)
    return points.select("map_id", "point_index", "x", "y", "z", value.alias("value")).filter("value IS NOT NULL")


def decode_point_annotations(raw_points: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per point, time or score from map - reference annotation; |difference| >= 10000 is missing.

    On a pace map: if any difference is negative, positive ones are missing; scores outside 0..100 are missing.
    raw_points(map_id, point_index, reference, map_annotation), verdicts(map_id, kind).
    """
    diff = F.when(F.abs(F.col("map_annotation") - F.col("reference")) < 10000, F.col("map_annotation") - F.col("reference"))
    keyed = raw_points.withColumn("diff", diff)
    signs = keyed.groupBy("map_id").agg(F.max(F.col("diff") < 0).alias("any_negative"))
    met = keyed.join(signs, "map_id").join(verdicts.select("map_id", "kind"), "map_id")
    score = F.when(~(F.col("any_negative") & (F.col("diff") > 0)), F.abs("diff"))
    value = F.when(F.col("kind") == "pacemap_score", F.when(score.between(0, 100), score)).otherwise(F.col("diff"))
    return met.select("map_id", "point_index", "kind", value.cast("double").alias("value"))


def point_annotations(names: list[str], *cols: Column, markers: tuple = ("reference", "map")) -> Column:
    """A map of the annotations that are there; -10000 in a marker means none; whole numbers are written without decimals."""
    kept = []
    for n, c in zip(names, cols):
        c = F.when(c != -10000, c) if n in markers else c
        kept.append(F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")))
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*kept)), lambda k, v: v.isNotNull())


#: A file stem's suffix that names its polarity, with the letters that exports lose.
BIPOLAR_SUFFIX = r"(?i)[-_ ]?(?:bi?polar|bipol|bi)$"
UNIPOLAR_SUFFIX = r"(?i)[-_ ]?(?:uni?polar|unipol|uni)$"
#: Tokens that name the type of a map.
TYPE_TOKENS = ["voltage", "remap", "premap", "vt", "stim", "lvstim", "rvstim", "deep", "pre"]
#: Polarity, quantity.
POLARITY_KINDS = {"bi": "voltage_bipolar", "bipolar": "voltage_bipolar", "omni": "voltage_bipolar", "uni": "voltage_unipolar", "unipolar": "voltage_unipolar"}
#: Channel of a point export, quantity.
DXL_CHANNELS = {
    "lat": "activation_time",
    "score": "map_score",
    "cfemean": "cfe_mean",
    "cfestddev": "cfe_stddev",
    "fractionation": "fractionation",
    "pfreq": "peak_frequency",
    "pneg": "voltage_peak_negative",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def split_polarity(stem: Column) -> tuple[Column, Column]:
    """The stem without its polarity suffix, and the polarity (null without a suffix)."""
    polarity = F.when(stem.rlike(BIPOLAR_SUFFIX), "bipolar").when(stem.rlike(UNIPOLAR_SUFFIX), "unipolar")
    base = F.when(polarity == "bipolar", F.regexp_replace(stem, BIPOLAR_SUFFIX, "")).when(polarity == "unipolar", F.regexp_replace(stem, UNIPOLAR_SUFFIX, ""))
    return F.coalesce(base, stem), polarity


def describe_files(files: DataFrame, col: str = "stem") -> DataFrame:
    """group_key, polarity, part, type_tokens and kind of file stems.

    The suffix says the polarity; without one the last token that begins with uni or bi does. The group key is the stem without
    its suffix. The kind is the polarity's voltage, bipolar if nothing is said.
    """
    base, suffix = split_polarity(F.col(col))
    tokens = F.filter(F.split(F.regexp_replace(col, r"(?i)^Contact_Mapping_Model_?", ""), r"[_\-\s]+"), lambda t: t != "")
    low = F.transform(tokens, F.lower)
    named = F.element_at(F.filter(low, lambda t: t.startswith("uni") | t.startswith("bi")), -1)
    polarity = F.coalesce(suffix, F.when(F.size(F.filter(low, lambda t: t.startswith("uni") | t.startswith("bi"))) > 0, F.when(named.startswith("uni"), "unipolar").otherwise("bipolar")))
    part = F.when(F.array_contains(low, "endo"), "endo").when(F.array_contains(low, "epi"), "epi")
    typed = F.filter(low, lambda t: F.exists(F.array(*map(F.lit, TYPE_TOKENS)), lambda x: t.contains(x)))
    out = files.withColumns({"group_key": base, "polarity": polarity, "part": part, "type_tokens": typed})
    return out.withColumn("kind", F.coalesce(lookup(POLARITY_KINDS, F.col("polarity")), F.lit("voltage_bipolar")))


def dxl_quantity(map_type: Column, value_column: Column) -> tuple[Column, Column]:
    """Kind and measurement name of a point export's map type; only pp takes its kind from the polarity.

    Other channels keep the bare name when bipolar and end in _uni when unipolar; unknown ones keep the export's column name.
    """
    base, polarity = split_polarity(map_type)
    channel = F.lower(F.trim(F.when(base == "", map_type).otherwise(base)))
    kind = F.coalesce(F.when(channel == "pp", lookup(POLARITY_KINDS, polarity)).otherwise(lookup(DXL_CHANNELS, channel)), F.lit("unknown"))
    name = F.when(kind == "unknown", value_column).otherwise(kind)
    return kind, F.when((channel != "pp") & (polarity == "unipolar"), F.concat(name, F.lit("_uni"))).otherwise(name)


#: Patterns on the upper-case map and study name, and the chamber they mean; the first match counts.
ATRIUM_PATTERNS = [
    (r"\bVT\b", "LV"),
    (r"\bLA\b|LEFT[\s_-]*ATRI|RE[-]?LA\b", "LA"),
    (r"\bRA\b|RIGHT[\s_-]*ATRI|RE[-]?RA\b", "RA"),
    (r"\bVERA\b", "LA"),
]
#: Patterns on the upper-case map name and the region they mean; the first match counts, "" is the whole chamber.
PART_PATTERNS = [
    (r"\bALLES\b|\bALL\b|\bFULL\b", ""),
    (r"POST(?:ERIOR)?[\s_-]*INF(?:ERIOR)?|POST[\s_-]*INF", "posterior inferior wall"),
    (r"POST(?:ERIOR)?[\s_-]*WALL|[\s_-]PW\b", "posterior wall"),
    (r"ANT(?:ERIOR)?[\s_-]*WALL|[\s_-]AW\b", "anterior wall"),
    (r"LAT(?:ERAL)?[\s_-]*WALL", "lateral wall"),
    (r"\bROOF\b|\bDACH\b", "roof"),
    (r"\bFLOOR\b|\bBODEN\b", "floor"),
    (r"SEPT(?:AL)?[\s_-]*WALL?|[\s_-]SEP\b", "septal wall"),
    (r"INF(?:ERIOR)?[\s_-]*WALL", "inferior wall"),
    (r"\bISTHMUS\b", "isthmus"),
    (r"[\s_-]POST\b|^POST\b|\bPOSTERIOR\b", "posterior wall"),
    (r"[\s_-]ANT\b|^ANT\b|\bANTERIOR\b", "anterior wall"),
    (r"[\s_-]LAT\b|^LAT\b|\bLATERAL\b", "lateral wall"),
    (r"[\s_-]SEP\b|^SEP\b|\bSEPTAL\b", "septal wall"),
    (r"\bINFERIOR\b", "inferior wall"),
]
#: The right atrium has no anterior wall.
RA_FRONT, RA_FRONT_PART = r"ANT(?:ERIOR)?", "lateral wall"
#: Patterns on the upper-case map name and the type of map they mean; the first match counts.
TYPE_PATTERNS = [
    (r"\bICPM\b|IC[\s_-]*PM\b|IC[\s_-]*PACE|IC[\s_-]*PATTERN|PATTERN[\s_-]*MATCH|PACE[\s_-]*MAP\b|PACE[\s_-]*PATTERN\b|PACEMAP\b|PACEPM", "pacemapping"),
    (r"\bAFIB\b|AF\b|ATRIAL\s+FIB", "AFIB"),
    (r"\bAFL\b|FLUTTER|ATRIAL\s+FLUTTER", "flutter"),
    (r"\bVT\b|VENTRICULAR\s+TACH", "VT"),
    (r"\bBIPOLAR\b", "voltage"),
    (r"\bSR\b|\bSINUS\b", "activation-SR"),
    (r"\bRPV\b|\bLPV\b|\bPVI\b|PULMONARY\s+VEIN", "PV-isolation"),
    (r"RE[\s_-]?(LA|RA|IC|PV)\b|REANNOTATION", "reannotation"),
]


def first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that the text matches, else null."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def tag_by_name(maps: DataFrame) -> DataFrame:
    """Atrium, part and map_type of maps(map_name, study_name); part is "" where the name says the whole chamber."""
    name = F.upper("map_name")
    out = maps.withColumn("atrium", first_match(F.upper(F.concat_ws(" ", F.coalesce("map_name", F.lit("")), F.coalesce("study_name", F.lit("")))), ATRIUM_PATTERNS))
    front = (F.col("atrium") == "RA") & name.rlike(RA_FRONT)
    return out.withColumn("part", F.when(front, RA_FRONT_PART).otherwise(first_match(name, PART_PATTERNS))).withColumn("map_type", first_match(name, TYPE_PATTERNS))
