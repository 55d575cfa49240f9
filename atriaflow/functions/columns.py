"""Column expressions: missing values, sentinels, channel names, units, clock times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null unless the number is finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def mask_sentinels(c: Column, limit: float = 10000.0) -> Column:
    """Values at or beyond +-limit stand for "not measured"."""
    return F.when(F.abs(c) < limit, c)


def split_channel(c: Column) -> Column:
    """``name(id)`` -> struct(name, id); without an id the whole text is the name."""
    name = F.regexp_extract(c, r"^\s*(.*?)\s*\(\s*([^()]*?)\s*\)\s*$", 1)
    ident = F.regexp_extract(c, r"^\s*(.*?)\s*\(\s*([^()]*?)\s*\)\s*$", 2)
    has = c.rlike(r"^\s*.*?\s*\(\s*[^()]*?\s*\)\s*$")
    return F.struct(F.when(has, name).otherwise(F.trim(c)).alias("name"), F.when(has, ident).alias("id"))


def unipoles(bipole: Column) -> Column:
    """The two unipole labels of a bipole label ``<lead> a-b`` -> [``<lead> a``, ``<lead> b``]; null if it names none."""
    lead = F.regexp_extract(bipole, r"^(.*?)([A-Za-z]?\d+)-([A-Za-z]?\d+)$", 1)
    one = F.regexp_extract(bipole, r"^(.*?)([A-Za-z]?\d+)-([A-Za-z]?\d+)$", 2)
    two = F.regexp_extract(bipole, r"^(.*?)([A-Za-z]?\d+)-([A-Za-z]?\d+)$", 3)
    return F.when(one != "", F.array(F.concat(lead, one), F.concat(lead, two)))


#: Time-series column without prefix and suffix, its unit.
CHANNEL_UNITS = {
    "totalforce": "g",
    "meantotalforce": "g",
    "lateralforce": "g",
    "axialforce": "g",
    "forcetimeintegral": "g*s",
    "alphaangle": "deg",
    "thetaangle": "deg",
    "cavitydistance1": "mm",
    "cavitydistance2": "mm",
    "cavitydistance3": "mm",
    "thermocouple1temp": "degC",
    "thermocouple2temp": "degC",
    "thermistortemp": "degC",
    "ablduration": "s",
    "tx": "mm",
    "ty": "mm",
    "tz": "mm",
    "anglefrommidline": "deg",
}


def channel_unit(c: Column) -> Column:
    """The unit of a time-series column, from its name without ``c<n>_`` before and ``_<n>`` after it; status columns have none."""
    name = F.trim(c)
    bare = F.lower(F.regexp_replace(F.regexp_replace(name, r"(?i)^c\d+_", ""), r"_\d+$", ""))
    units = F.create_map(*[F.lit(x) for kv in CHANNEL_UNITS.items() for x in kv])
    known = F.when(name.rlike(r"(?i)^c\d+[xyz]$"), "mm").otherwise(F.coalesce(F.try_element_at(units, bare), F.lit("unknown")))
    return F.when(name.rlike(r"_(ds|ps)$"), "unknown").otherwise(known)


def cloud_unit(c: Column) -> Column:
    """Registered positions (``trn_``) are in mm, the tracking frame names no scale."""
    return F.when(F.lower(F.trim(c)).startswith("trn_"), "mm").otherwise("unknown")


def wallclock_seconds(df: DataFrame, clock: str, keys: list[str]) -> DataFrame:
    """P20: ``HH:MM:SS.mmm`` texts as seconds from the first of their keys, in column ``seconds``."""
    parts = F.split(clock, ":")
    day = F.get(parts, F.lit(0)).try_cast("double") * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.get(parts, F.lit(2)).try_cast("double")
    keyed = df.withColumn("__day", day)
    first = keyed.groupBy(*keys).agg(F.min("__day").alias("__first"))
    return keyed.join(first, keys).withColumn("seconds", F.col("__day") - F.col("__first")).drop("__day", "__first")


def start_time(secs: Column, usecs: Column) -> Column:
    """P20: absolute start in seconds."""
    return secs.cast("double") + usecs.cast("double") / 1e6


def ms_to_sample(ms: Column, rate: Column) -> Column:
    """P20: the sample of a time in ms at a rate in Hz; halves go to the even sample."""
    return F.bround(ms * rate / 1000.0).cast("long")


def to_standard_unit(df: DataFrame, factors: DataFrame, value: str, quantity: str, unit: str) -> DataFrame:
    """P10: ``standard`` = value in the quantity's standard unit; null with a ``note`` where the unit is unknown.

    factors(quantity, unit, factor) is the small vocabulary table; Spark broadcasts it by its size.
    """
    f = factors.select(F.col("quantity").alias("__q"), F.col("unit").alias("__u"), "factor")
    joined = df.join(f, (F.col(quantity) == F.col("__q")) & (F.col(unit) == F.col("__u")), "left")
    note = F.when(F.col(unit).isNull(), F.lit("unit not declared")).when(F.col("factor").isNull(), F.concat(F.lit("unit not supported: "), F.col(unit)))
    return joined.withColumn("standard", F.col(value) * F.col("factor")).withColumn("note", note).drop("__q", "__u", "factor")


def apply_status(value: Column, valid: Column) -> Column:
    """Null where the vertex is marked invalid."""
    return F.when(F.coalesce(valid, F.lit(True)), value)
