"""The signal store: windows as long samples in Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of a row group: the least that a reader of a short time range has to take.
ROW_GROUP = 8 << 20


def write_samples(samples: DataFrame, path: str, files: int | None = None) -> None:
    """Each (data_uri, t, sample_idx, channel) once, as zstd Parquet clustered by data_uri and time; rows of points refer to the data_uri.

    One shuffle: ranges of (data_uri, t) hold what is equal together, so repeats go inside a range; a range is one folder (``part``) of files in that order
    with small row groups. The extents of the parts lie beside them, so that a reader opens only the files that it wants.
    """
    keys = ["data_uri", "t"]
    ranged = samples.repartitionByRange(files, *keys) if files else samples.repartitionByRange(*keys)
    once = ranged.dropDuplicates([*keys, "sample_idx", "channel"]).withColumn("part", F.spark_partition_id())
    once.sortWithinPartitions("part", *keys, "channel").write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("part").parquet(f"{path}/samples")
    extent = F.struct(*keys)
    written = samples.sparkSession.read.parquet(f"{path}/samples").groupBy("part").agg(F.min(extent).alias("lo"), F.max(extent).alias("hi"), F.min("t").alias("from_t"), F.max("t").alias("to_t"))
    written.select("part", F.col("lo.data_uri").alias("from_uri"), F.col("hi.data_uri").alias("to_uri"), "from_t", "to_t").coalesce(1).write.parquet(f"{path}/parts")


def select_samples(samples: DataFrame, channels: list[str] | None = None, time_range: tuple[float, float] | None = None, uris: list[str] | None = None) -> DataFrame:
    """A projection of channels, a closed time range and windows; all reach the Parquet scan. Missing units read ``unknown``."""
    out = samples
    if uris is not None:
        out = out.filter(F.col("data_uri").isin(uris))
    if channels is not None:
        out = out.filter(F.col("channel").isin(channels))
    if time_range is not None:
        out = out.filter(F.col("t").between(*map(float, time_range)))
    return out.withColumn("unit", F.coalesce("unit", F.lit("unknown"))) if "unit" in out.columns else out


def read_samples(spark: SparkSession, path: str, channels: list[str] | None = None, time_range: tuple[float, float] | None = None, uris: list[str] | None = None) -> DataFrame:
    """From a store that `write_samples` made. Parts that cannot hold what is wanted are pruned when the query runs, row groups by their statistics."""
    parts = spark.read.parquet(f"{path}/parts")
    if time_range is not None:
        lo, hi = map(float, time_range)
        parts = parts.filter((F.col("from_t") <= hi) & (F.col("to_t") >= lo))
    if uris is not None:
        parts = parts.filter(reduce(lambda a, b: a | b, [F.lit(u).between(F.col("from_uri"), F.col("to_uri")) for u in uris], F.lit(False)))
    wanted = select_samples(spark.read.parquet(f"{path}/samples"), channels, time_range, uris)
    if time_range is None and uris is None:
        return wanted.drop("part")
    # one row for each folder of the store: the size of the folder listing that the driver holds anyway
    return wanted.join(F.broadcast(parts.select("part")), "part", "left_semi").drop("part")


def infer_sample_rate(samples: DataFrame, digits: int | None = 0) -> DataFrame:
    """1 / median of the positive steps of time, rounded; windows with fewer than two samples have no row's step and no rate."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("data_uri").orderBy("sample_idx"))
    rates = samples.select("data_uri", step.alias("dt")).filter("dt > 0").groupBy("data_uri").agg((1 / F.median("dt")).alias("sample_rate"))
    return rates if digits is None else rates.withColumn("sample_rate", F.round("sample_rate", digits))
