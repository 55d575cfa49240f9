"""Files as arrays of lines: headers, sections and columns are looked up inside the array, and rows are exploded last, so no reader shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value of every file below path: UTF-8, or Latin-1 where that is what the bytes are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(F.col("_metadata.file_path").alias("file"), text.alias("value"))


def file_lines(files: DataFrame) -> DataFrame:
    """files(file, value) -> file, lines array<string>."""
    return files.select("file", F.split("value", r"\r?\n").alias("lines"))


def _hits(lines: Column, test: Test) -> Column:
    return F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False)))


def first_index(lines: str | Column, test: Test) -> Column:
    """The place (from 0) of the first line that passes; null if none does."""
    lines = F.col(lines) if isinstance(lines, str) else lines
    at = F.array_position(_hits(lines, test), True)
    return F.when(at > 0, (at - 1).cast("int"))


def last_index(lines: str | Column, test: Test) -> Column:
    lines = F.col(lines) if isinstance(lines, str) else lines
    at = F.array_position(F.reverse(_hits(lines, test)), True)
    return F.when(at > 0, (F.size(lines) - at).cast("int"))


def first_of(lines: str | Column, test: Test) -> Column:
    """The first line that passes; null if none does."""
    return F.get(F.filter(lines, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(0))


def behind(lines: str | Column, place: Column) -> Column:
    """The lines after a place."""
    return F.slice(lines, place + 2, F.size(lines))


def before(lines: str | Column, place: Column) -> Column:
    return F.slice(lines, F.lit(1), place)


def filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x) != "")


def section(lines: str | Column, name: str) -> Column:
    """The lines of the section ``[name]`` (case ignored); null without it."""
    lines = F.col(lines) if isinstance(lines, str) else lines
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lower(F.regexp_extract(x, r"^\s*\[(\w+)\]", 1)).alias("n"))), lambda h: h["n"] != "")
    start = F.get(F.filter(heads, lambda h: h["n"] == name.lower()), F.lit(0))["i"]
    end = F.coalesce(F.get(F.filter(heads, lambda h: h["i"] > start), F.lit(0))["i"], F.size(lines))
    return F.when(start.isNotNull(), F.slice(lines, start + 2, F.greatest(end - start - 1, F.lit(0))))


def comma_cells(line: Column) -> Column:
    """The trimmed cells of a comma-separated line; quoted cells may hold commas and doubled quotes."""
    quoted = F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.when(F.trim(x).rlike(r'^".*"$'), F.replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.transform(F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",")), lambda x: F.trim(x))


def strict(value: Column, right: Column, message: str) -> Column:
    """value, or an error that names the file where `right` does not hold."""
    return F.when(F.coalesce(right, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(message + " in "), F.col("file"))))
