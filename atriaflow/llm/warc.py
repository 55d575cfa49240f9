"""WARC archives: write pages as records, read records back by boundary-chain verification.

Writing: one record per row, laid down by Spark's text writer (the record separator is the line separator), so
each task writes its own archives. Rows with equal payloads become one response and revisits of it.

Reading: the text reader splits the bytes at each ``WARC/1.``. Every piece is a *candidate* record: its header
names the length of its block, hence the offset of its successor. Pointer jumping from offset 0 of a file over
(offset, successor) pairs keeps only what the chain reaches, so a payload that holds record headers, even whole
records, yields none. Pairs are a few dozen bytes each; payloads never enter a group, but for records that
hold the magic and so span several pieces.

Defined cases: null html is an empty payload; null url leaves out Target-URI; line breaks and blanks in a url are
percent-encoded; a null page_id is written without an id and read back as null, and is never a revisit's target
unless no row of its group has an id, in which case all rows of the group are responses; rows that repeat the
smallest page_id of their group are all responses. An archive whose chain breaks yields the records before the
break. An empty table makes empty archives and no records. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, stored

MAGIC = "WARC/1."
CRLF = "\r\n"
GAP = "\r\n\r\n"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "application/http; msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a hex SHA-1: 8 groups of 20 bits, 4 letters each."""

    def four(g: Column) -> Column:
        bits = F.conv(F.substring(digest, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_B32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def with_base32(df: DataFrame, name: str, data: Column) -> DataFrame:
    """df with the base32 SHA-1 of data; the digest is a projection of its own, so that it is made once a row."""
    return df.withColumn("sha1_hex", F.sha1(data)).withColumn(name, base32(F.col("sha1_hex"))).drop("sha1_hex")


def _uuid(of: Column) -> Column:
    h = F.md5(of.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit(">" if a == 21 else "-"))])


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload binary) with refers_to: the page_id that a revisit repeats, else null.

    The first page of each payload is found with partial aggregates of (digest, min id), so copies meet only as
    one row per task; only payloads that occur twice or more are joined back, from a stored table with one row for each, so that
    Spark can split the pages of a hot payload.
    """
    keyed = pages.withColumn("payload_key", F.sha2("payload", 256))
    again = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("payload_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    again = stored(again, "again")
    return keyed.join(again, "payload_key", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("payload_key", "first_id")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0, compression: str = "gzip") -> None:
    """Write a record per row of pages (page_id, url, html) to archives below path."""
    url = pages["url"].cast("string")
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(raw), F.lit(code))
    rows = revisits(pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload")), min_revisit_bytes)
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(GAP))
    rows = with_base32(rows, "digest", F.col("payload")).withColumn("http", http).withColumn("body", F.when(is_revisit, F.lit("")).otherwise(F.col("payload").cast("string")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit(""))

    page = F.col("page_id").cast("string")
    head = F.concat(
        F.lit(f"{MAGIC}0"),
        field("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _uuid(F.concat_ws("|", F.lit("page"), page, F.coalesce("url", F.lit(""))))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(is_revisit, F.lit(_PROFILE))),
        field("Refers-To-Page-Id", F.col("refers_to").cast("string")),
        field("Page-Id", page),
        field("Content-Type", F.lit(_HTTP)),
        field("Content-Length", (F.octet_length("http") + F.octet_length("body")).cast("string")),
    )
    rows.select(F.concat(head, F.lit(GAP), "http", "body").alias("value")).write.option("lineSep", GAP).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _placed(pieces: DataFrame, length: Column) -> DataFrame:
    """start: the offset of the piece's magic; -1 for what stands before the first magic of the file."""
    by_file = Window.partitionBy("file").orderBy("block", "seq")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(by_file)
    return pieces.withColumn("start", F.when(nth == 1, F.lit(-1)).otherwise(F.coalesce(F.sum(length + len(MAGIC)).over(before), F.lit(0)) - len(MAGIC)).cast("long"))


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\n{name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r|$)", 1)
    return F.when(found != "", found)


def _payload_of(block: Column, content_type: Column) -> tuple[Column, Column]:
    """The payload of a record's block, and the HTTP header before it (empty if the block is no HTTP message)."""
    http = F.when(F.coalesce(F.lower(content_type), F.lit("")).startswith("application/http"), F.substring_index(block.cast("string"), GAP, 1)).otherwise(F.lit(""))
    skip = F.when(http != "", F.octet_length(http) + len(GAP)).otherwise(F.lit(0))
    return F.substring(block, skip + 1, F.octet_length(block)), http


def _described(pieces: DataFrame) -> DataFrame:
    """What a piece claims as a record: header fields, block length, and what its own bytes give as payload."""
    head = F.substring_index("value", GAP, 1)
    size = F.octet_length("value")
    out = pieces.withColumn("head", head).withColumn("head_bytes", F.octet_length("head").cast("long"))
    out = out.withColumn("block_bytes", F.when(F.col("head").rlike(r"^[01]\r\n") & (F.col("head_bytes") + len(GAP) <= size), F.expr(r"try_cast(regexp_extract(head, '(?i)\\ncontent-length:[ \\t]*([0-9]+)[ \\t]*(\\r|$)', 1) AS long)")))
    own = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + len(GAP) + 1).cast("int"), F.coalesce(F.col("block_bytes"), F.lit(0)).cast("int"))
    whole = F.col("head_bytes") + len(GAP) + F.col("block_bytes") <= size
    kind = _header(F.col("head"), "content-type")
    out = out.withColumn("content_type", kind).withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("own", own)
    payload, http = _payload_of(F.col("own"), F.col("content_type"))
    out = out.withColumn("http", http).withColumn("payload", payload)
    out = with_base32(out, "payload_digest", F.when(F.col("whole"), F.col("payload")))
    return out.select(
        "file", "block", "seq", size.cast("long").alias("bytes"), "head_bytes", "block_bytes",
        "whole", "content_type",
        _header(F.col("head"), "warc-type").alias("record_type"), _header(F.col("head"), "warc-record-id").alias("record_id"), _header(F.col("head"), "warc-target-uri").alias("url"),
        F.regexp_replace(_header(F.col("head"), "warc-payload-digest"), "^sha1:", "").alias("declared_digest"),
        _header(F.col("head"), "page-id").try_cast("long").alias("page_id"), _header(F.col("head"), "refers-to-page-id").try_cast("long").alias("refers_to"),
        F.when(F.col("whole"), F.octet_length("payload").cast("long")).alias("payload_bytes"), "payload_digest",
        F.regexp_extract("http", r"(?i)\ncontent-length:[ \t]*(\d+)", 1).try_cast("long").alias("http_bytes"),
    )


def reachable(start: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Pointer jumping: which of the candidates (ascending starts) the chain from offset 0 reaches.

    After round k all candidates within 2^k steps of the file's start are marked and every pointer spans 2^k.
    """
    n = len(start)
    at = np.searchsorted(start, successor)
    at = np.where((at < n) & (start[np.minimum(at, n - 1)] == successor), at, n) if n else at
    jump, seen = np.append(at, n), np.zeros(n + 1, dtype=bool)
    seen[:n] = start == 0
    for _ in range(max(1, n).bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("start")
    keep = reachable(group["start"].to_numpy(), group["successor"].to_numpy())
    return group[keep]


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record that the chain from its file's start reaches: file, start, record_type, record_id, url,
    page_id, refers_to, payload_bytes, payload_digest, declared_digest, and payload (binary) if asked for.

    A revisit's payload_bytes and payload_digest are those it declares for the full payload.
    """
    placed = stored(_placed(_described(_pieces(spark, path)), F.col("bytes")).filter("start >= 0"), "candidates")
    pairs = placed.filter("block_bytes IS NOT NULL").select("file", "start", (F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("block_bytes") + 2 * len(GAP)).alias("successor"))
    chain = pairs.groupBy("file").applyInPandas(_chain, T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("successor", T.LongType())]))
    records = placed.join(chain, ["file", "start"])
    spanning = F.lit(True) if with_payload else ~F.col("whole")
    records = stored(records, "records")
    out = records.withColumn("payload", F.lit(None).cast("binary"))
    if with_payload or not records.filter(spanning).isEmpty():
        out = out.filter(~spanning).unionByName(_gathered(spark, path, records.filter(spanning)))
    revisit = F.col("record_type") == "revisit"
    out = out.withColumn("payload_bytes", F.when(revisit, F.col("http_bytes")).otherwise(F.col("payload_bytes"))).withColumn("payload_digest", F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")))
    cols = ["file", "start", "record_type", "record_id", "url", "page_id", "refers_to", "payload_bytes", "payload_digest", "declared_digest"]
    return out.select(*cols, *["payload"] * with_payload)


def _gathered(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Read again the files of records whose bytes lie in several pieces, and put each record's pieces together."""
    files = records.select("file").distinct()
    pieces = _placed(_pieces(spark, path).join(files, "file", "left_semi"), F.octet_length("value").cast("long")).filter("start >= 0").select("file", F.col("start").alias("piece"), "value")
    # a record starts at a piece; its other pieces are those up to the next record's
    spans = records.select("file", F.col("start").alias("piece"), F.struct(F.col("start").alias("piece"), "successor").alias("span"))
    upto = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    own = pieces.join(spans, ["file", "piece"], "left").withColumn("span", F.last("span", ignorenulls=True).over(upto)).filter("piece < span.successor")
    joined = own.groupBy("file", F.col("span.piece").alias("start")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    both = records.drop("payload_bytes", "payload_digest", "http_bytes").join(joined, ["file", "start"])
    block = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + len(GAP) + 1).cast("int"), F.col("block_bytes").cast("int"))
    payload, http = _payload_of(block, F.col("content_type"))
    both = both.withColumn("payload", payload).withColumn("http_bytes", F.regexp_extract(http, r"(?i)\ncontent-length:[ \t]*(\d+)", 1).try_cast("long")).drop("value")
    return with_base32(both.withColumn("payload_bytes", F.octet_length("payload").cast("long")), "payload_digest", F.col("payload"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _oracle() -> str:
    bits = "('0x' || substr(s, {}, 5))::BIGINT"
    letters = " || ".join(f"substr('{_B32}', (({bits.format(1 + 5 * g)} >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {letters} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f"""


ORACLE = _oracle()
