"""What the corpus operators share: stored intermediate tables and numpy views of text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all operators of this subpackage take it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy helpers look at in one step.
STEP_BYTES = 1 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for local masters a folder of ours."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = tempfile.mkdtemp(prefix="spark-atriaflow-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/atriaflow-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once all that was read from them is stored itself."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            java = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            java.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(java, True)


def renewed(df: DataFrame) -> DataFrame:
    """df with columns of its own, for co-groups of two tables that come from one."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def unused(df: DataFrame, n: int) -> list[str]:
    """n column names that df does not have."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"__own{i}") not in taken:
            out.append(name)
        i += 1
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(col: str = "doc_id") -> Column:
    """doc_id for comparisons of order: rows without one come after all others."""
    return F.coalesce(F.col(col), F.lit(2**63 - 1))


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- numpy views of Arrow text columns ------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE modulo 2^64 and their inverses, for exponents below n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, STEP_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def steps(offs: np.ndarray, limit: int = STEP_BYTES):
    """Runs of rows (lo, hi) whose bytes are at most limit; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of rows lo..hi of a text column: byte ranges, the row bounds in words, 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lo: int, hi: int):
        self.data = data = raw[offs[lo] : offs[hi]]
        self.rows = rows = offs[lo : hi + 1] - offs[lo]
        space = _SPACE[data]
        before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        at = rows[:-1][rows[:-1] < len(data)]
        before[at] = True
        at = rows[1:][rows[1:] > 0] - 1
        after[at] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.bounds = np.searchsorted(self.start, rows)

    def hashes(self) -> np.ndarray:
        up, down = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each item, its row, where row i has the items bounds[i]..bounds[i+1]."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items, for each start; the last n-1 starts are left out."""
    if len(x) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(x) - n + 1, dtype=np.uint64)
    for j in range(n):
        h *= np.uint64(0x100000001B3)
        h += x[j : len(x) - n + 1 + j]
    return mix64(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive items."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out
