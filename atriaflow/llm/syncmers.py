"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers (by hash) is its first or last. Whether a k-mer is
chosen depends on itself alone, so texts that share a stretch of k code points share the anchors in it, wherever it stands. Of
k - s + 1 k-mers in a row one is a syncmer, so every code point is in an anchor, but for at most k - s at either end. The fingerprint
of a text keeps all its syncmers by position, 16 hex digits each: 10 of the hash, 6 of the distance from the one before. Two
fingerprints are matched by position: the longest chain of anchors that keeps its order in both texts counts, over the anchors of either.

A caller may ask for a sample of one in `density` anchors: those whose hash is below a fixed threshold (so anchors grow with the
text), and in short texts at least those of the LEAST least hashes, with all their positions. The sample is coordinated: below the
lower of two texts' thresholds both fingerprints hold every anchor, and these are compared. The query asks for all.

The text that follows a document (descending doc_id) is found without a global window. Rows drawn by a sample, and the very first, bound the
ranges of the order (id, hash of text); a row goes to its range, and a row that bounds a range goes to the range before too, where it
follows the last row (the very first follows the very last). So each range has what it needs, and one exchange and one sort suffice.

Defined cases: null text is empty; an empty text has the empty fingerprint, likeness 1 to another empty one and 0 to others; a
text shorter than k code points has one anchor, itself; null ids come after all others (descending); rows with equal ids are
ordered by hash of text; a single document follows itself; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64, sliding_min, steps, text_arrays

K, S = 12, 5
#: Distinct anchors that short texts have at least in a sample, where they have so many.
LEAST = 48
_ALL = np.uint64(2**64 - 1)
#: Code points that the numpy steps take at once.
STEP_CHARS = 1 << 18
#: Ranges of documents at most, whatever the table's size: their bounds are on the driver and in every task. A range is sorted by Spark and streamed, so it may be large.
MOST_RANGES = 1 << 14


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for j in range(n):
        h *= np.uint64(0x100000001B3)
        h += codes[j : len(codes) - n + 1 + j]
    return mix64(h)


def _syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the closed syncmers among the k-mers of codes."""
    inner = _rolling(codes, S)
    if len(codes) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = K - S + 1
    least = sliding_min(inner, width)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    # the k-mer's own hash, from the s-mers at its ends and its middle, which cover it
    whole = inner[at] + mix64(inner[at + S // 2 + 2] + np.uint64(1)) + mix64(inner[at + width - 1] + np.uint64(2))
    return at, mix64(whole)


class Fingerprint:
    """Anchors by position: hashes and positions, and the threshold up to which the text has no others."""

    def __init__(self, h: np.ndarray, at: np.ndarray, density: int = 1):
        """Of the hashes h at the places `at` (ascending), all, or those below the threshold of a sample of one in `density`."""
        self.limit = _ALL
        if density > 1:
            below = np.uint64(2**64 // density)
            values = np.unique(h) if np.count_nonzero(h <= below) < 2 * LEAST else h
            self.limit = below if values is h else max(below, values[LEAST - 1]) if len(values) >= LEAST else _ALL
        drawn = h <= self.limit
        self.h, self.at = h[drawn], at[drawn]
        self._own: tuple[np.ndarray, np.ndarray] | None = None

    def __str__(self) -> str:
        gaps = np.diff(self.at, prepend=0).astype(np.uint64) & np.uint64(0xFFFFFF)
        return ((self.h >> np.uint64(24) << np.uint64(24)) | gaps).astype(">u8").tobytes().hex()

    def _upto(self, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Hashes up to the limit mixed with their occurrence number, and positions, by hash."""
        if limit == self.limit:
            if self._own is None:
                self._own = self._by_hash(limit)
            return self._own
        return self._by_hash(limit)

    def _by_hash(self, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        keep = self.h <= limit
        h, at = self.h[keep], self.at[keep]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        first = np.searchsorted(h, h)
        return h + (np.arange(len(h)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), at

    def likeness(self, other: Fingerprint) -> float:
        if not len(self.h) or not len(other.h):
            return float(not len(self.h) and not len(other.h))
        limit = min(self.limit, other.limit)
        (h, at), (other_h, other_at) = self._upto(limit), other._upto(limit)
        _, mine, theirs = np.intersect1d(h, other_h, return_indices=True)
        places = other_at[theirs][np.argsort(at[mine])]
        # what ascends from the start, or is all, needs no search
        falls = np.flatnonzero(places[1:] < places[:-1])
        chain: list[int] = places[: falls[0] + 1 if len(falls) else len(places)].tolist()
        for p in places[len(chain) :].tolist():
            i = bisect_left(chain, p)
            chain[i : i + 1] = [p]
        drawn = len(h) + len(other_h) - len(mine)
        return len(chain) / drawn if drawn else 0.0


def fingerprints(texts: list[str], density: int = 1) -> list[Fingerprint]:
    out: list[Fingerprint] = []
    run: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        run.append(t)
        size += len(t)
        if size >= STEP_CHARS or i + 1 == len(texts):
            out += _step(run, density)
            run, size = [], 0
    return out


def _step(texts: list[str], density: int) -> list[Fingerprint]:
    bounds = np.cumsum([0, *map(len, texts)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    at, h = _syncmers(codes)
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + K <= bounds[row + 1]
    at, h, row = at[inside], h[inside], row[inside]
    lo = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        if lo[i] < lo[i + 1]:
            out.append(Fingerprint(h[lo[i] : lo[i + 1]], at[lo[i] : lo[i + 1]] - bounds[i], density))
        else:
            # no k-mer, or none with the least inner part at an edge: the text is its own anchor
            own = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")] if t else []
            out.append(Fingerprint(np.array(own, dtype=np.uint64), np.zeros(len(own), np.int64)))
    return out


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bytes of text of a partition of the exchange, ranges for each partition, and rows of the sample for each range.
PARTITION_BYTES, RANGES, SAMPLED = 1 << 27, 4, 8


def _finished(ids: list, texts: list[str], following: list[str], prints: list[Fingerprint], next_prints: list[Fingerprint]) -> dict:
    cut = [edited(t, f) for t, f in zip(texts, following)]
    cut_prints = fingerprints(cut)
    return {
        "doc_id": ids, "n_chars": list(map(len, texts)), "edited_sha256": list(map(_sha, cut)),
        "fingerprint": list(map(str, prints)), "edited_fingerprint": list(map(str, cut_prints)),
        "near_edited": [a.likeness(b) for a, b in zip(prints, cut_prints)], "near_next": [a.likeness(b) for a, b in zip(prints, next_prints)],
    }


def _rows(columns: dict) -> pa.RecordBatch:
    types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.string())) for c, v in columns.items()})


def _stream(it):
    """Sorted rows of whole ranges: each row is finished by the next of its range, the last by the one that only follows."""
    held = None
    # few rows at a time, as their fingerprints are larger than their texts
    for batch in (b.slice(lo, hi - lo) for b in it for lo, hi in steps(text_arrays(b["text"])[1])):
        ids, texts, follows = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()], batch["follows"].to_pylist()
        prints = fingerprints(texts)
        own = ([held] if held else []) + list(zip(ids, texts, prints, follows))
        # equal rows that bound a range follow one another: only the first is what follows
        pairs = [(a, b) for a, b in zip(own, own[1:]) if not a[3]]
        if own:
            held = own[-1]
        if pairs:
            a, b = zip(*pairs)
            yield _rows(_finished([x[0] for x in a], [x[1] for x in a], [x[1] for x in b], [x[2] for x in a], [x[2] for x in b]))


def placed_in(bounds: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys (first, second), the number of the last bound (rows of two, ascending) that is not above it, and whether it is that bound."""
    lo, hi = np.searchsorted(bounds[:, 0], first, "left"), np.searchsorted(bounds[:, 0], first, "right")
    at = lo - 1
    for i in np.flatnonzero(lo < hi):  # keys that share the first part with a bound
        at[i] = lo[i] + np.searchsorted(bounds[lo[i] : hi[i], 1], second[i], "right") - 1
    at = np.maximum(at, 0)
    return at, (bounds[at, 0] == first) & (bounds[at, 1] == second)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # ascending keys: -1 - id, so that no id overflows and rows without one come last
    keyed = plain.withColumns({"first": F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1)), "second": F.xxhash64("text")})
    keys = keyed.select("first", "second")
    n, size = plain.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    wanted = min(RANGES * parts, MOST_RANGES)
    parts = min(parts, wanted)
    sample = keys.sample(min(1.0, SAMPLED * wanted / max(n, 1)), seed=1).toArrow()  # at most SAMPLED * MOST_RANGES rows
    ascending = sorted(set(zip(sample["first"].to_pylist(), sample["second"].to_pylist())))
    least = keys.orderBy("first", "second").limit(1).collect()
    ends = {tuple(r) for r in least} | set(ascending[:: max(1, len(ascending) // wanted)])
    bounds = np.array(sorted(ends), dtype=np.int64).reshape(-1, 2)

    def assign(it):
        for batch in it:
            at, bound = placed_in(bounds, batch["first"].to_numpy(), batch["second"].to_numpy())
            again = np.flatnonzero(bound)
            take = pa.array(np.concatenate([np.arange(len(at)), again]))
            ranges = np.concatenate([at, (at[again] - 1) % len(bounds)])
            yield pa.RecordBatch.from_pydict({"range": pa.array(ranges, pa.int64()), "follows": pa.array(np.arange(len(take)) >= len(at))} | {c: batch[c].take(take) for c in ("first", "second", "doc_id", "text")})

    ranged = keyed.mapInArrow(assign, "range long, follows boolean, first long, second long, doc_id long, text string")
    in_order = ranged.repartition(parts, "range").sortWithinPartitions("range", "follows", "first", "second")
    return in_order.select("doc_id", "text", "follows").mapInArrow(_stream, _KIND)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
