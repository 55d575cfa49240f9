"""Near-duplicate groups by Order MinHash with banded alignment.

Texts are sequences of words; equal texts are first folded to one representative by their digest. A text's K-word shingles are
labelled with their occurrence number. Each of SKETCHES sketches hashes all labelled shingles, samples the TUPLE least and
hashes these *in text order*: two texts share a sketch if they share the sampled shingles and their order, so the chance follows
edit similarity. At similarity 0.8 a long pair shares a sketch with probability near 0.8^4 = 0.41, and at least one of 24 with
1 - 3e-6. Texts of at most SHORT shingles have exact keys instead: two of them can only be alike in one common run of shingles
(an edit in the middle spoils nine), so every run of at least 0.8 of the shingles is a key.

The rule: two texts are linked if a least-edit alignment of their word sequences, within a band of diagonals as wide as the
threshold allows, matches so many windows of K words that their Jaccard similarity (matched / all) is 0.8 or more. The alignment
decides alone: texts that have the same windows in another order are not linked.

Candidates, never all pairs of a group:
1. In a bucket (the texts of one key) the hub is the member that meets most texts in all its buckets, which is the original where
   others are edited from it. Each text meets the hub of most of its buckets.
2. Buckets with members of two components or more go on by their texts' rarest windows. Of all windows of these
   texts, those of one component are counted out, those that the same texts have are taken together, and texts that keep too few
   for any link go. A link needs a common window among the rarest fifth of each. All texts of different components that share such
   a window, however frequent, are compared through it: a pair is written at the first window that it has in common, if from there
   on both texts have enough shared windows, and the bits of their windows (a signature for each text) leave enough in common. So
   no pair is written that cannot be alike, and none that can is passed over.

So a pair of different components is lost only if its texts share no sketch (chance above); README gives the recall that was
measured.

Components come from min-label propagation with pointer jumping over stored tables; links and labels never reach the driver.

Defined cases: null text is empty; texts of fewer than K words form one shingle of all words; empty texts are equal to one
another and link to nothing else; null ids lose against any id when a group's class is named; rows that repeat an id are rows of
their own; an empty table gives no rows; other columns pass through `keep_near`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, documents, free, grams, id_key, mix64, steps, stored, text_arrays, unused

K = 5
SKETCHES = 24
TUPLE = 4
THRESHOLD = 0.8
#: Shingles up to which a text has exact run keys; from 0.8 of it on texts have sketches.
SHORT = 24
#: The texts of a window are dealt to one more slot for each FANOUT^2 of them, so that no task compares all texts of a frequent one.
FANOUT = 16
#: Longs of a text's signature, and windows by which a pair is known to have met ahead of a window.
SIGNATURE, AHEAD = 16, 16


# ---- sketches --------------------------------------------------------------------------------------------


def shingles(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word windows of a word sequence; a shorter one is one window."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(h))):
        out *= np.uint64(0x100000001B3)
        out += h[j : n + j]
    return mix64(out)


def labelled_rows(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with how often the shingle occurred before in its row."""
    key = x + mix64(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(len(s)), 0)) if len(s) else order
    count = np.empty(len(s), dtype=np.uint64)
    count[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return x + count * np.uint64(0x9E3779B97F4A7C15)


_SEEDS = mix64(np.arange(1, 4097, dtype=np.uint64))
#: Least labelled shingles that a threshold is expected to let through, of which the TUPLE least are taken.
_DRAW = 20


def order_minhash(y: np.ndarray, row: np.ndarray, rows: int, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """Keys (rows x sketches) of the labelled shingles y of many rows, each of which has at least `size`: the `size` least under each hash, in text order."""
    counts = np.bincount(row, minlength=rows)
    upto = np.where(counts > _DRAW, np.minimum(_DRAW / np.maximum(counts, 1), 1.0) * 2.0**64, 2.0**64)
    cut = np.minimum(upto, 2.0**64 - 4096).astype(np.uint64)
    cut[counts <= _DRAW] = np.uint64(2**64 - 1)
    cut = cut[row]
    out = np.zeros((rows, sketches), dtype=np.uint64)
    for i in range(sketches):
        v = (y ^ _SEEDS[i]) * (_SEEDS[i + sketches] | np.uint64(1))
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x94D049BB133111EB)
        low = np.flatnonzero(v <= cut)
        got = np.bincount(row[low], minlength=rows)
        if (got < size).any():  # hardly ever: take such rows whole
            low = np.flatnonzero((v <= cut) | (got < size)[row])
            got = np.bincount(row[low], minlength=rows)
        order = np.lexsort((v[low], row[low]))
        rank = np.arange(len(low)) - np.repeat(np.cumsum(got) - got, got)
        chosen = np.sort(low[order[rank < size]]).reshape(rows, size)
        key = np.zeros(rows, dtype=np.uint64)
        for j in range(size):
            key = key * np.uint64(0x100000001B3) + y[chosen[:, j]]
        out[:, i] = mix64(key ^ _SEEDS[i])
    return out


def run_keys(x: np.ndarray) -> np.ndarray:
    """Keys of all runs of at least THRESHOLD of the shingles x of a short text."""
    least = int(np.ceil(THRESHOLD * len(x) - 1e-6))
    return np.concatenate([grams(x, n) for n in range(max(1, least), len(x) + 1)])


def text_keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For many word sequences: their numbers of shingles, and their keys."""
    x, row = shingle_rows(h, bounds)
    rows = len(bounds) - 1
    counts = np.bincount(row, minlength=rows)
    long = np.flatnonzero(counts >= THRESHOLD * SHORT)
    take = (counts >= THRESHOLD * SHORT)[row]
    number = np.cumsum(counts >= THRESHOLD * SHORT) - 1
    sketches = order_minhash(labelled_rows(x[take], number[row[take]]), number[row[take]], len(long)) if len(long) else np.zeros((0, SKETCHES), np.uint64)
    keys = [np.zeros(0, np.uint64)] * rows
    for i, k in zip(long, sketches):
        keys[i] = k
    at = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts <= SHORT)):
        keys[i] = np.unique(np.concatenate([keys[i], run_keys(x[at[i] : at[i] + counts[i]])]))
    return counts, keys


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(flat))


def _sketch(it):
    for batch in it:
        raw, offs = text_arrays(batch["text"])
        counts, keys = [np.zeros(0, np.int64)], []
        for lo, hi in steps(offs):
            w = Words(raw, offs, lo, hi)
            n, own = text_keys(w.hashes(), w.bounds)
            counts.append(n)
            keys += own
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("doc_id", "row", "digest")} | {"n": pa.array(np.concatenate(counts), pa.int32()), "keys": _lists(keys)})


# ---- verification ----------------------------------------------------------------------------------------


def matched_windows(a: np.ndarray, b: np.ndarray, most: int, k: int = K) -> int | None:
    """Windows of k words within the matched runs of an alignment of a and b of least edits (insertions and deletions), at most `most`.

    Furthest-reaching points on the diagonals of a band, with the windows counted on the way, in memory of the order of
    `most`; None if no alignment stays within `most` edits.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    # one more word that the other sequence does not have ends every run
    a, b = np.r_[a, np.uint64(1)], np.r_[b, np.uint64(0)]
    reach, count = np.full(2 * most + 5, -1, np.int64), np.zeros(2 * most + 5, np.int64)
    off = most + 2
    reach[off + 1] = 0
    for d in range(most + 1):
        ks = np.arange(-d, d + 1, 2)
        ks = ks[(ks >= -m) & (ks <= n)]
        below, above = reach[off + ks - 1], reach[off + ks + 1]
        below, above = np.where(ks == -d, -1, below), np.where((ks == d) & (d > 0), -1, above)
        down = (ks == -d) | ((ks != d) & (below < above))
        i = np.where(down, above, below + 1)
        c = np.where(down, count[off + ks + 1], count[off + ks - 1])
        fits = (np.where(down, above, below) >= 0) & (i <= n) & (i - ks >= 0) & (i - ks <= m)
        i = np.where(fits, i, -1)
        for x in np.flatnonzero(fits & (a[np.where(fits, i, 0)] == b[np.where(fits, i - ks, 0)])):
            p, q = int(i[x]), int(i[x] - ks[x])
            total, step = 0, 16
            while True:
                width = min(step, n - p - total, m - q - total)
                differ = np.flatnonzero(a[p + total : p + total + width] != b[q + total : q + total + width])
                if len(differ) or not width:
                    total += int(differ[0]) if len(differ) else 0
                    break
                total, step = total + width, step * 4
            i[x] += total
            c[x] += max(0, total - k + 1)
        reach[off + ks], count[off + ks] = i, c
        if abs(n - m) <= d and (n - m - d) % 2 == 0 and reach[off + n - m] >= n:
            return int(count[off + n - m])
    return None


def similarity(a: np.ndarray, b: np.ndarray, k: int = K, threshold: float = THRESHOLD) -> float:
    """Jaccard similarity of the k-word windows of two word sequences, of which those are common that a banded alignment matches.

    0 where the alignment takes more edits than the threshold allows.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0
    n, m = max(0, len(a) - k + 1), max(0, len(b) - k + 1)
    if not n or not m:
        return 0.0
    # at the threshold this many windows may be unmatched, and an inserted or deleted word unmatches one at least
    matched = matched_windows(a, b, int((1 - threshold) / (1 + threshold) * (n + m)) + 1, k)
    return 0.0 if matched is None else matched / (n + m - matched)


def shingle_rows(h: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """`shingles` of many word sequences at once (row i has the words bounds[i]..bounds[i+1] of h), and the row of each."""
    words = np.diff(bounds)
    counts = np.where(words > 0, np.maximum(1, words - k + 1), 0)
    row = np.repeat(np.arange(len(words)), counts)
    start = bounds[:-1][row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    length = np.minimum(words, k)[row]
    out = np.zeros(len(row), dtype=np.uint64)
    for j in range(k):
        grown = out * np.uint64(0x100000001B3) + h[np.minimum(start + j, len(h) - 1)] if len(h) else out
        out = np.where(j < length, grown, out)
    return mix64(out), row


def most_similar(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of word sequences, the Jaccard similarity of its windows with their repeats: no alignment is above it."""
    sides = []
    for side in (a, b):
        bounds = np.cumsum([0, *map(len, side)])
        sides.append(shingle_rows(np.concatenate(side) if side else np.zeros(0, np.uint64), bounds))
    row = np.concatenate([sides[0][1], sides[1][1]])
    key = np.concatenate([sides[0][0], sides[1][0]]) + mix64(row.astype(np.uint64) + np.uint64(1))
    if not len(key):
        return np.ones(len(a))
    order = np.argsort(key)
    key, row, second = key[order], row[order], order >= len(sides[0][1])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    in_b = np.add.reduceat(second.astype(np.int64), first)
    in_a = np.diff(np.r_[first, len(key)]) - in_b
    bags, total = np.bincount(row[first], np.minimum(in_a, in_b), len(a)), np.bincount(row, minlength=len(a))
    # two sequences without words are alike
    return np.where(total > 0, bags / np.maximum(total - bags, 1), 1.0)


def linked(a: list[np.ndarray], b: list[np.ndarray], step: int = 1 << 18) -> list[bool]:
    """Whether each pair of word sequences has the similarity; only pairs whose windows allow it are aligned."""
    sizes = np.cumsum([0, *(len(x) + len(y) for x, y in zip(a, b))])
    out: list[bool] = []
    for lo, hi in steps(sizes, step):
        allowed = most_similar(a[lo:hi], b[lo:hi]) >= THRESHOLD
        out += [bool(ok) and similarity(x, y) >= THRESHOLD for ok, x, y in zip(allowed, a[lo:hi], b[lo:hi])]
    return out


def _verify(it):
    for batch in it:
        sides = []
        for c in ("a_text", "b_text"):
            raw, offs = text_arrays(batch[c])
            hashes = []
            for lo, hi in steps(offs):
                w = Words(raw, offs, lo, hi)
                h = w.hashes()
                hashes += [h[p:q] for p, q in zip(w.bounds[:-1], w.bounds[1:])]
            sides.append(hashes)
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "linked": pa.array(linked(*sides), pa.bool_())})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) with linked; texts(id, text) has one row per id."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text").mapInArrow(_verify, "a long, b long, linked boolean")


# ---- components ------------------------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) -> (id, label): the least id of its component for every id that has a link.

    Each round takes the least label of the neighbours (partial minima per task) and then jumps to the label's own label.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("least"))
        jump = least.join(labels.select(F.col("id").alias("least"), F.col("label").alias("jump")), "least", "left")
        new = stored(jump.select("id", F.col("label").alias("was"), F.coalesce(F.least("least", "jump"), "least").alias("label")), "labels")
        free(labels)
        settled, labels = new.filter("was <> label").isEmpty(), new
        if settled:
            free(edges)
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


# ---- groups ----------------------------------------------------------------------------------------------


class Links:
    """What is known of the links between texts(id, text): pairs tried, and the components of those linked."""

    def __init__(self, texts: DataFrame):
        self.texts, self.tried = texts, []
        self.labels = texts.sparkSession.createDataFrame([], "id long, label long")

    def try_pairs(self, pairs: DataFrame) -> None:
        """Align pairs(a, b) of ids, each once (a < b)."""
        pairs = stored(pairs, "pairs")
        new = stored(verified(pairs, self.texts), "tried")
        free(pairs)
        self.tried.append(new)
        if not new.filter("linked").isEmpty():
            free(self.labels)
            self.labels = components(self.links())

    def links(self) -> DataFrame:
        both = self.tried[0]
        for more in self.tried[1:]:
            both = both.unionByName(more)
        return both.filter("linked").select("a", "b")

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the component of its column of ids; a text without links is its own."""
        labels = self.labels.select(F.col("id").alias("__of"), F.col("label").alias("__label"))
        return df.join(labels, df[column] == labels["__of"], "left").withColumn(name, F.coalesce("__label", column)).drop("__of", "__label")

    def untried(self, pairs: DataFrame) -> DataFrame:
        for tried in self.tried:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        return pairs


def _alike(n: str | Column, m: str | Column) -> Column:
    """Whether texts of n and m shingles can reach the threshold."""
    return F.least(n, m) >= F.greatest(n, m) * THRESHOLD - 1e-6


def _hubs(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sketched(id, n, keys) -> members(bucket, id, n, hub, hub_n) of buckets of two or more, and pairs(a, b, text, hub, common)."""
    each = sketched.select("id", "n", F.explode("keys").alias("bucket"))
    sizes = stored(each.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    members = stored(each.join(sizes, "bucket"), "members")
    weight = stored(members.groupBy("id").agg(F.sum(F.col("size") - 1).alias("weight")), "weights")
    weighed = members.drop("size").join(weight, "id")
    hubs = stored(weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("last"), "n")).alias("hub")).select("bucket", (-F.col("hub.last")).alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    led = stored(members.drop("size").join(hubs, "bucket"), "led")
    free(sizes, members, weight, hubs)
    met = led.filter((F.col("id") != F.col("hub")) & _alike("n", "hub_n"))
    pairs = met.groupBy(F.col("id").alias("text"), "hub").agg(F.count("*").alias("common"))
    return led, stored(pairs.select(F.least("text", "hub").alias("a"), F.greatest("text", "hub").alias("b"), "text", "hub", "common"), "candidates")


def _windows(it):
    """The labelled windows of texts(id, label, n, text)."""
    for batch in it:
        raw, offs = text_arrays(batch["text"])
        for lo, hi in steps(offs):
            w = Words(raw, offs, lo, hi)
            x, row = shingle_rows(w.hashes(), w.bounds)
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_pydict({c: batch[c].take(at) for c in ("id", "label", "n")} | {"w": pa.array(labelled_rows(x, row).view(np.int64))})


def _sign(it):
    """The id of texts(id, label, n, text) and s0, s1, ...: a bit for each labelled window, as its hash tells."""
    for batch in it:
        raw, offs = text_arrays(batch["text"])
        bits = np.zeros((len(offs) - 1, SIGNATURE), dtype=np.uint64)
        for lo, hi in steps(offs):
            w = Words(raw, offs, lo, hi)
            x, row = shingle_rows(w.hashes(), w.bounds)
            at = mix64(labelled_rows(x, row)) % np.uint64(64 * SIGNATURE)
            np.bitwise_or.at(bits, (row + lo, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        columns = {f"s{i}": pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(SIGNATURE)}
        yield pa.RecordBatch.from_pydict({"id": batch["id"]} | columns)


def signatures(texts: DataFrame) -> DataFrame:
    """id and signature of texts(id, label, n, text)."""
    return texts.mapInArrow(_sign, "id long, " + ", ".join(f"s{i} long" for i in range(SIGNATURE)))


def _least_common(a: DataFrame, b: DataFrame) -> Column:
    """Windows that texts of a and b, of n windows, have in common at the threshold."""
    return F.ceil((a["n"] + b["n"]) * (THRESHOLD / (1 + THRESHOLD)) - 1e-6)


def _may_match(a: DataFrame, b: DataFrame) -> Column:
    """Whether texts of a and b, of n windows and with signatures, can have the threshold in common: windows whose bit the other lacks are not matched."""
    least = _least_common(a, b)

    def lacking(x: DataFrame, y: DataFrame) -> Column:
        return sum(F.bit_count(x[f"s{i}"].bitwiseAND(F.bitwise_not(y[f"s{i}"]))) for i in range(SIGNATURE))

    return (lacking(a, b) <= a["n"] - least) & (lacking(b, a) <= b["n"] - least)


def _first_windows(open_: DataFrame) -> DataFrame:
    """Of open_(id, label, n, text): members (w, id, n, rest, before), the rarest windows that a text shares with other components.

    Windows that the same texts have count as one, the least of them, with their number. rest is the number of shared windows of the
    text from this one on, before has the AHEAD ones ahead of it.
    """
    each = open_.mapInArrow(_windows, "id long, label long, n int, w long")
    same = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"set{i}") for i in range(2)]
    shared = each.groupBy("w").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("texts"), *same).filter("lo <> hi")
    passages = stored(shared.groupBy("texts", "set0", "set1").agg(F.min("w").alias("w"), F.count("*").alias("windows")).select("w", "texts", "windows"), "passages")
    own = Window.partitionBy("id")
    ranked = own.orderBy("texts", "w")
    placed = each.join(passages, "w").select(
        "w", "id", "n",
        (F.sum("windows").over(own) - F.sum("windows").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) + F.col("windows")).alias("rest"),
        F.collect_list("w").over(ranked.rowsBetween(-AHEAD, -1)).alias("before"),
    )
    # a link has common windows for THRESHOLD of the text's, all of them shared: its first is followed by the others
    members = stored(placed.filter(F.col("rest") >= F.ceil(F.col("n") * THRESHOLD - 1e-6)), "members")
    free(passages)
    return members


def _meetings(found: Links, members: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that may be linked of texts of different components that share a window of members(w, id, n, rest, before), and the stored table behind them; signed has their signatures.

    Without rest and before (as in `_first_windows`) no pair is passed over at a window for them.
    """
    for c, whole in (("rest", F.col("n").cast("long")), ("before", F.array().cast("array<long>"))):
        if c not in members.columns:
            members = members.withColumn(c, whole)
    own = found.labelled(members, "id", "label")
    mixed = own.groupBy("w").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    slots = (1 + F.floor(F.col("size") / FANOUT**2)).alias("slots")
    # texts that can be alike are of one band of sizes, or of two that follow one another
    band = F.floor(F.log("n") / F.log(F.lit(1.01 / THRESHOLD))).alias("band")
    now = stored(own.join(mixed.select("w", slots), "w").join(signed, "id").select("*", band), "frequent")
    less = now.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    more = now.withColumn("slot", F.pmod(F.xxhash64("id"), "slots")).withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    more = more.select(*(F.col(c).alias(c) for c in more.columns))
    met = (less["w"] == more["w"]) & (less["band"] == more["band"]) & (less["slot"] == more["slot"])
    ahead = (less["n"] < more["n"]) | ((less["n"] == more["n"]) & (less["id"] < more["id"]))
    enough = F.least(less["rest"], more["rest"]) >= _least_common(less, more)
    # a pair that has a window ahead of this one in common meets there
    first = ~F.arrays_overlap(less["before"], more["before"])
    meet = less.join(more, met & (less["label"] != more["label"]) & ahead & enough & _may_match(less, more) & first)
    return meet.select(F.least(less["id"], more["id"]).alias("a"), F.greatest(less["id"], more["id"]).alias("b")), now


def try_frequent(found: Links, members: DataFrame, signed: DataFrame) -> None:
    """Align the pairs of `_meetings` that were not aligned before."""
    pairs, now = _meetings(found, members, signed)
    found.try_pairs(found.untried(pairs.distinct()))
    free(now)


def link_texts(sketched: DataFrame, texts_of) -> Links:
    """sketched(id, n, keys) -> Links; texts_of(ids) gives the table (id, text) of some ids."""
    led, pairs = _hubs(sketched)
    # of all texts in buckets: two that are alike may have hubs of other sizes only
    found = Links(stored(texts_of(led.select("id").distinct()), "texts"))
    best = pairs.groupBy("text").agg(F.max(F.struct("common", (-F.col("hub")).alias("hub"))).alias("best")).select("text", (-F.col("best.hub")).alias("hub"))
    found.try_pairs(best.select(F.least("text", "hub").alias("a"), F.greatest("text", "hub").alias("b")).distinct())
    # buckets that have texts of several components
    each = stored(found.labelled(led.select("bucket", "id", "n"), "id", "label"), "each")
    mixed = stored(each.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket"), "mixed")
    open_ = stored(each.join(mixed, "bucket").select("id", "label", "n").distinct(), "open")
    free(led, pairs, each, mixed)
    if not open_.isEmpty():
        texts = open_.join(found.texts, "id")
        members = _first_windows(texts)
        try_frequent(found, members, signatures(texts.join(members.select("id").distinct(), "id", "left_semi")))
        free(members)
    return found


def group_near(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text_sha256, class_id (least doc_id of its group), group_size, kept, n_links.

    kept marks one row of each group, that with the least doc_id. n_links counts verified links of the row's text to different
    texts; further links within a group, implied by its component, were not compared.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sketch, "doc_id long, row long, digest binary, n int, keys array<long>"), "rows")
    # a text's number: the least row number it has
    chosen = stored(rows.groupBy("digest").agg(F.min("row").alias("id")), "numbers")
    sketched = rows.filter(F.size("keys") > 0).join(chosen.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "keys")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = chosen.join(ids, "id").select("digest", "id")
        # by id, not by what the join was dealt by: copies of a hot text are folded in the tasks, and Spark can split the join
        return plain.join(wanted, "digest").groupBy("id").agg(F.first("text").alias("text"))

    found = link_texts(sketched, texts_of)
    links = found.links()
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    named = stored(found.labels.join(degree, "id").select("id", "label", "n_links"), "named")
    placed = rows.select("doc_id", "row", "digest").join(chosen, "digest").join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))
    placed = stored(placed.drop("id"), "placed")
    classes = stored(placed.groupBy("label").agg(F.min(F.struct(id_key().alias("order"), "digest", "row", "doc_id")).alias("first"), F.count("*").alias("group_size")).select("label", F.col("first.row").alias("first"), F.col("first.doc_id").alias("class_id"), "group_size"), "classes")
    free(rows, chosen, named, found.texts, found.labels, *found.tried)
    out = placed.join(classes, "label")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "class_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_near(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that with the least doc_id; all columns are kept."""
    id_, digest = unused(docs, 2)
    stay = group_near(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(digest))
    keyed = docs.withColumn(digest, F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)).withColumn(id_, docs["doc_id"].cast("long"))
    kept = keyed.join(stay, keyed[digest].eqNullSafe(stay[digest]) & keyed[id_].eqNullSafe(stay[id_]), "left_semi")
    return kept.dropDuplicates([id_, digest]).drop(id_, digest)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near(documents(spark, sf_dir).select("doc_id", "text"))
