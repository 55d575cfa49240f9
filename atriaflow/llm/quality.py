"""Quality classification by Bradley-Terry pairwise ranking.

From labelled documents, preference pairs (a good one over a bad one) are drawn; weights are learned by logistic loss on
the difference of the two feature vectors, so only the order of scores is fitted. The cut is then a quantile of the
training scores: the one that leaves the training share of good documents above it.

Features are shares and lengths of a whole text, and the shares of its words and of its byte triples by hash (numpy over its bytes and
words). The fit takes the features of at most about TRAIN_ROWS labelled documents, drawn by a hash of the id; the model is a vector, which
goes to the tasks that score every text. Features of documents are never stored.

Defined cases: null and empty texts have features of their own (they are marked) and a score; without labels of both kinds the
score is 0.5 for all; labels that repeat a doc_id are averaged; of labelled rows that repeat an id the least text is learned from; rows that
repeat get equal scores; very long texts are taken as one; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, documents, fold, mix64, steps, text_arrays

TRAIN_ROWS = 20_000
PAIRS = 60_000
ROUNDS = 300
RIDGE = 1e-3
#: Buckets of the hashed words, and of the hashed byte triples.
HASHED = 96
#: Standard deviation that hashed features are given, where the others have 1: each of them tells little.
HASHED_SPREAD = 0.3

_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "comma", "exclaim", "pipe", "money", "at_slash", "other_sign", "high"]
FEATURES = [*_CLASSES, "log_words", "log_lines", "word_length", "word_spread", "long_words", "short_words", "distinct_words", "commonest_word", "distinct_lines", "line_words", "upper_words", "sign_words", "same_neighbour", "repeated_triples", "no_text"]
WIDTH = len(FEATURES) + 2 * HASHED


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("other_sign"), dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = 0
    t[ord("A") : ord("Z") + 1] = 1
    t[ord("0") : ord("9") + 1] = 2
    t[[9, 11, 12, 32]] = 3
    t[[10, 13]] = 4
    for name, chars in (("stop", ".?"), ("comma", ",;:"), ("exclaim", "!"), ("pipe", "|"), ("money", "$%*#&"), ("at_slash", "@/")):
        t[[ord(c) for c in chars]] = _CLASSES.index(name)
    t[128:] = _CLASSES.index("high")
    return t


_TABLE = _class_table()


def _distinct(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of distinct values and the count of the commonest."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])]) if len(v) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[new, len(v)])
    most = np.zeros(n)
    np.maximum.at(most, r[new], runs)
    return np.bincount(r[new], minlength=n).astype(float), most


def features(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The feature rows of the texts with these bytes."""
    out = np.zeros((len(offs) - 1, WIDTH), dtype=np.float64)
    for lo, hi in steps(offs):
        w = Words(raw, offs, lo, hi)
        out[lo:hi, : len(FEATURES)] = _step(w)
        out[lo:hi, len(FEATURES) :] = hashed_shares(w)
    return out


def hashed_shares(w: Words) -> np.ndarray:
    """For each row the share of its words in each bucket, and of its byte triples; square roots, as they are small."""
    n = len(w.rows) - 1
    row = np.repeat(np.arange(n), np.diff(w.bounds))
    words = np.bincount(row * HASHED + (w.hashes() % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    d = w.data.astype(np.uint64)
    triples = (mix64(d[:-2] << np.uint64(16) | d[1:-1] << np.uint64(8) | d[2:]) % np.uint64(HASHED)).astype(np.int64) if len(d) > 2 else np.zeros(0, np.int64)
    at = np.repeat(np.arange(n), np.diff(w.rows))
    first, last = at[: len(triples)], at[2:]
    inside = first == last
    shares = np.bincount((first * HASHED + triples)[inside], minlength=n * HASHED).reshape(n, HASHED)
    return np.sqrt(np.concatenate([x / np.maximum(x.sum(axis=1, keepdims=True), 1) for x in (words, shares)], axis=1))


def _step(w: Words) -> np.ndarray:
    n = len(w.rows) - 1
    size = np.diff(w.rows).astype(float)
    some = np.maximum(size, 1)
    kind = _TABLE[w.data]
    byte_row = np.repeat(np.arange(n), np.diff(w.rows))
    counts = np.bincount(byte_row * len(_CLASSES) + kind, minlength=n * len(_CLASSES)).reshape(n, -1)
    f = np.zeros((n, len(FEATURES)))
    f[:, : len(_CLASSES)] = counts / some[:, None]
    words = np.diff(w.bounds).astype(float)
    any_word = np.maximum(words, 1)
    row = np.repeat(np.arange(n), np.diff(w.bounds))
    length = (w.end - w.start).astype(float)
    total = lambda x, r=row: np.bincount(r, weights=x, minlength=n)
    h = w.hashes()
    distinct, commonest = _distinct(h, row, n)
    lines = counts[:, _CLASSES.index("newline")] + 1.0
    mean = total(length) / any_word
    kinds = kind[w.start]
    last = kind[w.end - 1]
    # lines as sums of their words' hashes
    newline = np.cumsum(w.data == 10)
    line = (newline[w.start] if len(w.start) else np.zeros(0, np.int64)) + row  # rows never share a line number
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        line_hash = np.add.reduceat(h, first) if len(first) else np.zeros(0, np.uint64)
        triple = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if len(h) > 2 else np.zeros(0, np.uint64)
    filled = np.bincount(row[first], minlength=n).astype(float)
    distinct_lines, _ = _distinct(line_hash, row[first], n)
    inside = row[:-2] == row[2:] if len(h) > 2 else np.zeros(0, bool)
    triple, triple_row = triple[inside], row[:-2][inside] if len(h) > 2 else np.zeros(0, np.int64)
    triples = np.bincount(triple_row, minlength=n).astype(float)
    distinct_triples, _ = _distinct(triple, triple_row, n)
    same = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])] if len(h) else np.zeros(0, bool)
    more = [
        np.log1p(words), np.log1p(lines), mean, np.sqrt(np.maximum(total(length**2) / any_word - mean**2, 0)),
        total(length > 12) / any_word, total(length < 3) / any_word, distinct / any_word, commonest / any_word,
        distinct_lines / np.maximum(filled, 1), np.log1p(words / lines), total(kinds == 1) / any_word, total((last > 4) & (last < 12) & (last != 5) & (last != 6)) / any_word,
        total(same) / any_word, 1 - distinct_triples / np.maximum(triples, 1), size == 0,
    ]
    f[:, len(_CLASSES) :] = np.stack(more, axis=1)
    return f


class Ranking:
    """Weights on standardised features, the cut and the spread of scores."""

    def __init__(self, mean, scale, weights, cut, spread):
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def score(self, f: np.ndarray) -> np.ndarray:
        """Scores of feature rows: 0.5 at the cut."""
        # summed row by row, as the rounding of a matrix product depends on the rows beside it
        s = (np.clip((f - self.mean) / self.scale, -20, 20) * self.weights).sum(axis=1) - self.cut
        return 1 / (1 + np.exp(-np.clip(s / self.spread, -500, 500)))


def _bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int, rounds: int) -> np.ndarray:
    """Weights under which, for pairs drawn of a good and a bad row, log(1 + exp(-w (x_good - x_bad))) is least."""
    rng = np.random.default_rng(0)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    d = x[rng.choice(up, pairs)] - x[rng.choice(down, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds // 20):  # Newton steps: the loss is convex
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ranking:
    """docs(doc_id, text), labels(doc_id, quality); the features of about train_rows rows come to the driver at most."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality").filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, train_rows / max(n, 1)) * (1 << 30))
    texts = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(it):
        for batch in it:
            f = features(*text_arrays(batch["text"])).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"quality": batch["quality"], "f": pa.array(list(f), pa.list_(pa.float32()))})

    rows = texts.mapInArrow(run, "quality double, f array<float>").toPandas()
    x = np.array(rows["f"].tolist(), dtype=np.float64).reshape(len(rows), WIDTH)
    y = rows["quality"].to_numpy() > 0.5
    order = np.lexsort(np.c_[x, y].T) if len(x) else np.zeros(0, np.int64)
    x, y = x[order], y[order]
    zero = np.zeros(WIDTH)
    if not y.any() or y.all():
        return Ranking(zero, zero + 1, zero, 0.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    scale[len(FEATURES) :] /= HASHED_SPREAD
    z = np.clip((x - mean) / scale, -20, 20)
    w = _bradley_terry(z, y, PAIRS, ROUNDS)
    s = z @ w
    cut = float(np.quantile(s, 1 - y.mean()))
    return Ranking(mean, scale, w, cut, max(1e-6, float(s.std()) / 2))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for each row of docs, learned from labels(doc_id, quality)."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(plain, labels))

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(model.value.score(features(*text_arrays(batch["text"]))))})

    return plain.mapInArrow(run, "doc_id long, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(fold("doc_id", 3) != 1)
    out = score(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
