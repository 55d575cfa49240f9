"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (n of NGRAMS, hashed) of about TRAIN_DOCS documents per language, drawn by a hash of id and text, so
that the model is bounded at every corpus size. The counts are partial sums per task, added up by Spark; the smoothed
log-probability matrix (buckets x languages) is the broadcast. It has at most MATRIX_CELLS cells: every language is
learned, and with very many of them there are fewer buckets for each. Scoring is sparse: the hashed n-grams of a run of whole texts name rows of the
matrix, which are gathered and added up by text (numpy).

Defined cases: a null text or one without a letter is ``und`` with score 0; an empty training set makes every text ``und``;
the n-grams of very long texts are counted piece by piece; ties go to the language first in code-point order; repeated rows get equal
results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, unused

BUCKETS = 1 << 15
NGRAMS = (1, 2, 3)
TRAIN_DOCS = 2000
#: Cells of the broadcast matrix (4 bytes each).
MATRIX_CELLS = 1 << 24
#: Code points that the numpy steps take at once, and texts whose counts they hold.
STEP_CHARS, STEP_TEXTS = 1 << 17, 32
#: Cells of the matrix that are gathered at once; up to FEW_LANGS languages are added up one by one (the same sums, sooner).
GATHERED, FEW_LANGS = 1 << 22, 16
#: Evidence of neighbouring n-grams overlaps; a document's log-likelihoods are divided by the root of its n-grams times this.
TEMPER = 0.25
UND = "und"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of texts, with a blank on both sides of each, and their bounds."""
    framed = [f" {t.lower()} " for t in texts]
    return np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.cumsum([0, *map(len, framed)])


def _hashed(codes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint32)
    for j in range(n):
        h *= np.uint32(0x01000193)
        h ^= codes[j : len(codes) - n + 1 + j] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B + 2 * n)
    return (h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def _runs(texts: list[str]):
    """Runs of up to STEP_TEXTS texts of about STEP_CHARS, with the number of their first."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if run and (size + len(t) > STEP_CHARS or len(run) == STEP_TEXTS):
            yield first, run
            run, size, first = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def _grams(texts: list[str], buckets: int):
    """Hashed n-grams of texts, some at a time: their rows (ascending) and buckets."""
    codes, bounds = _codes(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for lo in range(0, len(codes), STEP_CHARS):
        for n in NGRAMS:
            h = _hashed(codes[lo : lo + STEP_CHARS + n - 1], n, buckets)
            own = row[lo : lo + len(h)]
            inside = own == row[lo + n - 1 : lo + n - 1 + len(h)]
            if inside.any():
                yield own[inside], h[inside]


def count_ngrams(texts: list[str], buckets: int) -> np.ndarray:
    """Hashed n-gram counts (texts x buckets)."""
    out = np.zeros(len(texts) * buckets, dtype=np.int64)
    for rows, h in _grams(texts, buckets):
        out += np.bincount(rows * buckets + h, minlength=len(out))
    return out.reshape(len(texts), buckets)


def _counter(buckets: int):
    def run(it):
        """Per language, the n-gram counts of this task's training documents."""
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            for t, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                own = count_ngrams([t], buckets)[0]
                sums[lang] = sums[lang] + own if lang in sums else own
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at, pa.int32()), "n": pa.array(own[at], pa.int64())})

    return run


class Model:
    """Languages and their log-probabilities (buckets x languages, so that an n-gram's are side by side)."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, np.ascontiguousarray(logp.T, dtype=np.float32)

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text under each language, and its number of n-grams: the rows of the matrix that its n-grams name, added up."""
        total, n_grams = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        few = len(self.langs) <= FEW_LANGS
        for rows, h in _grams(texts, len(self.logp)):
            n_grams += np.bincount(rows, minlength=len(texts))
            step = len(h) if few else max(1, GATHERED // len(self.langs))
            for lo in range(0, len(h), step):
                r, own = rows[lo : lo + step], self.logp[h[lo : lo + step]]
                if few:
                    for k in range(len(self.langs)):
                        total[:, k] += np.bincount(r, weights=own[:, k], minlength=len(texts))
                else:
                    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    total[r[starts]] += np.add.reduceat(own, starts, axis=0, dtype=np.float64)
        return total, n_grams

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        for first, run in _runs(texts):
            total, n_grams = self.log_likelihoods(run)
            z = total / (TEMPER * np.sqrt(np.maximum(n_grams, 1)))[:, None]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            for i, t in enumerate(run):
                if any(map(str.isalpha, t)):
                    names[first + i], scores[first + i] = self.langs[best[i]], float(p[i, best[i]])
        return names, scores


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """docs(doc_id, text, lang): learn from rows with a text and a language, about train_docs of each language."""
    labelled = docs.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    buckets = BUCKETS
    while buckets > 1 and buckets * len(sizes) > MATRIX_CELLS:
        buckets //= 2
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, train_docs / n)) for lang, n in sizes.items()], "lang string, share double")
    drawn = labelled.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counted = drawn.select("lang", "text").mapInArrow(_counter(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    table = np.zeros((len(langs), buckets))
    rows = counted.toArrow()  # at most MATRIX_CELLS rows
    if rows.num_rows:
        at = pc.index_in(rows["lang"], value_set=pa.array(langs, rows["lang"].type)).to_numpy()
        table[at, rows["bucket"].to_numpy()] = rows["n"].to_numpy()  # one row for each language and bucket
    seen = table.sum(axis=1) > 0
    langs, table = [x for x, s in zip(langs, seen) if s], table[seen]
    return Model(langs, np.log((table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)))


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score (which take the place of columns of these names); the others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(pred, score)
    kept = schema.columns

    def run(it):
        for batch in it:
            names, scores = shared.value.score([t or "" for t in batch["text"].to_pylist()])
            table = pa.Table.from_batches([batch]).select(kept).append_column(pred, pa.array(names, pa.string())).append_column(score, pa.array(scores, pa.float64()))
            yield from table.to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema)
    return schema.mapInArrow(run, f"{kinds}, `{pred}` string, `{score}` double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose language is known with a score of at least `least`; learns from the rows of the training folds."""
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    lang, score = unused(docs, 2)
    return predict(docs, model, lang, score).filter((F.col(lang) != UND) & (F.col(score) >= least)).select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


