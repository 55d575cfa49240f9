"""Mixture-controlled packing of token streams into fixed windows.

Each source is a queue: the token ids of its documents, one after another, each closed by the end id. A window of WINDOW
tokens serves the queues in turn; a queue's quantum is its share of all tokens, and what a queue is owed after rounding to whole
tokens is its deficit, carried to the next window. The state of this deficit round-robin before window w has a closed form:
with A_k the tokens of queues 1..k over all tokens N, queues 1..k have served floor(w * WINDOW * A_k) tokens, whole numbers that
differ from the exact share by less than one token, and every window is full. So window, place and cut of every token
follow from its position in its queue: no task needs another's state, deficits carry over windows and partitions alike, and
only the very last sequence of the corpus is short.

A queue must be served at least one token a window for the closed form to be monotone, and `quantum` tokens so that documents are not cut into crumbs; sources whose
share of a window is less share queue 0. What this queue is served is dealt to its sources by the same closed form, over windows GROWTH times as large; sources
below the quantum there share the queue 0 of the next level, until none is left. The totals of the sources are on the driver.

A mixture may be asked for by `proportions`; without, it is each source's share of all tokens. Where a source runs dry before the
others, a phase ends there and the rest go on in their proportions to one another: within a phase the shares are those of its
tokens, so the same closed form serves it. There are as many phases as sources at most, planned from their totals.

Token ids are made once and stored; positions come from running sums per (task, queue) plus a prefix over these sums.
Nothing is grouped by source, so a hot source is spread as its documents are.

Defined cases: null text is empty (a document of the end id alone); a null source is a queue; rows that repeat an id are documents of
their own; an empty table gives no pieces; a document longer than a window is cut as any other; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

WINDOW = 2048
#: How many times as large the windows of a level are as those of the one above.
GROWTH = 2
#: Tokens that op10 and the pipeline serve at once at least.
QUANTUM = 256
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words that a Python worker remembers with their ids, over all its tasks.
REMEMBERED = 1_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """ids of texts under a tokenizer whose tokens never hold white space and depend on one word only; words are remembered.

    The vocabulary lower-cases and splits letters from other signs, so a word's ids are those of its letters, then of the signs
    after it. Words in common Latin letters go straight to the merge model; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.number = [i.to_bytes(int(self.kind[-1]), "little") for i in range(self.whole.get_vocab_size())]
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}
        self.table = {c: "".join(p for p, _ in alphabet.pre_tokenize_str(chr(c))) for c in range(0x80, 0x250)}

    def _slow(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _plain(self, letters: str) -> bool:
        return letters.isalpha() and (letters.isascii() or (max(letters) < "ɐ" and "İ" not in letters and unicodedata.is_normalized("NFC", letters)))

    def _new(self, word: str) -> bytes:
        signs = len(word)
        while signs and word[signs - 1] in ".,;:!?$%&*#|":
            signs -= 1
        letters = word[:signs]
        if letters and self._plain(letters):
            low = letters.lower()
            ids = self.known.get(low) if signs < len(word) else None
            if ids is None:
                ids = b"".join([self.number[t.id] for t in self.model.tokenize(low if low.isascii() else low.translate(self.table))])
            if signs < len(word):
                self.known[low] = ids
                ids += self._signs(word[signs:])
            return ids
        return self._slow(word)

    def _signs(self, signs: str) -> bytes:
        """The ids of signs after a word, of which there are few; longer runs are not remembered."""
        if (ids := self.endings.get(signs)) is None:
            ids = self._slow(signs)
            if len(signs) < 8 and len(self.endings) < REMEMBERED:
                self.endings[signs] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian numbers of 16 bits, or of 32 where the vocabulary needs them."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or "<|" in text:
            return self._slow(text)
        words = (text.lower() if "Σ" not in text and "İ" not in text else text).split()
        known = self.known
        ids = list(map(known.get, words))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    if (x := known.get(w := words[i])) is None:
                        x = self._new(w)
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = x
                    ids[i] = x
        return b"".join(ids)


_workers: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python process; what it remembers serves all tasks that the process runs."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, ids, n_tokens with the end id, and task, before: the tokens of the source earlier in its task."""

    def run(it):
        encode = worker_tokenizer(path)
        width = int(encode.kind[-1])
        task, served = TaskContext.get().partitionId(), {}
        for batch in it:
            ids, sizes, before = [], [], []
            for text, source in zip(batch["text"], batch["source"].to_pylist()):
                ids.append(encode(text.as_py() or ""))
                sizes.append(len(ids[-1]) // width + 1)
                before.append(served.get(source, 0))
                served[source] = before[-1] + sizes[-1]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "source": batch["source"], "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array(sizes, pa.int64()), "task": pa.array([task] * len(ids), pa.int32()), "before": pa.array(before, pa.int64())})

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["source"].cast("string").alias("source"))
    return stored(plain.mapInArrow(run, "doc_id long, source string, ids binary, n_tokens long, task int, before long"), "tokens")


class Schedule:
    """Closed form of the round-robin: queue k has served floor(w * window * A_k) - floor(w * window * A_(k-1)) tokens before window w."""

    def __init__(self, sizes: list[int], window: int):
        self.window, self.total = window, sum(sizes)
        self.bounds = [sum(sizes[:k]) for k in range(len(sizes) + 1)]

    def _exact(self, k: int, w: int) -> int:
        """Tokens that queue k has served before window w."""
        slots = min(w * self.window, self.total)
        return slots * self.bounds[k + 1] // self.total - slots * self.bounds[k] // self.total

    def _before(self, k: int, w: int) -> int:
        """Tokens of queues before k that all windows before w have served."""
        return min(w * self.window, self.total) * self.bounds[k] // self.total

    def pieces(self, k: int, start: int, n: int):
        """(window, offset there, tokens) of the n tokens of queue k from position start on."""
        share = self.bounds[k + 1] - self.bounds[k]
        w = max(0, start * self.total // share // self.window - 1) if share else 0
        while self._exact(k, w + 1) <= start:
            w += 1
        while n:
            here, upto = self._exact(k, w), self._exact(k, w + 1)
            take = min(n, upto - start)
            if take:
                yield w, self._before(k, w + 1) - self._before(k, w) + start - here, take
            start, n, w = start + take, n - take, w + 1


class Plan:
    """Schedules by level for the tokens of each source: queue 0 of a level is what the next level deals out."""

    def __init__(self, sizes: list[int], window: int, quantum: int = 1):
        self.levels: list[Schedule] = []
        #: level and queue there, by source
        self.places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
        left, size = [i for i, n in enumerate(sizes) if n], window
        while left:
            total = sum(sizes[i] for i in left)
            large = sorted((i for i in left if sizes[i] * size >= quantum * total), key=lambda i: (-sizes[i], i))
            rest = total - sum(sizes[i] for i in large)
            while large and 0 < rest and rest * size < quantum * total:  # the rest alone is owed less than that
                rest += sizes[large.pop()]
            large.sort()
            for k, i in enumerate(large, 1):
                self.places[i] = len(self.levels), k
            self.levels.append(Schedule([rest, *(sizes[i] for i in large)], size))
            gone = set(large)
            left, size = [i for i in left if i not in gone], size * GROWTH

    def pieces(self, source: int, start: int, n: int):
        """(window, offset there, tokens) of the n tokens of a source from position start on."""
        yield from self._served(*self.places[source], start, n)

    def _served(self, level: int, k: int, start: int, n: int):
        for w, offset, take in self.levels[level].pieces(k, start, n):
            if level:
                yield from self._served(level - 1, 0, w * self.levels[level].window + offset, take)
            else:
                yield w, offset, take


class Mixture:
    """Plans by phase: in each, the sources that have tokens left are served in their proportions until one runs dry."""

    def __init__(self, sizes: list[int], window: int, proportions: list[float] | None = None, quantum: int = 1):
        self.window = window
        #: for each phase: tokens before it, tokens of each source before it, plan
        self.phases: list[tuple[int, list[int], Plan]] = []
        shares = [Fraction(p) for p in proportions] if proportions else [Fraction(n) for n in sizes]
        left, served, total = list(sizes), [0] * len(sizes), 0
        while any(left):
            live = [i for i, n in enumerate(left) if n]
            weighed = [i for i in live if shares[i] > 0]
            if weighed:
                # whole tokens up to the moment at which the first is empty; that one gives all it has
                rounds, first = min((left[i] / shares[i], i) for i in weighed)
                part = [0] * len(left)
                for i in weighed:
                    part[i] = left[i] if i == first else min(left[i], int(rounds * shares[i]))
            else:
                part = list(left)
            self.phases.append((total, list(served), Plan(part, window, quantum)))
            total += sum(part)
            served = [a + b for a, b in zip(served, part)]
            left = [a - b for a, b in zip(left, part)]

    def pieces(self, source: int, start: int, n: int):
        """(window, offset there, tokens) of the n tokens of a source from position start on."""
        if len(self.phases) == 1:
            yield from self.phases[0][2].pieces(source, start, n)
            return
        for at, (total, served, plan) in enumerate(self.phases):
            upto = self.phases[at + 1][1][source] if at + 1 < len(self.phases) else start + n
            take = min(start + n, upto) - start
            if take <= 0:
                continue
            for w, offset, length in plan.pieces(source, start - served[source], take):
                place = total + w * self.window + offset
                while length:
                    here = min(length, self.window - place % self.window)
                    yield place // self.window, place % self.window, here
                    place, length = place + here, length - here
            start, n = start + take, n - take
            if not n:
                return


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, proportions: dict[str | None, float] | None = None, quantum: int = 1) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, queue.

    proportions: weights of the sources in every window, as long as each has tokens; those not named come after all others.
    quantum: the least number of tokens that a queue is served at once. A source that is owed less of a window is served that much, or up to twice as much, every so many windows:
    fewer pieces a document, and proportions that hold over these windows.
    """
    tokens = tokenized(docs, vocabulary or vocabulary_path())
    sums = stored(tokens.groupBy("task", "source").agg(F.sum("n_tokens").alias("tokens")), "task_sums")
    totals = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(F.col("source").isNull(), "source").collect()
    plan = Mixture([r["tokens"] for r in totals], window, proportions and [proportions.get(r["source"], 0) for r in totals], quantum)
    named = docs.sparkSession.createDataFrame([(r["source"], i) for i, r in enumerate(totals)], "source string, queue int")
    keyed = sums.withColumnRenamed("source", "s").join(F.broadcast(named), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    base = keyed.withColumn("base", F.coalesce(F.sum("tokens").over(Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = stored(base.select(F.col("task").alias("t"), F.col("source").alias("s"), "queue", "base"), "bases")
    placed = tokens.join(base, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "queue", "ids", "n_tokens", (F.col("base") + F.col("before")).alias("position"))

    def run(it):
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in it:
            out = {c: [] for c in ("row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for i, (ids, n, queue, position) in enumerate(zip(batch["ids"].to_pylist(), batch["n_tokens"].to_pylist(), batch["queue"].to_pylist(), batch["position"].to_pylist())):
                whole = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * (n - 1) else "<u4").astype("<u4").tobytes() + end
                at = 0
                for sequence, offset, take in plan.pieces(queue, position, n):
                    for c, v in zip(out, (i, at, take, zlib.crc32(whole[4 * at : 4 * (at + take)]), n, sequence, offset)):
                        out[c].append(v)
                    at += take
            rows = pa.array(out.pop("row"), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(rows)} | {c: pa.array(v, pa.int64()) for c, v in out.items()} | {c: batch[c].take(rows) for c in ("source", "queue")})

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, queue int")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text", "source"), quantum=QUANTUM)


