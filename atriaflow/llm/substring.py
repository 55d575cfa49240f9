"""Substring deduplication with suffix automata of reference shards.

Rule: a window is WINDOW consecutive words of one document; a word goes if a window over it also starts in a document with a
smaller doc_id. Windows are judged on the input.

1. Every document gives the anchors of its windows (the least hash of the GRAM-word grams in a window; a function of the
   window alone) and, on the way, its word count and digest. Of equal texts only that with the least id goes on: a later
   copy loses every word that any window covers.
2. Anchors found in two documents or more mark the windows that can repeat. Only the documents that have such anchors are read
   again; their marked windows are hashed, and the least document id of each hash (partial minima per task) is its owner.
3. The owners' stretches of such windows are the reference; the others' stretches are the stream. A stretch goes to the shard
   of its owner. Shards are sized by reference words; a shard that many stretches stream to is split into salted copies.
4. A task builds its shard's suffix automaton (over words), which knows for each state where its string stands in the
   reference, and streams the stretches through it: the matching statistics give, at each word, the longest match that ends
   there. Matches of WINDOW words and more that stand in a document with a smaller id are the spans to remove.

The automata go to the tasks of their own shard only: the references of a large corpus have no size bound that would allow a
broadcast to all tasks, and a stretch can match nowhere else. Hashes route; the automaton, on whole words, decides.

Defined cases: null text has no words; a null doc_id comes after all others, and nothing is removed on its account; rows with
equal ids never remove from one another; equal rows get equal results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Words, documents, grams, id_key, sliding_min, steps, stored, text_arrays, unused

WINDOW = 50
GRAM = 8
#: Reference words of a shard, and words that a task streams.
SHARD_WORDS = 60_000
STREAM_WORDS = 400_000


def window_anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window of the word hashes h, the least hash of its grams."""
    g = grams(h, gram)
    width = window - gram + 1
    return sliding_min(g, width) if len(g) >= width else np.zeros(0, np.uint64)


def _joined(w: Words, i: int) -> bytes:
    """The words of row i, joined by one space."""
    own = bytes(w.data[w.rows[i] : w.rows[i + 1]])
    return b" ".join(own.split())


def _survey(it):
    for batch in it:
        raw, offs = text_arrays(batch["text"])
        n, sha, anchors = [], [], []
        for lo, hi in steps(offs):
            w = Words(raw, offs, lo, hi)
            h = w.hashes()
            for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
                n.append(b - a)
                sha.append(hashlib.sha256(_joined(w, i)).hexdigest())
                anchors.append(np.unique(window_anchors(h[a:b])).view(np.int64))
        bounds = np.cumsum([0, *map(len, anchors)])
        flat = pa.array(np.concatenate(anchors) if anchors else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "rank": batch["rank"], "key": batch["key"], "n_words": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.string()), "anchors": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)})


def _doubtful(it):
    """(hash, rank, key) of the windows of a document whose anchor occurs in other documents too."""
    for batch in it:
        raw, offs = text_arrays(batch["text"])
        marked = batch["marked"]
        for lo, hi in steps(offs):
            w = Words(raw, offs, lo, hi)
            h = w.hashes()
            for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:]), lo):
                at = _marked_starts(h[a:b], marked[i])
                if len(at):
                    v = grams(h[a:b], WINDOW)[at].view(np.int64)
                    yield pa.RecordBatch.from_pydict({"hash": pa.array(v), "rank": batch["rank"].take(pa.array(np.full(len(v), i))), "key": batch["key"].take(pa.array(np.full(len(v), i))), "start": pa.array(at.astype(np.int32))})


def _marked_starts(h: np.ndarray, marked: pa.Scalar) -> np.ndarray:
    return np.flatnonzero(np.isin(window_anchors(h), marked.values.to_numpy(zero_copy_only=False).view(np.uint64)))


def _stretches(it):
    """Runs of windows with one owner, as text: reference (the document is the owner) and stream."""
    for batch in it:
        out = {c: [] for c in ("owner", "rank", "key", "first", "words", "n")}
        for rank, key, text, starts, owners in zip(batch["rank"].to_pylist(), batch["key"].to_pylist(), batch["text"].to_pylist(), batch["starts"], batch["owners"]):
            words = text.encode("utf-8", "surrogatepass").split()
            at, own = (x.values.to_numpy(zero_copy_only=False) for x in (starts, owners))
            order = np.argsort(at)
            at, own = at[order], own[order]
            cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(own) != 0), True])
            for p, q in zip(cut[:-1], cut[1:]):
                first, last = int(at[p]), int(at[q - 1]) + WINDOW
                for c, v in zip(out, (int(own[p]), rank, key, first, b" ".join(words[first:last]), last - first)):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict({"owner": pa.array(out["owner"], pa.int64()), "rank": pa.array(out["rank"], pa.int64()), "key": pa.array(out["key"], pa.string()), "first": pa.array(out["first"], pa.int32()), "words": pa.array(out["words"], pa.binary()), "n": pa.array(out["n"], pa.int64())})


class SuffixAutomaton:
    """The suffix automaton of a sequence of symbols: states hold their longest length, suffix link and first end."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        nexts, link, length, end = self.next, self.link, self.length, self.end
        last = 0
        for at, c in enumerate(symbols):
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            end.append(at)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    end.append(end[q])
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def matches(self, symbols: list[int]):
        """For each symbol: length of the longest match that ends there, and where that string first ends in the sequence."""
        state = length = 0
        nexts, link, lengths, end = self.next, self.link, self.length, self.end
        for c in symbols:
            while state and c not in nexts[state]:
                state = link[state]
                length = lengths[state]
            if c in nexts[state]:
                state = nexts[state][c]
                length += 1
            else:
                state = length = 0
            yield length, end[state]


def _match(reference: pd.DataFrame, stream: pd.DataFrame) -> pd.DataFrame:
    """Spans of the streamed stretches that stand in the reference of a document with a smaller id."""
    number: dict[bytes, int] = {}
    symbols: list[int] = []
    rank_at: list[int] = []
    for rank, words in sorted(zip(reference["ref_rank"], reference["ref_words"])):
        own = [number.setdefault(w, len(number)) for w in words.split()]
        symbols += own
        rank_at += [rank] * len(own)
        symbols.append(-len(rank_at) - 1)  # a symbol of its own: no match runs over it
        rank_at.append(2**63 - 1)
    automaton = SuffixAutomaton(symbols)
    out = []
    for rank, key, first, words in zip(stream["rank"], stream["key"], stream["first"], stream["words"]):
        upto = -1
        for at, (length, end) in enumerate(automaton.matches([number.get(w, -1) for w in words.split()])):
            if length >= WINDOW and rank_at[end] < rank:
                lo = at - length + 1
                if out and upto >= lo - 1 and out[-1][0] == key and out[-1][1] == rank and upto >= 0:
                    out[-1][3] = first + at + 1
                else:
                    out.append([key, rank, first + lo, first + at + 1])
                upto = at
    return pd.DataFrame(out, columns=["key", "rank", "lo", "hi"])


def _remaining(it):
    """Counts and digests of what the spans leave."""
    for batch in it:
        removed, sha, kept_text = [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()
            gone = np.zeros(len(words), dtype=bool)
            for s in spans:
                gone[s["lo"] : s["hi"]] = True
            removed.append(int(gone.sum()))
            left = b" ".join([w for w, g in zip(words, gone) if not g])
            sha.append(hashlib.sha256(left).hexdigest())
            kept_text.append(left)
        yield pa.RecordBatch.from_pydict({"rank": batch["rank"], "key": batch["key"], "removed": pa.array(removed, pa.int64()), "left": pa.array(sha, pa.string()), "kept": pa.array(kept_text, pa.binary()).cast(pa.string())})


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Spans:
    """What substring deduplication finds in docs(doc_id, text)."""

    def __init__(self, docs: DataFrame):
        # rank orders rows by id, those without an id last; key tells rows of one rank apart by their text
        text = F.coalesce(docs["text"].cast("string"), F.lit(""))
        self.texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("rank", id_key()).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
        self.survey = stored(self.texts.mapInArrow(_survey, "doc_id long, rank long, key string, n_words long, sha string, anchors array<long>"), "survey")
        self.firsts = stored(self.survey.groupBy("key").agg(F.min("rank").alias("first_rank")), "firsts")
        self.spans = self._spans()

    def _spans(self) -> DataFrame:
        """(rank, key, spans) of the first of equal texts, where anything goes."""
        shown = self.survey.filter("n_words >= 50").groupBy("key", "rank").agg(F.first("anchors").alias("anchors"))
        shown = shown.join(self.firsts, "key").filter("rank = first_rank").select("rank", "key", F.explode("anchors").alias("anchor"))
        shown = stored(shown, "anchors")
        shared = shown.groupBy("anchor").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).filter("lo < hi").select("anchor")
        shared = stored(shared, "shared")
        marked = shown.join(shared, "anchor").groupBy("rank", "key").agg(F.collect_list("anchor").alias("marked"))
        doubtful = stored(self.texts.join(marked, ["rank", "key"]).select("rank", "key", "text", "marked"), "doubtful")
        windows = stored(doubtful.mapInArrow(_doubtful, "hash long, rank long, key string, start int"), "windows")
        owners = windows.groupBy("hash").agg(F.min("rank").alias("owner"), F.max("rank").alias("other")).filter("owner < other").select("hash", "owner")
        # a stored table on the other side, so that Spark can split the rows of a hot window
        owners = stored(owners, "owners")
        placed = windows.join(owners, "hash").groupBy("rank", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("owner").alias("owners"))
        kinds = "owner long, rank long, key string, first int, words binary, n long"
        stretches = stored(doubtful.join(placed, ["rank", "key"]).select("rank", "key", "text", "starts", "owners").mapInArrow(_stretches, kinds), "stretches")
        return self._matched(stretches).groupBy("rank", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def _matched(self, stretches: DataFrame) -> DataFrame:
        reference = stretches.filter("owner = rank").select(F.col("owner").alias("at"), F.col("rank").alias("ref_rank"), F.col("words").alias("ref_words"), F.col("n").alias("ref_n"))
        stream = stretches.filter("owner < rank")
        total = reference.agg(F.sum("ref_n")).first()[0] or 0
        shards = max(1, -(-total // SHARD_WORDS))
        shard = lambda owner: F.pmod(F.xxhash64(owner), F.lit(shards)).cast("int")
        copies = stream.groupBy(shard("owner").alias("shard")).agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("copies"))
        copies = stored(copies, "copies")
        left = reference.withColumn("shard", shard("at")).join(copies, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        right = stream.withColumn("shard", shard("owner")).join(copies, "shard").withColumn("salt", F.pmod(F.xxhash64("rank", "key", "first"), F.col("copies")).cast("int"))
        a = left.select("shard", "salt", "ref_rank", "ref_words").groupBy("shard", "salt")
        b = right.select(F.col("shard").alias("to"), F.col("salt").alias("part"), "rank", "key", "first", "words").groupBy("to", "part")
        return stored(a.cogroup(b).applyInPandas(lambda x, y: _match(x, y), "key string, rank long, lo int, hi int"), "spans")

    def remaining(self) -> DataFrame:
        """(rank, key, removed, left, kept) of the first of equal texts, where anything goes."""
        return self.texts.join(self.spans, ["rank", "key"]).select("rank", "key", "text", "spans").mapInArrow(_remaining, "rank long, key string, removed long, left string, kept string")

    def report(self) -> DataFrame:
        """One row per row: doc_id, n_words, n_removed, kept_sha256."""
        cut = self.remaining().groupBy("rank", "key").agg(F.first("removed").alias("removed"), F.first("left").alias("left"))
        out = self.survey.join(self.firsts, "key").join(cut, ["rank", "key"], "left")
        copy = (F.col("rank") > F.col("first_rank")) & (F.col("n_words") >= WINDOW)
        return out.select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
        )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256."""
    return Spans(docs).report()


def keep_substrings(docs: DataFrame) -> DataFrame:
    """docs with the words that stay, joined by one space where words went; all columns are kept."""
    found = Spans(docs)
    rank, key, cut_rank, cut_key, kept, same, first = unused(docs, 7)
    cut = found.remaining().groupBy(F.col("rank").alias(cut_rank), F.col("key").alias(cut_key)).agg(F.first("kept").alias(kept))
    firsts = found.firsts.select(F.col("key").alias(same), F.col("first_rank").alias(first))
    keyed = docs.withColumn(rank, id_key()).withColumn(key, F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256))
    both = keyed.join(firsts, F.col(key) == F.col(same)).join(cut, (F.col(rank) == F.col(cut_rank)) & (F.col(key) == F.col(cut_key)), "left")
    gone = (F.col(rank) > F.col(first)) & (F.regexp_count("text", F.lit(WORD)) >= WINDOW)
    text = F.when(gone, F.lit("")).when(F.col(kept).isNotNull(), F.col(kept)).otherwise(F.col("text"))
    return both.withColumn("text", text).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, row, unnest(range(1, len(words) - 48)) AS p, words FROM d WHERE len(words) >= 50),
h AS (SELECT doc_id, row, p, md5(array_to_string(words[p:p + 49], ' ')) AS h FROM w),
m AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h),
s AS (SELECT row, p FROM h JOIN m USING (h) WHERE doc_id > first_id OR (doc_id IS NULL AND first_id IS NOT NULL)),
g AS (SELECT DISTINCT row, unnest(range(p, p + 50)) AS k FROM s),
k AS (SELECT row, list(k) AS gone FROM g GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (row)"""


