"""Top-k search, conversation repair and source divergence against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from atriaflow.llm import divergence, maxscore, queries, repair

# ---- top-k search --------------------------------------------------------------------------------------

VECTORS = "vec_id long, v array<double>, score string, rank int"


def found(spark, rows, k, cells=None):
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], VECTORS)
    got = maxscore.top_k(maxscore.whole_vectors(df, "vec_id", "v", 64, F.col("vec_id") % 20 == 0), k).collect()
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def top_by_hand(rows, k):
    whole = [(i, [min(max(math.floor(64 * x), -(2**63)), 2**63 - 1) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (i, q) in enumerate(whole):
        if i is None or i % 20:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(q, x)), -(2**63)), 2**63 - 1), j) for n, (j, x) in enumerate(whole) if n != at]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out.update((i, rank, j, s) for rank, (s, j) in enumerate(scored[:k], 1))
    return out


def test_top_k_over_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12).round(1)]) for i in range(400)]  # many ties
    monkeypatch.setattr(maxscore, "SHARD_CELLS", 12 * 30)
    monkeypatch.setattr(maxscore, "WAVE", 3)
    assert found(spark, rows, 5) == top_by_hand(rows, 5)


def test_terms_that_cannot_compete_are_probed_only(spark):
    """A shard's essential terms are fewer than all, and rows drop out on the way."""
    rng = np.random.default_rng(2)
    cells = rng.integers(-3, 4, (500, 24))
    cells[:, 0] *= 40
    block = {"part": 9, "nth": 0, "width": 24, "asks": [0], "query_ids": [0], "queries": np.array([[5] + [1] * 23], "<i8").tobytes()}
    shard = maxscore.Shard({"part": 1, "nth": 0, "ids": list(range(500)), "width": 24, "cells": cells.astype("<i8").tobytes()})
    scores = cells @ np.array([5] + [1] * 23)
    floor = int(np.sort(scores)[-10])
    got = [(row, s) for _, row, s in maxscore._search(block, [floor], shard, 10)]
    want = sorted(range(500), key=lambda i: (-scores[i], i))[:10]
    assert [r for r, _ in got] == want and [s for _, s in got] == [int(scores[i]) for i in want]
    # a floor that nothing reaches finds nothing, one below all finds the best k
    assert not list(maxscore._search(block, [int(scores.max()) + 1], shard, 10))
    assert [r for _, r, _ in maxscore._search(block, [int(scores.min()) - 1], shard, 10)] == want


def test_top_k_odd_vectors(spark):
    odd = [(0, None), (20, [1.0, None]), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (80, []), (100, [1.0, -2.0]), (100, [1.0, -2.0]), (None, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [3.0]), (3, [1e300, -1e300]), (120, [1e18, 5.0]), (4, [-1.0, 2.0, 9.0])]
    for k in (1, 3, 50):
        assert found(spark, odd, k) == top_by_hand(odd, k)
    assert not found(spark, [], 3) and not found(spark, [(20, [1.0])], 3) and not found(spark, [(1, [1.0]), (2, [1.0])], 3)


# ---- conversation repair -------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, place string, cost string"
PATTERN = re.compile(r"(s?(ua)+)?")


def test_repair_against_all_edits():
    rng = np.random.default_rng(3)
    texts = ["a.", "b", "", "c!", "a."]
    for n in (0, 1, 2, 3, 4):
        for _ in range(12):
            rows = [(str(rng.choice(["user", "assistant", "system", "tool"])), str(rng.choice(texts))) for _ in range(n)]
            seen, kinds = set(), ""
            for role, text in rows:
                kind = {"u": "u", "a": "a", "s": "s"}.get(role[0], "x")
                kinds += "-" if not text or (role, text) in seen else kind if text[-1] in ".!?" else kind.upper()
                seen.add((role, text))
            edits, cost, _ = repair.trace(kinds, repair.END, repair.NONE, True)
            audit = "".join("I" * len(i) + e for i, e, _ in edits)
            assert (cost, audit) == _cheapest(rows, kinds), (rows, kinds)


def _cheapest(rows, kinds):
    """Dijkstra-free search: all strings of edits up to a cost, by cost and then by audit."""
    frontier = {(0, "", 0, "")}  # row, audit, cost, initials
    done = []
    while frontier:
        then = set()
        for i, audit, cost, initials in frontier:
            if cost > 3 * len(rows) + 4:
                continue
            if i == len(rows) and PATTERN.fullmatch(initials):
                done.append((cost, audit))
            if len(initials) < 2 * len(rows) + 4:
                for x in "ua":
                    then.add((i, audit + "I", cost + 2, initials + x))
            if i < len(rows):
                then.add((i + 1, audit + "D", cost + 3, initials))
                if kinds[i] != "-":
                    cut = kinds[i].isupper()
                    then.add((i + 1, audit + "K", cost + cut, initials + (rows[i][0][:1] or " ")))
                    for x in "ua":
                        then.add((i + 1, audit + "R", cost + cut + 2, initials + x))
        frontier = {x for x in then if re.fullmatch(r"s?(ua)*u?", x[3])}
    return min(done)


def whole(rows):
    """Audit and cost of a conversation in one piece."""
    seen, kinds = set(), ""
    for role, text in rows:
        kind = {"u": "u", "a": "a", "s": "s"}.get(role[:1], "x")
        bare = text.rstrip(repair.SPACES)
        kinds += "-" if not bare or (role, text) in seen else kind if bare[-1] in ".!?" else kind.upper()
        seen.add((role, text))
    edits, cost, _ = repair.trace(kinds, repair.END, repair.NONE, True)
    return "".join("I" * len(i) + e for i, e, _ in edits), cost


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_chunks_converge_to_the_whole(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    for conv in (1, 2, 3, None):
        # user turns alone keep a constant from settling for long; others mix
        roles = ["user"] if conv == 2 else ["user", "assistant", "system", "user", "assistant"]
        rows += [(conv, t, str(rng.choice(roles)), f"{t}{rng.choice(['.', '', '!'])}", "x", "y") for t in range(17)]
    out, _ = repair.repair(spark.createDataFrame(rows, TURNS))
    got = {r["conv_id"]: r for r in repair.report(out).collect()}
    turns = defaultdict(list)
    for r in repair.repaired(out).orderBy("place", "nth").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv in (1, 2, 3, None):
        audit, cost = whole([(r[2], r[3]) for r in rows if r[0] == conv])
        assert (got[conv]["audit"], got[conv]["cost"]) == (audit, cost)
        assert got[conv]["repaired_sha256"] == hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest()
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in turns[conv]))


def test_rerun_stops_where_vectors_agree():
    kinds = "su" + "ua" * 20
    old = repair._based(repair.END)
    edge = repair.left_edge(kinds, old)
    for new in ((0, 7, 1, 3), (5, 0, 0, 0), (2, 2, 2, 2)):
        assert repair.rerun(kinds, old, repair._closed(list(new)), edge) == repair.left_edge(kinds, repair._closed(list(new)))


def test_repair_odd_conversations(spark):
    rows = [(1, None, None, None, "p", "c"), (1, 5, "user", "hi.", "p", "c"), (1, 5, "user", "hi.", "p", "c"), (1, 9, "assistant", "a" * 5000 + "? \n", "p", "c"), (2, None, "system", "s.", "p", "c"), (None, 1, "user", "x", "p", "c")]
    got = {r["conv_id"]: r.asDict() for r in repair.report(repair.repair(spark.createDataFrame(rows, TURNS))[0]).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1] == {"conv_id": 1, "gaps": 3, "blank": 1, "duplicate": 1, "truncated": 0, "illegal": 2, "cost": 6, "audit": "DKDK", "repaired_sha256": sha(f"user:hi.\nassistant:{'a' * 5000}? \n")}
    assert (got[2]["gaps"], got[2]["audit"], got[2]["cost"], got[2]["repaired_sha256"]) == (0, "D", 3, sha(""))
    assert (got[None]["audit"], got[None]["cost"], got[None]["truncated"]) == ("D", 3, 1)
    assert repair.report(repair.repair(spark.createDataFrame([], TURNS))[0]).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "Hi. Yes!", "p", "c") for c in range(20) for t in range(8)] + [(None, None, "assistant", None, "p", "c")]
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damage(spark.createDataFrame(rows, TURNS)).collect())
    want = Counter()
    for c, t, role, text, *_ in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        row = (c, t, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
        want[row] += {0: 0, 3: 2}.get(lot, 1)
    assert got == +want


# ---- source divergence ---------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n long, total string, item string"


def audit_by_hand(rows, least, top):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) for _, text, *_ in rows]
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for (_, _, lang, source), own in zip(rows, terms):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(own))
        counts[lang, source].update(own)
        counts[lang, None].update(own)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(group, t):
            return 1 + 10**9 * (counts[lang, group][t] + 2) // (sum(counts[lang, group][x] for x in kept) + 2 * len(kept))

        f = lambda a, b, t: (p(a, t) - p(b, t)) ** 2 // (p(a, t) + p(b, t))
        pairs = sorted(((sum(f(source, o, t) for t in kept), o) for k, o in groups if k == lang and o != source), key=lambda x: (-x[0], x[1].encode()))
        more = sorted(((f(source, None, t), t) for t in kept if counts[lang, source][t] and p(source, t) > p(None, t)), key=lambda x: (-x[0], x[1].encode()))[:top]
        for part, ranked in (("pair", pairs), ("term", more)):
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def audited(spark, rows, least, top):
    df = spark.createDataFrame([(*r, 1, "t", "i") for r in rows], DOCS)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, least, top).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence_against_counting(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["Haus", "haus", "été", "ÉTÉ", "x1y", "don't", "ß", "日本", "The"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 30)))), str(rng.choice(["de", "fr"])), str(rng.choice(["a", "b", "é", "c"]))) for i in range(120)]
    rows += [(500, None, "de", "silent"), (501, "", None, None), (502, "only here", "xx", "one"), (502, "only here", "xx", "one"), (503, "q\n" * 3000, "de", "a")]
    want = audit_by_hand(rows, 4, 5)
    assert audited(spark, rows, 4, 5) == want
    monkeypatch.setattr(divergence, "SEGMENT", 3)
    monkeypatch.setattr(divergence, "COUNT_BYTES", 64)
    assert audited(spark, rows, 4, 5) == want
    assert audited(spark, [], 4, 5) == set()
    assert audited(spark, rows, 10**6, 5) == audit_by_hand(rows, 10**6, 5)  # nothing is kept


def test_prices_of_large_counts():
    for count, total in ((0, 1), (5, 10**6), (9 * 10**14, 10**15), (0, 9 * 10**15)):
        assert int(divergence.price(np.array([count]), total)[0]) == 1 + 10**9 * (count + 2) // total


# ---- the SQL of all corpus queries ---------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles_run(name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    try:
        for table in ("documents", "embeddings", "pages", "conversations", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    except duckdb.IOException:
        pytest.skip("the given tables are not there")
    assert con.sql(queries.oracle_sql()[name]).fetchall()


# ---- packing with a quantum, sparse scoring -------------------------------------------------------------


@pytest.mark.parametrize("sizes", [[3000] * 2048, [30_000] * 100, [900_000, *[2000] * 300, 5], [400] * 7, [100_000, 90]])
def test_a_quantum_keeps_documents_together(sizes):
    from atriaflow.llm import packing

    quantum, total = packing.QUANTUM, sum(sizes)
    plan = packing.Plan(sizes, 2048, quantum)
    taken, pieces, documents = np.zeros(total, dtype=np.int64), 0, 0
    for i, n in enumerate(sizes):
        for start in range(0, n, 300):
            length, documents = min(300, n - start), documents + 1
            for w, offset, take in plan.pieces(i, start, length):
                assert offset + take <= 2048
                taken[w * 2048 + offset : w * 2048 + offset + take] += 1
                pieces += 1
    assert (taken == 1).all()  # every window but the last is full
    assert pieces <= 2.6 * documents
    # over a round of its level, a source has its share to within a quantum or two
    for i in (0, len(sizes) - 1):
        level, k = plan.places[i]
        if level == 0 and sizes[i] * 2048 >= quantum * total:
            served = [plan.levels[0]._exact(k, w + 1) - plan.levels[0]._exact(k, w) for w in range(total // 2048)]
            assert all(abs(x - sizes[i] * 2048 / total) < 1 for x in served)


def test_sparse_scores_equal_the_product():
    from atriaflow.llm import langid

    rng = np.random.default_rng(11)
    texts = ["", "a", "ÄÖ ß", "x" * 5, *("".join(rng.choice(list("abc é日"), int(rng.integers(0, 400)))) for _ in range(40))]
    for n in (1, 3, 40):
        logp = np.log(rng.dirichlet(np.ones(256), n)).astype(np.float32)
        got, grams = langid.Model([str(i) for i in range(n)], logp).log_likelihoods(texts)
        counts = langid.count_ngrams(texts, 256)
        assert np.allclose(got, counts @ logp.T.astype(float)) and (grams == counts.sum(axis=1)).all()


# ---- the pipeline, stage by stage, against plain Python and SQL ------------------------------------------


def test_pipeline_equals_brute_force(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from tokenizers import Tokenizer

    import corpus_pipeline
    from atriaflow.llm import mixing, packing

    rng = np.random.default_rng(12)

    def text(letters, n):
        return ["".join(rng.choice(list(letters), 4)) for _ in range(n)]

    rows = []
    for i in range(60):
        own = text("abcdefgh" if i % 2 else "стуфхцчш", 90)
        edited = list(own)
        edited[40] = "zz" if i % 2 else "яя"
        lang, source = ("aa", "bb")[i % 2], f"s{i % 4}" if i % 5 else None
        rows.append((10 * i, " ".join(own), lang, source))
        if i % 3 == 0:
            rows += [(10 * i + 1, " ".join(own), lang, "s9"), (10 * i + 2, " ".join(edited), lang, source)]
    rows += [(2000, None, "aa", "s0"), (2001, "12 34", "aa", "s0"), (2002, "", "bb", "s1"), (2003, "одно", "aa", "s1"), (2004, "cab", "bb", "s1")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], kinds).coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    # language: two alphabets leave no doubt, so only texts without a letter go
    stays = {i: (t, s) for i, t, _, s in rows if t and any(map(str.isalpha, t))}
    # exact copies: the largest id of each text
    largest = {}
    for i, (t, _) in stays.items():
        largest[t] = max(i, largest.get(t, i))
    stays = {i: (t, s) for i, (t, s) in stays.items() if largest[t] == i}
    # near copies: components of pairs, the least id of each
    windows = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, (t, _) in stays.items()}
    group = {i: i for i in stays}
    for i in sorted(stays):
        for j in sorted(stays):
            if i < j and len(windows[i] & windows[j]) / len(windows[i] | windows[j]) >= 0.8:
                group = {k: min(group[i], group[j]) if g in (group[i], group[j]) else g for k, g in group.items()}
    stays = {i: x for i, x in stays.items() if group[i] == i}
    # the mix, by the SQL that op9 is held against
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, (t, s) in stays.items()])
    result = con.sql(mixing.ORACLE)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in (dict(zip(result.columns, x)) for x in result.fetchall())}
    assert set(taken.values()) >= {1, 2} and set(got["doc_id"]) == {i for i, n in taken.items() if n}
    # packing: each copy's ids once, in full windows
    encode = Tokenizer.from_file(packing.vocabulary_path())
    for i, pieces in got.groupby("doc_id"):
        ids = np.array([*encode.encode(stays[i][0], add_special_tokens=False).ids, 1], dtype="<u4")
        assert Counter(p for r in pieces.itertuples() for p in range(r.start, r.start + r.length)) == Counter(dict.fromkeys(range(len(ids)), taken[i]))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in pieces.itertuples())
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    assert (ordered.groupby("sequence_id")["length"].sum().iloc[:-1] == packing.WINDOW).all()
