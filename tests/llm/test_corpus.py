"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from atriaflow.llm import chat, exact_dedup, langid, mixing, near_dedup, packing, quality, substring, syncmers, warc
from atriaflow.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"


def docs(spark, rows):
    """rows (doc_id, text[, lang[, source]]), with an extra column whose name operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (None, "a"), (5, "a"), (5, "a"), (None, None)]


def test_warc_round_trip_and_magic_in_payloads(spark):
    inner = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.0 é"
    rows = [(1, "u", inner), (2, None, None), (3, "a b\r\nc", "plain"), (4, "u", inner), (None, "n", "plain"), (None, None, "alone"), (7, "z", "dup"), (7, "z", "dup"), (9, "y", "")]
    path = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_warc(spark, path, with_payload=True).collect()
    assert len(got) == len(rows)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    by = {r["page_id"]: r for r in got}
    assert bytes(by[1]["payload"]).decode() == inner and by[1]["payload_digest"] == sha(inner)
    assert (by[4]["record_type"], by[4]["refers_to"], by[4]["payload_bytes"]) == ("revisit", 1, len(inner.encode()))
    assert by[9]["refers_to"] == 2 and by[2]["payload_bytes"] == 0 and by[3]["url"] == "a%20b%0D%0Ac"
    assert sorted(r["record_type"] for r in got if r["page_id"] == 7) == ["response", "response"]
    empty = new_path(spark, "e")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_pointer_jumping():
    start = np.array([0, 10, 15, 30, 50])
    assert list(warc.reachable(start, np.array([10, 30, 99, 50, 70]))) == [True, True, False, True, True]
    assert list(warc.reachable(start[1:], np.array([15, 30, 50, 70]))) == [False] * 4


def test_exact_groups(spark):
    got = exact_dedup.group_exact(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == 3
    assert {(r["keep_id"], r["group_size"]) for r in got if r["text_sha256"] == hashlib.sha256(b"a").hexdigest()} == {(5, 4)}
    assert exact_dedup.keep_exact(docs(spark, ODD)).count() == 3
    assert exact_dedup.group_exact(docs(spark, [])).count() == 0


def test_exact_history(spark):
    old, new = exact_dedup.light(docs(spark, [(1, "a"), (2, "b")])), exact_dedup.light(docs(spark, [(3, "a"), (4, "c"), (5, "c")]))
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.resolve(new, old).collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}


def test_exact_history_of_one_table(spark):
    rows = [(i, f"t{i % 7}") for i in range(10)] + [(20, "t1"), (None, "t2"), (None, "new"), (None, "new"), (20, "t1")]
    got = exact_dedup.group_exact(docs(spark, rows)).toPandas()
    for r in got.itertuples():
        own = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in own if i is not None]
        assert r.group_size == len(own) and (r.keep_id == max(ids) if ids else r.keep_id != r.keep_id)
    assert got.groupby("text_sha256")["kept"].sum().eq(1).all()
    clash = docs(spark, rows).withColumnRenamed("label", "__own0").withColumnRenamed("lang", "digest")
    assert exact_dedup.keep_exact(clash).columns == clash.columns and exact_dedup.keep_exact(clash).count() == 8


def test_perfect_hash_is_minimal(spark):
    rows = [(i, f"t{i}") for i in range(9000)]
    index = exact_dedup.build_index(exact_dedup.winners(exact_dedup.light(docs(spark, rows))), ["winner"])
    slots = index.slots.toPandas()
    for _, g in slots.groupby("region"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_perfect_hash_takes_another_seed():
    made = [hashlib.sha256(bytes([i])).hexdigest() for i in range(40)]
    # two digests that differ, but agree in both hashes of the first seed
    made[1] = made[1][:21] + made[0][21:35] + made[1][35:]
    got = exact_dedup._fill(pa.table({"digest": made, "bucket": [i // 4 for i in range(40)]}))
    assert min(got["seed"].to_pylist()) > 0 and sorted(got["slot"].to_pylist()) == list(range(40))
    with pytest.raises(ValueError):
        exact_dedup._fill(pa.table({"digest": [made[0]] * 2, "bucket": [0, 0]}))


def test_quality_ranks_held_out(spark):
    good = [(i, words(i, 80).capitalize() + ".") for i in range(150)]
    bad = [(i, "$$$ ### " * 40 + words(i, 5).upper()) for i in range(150, 300)]
    d = docs(spark, good + bad + [(900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 300, 2)] + [(0, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(d, labels).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in range(1, 300, 2)]) > 0.95
    assert {r["score"] for r in quality.score(d, labels.filter("quality = 7")).collect()} == {0.5}


def test_pairwise_loss_is_least():
    """The weights against plain gradient descent on the same loss over the same pairs."""
    r = np.random.default_rng(4)
    x, good = r.normal(size=(60, 3)), np.arange(60) < 25
    x[good, 0] += 1.0
    got = quality._bradley_terry(x, good, 400, quality.ROUNDS)
    rng = np.random.default_rng(0)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    d = x[rng.choice(up, 400)] - x[rng.choice(down, 400)]
    w = np.zeros(3)
    for _ in range(20_000):
        w += 0.05 * ((d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) - quality.RIDGE * w)
    assert np.allclose(got, w, atol=1e-4)


def test_quality_features_and_defined_cases(spark):
    texts = ["Ab, cd.\nab!", "", "x", "é é $$"]
    raw = [t.encode() for t in texts]
    f = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    at = quality.FEATURES.index
    assert f.shape == (4, quality.WIDTH) and f[0, at("upper")] == 1 / 11 and f[0, at("newline")] == 1 / 11 and list(f[:, at("no_text")]) == [0, 1, 0, 0]
    assert f[3, at("distinct_words")] == 2 / 3 and np.allclose((f[:, len(quality.FEATURES) : -quality.HASHED] ** 2).sum(axis=1), [1, 0, 1, 1])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = [(i, words(1, 30) if i % 2 else "$$$ ||| " * (20 if i else 20_000)) for i in range(40)]
    got = quality.score(docs(spark, rows + rows[:3]), labels).toPandas()
    assert len(got) == 43 and got.groupby("doc_id")["score"].nunique().max() == 1
    assert ((got["score"] > 0.5) == (got["doc_id"] % 2 == 1)).all()
    assert quality.score(docs(spark, []), labels).count() == 0


def test_syncmers_are_context_free():
    a, b, c = words(1, 300), words(2, 200), words(3, 200)
    at, h = syncmers._syncmers(np.frombuffer((b + a).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    at2, h2 = syncmers._syncmers(np.frombuffer((c + a).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    assert set(h[at >= len(b)]) == set(h2[at2 >= len(c)])
    k, s = syncmers.K, syncmers.S
    text = b + a
    inner = syncmers._rolling(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1), s)
    brute = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    assert list(at) == brute


def test_fingerprints_follow_the_next_document(spark):
    rows = [(i, words(i, 60)) for i in range(40)] + [(None, None), (41, ""), (42, "short"), (43, words(5, 9000))]
    got = {r["doc_id"]: r for r in syncmers.fingerprint_documents(docs(spark, rows).repartition(7)).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [(None, "")]
    for i, (doc_id, text) in enumerate(order):
        want = syncmers.edited(text or "", order[(i + 1) % len(order)][1] or "")
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[7]["near_edited"] > 0.3 > 0.05 > got[7]["near_next"] and got[41]["fingerprint"] == ""
    one = syncmers.fingerprint_documents(docs(spark, [(1, "abc" * 30)])).first()
    assert one["near_next"] == 1.0


def test_fingerprints_hold_all_anchors_below_the_threshold():
    texts = [words(1, 40), words(2, 3000), "ab" * 4000, "short", ""]
    for t, f in zip(texts, syncmers.fingerprints(texts)):
        at, h = syncmers._syncmers(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        brute = [(int(x), int(p)) for x, p in zip(h, at) if x <= f.limit]
        if len(t) > 12:
            assert list(zip(f.h.tolist(), f.at.tolist())) == brute
            assert len({x for x, _ in brute}) >= min(syncmers.LEAST, len(set(h.tolist())))
    assert len(syncmers.fingerprints([words(2, 3000)])[0].at) > 150  # grows with the text
    assert [str(f) == "" for f in syncmers.fingerprints(texts)] == [False] * 4 + [True]


def test_every_window_is_looked_at():
    """One other letter anywhere but at the ends shows in the fingerprint and in the likeness; samples are coordinated as before."""
    text = words(4, 600)
    own = syncmers.fingerprints([text])[0]
    gap = syncmers.K - syncmers.S
    for at in range(gap, len(text) - gap, 37):
        other = syncmers.fingerprints([text[:at] + "#" + text[at + 1 :]])[0]
        assert str(other) != str(own) and 0.9 < own.likeness(other) < 1
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    assert own.at.tolist() == syncmers._syncmers(codes)[0].tolist() and np.diff(own.at).max() <= gap + 1
    sample = syncmers.fingerprints([words(2, 3000)], 16)[0]
    assert 150 < len(sample.at) < len(syncmers.fingerprints([words(2, 3000)])[0].at) / 8 and sample.limit == 2**64 // 16


def test_likeness_is_the_longest_common_chain():
    r = np.random.default_rng(8)

    def brute(a, b):
        limit = min(a.limit, b.limit)
        sides = []
        for f in (a, b):
            seen, out = {}, {}
            for h, p in zip(f.h.tolist(), f.at.tolist()):
                if h <= limit:
                    seen[h] = seen.get(h, -1) + 1
                    out[h, seen[h]] = p
            sides.append(out)
        x, y = ([k for k, _ in sorted(s.items(), key=lambda e: e[1]) if k in sides[1 - i]] for i, s in enumerate(sides))
        table = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        either = len(sides[0].keys() | sides[1].keys())
        return table[-1, -1] / either if either else 0.0

    for _ in range(30):
        a, b = words(int(r.integers(3)), int(r.integers(20, 400))), words(int(r.integers(3)), int(r.integers(20, 400)))
        cut = int(r.integers(len(a)))
        f, g = syncmers.fingerprints([a, b[cut // 2 :] + a[cut:] + b[: cut // 2]])
        assert f.likeness(g) == brute(f, g)


def test_ranges_of_the_order():
    bounds = np.array([[-5, 3], [-5, 9], [0, 0], [7, 1]])
    at, bound = syncmers.placed_in(bounds, np.array([-5, -5, -5, -4, 0, 7, 8]), np.array([3, 8, 9, 0, 0, 2, 0]))
    assert list(at) == [0, 0, 1, 1, 2, 3, 3] and list(bound) == [True, False, True, False, True, False, False]


def test_fingerprints_of_repeated_rows(spark):
    rows = [(i % 5, f"{i % 5} text") for i in range(200)] + [(None, "n")] * 3 + [(9, "b"), (9, "a")]
    got = syncmers.fingerprint_documents(docs(spark, rows).repartition(6)).toPandas()
    assert len(got) == len(rows) and syncmers.fingerprint_documents(docs(spark, [])).count() == 0
    inner = got[got["doc_id"] == 3]["edited_sha256"].value_counts()
    # all but the last of equal rows are followed by one of their own
    assert sorted(inner) == [1, 39] and inner.idxmax() == hashlib.sha256(syncmers.edited("3 text", "3 text").encode()).hexdigest()


def test_near_groups_equal_brute_force(spark):
    base = [words(i, 120).split() for i in range(25)]
    rows, passage = [], words(99, 60).split()
    for i, w in enumerate(base):
        rows.append((10 * i, " ".join(w)))
        for j in range(3):
            v = list(w)
            v[7 * j + 3] = "zz"
            rows.append((10 * i + j + 1, " ".join(v)))
    rows += [(1000 + i, " ".join(words(500 + i, 50).split() + passage)) for i in range(30)] + [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two"), (None, "one two")]
    got = near_dedup.group_near(docs(spark, rows)).toPandas()
    assert len(got) == len(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows if t and i is not None}
    cls = {r.doc_id: r.class_id for r in got.itertuples() if r.doc_id == r.doc_id}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                assert cls[a] == cls[b]
    assert len({cls[1000 + i] for i in range(30)}) == 30 and len({cls[10 * i] for i in range(25)}) == 25
    assert near_dedup.keep_near(docs(spark, rows)).count() == got["class_id"].nunique() == got["kept"].sum()
    assert near_dedup.group_near(docs(spark, [])).count() == 0


def near_classes(spark, rows):
    return {r["doc_id"]: r["class_id"] for r in near_dedup.group_near(docs(spark, rows)).collect()}


def test_near_groups_of_short_texts(spark):
    rows = []
    for i in range(40):
        w = words(7000 + i, 40).split()
        rows += [(100 * i, " ".join(w[:9])), (100 * i + 1, " ".join(w[:8] if i % 2 else w[1:9])), (100 * i + 2, " ".join(w[:6]))]
        rows += [(100 * i + 10, " ".join(w[10:34])), (100 * i + 11, " ".join(w[10:38]))]  # 20 and 24 shingles
    cls = near_classes(spark, rows)
    assert all(cls[100 * i + 1] == 100 * i and cls[100 * i + 2] == 100 * i + 2 and cls[100 * i + 11] == 100 * i + 10 for i in range(40))


def test_near_groups_keep_the_order(spark):
    rows = []
    for i in range(20):
        w = words(8000 + i, 160).split()
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w[80:] + w[:80])), (10 * i + 2, " ".join(w * 3)), (10 * i + 3, " ".join([*w[:40], "zz", *w[40:]]))]
    # 0.83 of the windows in common, through an alignment of some 900 edits
    p = words(1, 1).split() + words(2, 1).split()
    rows += [(10_000 + i, " ".join([*words(3 + i, 450).split(), *p * 2500])) for i in range(2)]
    cls = near_classes(spark, rows)
    assert all([cls[10 * i + j] - 10 * i for j in range(4)] == [0, 1, 2, 0] for i in range(20))
    assert cls[10_001] == 10_000


def test_near_groups_of_many_copies(spark):
    """Copies of one text that are alike only through it, and pairs that are alike among many texts of one form."""
    rng, rows = np.random.default_rng(11), []
    base = words(1, 200).split()
    rows.append((0, " ".join(base)))
    for i in range(1, 300):
        v = list(base)
        for at in rng.choice(200, 4, replace=False):
            v[at] = f"x{i}y{at}"
        rows.append((i, " ".join(v)))
    form = words(2, 150).split()
    for i in range(100):
        own = words(300 + i, 50).split()
        rows += [(1000 + 2 * i, " ".join(form + own)), (1001 + 2 * i, " ".join([*form, *own[:-1], "zz"]))]
    cls = near_classes(spark, rows)
    assert {cls[i] for i in range(300)} == {0}
    assert all(cls[1000 + 2 * i] == cls[1001 + 2 * i] == 1000 + 2 * i for i in range(100))


def frequent_window(spark, monkeypatch, rows, fanout):
    """The links found among texts that all share one window, and how often pairs were aligned."""
    monkeypatch.setattr(near_dedup, "FANOUT", fanout)
    texts = near_dedup.stored(spark.createDataFrame([(i, t, len(t.split()) - 4) for i, t in rows], "id long, text string, n int"), "texts")
    found = near_dedup.Links(texts.select("id", "text"))
    found.try_pairs(spark.createDataFrame([], "a long, b long"))
    signed = near_dedup.signatures(texts.select("id", F.col("id").alias("label"), "n", "text"))
    near_dedup.try_frequent(found, texts.select(F.lit(7).cast("long").alias("w"), "id", "n"), signed)
    return {(r["a"], r["b"]) for r in found.links().collect()}, sum(t.count() for t in found.tried), len(found.tried)


@pytest.mark.parametrize("fanout", [2, 16])
def test_frequent_windows_lose_no_pair(spark, monkeypatch, fanout):
    rows = []
    for i in range(30):
        w = words(100 + i, 60).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "other"]))]
    links, aligned, rounds = frequent_window(spark, monkeypatch, rows, fanout)
    # no two texts but these pairs can be alike, and the signatures tell without an alignment
    assert links == {(2 * i, 2 * i + 1) for i in range(30)} and aligned == 30 and rounds > 1


def test_signatures_pass_every_pair_that_is_linked(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6):
        w = words(200 + i, int(rng.integers(40, 1500))).split()
        for _ in range(12):
            v = list(w)
            for at in rng.integers(0, len(v), int(rng.integers(0, max(2, len(v) // 30)))):
                v[at] = "zz"
            rows.append((len(rows), " ".join(v[int(rng.integers(0, 4)) :])))
    table = spark.createDataFrame([(i, i, len(t.split()) - 4, t) for i, t in rows], "id long, label long, n int, text string")
    both = near_dedup.stored(table.join(near_dedup.signatures(table), "id"), "signed")
    other = near_dedup.stored(both, "signed")
    passed = {(r[0], r[1]) for r in both.join(other, (both["id"] < other["id"]) & near_dedup._may_match(both, other)).select(both["id"], other["id"]).collect()}
    pairs = spark.createDataFrame([(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))], "a long, b long")
    linked = {(r["a"], r["b"]) for r in near_dedup.verified(pairs, table.select("id", "text")).filter("linked").collect()}
    assert len(linked) > 50 and linked <= passed and len(passed) < len(rows) * (len(rows) - 1) // 4


def test_pairs_meet_at_one_window(spark):
    """Texts with a long form in common meet once, however many windows of it they share."""
    form, rows = words(5, 300).split(), []
    for i in range(24):
        own = words(900 + i, 70).split()
        rows += [(2 * i, " ".join(form + own)), (2 * i + 1, " ".join([*form[:-40], *own, "zz"]))]
    texts = near_dedup.stored(spark.createDataFrame([(i, t, len(t.split()) - 4) for i, t in rows], "id long, text string, n int"), "texts")
    found = near_dedup.Links(texts.select("id", "text"))
    open_ = texts.select("id", F.col("id").alias("label"), "n", "text")
    members = near_dedup._first_windows(open_)
    met = near_dedup._meetings(found, members, near_dedup.signatures(open_))[0].collect()
    assert len(met) == len(set(met))
    everyone = spark.createDataFrame([(i, j) for i in range(48) for j in range(i + 1, 48)], "a long, b long")
    linked = {(r["a"], r["b"]) for r in near_dedup.verified(everyone, texts.select("id", "text")).filter("linked").collect()}
    assert len(linked) > 20 and linked <= {tuple(r) for r in met}


def test_texts_meet_beside_hubs_of_other_sizes(spark):
    x = words(1, 100).split()
    texts = {1: x, 2: [*x[:-1], "zz"], 3: [*x, *words(2, 100).split()], 4: words(3, 200).split()}
    sketched = spark.createDataFrame([(i, len(t) - 4, k) for (i, t), k in zip(texts.items(), ([1], [1], [1, 2], [2]))], "id long, n int, keys array<long>")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    found = near_dedup.link_texts(sketched, lambda ids: table.join(ids, "id"))
    assert [tuple(r) for r in found.links().collect()] == [(1, 2)]


def test_order_minhash_is_the_sample_in_text_order():
    r = np.random.default_rng(2)
    texts = [r.integers(0, 9, n).astype(np.uint64) for n in (20, 21, 24, 25, 300, 40, 5000, 3, 0, 22)]
    bounds = np.cumsum([0, *map(len, texts)])
    counts, keys = near_dedup.text_keys(near_dedup.mix64(np.concatenate(texts)), bounds)
    assert list(counts) == [max(1, len(t) - 4) if len(t) else 0 for t in texts]
    assert [len(k) for k in keys[4:9]] == [24, 24, 24, 1, 0]
    x, row = near_dedup.shingle_rows(near_dedup.mix64(texts[4]), np.array([0, 300]))
    y, seen = near_dedup.labelled_rows(x, row), {}
    brute = np.array([v + np.uint64(seen.setdefault(int(v), []).append(0) or len(seen[int(v)]) - 1) * np.uint64(0x9E3779B97F4A7C15) for v in x])
    assert (y == brute).all()
    v = (y ^ near_dedup._SEEDS[3]) * (near_dedup._SEEDS[3 + near_dedup.SKETCHES] | np.uint64(1))
    v ^= v >> np.uint64(32)
    v *= np.uint64(0x94D049BB133111EB)
    key = np.uint64(0)
    for at in np.sort(np.argsort(v)[: near_dedup.TUPLE]):
        key = key * np.uint64(0x100000001B3) + y[at]
    assert keys[4][3] == near_dedup.mix64(np.array([key ^ near_dedup._SEEDS[3]]))[0]


def least_edit_windows(a, b, k=5):
    """All numbers of windows in the matched runs of alignments of least edits, by dynamic programming over all of them."""
    n, m = len(a), len(b)
    best = {(0, 0): (0, {(0, 0)})}  # edits, {(run length, windows)}
    for i in range(n + 1):
        for j in range(m + 1):
            for di, dj, cost in ((1, 0, 1), (0, 1, 1), (1, 1, 0)):
                if i >= di and j >= dj and (i - di, j - dj) in best and (cost or a[i - 1] == b[j - 1]):
                    d, ends = best[i - di, j - dj]
                    ends = {(0, w) for _, w in ends} if cost else {(r + 1, w + (r + 1 >= k)) for r, w in ends}
                    have = best.get((i, j))
                    if have is None or d + cost < have[0]:
                        best[i, j] = d + cost, ends
                    elif d + cost == have[0]:
                        best[i, j] = have[0], have[1] | ends
    d, ends = best[n, m]
    return d, {w for _, w in ends}


def test_alignment_has_the_least_edits():
    r = np.random.default_rng(5)
    for _ in range(60):
        a = r.integers(5, 9, r.integers(1, 25)).astype(np.uint64)
        b = r.integers(5, 9, r.integers(1, 25)).astype(np.uint64) if r.random() < 0.4 else np.delete(a, r.integers(0, len(a), 2))
        edits, windows = least_edit_windows(a.tolist(), b.tolist(), 3)
        for most in (2, 8, 60):
            got = near_dedup.matched_windows(a, b, most, 3)
            assert got in windows if edits <= most else got is None


def test_alignment_decides():
    a = np.arange(10, 210).astype(np.uint64)
    assert near_dedup.similarity(a, np.r_[a[100:], a[:100]]) < 0.5
    assert near_dedup.similarity(a, np.delete(a, 50)) == 191 / 200
    assert near_dedup.similarity(a, a.copy()) == 1.0 and near_dedup.similarity(a[:3], a[:4]) == 0.0


def test_bounds_cut_no_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 150).astype(np.uint64)

    def varied():
        x = base.copy()
        x[r.integers(0, 150, r.integers(0, 9))] = r.integers(0, 2**63)
        return np.delete(x, r.integers(150)) if r.random() < 0.3 else x

    a = [varied() for _ in range(200)] + [base[:3], base[:0], base[:0], base[:5], np.tile(base[:7], 30)]
    b = [varied() for _ in range(200)] + [base[:3], base[:0], base[:2], base[:6], np.tile(base[:7], 31)]
    want = [near_dedup.similarity(x, y) >= near_dedup.THRESHOLD for x, y in zip(a, b)]
    assert near_dedup.linked(a, b, step=1000) == want and 0 < sum(want) < len(want)
    assert near_dedup.linked([], []) == []
    for x in a[-8:]:
        assert (near_dedup.shingle_rows(x, np.array([0, len(x)]))[0] == near_dedup.shingles(x)).all()


def test_language_held_out(spark):
    rng = np.random.default_rng(0)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    rows = [(i, text("abcde") if i % 2 else text("defgh"), "aa" if i % 2 else "bb") for i in range(200)] + [(500, None, "aa"), (501, "12 34", "aa"), (502, "abc", None), (None, "abcab", "aa")]
    d = docs(spark, rows)
    model = langid.fit(d.filter("doc_id < 100"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(d, model).collect()}
    assert all(got[i] == ("aa" if i % 2 else "bb") for i in range(100, 200)) and got[500] == got[501] == "und"
    assert langid.fit(d.filter("doc_id < 0")).langs == []
    assert langid.keep_identified(d.withColumnRenamed("label", "score")).columns[-1] == "score"


def test_language_equals_plain_naive_bayes(spark):
    rng = np.random.default_rng(1)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))
    rows = [(i, text("abcdeé" if i % 2 else "éfgh日", 1 + i % 30), "aa" if i % 2 else "bb") for i in range(120)]
    model = langid.fit(docs(spark, rows))

    def grams(t):
        codes, bounds = langid._codes([t])
        return [int(h) for n in langid.NGRAMS for i in range(len(codes) - n + 1) for h in langid._hashed(codes[i : i + n], n, langid.BUCKETS)]

    counts = {lang: np.zeros(langid.BUCKETS) for lang in ("aa", "bb")}
    for _, t, lang in rows:
        for h in grams(t):
            counts[lang][h] += 1
    tests = [text("abfg日", 7), text("abc", 3), "é", text("aéf", 90_000), ""]  # the fourth takes several steps
    got, n = model.log_likelihoods(tests)
    for i, t in enumerate(tests):
        own = grams(t) if len(t) < 1000 else None
        if own is not None:
            want = [sum(np.log((counts[x][h] + 0.5) / (counts[x] + 0.5).sum()) for h in own) for x in ("aa", "bb")]
            assert n[i] == len(own) and np.allclose(got[i], want, rtol=1e-5)
    assert n[3] == 3 * (len(tests[3]) + 2) - 3


def test_language_defined_cases(spark):
    many = [(i, f"{words(i % 700, 6)}", f"l{i % 700}") for i in range(2100)]
    model = langid.fit(docs(spark, many))
    assert len(model.langs) == 700 and model.logp.size <= langid.MATRIX_CELLS
    same = langid.fit(docs(spark, [(1, "abc", "b"), (2, "abc", "a")]))
    got = langid.predict(docs(spark, [(1, "abc"), (1, "abc"), (None, "x" * 300_000), (2, None)]), same).toPandas()
    assert list(got["lang_pred"]) == ["a", "a", "a", "und"] and list(got["score"])[:2] == [0.5, 0.5]
    assert langid.predict(docs(spark, []), same).count() == 0 and langid.fit(docs(spark, [])).score(["abc"]) == (["und"], [0.0])


TURNS = "conv_id long, turn long, role string, text string, part string, n string"


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye <|im_end|>"), (2, 0, "system", "only"), (3, None, None, "x")]
    got = {(r["conv_id"], r["part"], r["perspective"]): r for r in chat.rotate(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (3, 0, "unknown")}
    r = got[1, 0, "ann"]
    spans = [r["rendered"][slice(*map(int, x.split(":")))] for x in r["mask"].split(",")]
    assert spans == ["hi<|im_end|>\n", "bye <\\|im_end|><|im_end|>\n"]
    assert "user name=bob" in r["rendered"] and r["n_chars"] == len(r["rendered"]) and r["starts_at"] == 0
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_renders_whole_dialogues(spark):
    """Conversations longer than a row, with equal and null turns, repeated rows and long texts, against a plain rendering."""
    rng = np.random.default_rng(3)
    names = ["ann", "bo\nb", "system", None, "assistant"]
    rows = [(int(rng.integers(2)) or None, [None, 5, int(rng.integers(50))][i % 3], names[int(rng.integers(5))], "t" * int(rng.integers(9))) for i in range(700)]
    rows += [(7, 0, "ann", "é" * 200_000), (7, 0, "ann", "é"), *[(8, 1, "bob", "same")] * 30]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(5)
    got = {}
    for r in sorted(chat.rotate(turns, 16).collect(), key=lambda r: r["part"]):
        text, mask = got.setdefault((r["conv_id"], r["perspective"]), ("", []))
        assert r["starts_at"] == len(text) and r["n_chars"] == len(r["rendered"]) and r["n_turns"] <= 16
        got[r["conv_id"], r["perspective"]] = text + r["rendered"], mask + [tuple(map(int, x.split(":"))) for x in r["mask"].split(",") if x]
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((-1 if t is None else t, "unknown" if x is None else x, m) for c, t, x, m in rows if c == conv)
        for who in {x for _, x, _ in own} - {"system"}:
            text, mask = "", []
            for _, x, m in own:
                name = x.replace("\n", " ")
                text += "<|im_start|>" + ("assistant" if x == who else "system" if x == "system" else f"user name={name}") + "\n"
                mask += [(len(text), len(text) + len(m) + 11)] if x == who else []
                text += m + "<|im_end|>\n"
            want[conv, who] = text, mask
    assert got == want


def test_substrings_equal_brute_force(spark):
    p, q = words(1, 70), words(2, 55)
    rows = [(5, f"{words(3, 30)} {p} {words(4, 20)}"), (2, f"{p}  {words(5, 60)}\n{q}"), (9, f"{q} {words(6, 10)} {p}"), (1, words(7, 49)), (11, words(7, 49)), (12, f"{p}  {words(5, 60)}\n{q}"), (None, p), (13, None), (14, ""), (5, p)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(docs(spark, rows)).collect())
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if i is None else i)
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (1 << 62 if i is None else i):
                gone |= set(range(k, k + 50))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i or 0, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    assert got == sorted(want)


def test_substrings_keep_columns_that_clash(spark):
    p, q = words(1, 70), words(5, 60)
    rows = [(2, f"{p}  {q}"), (5, f"{words(3, 30)} {p} end"), (7, f"{p}  {q}"), (1, words(7, 49)), (None, None), (8, "")]
    names = ["__own0", "__r", "__k", "__rank", "__key", "__same", "__first", "__kept", "key", "rank", "kept"]
    table = docs(spark, rows).withColumns({n: F.coalesce(F.length("text"), F.lit(-1)) for n in names})
    got = substring.keep_substrings(table)
    assert got.columns == table.columns
    left = {r["doc_id"]: (r["text"], {r[n] for n in names}) for r in got.collect()}
    assert left == {i: (w, {-1 if t is None else len(t)}) for (i, t), w in zip(rows, [rows[0][1], f"{words(3, 30)} end", "", rows[3][1], None, ""])}
    assert substring.keep_substrings(table.limit(0)).count() == 0


def test_mixture_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", ["a", "b", None][i % 3]) for i in range(900)] + [(None, None, "en", "c")]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert len(got) == 901
    for _, g in got.groupby("source", dropna=False):
        taken, target = (g["size"] * g["times"]).sum(), g["target"].iloc[0]
        assert abs(taken - target) <= 7 and g["times"].max() <= 2 and target <= 2 * g["source_size"].iloc[0]
    assert mixing.keep_mixed(docs(spark, rows)).count() == got["times"].sum()
    assert mixing.mix(docs(spark, [])).count() == 0


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.vocabulary_path())
    rows = [(i, f"{words(i, 20 + 31 * (i % 9))}, Été's ΣΑΣ 12 <|endoftext|> É", "en", f"s{i % 4}" if i % 5 else None) for i in range(60)] + [(100, None), (101, ""), (102, words(1, 4000)), (103, "a\x1cb c İ")]
    got = packing.pack(docs(spark, rows)).toPandas()
    for i, text, *_ in rows:
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in got[got["doc_id"] == i].sort_values("start").itertuples():
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(ids[at : at + r.length].tobytes()), len(ids))
            at += r.length
        assert at == len(ids)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    sizes = ordered.groupby("sequence_id")["length"].sum()
    assert (sizes.iloc[:-1] == packing.WINDOW).all()
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n_sources", [1, 3, 90])
def test_schedule_carries_deficits(n_sources):
    sizes = [int(x) for x in np.random.default_rng(n_sources).integers(3000, 9000, n_sources)]
    plan = packing.Schedule([0, *sizes], 2048)
    windows = -(-sum(sizes) // 2048)
    for w in range(windows):
        served = [plan._exact(k, w + 1) - plan._exact(k, w) for k in range(n_sources + 1)]
        assert min(served) >= 0 and sum(served) == min(2048, sum(sizes) - 2048 * w)


@pytest.mark.parametrize("sizes", [[5000] * 100, [400_000, *[4000] * 200], [300_000, *[20 + i % 7 for i in range(3000)], 1], [3]])
def test_every_window_has_the_proportions(sizes):
    plan, total = packing.Plan(sizes, 2048), sum(sizes)
    served, taken = np.zeros((-(-total // 2048), len(sizes)), dtype=np.int64), np.zeros(total, dtype=np.int64)
    for i, n in enumerate(sizes):
        at = 0
        for start, length in ((0, n // 3), (n // 3, n - n // 3)):
            for w, offset, take in plan.pieces(i, start, length):
                assert offset + take <= 2048 and w * 2048 + offset >= at
                at = w * 2048 + offset + take
                taken[at - take : at] += 1
                served[w, i] += take
    assert (taken == 1).all()
    share = np.array(sizes) * 2048 / total
    own = share >= 1
    assert (abs(served[:-1, own] - share[own]) < 2).all()
    # a source below one token a window is spread over the corpus too
    small = np.flatnonzero(~own & (np.array(sizes) > 15))
    assert all(np.flatnonzero(served[:, i])[-1] - np.flatnonzero(served[:, i])[0] > 0.7 * len(served) for i in small)


def test_packing_mixes_a_hundred_sources(spark):
    rows = [(i, words(i % 50, 60), "en", f"s{i % 100}") for i in range(1000)]
    got = packing.pack(docs(spark, rows)).toPandas()
    full = got[got["sequence_id"] < got["sequence_id"].max()].groupby("sequence_id")["source"].nunique()
    assert len(full) and (full == 100).all()


def test_given_proportions_fill_every_window():
    sizes, shares = [40_000, 9_000, 30_000, 500, 0, 3_000], [0.5, 0.125, 0.25, 0.125, 1.0, 0.0]
    plan, total = packing.Mixture(sizes, 2048, shares), sum(sizes)
    served, taken = np.zeros((-(-total // 2048), len(sizes)), dtype=np.int64), np.zeros(total, dtype=np.int64)
    for i, n in enumerate(sizes):
        at = 0
        for start, length in ((0, n // 3), (n // 3, n - n // 3)):
            for w, offset, take in plan.pieces(i, start, length):
                assert offset + take <= 2048 and w * 2048 + offset >= at
                at = w * 2048 + offset + take
                taken[at - take : at] += 1
                served[w, i] += take
    assert (taken == 1).all() and list(served.sum(axis=0)) == sizes
    assert (abs(served[0] - [1024, 256, 512, 256, 0, 0]) <= 2).all()
    # without the fourth the others keep their proportions to one another; the one without a weight comes last
    assert (abs(served[4, :3] / 2048 - np.array([4, 1, 2]) / 7) < 0.01).all() and served[-2, 5] == 2048


def test_packing_takes_proportions(spark):
    rows = [(i, words(i, 90), "en", "ab"[i % 2]) for i in range(300)]
    got = packing.pack(docs(spark, rows), proportions={"a": 3, "b": 1}).toPandas()
    first = got[got["sequence_id"] == 0].groupby("source")["length"].sum()
    assert first["a"] == 1536 and first["b"] == 512
    assert got.groupby("doc_id")["length"].sum().eq(got.groupby("doc_id")["doc_tokens"].first()).all()


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, words(i % 40, 60), "en", f"s{i % 3}") for i in range(80)] + [(90, None), (91, "12")]
    docs(spark, rows).drop("label").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out["doc_id"].isin(range(40, 80)).all() and len(out)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    clash = docs(spark, [(i, words(i, 60)) for i in range(12)]).withColumnRenamed("label", "__own0").withColumn("digest", F.lit("d")).withColumn("row", F.lit(1)).withColumn("hash", F.lit("h"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, "").columns == clash.columns
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixture_of_ties_and_repeats(spark):
    rows = [(i % 3, "w w w", "en", "a") for i in range(60)] + [(i, "x " * 3, "en", "b") for i in range(60)] + [(7, "", "en", "c"), (8, None, "en", "c")]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and got[got["source"] == "c"]["target"].eq(0).all()
    same = got[got["source"] == "a"].groupby("doc_id")["times"].nunique()
    assert (same == 1).all()  # rows that repeat id and text are taken together
    b = got[got["source"] == "b"]
    assert abs((b["size"] * b["times"]).sum() - b["target"].iloc[0]) <= 3


def test_repeated_ids_of_other_texts(spark):
    rows = [(1, words(1, 80)), (1, words(2, 80)), (1, words(1, 80)), (2, f"{words(2, 80)} end")]
    got = substring.dedup_substrings(docs(spark, rows)).toPandas().sort_values(["doc_id", "n_removed"])
    assert list(got["n_removed"]) == [0, 0, 0, 80]
    packed = packing.pack(docs(spark, rows)).toPandas()
    assert packed["length"].sum() == packed[packed["start"] == 0]["doc_tokens"].sum()


def test_warc_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "u", "a", "p", "d", 3), (2, "u", "a", "p", "d", 4)], "page_id long, url string, html string, payload string, digest string, refers_to int")
    path = new_path(spark, "clash")
    warc.write_warc(pages, path)
    assert {r["page_id"]: r["refers_to"] for r in warc.read_warc(spark, path).collect()} == {1: None, 2: 1}
