"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from figquarry.llm import decontamination, divergence, neighbours, packing, quality_classifier, resampling, token_count

EXTRA = "term string, g string, h string, n long, score double, rank int, id long, x string, features string, gains string"
NONE = (None,) * 10


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11 --------------------------------------------------------------------------------------------------------


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), "hot" if rng.random() < 0.4 else rng.choice(["s1", "S2", "ßource", "", None, "s10"])
        rows.append((k, rng.choice([" ", ", ", "1", "\n"]).join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 30))).replace("a", rng.choice("aA")), lang, source))
    rows += [(900, None, "xx", "only"), (901, "", "yy", "a"), (902, "lonely words here", "yy", "b"), (903, "É é É é Éa", "zz", "a"), (904, "É ÉA", "zz", "b"), (905, "É éa", "zz", "c"), (5, "twice", "en", "s1"), (5, "twice", "en", "s1"), (None, "twice \x00twice", "en", "s1")]
    return rows


def audit_by_hand(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = term.findall(lower(text))
        groups.add((lang, source))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [s for l, s in groups if l == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in mine}
        p = lambda n, whole: 1 + math.floor(Fraction(10**9 * (n + 1), whole + len(kept)))
        f = lambda p, q: math.floor(Fraction((p - q) * (p - q), q))
        pairs = [(s, sum(f(p(counts[lang, source][t], total[source]), p(counts[lang, s][t], total[s])) for t in kept)) for s in mine if s != source]
        whole = {t: sum(counts[lang, s][t] for s in mine) for t in kept}
        terms = []
        for t in kept:
            a, b = p(counts[lang, source][t], total[source]), p(whole[t], sum(whole.values()))
            if counts[lang, source][t] > 0 and a > b:
                terms.append((t, f(a, b)))
        for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:top])):
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())))]
    return sorted(out)


@pytest.mark.parametrize("least, top, block", [(3, 200, 1 << 20), (1, 4, 7), (1000, 5, 1 << 20)])
def test_audit(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = corpus(least)
    df = spark.createDataFrame([r + NONE for r in rows], f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3)
    got = sorted(map(tuple, divergence.audit(df, least, top).collect()))
    assert got == audit_by_hand(rows, least, top)
    assert least > 1 or len({r[5] for r in got if r[2] == "term"}) == top


def test_tally_holds_only_shared_cells():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    counts = [[{"source": f"s{k:02d}", "n": int(rng.integers(1, 4))} for k in sorted(rng.choice(30, rng.integers(1, 12), replace=False))] for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"lang": ["a" if i % 3 else "b" for i in range(200)], "counts": counts})
    got = Counter()
    for out in divergence._tally_batches(iter([batch])):
        for r in out.to_pylist():
            got[r["lang"], r["g"], r["h"], r["a"], r["b"]] += r["m"]
    want = Counter(("a" if i % 3 else "b", x["source"], y["source"], x["n"], y["n"]) for i, c in enumerate(counts) for x in c for y in c if x["source"] < y["source"])
    assert got == want


# --- 12 --------------------------------------------------------------------------------------------------------


def draw_by_hand(rows, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def feature_buckets(text):
        w = word.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    docs, aims = [feature_buckets(t) for _, t in rows], [feature_buckets(t) for t in target]
    s, t = (Counter(b for _, f in some for b in f) for some in (docs, aims))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * float(s.total() + buckets)) / ((s[b] + 1) * float(t.total() + buckets))))
    out = []
    for (i, _), (n, f) in zip(rows, docs):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abCé7", k=rng.randint(1, 4))) for _ in range(50)]
    return [rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most, buckets, least", [(1, 10_000, 20), (3, 97, 10), (2, 1000, 0)])
def test_resampling(spark, most, buckets, least):
    rows = list(enumerate(texts(most, 150))) + [(300, None), (301, ""), (302, "a " * 5000), (None, "b " * 40), (303, "x"), (3, "b " * 40), (3, "b " * 40)]
    target = texts(9, 12) + [None, ""]
    df = spark.createDataFrame([(i, t, None, "s") + NONE for i, t in rows], f"doc_id long, text string, lang string, source string, {EXTRA}").repartition(3)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = Counter(map(tuple, resampling.resample(df, aim, most, buckets, least).collect()))
    assert got == draw_by_hand(rows, target, most, buckets, least)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 5):
        ids = rng.integers(0, 4, 200)
        order = resampling.suffix_array(ids, depth)
        heads = [tuple(ids[i : i + depth]) for i in order]
        assert sorted(order) == list(range(200)) and heads == sorted(heads)
        shared = resampling.common_prefixes(ids, order, depth)
        assert list(shared[1:]) == [next((k for k in range(depth) if k >= min(len(a), len(b)) or a[k] != b[k]), depth) for a, b in zip(heads, heads[1:])]


def test_an_ngram_is_hashed_once_a_run(monkeypatch):
    asked, plain = [], zlib.crc32
    monkeypatch.setattr(resampling.zlib, "crc32", lambda b: asked.append(b) or plain(b))
    sizes, lists = resampling.bucket_lists([b"a b a b a", b"", b"b A b", b"c"], 2, 1 << 32)
    assert sorted(asked) == [b"a", b"a b", b"b", b"b a", b"c"] and list(sizes) == [5, 0, 3, 1]
    assert [list(x) for x in lists] == [[plain(w) for w in ws] for ws in ([b"a", b"b", b"a", b"b", b"a", b"a b", b"b a", b"a b", b"b a"], [], [b"b", b"a", b"b", b"b a", b"a b"], [b"c"])]


# --- 13 --------------------------------------------------------------------------------------------------------


def nearest_by_hand(rows, every=20, top=20):
    lengths = Counter(len(x) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x))
    least = {}
    if lengths:
        d = max(lengths, key=lambda n: (lengths[n], n))
        for i, x in rows:
            if i is not None and x is not None and len(x) == d and None not in x and np.isfinite(x).all() and any(x):
                least[i] = min(least.get(i, tuple(x)), tuple(x))
    ids = sorted(least)
    out = {}
    for q in ids:
        if q % every == 0:
            score = lambda v: sum(a * b for a, b in zip(least[q], least[v]))
            out[q] = sorted(((-score(v), v) for v in ids if v != q))[:top]
    return out


def embedded(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 1) + NONE for i, x in rows], f"vec_id long, embedding array<{kind}>, label int, {EXTRA}").repartition(3)


def found(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def test_neighbours_on_odd_vectors(spark):
    rng = np.random.default_rng(1)
    whole = lambda n: [float(x) for x in rng.integers(-3, 4, n)]
    rows = [(k, whole(6)) for k in range(300)] + [(400 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for k in range(120)]  # ties and a large group of equal vectors
    rows += [(700, None), (720, []), (740, [0.0] * 6), (760, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (780, [float("nan")] + [1.0] * 5), (800, [float("inf")] + [1.0] * 5), (820, [1.0] * 5), (None, [1.0] * 6), (840, [-0.0, 0.0, 0.0, 0.0, 0.0, 5.0]), (841, [0.0, 0.0, 0.0, 0.0, 0.0, 5.0]), (860, [30.0] * 6), (20, [9.0] * 6), (40, rows[40][1])]
    got, want = found(neighbours.search(embedded(spark, rows), F.col("vec_id") % 20 == 0, success=1 - 1e-9, sample=50, block=16)), nearest_by_hand(rows)
    assert {q: [(-s, v) for v, s in x] for q, x in got.items()} == want
    few = [(k, whole(4)) for k in range(0, 60, 7)] + [(0, [1.0, 0.0, 0.0, 0.0])]
    assert {q: len(x) for q, x in found(neighbours.search(embedded(spark, few), F.col("vec_id") % 20 == 0)).items()} == {q: len(x) for q, x in nearest_by_hand(few).items()}
    assert neighbours.search(embedded(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(embedded(spark, [(0, [1.0, 2.0])], "float"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shape", ["even", "clusters", "norms"])
def test_recall_and_scores(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    if shape == "clusters":
        x = rng.normal(size=(12, 24))[np.where(rng.random(3000) < 0.35, 0, rng.integers(0, 12, 3000))] + 0.15 * x
    if shape == "norms":
        x *= np.exp(rng.normal(size=(3000, 1)) * 0.5)
    x = x.astype(np.float32)
    got = found(neighbours.search(embedded(spark, [(k, [float(v) for v in row]) for k, row in enumerate(x)], "float"), F.col("vec_id") % 20 == 0))
    exact, hits = x.astype(float) @ x.astype(float).T, []
    for q in range(0, 3000, 20):
        others = [(-exact[q, v], v) for v in range(3000) if v != q]
        best = {v for _, v in sorted(others)[:20]}
        hits.append(len(best & {v for v, _ in got[q]}))
        scores = [s for _, s in got[q]]
        assert len(scores) == 20 and scores == sorted(scores, reverse=True)
        assert all(s == pytest.approx(exact[q, v], rel=1e-12, abs=1e-12) for v, s in got[q])
    assert np.mean(hits) / 20 >= 0.9


def test_visits_follow_probability():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8))
    h = neighbours.Hashing(x, x[:100], 100_000, float(np.sqrt((x * x).sum(axis=1)).max()), 3, 0.9)
    q, t, bucket = h.visits(x[:20])
    assert set(q) == set(range(20)) and set(t) == {0, 1, 2} and len(set(zip(q, t, bucket))) == len(q)
    steps, slices = np.tile(np.arange(3.0), (2, 4, 1)), rng.random((2, 4, 3))
    chosen, share = neighbours.best_products(steps, slices, 10)
    for r in range(2):
        every = sorted((float(np.prod([slices[r, i, c] for i, c in enumerate(p)])) for p in np.ndindex(3, 3, 3, 3)), reverse=True)
        assert share[r] == pytest.approx(every[:10])
        assert [float(np.prod([slices[r, i, int(c)] for i, c in enumerate(p)])) for p in chosen[r]] == pytest.approx(every[:10])
    z = np.linspace(-5, 5, 41)
    assert neighbours.normal(z) == pytest.approx([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z], abs=2e-7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], f"doc_id long, text string, lang string, source string, {EXTRA}")
    assert divergence.audit(none).count() == 0
    assert resampling.resample(none, spark.createDataFrame([], "text string")).count() == 0
    one = resampling.resample(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), spark.createDataFrame([], "text string")).collect()
    assert len(one) == 1 and one[0]["rank"] is None and one[0].n_features == 30


# --- bounds of earlier operators -------------------------------------------------------------------------------


def test_token_counts_of_an_endless_word():
    import tracemalloc

    vocabulary = [("<unk>", 0.0), ("▁", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -1.5), ("ba", -2.0), ("bab", -3.0), ("abab", -4.0)]
    counter, rng = token_count.WordCounter(vocabulary), random.Random(1)
    word = "".join(rng.choices("abx", k=400_000))
    assert sum(counter.search(w) for w in ("ab", "x", "xxab")) == 1 + 1 + 2
    tracemalloc.start()
    n = counter.search(word)
    assert 100_000 < n < 400_000 and tracemalloc.get_traced_memory()[1] < 5 * len(word) + (1 << 20)  # the word as the automaton reads it
    tracemalloc.stop()
    assert counter.search(word * 12) > 11 * n  # some five million characters


def test_what_reaches_the_driver_is_bounded_by_documents(spark, monkeypatch):
    seen, train = [], quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", lambda x, y: seen.append(len(y)) or train(x, y))
    docs = spark.range(30_000).selectExpr("id % 4 AS doc_id", "concat('some text ', id % 3) AS text")
    labels = spark.range(4000).selectExpr("id % 4 AS doc_id", "CAST(id % 2 AS INT) AS quality")
    quality_classifier.fit(docs, labels, folds=1, held_fold=5)
    quality_classifier.fit(docs, labels, folds=1, held_fold=5, sample=2)
    assert seen == [4, 2]


def test_leaks_and_packing_of_empty_tables(spark):
    import public_tokenizers

    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a few words of a text that is here")], "doc_id long, text string")
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.without_leaks(some, bench).count() == 1
    assert packing.packed(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_documents_that_share_a_template_are_not_compared_all_with_all(spark, monkeypatch):
    from figquarry.llm import simhash

    rng = random.Random(4)
    template, rows = [f"t{i}" for i in range(120)], []
    for k in range(400):  # half of each document is the template: alike to 0.3 to 0.5
        rows.append((k, " ".join(template + [f"w{k}x{i}" for i in range(rng.randint(110, 150))])))
    for k in range(0, 400, 10):  # near copies among them
        words = rows[k][1].split()
        words[200] = "changed"
        rows.append((1000 + k, " ".join(words)))
    seen, rare = [], simhash._rare_pairs
    monkeypatch.setattr(simhash, "_rare_pairs", lambda *a: seen.append(rare(*a)) or seen[-1])
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string"), block_limit=32).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert seen and seen[0].count() <= 200  # of some 97,000 pairs
