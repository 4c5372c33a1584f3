"""Operators 7 and 9 against plain Python."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadre.llm import minhash, mixing


def shares(text):
    w = (text or "").encode().split()
    if not w:
        return Counter()
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def groups_of(corpus):
    items = [(i, t or "", shares(t)) for i, t, *_ in corpus]
    root = {i: i for i, *_ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, t, s) in enumerate(items):
        for j, u, v in items[:k]:
            if t == u or (s and v and jaccard(s, v) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_groups_equal_all_pairs(docs, corpus):
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_rows(docs).collect()}
    want = groups_of(corpus)
    assert got == {i: (c, c == i) for i, c in want.items()}
    assert max(Counter(want.values()).values()) >= 8


def test_drop_near_copies_keeps_columns(docs, corpus):
    out = minhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, c in groups_of(corpus).items() if c == i}


def near_classes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in minhash.near_rows(df).collect()}


def test_drifting_copies_stay_together(spark):
    """Versions that are near the next few only: most are not near their bucket's leader."""
    r, texts = random.Random(4), []
    for k in range(6):
        words = ["g%dw%d" % (k, i) for i in range(150)]
        for v in range(25):
            texts.append(" ".join(words))
            words[r.randrange(150)] = "g%dv%d" % (k, v)
    got = near_classes(spark, texts)
    assert got == groups_of(list(enumerate(texts))) and len(set(got.values())) == 6


def test_pairs_in_a_hot_bucket_are_found(spark):
    """Pairs barely similar enough among many texts that share most of their words."""
    r, texts = random.Random(6), []
    passage = ["p%d" % i for i in range(120)]
    for k in range(150):
        own = ["o%d-%d" % (k, i) for i in range(40)]
        texts.append(" ".join(passage + own))
        texts.append(" ".join(passage + own[:26] + ["c%d-%d" % (k, i) for i in range(r.randrange(10, 14))]))
    want = groups_of(list(enumerate(texts)))
    assert 100 < len(set(want.values())) < 250
    assert near_classes(spark, texts) == want


def test_one_shared_bucket_is_enough(spark):
    """All texts in one bucket led by text 0: a chain 0 ~ 1 ~ 2, and 40 pairs."""
    def changed(words, at, tag):
        return [tag + w if k in at else w for k, w in enumerate(words)]

    base = ["w%d" % i for i in range(160)]
    x = changed(base, (20, 60, 100), "x")
    texts = [base, x, changed(x, (40, 80, 120), "y")]
    want = {(0, 1), (1, 2)}
    for k in range(40):
        own = ["o%d-%d" % (k, i) for i in range(160)]
        want.add((len(texts), len(texts) + 1))
        texts += [own, changed(own, (30, 70, 110), "z")]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    signed = minhash.signatures(docs).select("id", "sig", F.array(F.lit(7).cast("long")).alias("bands"))
    assert {tuple(sorted(r)) for r in minhash.links(docs, signed).select("id", "lead").collect()} == want


def test_signature_agreement_estimates_weighted_similarity():
    r = random.Random(2)
    words = ["w%d" % r.randrange(300) for _ in range(400)] + ["a b c d e"] * 30
    off, n = [], 0
    for cut in (40, 120, 250):
        other = words[:]
        for i in range(cut):
            other[r.randrange(len(other))] = "v%d" % i
        a, b = " ".join(words), " ".join(other)
        est = np.mean([(minhash.signature(minhash.cells(a + " s%d" % k * 0), 960) == minhash.signature(minhash.cells(b), 960)).mean() for k in range(1)])
        off.append(abs(est - jaccard(shares(a), shares(b))))
    assert max(off) < 0.06


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_signature_fills_every_coordinate(n):
    cell = minhash._mix(np.arange(n, dtype=np.uint64))
    sig = minhash.signature(cell)
    assert sig.shape == (minhash.COORDS,) and len(set(sig.tolist())) > minhash.COORDS * 0.6 or n == 1


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(1, 50)] + [(205, 203), (203, 201), (205, 200)]
    got = {r["id"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "id long, lead long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 50))
    assert got[205] == got[203] == got[201] == 200


def test_targets_stop_at_three_times_and_share_the_rest():
    t = mixing.targets({"a": 10, "b": 1000, "c": 500, "z": 0}, {"a": 3, "b": 1, "c": 2, "z": 3})
    assert t["a"] == 30 and t["z"] == 0 and sum(t.values()) == pytest.approx(1510)
    assert t["c"] == pytest.approx(2 * t["b"])


def test_mix_comes_near_its_targets(docs, corpus):
    out, sources, size, copies = mixing.mix(docs)
    rows = out.collect()
    plan = {r["source"]: r for r in sources.collect()}
    n = {i: len((t or "").encode().split()) for i, t, *_ in corpus}
    src = {i: s for i, _, _, s in corpus}
    taken, sizes, least = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r[size] == n[r["doc_id"]] and 0 <= r[copies] <= 3
        taken[src[r["doc_id"]]] += r[size] * r[copies]
        sizes[src[r["doc_id"]]] += r[size]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets({mixing.NULL if s is None else s: k for s, k in sizes.items()},
                          {mixing.NULL if s is None else s: i % 3 + 1 for i, s in enumerate(order)})
    for s in order:
        t = want[mixing.NULL if s is None else s]
        assert plan[s]["target"] == pytest.approx(t) and plan[s]["source_size"] == sizes[s]
        assert abs(taken[s] - t) <= max(5, 0.01 * t)
    again = mixing.mix(docs.repartition(7))[0].collect()
    assert {r["doc_id"]: r[copies] for r in rows} == {r["doc_id"]: r[copies] for r in again}


def test_flow_uses_fresh_words_before_repeats():
    # both can feed s1; only p2 can feed s2
    sizes = {("s1",): 100, ("s1", "s2"): 100}
    flow = mixing.route(sizes, {"s1": 100, "s2": 100})
    assert flow[("s1",)]["s1"] == 100 and flow[("s1", "s2")] == {"s1": 0, "s2": 100}
    flow = mixing.route(sizes, {"s1": 250, "s2": 50})
    assert sum(flow[("s1",)].values()) + sum(flow[("s1", "s2")].values()) == 300
    cost = lambda n, size: sum(max(0, n - k * size) for k in (1, 2))  # noqa: E731  second uses cost 1, third 2
    best = min(cost(a, 100) + cost(300 - a, 100) for a in range(0, 301) if 300 - a >= 50)
    assert sum(cost(sum(flow[p].values()), 100) for p in sizes) == best


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, m) for i, m in enumerate([["a"]] * 40 + [["a", "b"]] * 40 + [["b"]] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    out, sources, size, copies = mixing.mix(df, members=F.col("m"))
    total = sum(r[size] * r[copies] for r in out.collect())
    assert abs(total - 900) <= 20 and {r["source"] for r in sources.collect()} == {"a", "b"}


def test_mixed_rows_repeat(docs):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    want, _, _, copies = mixing.mix(docs)
    assert out.count() == want.agg(F.sum(copies)).first()[0]


def test_signatures_are_not_shuffled_to_drop_equal_rows(docs, monkeypatch):
    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, name)
    written = minhash.written
    monkeypatch.setattr(minhash, "written", spy)
    minhash.near_groups(docs.union(docs)).count()
    assert "Aggregate" not in plans["minhash-firsts"]


def test_signatures_stay_in_place_until_texts_are_compared(docs, monkeypatch):
    columns = {}

    def spy(df, name):
        columns[name] = df.columns
        return written(df, name)
    written = minhash.written
    monkeypatch.setattr(minhash, "written", spy)
    got = {(r["id"], r["class_id"]) for r in minhash.near_groups(docs.union(docs)).collect()}
    assert "sig" not in columns["minhash-firsts"] and columns["minhash-sigs"] == ["id", "sig"]
    assert got == {(r["id"], r["class_id"]) for r in minhash.near_groups(docs).collect()}
