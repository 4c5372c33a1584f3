"""Operators 11, 12 and 13 against plain Python."""
import bisect
import functools
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadre.llm import centroids, importance, packing
from cadre.llm.queries import tokenizer_path

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BPE = "byte_bpe_50k.json"


# -- importance ----------------------------------------------------------------

def runs(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_scores(rows, target, n, buckets, percent, min_words, seed):
    of = lambda t: [zlib.crc32(x.encode()) % buckets for x in runs(t, n)[1]]
    held = [(i, runs(t, n)[0], of(t)) for i, t in rows]
    s, t = Counter(b for _, _, x in held for b in x), Counter(b for x in target for b in of(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, words, x in held:
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), words >= min_words))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0]))[:percent * sum(x[4] for x in out) // 100]
    rank = {x[0]: k + 1 for k, x in enumerate(able)}
    return {x[0]: (*x[1:4], rank.get(x[0])) for x in out}


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (3, 70_000, 50), (2, 7, 100)])
def test_importance(spark, docs, corpus, n, buckets, percent):
    target = [corpus[3][1], corpus[5][1], None, "Thrée ßtrom 中文字 the"]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(docs, t, n=n, buckets=buckets, percent=percent, seed="7")
    want = plain_scores([(x[0], x[1]) for x in corpus], [x or "" for x in target], n, buckets, percent, 20, "7")
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    kept = importance.drawn(docs, got)
    assert kept.columns == docs.columns and kept.count() == sum(x[3] is not None for x in want.values())


def test_importance_of_odd_and_empty_tables(spark, odd_rows, empty):
    t = spark.createDataFrame([("one two three",)], "text string")
    got = importance.resample(odd_rows, t, min_words=1, percent=100).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert {(r["n_features"], r["rank"] is None) for r in got if r["n_features"] == 0} == {(0, True)}
    assert importance.resample(empty, t).count() == 0
    assert importance.resample(odd_rows, t.where("false")).count() == 6
    assert importance.resample(odd_rows, t).where("rank IS NOT NULL").count() == 0  # floor of a tenth


def test_dictionary_only_saves_work():
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "é", "中文", "q%d" % r.randrange(3000)]) for _ in range(r.randrange(60))) for _ in range(300)]
    small, none = importance.Dictionary(limit=700, first=10), importance.Dictionary(limit=0)
    for _ in range(3):
        for a, b in zip(small.payloads(texts), none.payloads(texts)):
            assert (a == b).all()
    assert small.size == 700 and none.size == 0
    crc, length, _ = none.payloads([texts[0]])
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in texts[0].split()] and length.tolist() == [len(w.encode()) for w in texts[0].split()]


def test_advanced_crcs():
    for a, b in [(b"", b"x"), (b"ab", b""), (b"ab", b"cdefghijk" * 999)]:
        got = importance.advance(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)


def test_ties_draw_by_id_over_many_partitions(spark):
    rows = spark.range(3000).selectExpr("id", "(id % 3) * 5 AS score", "id % 2 = 0 AS able").repartition(17)
    got = importance.ranked(rows, "able", lambda n: n // 2)
    rank = {r["id"]: r["rank"] for r in got.collect()}
    order = sorted((i for i in range(0, 3000, 2)), key=lambda i: (-(i % 3), i))
    assert rank == {**dict.fromkeys(range(3000)), **{i: k + 1 for k, i in enumerate(order[:750])}}


# -- packing -------------------------------------------------------------------

def plain_best_fit(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity and at >= len(rooms)
        bisect.insort(rooms, room - x)
    return rooms


def test_plan_is_document_by_document_best_fit():
    r = random.Random(2)
    for _ in range(200):
        capacity = r.choice([1, 8, 33, 100, 1024])
        lengths = [min(capacity, 1 + int(r.expovariate(r.choice([2, 8, 30]) / capacity))) for _ in range(r.randrange(1, 300))]
        plan, n = packing.best_fit_decreasing(Counter(lengths), capacity)
        number = np.arange(len(lengths))
        p = plan[np.searchsorted(plan[:, 0], number, side="right") - 1]
        nth = number - p[:, 0]
        held = defaultdict(list)
        for s, o, x in zip(p[:, 2] + nth // p[:, 1], p[:, 3] + nth % p[:, 1] * p[:, 4], sorted(lengths, reverse=True)):
            held[int(s)].append((int(o), x))
        rooms = plain_best_fit(lengths, capacity)
        assert sorted(held) == list(range(n)) and n == len(rooms)
        assert sorted(capacity - sum(x for _, x in h) for h in held.values()) == rooms
        for h in held.values():
            ends = [o + x for o, x in sorted(h)]
            assert [o for o, _ in sorted(h)] == [0, *ends[:-1]] and ends[-1] <= capacity


def test_plan_of_many_documents_is_short():
    counts = {x: 10 ** 9 // x for x in range(1, 1025)}
    plan, n = packing.best_fit_decreasing(counts, 1024)
    assert len(plan) < 50_000 and n <= 1.001 * sum(x * c for x, c in counts.items()) / 1024


@functools.cache
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path(BPE))


def library_ids(text):
    return library().encode(text, add_special_tokens=False).ids


def test_encoder_agrees_with_the_library(corpus):
    enc = packing.encoder(tokenizer_path(BPE))
    odd = ["aᲊb \U0001f9ff\U00031350͸ x", "ok \U0001f600's 12²١", "​ 　  x  y", "don't  \r\n\n x <|endoftext|>y"]
    for t in [x[1] or "" for x in corpus[:60]] + odd:
        assert enc.ids(t).tolist() == library_ids(t)
    assert enc.unsettled.search("\U0001f9ff") and not enc.unsettled.search("éß中ü ")


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(docs, corpus, capacity):
    out = packing.pack(docs, tokenizer_path(BPE), capacity=capacity, keep_ids=True)
    rows = out.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    lengths = []
    for i, t, *_ in corpus:
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = library_ids(t or "") + [2]
        assert [x for r in parts for x in r["ids"]] == ids
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        assert all(r["length"] == capacity for r in parts[1:]) and len(parts) == -(-len(ids) // capacity)
        lengths += [r["length"] for r in parts]
    assert len(by_seq) == len(plain_best_fit(lengths, capacity))
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(out).collect()}
    for s, parts in by_seq.items():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        assert sum(r["length"] for r in parts) <= capacity and made[s] == [x for r in parts for x in r["ids"]]


def test_packing_of_odd_and_empty_tables(odd_rows, empty):
    rows = packing.pack(odd_rows, tokenizer_path(BPE), capacity=8).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == {None: 2, 1: 3, 2: 1}
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert packing.pack(empty, tokenizer_path(BPE)).count() == 0


# -- centroids -----------------------------------------------------------------

def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (hashlib.sha256(f"{seed}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        for j, vs in held.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept), cents


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(4)
    spots = [[r.gauss(0, 2) for _ in range(6)] for _ in range(7)]
    rows = [(i, [c + r.gauss(0, 0.3) * (k + 1) for k, c in enumerate(r.choice(spots))]) for i in range(400)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(500, 620)]
    rows += [(700, None), (701, []), (702, [1.0] * 5), (703, [None] + [1.0] * 5), (704, [float("nan")] + [1.0] * 5),
             (705, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (3, [0.25] * 6), (3, [0.25] * 6), (706, [-0.0001] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    return rows, df.withColumn("id", F.lit("x")).withColumn("cluster", F.lit("x")).withColumn("h", F.lit("x"))


@pytest.mark.parametrize("k,lead", [(8, 2), (40, 3), (3, 6)])
def test_clusters(vectors, k, lead):
    rows, df = vectors
    out, cents = centroids.cluster(df, k=k, rounds=4, dims=6, lead=lead)
    want, want_cents = plain_clusters(rows, k, 4, 6, 256, "2")
    got = out.select("vec_id", "cluster", "distance").collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in got) == want
    assert cents.tolist() == want_cents
    full = centroids.with_inertia(out, cents).collect()
    per = Counter()
    for _, c, d in want:
        per[c] += d
    for r in full:
        assert r["cluster_inertia"] == per[r["cluster"]] and r["inertia"] == sum(per.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_cents[r["cluster"]])).encode()).hexdigest()


def test_filter_leaves_out_most_distances_and_no_result():
    r = np.random.default_rng(1)
    spots = r.normal(0, 900, (40, 64)).astype(np.int64)
    v = spots[r.integers(0, 40, 3000)] + r.normal(0, 60, (3000, 64)).astype(np.int64)
    v[:50] = spots[:1]  # many on one centroid
    spots[7] = spots[3]  # a tie
    cov = np.cov(v.T)
    rotation = centroids.Rotation(v.mean(0), np.linalg.eigh(cov)[1][:, ::-1], 16)
    cluster, distance, made = centroids.nearest(v, rotation.coordinates(v.astype(float)), spots, rotation.coordinates(spots.astype(float)))
    every = ((v[:, None, :] - spots[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert made < every.size / 10


def test_few_no_and_too_large_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    out, cents = centroids.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), dims=2, lead=1)
    assert [(r["cluster"], r["distance"]) for r in out.collect()] == [(0, 0), (0, 0)] and len(cents) == 2
    out, cents = centroids.cluster(spark.createDataFrame([], schema), dims=2, lead=1)
    assert centroids.with_inertia(out, cents).count() == 0 and not len(cents)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e7, 2.0])], schema), dims=2, lead=1)
