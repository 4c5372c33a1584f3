"""Operator 5 against plain Python."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cadre.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.fixture(scope="module")
def scored(docs):
    return {r["doc_id"]: r for r in lm.score_documents(docs).collect()}


@pytest.mark.parametrize("lexicon", [1 << 16, 40])
def test_base_score(docs, corpus, lexicon, monkeypatch):
    monkeypatch.setattr(lm, "LEXICON", lexicon)
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in corpus}
    c = Counter(w for i, t, *_ in corpus if not out[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, *_ in corpus:
        ws = tokens(t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_probing_by_join_gives_the_same_scores(docs, scored):
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, broadcast_bytes=0).collect()}
    assert got == {i: pytest.approx(r["score"], rel=1e-9) for i, r in scored.items()}


def test_probing_by_join_writes_little(spark):
    """What is kept for the join, besides the filter, is less than the texts."""
    import os
    from cadre.session import ensure_checkpoint_dir
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"word{w}" for w in rng.zipf(1.2, 500) % 30_000)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    old = set(os.listdir(top))
    assert lm.score_documents(docs, broadcast_bytes=0).where("score < 0").count() == 600
    size = sum(os.path.getsize(os.path.join(at, f)) for d in set(os.listdir(top)) - old if d.startswith("lm-")
               for at, _, names in os.walk(os.path.join(top, d)) for f in names if not f.startswith("."))
    held = sum(os.path.getsize(os.path.join(at, f)) for d in set(os.listdir(top)) - old if d.startswith("lm-filter")
               for at, _, names in os.walk(os.path.join(top, d)) for f in names)
    assert size - held < 0.7 * sum(len(t) for _, t in rows)


def test_bigrams_help(corpus, scored):
    """Copies of trained texts are far likelier under the model than word by word."""
    assert sum(r["score"] for r in scored.values()) > sum(r["base_score"] for r in scored.values())


def test_filter_never_undercounts_and_rarely_overcounts(spark):
    n = [(int(k), 1 + k % 90) for k in range(3000)]
    f, segments = lm.build_filter(spark.createDataFrame(n, "key long, n long"))
    data = np.zeros((segments, lm.SEGMENT_BITS // 8), np.uint8)
    for r in f.collect():
        data[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    q = lm.probe(np.arange(6000), segments, lambda s, at: data[s, at])
    want = lm.quantised(np.array([c for _, c in n]))
    assert (q[:3000] >= want).all() and (q[:3000] > want).mean() < 0.02 and (q[3000:] > 0).mean() < 0.02
    for c in range(1, 200):
        e = lm.expected(lm.quantised(np.array([c])))[0]
        same = [x for x in range(1, 400) if lm.quantised(np.array([x]))[0] == lm.quantised(np.array([c]))[0]]
        assert e == pytest.approx(np.mean(same))


def test_probabilities_sum_to_about_one(docs):
    from pyspark.sql import functions as F
    m = lm.Model(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    codes = np.array([c for c in range(len(m.counts)) if c != lm.BEGIN])
    assert m.alone[codes].sum() == pytest.approx(1, abs=0.12)
    for prev in (lm.BEGIN, lm.FIRST, lm.FIRST + 3):
        seen = lm.expected(lm.probe((prev << 20) | codes, m.segments, lambda s, at: m.data[s, at]))
        p = m.weight[prev] * np.minimum(1, seen / max(1, m.context[prev])) + (1 - m.weight[prev]) * m.alone[codes]
        assert 0.4 < p.sum() < 1.3


@pytest.mark.parametrize("lexicon,broadcast_bytes", [(1 << 16, lm.BROADCAST_BYTES), (5, lm.BROADCAST_BYTES), (5, 0)])
def test_words_outside_the_lexicon_keep_their_contexts(docs, corpus, lexicon, broadcast_bytes, monkeypatch):
    """Scores by counts of all words and bigrams, whatever the size of the lexicon."""
    monkeypatch.setattr(lm, "LEXICON", lexicon)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, broadcast_bytes=broadcast_bytes).collect()}
    kept = [tokens(t) for i, t, *_ in corpus if zlib.crc32(str(i).encode()) % 10]
    c, c2 = Counter(w for t in kept for w in t), Counter(p for t in kept for p in zip(["begin", *t], t))
    mass = sum(c.values()) + 0.1 * (len(c) + 1)
    mean = lambda n: float(lm.expected(lm.quantised(np.array([n])))[0]) if n else 0.0
    off = []
    for i, t, *_ in corpus:
        want = 0.0
        for h, w in zip(["begin", *tokens(t)], tokens(t)):
            ch = mean(len(kept) if h == "begin" else c[h])
            part = 0.8 * ch / (ch + 10)
            want += math.log10(part * min(1, mean(c2[h, w]) / max(1, ch)) + (1 - part) * (mean(c[w]) + 0.1) / mass)
        off.append(abs(got[i] / want - 1))
    # the filter may overcount a few n-grams
    assert np.median(off) < 1e-3 and max(off) < 0.1
