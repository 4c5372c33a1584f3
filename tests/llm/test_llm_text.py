"""Operators 1, 3, 6, 8 and 10 against plain Python."""
import hashlib
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cadre.llm import bpe, line_dedup, quality, simhash, token_counts
from cadre.llm.queries import tokenizer_path

WS = " \t\n\x0b\f\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0d]+")


def lines_left(corpus, min_chars=40, min_docs=5):
    held = defaultdict(set)
    key = lambda line: line.strip(WS).translate(LOWER)
    for i, t, *_ in corpus:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = {}
    for i, t, *_ in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup(docs, corpus, batches, fanout):
    out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout, counts=True)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()}
    want = lines_left(corpus)
    assert got == want and sum(x[1] for x in want.values()) > 20
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]


def test_line_runs_stay_disjoint_and_few(spark, docs):
    thin = docs.select(F.col("doc_id").alias("id"), "text")
    from cadre.llm.common import scratch_path
    runs = line_dedup.LineRuns(spark, scratch_path(spark, "t"), fanout=2)
    for b in line_dedup.batches_by_id(thin, 4):
        runs.add_batch(b, 10)
    assert [level for level, _ in runs.runs] == [2]
    again = line_dedup.LineRuns(spark, runs.path, runs=runs.runs)
    own = again._read([f for _, f in again.runs]).where("own")
    assert own.count() == own.select("h1", "h2").distinct().count()
    want = Counter()
    for r in thin.collect():
        want.update({k for x in (r["text"] or "").split("\n") if len(k := x.strip(WS).translate(LOWER)) >= 10})
    assert sorted(r["n_docs"] for r in again.totals().collect()) == sorted(want.values())


def repeated(words, window=8):
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    hit = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i:i + window])] > 1:
            hit |= set(range(i, i + window))
    return len(hit)


def test_quality_measures(docs, corpus):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t, *_ in corpus:
        t = t or ""
        words = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        n_rep = repeated(words)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), n_rep)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * n_rep > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert not got[215]["kept"]  # mere symbols


def test_quality_keeps_columns_and_agrees_with_judge(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and want


def test_sketches_merge_to_the_same_quantiles(spark):
    rows = [("en", "s%d" % (i % 3), "x", i % 500, 1) for i in range(3000)]
    sk = spark.createDataFrame(rows, "lang string, source string, measure string, bucket int, n long")
    one = quality.quantiles(quality.merge(sk, "lang"), ["lang"], {"q": 0.25}).collect()[0]
    parts = quality.merge(sk, "lang", "source")
    two = quality.quantiles(quality.merge(parts, "lang"), ["lang"], {"q": 0.25}).collect()[0]
    assert one["q"] == two["q"] == pytest.approx(2 * 1.02 ** 124 / 2.02) and one["n"] == 3000


def test_fence_follows_its_group(spark):
    """The same share of symbols is common in one source and rejected in another."""
    plain = "word " * 0 + " ".join("w%d" % i for i in range(60))
    table = " ".join("w%d |" % i for i in range(60))
    rows = [(i, plain, "en", "prose") for i in range(300)] + [(1000 + i, table, "en", "tables") for i in range(300)]
    rows += [(2000, table, "en", "prose"), (2001, table, "en", "tables"), (2002, plain, "fr", "few")]
    from llm_schema import SCHEMA
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert not got[2000] and got[2001] and got[2002] and got[0] and got[1000]


def test_each_fence_rejects_an_outlier_of_a_tight_group(spark):
    from llm_schema import SCHEMA
    word = lambda i, k: "w%04d" % (97 * i + k)
    lines = lambda i, n: [" ".join(word(i, 4 * k + j) for j in range(4)) for k in range(n)]
    clean = ["\n".join(lines(i, 10)) for i in range(100)] * 3
    clean += [x.replace("w", "$", 1) for x in clean[:6]]  # one symbol
    five = lines(0, 5)
    outliers = {
        "symbol_share": " ".join(lines(0, 10)).replace("w", "$", 10),
        "dup_line_share": "\n".join(five[k] for k in (0, 1, 2, 3, 4, 0, 2, 4, 1, 3)),
        "repeat_share": " ".join([*lines(0, 10), *lines(1, 4), *lines(0, 2)]),
        "mean_word_chars": " ".join("long%03d" % k for k in range(40)),
        "lo_mean_word_chars": " ".join("%03d" % k for k in range(40)),
    }
    texts = [*clean, *outliers.values()]
    df = spark.createDataFrame([(i, t, "en", "tight", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(rows[i]["kept"] for i in range(len(clean)))
    f = quality.learn(df).collect()[0]
    for i, k in enumerate(outliers, len(clean)):
        r, k = rows[i], k.removeprefix("lo_")
        value = {"symbol_share": r["n_symbols"] / r["n_words"], "dup_line_share": r["n_dup_lines"] / r["n_full_lines"],
                 "repeat_share": r["n_repeat_words"] / r["n_words"], "mean_word_chars": r["word_chars"] / r["n_words"]}
        assert not r["base_failed"] and not r["kept"]
        assert [m for m, v in value.items() if not f[f"lo_{m}"] <= v <= f[f"hi_{m}"]] == [k]  # by this fence alone


def test_bpe_equals_the_library(docs, corpus):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    enc = bpe.encode(docs, path, lexicon_words=50)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.decode(enc, path).collect()}
    for i, t, *_ in corpus:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, lib.decode(ids, skip_special_tokens=False)), i


def test_lexicon_is_minimal_and_accepts_its_words_only():
    path = tokenizer_path("byte_bpe_50k.json")
    tok = bpe.tokenizer(path)
    words = [a + b for a in (b"", b"re", b"un", b"pre") for b in (b"do", b"doing", b"done", b"go", b"going")]
    lex = bpe.Lexicon(bpe.compile_lexicon(words, tok.merge_words(bpe.Words(words))))
    rank = lex.find(bpe.Words([*words, b"d", b"doin", b"redoo", b"", b"x"]))
    assert sorted(rank[:len(words)]) == list(range(len(words))) and (rank[len(words):] == -1).all()
    for w, r in zip(words, rank):
        assert lex.ids.gather(rank[:0]).size == 0 and lex.ids.gather(r[None]).tolist() == tok.merge_long(w)
    # states that accept the same endings are one state: the right languages of all prefixes
    ends = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(lex.final) == len(ends)


def test_token_counts_and_cache(spark, docs, corpus):
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    from cadre.llm.common import scratch_path
    root = scratch_path(spark, "cache")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in
           token_counts.count_tokens(docs, path, cache_root=root).collect()}
    for i, t, *_ in corpus:
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)
    cache = token_counts.TokenCountCache(spark, root, path)
    distinct = len({t or "" for _, t, *_ in corpus})
    assert cache.read().count() == distinct
    again = token_counts.count_tokens(docs, path, cache_root=root)
    assert again.count() == len(corpus) and cache.read().count() == distinct  # nothing was missing


def test_json_tokenizer_counts(docs, corpus):
    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in corpus}


def xx_fingerprint(spark, text):
    df = spark.createDataFrame([(0, text)], "id int, text string")
    words = WORD.findall(text)
    runs = [words[i:i + 5] for i in range(max(1, len(words) - 4))] if words else []
    hashes = [spark.range(1).select(F.xxhash64(*[F.lit(w) for w in x])).first()[0] for x in runs]
    fp = 0
    for b in range(64):
        if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes):
            fp |= 1 << b
    return simhash.fingerprints(df, ["id"]).first()["fp"] & (2 ** 64 - 1), fp


def test_fingerprint_votes(spark):
    for text in ("a b", "the quick brown fox jumps over the lazy dog of the", ""):
        got, want = xx_fingerprint(spark, text)
        assert got == want


def test_edits_and_neighbours(docs, corpus):
    rows = sorted((i, t or "") for i, t, *_ in corpus)
    got = {r["doc_id"]: r for r in simhash.compare_edits(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edit = t[:len(t) - half] + nxt[1][:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert got[i]["next_fp"] == got[nxt[0]]["fp"]
    same = defaultdict(set)
    for i, t in rows:
        same[t].add(got[i]["fp"])
    assert all(len(x) == 1 for x in same.values())


def test_many_id_ranges_find_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 7)
    ids = [3 * i if i < 50 else i * i for i in range(200)]
    df = spark.createDataFrame([(i, "t%d " % i * 3) for i in ids], "doc_id long, text string").repartition(5)
    got = {r["id"]: r["edited"] for r in simhash.edited(df).where("not ghost").collect()}
    order = sorted(set(ids))
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = "t%d " % a * 3, "t%d " % b * 3
        assert got[a] == t[:len(t) - len(t) // 2] + n[:len(t) // 2]


@pytest.mark.parametrize("radius", [1, 3])
def test_radius_search_is_complete(spark, radius):
    import random
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    every = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = Counter((x["q"], x["fp"], x["distance"]) for x in simhash.within_radius(df, df, radius).collect())
    dist = lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count()
    u = set(signed)
    assert got == Counter((a, b, dist(a, b)) for a in u for b in u if dist(a, b) <= radius)


def test_cache_with_doubled_appends_and_two_writers(spark, tmp_path):
    path, root = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "doc_id long, text string")
    first = {tuple(r) for r in token_counts.count_tokens(df, path, cache_root=root).collect()}
    cache = token_counts.TokenCountCache(spark, root, path)
    stored = spark.read.schema(token_counts.CACHE).parquet(cache.path)
    rows = [tuple(r) for r in stored.collect()]
    for _ in range(2):  # a job tried again, and another job that counted the same texts
        spark.createDataFrame(rows, token_counts.CACHE).write.mode("append").parquet(cache.path)
    again = token_counts.count_tokens(df, path, cache_root=root).collect()
    assert len(again) == 3 and {tuple(r) for r in again} == first
    assert cache.read().count() == 3 < spark.read.schema(token_counts.CACHE).parquet(cache.path).count()
