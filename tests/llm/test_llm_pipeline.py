"""The pipeline against plain Python, and the cases every operator defines."""
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadre.llm import bpe, line_dedup, lm, minhash, mixing, pii, quality, simhash, suffix, token_counts
from cadre.llm.queries import ORACLE, QUERIES, tokenizer_path
from test_llm_pairs import groups_of
from test_llm_text import lines_left

BPE = tokenizer_path("byte_bpe_50k.json")
OPERATORS = {
    "line_dedup": lambda d: line_dedup.dedup_lines(d, counts=True),
    "pii": lambda d: pii.replace_personal_data(d, b"k"),
    "quality": quality.judge,
    "quality_keep": quality.keep_good,
    "suffix": suffix.remove_repeats,
    "lm": lm.score_documents,
    "bpe": lambda d: bpe.decode(bpe.encode(d, BPE), BPE, [c for c in bpe.encode(d, BPE).columns if c not in d.columns][0]),
    "mixing": lambda d: mixing.mix(d)[0],
    "mixed_rows": mixing.mixed_rows,
    "simhash": simhash.compare_edits,
    "minhash": minhash.near_rows,
    "minhash_drop": minhash.drop_near_copies,
    "token_counts": lambda d: token_counts.count_tokens(d, tokenizer_path("piece_bpe_32k.model")),
}
ONE_TO_ONE = {"line_dedup", "pii", "quality", "suffix", "lm", "bpe", "mixing", "simhash", "minhash", "token_counts"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(odd_rows, name):
    out = OPERATORS[name](odd_rows)
    rows = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if name in ONE_TO_ONE:
        assert Counter(r["doc_id"] for r in rows) == {None: 2, 1: 3, 2: 1}
        # rows that are alike get like results
        if name not in ("simhash",):
            by = defaultdict(set)
            for r in rows:
                by[r["doc_id"], str(r.asDict().get("text"))].add(str(r)) if "text" in out.columns else None
            assert all(len(v) == 1 for v in by.values())


def test_mean_results_of_odd_rows(odd_rows):
    lines = {r["n_dropped"] for r in line_dedup.dedup_lines(odd_rows, counts=True).collect()}
    assert lines == {0}
    near = [(r["doc_id"], r["class_id"], r["kept"]) for r in minhash.near_rows(odd_rows).collect()]
    assert sorted(near, key=str) == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 3 + [(2, 2, True)], key=str)
    cut = [(r["doc_id"], r["n_removed"]) for r in suffix.remove_repeats(odd_rows).collect()]
    assert all(n == 0 for _, n in cut)


def test_queries_are_all_there():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLE) <= set(QUERIES)


def test_pipeline_stage_by_stage(spark, docs, corpus):
    lang = {i: (s, g) for i, _, g, s in corpus}
    text = {i: t for i, t, *_ in corpus}
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, "")
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == kept and len(kept) > 100
    two = stages[1](spark, one, "")
    rows = two.collect()
    want = lines_left([(i, text[i]) for i in kept])
    assert {r["doc_id"]: (r["text"] or "") for r in rows} == {i: x[2] for i, x in want.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    three = stages[2](spark, two, "")
    groups = groups_of([(i, x[2]) for i, x in want.items()])
    left = {i: want[i][2] for i, c in groups.items() if c == i}
    assert {r["doc_id"]: r["text"] or "" for r in three.collect()} == left
    four = stages[3](spark, three, "")
    for d in (one, two, three, four):
        assert d.columns == docs.columns
    times = Counter(r["doc_id"] for r in four.collect())
    size = {i: len(t.encode().split()) for i, t in left.items()}
    total, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        total[lang[i][0]] += n
        taken[lang[i][0]] += n * times[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = mixing.targets({mixing.NULL if s is None else s: n for s, n in total.items()}, {mixing.NULL if s is None else s: k % 3 + 1 for k, s in enumerate(order)})
    assert max(times.values()) <= 3
    off = {s: (taken[s] - goal[mixing.NULL if s is None else s], total[s]) for s in order}
    # what is left of a quota is smaller than any document that could still be taken once more
    assert all(abs(d) <= max(8, 0.01 * n, max(size.values()) / 2) for d, n in off.values()) and abs(sum(d for d, _ in off.values())) < 0.02 * sum(size.values()), off
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(BPE)
    five = stages[4](spark, four, "").collect()
    assert Counter(r["doc_id"] for r in five) == times
    assert all(r["round_trip"] and r["ids"] == lib.encode(left[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in five)


def test_entry_registers_them():
    import __spark_entry__ as entry
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
