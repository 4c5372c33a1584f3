"""Driver contract: entry smoke run, registry consistency, sample oracle checks."""
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from cadre.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "advisor" in df.columns


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 40


@pytest.mark.parametrize("name", ["kpi_rollup", "scorecard_rollup", "stratified_split", "auc_ovr",
                                  "target_encode_oof", "validate_rows", "period_aligned_rollup"])
def test_oracle_matches_at_small_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(cols)
    order = sorted(cols)
    a = Counter(tuple(r[c] for c in order) for r in [x.asDict() for x in sdf.collect()])
    b = Counter(tuple(dict(zip(cols, r))[c] for c in order) for r in res.fetchall())
    assert a == b


def test_queries_without_a_library_of_the_training_data_part(monkeypatch):
    import sys
    have = set(E.queries())
    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("cadre.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # its import now fails
    left = set(E.queries())
    assert "kpi_rollup" in left and set(E.oracle_sql()) <= left
    assert have - left == {q for q in have if q == "pipeline" or (q.startswith("op") and q[2].isdigit())}
