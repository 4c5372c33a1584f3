"""KPI / scorecard rollups on hand-built facts (FIXTURES section 1-2 cases)."""
import pytest
from pyspark.sql import functions as F

from cadre.operators import rollup

KPI_SCHEMA = "advisor string, month string, metric string, score string, ptg string, wptg string"


def kpi_rows(spark):
    return spark.createDataFrame([
        (" A1 ", "2026-01", "QA", "80", "90", "10"),
        ("A1", "2026-02", "QA", "70", "110", None),       # latest month, null wptg
        ("A1", "2026-02", "CSAT", "60", "1d", None),       # bad PTG text
        ("A1", None, "CSAT", "50", "100", "5"),            # null month
        ("A2", "2026-01", "QA", "90", "80", "8"),           # no PTG >= 100
        ("A2", "2026-01", "QA", "nan", None, "2"),
        ("nan", "2026-01", "QA", "1", "1", "1"),            # dropped key
        ("", "2026-01", "QA", "1", "1", "1"),               # dropped key
    ], KPI_SCHEMA)


def test_kpi_rollup_semantics(spark):
    out = {r["advisor"]: r for r in rollup.kpi_rollup(kpi_rows(spark)).collect()}
    assert set(out) == {"A1", "A2"}
    a1, a2 = out["A1"], out["A2"]
    assert a1["kpi_avg_ptg"] == pytest.approx((90 + 110 + 100) / 3)
    assert a1["kpi_latest_ptg"] == 110.0
    assert a1["kpi_composite_wptg_latest"] is None       # latest month has no wptg
    assert a1["kpi_pct_above_target"] == pytest.approx(2 / 3)
    assert a1["n_kpi_months"] == 2 and a1["n_kpi_metrics"] == 2
    assert a2["kpi_pct_above_target"] is None             # T6 parity: null, not 0
    assert a2["kpi_avg_score"] == 90.0
    z = {r["advisor"]: r for r in rollup.kpi_rollup(kpi_rows(spark), zero_share_as_null=False).collect()}
    assert z["A2"]["kpi_pct_above_target"] == 0.0


def test_blank_texts_are_no_month_and_no_metric(spark):
    df = spark.createDataFrame([("A", "", "", "1", "1", "1"), ("A", None, "\u00a0", "2", None, None)], KPI_SCHEMA)
    r = rollup.kpi_rollup(df).first()
    assert r["n_kpi_months"] is None and r["n_kpi_metrics"] == 0 and r["kpi_avg_score"] == 1.5


def test_person_features_keep_persons_without_top_metrics(spark):
    df = spark.createDataFrame([("A", "2026-01", "m", "1", "2", "3"), ("A", "2026-01", "m", "3", "4", "5"),
                                ("B", "2026-01", "other", "1", "1", "1"), (" ", "2026-01", "m", "9", "9", "9"),
                                ("C", None, None, None, None, None)], KPI_SCHEMA)
    rows = {r["advisor"]: r for r in rollup.person_features(df, n=1).collect()}
    assert set(rows) == {"A", "B", "C"} and rows["A"]["m_score_avg"] == 2.0
    assert rows["B"]["m_ptg_avg"] is None and rows["B"]["kpi_avg_ptg"] == 1.0 and rows["C"]["n_kpi_metrics"] == 0
    # rows without a valid key do not choose the top metrics
    more = spark.createDataFrame([("nan", "2026-01", "z", "1", "1", "1")] * 9, KPI_SCHEMA)
    assert rollup.top_metric_list(df.union(more), n=1) == ["m"]


def test_period_rollup_trims_and_joins_each_label_once(spark):
    facts = spark.createDataFrame([("A", "2026-01", "m", "1", "2", "3"), ("A", "2026-03", "m", "1", "4", "5")], KPI_SCHEMA)
    labels = spark.createDataFrame([(" A", "2026-03"), ("A", "2026-03"), ("A", "2026-01")], "advisor string, eval_month string")
    got = {(r["advisor"], r["eval_month"]): (r["n_rows"], r["sum_wptg"]) for r in rollup.period_aligned_rollup(facts, labels).collect()}
    assert got == {("A", "2026-03"): (2, 8.0), ("A", "2026-01"): (1, 3.0)}


def test_top_metrics_tie_by_name_and_pivot_cap(spark):
    rows_ = [("A", "2026-01", f"m{i:02d}", "1", "1", "1") for i in range(40) for _ in range(1 + (i % 3))]
    df = spark.createDataFrame(rows_, KPI_SCHEMA)
    top = [r["metric"] for r in rollup.top_metrics(df, n=30).orderBy("rank").collect()]
    assert len(top) == 30 and top[:3] == ["m02", "m05", "m08"]
    wide = rollup.metric_pivot(df, n=30)
    assert len(wide.columns) == 1 + 30 * 3


def test_pivot_name_collision_raises(spark):
    df = spark.createDataFrame([("A", "2026-01", "a b", "1", "1", "1"), ("A", "2026-01", "a-b", "1", "1", "1")],
                               KPI_SCHEMA)
    with pytest.raises(ValueError):
        rollup.metric_pivot(df, metrics=["a b", "a-b"])


def test_metric_latest_by_month_then_value(spark):
    out = {r["metric"]: r for r in rollup.metric_latest(kpi_rows(spark)).filter(F.col("advisor") == "A1").collect()}
    assert out["QA"]["ptg_latest"] == 110.0 and out["CSAT"]["ptg_latest"] == 100.0
    assert out["QA"]["n_kpi_months"] == 2


def test_scorecard_rollup(spark):
    df = spark.createDataFrame([
        (" A@X.com", 1, "10", "3", "1", "0", "2", "1", "Y"),
        ("a@x.com ", 2, "20", "1", "2", "4", None, "1", "maybe"),
        ("a@x.com", 3, None, "x", None, None, None, None, "no"),
        ("b@x.com", 1, None, None, None, None, None, None, None),
    ], "email string, ts int, ptg string, rank string, quartile string, consec_failing string, "
       "met_count string, fail_count string, kpi_passed string")
    out = {r["email_lower"]: r for r in rollup.scorecard_rollup(df, order=("ts",)).collect()}
    a, b = out["a@x.com"], out["b@x.com"]
    assert a["sc_avg_ptg"] == 15.0 and a["sc_latest_ptg"] == 20.0 and a["sc_best_rank"] == 1.0
    assert a["sc_total_met"] == 2.0 and a["sc_pct_kpi_passed"] == 0.5 and a["sc_n_records"] == 3
    assert b["sc_avg_ptg"] is None and b["sc_total_met"] is None and b["sc_n_records"] == 1


def test_period_aligned_rollup_window(spark):
    facts = spark.createDataFrame([
        ("A", "2026-01", "m", "1", "10", "1"), ("A", "2026-03", "m", "1", "30", "1"),
        ("A", "2026-04", "m", "1", "40", "1"), ("A", "2025-12", "m", "1", "99", "1")], KPI_SCHEMA)
    labels = spark.createDataFrame([("A", "2026-03"), ("B", "2026-03")], "advisor string, eval_month string")
    out = {r["advisor"]: r for r in rollup.period_aligned_rollup(facts, labels).collect()}
    assert out["A"]["n_rows"] == 2 and out["A"]["avg_ptg"] == 20.0
    assert out["B"]["n_rows"] == 0 and out["B"]["avg_ptg"] is None
