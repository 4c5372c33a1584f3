"""Plan-time column resolution and feature sets (P1-P15), W9 sample."""
from cadre.operators import columns, split


def test_header_normalise_and_resolve(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Advisor ID ` int, `email` int, `PTG` int")
    n = columns.normalise_headers(df)
    assert n.columns == ["Advisor ID", "email", "PTG"]
    assert columns.resolve(df.columns, columns.NameRule(["advisor id"])) == "Advisor\u00a0ID "
    assert columns.resolve(["a", "A "], columns.NameRule(["a"])) == "A "                 # last duplicate wins
    assert columns.resolve(["x", "Game Changer Employee Number"], "employee") == "Game Changer Employee Number"
    assert columns.resolve(["My Employee\u00a0Number (new)"], "employee") == "My Employee\u00a0Number (new)"
    assert columns.resolve(["Emp No", "Advisor ID"], "employee") == "Advisor ID"          # candidate order, not table order
    assert columns.resolve(["Email Address"], "email") == "Email Address"
    assert columns.resolve(["latest star rating"], "star") == "latest star rating"
    assert columns.resolve(["Latest Weighted PTG"], "ptg_target") == "Latest Weighted PTG"
    assert columns.resolve(["x"], "star") is None


def test_select_reindex_drop(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert columns.select_renamed(df, {"x": "_x", "zz": "_z"}).columns == ["_x"]
    r = columns.reindex(df, ["y", "missing"])
    assert r.columns == ["y", "missing"] and r.first()["missing"] is None
    assert columns.drop_cols(df, ["x", "nope"]).columns == ["y"]


def test_feature_sets():
    cols = ["L-English", "CL-PRC", "Tr-Bus", "GC Region", "GC Barangay", "Site Distance", "cnt_L",
            "dist_bucket", "Latest STAR Rating", "Role Type", "tenure_months", "Record ID"]
    flags = columns.flag_cols(cols)
    assert flags == ["L-English", "CL-PRC", "Tr-Bus"]
    pre = columns.feature_set(cols, "prehire", first=flags)
    # Tr-Bus, CL-PRC, GC Barangay and dist_bucket are on the always-drop list
    assert pre == ["L-English", "GC Region", "Site Distance", "cnt_L"]
    plus = columns.feature_set(cols, "prehire", "onboarding", first=flags)
    assert plus[-2:] == ["Role Type", "tenure_months"]
    kpi = columns.feature_set(["sc_avg_ptg", "QA_ptg_avg", "n_kpi_months", "Role Type", "x"], "kpi_driver")
    assert kpi == ["sc_avg_ptg", "QA_ptg_avg", "n_kpi_months", "Role Type"]
    demo = columns.feature_set(cols, "demographic")
    assert demo == ["GC Region", "Site Distance", "tenure_months"]
    ex = columns.features_by_exclusion([*cols, "Hire Date", "_y", "GC City"])
    assert ex == ["GC Region", "Site Distance", "Role Type", "tenure_months", "GC City"]
    shared, only = columns.shared_and_only(["a", "b", "c"], ["c", "d", "a"])
    assert shared == ["a", "c"] and only == ["d"]


def test_sample_rows_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "rid")
    a = [r["rid"] for r in split.sample_rows(df, "rid", 20).collect()]
    b = [r["rid"] for r in split.sample_rows(df, "rid", 20).collect()]
    assert a == b and len(set(a)) == 20 and a != list(range(20))
