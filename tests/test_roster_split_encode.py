"""Roster dedup/joins, stratified splits and encoders on hand-built frames."""
import pytest
from pyspark.sql import functions as F

from cadre.operators import encode, roster, split


def test_priority_dedup_keeps_whole_priority_row(spark):
    a = spark.createDataFrame([("1", None, "a1"), ("2", "5", "a2"), (" 3 ", "4", "a3"), ("", "1", "blank")],
                              "emp_id string, star string, name string")
    b = spark.createDataFrame([("1", "3", "b1", "x"), ("3", "1", "b3", "y"), ("4", "5", "b4", "z"),
                               ("4", "4", "b4bis", "w")], "emp_id string, star string, name string, seg string")
    u = {r["emp_id"]: r for r in roster.union_dedup(a, b, "emp_id", order=["name"]).collect()}
    assert set(u) == {"1", "2", "3", "4"}
    assert u["1"]["star"] is None and u["1"]["_source"] == "a"     # T8: A's null label hides B's
    assert u["3"]["name"] == "a3"                                    # NBSP key normalised
    assert u["4"]["name"] == "b4"                                    # within-source tie by order col
    en = {r["emp_id"]: r for r in roster.enrich(roster.union_dedup(a, b), b, "emp_id", a.columns,
                                                 order=["seg"]).collect()}
    assert en["4"]["seg"] == "w" and en["2"]["seg"] is None


def test_join_coverage(spark):
    r = spark.createDataFrame([("1",), ("2",), ("3",)], "emp_id string")
    k = spark.createDataFrame([(" 1", 5)], "advisor string, n_kpi_months int")
    k = k.withColumn("advisor", F.trim("advisor"))
    j = roster.left_join_rollup(r, k, "emp_id", "advisor")
    cov = roster.join_coverage(j, "n_kpi_months", "kpi").first()
    assert (cov["total"], cov["joined"]) == (3, 1) and cov["pct"] == pytest.approx(100 / 3)


def _labelled(spark, n0=171, n1=29):
    rows_ = [(i, 0) for i in range(n0)] + [(10_000 + i, 1) for i in range(n1)]
    return spark.createDataFrame(rows_, "id long, y int")


def test_stratified_split_exact_counts(spark):
    s = split.stratified_split(_labelled(spark), "y", "id", 0.2, None)
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got[(0, "test")] == 34 and got[(1, "test")] == 6


def test_bucketed_rank_equals_single_window(spark):
    from pyspark.sql import Window
    df = _labelled(spark, 500, 300).withColumn("h", split.hash_order("id"))
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "id")))
    got = split.rank_within(df, ["y"], "h", "id", n_buckets=7)
    a = sorted((r["id"], r["r"]) for r in ref.collect())
    b = sorted((r["id"], r["_rank"]) for r in got.collect())
    assert a == b


def test_folds_balanced(spark):
    f = split.stratified_folds(_labelled(spark, 103, 17), "y", "id", 5)
    sizes = {}
    for r in f.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in sizes.values())


def test_target_encoder_hand_values(spark):
    tr = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1), ("a", 1)], "c string, y int")
    m = encode.fit_target_encoder(tr, ["c"], "y", smoothing=10.0)
    g = 4 / 5
    assert m.global_mean == pytest.approx(g)
    te = spark.createDataFrame([("a",), ("b",), (None,), ("zzz",)], "c string")
    out = [r["c"] for r in m.transform(te).collect()]
    assert out[0] == pytest.approx((3 * (2 / 3) + 10 * g) / 13)
    assert out[1] == pytest.approx((1 + 10 * g) / 11)
    assert out[2] == pytest.approx((1 + 10 * g) / 11)      # null is its own category 'nan'
    assert out[3] == pytest.approx(g)                        # unseen -> global mean


def test_out_of_fold_does_not_use_own_fold(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 0), (0, "b", 1), (1, "b", 1)], "fold int, c string, y int")
    out = {(r["fold"], r["c"]): r["c_oof"] for r in encode.target_encode_oof(df, ["c"], "y", "fold").collect()}
    g0, g1 = (0 + 1) / 2, (1 + 1) / 2           # other-fold global means
    assert out[(0, "a")] == pytest.approx((0 + 10 * g0) / 11)
    assert out[(1, "b")] == pytest.approx((1 + 10 * g1) / 11)


def test_ordinal_and_standardise(spark):
    tr = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, None)], "c string, x double")
    te = spark.createDataFrame([("a", 1.0), ("zz", None), (None, 2.0)], "c string, x double")
    o = [r["c_ord"] for r in encode.ordinal_encode(tr, te, ["c"]).collect()]
    assert o == [0, -1, 2]            # sorted: 'a', 'b', 'nan'
    z = [r["x_z"] for r in encode.standardise(tr, te, ["x"]).collect()]
    mean, sd = 4 / 3, (((1 - 4 / 3) ** 2 + (3 - 4 / 3) ** 2 + (4 / 3) ** 2) / 3) ** 0.5
    assert z[0] == pytest.approx((1 - mean) / sd) and z[1] == pytest.approx(-mean / sd)
