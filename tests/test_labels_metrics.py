"""Labels, evaluation metrics and explanations against brute force."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cadre.operators import explain, labels, metrics
from cadre.operators.windows import running_sums


@pytest.mark.parametrize("ties", [0.0, 0.8])
def test_exact_quantiles_match_percentile(spark, ties):
    rnd = random.Random(3)
    vals = [(0.0 if rnd.random() < ties else round(rnd.gauss(100, 20), 2),) for _ in range(5000)] + [(None,)]
    df = spark.createDataFrame(vals, "v double")
    probs = [0.0, 1 / 3, 0.5, 2 / 3, 1.0]
    n, q = labels.exact_quantiles(df, "v", probs)
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert n == 5000 and q == pytest.approx(want, abs=1e-9)
    assert labels.exact_quantiles(df.where("v is null"), "v", [0.5])[0] == 0


def test_buckets_stay_even_with_an_outlier(spark):
    from cadre.operators.windows import bucket_of, quantile_edges
    df = spark.range(20_000).selectExpr("id / 20000.0D AS v").union(spark.createDataFrame([(1e12,)], "v double"))
    edges = quantile_edges(df, "v", 64)
    n = [r["count"] for r in df.groupBy(bucket_of(F.col("v"), edges).alias("b")).count().collect()]
    assert len(n) == 64 and max(n) <= 2 * sum(n) / len(n)
    x = [edges[0] - 1, edges[0], edges[-1], float("inf"), -float("inf")]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(bucket_of(F.col("v"), edges)).collect()]
    assert got == [0, 1, len(edges), len(edges), 0]


def test_tercile_guards(spark):
    with pytest.raises(ValueError):
        labels.tercile_cuts(spark.createDataFrame([(float(i),) for i in range(10)], "v double"), "v")
    df = spark.createDataFrame([(1.0,)] * 40, "v double")
    with pytest.raises(ValueError):
        labels.tercile_tiers(df, "v")


def _pred(spark):
    rows_ = [(0, 0, 0.7, 0.2, 0.1), (0, 1, 0.4, 0.5, 0.1), (1, 1, 0.2, 0.6, 0.2), (1, 0, 0.5, 0.3, 0.2),
             (2, 1, 0.1, 0.6, 0.3), (2, 2, 0.1, 0.2, 0.7), (0, 0, 0.5, 0.3, 0.2), (1, 1, 0.2, 0.5, 0.3)]
    return spark.createDataFrame(rows_, "label int, prediction int, p0 double, p1 double, p2 double")


def _auc_brute(y, s):
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    return sum((p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)) / (len(pos) * len(neg))


def test_auc_matches_brute_force_with_ties(spark):
    df = _pred(spark)
    rows_ = df.collect()
    out = {r["class"]: r["auc"] for r in metrics.auc_ovr(df, "label", ["p0", "p1", "p2"], n_buckets=3).collect()}
    per = [_auc_brute([r["label"] == c for r in rows_], [r[f"p{c}"] for r in rows_]) for c in range(3)]
    for c in range(3):
        assert out[str(c)] == pytest.approx(per[c])
    assert out["macro"] == pytest.approx(sum(per) / 3)


def test_auc_single_class_is_null(spark):
    df = _pred(spark).withColumn("label", F.lit(1))
    out = {r["class"]: r["auc"] for r in metrics.auc_ovr(df, "label", ["p0", "p1", "p2"]).collect()}
    assert out["macro"] is None


def test_class_report_and_macro_f1(spark):
    df = _pred(spark).union(spark.createDataFrame([(3, 0, 0.9, 0.05, 0.05)], _pred(spark).schema))
    rep = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert rep["3"]["precision"] == 0.0 and rep["3"]["recall"] == 0.0 and rep["3"]["f1"] == 0.0
    assert rep["0"]["precision"] == pytest.approx(2 / 4) and rep["0"]["recall"] == pytest.approx(2 / 3)
    f1s = [rep[str(c)]["f1"] for c in range(4)]
    assert metrics.macro_f1(df).first()["macro_f1"] == pytest.approx(sum(f1s) / 4)


def test_confusion_has_empty_cells(spark):
    c = metrics.confusion(_pred(spark), n_classes=4)
    assert c.count() == 16 and c.filter("actual = 3").agg(F.sum("n")).first()[0] == 0


def test_calibration_bin_edges(spark):
    df = spark.createDataFrame([(1 if i % 2 else 0, 0.1 if i < 20 else 0.1000001) for i in range(40)],
                               "label int, p1 double").withColumn("p0", 1 - F.col("p1"))
    cal = {(r["class"], r["bin"]): r["n"] for r in metrics.calibration(df, "label", ["p0", "p1"]).collect()}
    assert cal[(1, 0)] == 20 and cal[(1, 1)] == 20     # 0.1 is right-closed in bin 0


def test_threshold_best_is_lowest_on_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.5, 0), (0.4, 1)], "score double, positive int")
    cur = {r["threshold"]: r for r in metrics.threshold_curve(df, "score", "positive", n_buckets=2).collect()}
    assert cur[0.8]["precision"] == 1.0 and cur[0.8]["recall"] == pytest.approx(2 / 3)
    assert cur[0.4]["recall"] == 1.0 and cur[0.4]["precision"] == 0.75
    best = metrics.best_threshold(metrics.threshold_curve(df, "score", "positive")).first()
    f1 = lambda p, r: 2 * p * r / (p + r + 1e-9)
    assert best["best_f1"] == pytest.approx(max(f1(1, 2 / 3), f1(0.75, 1), f1(2 / 3, 2 / 3), f1(1, 1 / 3)))


def test_running_sums_buckets_equal_brute_force(spark):
    rnd = random.Random(5)
    data = [(g, rnd.random(), rnd.randint(0, 3)) for g in range(3) for _ in range(200)]
    data = list({(g, x): (g, x, v) for g, x, v in data}.values())
    df = spark.createDataFrame(data, "g int, x double, v int")
    got = {(r["g"], r["x"]): r["cum_v"] for r in running_sums(df, ["g"], "x", ["v"], n_buckets=9).collect()}
    for g, x, _ in data:
        assert got[(g, x)] == sum(v for g2, x2, v in data if g2 == g and x2 <= x)


def test_weights_and_baseline(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)] * 3, "label int")
    w = {r["class"]: r["weight"] for r in metrics.class_weights(df).collect()}
    assert w[0] == pytest.approx(12 / 18) and w[1] == pytest.approx(12 / 9)
    b = metrics.majority_baseline(df, df, "label").first()
    assert b["majority_class"] == 0 and b["baseline_accuracy"] == 0.5


def test_groups_notes_direction(spark):
    df = spark.createDataFrame([("CL-PRC",), ("cnt_L",), ("GC City",), ("zzz",), ("V-x",)], "feature string")
    g = [r["g"] for r in df.select(explain.group_of(F.col("feature")).alias("g")).collect()]
    assert g == ["certifications", "counts", "geography", "other", "vertical"]
    n = spark.createDataFrame([("a_wptg_avg",), ("QA_ptg",), ("sc_x",), ("tenure_months",), ("x",)], "feature string")
    notes = [r["n"] for r in n.select(explain.driver_note(F.col("feature")).alias("n")).collect()]
    assert notes == ["Weighted PTG component", "Raw PTG", "Scorecard aggregate", "HR — tenure", ""]
    d = spark.createDataFrame([(0,), (1,), (2,), (3,)], "c int")
    dirs = [r["d"] for r in d.select(explain.direction_text(F.col("c")).alias("d")).collect()]
    assert dirs == [explain.DIR_RISK, "↑ STAR 3 signal", "↑ STAR 4 signal", explain.DIR_TOP]


def test_linear_contributions_and_drivers(spark):
    feats = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", None), (2, "b", 4.0)],
                                  "row_id int, feature string, x double")
    coefs = spark.createDataFrame([(0, "a", 2.0), (1, "a", -1.0), (0, "b", 1.0), (1, "b", 1.0)],
                                  "class int, feature string, coef double")
    c = {(r["row_id"], r["feature"], r["class"]): r["contribution"]
         for r in explain.linear_contributions(feats, coefs).collect()}
    assert c[(1, "a", 0)] == -2.0 and c[(2, "a", 1)] == -1.0 and c[(1, "b", 0)] == 0.0
    d = {r["feature"]: r for r in explain.driver_ranking(explain.linear_contributions(feats, coefs)).collect()}
    assert d["a"]["rank"] == 1 and d["a"]["mean_abs"] == pytest.approx(6 / 4)
