"""Model-layer helpers on tiny frames: OvR probabilities, tuning loop,
evaluator arithmetic, latest-period rows."""
import pytest
from pyspark.sql import functions as F

from cadre.operators import metrics, rollup, train


def _frame(spark, n=120):
    rows_ = [(i, "a" if i % 2 else "b", float(i % 7), i % 3, i % 4) for i in range(n)]
    return spark.createDataFrame(rows_, "row_id int, cat string, num double, label int, fold int") \
        .withColumn("weight", F.lit(1.0)).withColumn("is_val", F.col("row_id") % 5 == 0)


SPEC = train.FeatureSpec(categorical=["cat"], numeric=["num"])


def test_macro_f1_evaluator_matches_dataframe_metric(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (3, 0)], "label int, prediction int")
    pairs = [(r["actual"], r["predicted"], r["n"]) for r in metrics.pair_counts(df).collect()]
    assert train.macro_f1_from_pairs(pairs) == pytest.approx(metrics.macro_f1(df).first()["macro_f1"])
    assert train.MacroF1Evaluator().evaluate(df.withColumn("prediction", F.col("prediction").cast("double"))) \
        == pytest.approx(metrics.macro_f1(df).first()["macro_f1"])


def test_ovr_probabilities_sum_to_one(spark):
    df = _frame(spark)
    model = train.pipeline(SPEC, train.boosted_ovr(max_iter=5, max_depth=2, validation="is_val")).fit(df)
    ev = train.evaluate(model, df, 3, "ovr").first()
    assert ev["auc"] is not None and 0.0 <= ev["accuracy"] <= 1.0
    probs = train.with_probabilities(train.ovr_probabilities(model.transform(df)), 3)
    for r in probs.select("p0", "p1", "p2").collect():
        assert r["p0"] + r["p1"] + r["p2"] == pytest.approx(1.0)


def test_tune_loop_scores_every_trial(spark):
    df = _frame(spark)
    model, maps, avg = train.tune(SPEC, train.forest(numTrees=5, minInstancesPerNode=1), df, "fold", 4,
                                  n_trials=2, space={"maxDepth": ("int", 2, 3)})
    assert len(maps) == 2 and len(avg) == 2 and all(0.0 <= a <= 1.0 for a in avg)
    assert model.transform(df).count() == df.count()


def test_latest_period_rows(spark):
    df = spark.createDataFrame([("A", "2026-01", 1), ("A", "2026-02", 2), ("A", "2026-02", 3),
                                ("B", None, 4), ("B", "2025-12", 5)], "advisor string, month string, v int")
    got = sorted(r["v"] for r in rollup.latest_period_rows(df).collect())
    assert got == [2, 3, 5]


def test_models_learn_a_table_with_signal(spark):
    from cadre.plans import catalog
    catalog.load_all()
    d = "/root/testdata/sf0.001"
    f = catalog.QUERIES["train_forest"](spark, d).first()
    assert f["accuracy"] > f["baseline_accuracy"] + 0.2
    lr = catalog.QUERIES["train_logreg"](spark, d)
    ev = lr.where("model is not null").first()
    assert ev["accuracy"] > ev["baseline_accuracy"] + 0.2
    up = {r["class"]: r["feature"] for r in lr.where("direction = 'up' and rank = 1").collect()}
    assert up[2] in ("n_lines", "sum_qty")  # the top tier is the orders with most lines and units
    imp = {r["feature"]: r["importance"] for r in catalog.QUERIES["permutation_importance"](spark, d).collect()}
    assert max(imp, key=imp.get) in ("n_lines", "sum_qty") and max(imp.values()) > 0.05


def test_permutation_moves_rows_and_keeps_values(spark):
    from collections import Counter

    from cadre.operators import split
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL ELSE id * 10 END AS x")
    rows = split.permute_columns(df, ["x"], "id").collect()
    assert Counter(r["x"] for r in rows) == Counter(r["perm_x"] for r in rows) and len(rows) == 5000
    assert sum(r["x"] is not None and r["x"] == r["perm_x"] for r in rows) == 0
    assert [r["perm_x"] for r in split.permute_columns(spark.range(1).selectExpr("id", "id AS x"), ["x"], "id").collect()] == [0]


def test_seeds_give_different_splits(spark):
    from cadre.operators import split
    df = spark.range(20_000).selectExpr("id", "id % 3 AS label")
    a = split.stratified_split(df, "label", "id", 0.2, None, seed=42).select("id", F.col("split").alias("a"))
    b = split.stratified_split(df, "label", "id", 0.2, None, seed=43).select("id", F.col("split").alias("b"))
    same = a.join(b, "id").where("a = b").count() / 20_000
    assert 0.66 < same < 0.70  # 0.8 ** 2 + 0.2 ** 2


def test_registered_search_is_the_whole_search(spark, monkeypatch):
    from cadre.plans import q_ml
    rows_ = [(i, "F" if i % 2 else "O", "1-URGENT", "AUTO", f"N{i % 3}", float(i), 1 + i % 7, float(i % 50), 0.1, 0.2, i % 3, "test" if i % 5 == 0 else "train") for i in range(60)]
    frame = spark.createDataFrame(rows_, "row_id bigint, o_orderstatus string, o_orderpriority string, c_mktsegment string, c_nationkey string, c_acctbal double, "
                                         "n_lines bigint, sum_qty double, avg_disc double, avg_tax double, label int, split string")
    monkeypatch.setattr(q_ml, "_ml_frame", lambda spark, d: frame.withColumn("weight", F.lit(1.0)).withColumn("is_val", F.lit(False)))

    class Seen(Exception):
        pass

    def seen(maps, stages, estimator, evaluator, rows, fold, k, *_):
        raise Seen(maps, k, rows.count())

    monkeypatch.setattr(train, "cross_validate", seen)
    with pytest.raises(Seen) as e:
        q_ml.tune_cv(spark, "unused")
    maps, k, n = e.value.args
    assert (len(maps), k, n) == (50, 5, 48)
    for name, (kind, lo, hi) in train.FOREST_SPACE.items():
        drawn = [float(v) for m in maps for p, v in m.items() if p.name == name]
        assert len(drawn) == 50 and lo <= min(drawn) < (lo + hi) / 2 < max(drawn) <= hi
