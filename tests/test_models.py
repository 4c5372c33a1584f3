"""Tree contributions, boosting, saved stages, resumable search, registry and
the one-scan evaluation."""
import json
import math
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cadre.operators import boost, metrics, score, search, stages, train, trees
from cadre.operators.evaluation import Evaluation
from cadre.sources.registry import ModelRegistry


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(1)
    rows = []
    for i in range(900):
        a, b, c = float(r.randrange(9)), r.gauss(0, 1), r.choice("uvwxyz")
        label = min(2, max(0, int(a / 4 + (c in "ux") - 0.5 + r.gauss(0, 0.4))))
        rows.append((i, a, b, c, label, 1.0 + i % 2, i % 6 == 0, i % 3))
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c string, label int, weight double, is_val boolean, fold int")
    df = StringIndexer(inputCol="c", outputCol="ci").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "ci"], outputCol="features").transform(df).cache()


def largest_gap(scored, contrib, base, col):
    own = scored.select("row_id", F.posexplode(vector_to_array(col)).alias("class", "out"))
    sums = contrib.groupBy("row_id", "class").agg(F.sum("contribution").alias("s"))
    gap = F.col("out") - F.element_at(F.array(*map(F.lit, base)), F.col("class") + 1) - F.coalesce("s", F.lit(0.0))
    return own.join(sums, ["row_id", "class"], "left").agg(F.max(F.abs(gap))).first()[0]


def test_forest_contributions_add_up(frame):
    model = RandomForestClassifier(numTrees=9, maxDepth=5, weightCol="weight", seed=2).fit(frame)
    nodes = trees.node_table(model)
    assert nodes.where("left_categories IS NOT NULL").count() and nodes.where("threshold IS NOT NULL").count()
    contrib = trees.path_contributions(frame, nodes, ["a", "b", "c"])
    assert contrib.columns == ["row_id", "feature", "class", "contribution"]
    assert sum(trees.base_values(nodes)) == pytest.approx(1.0)
    assert largest_gap(model.transform(frame), contrib, trees.base_values(nodes), "probability") < 1e-12
    # names may be shared: positions are added up
    merged = trees.path_contributions(frame.where("row_id < 5"), nodes, ["a", "x", "x"])
    assert {r["feature"] for r in merged.select("feature").collect()} <= {"a", "x"}


def test_single_leaf_and_odd_values(spark):
    leaf = spark.createDataFrame([(0, 0, -1, None, None, -1, -1, 5, [0.25, 0.75])], trees.NODES)
    rows = spark.createDataFrame([(1, [1.0]), (2, [float("nan")]), (3, [None])], "row_id int, features array<double>")
    assert trees.path_contributions(rows, leaf, ["a"]).count() == 0 and trees.base_values(leaf) == [0.25, 0.75]
    split = spark.createDataFrame([(0, 0, 0, 2.0, None, 1, 2, 5, [0.5]), (0, 1, -1, None, None, -1, -1, 2, [0.1]), (0, 2, -1, None, None, -1, -1, 3, [0.9])], trees.NODES)
    got = {r["row_id"]: r["contribution"] for r in trees.path_contributions(rows, split, ["a"]).collect()}
    assert got == pytest.approx({1: -0.4, 2: 0.4, 3: 0.4})  # NaN and null go right
    with pytest.raises(ValueError):
        trees.path_contributions(rows, split.where("false"), ["a"])


def test_walks_of_batches_equal_the_joined_walks(frame, spark, monkeypatch):
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=2).fit(frame)
    # ids that repeat or are null are added up; a null, short or odd array goes right
    odd = spark.createDataFrame([(7, [None, 0.5, 1.0]), (7, [2.0]), (None, None), (None, [float("nan"), -1.0, 99.0]), (8, [])], "row_id long, features array<double>")
    rows = frame.select("row_id", vector_to_array("features").alias("features")).where("row_id < 200").unionByName(odd)
    nodes = trees.node_table(model)

    def found():
        got = trees.path_contributions(rows, nodes, ["a", "b", "a"])
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        return {(r["row_id"], r["feature"], r["class"]): r["contribution"] for r in got.collect()}, plan.count("Join ")

    batches, joins = found()
    assert joins == 0  # no row is copied for every tree
    monkeypatch.setattr(trees, "fits", lambda nodes: False)
    joined, joins = found()
    assert joins > 0 and (None, "a", 0) in joined and batches == pytest.approx(joined, abs=1e-12)


def plain_boost(rows, k, rounds, step):
    """Rows (x in {0, 1}, y, w, is_val): stumps on x, in plain Python."""
    train_rows = [r for r in rows if not r[3]]
    total = sum(r[2] for r in train_rows)
    base = [math.log(sum(r[2] for r in train_rows if r[1] == c) / total) for c in range(k)]
    m = {x: list(base) for x in (0, 1)}
    out = []
    prob = lambda x: [math.exp(v) / sum(map(math.exp, m[x])) for v in m[x]]
    for r in range(1, rounds + 1):
        p = {x: prob(x) for x in (0, 1)}
        add = {}
        for x in (0, 1):
            for c in range(k):
                h = max(p[x][c] * (1 - p[x][c]), boost.H_MIN)
                z = [(min(4.0, max(-4.0, ((y == c) - p[x][c]) / h)), w * h) for xx, y, w, v in train_rows if xx == x]
                add[x, c] = sum(a * b for a, b in z) / sum(b for _, b in z)
        for (x, c), v in add.items():
            m[x][c] += step * (k - 1) / k * v
        loss = lambda val: (lambda part: sum(-math.log(prob(x)[y]) for x, y, _, _ in part) / len(part))([q for q in rows if q[3] == val])
        out.append((r, loss(False), loss(True)))
    return out


def test_boosting_rounds_equal_plain_python(spark):
    r = random.Random(3)
    rows = [(x := r.randrange(2), min(2, x + r.choice([0, 0, 1])) if r.random() < 0.9 else r.randrange(3), 1.0 + i % 3, i % 5 == 0) for i in range(300)]
    df = spark.createDataFrame([(float(x), y, w, v) for x, y, w, v in rows], "x double, label int, weight double, is_val boolean")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    got = boost.fit_boosted(df, 3, max_rounds=5, step=0.3, max_depth=1, min_instances=1, subsample=1.0, patience=50, checkpoint_every=2)
    want = plain_boost(rows, 3, 5, 0.3)
    for g, w in zip(got.history, want, strict=True):
        assert g == pytest.approx(w, abs=1e-9)
    assert got.history_table().where("best").count() == 1


def test_boosting_rounds_keep_one_frame_of_plain_columns(frame, monkeypatch):
    kept = []
    persist = type(frame).persist
    monkeypatch.setattr(type(frame), "persist", lambda df, *a: kept.append(df) or persist(df, *a))
    boost.fit_boosted(frame, 3, max_rounds=2, max_depth=2)
    assert len(kept) == 2  # the scored rows of each round, and no second copy of the drawn ones
    assert all("lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString() for df in kept)


def test_boosting_stops_on_the_validation_rows(spark, frame):
    # validation labels that training makes ever less likely
    wrong = frame.withColumn("label", F.when(F.col("is_val"), (F.col("label") + 1) % 3).otherwise(F.col("label")))
    got = boost.fit_boosted(wrong, 3, max_rounds=40, step=0.5, max_depth=3, patience=2)
    assert len(got.history) == got.best_round + 2 < 40
    assert len(got.regressors[0].trees) == got.best_round
    no_val = boost.fit_boosted(frame.withColumn("is_val", F.lit(None).cast("boolean")), 3, max_rounds=2, max_depth=2)
    assert no_val.best_round == 2
    with pytest.raises(ValueError):
        boost.fit_boosted(frame.withColumn("is_val", F.lit(True)), 3)


def test_boosted_model_is_saved_and_explained(frame, tmp_path):
    got = boost.fit_boosted(frame, 3, max_rounds=4, step=0.4, max_depth=4, patience=3)
    scored = got.model.transform(frame)
    got.model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(frame)
    cols = ["row_id", vector_to_array("probability").alias("p"), "prediction"]
    assert again.select(*cols).exceptAll(scored.select(*cols)).count() == 0
    assert set(scored.columns) == {*frame.columns, "probability", "rawPrediction", "prediction"}
    nodes = trees.boosted_node_table(got.regressors)
    base = [a + b for a, b in zip(trees.base_values(nodes), got.base)]
    assert largest_gap(scored, trees.path_contributions(frame, nodes, ["a", "b", "c"]), base, "rawPrediction") < 1e-9
    acc = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert acc > 0.6


SCHEMA = {"cat": {"type": "categorical", "values": ["a", "b"]}, "num": {"type": "numeric", "range": [0.0, 10.0]}, "flag": {"type": "binary"}}


def test_stages_survive_a_save_and_a_new_session(spark, tmp_path):
    raw = [(1, "b", "4", "1", 1.0), (2, "a", "6", "0", 0.0), (3, None, "", "TRUE", 1.0), (4, "b", "2", "0", 0.0)]
    df = spark.createDataFrame(raw, "row_id int, cat string, num string, flag string, y double")
    pipe = Pipeline(stages=[stages.RowValidator(schema=json.dumps(SCHEMA), keep=["row_id", "y"]),
                            stages.OrdinalEncoder(inputCols=["cat"], outputCols=["code"]),
                            stages.SmoothedTargetEncoder(inputCols=["cat"], outputCols=["enc"], labelCol="y", smoothing=2.0),
                            stages.PopulationScaler(inputCols=["num", "flag"], outputCols=["z", "zf"]),
                            VectorAssembler(inputCols=["code", "enc", "z", "zf"], outputCol="features")]).fit(df)
    path = str(tmp_path / "p")
    pipe.write().overwrite().save(path)
    loaded = stages.load_in(spark.newSession(), path)
    new = spark.createDataFrame([(1, "b", "4", "1"), (2, "q", "11", "yes"), (3, None, "x", None)], "row_id int, cat string, num string, flag string")
    got = {r["row_id"]: r for r in loaded.transform(new).collect()}
    sd = math.sqrt(sum((x - 3.0) ** 2 for x in (4, 6, 0, 2)) / 4)
    assert [got[i]["code"] for i in (1, 2, 3)] == [1.0, -1.0, 2.0]  # a, b, nan
    assert got[1]["enc"] == pytest.approx((1.0 + 2 * 0.5) / 4) and got[2]["enc"] == 0.5 and got[3]["enc"] == pytest.approx(2 / 3)
    assert [got[i]["z"] for i in (1, 2, 3)] == pytest.approx([1 / sd, 8 / sd, -3 / sd])
    assert got[1]["errors"] == [] and got[3]["errors"] == ["'num': expected a number, got 'x'"]
    assert got[2]["errors"] == ["'cat': unknown category, got 'q'", "'num': expected 0.0 to 10.0, got '11'", "'flag': expected 0/1, got 'yes'"]
    assert got[1]["cat"] == "b" and len(got[1]["features"]) == 4
    same = pipe.transform(new).select("row_id", vector_to_array("features").alias("f"))
    assert loaded.transform(new).select("row_id", vector_to_array("features").alias("f")).collect() == same.collect()


def test_linear_stages_code_unseen_as_minus_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "cat string, num double")
    model = Pipeline(stages=train.linear_stages(train.FeatureSpec(["cat"], ["num"]))).fit(df)
    got = [list(r["features"]) for r in model.transform(spark.createDataFrame([("zz", None), ("b", 3.0)], "cat string, num double")).collect()]
    assert got == [[-1.0, -2.0], [1.0, 1.0]]


def test_schema_checks_are_off_by_default(spark):
    df = spark.createDataFrame([("zz", "99")], "cat string, num string")
    types = {k: v["type"] for k, v in SCHEMA.items()}
    assert score.validate_rows(df, types).first()["errors"] == []
    assert len(score.validate_rows(df, types, features=SCHEMA).first()["errors"]) == 2


class Killed(Exception):
    pass


def test_a_killed_search_goes_on(spark, frame, tmp_path):
    frame = frame.drop("features")
    spec = train.FeatureSpec(categorical=["c"], numeric=["a", "b"])
    log = search.TrialLog(spark, str(tmp_path / "log"))
    space = {"maxDepth": ("int", 2, 4), "subsamplingRate": ("float", 0.5, 1.0)}
    est = train.forest(numTrees=3, minInstancesPerNode=1)
    fits = []

    def dies(trial, fold):
        if len(fits) == 4:
            raise Killed
        fits.append((trial, fold))

    with pytest.raises(Killed):
        train.tune(spec, est, frame, "fold", 3, n_trials=3, space=space, log=log, run="r", parallelism=1, on_fit=dies)
    kept = log.done("r")
    assert set(kept) == set(fits) and len(fits) == 4
    again = []
    _, maps, avg = train.tune(spec, est, frame, "fold", 3, n_trials=3, space=space, log=log, run="r", parallelism=2, on_fit=lambda t, f: again.append((t, f)))
    assert len(again) == 5 and not set(again) & set(fits)
    rows = log.read("r").collect()
    assert len(rows) == 9 and {r["params"] for r in rows} == {search.describe(m) for m in maps}
    assert avg == [pytest.approx(sum(log.done("r")[t, f] for f in range(3)) / 3) for t in range(3)]
    # the whole log: nothing is fitted, another run starts afresh
    train.tune(spec, est, frame, "fold", 3, n_trials=3, space=space, log=log, run="r", on_fit=lambda *a: again.append(a))
    assert len(again) == 5 and log.done("other") == {}


def test_registry_points_to_whole_versions_only(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "cat string, num double")
    model = Pipeline(stages=train.linear_stages(train.FeatureSpec(["cat"], ["num"]))).fit(df)
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    first = reg.publish("one", model, {"accuracy": 0.5}, {"features": ["cat"]}, {"cuts": df})
    with pytest.raises(Exception, match="(?i)already exists"):
        reg.publish("half", model, tables={"../model": df})
    assert reg.current()["version"] == first and reg.versions().count() == 1
    second = reg.publish("two", model, {"accuracy": 0.7})
    assert reg.current()["version"] == second and reg.current()["metrics"] == {"accuracy": 0.7}
    loaded, meta = reg.load(first)
    assert meta == {"features": ["cat"]} and reg.table("cuts", first).collect() == df.collect()
    assert loaded.transform(df).first()["features"] == model.transform(df).first()["features"]


def test_one_scan_evaluation_equals_the_single_reports(spark):
    from cadre.plans import views
    p = ["p0", "p1", "p2"]
    pred = views.pred(spark, "/root/testdata/sf0.01").cache()
    e = Evaluation(pred, prob_cols=p, heads={"composite": [1, 2]})
    heads = {r["head"]: r for r in e.heads_summary().collect()}
    for r in metrics.auc_ovr(pred, "label", p).collect():
        if r["class"] != "macro":
            assert heads[r["class"]]["auc"] == pytest.approx(r["auc"])
    for h, cs in (("0", [0]), ("composite", [1, 2])):
        best = metrics.best_threshold(metrics.threshold_curve(metrics.head_scores(pred, "label", p, cs), "score", "positive")).first()
        assert (heads[h]["best_threshold"], heads[h]["best_f1"]) == pytest.approx((best["best_threshold"], best["best_f1"]))
    a = {(int(r["head"]), r["bin"]): (r["n"], r["mean_predicted"], r["fraction_positive"]) for r in e.calibration().collect()}
    b = {(r["class"], r["bin"]): (r["n"], r["mean_predicted"], r["fraction_positive"]) for r in metrics.calibration(pred, "label", p).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert {r["class"]: tuple(r)[1:] for r in e.class_report().collect()} == {r["class"]: pytest.approx(tuple(r)[1:]) for r in metrics.class_report(pred).collect()}
    assert tuple(e.headline().first()) == pytest.approx(tuple(metrics.accuracy_report(pred).first()))


def test_evaluation_of_nulls_and_no_rows(spark):
    schema = "label int, prediction int, p0 double, p1 double"
    df = spark.createDataFrame([(None, 0, 0.5, 0.5), (0, None, None, 0.2), (1, 1, 0.1, 0.9)], schema)
    e = Evaluation(df, prob_cols=["p0", "p1"])
    heads = {r["head"]: r for r in e.heads_summary().collect()}
    assert (heads["0"]["n"], heads["0"]["n_positive"], heads["1"]["n"], heads["1"]["n_positive"]) == (2, 0, 3, 1)
    assert heads["0"]["auc"] is None and heads["1"]["auc"] == 1.0
    assert Evaluation(df.where("false"), prob_cols=["p0", "p1"]).heads_summary().count() == 0


def test_sketches_merge_like_one_pass(spark, tmp_path):
    from cadre.operators import sketches
    df = spark.range(20_000).selectExpr("id % 4 AS day", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 3000 END AS v",
                                        "CAST(id AS STRING) AS s", "CAST(NULL AS DOUBLE) AS none")
    store = sketches.SketchStore(spark, str(tmp_path / "s"))
    for day in range(4):
        store.add(df.where(f"day = {day}"), "day", ["v", "s", "none"], ["v", "none"])
    got = {r["feature"]: r for r in store.profile().collect()}
    one = {r["feature"]: r for r in sketches.merged_profile(sketches.column_sketches(df.withColumn("day", F.lit(0)), "day", ["v", "s", "none"], ["v", "none"])).collect()}
    for c in got:  # the distinct sketches merge to the very same registers
        assert [got[c][x] for x in ("n", "n_null", "lo", "hi", "n_distinct")] == [one[c][x] for x in ("n", "n_null", "lo", "hi", "n_distinct")]
    assert (got["v"]["n"], got["v"]["n_null"], got["v"]["lo"], got["v"]["hi"]) == (20_000, 2_000, 1.0, 2999.0)
    assert abs(got["v"]["n_distinct"] - 2700) < 0.05 * 2700 and abs(got["s"]["n_distinct"] - 20_000) < 0.05 * 20_000
    assert got["none"]["n_null"] == 20_000 and got["none"]["quantiles"] is None and got["s"]["quantiles"] is None
    for p, q in zip((1 / 3, 0.5, 2 / 3), got["v"]["quantiles"]):
        assert abs(q / 3000 - p) < 0.035
    assert {r["n"] for r in store.profile(["1", "3"]).collect()} == {10_000}
    store.add(df.where("day = 1 AND v IS NOT NULL"), "day", ["v"], ["v"])  # day 1 is replaced
    assert {r["feature"]: r["n"] for r in store.profile(["1"]).collect()} == {"v": df.where("day = 1 AND v IS NOT NULL").count()}


def test_payload_document(spark, tmp_path):
    from cadre.operators import explain
    from cadre.sources import artifacts
    rows = [(1, 0, c, -0.5 - c, g, v) for c in range(2) for g, v in (("a", 0.2 + c), ("b", -1.0))] + [(2, 1, c, -0.1, "a", 0.4) for c in range(2)]
    long = spark.createDataFrame(rows, "row_id int, actual int, class int, base_log_odds double, group string, contribution double")
    info = [("a", "A", "first"), ("b", "B", "second"), ("z", "Z", "none")]
    nested = explain.payload_samples(long, ["a", "b", "z"], 2)
    artifacts.write_payload(nested, explain.payload_groups(nested, info, 2), str(tmp_path / "p"), {"n_test": 2})
    doc = json.loads(artifacts.payload_document(spark, str(tmp_path / "p")))
    assert doc["meta"] == {"n_test": 2} and sorted(doc["correlations"]) == ["a", "b", "z"]
    assert doc["correlations"]["a"] == pytest.approx([0.3, 0.8]) and doc["correlations"]["b"] == pytest.approx([-0.5, -0.5])
    assert {g["key"]: g["dominant_class"] for g in doc["groups"]} == {"a": 1, "b": 0, "z": 0}
    assert {g["key"]: (g["label"], g["description"]) for g in doc["groups"]}["b"] == ("B", "second")
    first = next(s for s in doc["samples"] if s["row_id"] == 1)
    assert first["base"] == [-0.5, -1.5] and first["contributions"] == [[0.2, 1.2], [-1.0, -1.0], [0.0, 0.0]] and first["actual"] == 0
    with pytest.raises(ValueError):
        artifacts.payload_document(spark, str(tmp_path / "p"), limit=1)
