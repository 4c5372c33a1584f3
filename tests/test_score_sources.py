"""Validation/scoring (K1, K2, K4, P12), sources and sinks."""
import os

import pytest
from pyspark.sql import functions as F

from cadre.operators import profile, score, train
from cadre.sources import artifacts, csv

SCHEMA = {"ChS-big": "binary", "Site Distance": "numeric", "GC Region": "categorical"}


def test_bad_numeric_gives_one_error_naming_field(spark):
    df = spark.createDataFrame([("1", "abc", "North", "extra")], "`ChS-big` string, `Site Distance` string, "
                                                               "`GC Region` string, junk string")
    r = score.validate_rows(df, SCHEMA).first()
    assert r["errors"] == ["'Site Distance': expected a number, got 'abc'"]
    assert "junk" not in r.asDict() and r["ChS-big"] == 1.0


def test_all_default_and_blank_rows_validate(spark):
    t = score.template(spark, SCHEMA)
    assert t.columns == list(SCHEMA) and t.count() == 1          # template = field count
    r = score.validate_rows(t, SCHEMA).first()
    assert r["errors"] == [] and r["Site Distance"] is None


def test_binary_text_is_parsed_not_truthy(spark):
    df = spark.createDataFrame([("0",), ("false",), ("TRUE",), ("x",)], "`ChS-big` string")
    out = score.validate_rows(df, {"ChS-big": "binary"}).collect()
    assert [r["ChS-big"] for r in out] == [0.0, 0.0, 1.0, None]
    assert len(out[3]["errors"]) == 1


@pytest.fixture(scope="module")
def tiny_model(spark):
    rows_ = [(i, "a" if i % 2 else "b", float(i % 7), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows_, "row_id int, cat string, num double, label int").withColumn("weight", F.lit(1.0))
    spec = train.FeatureSpec(categorical=["cat"], numeric=["num"])
    model = train.pipeline(spec, train.forest(numTrees=5, maxDepth=3, minInstancesPerNode=1)).fit(df)
    return model, spec


def test_batch_scoring_shapes_and_probabilities(spark, tiny_model):
    model, _ = tiny_model
    batch = spark.createDataFrame([(1, "a", "3"), (2, None, None), (3, "zzz", "x")],
                                  "row_id int, cat string, num string")
    valid = score.validate_rows(batch, {"cat": "categorical", "num": "numeric"}, keep=["row_id"])
    out = score.score_batch(model, valid).collect()
    assert len(out) == 3                                            # 3 rows in -> 3 rows out
    for r in out:                                                   # all-null row scores too
        assert r["predicted_tier"] is not None
        assert r["p_at_risk"] + r["p_developing"] + r["p_high_performer"] == pytest.approx(1.0, abs=1e-3)
    counts = score.tier_counts(score.score_batch(model, valid))
    assert counts.count() == 3


def test_model_roundtrip(spark, tiny_model, tmp_path):
    model, _ = tiny_model
    df = spark.createDataFrame([(1, "a", 2.0)], "row_id int, cat string, num double")
    path = str(tmp_path / "model")
    train.save_model(model, path, {"n_classes": 3})
    m2, meta = train.load_model(path)
    assert meta == {"n_classes": 3}
    assert model.transform(df).first()["prediction"] == m2.transform(df).first()["prediction"]


def test_dirty_csv_scan(spark, tmp_path):
    p = tmp_path / "dirty.csv"
    p.write_bytes(("﻿Advisor ID, Score ,PTG\n"
                   "A1,1,2\n"
                   "A2,3\n"
                   "A3,4,5,6\n"
                   "A4,N/A,\"1,5\"\n"
                   "A5,NULL,nan\n").encode("utf-8"))
    df = csv.read_dirty_csv(spark, str(p))
    assert df.columns == ["Advisor ID", "Score", "PTG"]
    got = {r["Advisor ID"]: (r["Score"], r["PTG"]) for r in df.collect()}
    assert set(got) == {"A1", "A2", "A4", "A5"}                   # over-long row skipped
    assert got["A2"] == ("3", None)                                # short row kept
    assert got["A4"] == (None, "1,5") and got["A5"] == (None, None)


def test_quoted_line_breaks_by_many_tasks(spark, tmp_path):
    import csv as plain
    import io
    import random
    r = random.Random(5)
    piece = lambda: r.choice(["plain", "a,b", 'say ""hi""', "two\nlines", "\n", "x\r\ny", "", "é中", "end\n"])
    for name in ("one.csv", "two.csv"):
        rows = []
        for i in range(3000):
            quoted = r.random() < 0.3 if name == "one.csv" or 1000 < i < 1100 else False
            f = ['"' + "".join(piece() for _ in range(3)) + '"' if quoted else "v%d" % i for _ in range(2)]
            rows.append(",".join([name[0] + str(i), *f][:2 if i % 50 == 0 else 3]) + (",extra" if i % 71 == 0 and i % 50 else ""))
        (tmp_path / name).write_text("\ufeffid,b ,c\n" + "\n".join(rows) + "\n", encoding="utf-8", newline="")
    want = []
    for name in ("one.csv", "two.csv"):
        text = (tmp_path / name).read_bytes().decode("utf-8-sig")
        for row in list(plain.reader(io.StringIO(text, newline="")))[1:]:
            if row and len(row) <= 3:
                row = [x if x != "" else None for x in row] + [None] * (3 - len(row))
                want.append(tuple(row))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = csv.read_dirty_csv(spark, str(tmp_path), multi_line=True)
        assert csv._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        key = lambda x: tuple((v is None, v) for v in x)
        assert df.columns == ["id", "b", "c"]
        assert sorted((tuple(x) for x in df.collect()), key=key) == sorted(want, key=key)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "three.csv").write_text("id,c,b\n1,2,3\n")
    with pytest.raises(ValueError, match="different headers"):
        csv.read_dirty_csv(spark, str(tmp_path), multi_line=True)


def test_csv_sink_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5)], "id int, s string, p double")
    path = str(tmp_path / "out")
    csv.write_csv(df, path, single_file=True)
    back = csv.read_dirty_csv(spark, path)
    assert [tuple(r) for r in back.collect()] == [("1", "a,b", "0.5")]


def test_model_schema_json_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "x", 0), (3.0, "y", 1)], "num double, cat string, flag int")
    prof = profile.column_profile(df, ["flag"], ["num"], ["cat"])
    path = str(tmp_path / "schema")
    artifacts.write_model_schema(prof, path)
    feats = artifacts.read_model_schema(spark, path)
    assert feats["num"] == {"type": "numeric", "range": [1.0, 3.0]}
    assert feats["cat"] == {"type": "categorical", "values": ["x", "y"]}
    assert artifacts.schema_types(feats)["flag"] == "binary"


def test_reports_and_exports(spark, tmp_path):
    row = spark.createDataFrame([("m", 0.5, 0.4)], "model string, accuracy double, macro_f1 double")
    long = artifacts.metrics_long(row)
    assert sorted((r["metric"], r["value"]) for r in long.collect()) == [("accuracy", 0.5), ("macro_f1", 0.4)]
    artifacts.write_report({"headline": long}, str(tmp_path / "rep"))
    c = spark.createDataFrame([(1, "a", 0, 0.1)], "row_id int, feature string, class int, contribution double")
    artifacts.export_explanations(c, c.select("feature"), str(tmp_path / "exp"), {"n": 1})
    assert os.path.isdir(tmp_path / "exp" / "contributions" / "class=0")


def _trims(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("trim(")


def test_values_are_trimmed_once(spark):
    """A trim by characters is most of the cost of validating a batch: one for each value."""
    from pyspark.sql import functions as F

    from cadre.operators import features, score
    kinds = {"n": "numeric", "b": "binary", "c": "categorical"}
    rows_ = [(1, " 1.5 ", "TRUE", " x "), (2, "1d", "yes", ""), (3, None, None, None), (4, "", "  ", " "), (5, "1e999", "0", "n/a"),
             (6, "-", "1.0", "y"), (7, "NaN", "2", "z")]
    df = spark.createDataFrame(rows_, "id int, n string, b string, c string").repartition(2)
    out = score.validate_rows(df, kinds, keep=["id"])
    assert _trims(out) == 3 and _trims(out.drop("errors")) == 3
    got = {r["id"]: tuple(r)[1:] for r in out.collect()}
    assert got[1] == (1.5, 1.0, "x", []) and got[3] == (None, None, None, []) and got[4] == (None, None, None, [])
    assert got[2] == (None, None, None, ["'n': expected a number, got '1d'", "'b': expected 0/1, got 'yes'"])
    assert got[5] == (float("inf"), 0.0, "n/a", []) and got[6][0] is None and got[7][0] is None
    share = features.numeric_share(df.withColumn("d", F.col("id") / F.when(F.col("id") > 2, 2)), ["n", "b", "d"])
    assert _trims(share) == 2
    assert {r["feature"]: round(r["numeric_share"] * 7) for r in share.collect()} == {"n": 2, "b": 3, "d": 5}
