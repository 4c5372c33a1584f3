"""Evaluation of multiclass predictions as DataFrame aggregations (V1-V9, L1, L3).

Input is a prediction table: ``label`` (int), ``prediction`` (int) and one
probability column per class (``prob_cols[c]`` holds P(class = c)).  Every
metric is an aggregation over that table; curves (AUC, precision/recall
sweeps) first collapse to distinct scores per class and then use the
bucketed running sums of :mod:`cadre.operators.windows`, so no class is
ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadre.operators.windows import running_sums
from cadre.session import cut_lineage

# Inner bin edges of a 10-bin uniform calibration curve: i * 0.1 for i = 1..9
# (the same doubles numpy's linspace(0, 1, 11) produces).
CAL_EDGES = [i * 0.1 for i in range(1, 10)]
F1_EPS = 1e-9


def _q(c: str):
    return F.col(f"`{c}`")


def accuracy_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                    baseline: float | None = None) -> DataFrame:
    """V1: ``n, accuracy, baseline_accuracy, lift``; the baseline defaults to
    the majority-class share of the labels."""
    return accuracy_of(pair_counts(pred, label, prediction), baseline)


def accuracy_of(pairs: DataFrame, baseline: float | None = None) -> DataFrame:
    """:func:`accuracy_report` from pair counts."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    known = F.sum(F.when(F.col("actual").isNotNull() & F.col("predicted").isNotNull(), F.col("n")))
    # k^2 pair counts, then k class rows, then one row: no join
    per = pairs.groupBy("actual").agg(
        F.sum("n").alias("c"), hit.alias("hit"), known.alias("known"))
    base = F.max("c") / F.sum("c").cast("double") if baseline is None else F.lit(float(baseline))
    out = per.agg(F.sum("c").alias("n"), F.try_divide(F.sum("hit"), F.sum("known").cast("double")).alias("accuracy"),
                  base.alias("baseline_accuracy"))
    return out.withColumn("lift", F.col("accuracy") - F.col("baseline_accuracy"))


def pair_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (actual, predicted) pair — the k^2 table every
    classification metric derives from."""
    return pred.groupBy(_q(label).cast("int").alias("actual"), _q(prediction).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction",
              n_classes: int | None = None) -> DataFrame:
    """V5: full k x k grid (zeros included), k = max(classes seen, n_classes).

    The grid is generated from the one-row class count with ``sequence``
    + ``explode`` (no cross join) and left-joined to the pair counts.
    """
    pc = pair_counts(pred, label, prediction)
    k_expr = F.greatest(F.max("actual"), F.max("predicted")) + 1
    if n_classes is not None:
        k_expr = F.greatest(k_expr, F.lit(n_classes))
    k = pc.agg(k_expr.alias("k"))
    grid = (k.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("actual"), "k")
            .select("actual", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("predicted")))
    return (grid.join(pc, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V4: precision, recall, F1, support per class over classes in y ∪ ŷ
    (zero division -> 0), plus 'macro avg' and 'weighted avg' rows."""
    return class_report_of(pair_counts(pred, label, prediction))


def class_report_of(pc: DataFrame) -> DataFrame:
    """:func:`class_report` from pair counts."""
    classes = pc.select(F.explode(F.array("actual", "predicted")).alias("cls")).distinct()
    sup = pc.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    prd = pc.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    tp = pc.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    per = (classes.join(sup, "cls", "left").join(prd, "cls", "left").join(tp, "cls", "left")
           .fillna(0, ["support", "n_pred", "tp"]))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred").cast("double")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support").cast("double")).otherwise(F.lit(0.0))
    per = per.select("cls", p.alias("precision"), r.alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    per = per.withColumn("f1", f1)
    rows = per.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                      F.col("support").cast("bigint").alias("support"))
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    tot.cast("bigint").alias("support"))
    wavg = per.agg(F.lit("weighted avg").alias("class"),
                   *[F.try_divide(F.sum(F.col(m) * F.col("support")), tot.cast("double")).alias(m)
                     for m in ("precision", "recall", "f1")],
                   tot.cast("bigint").alias("support"))
    return rows.unionByName(macro).unionByName(wavg)


def macro_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V2: unweighted mean of per-class F1 over y ∪ ŷ (not MLlib's weighted F1)."""
    rep = class_report(pred, label, prediction)
    return rep.filter(F.col("class") == "macro avg").select(F.col("f1").alias("macro_f1"))


def _long_scores(pred: DataFrame, label: str, prob_cols: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(prob_cols))
    return pred.selectExpr(f"CAST(`{label}` AS INT) AS _y",
                           f"stack({len(prob_cols)}, {pairs}) AS (class, score)")


def auc_ovr(pred: DataFrame, label: str = "label", prob_cols: Sequence[str] = ("p0", "p1", "p2"),
            **kw) -> DataFrame:
    """V3: one-vs-rest ROC AUC per class and their macro mean.

    Per class, AUC = P(score_pos > score_neg) + 0.5 P(tie) from counts per
    distinct score (Mann-Whitney).  Macro is null — like the reference's
    failure path — when y holds a single class or a class count that does
    not match the probability columns.
    """
    long = _long_scores(pred, label, prob_cols).withColumn(
        "_pos", (F.col("_y") == F.col("class")).cast("long"))
    g = long.groupBy("class", "score").agg(F.sum("_pos").alias("npos"),
                                           (F.count(F.lit(1)) - F.sum("_pos")).alias("nneg"))
    g = cut_lineage(g)
    cum = running_sums(g, ["class"], "score", ["nneg"], **kw)
    per = cum.groupBy("class").agg(
        F.sum(F.col("npos") * (F.col("cum_nneg") - F.col("nneg") + 0.5 * F.col("nneg"))).alias("u"),
        F.sum("npos").alias("P"), F.sum("nneg").alias("N"))
    per = per.withColumn("auc", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                       F.col("u") / (F.col("P") * F.col("N")).cast("double")))
    rows = per.filter(F.col("P") > 0).select(F.col("class").cast("string").alias("class"), "auc")
    k = len(prob_cols)
    macro = per.agg(F.when((F.count_if(F.col("P") > 0) == k) & (F.lit(k) >= 2),
                           F.avg(F.when(F.col("P") > 0, F.col("auc")))).alias("auc")) \
        .select(F.lit("macro").alias("class"), "auc")
    return rows.unionByName(macro)


def calibration(pred: DataFrame, label: str = "label", prob_cols: Sequence[str] = ("p0", "p1", "p2"),
                min_positives: int = 10) -> DataFrame:
    """V6: 10 equal-width right-closed bins per class; mean predicted and
    fraction positive; empty bins absent; classes with fewer than
    ``min_positives`` positives skipped."""
    long = _long_scores(pred, label, prob_cols).withColumn(
        "_pos", (F.col("_y") == F.col("class")).cast("double"))
    b = sum((F.col("score") > F.lit(e)).cast("int") for e in CAL_EDGES)
    binned = long.withColumn("bin", b)
    per_bin = binned.groupBy("class", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_predicted"),
        F.avg("_pos").alias("fraction_positive"), F.sum("_pos").alias("_np"))
    w = Window.partitionBy("class")
    return (per_bin.withColumn("_cls_pos", F.sum("_np").over(w))
            .filter(F.col("_cls_pos") >= min_positives).drop("_np", "_cls_pos"))


def threshold_curve(scored: DataFrame, score: str, positive: str, **kw) -> DataFrame:
    """V7: precision / recall / F1 at every distinct threshold t, predicting
    positive when score >= t.  F1 = 2PR/(P+R+1e-9), 0 when P+R = 0;
    recall is 1 when there are no positives."""
    g = scored.groupBy(_q(score).cast("double").alias("threshold")).agg(
        F.sum(_q(positive).cast("long")).alias("tp_at"), F.count(F.lit(1)).alias("n_at"))
    g = cut_lineage(g)
    n_positive = g.agg(F.sum("tp_at")).first()[0] or 0
    c = running_sums(g, [], "threshold", ["tp_at", "n_at"], descending=True, **kw)
    prec = F.col("cum_tp_at") / F.col("cum_n_at").cast("double")
    rec = F.col("cum_tp_at") / F.lit(float(n_positive)) if n_positive else F.lit(1.0)
    c = c.select("threshold", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(F1_EPS))
                ).otherwise(F.lit(0.0))
    return c.withColumn("f1", f1)


def best_threshold(curve: DataFrame) -> DataFrame:
    """V7: the threshold with the best F1; the lowest threshold on ties."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                    F.struct(F.col("f1"), -F.col("threshold")))
    return curve.agg(best.alias("b")).select(
        F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("best_f1"),
        F.col("b.precision").alias("precision_at_best"), F.col("b.recall").alias("recall_at_best"))


def head_scores(pred: DataFrame, label: str, prob_cols: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """V8/V9: a binary head — score = sum of the listed class probabilities,
    positive = label in those classes."""
    score = sum((_q(prob_cols[c]).cast("double") for c in classes), F.lit(0.0))
    return pred.select(score.alias("score"), _q(label).isin(list(classes)).cast("int").alias("positive"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """L3: balanced weight n / (k * n_c) per class."""
    counts = df.groupBy(_q(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    return counts.withColumn(
        "weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")).cast("double"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """L1: most frequent training class (smallest label on ties) and its
    accuracy on the test rows."""
    rows = train.select(_q(label).alias("cls"), F.lit(1).alias("a"), F.lit(0).alias("b")) \
        .unionByName(test.select(_q(label).alias("cls"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = rows.groupBy("cls").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"))
    first = F.struct(F.col("n_train"), -F.col("cls"))
    out = per.agg(F.max_by("cls", first).alias("majority_class"), F.sum("n_train").alias("n_train"),
                  F.sum("n_test").alias("n_test"), F.max_by("n_test", first).alias("_hit"))
    return out.select("majority_class", "n_train", "n_test",
                      F.try_divide(F.col("_hit"), F.col("n_test").cast("double")).alias("baseline_accuracy"))
