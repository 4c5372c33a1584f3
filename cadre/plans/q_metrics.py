"""Registered evaluation queries over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadre.operators import metrics, split
from cadre.plans import sql_views as V
from cadre.plans import views
from cadre.plans.catalog import register, rounded

P = ["p0", "p1", "p2"]
R = V.r6


def _pred(spark, d):
    return views.pred(spark, d)


@register("accuracy_lift", f"""
WITH {V.PRED},
c AS (SELECT label, count(*) AS n FROM pred GROUP BY label)
SELECT count(*) AS n,
       {R('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       {R('(SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM c)')} AS baseline_accuracy,
       {R('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) - (SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM c)')} AS lift
FROM pred
""")
def accuracy_lift(spark, d):
    """V1: accuracy, majority baseline and lift."""
    return rounded(metrics.accuracy_report(_pred(spark, d)))


_PC = "pc AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM pred GROUP BY 1, 2)"
_PER = f"""{_PC},
cls AS (SELECT actual AS c FROM pc UNION SELECT predicted FROM pc),
per0 AS (SELECT cls.c,
               coalesce((SELECT sum(n) FROM pc WHERE actual = cls.c), 0) AS support,
               coalesce((SELECT sum(n) FROM pc WHERE predicted = cls.c), 0) AS n_pred,
               coalesce((SELECT sum(n) FROM pc WHERE actual = cls.c AND predicted = cls.c), 0) AS tp
        FROM cls),
per1 AS (SELECT c, support,
               CASE WHEN n_pred > 0 THEN tp / CAST(n_pred AS DOUBLE) ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0.0 END AS recall FROM per0),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                       ELSE 0.0 END AS f1 FROM per1)"""


@register("per_class_report", f"""
WITH {V.PRED}, {_PER}
SELECT CAST(c AS STRING) AS class, {R('precision')} AS precision, {R('recall')} AS recall,
       {R('f1')} AS f1, CAST(support AS BIGINT) AS support FROM per
UNION ALL
SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM per
UNION ALL
SELECT 'weighted avg', {R('sum(precision * support) / CAST(sum(support) AS DOUBLE)')},
       {R('sum(recall * support) / CAST(sum(support) AS DOUBLE)')},
       {R('sum(f1 * support) / CAST(sum(support) AS DOUBLE)')}, CAST(sum(support) AS BIGINT) FROM per
""")
def per_class_report(spark, d):
    """V4: per-class precision/recall/F1/support + macro and weighted rows."""
    return rounded(metrics.class_report(_pred(spark, d)))


@register("macro_f1", f"""
WITH {V.PRED}, {_PER}
SELECT {R('avg(f1)')} AS macro_f1 FROM per
""")
def macro_f1(spark, d):
    """V2: macro F1 over classes in y ∪ ŷ (zero division -> 0)."""
    return rounded(metrics.macro_f1(_pred(spark, d)))


@register("confusion", f"""
WITH {V.PRED}, {_PC},
k AS (SELECT greatest(max(actual), max(predicted)) + 1 AS k FROM pc),
g AS (SELECT a.actual, p.predicted FROM k,
      (SELECT unnest(range(0, (SELECT k FROM k))) AS actual) a,
      (SELECT unnest(range(0, (SELECT k FROM k))) AS predicted) p)
SELECT CAST(g.actual AS INTEGER) AS actual, CAST(g.predicted AS INTEGER) AS predicted,
       CAST(coalesce(pc.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN pc ON g.actual = pc.actual AND g.predicted = pc.predicted
""")
def confusion(spark, d):
    """V5: confusion counts over the full label grid, empty cells as 0."""
    return metrics.confusion(_pred(spark, d))


def _long_sql():
    return " UNION ALL ".join(
        f"SELECT label, {i} AS class, {p} AS score FROM pred" for i, p in enumerate(P))


@register("auc_ovr", f"""
WITH {V.PRED},
l AS ({_long_sql()}),
g AS (SELECT class, score, sum(CASE WHEN label = class THEN 1 ELSE 0 END) AS npos,
             sum(CASE WHEN label = class THEN 0 ELSE 1 END) AS nneg FROM l GROUP BY class, score),
c AS (SELECT *, sum(nneg) OVER (PARTITION BY class ORDER BY score
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g),
per AS (SELECT class, sum(npos * (cum - nneg + 0.5 * nneg)) AS u, sum(npos) AS P, sum(nneg) AS N
        FROM c GROUP BY class),
a AS (SELECT class, P, CASE WHEN P > 0 AND N > 0 THEN u / CAST(P * N AS DOUBLE) END AS auc FROM per)
SELECT CAST(class AS STRING) AS class, {R('auc')} AS auc FROM a WHERE P > 0
UNION ALL
SELECT 'macro', {R('CASE WHEN count(CASE WHEN P > 0 THEN 1 END) = 3 THEN avg(CASE WHEN P > 0 THEN auc END) END')}
FROM a
""")
def auc_ovr(spark, d):
    """V3: one-vs-rest AUC per class and the macro average."""
    return rounded(metrics.auc_ovr(_pred(spark, d), "label", P))


_EDGES_SQL = " + ".join(f"CAST(score > CAST({e!r} AS DOUBLE) AS INTEGER)" for e in metrics.CAL_EDGES)


@register("calibration", f"""
WITH {V.PRED},
l AS ({_long_sql()}),
b AS (SELECT class, {_EDGES_SQL} AS bin, score,
             CASE WHEN label = class THEN 1.0 ELSE 0.0 END AS pos FROM l),
pb AS (SELECT class, bin, count(*) AS n, avg(score) AS mp, avg(pos) AS fp, sum(pos) AS np
       FROM b GROUP BY class, bin),
ok AS (SELECT class FROM pb GROUP BY class HAVING sum(np) >= 10)
SELECT pb.class, CAST(pb.bin AS INTEGER) AS bin, pb.n, {R('mp')} AS mean_predicted,
       {R('fp')} AS fraction_positive
FROM pb JOIN ok ON pb.class = ok.class
""")
def calibration(spark, d):
    """V6: calibration bins per class (right-closed, 10 equal-width bins)."""
    return rounded(metrics.calibration(_pred(spark, d), "label", P))


def _curve_sql(score: str, pos: str) -> str:
    return f"""h AS (SELECT {score} AS s, CASE WHEN {pos} THEN 1 ELSE 0 END AS y FROM pred),
g AS (SELECT s AS threshold, sum(y) AS tp_at, count(*) AS n_at FROM h GROUP BY s),
c AS (SELECT threshold,
             sum(tp_at) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(n_at) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
             sum(tp_at) OVER () AS ptot FROM g),
pr AS (SELECT threshold, tp / CAST(pp AS DOUBLE) AS precision,
              CASE WHEN ptot > 0 THEN tp / CAST(ptot AS DOUBLE) ELSE 1.0 END AS recall FROM c),
cv AS (SELECT *, CASE WHEN precision + recall > 0
                      THEN 2 * precision * recall / (precision + recall + CAST(1e-9 AS DOUBLE)) ELSE 0.0 END AS f1
       FROM pr)"""


def _curve_out():
    return f"SELECT {R('threshold')} AS threshold, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1 FROM cv"


@register("threshold_sweep", f"""
WITH {V.PRED}, {_curve_sql('p0', 'label = 0')}
{_curve_out()}
""")
def threshold_sweep(spark, d):
    """V7/V9: precision, recall, F1 at every threshold of the at-risk head
    (P(class 0))."""
    s = metrics.head_scores(_pred(spark, d), "label", P, [0])
    return rounded(metrics.threshold_curve(s, "score", "positive"))


@register("composite_head", f"""
WITH {V.PRED}, {_curve_sql('p1 + p2', 'label IN (1, 2)')}
{_curve_out()}
""")
def composite_head(spark, d):
    """V8: sweep of a composite head — P(class 1) + P(class 2) against
    membership of either class."""
    s = metrics.head_scores(_pred(spark, d), "label", P, [1, 2])
    return rounded(metrics.threshold_curve(s, "score", "positive"))


def _best_sql(head: str, score: str, pos: str) -> str:
    return f"""(WITH {_curve_sql(score, pos)}
   SELECT '{head}' AS head, {R('threshold')} AS best_threshold, {R('f1')} AS best_f1,
          {R('precision')} AS precision_at_best, {R('recall')} AS recall_at_best
   FROM cv ORDER BY f1 DESC, threshold ASC LIMIT 1)"""


@register("best_threshold", f"""
WITH {V.PRED}
SELECT * FROM {_best_sql('at_risk', 'p0', 'label = 0')}
UNION ALL
SELECT * FROM {_best_sql('composite', 'p1 + p2', 'label IN (1, 2)')}
""")
def best_threshold(spark, d):
    """V7: best-F1 threshold (lowest on ties) of the at-risk head and the
    composite head."""
    p = _pred(spark, d)
    out = None
    for head, classes in (("at_risk", [0]), ("composite", [1, 2])):
        b = metrics.best_threshold(metrics.threshold_curve(
            metrics.head_scores(p, "label", P, classes), "score", "positive"))
        b = b.select(F.lit(head).alias("head"), "*")
        out = b if out is None else out.unionByName(b)
    return rounded(out)


_SPLIT_PRED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {split.hash_order_sql('row_id')}, row_id) AS rk,
                  count(*) OVER (PARTITION BY label) AS n FROM pred),
s AS (SELECT *, CASE WHEN rk <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM r)"""


@register("class_weights", f"""
WITH {V.PRED}, {_SPLIT_PRED},
c AS (SELECT label AS class, count(*) AS n FROM s WHERE split = 'train' GROUP BY label)
SELECT class, n, {R('sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE)')} AS weight FROM c
""")
def class_weights(spark, d):
    """L3: balanced class weights n / (k * n_c) on the training split."""
    s = split.stratified_split(_pred(spark, d), "label", "row_id", 0.2, None)
    return rounded(metrics.class_weights(s.filter(F.col("split") == "train"), "label"))


@register("majority_baseline", f"""
WITH {V.PRED}, {_SPLIT_PRED},
c AS (SELECT label, count(*) AS n FROM s WHERE split = 'train' GROUP BY label),
m AS (SELECT label AS majority_class, (SELECT sum(n) FROM c) AS n_train FROM c ORDER BY n DESC, label LIMIT 1)
SELECT m.majority_class, CAST(m.n_train AS BIGINT) AS n_train, count(*) AS n_test,
       {R('avg(CASE WHEN s.label = m.majority_class THEN 1.0 ELSE 0.0 END)')} AS baseline_accuracy
FROM s, m WHERE s.split = 'test' GROUP BY m.majority_class, m.n_train
""")
def majority_baseline(spark, d):
    """L1: majority class of the training split and its test accuracy."""
    s = split.stratified_split(_pred(spark, d), "label", "row_id", 0.2, None)
    return rounded(metrics.majority_baseline(s.filter(F.col("split") == "train"),
                                             s.filter(F.col("split") == "test"), "label"))
