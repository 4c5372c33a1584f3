"""All evaluation tables from one scan of the predictions.

A row of the prediction table is exploded once: into its (actual, predicted)
pair and into one (head, score, positive) entry per binary head, a head being a
class or a list of classes whose probabilities are added.  One aggregation
leaves the pair counts and the counts per (head, distinct score); it is written
out, and everything else is read from it: accuracy and the class report from
the pairs, calibration from the scores' bins, and the AUC, precision/recall
sweep and best threshold of every head from one bucketed running sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadre.operators import metrics
from cadre.operators.windows import running_sums
from cadre.session import cut_lineage


class Evaluation:
    """Counts of one prediction table and the reports read from them."""

    def __init__(self, pred: DataFrame, label: str = "label", prediction: str = "prediction",
                 prob_cols: Sequence[str] = ("p0", "p1", "p2"), heads: Mapping[str, Sequence[int]] | None = None):
        self.n_classes = len(prob_cols)
        self.class_heads = [str(c) for c in range(self.n_classes)]
        self.heads = {**{h: [c] for c, h in enumerate(self.class_heads)}, **{k: list(v) for k, v in (heads or {}).items()}}
        y = F.col(f"`{label}`").cast("int")
        score = lambda cs: sum((F.col(f"`{prob_cols[c]}`").cast("double") for c in cs), F.lit(0.0))
        none = lambda kind: F.lit(None).cast(kind)
        entries = [F.struct(none("string").alias("head"), none("double").alias("score"), y.alias("actual"),
                            F.col(f"`{prediction}`").cast("int").alias("predicted"), F.lit(0).alias("pos"))]
        entries += [F.struct(F.lit(h).alias("head"), score(cs).alias("score"), none("int").alias("actual"),
                             none("int").alias("predicted"), F.coalesce(y.isin(cs).cast("int"), F.lit(0)).alias("pos"))
                    for h, cs in self.heads.items()]
        counts = (pred.select(F.inline(F.array(*entries))).groupBy("head", "score", "actual", "predicted")
                  .agg(F.sum("pos").alias("n_pos"), F.count(F.lit(1)).alias("n")))
        self.counts = cut_lineage(counts)
        self._curve: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """Rows (actual, predicted, n)."""
        return self.counts.where("head IS NULL").select("actual", "predicted", "n")

    def scores(self) -> DataFrame:
        """Rows (head, score, n_pos, n), one per distinct score of a head."""
        return self.counts.where("head IS NOT NULL AND score IS NOT NULL").select("head", "score", "n_pos", "n")

    def curve(self) -> DataFrame:
        """V7/V9: per head and threshold t (each distinct score) precision,
        recall and F1 of predicting positive when score >= t."""
        if self._curve is None:
            run = running_sums(self.scores(), ["head"], "score", ["n_pos", "n"], descending=True)
            totals = self.scores().groupBy("head").agg(F.sum("n_pos").alias("P"), F.sum("n").alias("T"))
            # one row per head
            run = run.join(F.broadcast(totals), "head")
            precision = F.col("cum_n_pos") / F.col("cum_n").cast("double")
            recall = F.when(F.col("P") > 0, F.col("cum_n_pos") / F.col("P").cast("double")).otherwise(F.lit(1.0))
            run = run.withColumns({"precision": precision, "recall": recall})
            f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                        / (F.col("precision") + F.col("recall") + F.lit(metrics.F1_EPS))).otherwise(F.lit(0.0))
            self._curve = cut_lineage(run.withColumn("f1", f1))
        return self._curve

    def heads_summary(self) -> DataFrame:
        """V3/V7/V8: per head its rows, positives, AUC and the threshold with
        the best F1 (the lowest one on ties)."""
        neg = F.col("n") - F.col("n_pos")
        below = (F.col("T") - F.col("P")) - (F.col("cum_n") - F.col("cum_n_pos"))
        best = F.max_by(F.struct("score", "precision", "recall", "f1"), F.struct("f1", -F.col("score")))
        out = self.curve().groupBy("head").agg(
            F.sum(F.col("n_pos") * (below + 0.5 * neg)).alias("u"), F.max("P").alias("n_positive"), F.max("T").alias("n"), best.alias("b"))
        pairs = F.col("n_positive") * (F.col("n") - F.col("n_positive"))
        return out.select("head", "n", "n_positive", F.when(pairs > 0, F.col("u") / pairs.cast("double")).alias("auc"),
                          F.col("b.score").alias("best_threshold"), F.col("b.precision").alias("precision_at_best"),
                          F.col("b.recall").alias("recall_at_best"), F.col("b.f1").alias("best_f1"))

    def calibration(self, min_positives: int = 10) -> DataFrame:
        """V6: per class ten right-closed bins, from the distinct scores."""
        b = sum((F.col("score") > F.lit(e)).cast("int") for e in metrics.CAL_EDGES)
        per = self.scores().where(F.col("head").isin(self.class_heads)).groupBy("head", b.alias("bin")).agg(
            F.sum("n").alias("n"), F.sum(F.col("score") * F.col("n")).alias("s"), F.sum("n_pos").alias("n_pos"))
        enough = per.groupBy("head").agg(F.sum("n_pos").alias("P")).where(F.col("P") >= min_positives).select("head")
        return per.join(F.broadcast(enough), "head").select(
            "head", "bin", "n", (F.col("s") / F.col("n")).alias("mean_predicted"), (F.col("n_pos") / F.col("n")).alias("fraction_positive"))

    def class_report(self) -> DataFrame:
        """V2/V4/V5: the class report, from the pair counts."""
        return metrics.class_report_of(self.pairs())

    def headline(self, baseline: float | None = None) -> DataFrame:
        """V1: rows, accuracy, majority baseline and lift."""
        return metrics.accuracy_of(self.pairs(), baseline)

    def report(self, baseline: float | None = None) -> DataFrame:
        """Every table as rows (section, item, metric, value)."""
        def long(df: DataFrame, section: str, item) -> DataFrame:
            vals = [c for c, t in df.dtypes if t != "string" and c not in ("bin",)]
            pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in vals])
            return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(pairs))

        summary = cut_lineage(self.heads_summary())
        # like a failed multiclass AUC: null unless every class has positives and negatives
        macro = summary.where(F.col("head").isin(self.class_heads)).agg(
            F.when(F.count("auc") == self.n_classes, F.avg("auc")).alias("macro_auc"))
        confusion = self.pairs().select(F.concat_ws(">", "actual", "predicted").alias("pair"), "n")
        parts = [long(self.headline(baseline), "headline", F.lit("all")), long(macro, "headline", F.lit("all")),
                 long(self.class_report(), "class", F.col("class")), long(confusion, "confusion", F.col("pair")),
                 long(summary, "head", F.col("head")),
                 long(self.calibration(), "calibration", F.concat_ws(":", "head", F.col("bin").cast("string")))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
