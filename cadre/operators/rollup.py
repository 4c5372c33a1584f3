"""Long fact -> one row per person rollups (KPI fact and scorecard fact).

Plan shape (KPI rollup): a partial aggregation per ``(person, month)``
(map-side combine shrinks the fact by its metrics-per-month factor; the
shuffle key spreads a person who holds a third of all rows over months),
then one aggregation per person over at most one row per month.  "Latest
month" values are ``max_by(value, month)`` over those unique months, so no
window or self-join is needed.  Distinct metrics are counted from distinct
(person, metric) pairs.  Only hash aggregations touch the fact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.functions.numeric import as_double
from cadre.functions.text import email_key, fact_clean, safe_name, safe_name_py, utrim, valid_key, yes_no


def _prepare(facts: DataFrame, key_expr, measures: dict[str, str | None],
             passthrough: dict[str, str | None]) -> DataFrame:
    """Key normalised and filtered (F3), measures coerced to double (F6),
    blank texts null (F2)."""
    cols = [key_expr.alias("_k")]
    for name, src in measures.items():
        if src is not None and src in facts.columns:
            cols.append(as_double(facts, src).alias(name))
        else:
            cols.append(F.lit(None).cast("double").alias(name))
    for name, src in passthrough.items():
        if src is None or src not in facts.columns:
            cols.append(F.lit(None).cast("string").alias(name))
        elif isinstance(facts.schema[src].dataType, T.StringType):
            cols.append(fact_clean(F.col(src)).alias(name))
        else:
            cols.append(F.col(src).alias(name))
    return facts.select(*cols).filter(valid_key(F.col("_k")))


def kpi_facts(facts: DataFrame, key: str = "advisor", month: str | None = "month",
              metric: str = "metric", score: str | None = "score",
              ptg: str | None = "ptg", wptg: str | None = "wptg") -> DataFrame:
    """Normalised KPI fact: ``_k, _m, _metric, _score, _ptg, _wptg``."""
    key_expr = utrim(F.col(key).cast("string"))
    return _prepare(facts, key_expr, {"_score": score, "_ptg": ptg, "_wptg": wptg},
                    {"_m": month, "_metric": metric})


def kpi_rollup(facts: DataFrame, key: str = "advisor", month: str | None = "month",
               metric: str = "metric", score: str | None = "score",
               ptg: str | None = "ptg", wptg: str | None = "wptg",
               target: float = 100.0, zero_share_as_null: bool = True,
               out_key: str | None = None) -> DataFrame:
    """Per-person KPI rollup (A1-A6 with the latest-month self-join J4).

    Output: ``<key>, kpi_avg_score, kpi_avg_ptg, kpi_avg_wptg,
    kpi_latest_ptg, kpi_composite_wptg_latest, kpi_pct_above_target,
    n_kpi_months, n_kpi_metrics``.

    * averages skip nulls;
    * ``kpi_latest_ptg``: PTG of the latest month that has a PTG (month order
      is the column's natural order, so months should be ISO ``yyyy-MM``);
      several rows in that month -> the largest value;
    * ``kpi_composite_wptg_latest``: sum of weighted PTG over the person's
      latest month (latest taken over all rows); null when none has a value;
    * ``kpi_pct_above_target``: share of non-null PTG rows >= ``target``;
      null (not 0) when none qualify unless ``zero_share_as_null=False``;
    * ``n_kpi_months``: distinct months, null when there is none.
    """
    base = kpi_facts(facts, key, month, metric, score, ptg, wptg)
    per_month = base.groupBy("_k", "_m").agg(
        F.sum("_score").alias("s_score"), F.count("_score").alias("n_score"),
        F.sum("_ptg").alias("s_ptg"), F.count("_ptg").alias("n_ptg"),
        F.max("_ptg").alias("mx_ptg"),
        F.count_if(F.col("_ptg") >= F.lit(float(target))).alias("n_hit"),
        F.sum("_wptg").alias("s_wptg"), F.count("_wptg").alias("n_wptg"))

    def avg_of(s, n):
        return F.try_divide(F.sum(s), F.sum(n).cast("double"))

    n_ptg, n_hit = F.sum("n_ptg"), F.sum("n_hit")
    share = F.try_divide(n_hit.cast("double"), n_ptg.cast("double"))
    if zero_share_as_null:
        share = F.when(n_hit > 0, share)
    n_months = F.count("_m")
    # one row per month and person: max_by(x, month) is x of the latest month
    person = per_month.groupBy("_k").agg(
        avg_of("s_score", "n_score").alias("kpi_avg_score"),
        avg_of("s_ptg", "n_ptg").alias("kpi_avg_ptg"),
        avg_of("s_wptg", "n_wptg").alias("kpi_avg_wptg"),
        F.max_by("mx_ptg", F.when(F.col("n_ptg") > 0, F.col("_m"))).alias("kpi_latest_ptg"),
        F.max_by("s_wptg", F.col("_m")).alias("kpi_composite_wptg_latest"),
        share.alias("kpi_pct_above_target"),
        F.when(n_months > 0, n_months).alias("n_kpi_months"))
    metrics = base.where(F.col("_metric").isNotNull()).select("_k", "_metric").distinct() \
        .groupBy("_k").agg(F.count(F.lit(1)).alias("n_kpi_metrics"))
    out = person.join(metrics, "_k", "left").withColumn("n_kpi_metrics", F.coalesce("n_kpi_metrics", F.lit(0).cast("bigint")))
    return out.withColumnRenamed("_k", out_key or key)


def latest_period_rows(facts: DataFrame, key: str = "advisor", period: str = "month") -> DataFrame:
    """The rows of each person's latest period (periods compared in
    their natural order; rows without a period never qualify).

    The per-person maximum is an aggregation (map-side combined) joined back
    on ``(person, period)`` — a window partitioned by person would put a hot
    person's whole history in one task; this join only pairs the latest
    period's rows.
    """
    latest = facts.filter(F.col(period).isNotNull()).groupBy(key).agg(F.max(period).alias(period))
    return facts.join(latest, [key, period], "left_semi")


def top_metrics(facts: DataFrame, metric: str = "metric", n: int = 30, key: str | None = "advisor") -> DataFrame:
    """The ``n`` most frequent metrics (A7), ties broken by name; with
    ``key`` only rows with a valid key count.

    Output ``metric, n_rows, rank``; a global top-k: partial counts per
    metric, then a single ``limit`` over the (small) per-metric counts.
    """
    base = kpi_facts(facts, key, None, metric, None, None, None) if key in facts.columns else \
        facts.select(fact_clean(F.col(metric)).alias("_metric"))
    counts = (base.filter(F.col("_metric").isNotNull())
              .groupBy(F.col("_metric").alias("metric")).agg(F.count(F.lit(1)).alias("n_rows")))
    top = counts.orderBy(F.desc("n_rows"), F.asc("metric")).limit(n)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("n_rows"), F.asc("metric"))))


def top_metric_list(facts: DataFrame, metric: str = "metric", n: int = 30, key: str | None = "advisor") -> list[str]:
    """Top-N list on the driver (at most ``n`` strings) for an explicit pivot."""
    return [r["metric"] for r in top_metrics(facts, metric, n, key).orderBy("rank").collect()]


def metric_means_long(facts: DataFrame, key: str = "advisor", metric: str = "metric",
                      score: str | None = "score", ptg: str | None = "ptg",
                      wptg: str | None = "wptg", top: DataFrame | None = None,
                      n: int = 30) -> DataFrame:
    """Per person x top-N metric means in long form (A8 values, J8, P16).

    Rows are restricted to the top metrics by a semi join against the top
    list (a bounded ``n`` rows, broadcast); output ``<key>, metric,
    metric_safe, ptg_avg, wptg_avg, score_avg``.
    """
    base = kpi_facts(facts, key, None, metric, score, ptg, wptg)
    top = top if top is not None else top_metrics(facts, metric, n, key)
    keep = F.broadcast(top.select(F.col("metric").alias("_metric")))
    sub = base.join(keep, "_metric", "left_semi")
    return sub.groupBy(F.col("_k").alias(key), F.col("_metric").alias("metric")).agg(
        F.avg("_ptg").alias("ptg_avg"), F.avg("_wptg").alias("wptg_avg"),
        F.avg("_score").alias("score_avg"),
    ).withColumn("metric_safe", safe_name("metric"))


def metric_pivot(facts: DataFrame, key: str = "advisor", metric: str = "metric",
                 score: str | None = "score", ptg: str | None = "ptg",
                 wptg: str | None = "wptg", metrics: Sequence[str] | None = None,
                 n: int = 30, each=None) -> DataFrame:
    """Wide per-metric means ``{safe}_{ptg,wptg,score}_avg`` for the top-N.

    One row for every person with a valid key, also for those without any of
    the metrics.  Facts are first averaged per (person, listed metric), with all
    other metrics as one; only those few rows a person are laid out wide.  The
    metrics are an explicit list (by default the top-N, ``n`` strings on the
    driver), which caps the width.  Two metrics that collide after
    name-safing raise.  ``each`` changes the long means (say, rounds them)
    before they are laid out.
    """
    if metrics is None:
        metrics = top_metric_list(facts, metric, n, key)
    safe = [safe_name_py(m) for m in metrics]
    if len(set(safe)) != len(safe):
        raise ValueError(f"metric names collide after name-safing: {metrics}")
    base = kpi_facts(facts, key, None, metric, score, ptg, wptg)
    measures = ("_ptg", "_wptg", "_score")
    listed = F.when(F.col("_metric").isin(list(metrics)), F.col("_metric")) if metrics else F.lit(None).cast("string")
    cells = base.groupBy("_k", listed.alias("_metric")).agg(*[F.avg(v).alias(v) for v in measures])
    if each is not None:
        cells = each(cells)
    # one row for each person and metric: the largest value is the value
    means = [F.max(F.when(F.col("_metric") == m, F.col(v))).alias(f"{s}_{v[1:]}_avg")
             for m, s in zip(metrics, safe) for v in measures]
    if not means:
        return cells.select(F.col("_k").alias(key)).distinct()
    return cells.groupBy(F.col("_k").alias(key)).agg(*means)


def person_features(facts: DataFrame, key: str = "advisor", month: str | None = "month",
                    metric: str = "metric", score: str | None = "score", ptg: str | None = "ptg",
                    wptg: str | None = "wptg", metrics: Sequence[str] | None = None, n: int = 30, each=None) -> DataFrame:
    """One row per person with the dense rollup (A1-A6) and the wide
    per-metric means (A8); both are aggregated by person, so they meet
    without another exchange.  ``each`` changes both parts before that."""
    dense = kpi_rollup(facts, key, month, metric, score, ptg, wptg)
    return (each(dense) if each else dense).join(metric_pivot(facts, key, metric, score, ptg, wptg, metrics, n, each), key)


def metric_latest(facts: DataFrame, key: str = "advisor", month: str | None = "month",
                  metric: str = "metric", score: str | None = "score",
                  ptg: str | None = "ptg", wptg: str | None = "wptg") -> DataFrame:
    """Per person x metric mean and latest value of each measure (A9), long form.

    "Latest" is the last non-null value in month order (null months sort
    first) with the value itself as the final tie-break — file order is not
    a Spark concept.  Output ``<key>, metric, {score,ptg,wptg}_{avg,latest},
    n_kpi_months`` where ``n_kpi_months`` counts the person's distinct
    non-empty months (0 when none).
    """
    base = kpi_facts(facts, key, month, metric, score, ptg, wptg)
    names = ("score", "ptg", "wptg")
    # rows collapse to one per (person, metric, month) first, in a hash aggregation
    month = F.coalesce(F.col("_m"), F.lit(""))
    per_month = base.groupBy("_k", "_metric", month.alias("_m")).agg(
        *[f(F.col(f"_{x}")).alias(f"{p}_{x}") for x in names for p, f in (("s", F.sum), ("n", F.count), ("mx", F.max))])
    aggs = []
    for x in names:
        aggs.append(F.try_divide(F.sum(f"s_{x}"), F.sum(f"n_{x}").cast("double")).alias(f"{x}_avg"))
        # several values in the latest month: the largest
        aggs.append(F.max_by(f"mx_{x}", F.when(F.col(f"n_{x}") > 0, F.col("_m"))).alias(f"{x}_latest"))
    per_metric = per_month.groupBy("_k", "_metric").agg(*aggs)
    months = (base.where(F.col("_m").isNotNull()).select("_k", "_m").distinct()
              .groupBy("_k").agg(F.count(F.lit(1)).alias("n_kpi_months")))
    out = per_metric.join(months, "_k", "left").withColumn(
        "n_kpi_months", F.coalesce(F.col("n_kpi_months"), F.lit(0).cast("bigint")))
    return out.withColumnRenamed("_k", key).withColumnRenamed("_metric", "metric")


def scorecard_rollup(facts: DataFrame, email: str = "email", order: Sequence[str] = ("ts",),
                     ptg: str | None = "ptg", rank: str | None = "rank",
                     quartile: str | None = "quartile", consec: str | None = "consec_failing",
                     met: str | None = "met_count", fail: str | None = "fail_count",
                     kpi_passed: str | None = "kpi_passed",
                     out_key: str = "email_lower") -> DataFrame:
    """Per-email scorecard rollup.

    ``sc_latest_ptg`` is the last non-null PTG by the explicit ``order``
    columns (file order is not reproducible in Spark).  Sums are null when a
    person has no value; ``sc_n_records`` counts rows with null PTG too.
    One shuffle by email with map-side partial aggregation.
    """
    order = [o for o in order if o in facts.columns]
    passthrough = {f"_o{i}": o for i, o in enumerate(order)}
    passthrough["_kp"] = kpi_passed
    base = _prepare(facts, email_key(F.col(email)),
                    {"_ptg": ptg, "_rank": rank, "_q": quartile, "_consec": consec,
                     "_met": met, "_fail": fail}, passthrough)
    ord_struct = F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col("_ptg"))
    passed = yes_no(F.col("_kp"))
    return base.groupBy(F.col("_k").alias(out_key)).agg(
        F.avg("_ptg").alias("sc_avg_ptg"),
        F.max_by("_ptg", F.when(F.col("_ptg").isNotNull(), ord_struct)).alias("sc_latest_ptg"),
        F.avg("_rank").alias("sc_avg_rank"),
        F.min("_rank").alias("sc_best_rank"),
        F.avg("_q").alias("sc_avg_quartile"),
        F.max("_consec").alias("sc_max_consec_failing"),
        F.sum("_met").alias("sc_total_met"),
        F.sum("_fail").alias("sc_total_fail"),
        F.avg(passed.cast("double")).alias("sc_pct_kpi_passed"),
        F.count(F.lit(1)).alias("sc_n_records"),
    )


def period_aligned_rollup(facts: DataFrame, labels: DataFrame, key: str = "advisor",
                          month: str = "month", label_key: str | None = None,
                          label_month: str = "eval_month", months: int = 3,
                          ptg: str | None = "ptg", wptg: str | None = "wptg") -> DataFrame:
    """For each label row (person, evaluation month ``yyyy-MM``) roll up
    only the facts of the ``months`` months ending at that month.

    A range join would pair every label with every fact of the person (a
    hot person -> one exploding task).  Instead facts are pre-aggregated per
    (person, month), each label is expanded to its ``months`` months, and
    the two meet on an equi-join of (person, month).
    """
    label_key = label_key or key
    base = kpi_facts(facts, key, month, month, None, ptg, wptg)
    per_month = base.groupBy("_k", "_m").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_ptg").alias("s_ptg"), F.count("_ptg").alias("n_ptg"),
        F.sum("_wptg").alias("s_wptg"))
    first_day = F.to_date(F.concat(F.col("_lm"), F.lit("-01")))
    # keys trimmed as the facts' are, and each (person, month) once
    lab = labels.select(utrim(F.col(label_key).cast("string")).alias("_k"), F.col(label_month).alias("_lm")).distinct() \
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))) \
        .withColumn("_m", F.date_format(F.add_months(first_day, -F.col("_i")), "yyyy-MM"))
    j = lab.join(per_month, ["_k", "_m"], "left")
    return j.groupBy(F.col("_k").alias(key), F.col("_lm").alias(label_month)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.try_divide(F.sum("s_ptg"), F.sum("n_ptg").cast("double")).alias("avg_ptg"),
        F.sum("s_wptg").alias("sum_wptg"))
