"""Registered rollup queries (KPI fact and scorecard fact)."""

from __future__ import annotations

from cadre.operators import rollup
from cadre.plans import sql_views as V
from cadre.plans import views
from cadre.plans.catalog import register, rounded

KEY_OK = "advisor IS NOT NULL AND advisor <> '' AND lower(advisor) <> 'nan'"


@register("kpi_rollup", f"""
WITH {V.KPI},
k AS (SELECT * FROM kpi WHERE {KEY_OK}),
lm AS (SELECT advisor, max(month) AS latest_m FROM k WHERE month IS NOT NULL GROUP BY advisor),
lp AS (SELECT advisor, max(month) AS lp_m FROM k
       WHERE month IS NOT NULL AND ptg IS NOT NULL GROUP BY advisor)
SELECT k.advisor,
       (floor(floor((avg(score)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS kpi_avg_score,
       (floor(floor((avg(ptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS kpi_avg_ptg,
       (floor(floor((avg(wptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS kpi_avg_wptg,
       (floor(floor((max(CASE WHEN k.month = lp.lp_m THEN ptg END)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS kpi_latest_ptg,
       (floor(floor((sum(CASE WHEN k.month = lm.latest_m THEN wptg END)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS kpi_composite_wptg_latest,
       (floor(floor((CASE WHEN count(CASE WHEN ptg >= 100 THEN 1 END) > 0
             THEN count(CASE WHEN ptg >= 100 THEN 1 END) / CAST(count(ptg) AS DOUBLE) END) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6)
         AS kpi_pct_above_target,
       CASE WHEN count(DISTINCT k.month) > 0 THEN count(DISTINCT k.month) END AS n_kpi_months,
       count(DISTINCT metric) AS n_kpi_metrics
FROM k LEFT JOIN lm ON k.advisor = lm.advisor LEFT JOIN lp ON k.advisor = lp.advisor
GROUP BY k.advisor
""")
def kpi_rollup(spark, d):
    """Flagship: per-advisor KPI rollup (A1-A6, J4) over lineitem x part."""
    return rounded(rollup.kpi_rollup(views.kpi(spark, d)))


@register("kpi_top_metrics", f"""
WITH {V.KPI},
c AS (SELECT metric, count(*) AS n_rows FROM kpi WHERE metric IS NOT NULL AND {KEY_OK} GROUP BY metric)
SELECT metric, n_rows, CAST(row_number() OVER (ORDER BY n_rows DESC, metric) AS INTEGER) AS rank
FROM c ORDER BY n_rows DESC, metric LIMIT 30
""")
def kpi_top_metrics(spark, d):
    """Top-30 most frequent metrics (A7), ties by name."""
    return rollup.top_metrics(views.kpi(spark, d), n=30)


@register("kpi_metric_pivot", f"""
WITH {V.KPI},
c AS (SELECT metric, count(*) AS n_rows FROM kpi WHERE metric IS NOT NULL AND {KEY_OK} GROUP BY metric),
top AS (SELECT metric FROM c ORDER BY n_rows DESC, metric LIMIT 30)
SELECT advisor, metric,
       (floor(floor((avg(ptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS ptg_avg, (floor(floor((avg(wptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS wptg_avg,
       (floor(floor((avg(score)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS score_avg,
       regexp_replace(metric, '[ \\-/.]', '_', 'g') AS metric_safe
FROM kpi WHERE metric IN (SELECT metric FROM top) AND {KEY_OK}
GROUP BY advisor, metric
""")
def kpi_metric_pivot(spark, d):
    """Per-advisor means of the top-30 metrics (A8/J8/P16), long form."""
    return rounded(rollup.metric_means_long(views.kpi(spark, d), n=30))


# An explicit list of 30 metrics: the first names in sorted order.
WIDE_METRICS = [f"{a} {b}" for a in ("blue", "cold", "hot", "large") for b in
                ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")][:30]
_WIDE_SQL = ",\n       ".join(
    V.r6(f"avg(CASE WHEN metric = '{m}' THEN {v} END)") + f" AS {m.replace(' ', '_')}_{v}_avg"
    for m in WIDE_METRICS for v in ("ptg", "wptg", "score"))


@register("kpi_metric_pivot_wide", f"""
WITH {V.KPI}
SELECT advisor, {_WIDE_SQL}
FROM kpi WHERE {KEY_OK} GROUP BY advisor
""")
def kpi_metric_pivot_wide(spark, d):
    """Means of 30 listed metrics as ``{metric}_{measure}_avg`` columns, one row
    for every advisor (A8, wide form)."""
    return rollup.metric_pivot(views.kpi(spark, d), metrics=WIDE_METRICS, each=rounded)


@register("person_features", f"""
WITH {V.KPI},
k AS (SELECT * FROM kpi WHERE {KEY_OK}),
lm AS (SELECT advisor, max(month) AS latest_m FROM k GROUP BY advisor),
lp AS (SELECT advisor, max(month) AS lp_m FROM k WHERE ptg IS NOT NULL GROUP BY advisor)
SELECT k.advisor, {V.r6('avg(score)')} AS kpi_avg_score, {V.r6('avg(ptg)')} AS kpi_avg_ptg,
       {V.r6('avg(wptg)')} AS kpi_avg_wptg,
       {V.r6('max(CASE WHEN k.month = lp.lp_m THEN ptg END)')} AS kpi_latest_ptg,
       {V.r6('sum(CASE WHEN k.month = lm.latest_m THEN wptg END)')} AS kpi_composite_wptg_latest,
       {V.r6('CASE WHEN count(CASE WHEN ptg >= 100 THEN 1 END) > 0 THEN count(CASE WHEN ptg >= 100 THEN 1 END) / CAST(count(ptg) AS DOUBLE) END')} AS kpi_pct_above_target,
       CASE WHEN count(DISTINCT k.month) > 0 THEN count(DISTINCT k.month) END AS n_kpi_months,
       count(DISTINCT metric) AS n_kpi_metrics,
       {_WIDE_SQL}
FROM k LEFT JOIN lm ON k.advisor = lm.advisor LEFT JOIN lp ON k.advisor = lp.advisor
GROUP BY k.advisor
""")
def person_features(spark, d):
    """One row per advisor: the dense rollup (A1-A6) and 90 per-metric means."""
    return rollup.person_features(views.kpi(spark, d), metrics=WIDE_METRICS, each=rounded)


_LATEST = """
  (floor(floor((max(CASE WHEN coalesce(month, '') = mx_{m} THEN {m} END)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS {m}_latest"""

@register("kpi_metric_latest", f"""
WITH {V.KPI},
k AS (SELECT * FROM kpi WHERE {KEY_OK}),
mx AS (SELECT advisor, metric,
              max(CASE WHEN score IS NOT NULL THEN coalesce(month, '') END) AS mx_score,
              max(CASE WHEN ptg IS NOT NULL THEN coalesce(month, '') END) AS mx_ptg,
              max(CASE WHEN wptg IS NOT NULL THEN coalesce(month, '') END) AS mx_wptg
       FROM k GROUP BY advisor, metric),
nm AS (SELECT advisor, count(DISTINCT month) AS n_kpi_months FROM k
       WHERE month IS NOT NULL AND month <> '' GROUP BY advisor)
SELECT k.advisor, k.metric,
       (floor(floor((avg(score)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS score_avg, {_LATEST.format(m='score').strip()},
       (floor(floor((avg(ptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS ptg_avg, {_LATEST.format(m='ptg').strip()},
       (floor(floor((avg(wptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS wptg_avg, {_LATEST.format(m='wptg').strip()},
       coalesce(any_value(nm.n_kpi_months), 0) AS n_kpi_months
FROM k JOIN mx ON k.advisor = mx.advisor AND k.metric = mx.metric
LEFT JOIN nm ON k.advisor = nm.advisor
GROUP BY k.advisor, k.metric
""")
def kpi_metric_latest(spark, d):
    """Per advisor x metric mean + latest of each measure (A9), long form."""
    return rounded(rollup.metric_latest(views.kpi(spark, d)))


@register("scorecard_rollup", f"""
WITH {V.SC},
lp AS (SELECT email_lower, arg_max(ptg, (ts, event_id)) AS sc_latest_ptg
       FROM sc WHERE ptg IS NOT NULL GROUP BY email_lower)
SELECT s.email_lower,
       (floor(floor((avg(ptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_avg_ptg,
       (floor(floor((any_value(lp.sc_latest_ptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_latest_ptg,
       (floor(floor((avg(rank)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_avg_rank,
       (floor(floor((min(rank)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_best_rank,
       (floor(floor((avg(quartile)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_avg_quartile,
       (floor(floor((max(consec_failing)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_max_consec_failing,
       (floor(floor((sum(met_count)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_total_met,
       (floor(floor((sum(fail_count)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_total_fail,
       (floor(floor((avg(passed)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_pct_kpi_passed,
       count(*) AS sc_n_records
FROM sc s LEFT JOIN lp ON s.email_lower = lp.email_lower
GROUP BY s.email_lower
""")
def scorecard_rollup(spark, d):
    """Per-email scorecard rollup (A10-A15, F5, F6, F10) over events."""
    return rounded(rollup.scorecard_rollup(views.scorecard(spark, d), order=("ts", "event_id")))


@register("kpi_latest_month_rows", f"""
WITH {V.KPI},
lm AS (SELECT advisor, max(month) AS month FROM kpi WHERE month IS NOT NULL GROUP BY advisor)
SELECT k.advisor, k.month, k.metric, {V.r6('k.ptg')} AS ptg, {V.r6('k.wptg')} AS wptg
FROM kpi k SEMI JOIN lm ON k.advisor = lm.advisor AND k.month = lm.month
""")
def kpi_latest_month_rows(spark, d):
    """Every KPI row of each advisor's latest month."""
    rows = rollup.latest_period_rows(views.kpi(spark, d), "advisor", "month")
    return rounded(rows.select("advisor", "month", "metric", "ptg", "wptg"))
