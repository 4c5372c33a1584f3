"""Registered roster queries: union/dedup, enrichment, joins and coverage."""

from __future__ import annotations

from cadre.operators import rollup, roster
from cadre.plans import sql_views as V
from cadre.plans import views
from cadre.plans.catalog import register, rounded

_UNION_SQL = f"""{V.ROSTER_A}, {V.ROSTER_B},
u AS (SELECT emp_id, acctbal, name, nationkey, 'a' AS _source, 0 AS _src_order FROM ra
      UNION ALL
      SELECT emp_id, acctbal, name, nationkey, 'b' AS _source, 1 AS _src_order FROM rb),
ud AS (SELECT * EXCLUDE (rn, _src_order) FROM (
         SELECT *, row_number() OVER (PARTITION BY emp_id
                   ORDER BY _src_order, acctbal, name, nationkey, _source) AS rn FROM u)
       WHERE rn = 1)"""

_ENRICH_SQL = _UNION_SQL + """,
en AS (SELECT ud.*, rb.c_mktsegment, rb.email FROM ud LEFT JOIN rb ON ud.emp_id = rb.emp_id)"""


def _union(spark, d):
    return roster.union_dedup(views.roster_a(spark, d), views.roster_b(spark, d), "emp_id")


def _enriched(spark, d):
    a = views.roster_a(spark, d)
    return roster.enrich(_union(spark, d), views.roster_b(spark, d), "emp_id", a_columns=a.columns)


@register("roster_union_dedup", f"""
WITH {_UNION_SQL}
SELECT emp_id, (floor(floor((acctbal) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS acctbal, name, nationkey, _source FROM ud
""")
def roster_union_dedup(spark, d):
    """W1 union on shared columns + W2 priority dedup (supplier beats customer)."""
    return rounded(_union(spark, d))


@register("roster_enrich", f"""
WITH {_ENRICH_SQL}
SELECT emp_id, (floor(floor((acctbal) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS acctbal, name, nationkey, _source,
       c_mktsegment, email FROM en
""")
def roster_enrich(spark, d):
    """B-only columns (first row per key) left-joined onto the union."""
    return rounded(_enriched(spark, d))


_KPI_ROLL = f"""k AS (SELECT advisor, count(DISTINCT month) AS n_kpi_months FROM kpi
                     GROUP BY advisor)"""
_SC_ROLL = "s AS (SELECT email_lower, avg(ptg) AS sc_avg_ptg FROM sc GROUP BY email_lower)"


@register("join_coverage", f"""
WITH {_ENRICH_SQL}, {V.KPI}, {V.SC}, {_KPI_ROLL}, {_SC_ROLL},
j AS (SELECT en.emp_id, k.n_kpi_months, s.sc_avg_ptg FROM en
      LEFT JOIN k ON en.emp_id = k.advisor
      LEFT JOIN s ON lower(trim(en.email)) = s.email_lower)
SELECT 'kpi' AS "join", count(*) AS total, count(n_kpi_months) AS joined,
       (floor(floor((count(n_kpi_months) * 100.0 / count(*)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS pct FROM j
UNION ALL
SELECT 'scorecard', count(*), count(sc_avg_ptg),
       (floor(floor((count(sc_avg_ptg) * 100.0 / count(*)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) FROM j
""")
def join_coverage(spark, d):
    """J1 KPI join on employee id, J2 scorecard join on email, J9 coverage."""
    joined = _roster_joined(spark, d)
    kpi = roster.join_coverage(joined, "n_kpi_months", "kpi")
    sc = roster.join_coverage(joined, "sc_avg_ptg", "scorecard")
    return rounded(kpi.unionByName(sc))


def _roster_joined(spark, d):
    en = _enriched(spark, d)
    kpi = rollup.kpi_rollup(views.kpi(spark, d), out_key="advisor")
    sc = rollup.scorecard_rollup(views.scorecard(spark, d), order=("ts", "event_id"))
    j = roster.left_join_rollup(en, kpi, "emp_id", "advisor", "emp")
    return roster.left_join_rollup(j, sc, "email", "email_lower", "email")


@register("roster_kpi_join", f"""
WITH {_ENRICH_SQL}, {V.KPI}, {V.SC},
k AS (SELECT advisor, (floor(floor((avg(ptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS kpi_avg_ptg,
             count(DISTINCT month) AS n_kpi_months FROM kpi GROUP BY advisor),
s AS (SELECT email_lower, (floor(floor((avg(ptg)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS sc_avg_ptg, count(*) AS sc_n_records
      FROM sc GROUP BY email_lower)
SELECT en.emp_id, en._source, k.kpi_avg_ptg, k.n_kpi_months, s.sc_avg_ptg, s.sc_n_records
FROM en LEFT JOIN k ON en.emp_id = k.advisor
LEFT JOIN s ON lower(trim(en.email)) = s.email_lower
""")
def roster_kpi_join(spark, d):
    """Roster with KPI rollup (J1) and scorecard rollup (J2) columns."""
    j = _roster_joined(spark, d)
    return rounded(j.select("emp_id", "_source", "kpi_avg_ptg", "n_kpi_months",
                            "sc_avg_ptg", "sc_n_records"))
