"""Registered validation and period-alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadre.operators import rollup, score
from cadre.plans import sql_views as V
from cadre.plans import views
from cadre.plans.catalog import register, rounded
from cadre.sources.tables import table

R = V.r6

# Schema of the stand-in batch (feature -> type); "Job Grade" is absent from
# the input on purpose (missing column -> null).
BATCH_SCHEMA = {"ChS-big": "binary", "Site Distance": "numeric", "GC Region": "categorical",
                "Job Grade": "categorical"}

_BATCH_SQL = """b AS (
  SELECT o_orderkey,
         CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN 'false' ELSE 'yes' END AS "ChS-big",
         CASE WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 11 = 0 THEN ''
              ELSE ' ' || CAST(o_totalprice AS STRING) END AS "Site Distance",
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS "GC Region",
         o_orderstatus AS extra
  FROM orders)"""


def _batch(spark, d):
    o = table(spark, d, "orders")
    return o.selectExpr(
        "o_orderkey",
        "CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN 'false' ELSE 'yes' END AS `ChS-big`",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 11 = 0 THEN '' "
        "ELSE concat(' ', CAST(o_totalprice AS STRING)) END AS `Site Distance`",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS `GC Region`",
        "o_orderstatus AS extra")


@register("validate_rows", f"""
WITH {_BATCH_SQL},
v AS (
  SELECT o_orderkey,
         CASE WHEN "ChS-big" IS NULL OR trim("ChS-big") = '' THEN NULL
              WHEN upper(trim("ChS-big")) IN ('1', '1.0', 'TRUE') THEN 1.0
              WHEN upper(trim("ChS-big")) IN ('0', '0.0', 'FALSE') THEN 0.0 END AS "ChS-big",
         CASE WHEN "ChS-big" IS NOT NULL AND trim("ChS-big") <> ''
               AND upper(trim("ChS-big")) NOT IN ('1', '1.0', 'TRUE', '0', '0.0', 'FALSE')
              THEN '''ChS-big'': expected 0/1, got ''' || "ChS-big" || '''' END AS e1,
         CASE WHEN "Site Distance" IS NULL OR trim("Site Distance") = '' THEN NULL
              WHEN regexp_full_match(trim("Site Distance"), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN TRY_CAST(trim("Site Distance") AS DOUBLE) END AS "Site Distance",
         CASE WHEN "Site Distance" IS NOT NULL AND trim("Site Distance") <> ''
               AND NOT regexp_full_match(trim("Site Distance"), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN '''Site Distance'': expected a number, got ''' || "Site Distance" || '''' END AS e2,
         CASE WHEN "GC Region" IS NULL OR trim("GC Region") = '' THEN NULL ELSE trim("GC Region") END AS "GC Region",
         CAST(NULL AS STRING) AS "Job Grade"
  FROM b)
SELECT o_orderkey, {R('"ChS-big"')} AS "ChS-big", {R('"Site Distance"')} AS "Site Distance",
       "GC Region", "Job Grade",
       concat_ws(' | ', e1, e2) AS errors,
       CAST(e1 IS NOT NULL AS INTEGER) + CAST(e2 IS NOT NULL AS INTEGER) AS n_errors
FROM v
""")
def validate_rows(spark, d):
    """K1: coerce a raw text batch to the model schema (binary / numeric /
    categorical), missing schema column -> null (P12), extra column
    dropped, one error message per bad field."""
    v = score.validate_rows(_batch(spark, d), BATCH_SCHEMA, keep=["o_orderkey"])
    return rounded(v.select("o_orderkey", *[f"`{c}`" for c in BATCH_SCHEMA],
                            F.array_join("errors", " | ").alias("errors"),
                            F.size("errors").alias("n_errors")))


_LABELS_SQL = """lab AS (SELECT DISTINCT CAST(l_suppkey AS STRING) AS advisor,
                               strftime(o_orderdate, '%Y-%m') AS eval_month
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@register("period_aligned_rollup", f"""
WITH {V.KPI}, {_LABELS_SQL},
k AS (SELECT * FROM kpi WHERE {V.KEY_OK}),
j AS (SELECT lab.advisor, lab.eval_month, k.ptg, k.wptg, k.month
      FROM lab LEFT JOIN k ON k.advisor = lab.advisor AND k.month <= lab.eval_month
       AND k.month > strftime(CAST(lab.eval_month || '-01' AS DATE) - INTERVAL 3 MONTH, '%Y-%m'))
SELECT advisor, eval_month, count(month) AS n_rows, {R('avg(ptg)')} AS avg_ptg, {R('sum(wptg)')} AS sum_wptg
FROM j GROUP BY advisor, eval_month
""")
def period_aligned_rollup(spark, d):
    """KPI facts of the 3 months ending at each label's evaluation
    month (labels: supplier x order month), as an expanded equi-join."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    labels = (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("l_suppkey").cast("string").alias("advisor"),
                      F.date_format("o_orderdate", "yyyy-MM").alias("eval_month")).distinct())
    return rounded(rollup.period_aligned_rollup(views.kpi(spark, d), labels, "advisor", "month",
                                                label_month="eval_month", months=3))
