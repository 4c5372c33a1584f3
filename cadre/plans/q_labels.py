"""Registered label queries: ordinal map, tercile tiers, tier summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadre.functions.bins import ordinal_to_star
from cadre.operators import labels
from cadre.plans.catalog import register, rounded
from cadre.sources.tables import table


@register("ordinal_map", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x'
                               ELSE CAST(1 + doc_id % 6 AS VARCHAR) END AS star FROM labels)
SELECT doc_id, star,
       CASE star WHEN '1' THEN 0 WHEN '3' THEN 1 WHEN '4' THEN 2 WHEN '5' THEN 3 END AS y,
       CASE star WHEN '1' THEN 1 WHEN '3' THEN 3 WHEN '4' THEN 4 WHEN '5' THEN 5 END AS star_back
FROM s WHERE star IN ('1', '3', '4', '5')
""")
def ordinal_map(spark, d):
    """STAR {1,3,4,5} -> ordinal {0..3} (2, 6, text -> null) and
    F7: keep only the label set; inverse map back."""
    s = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("x"))
        .otherwise((1 + F.col("doc_id") % 6).cast("string")).alias("star"))
    y = labels.star_labels(s, "star", out="y")
    return y.withColumn("star_back", ordinal_to_star(F.col("y")))


_TERCILE_SQL = """
cuts AS (SELECT quantile_cont(c_acctbal, CAST(1 AS DOUBLE) / 3) AS p33,
                quantile_cont(c_acctbal, CAST(2 AS DOUBLE) / 3) AS p67
         FROM customer WHERE c_acctbal IS NOT NULL)"""


@register("tercile_tiers", f"""
WITH {_TERCILE_SQL.strip()},
t AS (SELECT c_custkey, c_acctbal,
             CASE WHEN c_acctbal IS NULL THEN NULL WHEN c_acctbal <= p33 THEN 0
                  WHEN c_acctbal <= p67 THEN 1 ELSE 2 END AS tier, p33, p67
      FROM customer, cuts)
SELECT c_custkey, (floor(floor((c_acctbal) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS c_acctbal, tier,
       CASE tier WHEN 0 THEN 'At-Risk' WHEN 1 THEN 'Developing' WHEN 2 THEN 'High Performer' END
         AS tier_label,
       (floor(floor((p33) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS p33, (floor(floor((p67) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS p67
FROM t
""")
def tercile_tiers(spark, d):
    """A18 exact tercile cut points (>= 30 values), C12 right-closed tiers,
    C14 tier names, over customer account balances."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    tiered, info = labels.tercile_tiers(c, "c_acctbal")
    return rounded(tiered.withColumn("p33", F.lit(info["p33"])).withColumn("p67", F.lit(info["p67"])))


@register("tier_summary", """
WITH o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS target FROM orders),
cuts AS (SELECT quantile_cont(target, CAST(1 AS DOUBLE) / 3) AS p33,
                quantile_cont(target, CAST(2 AS DOUBLE) / 3) AS p67 FROM o WHERE target IS NOT NULL),
t AS (SELECT CASE WHEN target IS NULL THEN NULL WHEN target <= p33 THEN 0
                  WHEN target <= p67 THEN 1 ELSE 2 END AS tier FROM o, cuts),
c AS (SELECT tier, count(*) AS n FROM t GROUP BY tier)
SELECT tier, n, CAST(sum(n) OVER () AS BIGINT) AS n_total,
       CAST(sum(CASE WHEN tier IS NOT NULL THEN n END) OVER () AS BIGINT) AS n_labeled,
       (floor(floor((sum(CASE WHEN tier IS NOT NULL THEN n END) OVER () / CAST(sum(n) OVER () AS DOUBLE)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6)
         AS pct_labeled,
       CASE tier WHEN 0 THEN 'At-Risk' WHEN 1 THEN 'Developing' WHEN 2 THEN 'High Performer' END
         AS tier_label
FROM c
""")
def tier_summary(spark, d):
    """A18 + C12 tiers of order totals (pending orders unlabelled), then A19
    class counts and A20 labelled share."""
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice")).alias("target"))
    tiered, _ = labels.tercile_tiers(o, "target")
    return rounded(labels.tier_summary(tiered, "tier"))
