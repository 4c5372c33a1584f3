"""Registered explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadre.operators import explain
from cadre.plans import sql_views as V
from cadre.plans import views
from cadre.plans.catalog import register, rounded
from cadre.session import cut_lineage, scratch_path
from cadre.sources import artifacts

R = V.r6

# Groups over the advisor feature names (metric-name prefixes), same rule
# kinds as the roster groups.
KPI_GROUPS = [
    ("size", "startswith", ["small_", "large_"]),
    ("colour", "startswith", ["red_", "blue_"]),
    ("temperature", "startswith", ["hot_", "cold_"]),
    ("age", "startswith", ["new_", "old_"]),
]


def _contrib(spark, d):
    """The cube and its size, which is read off the advisors' features and the
    coefficients rather than off the cube."""
    coefs, means, test, _ = views.kpi_model(spark, d)
    sizes = (test.select("row_id").distinct().count(), coefs.select("class").distinct().count())
    return explain.linear_contributions(test, coefs, "row_id", baseline=means), sizes


@register("log_odds", f"""
WITH {V.PRED}
SELECT row_id,
       {R('ln(least(greatest(p0, CAST(1e-9 AS DOUBLE)), 1.0))')} AS lo0,
       {R('ln(least(greatest(p1, CAST(1e-9 AS DOUBLE)), 1.0))')} AS lo1,
       {R('ln(least(greatest(p2, CAST(1e-9 AS DOUBLE)), 1.0))')} AS lo2,
       CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS argmax,
       CAST(CASE WHEN abs(ln(p0)) >= abs(ln(p1)) AND abs(ln(p0)) >= abs(ln(p2)) THEN 0
                 WHEN abs(ln(p1)) >= abs(ln(p2)) THEN 1 ELSE 2 END AS INTEGER) AS argmax_abs
FROM pred
""")
def log_odds(spark, d):
    """Clipped log-probabilities, argmax and argmax of |.|."""
    out = explain.log_odds(views.pred(spark, d), ["p0", "p1", "p2"])
    return rounded(out.select("row_id", "lo0", "lo1", "lo2", "argmax", "argmax_abs"))


@register("linear_contributions", f"""
WITH {V.EXPLAIN}
SELECT row_id, feature, CAST(class AS INTEGER) AS class, {R('contribution')} AS contribution FROM contrib
""")
def linear_contributions(spark, d):
    """Exact linear contributions coef * (x - mean) for the test
    advisors, per feature (top-30 metric means) and tier class, long form;
    coefficients and baseline means come from the training advisors."""
    coefs, means, test, _ = views.kpi_model(spark, d)
    return rounded(explain.linear_contributions(test, coefs, "row_id", baseline=means))


_NOTE_SQL = "CASE " + " ".join(
    (f"WHEN starts_with(feature, '{n}') THEN '{t}'" if n == "sc_" else
     f"WHEN contains(lower(feature), '{n}') THEN '{t}'") for n, t in explain.DRIVER_NOTES) + " ELSE '' END"


@register("driver_ranking", f"""
WITH {V.EXPLAIN},
ma AS (SELECT feature, sum(abs(contribution)) / CAST((SELECT n_ids * n_cls FROM nid) AS DOUBLE) AS mean_abs
       FROM contrib GROUP BY feature),
best AS (SELECT * FROM ma ORDER BY mean_abs DESC, feature LIMIT 30)
SELECT feature, {R('mean_abs')} AS mean_abs,
       CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank,
       {_NOTE_SQL} AS note
FROM best
""")
def driver_ranking(spark, d):
    """Top-30 drivers by mean |contribution| with notes."""
    contrib, sizes = _contrib(spark, d)
    return rounded(explain.driver_ranking(contrib, "row_id", 30, sizes))


def _group_sql() -> str:
    parts = []
    for key, kind, vals in KPI_GROUPS:
        cond = " OR ".join(f"starts_with(feature, '{v}')" for v in vals) if kind != "cols" else \
            "feature IN (" + ", ".join(f"'{v}'" for v in vals) + ")"
        parts.append(f"WHEN {cond} THEN '{key}'")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


@register("group_contributions", f"""
WITH {V.EXPLAIN},
pr AS (SELECT row_id, {_group_sql()} AS "group", class, sum(contribution) AS c
       FROM contrib GROUP BY 1, 2, 3),
gm AS (SELECT "group", class, sum(c) / CAST((SELECT n_ids FROM nid) AS DOUBLE) AS m FROM pr GROUP BY 1, 2),
dom AS (SELECT "group", arg_max(class, (abs(m), -class)) AS dominant_class FROM gm GROUP BY 1)
SELECT gm."group", CAST(gm.class AS INTEGER) AS class, {R('gm.m')} AS mean_contribution,
       CAST(dom.dominant_class AS INTEGER) AS dominant_class,
       CASE dom.dominant_class WHEN 3 THEN '{explain.DIR_TOP}' WHEN 0 THEN '{explain.DIR_RISK}'
            ELSE '↑ STAR ' || CAST([1, 3, 4, 5][dom.dominant_class + 1] AS STRING) || ' signal' END AS dominant_dir
FROM gm JOIN dom ON gm."group" = dom."group"
""")
def group_contributions(spark, d):
    """Contributions summed per feature group, mean signed
    per (group, class), dominant class and its wording."""
    contrib, sizes = _contrib(spark, d)
    return rounded(explain.group_contributions(contrib, "row_id", KPI_GROUPS, sizes=sizes))


@register("explanation_samples", f"""
WITH {V.EXPLAIN},
share AS (SELECT class, count(*) / CAST((SELECT count(*) FROM sp WHERE split = 'train') AS DOUBLE) AS p
          FROM sp WHERE split = 'train' GROUP BY class),
g AS (SELECT row_id, {_group_sql()} AS "group", class, sum(contribution) AS c FROM contrib GROUP BY 1, 2, 3)
SELECT g.row_id, CAST(sp.class AS INTEGER) AS actual, CAST(g.class AS INTEGER) AS class,
       {R('ln(least(greatest(share.p, CAST(1e-9 AS DOUBLE)), 1.0))')} AS base_log_odds, g."group", {R('g.c')} AS contribution
FROM g JOIN sp ON g.row_id = sp.row_id JOIN share ON share.class = g.class
""")
def explanation_samples(spark, d):
    """The explained advisors' actual class, base log-odds (of the training
    shares) and summed contributions per feature group."""
    coefs, means, test, split = views.kpi_model(spark, d)
    counts = {r["class"]: r["count"] for r in split.where("split = 'train'").groupBy("class").count().collect()}
    n = sum(counts.values())
    pred = split.where("split = 'test'").select("row_id", F.col("class").cast("int").alias("label"),
                                                *[F.lit(counts.get(c, 0) / n).alias(f"p{c}") for c in range(3)])
    contrib = explain.linear_contributions(test, coefs, "row_id", baseline=means)
    return rounded(explain.sample_table(pred, contrib, ["p0", "p1", "p2"], groups=KPI_GROUPS))


@register("coef_topk", f"""
WITH {V.EXPLAIN},
r AS (SELECT class, feature, coef,
             row_number() OVER (PARTITION BY class ORDER BY coef DESC, feature) AS up,
             row_number() OVER (PARTITION BY class ORDER BY coef ASC, feature) AS down FROM coef)
SELECT CAST(class AS INTEGER) AS class, 'up' AS direction, CAST(up AS INTEGER) AS rank, feature,
       {R('coef')} AS coef FROM r WHERE up <= 12
UNION ALL
SELECT CAST(class AS INTEGER), 'down', CAST(down AS INTEGER), feature, {R('coef')} FROM r WHERE down <= 12
""")
def coef_topk(spark, d):
    """Top-12 and bottom-12 coefficients per class."""
    coefs, _, _, _ = views.kpi_model(spark, d)
    c = coefs.withColumn("class", F.col("class").cast("int"))
    return rounded(explain.coef_topk(c, 12))


#: Label and description of each feature group.
GROUP_INFO = [
    ("size", "Part size", "Metrics of small and large parts"),
    ("colour", "Part colour", "Metrics of red and blue parts"),
    ("temperature", "Part temperature", "Metrics of hot and cold parts"),
    ("age", "Part age", "Metrics of new and old parts"),
    ("other", "Other parts", "Metrics of all other parts"),
]


@register("explanation_export", f"""
WITH {V.EXPLAIN},
share AS (SELECT class, count(*) / CAST((SELECT count(*) FROM sp WHERE split = 'train') AS DOUBLE) AS p
          FROM sp WHERE split = 'train' GROUP BY class),
g AS (SELECT row_id, {_group_sql()} AS key, class, sum(contribution) AS c FROM contrib GROUP BY 1, 2, 3),
info(key, label) AS (VALUES {", ".join(f"('{k}', '{t}')" for k, t, _ in GROUP_INFO)}),
dense AS (SELECT ids.row_id, info.key, cls.class, coalesce(g.c, 0.0) AS c
          FROM (SELECT DISTINCT row_id FROM contrib) ids CROSS JOIN info CROSS JOIN (SELECT DISTINCT class FROM contrib) cls
          LEFT JOIN g ON g.row_id = ids.row_id AND g.key = info.key AND g.class = cls.class),
m AS (SELECT key, class, avg(c) AS m FROM dense GROUP BY 1, 2),
dom AS (SELECT key, arg_max(class, (abs(m), -class)) AS d FROM m GROUP BY 1)
SELECT 'sample' AS part, dense.row_id, CAST(sp.class AS INTEGER) AS actual, dense.key, CAST(NULL AS VARCHAR) AS label, CAST(dense.class AS INTEGER) AS class,
       {R('ln(least(greatest(share.p, CAST(1e-9 AS DOUBLE)), 1.0))')} AS base_log_odds, {R('dense.c')} AS contribution,
       CAST(NULL AS INTEGER) AS dominant_class
FROM dense JOIN sp ON dense.row_id = sp.row_id JOIN share ON share.class = dense.class
UNION ALL
SELECT 'group', NULL, NULL, m.key, info.label, CAST(m.class AS INTEGER), NULL, {R('m.m')}, CAST(dom.d AS INTEGER)
FROM m JOIN info ON m.key = info.key JOIN dom ON dom.key = m.key
""")
def explanation_export(spark, d):
    """The explanation payload of the test advisors — nested samples,
    groups with labels, metadata — written, read back and laid out long."""
    coefs, means, test, split = views.kpi_model(spark, d)
    counts = {r["class"]: r["count"] for r in split.where("split = 'train'").groupBy("class").count().collect()}
    n = sum(counts.values())
    pred = split.where("split = 'test'").select("row_id", F.col("class").cast("int").alias("label"),
                                                *[F.lit(counts.get(c, 0) / n).alias(f"p{c}") for c in range(3)])
    contrib = explain.linear_contributions(test, coefs, "row_id", baseline=means)
    samples = cut_lineage(explain.payload_samples(explain.sample_table(pred, contrib, ["p0", "p1", "p2"], groups=KPI_GROUPS),
                                                  [k for k, _, _ in GROUP_INFO], 3))
    path = scratch_path(spark, "payload")
    artifacts.write_payload(samples, explain.payload_groups(samples, GROUP_INFO, 3), path, {"n_test": samples.count(), "n_classes": 3})
    samples, groups, meta = artifacts.read_payload(spark, path)
    keys = F.array(*[F.lit(k) for k, _, _ in GROUP_INFO])
    by_group = samples.select("row_id", "actual", "base", F.posexplode("contributions").alias("g", "c"))
    by_class = by_group.select("row_id", "actual", "base", "g", F.posexplode("c").alias("class", "contribution"))
    rows = by_class.select(F.lit("sample").alias("part"), "row_id", "actual", F.element_at(keys, F.col("g") + 1).alias("key"),
                           F.lit(None).cast("string").alias("label"), "class", F.element_at("base", F.col("class") + 1).alias("base_log_odds"),
                           "contribution", F.lit(None).cast("int").alias("dominant_class"))
    each = groups.select("key", "label", "dominant_class", F.posexplode("mean_contribution").alias("class", "contribution"))
    none = lambda t: F.lit(None).cast(t)
    return rounded(rows.unionByName(each.select(F.lit("group").alias("part"), none("bigint").alias("row_id"), none("int").alias("actual"), "key", "label",
                                                "class", none("double").alias("base_log_odds"), "contribution", "dominant_class")))
