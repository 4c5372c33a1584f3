"""Registered feature queries: flag counts/coercion, buckets, tenure, profile,
type inference and cardinality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadre.functions import text
from cadre.operators import clean, columns, features, profile
from cadre.operators.sketches import SketchStore
from cadre.plans.catalog import register, rounded
from cadre.session import cut_lineage, scratch_path
from cadre.sources.tables import table

NUM_RE_SQL = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"
WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
TOKENS_SQL = ", ".join("'" + t + "'" if t != "\u00a0" else "chr(160)" for t in text.BLANK_TOKENS)

# Flag stand-ins over orders: (column name, SQL text expression).
FLAG_SQL = [
    ("L-urgent", "CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN '2' "
                 "WHEN '5-LOW' THEN NULL ELSE '0' END"),
    ("L-open", "CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN '0' ELSE 'x' END"),
    ("S-odd", "CAST(o_custkey % 2 AS STRING)"),
    ("ChS-big", "CASE WHEN o_totalprice > 200000 THEN '1' WHEN o_totalprice < 50000 THEN NULL ELSE '0' END"),
    ("CL-third", "CASE WHEN o_orderkey % 3 = 0 THEN ' 1 ' ELSE 'N/A' END"),
    ("V-fifth", "CASE WHEN o_orderkey % 5 = 0 THEN '-1' ELSE '1' END"),
    ("ISPseven", "CASE WHEN o_custkey % 7 = 0 THEN '' ELSE '0' END"),
    ("Tr-bus", "CASE WHEN o_orderkey % 4 = 0 THEN '3' ELSE '0.5' END"),
]


def _flags_frame(spark, d):
    o = table(spark, d, "orders")
    return o.selectExpr("o_orderkey", *[f"{sql} AS `{name}`" for name, sql in FLAG_SQL],
                        "o_orderpriority AS `GC Region`")


def _sql_clean(c):
    return (f"(CASE WHEN {c} IN ({TOKENS_SQL}) THEN NULL "
            f"ELSE nullif(trim({c}, {WS_SQL}), '') END)")


def _sql_num(c):
    t = f"trim({c}, {WS_SQL})"
    return f"(CASE WHEN regexp_full_match({t}, {NUM_RE_SQL}) THEN TRY_CAST({t} AS DOUBLE) END)"


_FLAGS_CTE = ("f AS (SELECT o_orderkey, " + ", ".join(
    f"{_sql_clean('(' + sql + ')')} AS \"{name}\"" for name, sql in FLAG_SQL) + " FROM orders)")


def _cnt_sql():
    parts = []
    for p in columns.FLAG_PREFIXES:
        members = [n for n, _ in FLAG_SQL if n.startswith(p)]
        if members:
            s = " + ".join(f"coalesce({_sql_num(chr(34) + m + chr(34))}, 0)" for m in members)
            parts.append(f"(floor(floor((CAST({s} AS DOUBLE)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS cnt_{features.group_name(p)}")
    filled = " + ".join(f"CAST(\"{n}\" IS NOT NULL AS INTEGER)" for n, _ in FLAG_SQL)
    parts.append(f"(floor(floor((({filled}) / {float(len(FLAG_SQL))}) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS flag_completeness")
    return ",\n       ".join(parts)


@register("flag_counts", f"""
WITH {_FLAGS_CTE}
SELECT o_orderkey,
       {_cnt_sql()}
FROM f
""")
def flag_counts(spark, d):
    """F1 clean, P6 flag columns by prefix, A22 per-group counts (before
    clipping) and A23 flag completeness, per order."""
    df = clean.clean_frame(_flags_frame(spark, d))
    flags = columns.flag_cols(df.columns)
    out = features.flag_features(df, flags)
    keep = ["o_orderkey"] + [c for c in out.columns if c.startswith("cnt_") or c == "flag_completeness"]
    return rounded(out.select(*keep))


@register("flag_coerce", f"""
WITH {_FLAGS_CTE}
SELECT o_orderkey, """ + ", ".join(
    f"(floor(floor((least(greatest(coalesce({_sql_num(chr(34) + n + chr(34))}, 0.0), 0.0), 1.0)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS \"{n}\""
    for n, _ in FLAG_SQL) + """
FROM f
""")
def flag_coerce(spark, d):
    """flags numeric, null -> 0, clipped to [0, 1] (after F1 clean)."""
    df = clean.clean_frame(_flags_frame(spark, d))
    flags = columns.flag_cols(df.columns)
    return rounded(clean.coerce_flags(df, flags).select("o_orderkey", *[f"`{c}`" for c in flags]))


@register("value_buckets", """
WITH p AS (SELECT p_partkey,
                  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 1.25 - 2.5 END AS dist
           FROM part)
SELECT p_partkey, (floor(floor((dist) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS dist,
       CASE WHEN dist > -1 AND dist <= 5 THEN '<5km'
            WHEN dist > 5 AND dist <= 15 THEN '5-15km'
            WHEN dist > 15 AND dist <= 30 THEN '15-30km'
            WHEN dist > 30 AND dist <= 60 THEN '30-60km'
            WHEN dist > 60 AND dist <= 9999 THEN '>60km' END AS dist_bucket
FROM p
""")
def value_buckets(spark, d):
    """Right-closed distance bins (5.0 -> '<5km'; out of range -> null)."""
    p = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 17 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_size") * 1.25 - 2.5).alias("dist"))
    return rounded(features.distance_bucket(p, "dist"))


@register("tenure", """
WITH h AS (
  SELECT o_orderkey,
         o_orderdate + INTERVAL 30 YEAR + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS t
  FROM orders),
s AS (
  SELECT o_orderkey, CASE o_orderkey % 4
      WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S')
      WHEN 1 THEN strftime(t, '%m/%d/%Y')
      WHEN 2 THEN strftime(t, '%Y-%m-%d')
      ELSE 'not a date' END AS hire
  FROM h),
p AS (SELECT o_orderkey, coalesce(try_strptime(hire, '%Y-%m-%d %H:%M:%S'),
                                  try_strptime(hire, '%Y-%m-%d'),
                                  try_strptime(hire, '%m/%d/%Y')) AS ts FROM s),
m AS (SELECT o_orderkey,
             greatest(floor((epoch_us(TIMESTAMP '2026-06-23') - epoch_us(ts)) / 86400000000.0) / 30.44,
                      0.0) AS tm
      FROM p)
SELECT o_orderkey, (floor(floor((tm) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS tenure_months,
       CASE WHEN tm > -1 AND tm <= 3 THEN '<3m' WHEN tm > 3 AND tm <= 6 THEN '3-6m'
            WHEN tm > 6 AND tm <= 12 THEN '6-12m' WHEN tm > 12 AND tm <= 24 THEN '1-2yr'
            WHEN tm > 24 AND tm <= 60 THEN '2-5yr' WHEN tm > 60 AND tm <= 9999 THEN '>5yr' END
         AS tenure_bucket
FROM m
""")
def tenure(spark, d):
    """C8 date parse (declared formats, bad text -> null), C6 tenure months
    (time of day counts, floored at 0), C7 tenure bins."""
    o = table(spark, d, "orders")
    t = (F.col("o_orderdate") + F.expr("INTERVAL 30 YEARS")
         + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int")))
    r = F.col("o_orderkey") % 4
    hire = (F.when(r == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
            .when(r == 1, F.date_format(t, "MM/dd/yyyy"))
            .when(r == 2, F.date_format(t, "yyyy-MM-dd"))
            .otherwise(F.lit("not a date")))
    df = o.select("o_orderkey", hire.alias("hire"))
    out = features.tenure(df, "hire", formats=("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy"))
    return rounded(out.select("o_orderkey", "tenure_months", "tenure_bucket"))


_PROFILE_SQL = """
SELECT 'is_odd' AS feature, 'binary' AS type, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi,
       '0|1' AS "values"
UNION ALL
SELECT 'c_nationkey', 'numeric', min(c_nationkey), max(c_nationkey), NULL FROM customer
UNION ALL
SELECT 'c_acctbal', 'numeric', (floor(floor((min(c_acctbal)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6), (floor(floor((max(c_acctbal)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6), NULL
FROM customer
UNION ALL
SELECT 'no_value', 'numeric', 0.0, 1.0, NULL
UNION ALL
SELECT 'c_mktsegment', 'categorical', NULL, NULL, string_agg(v, '|' ORDER BY v)
FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY v LIMIT 50)
UNION ALL
SELECT 'c_name', 'categorical', NULL, NULL, string_agg(v, '|' ORDER BY v)
FROM (SELECT DISTINCT c_name AS v FROM customer WHERE c_name IS NOT NULL ORDER BY v LIMIT 50)
"""


@register("column_profile", _PROFILE_SQL)
def column_profile(spark, d):
    """Binary / numeric [min,max] (all-null -> [0,1]) / first 50 sorted
    distinct categorical values, over customer."""
    c = table(spark, d, "customer").withColumn("is_odd", (F.col("c_custkey") % 2).cast("int")) \
        .withColumn("no_value", F.lit(None).cast("double"))
    out = profile.column_profile(c, ["is_odd"], ["c_nationkey", "c_acctbal", "no_value"], ["c_mktsegment", "c_name"])
    return rounded(out.withColumn("values", F.array_join("values", "|")))


_TYPED_COLS = [
    ("orderkey_txt", "CAST(o_orderkey AS STRING)"),
    ("price_txt", "CAST(o_totalprice AS STRING)"),
    ("status", "o_orderstatus"),
    ("priority", "o_orderpriority"),
    ("mixed", "CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END"),
    ("mostly_text", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END"),
]


@register("type_inference", "WITH t AS (SELECT " + ", ".join(f"{sql} AS {n}" for n, sql in _TYPED_COLS)
          + " FROM orders)\n" + "\nUNION ALL\n".join(
              f"SELECT '{n}' AS feature, (floor(floor((avg(CASE WHEN {_sql_num(n)} IS NOT NULL THEN 1.0 ELSE 0.0 END)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6)"
              f" AS numeric_share, CASE WHEN avg(CASE WHEN {_sql_num(n)} IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5"
              f" THEN 'numeric' ELSE 'categorical' END AS inferred_type FROM t" for n, _ in _TYPED_COLS))
def type_inference(spark, d):
    """numeric when >= 50% of all rows parse, else categorical."""
    o = table(spark, d, "orders").selectExpr(*[f"{sql} AS {n}" for n, sql in _TYPED_COLS])
    return rounded(features.infer_types(o, [n for n, _ in _TYPED_COLS], 0.5))


_CARD_COLS = ["c_nationkey", "c_mktsegment", "c_name", "c_acctbal"]


@register("cardinality", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) > 20 AS high_card "
    f"FROM customer" for c in _CARD_COLS))
def cardinality(spark, d):
    """F12 + A16: distinct values per column, high-cardinality flag (> 20)."""
    return features.cardinality(table(spark, d, "customer"), _CARD_COLS, high=20)


_SKETCHED = ["l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
_SKETCHED_NUMERIC = ["l_quantity", "l_extendedprice"]


@register("sketch_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS n_null, "
    + (f"min({c}) AS lo, max({c}) AS hi" if c in _SKETCHED_NUMERIC else "CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi")
    + f", true AS distinct_near, true AS same_after_reload, {'true' if c in _SKETCHED_NUMERIC else 'CAST(NULL AS BOOLEAN)'} AS median_near FROM lineitem"
    for c in _SKETCHED))
def sketch_profile(spark, d):
    """A16/A18/A21/F12 (opt-in): sketches by ship year, stored load by load and
    merged: exact counts and ranges, distinct numbers within 8 %, a median
    within 4 % of its rank, and no change when a load is added again."""
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    store = SketchStore(spark, scratch_path(spark, "sketches"))
    store.add(li, "year", _SKETCHED, _SKETCHED_NUMERIC)
    before = cut_lineage(store.profile())
    store.add(li.where("year = 1995"), "year", _SKETCHED, _SKETCHED_NUMERIC)
    again = store.profile().select("feature", F.col("n").alias("_n"), F.col("n_distinct").alias("_d"))
    exact = li.agg(*[F.count_distinct(c).alias(c) for c in _SKETCHED]).first()
    median = {r["feature"]: r["quantiles"][1] for r in before.where("quantiles IS NOT NULL").collect()}
    below = li.agg(*[F.avg((F.col(c) <= F.lit(m)).cast("double")).alias(c) for c, m in median.items()],
                   *[F.avg((F.col(c) < F.lit(m)).cast("double")).alias(f"{c}_lt") for c, m in median.items()]).first()
    facts = [(c, float(exact[c]), bool(below[f"{c}_lt"] <= 0.54 and below[c] >= 0.46) if c in median else None) for c in _SKETCHED]
    facts = spark.createDataFrame(facts, "feature string, exact double, median_near boolean")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.08 * F.col("exact")
    # four rows each
    return before.join(again, "feature").join(facts, "feature").select(
        "feature", "n", "n_null", "lo", "hi", near.alias("distinct_near"),
        ((F.col("_n") == F.col("n")) & (F.col("_d") == F.col("n_distinct"))).alias("same_after_reload"), "median_near")
