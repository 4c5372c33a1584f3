"""Stand-in inputs built from the test tables.

Each view only reshapes given tables into the schema an operator expects
(the operators themselves do the work); every view has a SQL twin in
``cadre.plans.sql_views`` so DuckDB sees the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadre.sources.tables import table


def kpi(spark: SparkSession, d: str) -> DataFrame:
    """KPI fact: lineitem x part -> (advisor, month, metric, score, ptg, wptg)."""
    li = table(spark, d, "lineitem")
    part = table(spark, d, "part")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    ptg = F.when(F.col("l_tax") == 0, F.lit(None).cast("double")).otherwise(4 * F.col("l_quantity"))
    return j.select(
        F.col("l_suppkey").cast("string").alias("advisor"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.col("p_name").alias("metric"),
        F.col("l_quantity").alias("score"),
        ptg.alias("ptg"),
        (ptg * F.col("l_discount")).alias("wptg"),
    )


def scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Scorecard fact from events, every measure as raw text like a CSV read."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    passed = (F.when(F.col("event_type") == "purchase", F.lit("Y"))
              .when(F.col("event_type") == "signup", F.lit("YES"))
              .when(F.col("event_type") == "error", F.lit("N"))
              .when(F.col("event_type") == "view", F.lit("maybe")))
    return e.select(
        F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Example.com ")).alias("email"),
        F.col("ts"), F.col("event_id"),
        F.col("value").cast("string").alias("ptg"),
        (F.col("event_id") % 100).cast("string").alias("rank"),
        (1 + k % 4).cast("string").alias("quartile"),
        (k % 6).cast("string").alias("consec_failing"),
        (k % 10).cast("string").alias("met_count"),
        (k % 3).cast("string").alias("fail_count"),
        passed.alias("kpi_passed"),
    )


def roster_a(spark: SparkSession, d: str) -> DataFrame:
    """Roster source A (priority): suppliers."""
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("emp_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"),
    )


def roster_b(spark: SparkSession, d: str) -> DataFrame:
    """Roster source B: customers, with a B-only column and an email."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("emp_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
    )


def cat(spark: SparkSession, d: str) -> DataFrame:
    """Categorical training rows: documents x labels."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, d, "labels")
    return docs.join(lab, "doc_id", "inner")


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Prediction table (row_id, label, prediction, probability, p0..p2)."""
    c = cat(spark, d)
    a0 = 1 + F.col("doc_id") % 7
    a1 = 1 + F.col("doc_id") % 5
    a2 = 1 + F.col("n_chars") % 9
    tot = (a0 + a1 + a2).cast("double")
    y = (F.when(F.col("toxic") == 1, F.lit(0))
         .when(F.col("quality") == 0, F.lit(1)).otherwise(F.lit(2)))
    pr = (F.when((a0 >= a1) & (a0 >= a2), F.lit(0))
          .when(a1 >= a2, F.lit(1)).otherwise(F.lit(2)))
    return c.select(
        F.col("doc_id").alias("row_id"), y.alias("label"), pr.alias("prediction"),
        (a0 / tot).alias("p0"), (a1 / tot).alias("p1"), (a2 / tot).alias("p2"),
    ).withColumn("probability", F.array("p0", "p1", "p2"))


def kpi_feature_long(spark: SparkSession, d: str) -> DataFrame:
    """Per advisor x (top-30 metric, measure) values, long: (row_id, feature, x)."""
    from cadre.operators import rollup
    mm = rollup.metric_means_long(kpi(spark, d), n=30)
    long = mm.selectExpr("advisor AS row_id", "metric_safe",
                         "stack(3, 'ptg_avg', ptg_avg, 'wptg_avg', wptg_avg, "
                         "'score_avg', score_avg) AS (measure, x)")
    return long.select("row_id", F.concat_ws("_", "metric_safe", "measure").alias("feature"), "x")


def advisor_split(spark: SparkSession, d: str) -> DataFrame:
    """Advisors with class = tercile tier of their mean PTG and an 80/20
    stratified train/test split: (row_id, class, split)."""
    from cadre.operators import labels, rollup, split
    from cadre.session import cut_lineage
    # one row per advisor, read by the cut-point jobs and by the split
    roll = cut_lineage(rollup.kpi_rollup(kpi(spark, d)).select("advisor", "kpi_avg_ptg"))
    tiered, _ = labels.tercile_tiers(roll, "kpi_avg_ptg", out="class")
    t = tiered.select(F.col("advisor").cast("bigint").alias("row_id"), "class") \
        .filter(F.col("class").isNotNull())
    return split.stratified_split(t, "class", "row_id", 0.2, None)


def kpi_model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A linear score read off the training advisors: per tier class and
    feature, class mean minus overall mean.  Returns (coefficients
    (class, feature, coef), baseline means (feature, mean), test-advisor
    features (row_id, feature, x), the advisors' split (row_id, class, split))."""
    from cadre.session import cut_lineage
    # advisors x features and advisors, read several times below
    feats = cut_lineage(kpi_feature_long(spark, d).withColumn("row_id", F.col("row_id").cast("bigint")))
    s = cut_lineage(advisor_split(spark, d))
    train = feats.join(s.filter(F.col("split") == "train"), "row_id")
    by_class = cut_lineage(train.groupBy("class", "feature").agg(F.sum("x").alias("s"), F.count("x").alias("n")))
    means = by_class.groupBy("feature").agg(F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("mean"))
    coefs = by_class.join(means, "feature").select(
        "class", "feature", F.coalesce(F.try_divide(F.col("s"), F.col("n").cast("double")) - F.col("mean"), F.lit(0.0)).alias("coef"))
    test = feats.join(s.filter(F.col("split") == "test").select("row_id"), "row_id")
    return coefs, means, test, s


def order_features(spark: SparkSession, d: str) -> DataFrame:
    """Order-level modelling table: order attributes, per-order line
    aggregates and the customer's attributes; target ``sum_price``, the sum of
    the order's line prices (which the line counts and quantities explain)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_price"), F.avg("l_discount").alias("avg_disc"), F.avg("l_tax").alias("avg_tax"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    j = (o.join(li, o.o_orderkey == li.l_orderkey, "left")
         .join(c, o.o_custkey == c.c_custkey, "left"))
    return j.select(F.col("o_orderkey").alias("row_id"), "o_orderstatus", "o_orderpriority",
                    "c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("c_nationkey"),
                    "c_acctbal", "n_lines", "sum_qty", "avg_disc", "avg_tax", "sum_price")
