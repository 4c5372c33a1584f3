"""Column profile for the model schema (A21) and its JSON form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(c: str):
    return F.col(f"`{c}`")


def column_profile(df: DataFrame, binary: Sequence[str], numeric: Sequence[str],
                   categorical: Sequence[str], max_values: int = 50) -> DataFrame:
    """One row per feature ``feature, type, lo, hi, values``.

    * binary: values ["0", "1"];
    * numeric: [min, max] in one aggregation for all numeric columns;
      [0, 1] when a column is all null;
    * categorical: the first ``max_values`` sorted distinct strings — per
      column a distinct + top-k (``TakeOrderedAndProject``: each task keeps
      only ``max_values`` rows), never a collect of all values.
    """
    spark = df.sparkSession
    parts = []
    if binary:
        parts.append(spark.createDataFrame([(c,) for c in binary], "feature string").select(
            "feature", F.lit("binary").alias("type"), F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"), F.array(F.lit("0"), F.lit("1")).alias("values")))
    if numeric:
        agg = df.agg(*[F.min(_q(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(numeric)],
                     *[F.max(_q(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(numeric)])
        pairs = ", ".join(f"'{c}', lo{i}, hi{i}" for i, c in enumerate(numeric))
        long = agg.selectExpr(f"stack({len(numeric)}, {pairs}) AS (feature, lo, hi)")
        all_null = F.col("lo").isNull() & F.col("hi").isNull()
        parts.append(long.select(
            "feature", F.lit("numeric").alias("type"),
            F.when(all_null, F.lit(0.0)).otherwise(F.col("lo")).alias("lo"),
            F.when(all_null, F.lit(1.0)).otherwise(F.col("hi")).alias("hi"),
            F.lit(None).cast("array<string>").alias("values")))
    for c in categorical:
        first = (df.select(_q(c).cast("string").alias("v")).filter(F.col("v").isNotNull())
                 .distinct().orderBy("v").limit(max_values))
        parts.append(first.agg(
            F.lit(c).alias("feature"), F.lit("categorical").alias("type"),
            F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
            F.sort_array(F.collect_list("v")).alias("values")))
    if not parts:
        return spark.createDataFrame([], "feature string, type string, lo double, hi double, values array<string>")
    return reduce(DataFrame.unionByName, parts)


def schema_json(profile: DataFrame, extra: dict | None = None) -> DataFrame:
    """S6 payload: the profile as one JSON document row ``{features: {...}}``
    built with Spark's ``to_json`` (no driver-side dict)."""
    spec = F.when(F.col("type") == "numeric",
                  F.to_json(F.struct(F.col("type"), F.array("lo", "hi").alias("range"))))
    spec = spec.when(F.col("type") == "binary",
                     F.to_json(F.struct(F.col("type"), F.array(F.lit(0), F.lit(1)).alias("values"))))
    spec = spec.otherwise(F.to_json(F.struct(
        F.col("type"), F.coalesce("values", F.array().cast("array<string>")).alias("values"))))
    entries = profile.select(F.concat(F.to_json(F.array("feature")).substr(F.lit(2), F.length(F.to_json(F.array("feature"))) - 2),
                                      F.lit(":"), spec).alias("e"))
    doc = entries.agg(F.concat(F.lit('{"features":{'), F.array_join(F.sort_array(F.collect_list("e")), ","),
                               F.lit("}}")).alias("json"))
    return doc
