"""Column profiles from stored sketches (A16, A18, A21, F12, opt-in).

Each load date leaves one row per column: exact counts and range, an HLL sketch
of its distinct values and, for numbers, a KLL sketch of their ranks.  Profiles
over any set of dates merge these rows and never read old data again.  Counts
and ranges are exact; distinct numbers and quantiles carry the sketches' errors
(about 1.6 / sqrt(2^lg_k) of the number, and about 3.3 / k of the rank), so the
exact operators stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
K = 200


def column_sketches(df: DataFrame, load: str, columns: Sequence[str], numeric: Sequence[str] = (), lg_k: int = LG_K, k: int = K) -> DataFrame:
    """``load, feature, n, n_null, lo, hi, hll, kll``: one scan, one row per
    load and column; ``lo``, ``hi`` and ``kll`` are null unless the column is
    in ``numeric``."""
    numeric = set(numeric)
    q = lambda c: F.col(f"`{c}`")
    aggs, rows = [], []
    for i, c in enumerate(columns):
        aggs += [F.count(F.lit(1)).alias(f"n{i}"), F.count_if(q(c).isNull()).alias(f"u{i}"), F.hll_sketch_agg(q(c).cast("string"), lg_k).alias(f"h{i}")]
        x = q(c).cast("double")
        if c in numeric:
            aggs += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"x{i}"), F.kll_sketch_agg_double(x, k).alias(f"k{i}")]
        own = lambda p, t, c=c, i=i: F.col(f"{p}{i}") if c in numeric else F.lit(None).cast(t)
        rows.append(F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("n_null"), own("l", "double").alias("lo"),
                             own("x", "double").alias("hi"), F.col(f"h{i}").alias("hll"), own("k", "binary").alias("kll")))
    return df.groupBy(q(load).cast("string").alias("load")).agg(*aggs).select("load", F.inline(F.array(*rows)))


def merged_profile(sketches: DataFrame, probs: Sequence[float] = (1 / 3, 0.5, 2 / 3)) -> DataFrame:
    """``feature, n, n_null, lo, hi, n_distinct, quantiles`` over all rows of
    ``sketches`` (one row per column and load)."""
    out = sketches.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))
    # a sketch without values has no quantiles
    some = F.col("lo").isNotNull()
    quantiles = F.kll_sketch_get_quantile_double(F.when(some, F.col("kll")), F.array(*[F.lit(float(p)) for p in probs]))
    return out.select("feature", "n", "n_null", "lo", "hi", F.hll_sketch_estimate("hll").alias("n_distinct"), F.when(some, quantiles).alias("quantiles"))


class SketchStore:
    """Sketches of a table by load date, as Parquet partitions under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, load: str, columns: Sequence[str], numeric: Sequence[str] = (), **kw) -> None:
        """Sketches the loads in ``df``; a load that is added again is replaced."""
        column_sketches(df, load, columns, numeric, **kw).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def profile(self, loads: Sequence[str] | None = None, probs: Sequence[float] = (1 / 3, 0.5, 2 / 3)) -> DataFrame:
        """The profile of some loads, all by default."""
        sketches = self.read()
        if loads is not None:
            sketches = sketches.where(F.col("load").cast("string").isin(list(loads)))
        return merged_profile(sketches, probs)
