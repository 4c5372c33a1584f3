"""Distributed running sums inside groups.

A window ``partitionBy(group).orderBy(x)`` sends each group to one task; for
evaluation curves the group is a class — a third of all rows, or everything.
Here the ordering column is cut into buckets at quantiles of its values, so
they hold about as many rows each however the values lie: per (group, bucket)
totals give each bucket's starting offset (a small table of groups x buckets),
and the running sum is only computed inside a (group, bucket) window.  Results
equal the single-window ones; only the balance depends on the edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets are found in two steps of this many comparisons each.
SIDE = 32


def _constant(values: Sequence[float]) -> Column:
    """A constant array that is short in the plan."""
    text = ",".join("Infinity" if v == float("inf") else "-Infinity" if v == float("-inf") else repr(float(v)) for v in values)
    return F.split(F.lit(text), ",").cast("array<double>")


def quantile_edges(df: DataFrame, order: str, buckets: int = SIDE * SIDE) -> list[float]:
    """At most ``buckets - 1`` distinct values that part the rows evenly (the
    driver sees only these)."""
    probs = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(F.col(order).cast("double"), probs, 100 * buckets).alias("e")).first()["e"] if probs else None
    return sorted(set(got or []))


def bucket_of(col: Column, edges: Sequence[float]) -> Column:
    """Number of edges that are not above the value."""
    side = max(1, int(len(edges) ** 0.5) + 1)
    lower = [float("-inf"), *edges]
    lower += [float("inf")] * (side * side - len(lower))
    below = lambda e: e <= col.cast("double")
    coarse = F.size(F.filter(_constant(lower[::side]), below)) - 1
    # a value at infinity would also pass the padding
    inner = F.size(F.filter(F.slice(_constant(lower), coarse * side + 1, F.lit(side)), below))
    return F.least(coarse * side + inner - 1, F.lit(len(edges)))


def running_sums(df: DataFrame, group: Sequence[str], order: str, cols: Sequence[str],
                 n_buckets: int = SIDE * SIDE, descending: bool = False) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows of the same group whose
    ``order`` value is <= the row's (>= when ``descending``), rows being
    unique per (group, order) — aggregate to distinct values first, and cut
    the lineage: the frame is read three times.  ``group`` may be empty."""
    group = list(group)
    edges = quantile_edges(df, order, n_buckets)
    b = bucket_of(F.col(order), edges)
    with_b = df.withColumn("_b", F.lit(len(edges)) - b if descending else b)
    totals = with_b.groupBy(*group, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    # over the totals: at most n_buckets rows for each group
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                            for c in cols])
    o = F.col(order).desc() if descending else F.col(order).asc()
    inner = Window.partitionBy(*group, "_b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    run = with_b.select("*", *[F.sum(c).over(inner).alias(f"_r_{c}") for c in cols])
    j = run.join(offsets, group + ["_b"], "inner")
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_r_{c}")).alias(f"cum_{c}") for c in cols])
