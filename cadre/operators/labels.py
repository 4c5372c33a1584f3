"""Labels: exact tercile cut points, tiers, label maps, label summaries
(A18-A20, C12-C14, J7, F7)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadre.functions.bins import TIER_LABELS, label_name, star_to_ordinal, tier_of
from cadre.functions.numeric import as_double
from cadre.operators.windows import running_sums
from cadre.session import cut_lineage


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> tuple[int, list[float]]:
    """Exact linear-interpolation quantiles (Spark ``percentile`` semantics).

    One plan for every size: counts per distinct value (so ties collapse
    before anything moves), their bucketed running sums, and the values at
    the wanted ranks.  Returns ``(n, [quantile per prob])``.
    """
    v = df.select(as_double(df, col).alias("v")).filter(F.col("v").isNotNull())
    counts = cut_lineage(v.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    if n == 0:
        return 0, [float("nan")] * len(probs)
    places = [(p * (n - 1), math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in probs]
    ranks = sorted({r for _, lo, hi in places for r in (lo, hi)})
    upto = running_sums(counts, [], "v", ["n"])
    got = dict(zip(ranks, upto.agg(*[F.min(F.when(F.col("cum_n") > r, F.col("v"))) for r in ranks]).first()))
    out = []
    for pos, lo, hi in places:
        a, b = got[lo], got[hi]
        out.append(a if lo == hi or a == b else (hi - pos) * a + (pos - lo) * b)
    return n, out


def tercile_cuts(df: DataFrame, col: str, min_values: int = 30) -> tuple[float, float, int]:
    """(p33, p67, n) of the non-null values; needs ``min_values``."""
    n, (p33, p67) = exact_quantiles(df, col, [1.0 / 3.0, 2.0 / 3.0])
    if n < min_values:
        raise ValueError(f"only {n} non-null values in {col!r}; need >= {min_values} for terciles")
    return p33, p67, n


def with_tiers(df: DataFrame, col: str, p33: float, p67: float, out: str = "tier",
               labels: Sequence[str] = TIER_LABELS) -> DataFrame:
    """C12 + C14: right-closed tier (null stays null) and its label.

    Equal cut points cannot split three tiers and raise.
    """
    if p33 == p67:
        raise ValueError(f"tercile cut points are equal ({p33}); tiers are not separable")
    v = as_double(df, col)
    return (df.withColumn(out, tier_of(v, p33, p67))
            .withColumn(f"{out}_label", label_name(F.col(out), labels)))


def tercile_tiers(df: DataFrame, col: str, out: str = "tier", **kw) -> tuple[DataFrame, dict]:
    """A18 + C12: two-phase plan — the cut-point action, then a projection
    with the cut points as literals.  Returns (frame, tier_info)."""
    p33, p67, n = tercile_cuts(df, col, **kw)
    return with_tiers(df, col, p33, p67, out), {"p33": p33, "p67": p67, "n_values": n}


def tier_summary(tiered: DataFrame, tier: str = "tier",
                 labels: Sequence[str] = TIER_LABELS) -> DataFrame:
    """A19 + A20: per-class counts plus ``n_labeled``, ``n_total`` and
    ``pct_labeled`` (one aggregation; the totals come from a window over
    the handful of class rows)."""
    counts = tiered.groupBy(F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    return (counts
            .withColumn("n_total", F.sum("n").over(w))
            .withColumn("n_labeled", F.sum(F.when(F.col("tier").isNotNull(), F.col("n"))).over(w))
            .withColumn("pct_labeled", F.col("n_labeled") / F.col("n_total").cast("double"))
            .withColumn("tier_label", label_name(F.col("tier"), labels)))


def star_labels(df: DataFrame, star: str, out: str = "_y", keep_only_valid: bool = True) -> DataFrame:
    """J7/C13 + F7: STAR {1,3,4,5} -> {0,1,2,3}; others null and (by default)
    filtered out."""
    res = df.withColumn(out, star_to_ordinal(F.col(f"`{star}`")))
    return res.filter(F.col(out).isNotNull()) if keep_only_valid else res
