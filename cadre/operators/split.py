"""Reproducible stratified splits and folds (M1-M3).

Rows are ordered inside each class by a portable hash of their id (the same
integer arithmetic runs in Spark and in SQL), and the exact per-class rank
decides the split: ``test`` = the first ``round(test_size * n_class)`` rows.

A ``row_number()`` window partitioned by class would put a whole class —
a third of the table for three tiers — into one task.  Instead the hash
range is cut into buckets: per (class, bucket) counts give each bucket's
rank offset (a small table: classes x buckets), and the row number is only
computed inside a (class, bucket) window.  Same ranks, bounded tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A prime modulus below 2^31 and two multipliers: all products of reduced
# values stay below 2^62, so the same 64-bit arithmetic runs in Spark and SQL.
HASH_MOD = 2147483647
HASH_MULT = 1103515245
SEED_MULT = 48271
DEFAULT_SEED = 42


def _offset(seed: int) -> int:
    return (seed * SEED_MULT + 12345) % HASH_MOD


def hash_order(id_col, seed: int = DEFAULT_SEED):
    """Portable pseudo-random order key in [0, 2^31-1) for an integer id.

    The seed is added to the id before two rounds of ``x * x + m * x`` modulo
    a prime: unlike a linear step, which would only rotate one fixed order,
    each seed gives an order of its own.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    p = F.lit(HASH_MOD)
    x = F.pmod(F.pmod(c.cast("bigint"), p) + F.lit(_offset(seed)).cast("bigint"), p)
    for _ in range(2):
        x = F.pmod(F.pmod(x * x, p) + F.pmod(x * F.lit(HASH_MULT), p), p)
    return x


def hash_order_sql(id_col: str, seed: int = DEFAULT_SEED) -> str:
    """SQL twin of :func:`hash_order`."""
    p = HASH_MOD
    x = f"((((CAST({id_col} AS BIGINT) % {p}) + {p}) % {p} + {_offset(seed)}) % {p})"
    for _ in range(2):
        x = f"((({x} * {x}) % {p} + ({x} * {HASH_MULT}) % {p}) % {p})"
    return x


# Buckets over the hash range: fine enough that a (stratum, bucket) window
# holds ~n / (strata * 65536) rows even at 10^12 rows, and no count pass is
# needed to size them (empty buckets simply do not appear).
N_BUCKETS = 1 << 16


def rank_within(df: DataFrame, strata: Sequence[str], order_key: str, tie: str,
                n_buckets: int = N_BUCKETS) -> DataFrame:
    """Add ``_rank`` (1-based row number inside each stratum ordered by
    ``(order_key, tie)``) and ``_n`` (stratum size).

    ``order_key`` must be roughly uniform on [0, HASH_MOD) (see
    :func:`hash_order`).  The offsets table has at most strata x buckets
    rows (AQE broadcasts it when small, else shuffles).
    """
    strata = list(strata)
    b = F.floor(F.col(order_key) * F.lit(float(n_buckets)) / F.lit(float(HASH_MOD))).cast("int")
    with_b = df.withColumn("_b", b)
    counts = with_b.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    # windows over the counts: at most n_buckets rows for each stratum
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts
               .withColumn("_off", F.coalesce(F.sum("_nb").over(before), F.lit(0)))
               .withColumn("_n", F.sum("_nb").over(Window.partitionBy(*strata)))
               .drop("_nb"))
    inner = Window.partitionBy(*strata, "_b").orderBy(order_key, tie)
    ranked = with_b.withColumn("_rb", F.row_number().over(inner))
    # null-safe join on the strata (a null label is a stratum of its own)
    cond = [ranked[c].eqNullSafe(offsets[c]) for c in strata] + [ranked["_b"] == offsets["_b"]]
    j = ranked.join(offsets, cond, "inner")
    keep = [ranked[c] for c in df.columns]
    return j.select(*keep, (offsets["_off"] + ranked["_rb"]).alias("_rank"), offsets["_n"].alias("_n"))


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2,
                     val_size: float | None = 0.15, seed: int = DEFAULT_SEED,
                     out: str = "split", **kw) -> DataFrame:
    """M1 (+ M2): ``split`` = 'test' for the first ``round(test_size*n)``
    rows of each class, then 'val' for ``round(val_size * n_train)`` of the
    remaining rows (the inner validation split), else 'train'."""
    h = df.withColumn("_h", hash_order(id_col, seed))
    r = rank_within(h, [label], "_h", id_col, **kw)
    n_test = F.round(F.lit(float(test_size)) * F.col("_n"))
    split = F.when(F.col("_rank") <= n_test, F.lit("test"))
    if val_size:
        n_val = F.round(F.lit(float(val_size)) * (F.col("_n") - n_test))
        split = split.when(F.col("_rank") <= n_test + n_val, F.lit("val"))
    return r.withColumn(out, split.otherwise(F.lit("train"))).drop("_h", "_rank", "_n")


def sample_rows(df: DataFrame, id_col: str, n: int = 500, seed: int = DEFAULT_SEED) -> DataFrame:
    """A reproducible n-row sample (e.g. the explanation sample): the n
    smallest hash keys — a top-k that keeps only n rows per task."""
    return (df.withColumn("_h", hash_order(id_col, seed)).orderBy("_h", id_col).limit(n)
            .drop("_h"))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5,
                     seed: int = DEFAULT_SEED, out: str = "fold", **kw) -> DataFrame:
    """M3: fold = (rank - 1) mod k inside each class — every fold gets each
    class's rows within one of each other (StratifiedKFold sizes)."""
    h = df.withColumn("_h", hash_order(id_col, seed))
    r = rank_within(h, [label], "_h", id_col, **kw)
    return r.withColumn(out, ((F.col("_rank") - 1) % F.lit(k)).cast("int")).drop("_h", "_rank", "_n")


def permute_columns(df: DataFrame, cols: Sequence[str], id_col: str, seed: int = DEFAULT_SEED,
                    prefix: str = "perm_") -> DataFrame:
    """``df`` with ``{prefix}{col}``: the columns' values moved along one
    random cyclic order of all rows (by about a third of them), nulls included,
    so the multiset of each column is kept and no row keeps its own place."""
    ranked = rank_within(df.withColumn("_h", hash_order(id_col, seed)), [], "_h", id_col)
    step = F.greatest(F.floor(F.col("_n") / 3), F.lit(1))
    donor = ranked.select(((F.col("_rank") - 1 + step) % F.col("_n") + 1).alias("_rank"),
                          *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in cols])
    return ranked.join(donor, "_rank").drop("_h", "_rank", "_n")
