"""Roster union, priority dedup, enrichment joins and join coverage.

Dedup is a grouped ``min_by`` over a priority struct rather than a
``row_number`` window: the aggregation combines map-side, so a key holding a
third of all rows still reaches the shuffle as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadre.functions.text import email_key, norm_key, valid_key
from cadre.operators.columns import shared_and_only


def _q(c: str):
    return F.col(f"`{c}`")


def first_per_key(df: DataFrame, key: str, order: Sequence[str] = (),
                  priority: str | None = None) -> DataFrame:
    """One row per ``key``; lowest ``priority`` wins, then ``order``
    columns, then the row's own values (deterministic tie-break)."""
    rest = [c for c in df.columns if c != key]
    ordering = ([_q(priority)] if priority else []) + [_q(o) for o in order] + [_q(c) for c in rest]
    picked = df.groupBy(_q(key)).agg(
        F.min_by(F.struct(*[_q(c) for c in rest]), F.struct(*ordering)).alias("_row"))
    return picked.select(_q(key), *[F.col("_row")[c].alias(c) for c in rest])


def union_sources(a: DataFrame, b: DataFrame, key: str = "emp_id",
                  names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """UNION ALL of two sources on their shared columns plus ``_source``
    and ``_src_order`` (0 for the priority source)."""
    shared, _ = shared_and_only(a.columns, b.columns)
    cols = [key] + [c for c in shared if c != key]
    a2 = a.select(*[_q(c) for c in cols]).withColumn("_source", F.lit(names[0])).withColumn("_src_order", F.lit(0))
    b2 = b.select(*[_q(c) for c in cols]).withColumn("_source", F.lit(names[1])).withColumn("_src_order", F.lit(1))
    return a2.unionByName(b2)


def union_dedup(a: DataFrame, b: DataFrame, key: str = "emp_id",
                names: tuple[str, str] = ("a", "b"), order: Sequence[str] = ()) -> DataFrame:
    """W1 + W2: keys normalised (F4), blank keys dropped (F3), union on
    shared columns, one row per key with source ``a`` first."""
    a = a.withColumn(key, norm_key(_q(key))).filter(valid_key(_q(key)))
    b = b.withColumn(key, norm_key(_q(key))).filter(valid_key(_q(key)))
    u = union_sources(a, b, key, names)
    return first_per_key(u, key, order=order, priority="_src_order").drop("_src_order")


def enrich(union: DataFrame, b: DataFrame, key: str = "emp_id", a_columns: Sequence[str] = (),
           order: Sequence[str] = (), suffix: str = "_cdm") -> DataFrame:
    """Left join the B-only columns (first row per key in B) onto the
    union; a clash with an existing column gets ``suffix``."""
    b = b.withColumn(key, norm_key(_q(key))).filter(valid_key(_q(key)))
    only = [c for c in b.columns if c not in set(a_columns) and c != key]
    extras = first_per_key(b.select(_q(key), *[_q(c) for c in only]), key, order=order)
    renamed = [(_q(c).alias(c + suffix) if c in union.columns else _q(c)) for c in only]
    return union.join(extras.select(_q(key), *renamed), key, "left")


def left_join_rollup(roster: DataFrame, rollup: DataFrame, roster_key: str,
                     rollup_key: str, how_key: str = "emp") -> DataFrame:
    """Roster LEFT JOIN a per-person rollup on a normalised key
    (``emp``: NBSP-free stripped id; ``email``: stripped lower-case).

    Both sides are one row per person; Spark picks broadcast (small rollup,
    size known from statistics) or a sort-merge join — AQE re-plans at run
    time with measured sizes.
    """
    norm = norm_key if how_key == "emp" else email_key
    r = roster.withColumn("_jk", norm(_q(roster_key)))
    k = rollup.withColumnRenamed(rollup_key, "_jk")
    return r.join(k, "_jk", "left").drop("_jk")


def join_coverage(joined: DataFrame, probe_col: str, label: str) -> DataFrame:
    """Total rows, rows that found a match (``probe_col`` not null), %."""
    return joined.agg(
        F.lit(label).alias("join"),
        F.count(F.lit(1)).alias("total"),
        F.count(_q(probe_col)).alias("joined"),
    ).withColumn("pct", F.try_divide(F.col("joined") * 100.0, F.col("total").cast("double")))
