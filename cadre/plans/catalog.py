"""Registered queries: Spark plan + DuckDB oracle SQL per key.

Every query reads the given tables (through ``cadre.plans.views``) in full
and runs the library operator on them.  Doubles are rounded to 6 decimals at
the very end, in both engines, so the value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _floor(v):
    """Exact floor of a double using only IEEE operations (no long cast)."""
    t = v - (v % F.lit(1.0))  # truncation toward zero; fmod is exact
    return F.when((v < 0) & (t != v), t - F.lit(1.0)).otherwise(t)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (output hygiene for the oracle
    compare) as ``floor(floor(x*1e9+0.5)/1e9*1e6+0.5)/1e6``.

    Plain IEEE multiply/add/floor/divide, so Spark and the SQL twin
    (``sql_views.r6``) produce bit-identical doubles; the 9-place step absorbs
    float-summation noise between the engines first.  Staged over three
    projections so each step's floor references a plain column: nesting the expressions would
    copy every (possibly large) input expression ~25 times per column.
    """
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not dbl:
        return df

    def stage(frame, fn):
        return frame.select(*[(fn(F.col(f"`{c}`")).alias(c) if c in dbl else F.col(f"`{c}`"))
                              for c in frame.columns])

    a = stage(df, lambda c: c.cast("double") * F.lit(1e9) + F.lit(0.5))
    b = stage(a, lambda c: _floor(c) / F.lit(1e9) * F.lit(1e6) + F.lit(0.5))
    return stage(b, lambda c: _floor(c) / F.lit(1e6))


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"cadre.plans.{mod}")


MODULES = ["q_rollup", "q_clean", "q_roster", "q_features", "q_labels", "q_encode", "q_metrics", "q_explain", "q_score", "q_sources", "q_ml", "q_models"]
