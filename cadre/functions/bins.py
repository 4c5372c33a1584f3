"""Binning, date and label expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Site-distance bins, right-closed: (-1,5] (5,15] (15,30] (30,60] (60,9999]
DIST_EDGES = [-1, 5, 15, 30, 60, 9999]
DIST_LABELS = ["<5km", "5-15km", "15-30km", "30-60km", ">60km"]
# Tenure bins in months, right-closed: (-1,3] (3,6] (6,12] (12,24] (24,60] (60,9999]
TENURE_EDGES = [-1, 3, 6, 12, 24, 60, 9999]
TENURE_LABELS = ["<3m", "3-6m", "6-12m", "1-2yr", "2-5yr", ">5yr"]
# Days per month used for tenure, and the default reference date.
DAYS_PER_MONTH = 30.44
TENURE_REF_DATE = "2026-06-23"
# STAR rating -> ordinal class, and its labels.
STAR_MAP = {1: 0, 3: 1, 4: 2, 5: 3}
STAR_LABELS = ["STAR 1 (At-Risk)", "STAR 3", "STAR 4", "STAR 5 (Top)"]
# KPI tier labels by class index.
TIER_LABELS = ["At-Risk", "Developing", "High Performer"]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def right_closed_bins(c, edges: Sequence[float], labels: Sequence[str],
                      null_label: str | None = None) -> Column:
    """Label by right-closed bins ``(e0,e1], (e1,e2], ...``.

    Out-of-range and null values get ``null_label`` (the reference emits the
    text 'nan'; null by default here).  ``Bucketizer`` is left-closed, so it
    is not used.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    col = _c(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (col > F.lit(float(lo))) & (col <= F.lit(float(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(null_label).cast("string"))


def dist_bucket(c, null_label: str | None = None) -> Column:
    return right_closed_bins(c, DIST_EDGES, DIST_LABELS, null_label)


def tenure_bucket(c, null_label: str | None = None) -> Column:
    return right_closed_bins(c, TENURE_EDGES, TENURE_LABELS, null_label)


def parse_timestamp(c, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
                                                  "MM/dd/yyyy", "M/d/yyyy")) -> Column:
    """Text -> timestamp_ntz with coercion: first declared format that parses."""
    col = _c(c)
    parsed = [F.try_to_timestamp(col.cast("string"), F.lit(fmt)) for fmt in formats]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def tenure_months(hire, ref_date: str = TENURE_REF_DATE) -> Column:
    """floor-days(ref - hire) / 30.44, floored at 0; time of day counts.

    ``hire`` must be a timestamp (either kind); ``datediff`` would ignore a
    time part, so the difference is taken in microseconds.
    """
    h = _c(hire).cast("timestamp_ntz")
    ref = F.lit(ref_date).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", h, ref)
    days = F.floor(micros / F.lit(86_400_000_000))
    return F.greatest(days / F.lit(DAYS_PER_MONTH), F.lit(0.0))


def tier_of(c, p33, p67) -> Column:
    """3-way right-closed tier: <=p33 -> 0, <=p67 -> 1, else 2; null stays null."""
    col = _c(c)
    p33c = p33 if isinstance(p33, Column) else F.lit(float(p33))
    p67c = p67 if isinstance(p67, Column) else F.lit(float(p67))
    return (F.when(col.isNull(), F.lit(None).cast("int"))
            .when(col <= p33c, F.lit(0))
            .when(col <= p67c, F.lit(1))
            .otherwise(F.lit(2)))


def _lookup(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        cond = col == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def star_to_ordinal(c) -> Column:
    """STAR {1,3,4,5} -> {0,1,2,3}; anything else (2, text) -> null."""
    from cadre.functions.numeric import as_number
    return _lookup(as_number(_c(c)), {float(k): v for k, v in STAR_MAP.items()})


def ordinal_to_star(c) -> Column:
    return _lookup(_c(c), {v: k for k, v in STAR_MAP.items()})


def label_name(c, labels: Sequence[str] = TIER_LABELS) -> Column:
    """Class index -> label text (null outside the list)."""
    arr = F.array(*[F.lit(x) for x in labels])
    idx = _c(c).cast("int")
    return F.when((idx >= 0) & (idx < len(labels)), F.element_at(arr, idx + 1))
