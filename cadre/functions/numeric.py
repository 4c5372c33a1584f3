"""Numeric coercion with pandas ``to_numeric(errors='coerce')`` semantics.

Spark's ``try_cast('1d' as double)`` returns 1.0 and ``'nan'`` becomes NaN,
and plain ``cast`` raises under ANSI mode; so text is trimmed, matched
against a decimal pattern and only then cast.  NaN never leaves this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.functions.text import utrim

# Decimal literal accepted as a number (after trimming).
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NUMBER_CHARS = "0123456789+-.eE"
INF_RE = r"^[+-]?(inf|infinity)$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c, allow_inf: bool = False) -> Column:
    """Text -> double; unparsable, empty, 'nan' -> null.

    ``inf`` is null unless ``allow_inf`` (one infinite value ruins a mean).
    """
    return trimmed_to_double(utrim(_c(c).cast("string")), allow_inf)


def trimmed_to_double(txt: Column, allow_inf: bool = False) -> Column:
    """:func:`to_double` of text that is trimmed already.  ``txt`` occurs
    twice in the result: a column that holds it is trimmed once."""
    # Same accept set as NUMBER_RE: only digits, sign, point and exponent
    # characters may appear (this rejects Java's 'd'/'f' suffixes, hex,
    # 'NaN', 'Infinity'); try_cast rejects malformed arrangements of them
    # and '', and none of them is NaN.
    only_number_chars = F.translate(txt, NUMBER_CHARS, "") == F.lit("")
    parsed = F.when(only_number_chars, txt.try_cast("double"))
    if allow_inf:
        low = F.lower(txt)
        parsed = parsed.when(low.rlike(INF_RE),
                             F.when(low.startswith("-"), F.lit(float("-inf")))
                             .otherwise(F.lit(float("inf"))))
    return parsed


def nan_to_null(c) -> Column:
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def as_double(df, name: str, allow_inf: bool = False) -> Column:
    """Double view of column ``name`` whatever its type (string or numeric)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return to_double(name, allow_inf)
    col = F.col(name).cast("double")
    col = nan_to_null(col)
    if not allow_inf:
        col = F.when(F.abs(col) == float("inf"), F.lit(None).cast("double")).otherwise(col)
    return col


def as_number(c) -> Column:
    """Double from a string or numeric column expression (numbers go through
    their text form, so both kinds obey the same parse rules)."""
    return to_double(c)


def parses(c) -> Column:
    """1 when the value coerces to a number, else 0 (used for type sniffing)."""
    return to_double(c).isNotNull().cast("int")


def clip(c, lo=None, hi=None) -> Column:
    col = _c(c)
    if lo is not None:
        col = F.greatest(col, F.lit(lo))
    if hi is not None:
        col = F.least(col, F.lit(hi))
    return col


def flag01(c) -> Column:
    """Flag coercion: numeric, null -> 0, clipped to [0, 1]."""
    return clip(F.coalesce(to_double(c), F.lit(0.0)), 0.0, 1.0)
