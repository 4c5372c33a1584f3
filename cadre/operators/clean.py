"""Frame-level cleaning and coercion (F1-F13), one projection each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.functions.numeric import flag01
from cadre.functions.text import BLANK_TOKENS, clean_string, norm_header


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_frame(df: DataFrame, tokens: Sequence[str] = BLANK_TOKENS) -> DataFrame:
    """headers normalised, then on every string column blank tokens ->
    null, strip, '' -> null."""
    names = [norm_header(c) for c in df.columns]
    strings = set(_string_cols(df))
    return df.select(*[
        (clean_string(F.col(f"`{c}`"), tokens) if c in strings else F.col(f"`{c}`")).alias(n)
        for c, n in zip(df.columns, names)])


def coerce_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """flag columns numeric, null -> 0, clipped to [0, 1]."""
    fs = set(flags)
    return df.select(*[(flag01(F.col(f"`{c}`")) if c in fs else F.col(f"`{c}`")).alias(c)
                       for c in df.columns])


def advisor_or_production(df: DataFrame, title: str = "Job Title", role: str = "Role Type",
                          title_word: str = "advisor", role_value: str = "Production") -> DataFrame:
    """F8: title contains ``title_word`` (case-insensitive, null -> false) OR
    role equals ``role_value``."""
    t = F.coalesce(F.lower(F.col(f"`{title}`")).contains(title_word.lower()), F.lit(False))
    r = F.coalesce(F.col(f"`{role}`") == F.lit(role_value), F.lit(False))
    return df.filter(t | r)


def not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows where every listed column is present."""
    return df.na.drop(how="any", subset=list(cols))

