"""String column expressions: Unicode trim, blank tokens, key normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Tokens turned into null by the full cleaning pass (before stripping).
BLANK_TOKENS = ["", " ", "\u00a0", "N/A", "n/a", "NA", "None", "none", "#N/A", "-"]
# Tokens a default pandas CSV read turns into missing values (19 tokens).
READ_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Tokens the fact readers turn into null (empty string and a lone NBSP).
FACT_BLANK_TOKENS = ["", "\u00a0"]
# Yes/no parsing of a pass flag: these upper-cased values map to 1 / 0.
YES_TOKENS = ["Y", "YES", "1", "TRUE"]
NO_TOKENS = ["N", "NO", "0", "FALSE"]
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes (Unicode whitespace incl. NBSP).
WHITESPACE = ("\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Strip leading/trailing Unicode whitespace, NBSP included (Spark ``trim``
    only strips ASCII spaces).  ``btrim`` with a character set: no regex."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def null_if_in(c, tokens) -> Column:
    """Null when the value is one of ``tokens`` (exact match)."""
    col = _c(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


def clean_string(c, tokens=BLANK_TOKENS) -> Column:
    """Full value clean: blank tokens -> null, then strip, then '' -> null.

    The order matters: ``' N/A '`` is not a token before stripping, so it
    survives as ``'N/A'``.
    """
    stripped = utrim(null_if_in(c, tokens))
    return F.when(stripped == "", F.lit(None).cast("string")).otherwise(stripped)


def fact_clean(c) -> Column:
    """Fact-file clean: only '' and a lone NBSP become null."""
    return null_if_in(c, FACT_BLANK_TOKENS)


def norm_key(c) -> Column:
    """Employee-id key: drop every NBSP, then strip."""
    return utrim(F.regexp_replace(_c(c).cast("string"), "\u00a0", ""))


def email_key(c) -> Column:
    """Email key: strip then lower-case."""
    return F.lower(utrim(_c(c).cast("string")))


def valid_key(c) -> Column:
    """Predicate: key is not null, not '' and not the text 'nan'."""
    col = _c(c)
    return col.isNotNull() & (col != "") & (F.lower(col) != "nan")


def yes_no(c) -> Column:
    """Tri-state yes/no parse: 1, 0 or null for anything else."""
    v = F.upper(utrim(_c(c).cast("string")))
    return (F.when(v.isin(YES_TOKENS), F.lit(1))
            .when(v.isin(NO_TOKENS), F.lit(0))
            .otherwise(F.lit(None).cast("int")))


# Characters that a column-safe name replaces by "_"; "." only on demand.
UNSAFE, DOT = " -/", "."


def safe_name(c, with_dot: bool = True) -> Column:
    """Column-safe metric name: space, '-', '/' (and '.') become '_'."""
    unsafe = UNSAFE + DOT if with_dot else UNSAFE
    return F.translate(_c(c), unsafe, "_" * len(unsafe))


def safe_name_py(name: str, with_dot: bool = True) -> str:
    """Driver-side twin of :func:`safe_name` for plan-time column names."""
    return str(name).translate({ord(x): "_" for x in (UNSAFE + DOT if with_dot else UNSAFE)})


def norm_header(name: str) -> str:
    """Header normalise: NBSP -> space, then strip."""
    return name.replace("\u00a0", " ").strip()
