"""Registered cleaning / coercion / filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadre.functions import numeric, text
from cadre.operators import clean
from cadre.plans.catalog import register, rounded
from cadre.sources.tables import table

NBSP = "\u00a0"
# Whitespace characters the SQL twin strips (the test strings use only these).
SQL_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def _dirty_text():
    """Dirty text variants of ``event_type``, chosen by ``event_id % 8``."""
    et = F.col("event_type")
    r = F.col("event_id") % 8
    return (F.when(r == 0, F.concat(F.lit(" "), et, F.lit(" ")))
            .when(r == 1, F.lit("N/A"))
            .when(r == 2, F.lit(" N/A "))
            .when(r == 3, F.concat(F.lit(NBSP), et))
            .when(r == 4, F.lit(""))
            .when(r == 5, F.lit("-"))
            .when(r == 6, F.concat(F.upper(et), F.lit(NBSP + " ")))
            .otherwise(et))


_DIRTY_SQL = f"""CASE event_id % 8
   WHEN 0 THEN ' ' || event_type || ' '
   WHEN 1 THEN 'N/A'
   WHEN 2 THEN ' N/A '
   WHEN 3 THEN chr(160) || event_type
   WHEN 4 THEN ''
   WHEN 5 THEN '-'
   WHEN 6 THEN upper(event_type) || chr(160) || ' '
   ELSE event_type END"""
_TOKENS_SQL = ", ".join("'" + t.replace("'", "''") + "'" if t != NBSP else "chr(160)"
                        for t in text.BLANK_TOKENS)


@register("clean_strings", f"""
WITH d AS (SELECT event_id, {_DIRTY_SQL} AS raw FROM events),
c AS (SELECT event_id, raw,
             CASE WHEN raw IN ({_TOKENS_SQL}) THEN NULL ELSE trim(raw, {SQL_WS}) END AS s1
      FROM d)
SELECT event_id, raw,
       CASE WHEN s1 = '' THEN NULL ELSE s1 END AS cleaned,
       CASE WHEN raw IN ('', chr(160)) THEN NULL ELSE raw END AS fact_cleaned,
       trim(replace(raw, chr(160), ''), {SQL_WS}) AS key_norm,
       lower(trim(raw, {SQL_WS})) AS email_norm,
       coalesce(contains(lower(raw), 'er'), false) AS has_er,
       starts_with(raw, 'v') AS starts_v,
       regexp_replace(upper(trim(raw, {SQL_WS})), '[ \\-/.]', '_', 'g') AS safe
FROM c
""")
def clean_strings(spark, d):
    """F1 full clean, F2 fact clean, F4/F5 key normalising, C1-C4 string ops
    over dirty variants of ``events.event_type``."""
    e = table(spark, d, "events").select("event_id", _dirty_text().alias("raw"))
    raw = F.col("raw")
    return e.select(
        "event_id", "raw",
        text.clean_string(raw).alias("cleaned"),
        text.fact_clean(raw).alias("fact_cleaned"),
        text.norm_key(raw).alias("key_norm"),
        text.email_key(raw).alias("email_norm"),
        F.coalesce(F.lower(raw).contains("er"), F.lit(False)).alias("has_er"),
        raw.startswith("v").alias("starts_v"),
        text.safe_name(F.upper(text.utrim(raw))).alias("safe"),
    )


def _dirty_number():
    v = F.col("value").cast("string")
    k = F.get_json_object("props", "$.k")
    r = F.col("event_id") % 10
    return (F.when(r == 0, v)
            .when(r == 1, F.concat(F.lit(" "), v, F.lit(" ")))
            .when(r == 2, F.concat(v, F.lit("d")))
            .when(r == 3, F.lit("nan"))
            .when(r == 4, F.lit("inf"))
            .when(r == 5, F.concat(F.lit("1,"), k))
            .when(r == 6, F.concat(F.lit("+"), k))
            .when(r == 7, F.concat(k, F.lit("e-1")))
            .when(r == 8, F.concat(F.lit("."), k))
            .otherwise(F.lit("")))


@register("numeric_coerce", f"""
WITH d AS (
  SELECT event_id, CASE event_id % 10
     WHEN 0 THEN CAST(value AS VARCHAR)
     WHEN 1 THEN ' ' || CAST(value AS VARCHAR) || ' '
     WHEN 2 THEN CAST(value AS VARCHAR) || 'd'
     WHEN 3 THEN 'nan'
     WHEN 4 THEN 'inf'
     WHEN 5 THEN '1,' || json_extract_string(props, '$.k')
     WHEN 6 THEN '+' || json_extract_string(props, '$.k')
     WHEN 7 THEN json_extract_string(props, '$.k') || 'e-1'
     WHEN 8 THEN '.' || json_extract_string(props, '$.k')
     ELSE '' END AS raw
  FROM events),
t AS (SELECT event_id, trim(raw, {SQL_WS}) AS s FROM d)
SELECT event_id,
       CASE WHEN regexp_full_match(s, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
            THEN TRY_CAST(s AS DOUBLE) END AS num
FROM t
""")
def numeric_coerce(spark, d):
    """F6 numeric coercion (bad text, 'nan', 'inf', '1,000' -> null)."""
    e = table(spark, d, "events").select("event_id", _dirty_number().alias("raw"))
    return e.select("event_id", numeric.to_double("raw").alias("num"))


@register("yes_no_parse", """
WITH d AS (
  SELECT event_id, CASE event_id % 11
     WHEN 0 THEN 'Y' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'True'
     WHEN 4 THEN 'n' WHEN 5 THEN 'No ' WHEN 6 THEN '0' WHEN 7 THEN 'FALSE'
     WHEN 8 THEN 'maybe' WHEN 9 THEN NULL ELSE event_type END AS raw
  FROM events)
SELECT event_id, raw,
       CASE WHEN upper(trim(raw)) IN ('Y', 'YES', '1', 'TRUE') THEN 1
            WHEN upper(trim(raw)) IN ('N', 'NO', '0', 'FALSE') THEN 0 END AS passed
FROM d
""")
def yes_no_parse(spark, d):
    """F10 tri-state yes/no parse."""
    r = F.col("event_id") % 11
    raw = (F.when(r == 0, "Y").when(r == 1, " yes ").when(r == 2, "1").when(r == 3, "True")
           .when(r == 4, "n").when(r == 5, "No ").when(r == 6, "0").when(r == 7, "FALSE")
           .when(r == 8, "maybe").when(r == 9, F.lit(None).cast("string"))
           .otherwise(F.col("event_type")))
    e = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", "raw", text.yes_no("raw").alias("passed"))


@register("row_filter_disjunction", """
WITH p AS (
  SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS title,
         p_brand AS role, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price
  FROM part)
SELECT p_partkey, title, role, price FROM p
WHERE (coalesce(contains(lower(title), 'ring'), false) OR coalesce(role = 'Brand#2', false))
  AND price IS NOT NULL
""")
def row_filter_disjunction(spark, d):
    """F8 disjunctive filter (title contains a word, case-insensitive, null ->
    false; OR role equals a value) then F9 not-null filter."""
    p = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("title"),
        F.col("p_brand").alias("role"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_retailprice")).alias("price"))
    f = clean.advisor_or_production(p, title="title", role="role", title_word="Ring",
                                    role_value="Brand#2")
    return rounded(clean.not_null(f, ["price"]))
