"""Registered split and encoder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadre.operators import encode, split
from cadre.plans import sql_views as V
from cadre.plans import views
from cadre.plans.catalog import register, rounded
from cadre.sources.tables import table

_H = split.hash_order_sql("doc_id")
_RANKED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H}, doc_id) AS rk,
                  count(*) OVER (PARTITION BY quality) AS n FROM cat)"""
_NT = "round(CAST(0.2 AS DOUBLE) * n)"
_SPLIT = f"""s AS (SELECT *, CASE WHEN rk <= {_NT} THEN 'test'
                         WHEN rk <= {_NT} + round(CAST(0.15 AS DOUBLE) * (n - {_NT})) THEN 'val'
                         ELSE 'train' END AS split FROM r)"""
_FOLDS = "f AS (SELECT *, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r)"


def _split(spark, d):
    return split.stratified_split(views.cat(spark, d), "quality", "doc_id", 0.2, 0.15)


@register("stratified_split", f"""
WITH {V.CAT}, {_RANKED}, {_SPLIT}
SELECT doc_id, quality, split FROM s
""")
def stratified_split(spark, d):
    """M1 80/20 stratified split + M2 inner 85/15 validation split by label."""
    return _split(spark, d).select("doc_id", "quality", "split")


@register("stratified_folds", f"""
WITH {V.CAT}, {_RANKED}, {_FOLDS}
SELECT doc_id, quality, fold FROM f
""")
def stratified_folds(spark, d):
    """M3: stratified 5-fold assignment."""
    return split.stratified_folds(views.cat(spark, d), "quality", "doc_id", 5) \
        .select("doc_id", "quality", "fold")


def _enc_sql(tr: str, cols=("lang", "source")) -> str:
    stats = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS feature, coalesce(CAST({c} AS STRING), 'nan') AS category, count(*) AS n, "
        f"avg(CAST(quality AS DOUBLE)) AS mean FROM {tr} GROUP BY 2" for c in cols)
    return f"""g AS (SELECT avg(CAST(quality AS DOUBLE)) AS g FROM {tr}),
st AS ({stats}),
enc AS (SELECT feature, category, (n * mean + 10 * g) / (n + 10) AS enc FROM st, g)"""


@register("target_encode", f"""
WITH {V.CAT}, {_RANKED}, {_SPLIT},
tr AS (SELECT * FROM s WHERE split <> 'test'),
{_enc_sql('tr')}
SELECT s.doc_id, s.split,
       (floor(floor((coalesce(el.enc, g.g)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS lang_te,
       (floor(floor((coalesce(es.enc, g.g)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS source_te
FROM s CROSS JOIN g
LEFT JOIN enc el ON el.feature = 'lang' AND el.category = coalesce(s.lang, 'nan')
LEFT JOIN enc es ON es.feature = 'source' AND es.category = coalesce(s.source, 'nan')
""")
def target_encode(spark, d):
    """Smoothed target encoding (s=10) fitted on the training part
    of the stratified split, applied to every row (J6)."""
    s = _split(spark, d)
    model = encode.fit_target_encoder(s.filter(F.col("split") != "test"), ["lang", "source"], "quality")
    out = model.transform(s, suffix="_te")
    return rounded(out.select("doc_id", "split", "lang_te", "source_te"))


@register("target_encode_unseen", f"""
WITH {V.CAT},
tr AS (SELECT * FROM cat WHERE lang IN ('en', 'de')),
{_enc_sql('tr', ('lang',))}
SELECT c.doc_id, c.lang, (floor(floor((coalesce(el.enc, g.g)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS lang_te
FROM cat c CROSS JOIN g
LEFT JOIN enc el ON el.feature = 'lang' AND el.category = coalesce(c.lang, 'nan')
""")
def target_encode_unseen(spark, d):
    """E1 transform with categories unseen at fit time -> global mean
    (fit on English and German documents, applied to all)."""
    c = views.cat(spark, d)
    model = encode.fit_target_encoder(c.filter(F.col("lang").isin("en", "de")), ["lang"], "quality")
    return rounded(model.transform(c, suffix="_te").select("doc_id", "lang", "lang_te"))


def _oof_sql(cols=("lang", "source")) -> str:
    cf = "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS feature, coalesce(CAST({c} AS STRING), 'nan') AS category, fold, count(*) AS ncf, "
        f"sum(CAST(quality AS DOUBLE)) AS scf FROM f GROUP BY 2, 3" for c in cols)
    sel = ",\n       ".join(
        f"(floor(floor((coalesce(((c_{c}.sc - coalesce(f_{c}.scf, 0)) + 10 * gf.g) / "
        f"((c_{c}.nc - coalesce(f_{c}.ncf, 0)) + 10), gf.g)) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS {c}_oof" for c in cols)
    joins = "\n".join(
        f"LEFT JOIN cc c_{c} ON c_{c}.feature = '{c}' AND c_{c}.category = coalesce(f.{c}, 'nan')\n"
        f"LEFT JOIN cf f_{c} ON f_{c}.feature = '{c}' AND f_{c}.category = coalesce(f.{c}, 'nan') "
        f"AND f_{c}.fold = f.fold" for c in cols)
    return f"""ft AS (SELECT fold, count(*) AS nf, sum(CAST(quality AS DOUBLE)) AS sf FROM f GROUP BY fold),
tot AS (SELECT sum(nf) AS na, sum(sf) AS sa FROM ft),
gf AS (SELECT fold, (sa - sf) / CAST(na - nf AS DOUBLE) AS g FROM ft, tot),
cf AS ({cf}),
cc AS (SELECT feature, category, sum(ncf) AS nc, sum(scf) AS sc FROM cf GROUP BY 1, 2)
SELECT f.doc_id, f.fold,
       {sel}
FROM f JOIN gf ON f.fold = gf.fold
{joins}"""


@register("target_encode_oof", f"""
WITH {V.CAT}, {_RANKED}, {_FOLDS},
{_oof_sql()}
""")
def target_encode_oof(spark, d):
    """Out-of-fold target encoding over stratified 5 folds."""
    f = split.stratified_folds(views.cat(spark, d), "quality", "doc_id", 5)
    out = encode.target_encode_oof(f, ["lang", "source"], "quality", "fold")
    return rounded(out.select("doc_id", "fold", "lang_oof", "source_oof"))


_CUST_TRAIN = "c_mktsegment <> 'MACHINERY'"


@register("ordinal_encode", f"""
WITH tr AS (SELECT * FROM customer WHERE {_CUST_TRAIN}),
seg AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT coalesce(CAST(c_mktsegment AS STRING), 'nan') AS v FROM tr)),
nat AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT coalesce(CAST(c_nationkey AS STRING), 'nan') AS v FROM tr))
SELECT c.c_custkey, coalesce(seg.code, -1) AS c_mktsegment_ord, coalesce(nat.code, -1) AS c_nationkey_ord
FROM customer c
LEFT JOIN seg ON seg.v = coalesce(CAST(c.c_mktsegment AS STRING), 'nan')
LEFT JOIN nat ON nat.v = coalesce(CAST(c.c_nationkey AS STRING), 'nan')
""")
def ordinal_encode(spark, d):
    """Sorted-category ordinal codes fitted on non-machinery customers;
    an unseen category (MACHINERY) gets -1."""
    c = table(spark, d, "customer")
    out = encode.ordinal_encode(c.filter(F.col("c_mktsegment") != "MACHINERY"), c,
                                ["c_mktsegment", "c_nationkey"])
    return out.select("c_custkey", "c_mktsegment_ord", "c_nationkey_ord")


@register("standardise", f"""
WITH tr AS (SELECT * FROM customer WHERE {_CUST_TRAIN}),
st AS (SELECT avg(coalesce(c_acctbal, 0)) AS m1, stddev_pop(coalesce(c_acctbal, 0)) AS s1,
              avg(CAST(coalesce(c_nationkey, 0) AS DOUBLE)) AS m2,
              stddev_pop(CAST(coalesce(c_nationkey, 0) AS DOUBLE)) AS s2 FROM tr)
SELECT c_custkey,
       (floor(floor(((coalesce(c_acctbal, 0) - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS c_acctbal_z,
       (floor(floor(((coalesce(c_nationkey, 0) - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6) AS c_nationkey_z
FROM customer, st
""")
def standardise(spark, d):
    """E5: null -> 0 then z-score with the population sd of the fit rows."""
    c = table(spark, d, "customer")
    out = encode.standardise(c.filter(F.col("c_mktsegment") != "MACHINERY"), c,
                             ["c_acctbal", "c_nationkey"])
    return rounded(out.select("c_custkey", "c_acctbal_z", "c_nationkey_z"))
