"""DuckDB SQL twins of ``cadre.plans.views`` (used by the oracle queries)."""

from cadre.operators.split import hash_order_sql


def r6(expr: str) -> str:
    """SQL twin of ``catalog.rounded`` (same IEEE operations)."""
    return f"(floor(floor(({expr}) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6)"


KPI = """kpi AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS advisor,
         strftime(l_shipdate, '%Y-%m') AS month,
         p_name AS metric,
         l_quantity AS score,
         CASE WHEN l_tax = 0 THEN NULL ELSE 4 * l_quantity END AS ptg,
         (CASE WHEN l_tax = 0 THEN NULL ELSE 4 * l_quantity END) * l_discount AS wptg
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SC = """sc AS (
  SELECT lower(trim(' User' || CAST(user_id AS VARCHAR) || '@Example.com ')) AS email_lower,
         ts, event_id,
         value AS ptg,
         CAST(event_id % 100 AS DOUBLE) AS rank,
         CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS DOUBLE) AS quartile,
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS DOUBLE) AS consec_failing,
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS DOUBLE) AS met_count,
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS DOUBLE) AS fail_count,
         CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS passed
  FROM events)"""

ROSTER_A = """ra AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS emp_id, s_name AS name, s_nationkey AS nationkey,
         s_acctbal AS acctbal
  FROM supplier)"""

ROSTER_B = """rb AS (
  SELECT CAST(c_custkey AS VARCHAR) AS emp_id, c_name AS name, c_nationkey AS nationkey,
         c_acctbal AS acctbal, c_mktsegment,
         'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email
  FROM customer)"""

CAT = """cat AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

PRED = CAT + """,
pred AS (
  SELECT doc_id AS row_id,
         CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS label,
         CASE WHEN (1 + doc_id % 7) >= (1 + doc_id % 5) AND (1 + doc_id % 7) >= (1 + n_chars % 9) THEN 0
              WHEN (1 + doc_id % 5) >= (1 + n_chars % 9) THEN 1 ELSE 2 END AS prediction,
         (1 + doc_id % 7) / CAST((1 + doc_id % 7) + (1 + doc_id % 5) + (1 + n_chars % 9) AS DOUBLE) AS p0,
         (1 + doc_id % 5) / CAST((1 + doc_id % 7) + (1 + doc_id % 5) + (1 + n_chars % 9) AS DOUBLE) AS p1,
         (1 + n_chars % 9) / CAST((1 + doc_id % 7) + (1 + doc_id % 5) + (1 + n_chars % 9) AS DOUBLE) AS p2
  FROM cat)"""

KEY_OK = "advisor IS NOT NULL AND advisor <> '' AND lower(advisor) <> 'nan'"

# Explanation inputs: advisor features (top-30 metric means, long), advisor
# tiers (terciles of mean PTG) and tier-conditional coefficients.
EXPLAIN = KPI + f""",
k AS MATERIALIZED (SELECT * FROM kpi WHERE {KEY_OK}),
cnt AS (SELECT metric, count(*) AS n_rows FROM kpi WHERE metric IS NOT NULL GROUP BY metric),
top AS (SELECT metric FROM cnt ORDER BY n_rows DESC, metric LIMIT 30),
mm AS MATERIALIZED (SELECT advisor, regexp_replace(metric, '[ \\-/.]', '_', 'g') AS ms,
              avg(ptg) AS ptg_avg, avg(wptg) AS wptg_avg, avg(score) AS score_avg
       FROM k WHERE metric IN (SELECT metric FROM top) GROUP BY advisor, metric),
feat AS MATERIALIZED (SELECT CAST(advisor AS BIGINT) AS row_id, ms || '_ptg_avg' AS feature, ptg_avg AS x FROM mm
         UNION ALL SELECT CAST(advisor AS BIGINT), ms || '_wptg_avg', wptg_avg FROM mm
         UNION ALL SELECT CAST(advisor AS BIGINT), ms || '_score_avg', score_avg FROM mm),
roll AS (SELECT advisor, avg(ptg) AS v FROM k GROUP BY advisor),
cuts AS (SELECT quantile_cont(v, CAST(1 AS DOUBLE) / 3) AS p33,
                quantile_cont(v, CAST(2 AS DOUBLE) / 3) AS p67 FROM roll WHERE v IS NOT NULL),
tiers AS (SELECT CAST(advisor AS BIGINT) AS row_id,
                 CASE WHEN v <= p33 THEN 0 WHEN v <= p67 THEN 1 ELSE 2 END AS class
          FROM roll, cuts WHERE v IS NOT NULL),
tr AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {hash_order_sql('row_id')}, row_id) AS rk,
              count(*) OVER (PARTITION BY class) AS n FROM tiers),
sp AS MATERIALIZED (SELECT row_id, class, CASE WHEN rk <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
       FROM tr),
ftr AS (SELECT f.row_id, f.feature, f.x, sp.class FROM feat f JOIN sp ON f.row_id = sp.row_id
        WHERE sp.split = 'train'),
fte AS (SELECT f.* FROM feat f JOIN sp ON f.row_id = sp.row_id WHERE sp.split = 'test'),
fmean AS MATERIALIZED (SELECT feature, avg(x) AS mean FROM ftr GROUP BY feature),
cmean AS (SELECT class, feature, avg(x) AS cmean FROM ftr GROUP BY class, feature),
coef AS MATERIALIZED (SELECT c.class, c.feature, coalesce(c.cmean - m.mean, 0.0) AS coef
         FROM cmean c JOIN fmean m ON c.feature = m.feature),
contrib AS MATERIALIZED (SELECT f.row_id, f.feature, c.class,
                   coalesce(c.coef * (coalesce(f.x, m.mean) - m.mean), 0.0) AS contribution
            FROM fte f JOIN fmean m ON f.feature = m.feature JOIN coef c ON f.feature = c.feature),
nid AS (SELECT count(DISTINCT row_id) AS n_ids, count(DISTINCT class) AS n_cls FROM contrib)"""
