"""Registered queries of the file path and of plan-time column selection
(S1-S3, S5-S7, S9, P1-P5, P7-P10, P12, P15, W9, X1).

Files are written to a new folder of the shared checkpoint folder and read
back through the library's sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadre.functions.text import norm_key
from cadre.operators import columns, profile, score, split
from cadre.plans import sql_views as V
from cadre.plans import views
from cadre.plans.catalog import register, rounded
from cadre.session import ensure_checkpoint_dir
from cadre.sources import artifacts
from cadre.sources.csv import read_dirty_csv, write_csv
from cadre.sources.tables import table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("csv_scan_dirty", """
SELECT CAST(c_custkey AS VARCHAR) AS emp_id, c_name AS name,
       CAST(c_nationkey AS VARCHAR) AS PTG,
       CASE WHEN c_custkey % 13 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS ptg_again
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0
""")
def csv_scan_dirty(spark, d):
    """Customer as dirty text (BOM and NBSP in the header, a
    header name twice, NA tokens, short rows, rows with a surplus field that
    is filled or empty) read back as text, over-long rows skipped."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    last = F.when(key % 5 == 0, F.lit("NA")).otherwise(F.col("c_mktsegment"))
    tail = (F.when(key % 7 == 0, F.concat(F.lit(","), last, F.lit(",x")))
            .when(key % 11 == 0, F.concat(F.lit(","), last, F.lit(",")))
            .when(key % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(","), last)))
    line = F.concat(key.cast("string"), F.lit(","), "c_name", F.lit(","), F.col("c_nationkey").cast("string"), tail)
    path = _folder(spark, "dirty-csv")
    # one column that holds whole lines, named by the whole header line
    c.select(line.alias("\ufeffEmp\u00a0No ,name,PTG,PTG")).write.option("header", True).option("sep", "\u0001") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = read_dirty_csv(spark, path)
    emp = columns.resolve(df.columns, "employee")
    return columns.select_renamed(df, {emp: "emp_id", "name": "name", "PTG": "PTG", "PTG.1": "ptg_again"})


@register("schema_roundtrip", f"""
SELECT 'c_acctbal' AS feature, 'numeric' AS type, {V.r6('min(c_acctbal)')} AS lo, {V.r6('max(c_acctbal)')} AS hi, CAST(NULL AS VARCHAR) AS v FROM customer
UNION ALL SELECT 'c_nationkey', 'numeric', CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE), NULL FROM customer
UNION ALL SELECT 'is_odd', 'binary', NULL, NULL, v FROM (SELECT unnest(['0', '1']) AS v)
UNION ALL SELECT DISTINCT 'segment', 'categorical', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), c_mktsegment || '|' || (c_custkey % 2) FROM customer
""")
def schema_roundtrip(spark, d):
    """The profile of customer written as a schema document and
    read back, one row per range or value (values may hold any character)."""
    c = table(spark, d, "customer").withColumn("is_odd", (F.col("c_custkey") % 2).cast("int")) \
        .withColumn("segment", F.concat_ws("|", "c_mktsegment", (F.col("c_custkey") % 2).cast("string")))
    path = _folder(spark, "schema")
    artifacts.write_model_schema(profile.column_profile(c, ["is_odd"], ["c_acctbal", "c_nationkey"], ["segment"]), path)
    rows = []
    for feature, f in artifacts.read_model_schema(spark, path).items():
        if f["type"] == "numeric":
            rows.append((feature, f["type"], float(f["range"][0]), float(f["range"][1]), None))
        else:
            rows += [(feature, f["type"], None, None, str(v)) for v in f["values"]]
    return rounded(spark.createDataFrame(rows, "feature string, type string, lo double, hi double, v string"))


@register("scored_csv_roundtrip", f"""
WITH {V.PRED}
SELECT row_id, prediction, 'a, "b"' || chr(10) || prediction AS note FROM pred
""")
def scored_csv_roundtrip(spark, d):
    """Scored rows written as CSV (quotes, commas and line breaks in a
    field) and read back as text, then typed again."""
    note = F.concat(F.lit('a, "b"\n'), F.col("prediction").cast("string"))
    path = _folder(spark, "scored-csv")
    write_csv(views.pred(spark, d).select("row_id", "prediction", note.alias("note")), path)
    back = read_dirty_csv(spark, path, multi_line=True)
    return back.select(F.col("row_id").cast("bigint"), F.col("prediction").cast("int"), "note")


#: Headers as an extract might have them, by customer column.
_HEADERS = {"c_custkey": "Game Changer Employee\u00a0Number", "c_name": " Email Address", "c_nationkey": "Latest Star Rating ",
            "c_acctbal": "latest weighted PTG", "c_mktsegment": "GC Region"}


@register("column_resolution", f"""
SELECT CAST(c_custkey AS VARCHAR) AS emp_id, lower(c_name) AS email, CAST(c_nationkey AS INTEGER) AS star,
       {V.r6('c_acctbal')} AS ptg, CAST(NULL AS VARCHAR) AS missing
FROM customer
""")
def column_resolution(spark, d):
    """Roles found among normalised headers, the found columns
    selected and renamed, a missing one added as null."""
    c = table(spark, d, "customer").select(*[F.col(a).alias(b) for a, b in _HEADERS.items()])
    c = columns.normalise_headers(c)
    roles = {"employee": "emp_id", "email": "email", "star": "star", "ptg_target": "ptg"}
    found = columns.select_renamed(c, {columns.resolve(c.columns, r): n for r, n in roles.items()} | {"absent": "absent"})
    out = columns.drop_cols(columns.reindex(found.withColumn("extra", F.lit(1)), [*roles.values(), "extra", "missing"]), ["extra", "absent"])
    return rounded(out.withColumns({"emp_id": norm_key("emp_id"), "email": F.lower("email"), "star": F.col("star").cast("int")}))


_SET_COLUMNS = ["L-English", "CL-PRC", "GC Region", "GC City", "Site Distance", "cnt_L", "tenure_months", "Hire Date",
                "Latest STAR Rating", "Role Type", "sc_avg_ptg", "Record ID", "_y"]
#: What each set must hold of them, in order.
_SETS = {
    "prehire": ["L-English", "GC Region", "GC City", "Site Distance", "cnt_L"],
    "prehire_onboarding": ["L-English", "GC Region", "GC City", "Site Distance", "cnt_L", "Role Type", "tenure_months"],
    "kpi_driver": ["tenure_months", "Role Type", "sc_avg_ptg"],
    "demographic": ["GC Region", "GC City", "Site Distance", "tenure_months"],
    "by_exclusion": ["GC Region", "GC City", "Site Distance", "tenure_months", "Role Type", "sc_avg_ptg"],
}


def _present_sql(i: int) -> str:
    return f"count(CASE WHEN o_orderkey % {i + 2} = 0 THEN 1 END)"


@register("feature_sets", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS feature_set, {k + 1} AS place, '{c}' AS feature, {_present_sql(_SET_COLUMNS.index(c))} AS n_present FROM orders"
    for s, cols in _SETS.items() for k, c in enumerate(cols)))
def feature_sets(spark, d):
    """The feature sets of a wide table (orders under feature names,
    each column filled in part) and how many rows each chosen column has."""
    o = table(spark, d, "orders").select(*[F.when(F.col("o_orderkey") % (i + 2) == 0, F.col("o_orderkey")).alias(c)
                                           for i, c in enumerate(_SET_COLUMNS)])
    flags = columns.flag_cols(o.columns)
    flags = [f for f in flags if f.lower() not in columns.NEVER]
    sets = {"prehire": columns.feature_set(o.columns, "prehire", first=flags),
            "prehire_onboarding": columns.feature_set(o.columns, "prehire", "onboarding", first=flags),
            "kpi_driver": columns.feature_set(o.columns, "kpi_driver"),
            "demographic": columns.feature_set(o.columns, "demographic"),
            "by_exclusion": columns.features_by_exclusion(o.columns)}
    # one pass counts every column
    counts = o.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(_SET_COLUMNS)])
    rows = F.array(*[F.struct(F.lit(s).alias("feature_set"), F.lit(k + 1).alias("place"), F.lit(c).alias("feature"),
                              F.col(f"n{_SET_COLUMNS.index(c)}").alias("n_present"))
                     for s, cols in sets.items() for k, c in enumerate(cols)])
    return counts.select(F.inline(rows))


@register("sample_rows", f"""
SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {split.hash_order_sql('o_orderkey')}, o_orderkey LIMIT 500
""")
def sample_rows(spark, d):
    """A reproducible 500-row sample (the explanation sample)."""
    return split.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 500)


@register("permute_column", f"""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS x FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY {split.hash_order_sql('o_orderkey')}, o_orderkey) AS rk, count(*) OVER () AS n FROM v)
SELECT a.o_orderkey, a.x, b.x AS perm_x
FROM r a JOIN r b ON a.rk = (b.rk - 1 + greatest(b.n // 3, 1)) % b.n + 1
""")
def permute_column(spark, d):
    """A column's values (nulls too) moved along one random order of all rows."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("x"))
    return split.permute_columns(o, ["x"], "o_orderkey")


_LINEAR_SQL = f"""
WITH {V.PRED},
s AS (SELECT row_id, label, p0, p1, p2, coalesce(CASE WHEN row_id % 10 = 0 THEN NULL ELSE p0 END, 0.0) AS x FROM pred),
m AS (SELECT label, avg(x) AS mx FROM s GROUP BY label),
sc AS (SELECT s.row_id, -((x - (SELECT mx FROM m WHERE label = 0)) ^ 2) AS z0, -((x - (SELECT mx FROM m WHERE label = 1)) ^ 2) AS z1,
              -((x - (SELECT mx FROM m WHERE label = 2)) ^ 2) AS z2 FROM s),
e AS (SELECT row_id, exp(z0) AS e0, exp(z1) AS e1, exp(z2) AS e2 FROM sc)
SELECT row_id, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 'At-Risk' WHEN e1 >= e2 THEN 'Developing' ELSE 'High Performer' END AS predicted_tier,
       {V.r6('e0 / (e0 + e1 + e2)')} AS p_at_risk, {V.r6('e1 / (e0 + e1 + e2)')} AS p_developing,
       {V.r6('e2 / (e0 + e1 + e2)')} AS p_high_performer
FROM e
"""


@register("score_linear_batch", _LINEAR_SQL)
def score_linear_batch(spark, d):
    """A whole all-text batch validated and scored through a saved
    and reloaded model whose coefficients are the class means of one feature
    (scores ``2 m x - m^2``, equal to the nearest mean's up to a constant)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    from cadre.functions.bins import TIER_LABELS
    from cadre.operators import train
    p = views.pred(spark, d).withColumn("x", F.when(F.col("row_id") % 10 != 0, F.col("p0")))
    means = {r["label"]: r["m"] for r in p.groupBy("label").agg(F.avg(F.coalesce("x", F.lit(0.0))).alias("m")).collect()}
    z = [f"2 * ({means[k]!r}D) * coalesce(x, 0D) - ({means[k]!r}D) * ({means[k]!r}D)" for k in range(3)]
    total = " + ".join(f"exp({e})" for e in z)
    probs = [f"exp({e}) / ({total})" for e in z]
    best = (f"CASE WHEN ({probs[0]}) >= ({probs[1]}) AND ({probs[0]}) >= ({probs[2]}) THEN 0D "
            f"WHEN ({probs[1]}) >= ({probs[2]}) THEN 1D ELSE 2D END")
    stages = [SQLTransformer(statement="SELECT *, " + ", ".join(f"{q} AS _q{i}" for i, q in enumerate(probs)) + f", {best} AS prediction FROM __THIS__"),
              VectorAssembler(inputCols=["_q0", "_q1", "_q2"], outputCol="probability")]
    path = _folder(spark, "linear-model")
    train.save_model(PipelineModel(stages), path, {"features": ["x"]})
    model, meta = train.load_model(path)
    raw = p.select("row_id", F.col("x").cast("string").alias("x"))
    batch = score.validate_rows(raw, {f: "numeric" for f in meta["features"]}, keep=["row_id"])
    out = score.score_batch(model, batch, labels=TIER_LABELS)
    return rounded(out.select("row_id", "predicted_tier", "p_at_risk", "p_developing", "p_high_performer"))


@register("scored_linear_summary", f"""
WITH scored AS ({_LINEAR_SQL}),
t AS (SELECT unnest(['At-Risk', 'Developing', 'High Performer']) AS tier)
SELECT 'count' AS part, t.tier, count(s.row_id) AS n, CAST(NULL AS BIGINT) AS row_id, CAST(NULL AS DOUBLE) AS p_at_risk
FROM t LEFT JOIN scored s ON s.predicted_tier = t.tier GROUP BY t.tier
UNION ALL SELECT 'by_risk', predicted_tier, NULL, row_id, p_at_risk FROM scored
""")
def scored_linear_summary(spark, d):
    """The scored batch's rows per tier (0 for a tier that is never
    predicted) and all its rows by P(at-risk)."""
    s = score_linear_batch(spark, d)
    counts = score.tier_counts(s).select(F.lit("count").alias("part"), "tier", "n", F.lit(None).cast("bigint").alias("row_id"),
                                         F.lit(None).cast("double").alias("p_at_risk"))
    rows = score.rank_by_risk(s).select(F.lit("by_risk").alias("part"), F.col("predicted_tier").alias("tier"),
                                        F.lit(None).cast("bigint").alias("n"), "row_id", "p_at_risk")
    return counts.unionByName(rows)


@register("csv_quoted_breaks", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, sha256(text) AS text_sha256, length(text) AS n_chars
FROM (SELECT doc_id, source, CASE WHEN text IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
             '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL ELSE text END AS text FROM documents)
""")
def csv_quoted_breaks(spark, d):
    """Whole documents, whose texts hold line breaks and quotes, written
    as CSV and read back by as many tasks as the files have blocks."""
    path = _folder(spark, "quoted-csv")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = read_dirty_csv(spark, path, multi_line=True)
    return df.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"))
