"""Row validation against a model schema and batch scoring.

Validation is one projection: every schema feature becomes a coerced column
and the row's problems an ``errors`` array — nothing is scored row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadre.functions.bins import TIER_LABELS
from cadre.functions.numeric import trimmed_to_double
from cadre.functions.text import utrim

TRUE_TOKENS = ["1", "1.0", "TRUE"]
FALSE_TOKENS = ["0", "0.0", "FALSE"]


def _raw(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.col(f"`{name}`").cast("string")
    return F.lit(None).cast("string")


def _outside(name: str, val: Column, shown: Column, info: dict) -> Column:
    """Message for a coerced value outside the schema's range or values."""
    if info.get("range") and info["range"][0] is not None:
        lo, hi = (float(x) for x in info["range"])
        return F.when((val < lo) | (val > hi), F.concat(F.lit(f"'{name}': expected {lo} to {hi}, got "), shown))
    if info["type"] == "categorical" and info.get("values") is not None:
        return F.when(val.isNotNull() & ~F.coalesce(F.array_contains(F.array(*[F.lit(str(v)) for v in info["values"]]).cast("array<string>"), val), F.lit(False)),
                      F.concat(F.lit(f"'{name}': unknown category, got "), shown))
    return F.lit(None).cast("string")


def validate_rows(df: DataFrame, schema: dict[str, str], keep: Sequence[str] = (), features: dict | None = None) -> DataFrame:
    """K1 + P12: coerce raw text to the schema's feature types.

    * missing column, null or '' -> null (no error);
    * ``binary``: 0/1/true/false (any case) -> 0.0/1.0, other text is an
      error (the reference turned any filled text into 1 — T11 fixed);
    * ``numeric``: parsed number, else null and an error naming the field;
    * ``categorical``: stripped text.
    ``features`` (the stored schema, S7) also reports numbers outside the
    training range and unknown categories; their values are kept, since a model
    can score them.
    Extra input columns are dropped (``keep`` lists pass-through columns).
    Output: ``keep`` + features in schema order + ``errors array<string>``.
    """
    names = list(schema)
    kept = [F.col(f"`{k}`").alias(f"k{j}") for j, k in enumerate(keep)]
    keys = [f"k{j}" for j in range(len(keep))]
    # Text is trimmed in one projection, coerced in the next and judged in the
    # last: a trim by characters is dear, and in one expression would be done
    # again wherever it is used.
    raws = df.select(*kept, *[_raw(df, n).alias(f"r{i}") for i, n in enumerate(names)])
    trimmed = raws.select("*", *[utrim(F.col(f"r{i}")).alias(f"t{i}") for i in range(len(names))])
    values = trimmed.select("*", *[_coerced(F.col(f"t{i}"), schema[n]).alias(f"v{i}") for i, n in enumerate(names)])
    errs = []
    for i, name in enumerate(names):
        kind, raw, txt, val = schema[name], F.col(f"r{i}"), F.col(f"t{i}"), F.col(f"v{i}")
        shown = F.concat(F.lit("'"), raw, F.lit("'"))
        if kind in ("binary", "numeric"):
            expected = "0/1" if kind == "binary" else "a number"
            errs.append(F.when((txt != "") & val.isNull(), F.concat(F.lit(f"'{name}': expected {expected}, got "), shown)))
        if features is not None and name in features:
            errs.append(_outside(name, val, shown, features[name]))
    errors = F.filter(F.array(*errs), lambda e: e.isNotNull()) if errs else F.array().cast("array<string>")
    return values.select(*[F.col(c).alias(k) for c, k in zip(keys, keep)], *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)],
                         errors.alias("errors"))


def _coerced(txt: Column, kind: str) -> Column:
    """Trimmed text as the value of its feature; null and '' are null."""
    if kind == "binary":
        up = F.upper(txt)
        return F.when(up.isin(TRUE_TOKENS), F.lit(1.0)).when(up.isin(FALSE_TOKENS), F.lit(0.0))
    if kind == "numeric":
        return trimmed_to_double(txt)
    return F.when(txt != "", txt)


def template(spark, schema: dict[str, str]) -> DataFrame:
    """The blank batch template — one all-null row, one column per
    schema feature."""
    cols = ", ".join(f"CAST(NULL AS STRING) AS `{n}`" for n in schema)
    return spark.sql(f"SELECT {cols}")


def score_batch(model, df: DataFrame, features_col: str = "features",
                labels: Sequence[str] = TIER_LABELS, prob_prefix: str = "p_") -> DataFrame:
    """K2: ``model.transform`` + predicted tier name + one probability
    column per class (``vector_to_array``; no per-row Python)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    arr = vector_to_array(F.col("probability"))
    names = [prob_prefix + lab.lower().replace("-", "_").replace(" ", "_") for lab in labels]
    lab_arr = F.array(*[F.lit(x) for x in labels])
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.element_at(lab_arr, F.col("prediction").cast("int") + 1).alias("predicted_tier"),
        *[arr[i].alias(n) for i, n in enumerate(names)])


def tier_counts(scored: DataFrame, labels: Sequence[str] = TIER_LABELS,
                tier_col: str = "predicted_tier") -> DataFrame:
    """Scored rows per tier, 0 for tiers never predicted (the label
    list is a literal k-row table, left-joined)."""
    spark = scored.sparkSession
    lab = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "tier_index int, tier string")
    counts = scored.groupBy(F.col(tier_col).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return lab.join(counts, "tier", "left").select(
        "tier_index", "tier", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def rank_by_risk(scored: DataFrame, prob: str = "p_at_risk", n: int | None = None, id_col: str = "row_id") -> DataFrame:
    """Rows ordered by P(at-risk) descending, ties by id (a global sort
    — range partitioned, not collected); ``n`` keeps a top-n report."""
    ordered = scored.orderBy(F.desc(prob), id_col)
    return ordered.limit(n) if n else ordered
