"""Model-schema JSON, metrics reports and explanation exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.operators.profile import schema_json


def write_model_schema(profile: DataFrame, path: str) -> None:
    """The A21 profile as one JSON document (built by Spark's
    ``to_json``; one small row written as a single text file)."""
    schema_json(profile).coalesce(1).write.mode("overwrite").text(path)


def read_model_schema(spark: SparkSession, path: str) -> dict:
    """Model-schema JSON -> ``{feature: {type, range | values}}`` (the
    schema is model metadata, bounded by the feature count)."""
    text = "".join(r["value"] for r in spark.read.text(path).collect())
    return json.loads(text)["features"]


def schema_types(features: dict) -> dict[str, str]:
    """Feature -> type map used by ``score.validate_rows``."""
    return {k: v["type"] for k, v in features.items()}


def spark_schema(features: dict) -> T.StructType:
    """S7 -> a ``StructType`` of the coerced batch (binary/numeric double,
    categorical string)."""
    return T.StructType([T.StructField(k, T.StringType() if v["type"] == "categorical" else T.DoubleType())
                         for k, v in features.items()])


def metrics_long(row: DataFrame, id_cols=("model",)) -> DataFrame:
    """Wide metric rows -> ``(model, metric, value)`` (unpivot)."""
    id_cols = list(id_cols)
    vals = [f.name for f in row.schema.fields
            if f.name not in id_cols and isinstance(f.dataType, T.NumericType)]
    return row.unpivot(id_cols, vals, "metric", "value").withColumn("value", F.col("value").cast("double"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each metrics table (coverage, headline, per-class, thresholds)
    as Parquet under ``path/<name>``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_explanations(contrib: DataFrame, groups: DataFrame, path: str,
                        meta: dict | None = None) -> None:
    """Explanation payload — long contributions (partitioned by class),
    group summary and a one-row metadata document."""
    contrib.write.mode("overwrite").partitionBy("class").parquet(f"{path}/contributions")
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    spark = contrib.sparkSession
    spark.createDataFrame([(json.dumps(meta or {}),)], "meta string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/meta")


def write_payload(samples: DataFrame, groups: DataFrame, path: str, meta: dict) -> None:
    """The explanation payload of :func:`explain.payload_samples` and
    :func:`explain.payload_groups` with its metadata."""
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    spark = samples.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(samples, groups, meta) of a written payload."""
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    return spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/groups"), meta


def payload_document(spark: SparkSession, path: str, limit: int = 5000) -> str:
    """The whole payload as one JSON document, for a page to load.  A sample
    of more than ``limit`` rows is an error: take one with ``sample_rows``."""
    samples, groups, meta = read_payload(spark, path)
    if samples.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} explained rows; export a sample of them")
    as_rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    found = as_rows(groups)
    return json.dumps({"meta": meta, "groups": found, "correlations": {g["key"]: g["mean_contribution"] for g in found}, "samples": as_rows(samples)})
