"""A model registry: versioned artifacts and a pointer to the current one.

A version is a folder with the saved pipeline, its metadata and any tables
(metrics, feature columns, cut points).  Only after all of them are written is a
one-row pointer appended; a reader takes the newest pointer, so it never sees a
version that is half written, and a failed publication changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version string, published_at bigint, model string, metrics string"


class ModelRegistry:
    """Versions of one model under ``root`` in a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def publish(self, name: str, model: PipelineModel, metrics: dict | None = None, meta: dict | None = None,
                tables: dict[str, DataFrame] | None = None) -> str:
        """Writes a version, then points to it; returns its id."""
        version = uuid.uuid4().hex
        path = self._path(version)
        model.write().save(f"{path}/model")
        self.spark.createDataFrame([(json.dumps(meta or {}),)], "meta string").coalesce(1).write.json(f"{path}/meta")
        for t, df in (tables or {}).items():
            df.write.parquet(f"{path}/tables/{t}")
        row = [(version, time.time_ns(), name, json.dumps(metrics or {}))]
        self.spark.createDataFrame(row, POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")
        return version

    def versions(self) -> DataFrame:
        """All published versions, one row each."""
        return self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer")

    def current(self) -> dict:
        """The newest version (the larger id on equal times)."""
        r = self.versions().orderBy(F.desc("published_at"), F.desc("version")).first()
        return {**r.asDict(), "metrics": json.loads(r["metrics"])}

    def load(self, version: str | None = None) -> tuple[PipelineModel, dict]:
        """Model and metadata of a version, the current one by default."""
        path = self._path(version or self.current()["version"])
        meta = json.loads(self.spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
        return PipelineModel.load(f"{path}/model"), meta

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._path(version or self.current()['version'])}/tables/{name}")

    def _path(self, version: str) -> str:
        return f"{self.root}/versions/{version}"
