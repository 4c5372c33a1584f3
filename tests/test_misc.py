"""Remaining helpers: schema -> StructType, lineage cut."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.session import cut_lineage
from cadre.sources import artifacts

def test_spark_schema_from_model_schema():
    feats = {"a": {"type": "binary", "values": [0, 1]}, "b": {"type": "numeric", "range": [0, 1]},
             "c": {"type": "categorical", "values": ["x"]}}
    st = artifacts.spark_schema(feats)
    assert [f.dataType for f in st.fields] == [T.DoubleType(), T.DoubleType(), T.StringType()]


def test_lineage_cut(spark):
    rows_ = [(i, "a" if i % 2 else "b", float(i % 7), i % 3, i % 3) for i in range(90)]
    df = spark.createDataFrame(rows_, "row_id int, cat string, num double, label int, fold int") \
        .withColumn("weight", F.lit(1.0))
    cut = cut_lineage(df)
    assert cut.count() == 90
