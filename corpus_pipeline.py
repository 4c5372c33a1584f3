"""Corpus preparation: documents in, encoded training rows out.

``STAGES`` are applied in order; each reads what the one before it has
written.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadre.llm import bpe, line_dedup, minhash, mixing, quality
from cadre.llm.common import documents, ship, whole, written
from cadre.llm.queries import tokenizer_path


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents inside the adaptive quality fences."""
    ship(spark)
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without the lines that many documents share;
    ``n_chars`` follows the text."""
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    return out.select(*[F.length(whole("text")).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near copies."""
    ship(spark)
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as the mix of its source takes it."""
    ship(spark)
    return mixing.mixed_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the ids of each text, checked by decoding them."""
    ship(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    out = bpe.encode(docs, path, decoded="decoded")
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      (F.col("decoded") == whole("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", keep_good_documents),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode_texts),
]

#: Near copies and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
