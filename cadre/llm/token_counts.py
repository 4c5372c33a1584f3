"""Token counts through a digest cache.

A text's content digest (SHA-256 of its UTF-8 bytes; null is the empty text)
and the digest of the tokenizer's file key a stored count.  Counting a table
joins its digests to the cache, encodes one text for each digest that is
missing, and appends the new counts, so a text is encoded once however often
and in however many tables it occurs.

The normalisation maps null to the empty text and nothing else: any further
folding could give two contents with different counts the same digest.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a null id is
kept; a text of any length is encoded whole; repeated rows give repeated result
rows; a digest stored twice counts once; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.llm.common import narrow, scratch_path, text_parts, whole, written

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
#: Characters given to the encoder at a time.
CHUNK = 1 << 21

_loaded: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    """Function from a list of texts to their numbers of tokens."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = lambda texts: [len(tok.encode(x, add_special_tokens=False).ids) for x in texts]
    return _loaded[path]


def encode_misses(misses: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for b in batches:
            n = [x for _, part in text_parts(b, "text", CHUNK) for x in count(part)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
    return misses.select("digest", "text").mapInArrow(run, CACHE)


class TokenCountCache:
    """Stored counts of one tokenizer version: a Parquet folder under ``root``
    named by the version.  Writers only append; two jobs, or one that is tried
    again after its append, can both store a digest, so a reader takes one row
    per digest."""

    def __init__(self, spark: SparkSession, root: str, tokenizer: str):
        self.spark, self.tokenizer = spark, tokenizer
        self.path = f"{root}/tokenizer={tokenizer_version(tokenizer)}"
        # makes the folder, so that an empty cache is read like any other
        spark.createDataFrame([], CACHE).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(CACHE).parquet(self.path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def count(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row (id, n_bytes, n_tokens) per row of ``docs``.

        The texts move once, partitioned by (digest, id), so that a digest
        shared by many rows is spread; each distinct miss is one row there.
        """
        base = narrow(docs, id=id_col, text=text_col).withColumn("text", whole("text"))
        base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
        thin = written(base.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
        # a key of the text's row that is never null, for the join back to it
        row_key = F.xxhash64("id")
        first = thin.groupBy("digest").agg(F.min(row_key).alias("row_key"))
        misses = first.join(self.read(), "digest", "left_anti")
        texts = base.withColumn("row_key", row_key).join(misses, ["digest", "row_key"], "left_semi")
        new = encode_misses(texts, self.tokenizer)
        if docs.sparkSession is not self.spark:
            raise ValueError("the cache belongs to another session")
        # several rows can share both id and text
        new.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(self.path)
        return thin.join(self.read(), "digest", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, cache_root: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row.

    ``cache_root`` names a lasting cache; without it the cache starts empty in
    a new folder of the session's checkpoint folder.
    """
    spark = docs.sparkSession
    cache = TokenCountCache(spark, cache_root or scratch_path(spark, "token-counts"), tokenizer)
    return cache.count(docs, id_col, text_col).withColumn("over_limit", F.col("n_tokens") > limit)
