"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case.  ``LineRuns`` holds what has been seen as sorted runs of
(128-bit key hash, documents holding it, largest such id).  Each new batch of
documents is reduced to its keys and merge-joined with the runs: keys that no
run holds (the anti-join) become the batch's own run; keys already held become
count updates beside it.  When a level has ``fanout`` runs they are merged
into one run of the next level, so a batch meets only logarithmically many
runs.

A key found in at least ``min_docs`` documents loses all its lines except in
the document with the largest id; shorter keys are never looked at.

Defined cases: null or empty texts are one empty line; a row is a document,
so rows that repeat an id count singly and share that id's fate; rows with a
null id count as documents but keep all lines; texts of any length are split
whole; an empty table gives an empty result; other columns of the input travel unchanged through ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadre.llm.common import SPACE, ascii_lower, free_name, narrow, scratch_path, whole, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    """128 bits: two seeds of a 64-bit hash."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def key_hashes(text: Column, min_chars: int) -> Column:
    """Distinct key hashes of the text's lines of at least ``min_chars`` code points."""
    keys = F.filter(F.transform(F.split(text, "\n"), line_key), lambda k: F.length(k) >= min_chars)
    return F.array_distinct(F.transform(keys, _hash))


def entries(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, h1, h2) for each document and key; ``docs`` has id and text."""
    return docs.select("id", F.explode(key_hashes(whole("text"), min_chars)).alias("h")).select("id", "h.h1", "h.h2")


class LineRuns:
    """Levelled runs under ``path``; ``runs`` lists (level, folder) of the live
    ones and is all that a later session needs to go on with them."""

    SCHEMA = "h1 long, h2 long, n_docs long, last_id long, own boolean"

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2, runs: list[tuple[int, str]] | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.runs: list[tuple[int, str]] = list(runs or [])
        self._made = len(self.runs)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*folders)

    def _write(self, df: DataFrame, level: int) -> None:
        folder = f"{self.path}/L{level}-{self._made}"
        self._made += 1
        df.sortWithinPartitions("h1", "h2").write.parquet(folder)
        self.runs.append((level, folder))

    def add_batch(self, batch: DataFrame, min_chars: int = 40) -> None:
        """Adds a batch of documents (id, text) as a level-0 run."""
        seen = self._read([f for _, f in self.runs]).where("own").select("h1", "h2", F.lit(True).alias("seen"))
        new = entries(batch, min_chars).groupBy("h1", "h2").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("id").cast("long").alias("last_id"))
        joined = new.join(seen, ["h1", "h2"], "left")
        self._write(joined.select("h1", "h2", "n_docs", "last_id", F.col("seen").isNull().alias("own")), 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(live := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self.runs = [r for r in self.runs if r[0] != level]
            # a key's own row and its updates become one row; a run without its own row keeps an update
            merged = self._read([f for _, f in live]).groupBy("h1", "h2").agg(
                F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"), F.bool_or("own").alias("own"))
            self._write(merged, level + 1)
            level += 1

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last_id) of every key in the runs."""
        every = self._read([f for _, f in self.runs])
        return every.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))


def batches_by_id(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` (with ``id``) cut into ``n`` ranges of about as many rows, ascending."""
    edges = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    if not edges:
        return [docs]
    first = docs.where((F.col("id") <= edges[0]) | F.col("id").isNull())
    mid = [docs.where((F.col("id") > a) & (F.col("id") <= b)) for a, b in zip(edges, edges[1:])]
    return [first, *mid, docs.where(F.col("id") > edges[-1])]


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2,
                id_col: str = "doc_id", text_col: str = "text", counts: bool = False,
                runs_path: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of its text; with ``counts``
    also n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    thin = narrow(docs, id=id_col, text=text_col)
    runs = LineRuns(spark, runs_path or scratch_path(spark, "line-runs"), fanout)
    for batch in batches_by_id(thin, batches):
        runs.add_batch(batch, min_chars)
    # written, so that both sides of the join are plain exchanges and the
    # adaptive join can split the rows of a key that very many documents hold
    frequent = written(runs.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_id"), "frequent-lines")
    drops = (entries(thin, min_chars).join(frequent, ["h1", "h2"]).where(F.col("id") < F.col("last_id"))
             .groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop")))
    cols = docs.columns
    key, drop, lines = (free_name(cols, n) for n in ("_id", "_drop", "_lines"))
    joined = docs.join(drops.select(F.col("id").alias(key), F.col("drop").alias(drop)),
                       F.col(f"`{id_col}`") == F.col(key), "left")
    split = F.split(whole(F.col(f"`{text_col}`")), "\n")

    def stays(line: Column) -> Column:
        k = line_key(line)
        return (F.length(k) < min_chars) | ~F.array_contains(F.col(drop), _hash(k))

    kept = F.when(F.col(drop).isNull(), split).otherwise(F.filter(split, stays))
    text = F.when(F.col(drop).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.col(lines), "\n"))
    out = joined.withColumn(lines, kept)
    extra = [F.size(split).cast("long").alias("n_lines"),
             (F.size(split) - F.size(lines)).cast("long").alias("n_dropped")] if counts else []
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in cols], *extra)
