"""Dirty all-text CSV source and CSV sink."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadre.functions.text import READ_NULL_TOKENS, norm_header
from cadre.operators.clean import clean_frame
from cadre.operators.joins import lookup_join
from cadre.session import cut_lineage

MALFORMED = "_malformed"


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Names of the raw first line (one row is read)."""
    first = spark.read.text(path).limit(1).collect()
    return _names(first[0]["value"] if first else "", sep)


def _names(line: str, sep: str) -> list[str]:
    """Names in a raw header line.

    Spark would number repeated names (``PTG, PTG`` -> ``PTG0, PTG1``) and so
    hide them; here the first keeps its name and later ones get ``.1``, ``.2``.
    """
    line = line.lstrip("\ufeff").rstrip("\r")
    names = next(csv.reader([line], delimiter=sep), [])
    seen: dict[str, int] = {}
    out = []
    for n in map(norm_header, names):
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def _n_fields(raw, sep: str):
    """Fields of a raw record: separators outside quotes, plus one."""
    bare = F.regexp_replace(raw, '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their file, their block's offset and their place in it.

    A block is what one task reads of a file, so its lines come in order and
    ``at`` rises with them, by the same numbers whenever the files are read."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def quoted_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``(record)`` of files whose quoted fields may hold line breaks, and
    their distinct raw header lines; a file is read by as many tasks as it has
    blocks.

    A line opens inside a quoted field if an odd number of quotes stands before
    it in its file: those of the earlier blocks, one sum per block, plus those
    of its own block.  Blocks that begin outside quotes and have no line with an
    odd number of quotes hold a record per line and are passed on as they are;
    only the others' lines are ordered, block by block, and joined into records.
    As in the usual CSV rules, a quote in a field that is not quoted must not
    stand alone on its line.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    head = F.when(F.col("block") == 0, F.struct("at", "value"))
    per = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"), F.max(quotes % 2).alias("odd"), F.min(head).alias("head"))
    # one row per block; the window is over the blocks of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(per.withColumn("inside", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2))
    headers = [r["v"] for r in blocks.where("head IS NOT NULL").select(F.col("head.value").alias("v")).distinct().collect()]
    first = F.max(F.col("head.at")).over(Window.partitionBy("file"))
    known = blocks.select("file", "block", "inside", "odd", first.alias("_header_at"))
    lines = lookup_join(lines, cut_lineage(known), ["file", "block"], "inner").where("at <> _header_at")
    whole = (F.col("inside") == 0) & (F.col("odd") == 0)
    plain = lines.where(whole).select(F.col("value").alias("record"))

    in_block = Window.partitionBy("file", "block").orderBy("at")
    earlier = F.coalesce(F.sum(quotes).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the header line, left out above, holds no open quote
    starts = (F.col("inside") + earlier) % 2 == 0
    other = lines.where(~whole).withColumn("_starts", starts)
    other = cut_lineage(other.withColumn("_from", F.max(F.when(F.col("_starts"), F.col("at"))).over(in_block))
                        .select("file", "block", "at", "value", "_from"))
    # a block's first lines may go on with a record of an earlier block
    ends = other.groupBy("file", "block").agg(F.max("_from").alias("_last"))
    carried = F.last(F.when(F.col("_last").isNotNull(), F.struct("block", "_last")), ignorenulls=True).over(before)
    ends = cut_lineage(ends.withColumn("_open", carried).select("file", "block", "_open"))
    other = lookup_join(other, ends, ["file", "block"], "inner")
    own = F.struct("block", F.col("_from").alias("_last"))
    key = F.when(F.col("_from").isNotNull(), own).otherwise(F.col("_open"))
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    joined = other.groupBy("file", key.alias("_key")).agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("record"))
    return plain.unionByName(joined.select("record")), headers


def read_dirty_csv(spark: SparkSession, path: str, sep: str = ",", null_tokens=READ_NULL_TOKENS,
                   skip_overlong: bool = True, clean: bool = False, multi_line: bool = False) -> DataFrame:
    """Every column as text, header normalised (BOM dropped, NBSP ->
    space, strip).

    * ``multi_line``: quoted fields may hold line breaks (the header may not);
      files are still read block by block (:func:`quoted_records`), and files
      whose headers differ are an error.
    * S2: rows with more fields than the header are skipped, even if the
      surplus is empty; short rows are kept with nulls.  Spark hands out the
      raw text of both kinds, and its fields are counted.
    * S3: the pandas default missing-value tokens become null.
    * ``clean``: also apply the full value clean (F1).
    """
    if multi_line:
        records, headers = quoted_records(spark, path)
        found = {tuple(_names(h, sep)) for h in headers}
        if len(found) > 1:
            raise ValueError(f"files with different headers: {sorted(found)}")
        names = list(found.pop()) if found else []
    else:
        names = _header(spark, path, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    if multi_line:
        record = F.regexp_replace("record", "\r$", "")
        parsed = F.from_csv(F.col("record"), _ddl(schema), {**options, "multiLine": "true"})
        df = records.select(record.alias("record")).where(F.trim("record") != "").select(parsed.alias("_r")).select("_r.*")
    else:
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
              .options(**options).option("columnPruning", False).csv(path))
    if skip_overlong:
        raw = F.col(MALFORMED)
        df = df.filter(raw.isNull() | (_n_fields(raw, sep) <= len(names)))
    tokens = list(null_tokens)
    df = df.select(*[F.when(F.col(f"`{n}`").isin(tokens), F.lit(None).cast("string"))
                     .otherwise(F.col(f"`{n}`")).alias(n) for n in names])
    return clean_frame(df) if clean else df


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header CSV sink (parallel part files; ``single_file`` only for
    small reports)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
