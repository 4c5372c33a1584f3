"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import time
import uuid
import zipfile

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadre.session import ensure_checkpoint_dir

#: ASCII white space, the only characters that part words or pad lines.
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as
    ``spark-submit --py-files`` does, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cadre-py-"), "cadre.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: Column | str) -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder (with the writer's ``options``) and
    reread: cuts the lineage and survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of frames that are no longer held: it
    does so once its driver collects them, which a quiet driver rarely does."""
    gc.collect()
    # what a first collection finds still holds other frames
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Rows of thin tables for each task that goes on with them.
TASK_ROWS = 50_000


def give_back_memory() -> None:
    """Returns freed memory to the system: workers stay for later stages, and
    what they keep counts against their executor meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # other C libraries return it by themselves
        trim(0)


def thrifty(run: Callable) -> Callable:
    """A map over Arrow batches that ends with :func:`give_back_memory`."""
    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back_memory()
    return wrapped


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` thin rows, in no more partitions than they
    fill: the partitions of a shuffle are joined where there is little in them."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def free_name(taken: list[str], name: str) -> str:
    """``name``, or ``name_2``, ... if a column (in any case) already has it."""
    low, out, n = {t.lower() for t in taken}, name, 1
    while out.lower() in low:
        n += 1
        out = f"{name}_{n}"
    return out


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns
    of the input can then not clash with them."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def fits(df: DataFrame, limit_rows: int) -> bool:
    """Whether ``df`` has at most ``limit_rows`` rows (reads no more than that)."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def maybe_broadcast(df: DataFrame, limit_rows: int) -> DataFrame:
    """``df`` with a broadcast hint only if it has at most ``limit_rows`` rows;
    beyond that the join shuffles and is split by the adaptive skew join."""
    return F.broadcast(df) if fits(df, limit_rows) else df


def top_counts(counts: DataFrame, size: int, key: str = "w", n: str = "n") -> list[tuple]:
    """The ``size`` rows (key, n) of the largest counts, ties by key.

    A histogram of the counts in steps of a tenth of a binary order says how
    small a taken count can be, so only rows near the result are sorted.
    """
    step = F.floor(F.log2(n) * 10)
    left, least = size, None
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        least = r["b"]
        left -= r["k"]
        if left <= 0:
            break
    if least is None:
        return []
    return [tuple(r) for r in counts.where(step >= least).orderBy(F.desc(n), key).limit(size).select(key, n).collect()]


def text_parts(batch: pa.RecordBatch, column: str | int, chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about ``chars`` characters each: of a batch, only
    that much is held as Python strings at a time."""
    col = batch.column(column)
    start, part, size = 0, [], 0
    for lo in range(0, len(col), 64):
        for t in col.slice(lo, 64).to_pylist():
            part.append(t)
            size += len(t or "")
            if size >= chars:
                yield start, part
                start, part, size = start + len(part), [], 0
    if part:
        yield start, part
