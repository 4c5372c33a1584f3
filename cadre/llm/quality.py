"""Quality rules with thresholds learned per language and source.

Each document is measured; documents that pass the fixed base rule feed
mergeable quantile sketches, one per (language, source, measure); fences are
read off the sketches, joined back by (language, source), and documents
outside a fence are rejected.

A sketch is a table of logarithmic buckets with counts (relative accuracy
about 1 %, at most a few thousand buckets for any number of documents).  Two
sketches merge by adding counts, in any order, with the same result.  A group
of fewer than ``MIN_DOCS`` documents uses the merged sketch of its language,
and a language of fewer the merged sketch of all.

Fence: from ``q1 - 3 * spread`` (where a low value is bad) to
``q3 + 3 * spread``.  The spread is the group's own: the quartiles' distance or,
where most documents have one value, that of the outer twentieth from its
quartile.  Below it lie only the sketch's accuracy and the step that one line or
symbol of a short document makes.

Defined cases: null and empty texts have no words and fail the base rule; null
languages and sources are groups of their own; repeated rows count and are
judged singly; ids are not read, null or not; texts of any length are measured
whole; an empty table gives an empty result; other columns of the
input travel unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadre.llm.common import SPACE, free_name, give_back_memory, maybe_broadcast, whole, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
GAMMA = 1.02
#: Fewest documents for a sketch of a group's own.
MIN_DOCS = 200
#: Measure: (step of a short document, whether a low value is bad too).
MEASURES = {
    "symbol_share": (0.01, False),
    "dup_line_share": (0.05, False),
    "repeat_share": (0.02, False),
    "mean_word_chars": (0.1, True),
}
#: Thresholds for this many groups at most are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    for j in range(window):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n] * np.uint64(2 * j + 0xBF58476D1CE4E5B9)
    order = np.argsort(roll, kind="stable")
    same = roll[order][1:] == roll[order][:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[window:window + n] -= hit
    return int((np.cumsum(edge) > 0).sum())


def measure_text(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = text.encode().split()  # bytes split at ASCII white space only
    seen: set[str] = set()
    full = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            full += 1
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
            full - len(seen), repeated_words(words), full)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_full_lines"]


def _measured(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{n} long" for n in NAMES))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([measure_text(t) for t in texts], columns=NAMES, dtype="int64")
            del texts
            give_back_memory()
            yield out
    return run(whole(text))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def _values(m: Column) -> dict[str, Column]:
    """The judged measures; only asked for where there are words."""
    return {
        "symbol_share": m["n_symbols"] / m["n_words"],
        "dup_line_share": m["n_dup_lines"] / m["n_full_lines"],
        "repeat_share": m["n_repeat_words"] / m["n_words"],
        "mean_word_chars": m["word_chars"] / m["n_words"],
    }


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of rows with lang, source and m."""
    good = measured.where(~base_failed(F.col("m")))
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _values(F.col("m")).items()])
    rows = good.select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.measure", "p.value")
    # a bucket far below any other for 0
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / float(np.log(GAMMA)))).otherwise(-1_000_000)
    return rows.groupBy("lang", "source", "measure", bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches merged over all columns but ``by``."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """One row per ``by`` and measure with the quantiles ``at`` and the count n.

    A sketch has a bounded number of buckets, so its list is bounded.
    """
    total = sketch.groupBy(*by, "measure").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", F.col("n").alias("c")))).alias("b"))

    def value(q: float) -> Column:
        # the walk's state: rows so far, and the first bucket that reaches the rank
        rank = F.ceil(F.lit(q) * F.col("n"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket"))
        step = lambda s, x: F.struct(
            (s["seen"] + x["c"]).alias("seen"),
            F.when(s["bucket"].isNull() & (s["seen"] + x["c"] >= rank), x["bucket"]).otherwise(s["bucket"]).alias("bucket"))
        got = F.aggregate("b", start, step)["bucket"]
        return F.when(got > -1_000_000, 2 * F.pow(F.lit(GAMMA), got) / (GAMMA + 1)).otherwise(F.lit(0.0))

    return total.select(*by, "measure", "n", *[value(q).alias(k) for k, q in at.items()])


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with ``lo_*`` and ``hi_*`` of each measure."""
    levels = [merge(sketch, "lang", "source").withColumn("level", F.lit(2)),
              merge(sketch, "lang").select("lang", F.lit(None).cast("string").alias("source"), "measure", "bucket", "n", F.lit(1).alias("level")),
              merge(sketch).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bucket", "n", F.lit(0).alias("level"))]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    q = quantiles(every, ["level", "lang", "source"], {"q05": 0.05, "q1": 0.25, "q3": 0.75, "q95": 0.95})
    limits = []
    for k, (step, low) in MEASURES.items():
        least = F.greatest(F.col("q3") - F.col("q1"), F.lit(step), (GAMMA - 1) * F.col("q3"))
        above, below = F.greatest(least, F.col("q95") - F.col("q3")), F.greatest(least, F.col("q1") - F.col("q05"))
        mine = F.col("measure") == k
        limits.append(F.max(F.when(mine, F.col("q3") + 3 * above)).alias(f"hi_{k}"))
        limits.append(F.max(F.when(mine, F.col("q1") - 3 * below if low else F.lit(0.0))).alias(f"lo_{k}"))
    limits = q.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *limits)
    own = limits.where("level = 2").select("lang", "source", "n")
    lang = limits.where("level = 1").select(F.col("lang").alias("_lang"), F.col("n").alias("_n"))
    chosen = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "lang", "source",
        F.when(F.col("n") >= MIN_DOCS, 2).when(F.col("_n") >= MIN_DOCS, 1).otherwise(0).alias("use"))
    picked = limits.select(F.col("level").alias("_level"), F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                           *[c for c in limits.columns if c[:3] in ("lo_", "hi_")])
    same = ((F.col("use") == F.col("_level"))
            & F.when(F.col("use") > 0, F.col("lang")).eqNullSafe(F.col("_lang"))
            & F.when(F.col("use") > 1, F.col("source")).eqNullSafe(F.col("_source")))
    return chosen.join(picked, same).drop("_level", "_lang", "_source")


def _judged(measured: DataFrame, fence: DataFrame, lang: str, source: str, m: str) -> tuple[DataFrame, Column]:
    """``measured`` joined with its fences (columns named with a leading ``_f_``) and the verdict."""
    f = maybe_broadcast(fence.select(*[F.col(c).alias(f"_f_{c}") for c in fence.columns]), BROADCAST_GROUPS)
    out = measured.join(f, F.col(f"`{lang}`").eqNullSafe(F.col("_f_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("_f_source")), "left")
    inside = F.lit(True)
    for k, v in _values(F.col(m)).items():
        # a document that passes the base rule is in its group's sketch, so its fence exists
        inside = inside & v.between(F.col(f"_f_lo_{k}"), F.col(f"_f_hi_{k}"))
    return out, F.when(base_failed(F.col(m)), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Fences from all documents."""
    measured = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"),
                           _measured(F.col(f"`{text_col}`")).alias("m"))
    return written(fences(written(sketches(measured), "quality-sketches")), "quality-fences")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, the measures, base_failed and kept of every row."""
    thin = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"),
                               _measured(F.col(f"`{text_col}`")).alias("m")), "quality-measures")
    fence = written(fences(written(sketches(thin), "quality-sketches")), "quality-fences")
    out, kept = _judged(thin, fence, "lang", "source", "m")
    return out.select(F.col("id").alias(id_col), *[F.col("m")[n].alias(n) for n in NAMES],
                      base_failed(F.col("m")).alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Documents are measured once to learn the fences and once more where the
    texts are, which moves no text.
    """
    fence = learn(docs, text_col, lang_col, source_col)
    m = free_name(docs.columns, "_measures")
    out, kept = _judged(docs.withColumn(m, _measured(F.col(f"`{text_col}`"))), fence, lang_col, source_col, m)
    return out.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
