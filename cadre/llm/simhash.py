"""SimHash fingerprints and search within a Hamming radius, in DataFrame
functions only.

A document's terms are its runs of five words (one run of all words if it has
fewer); a term weighs as much as it occurs.  Each occurrence adds its 64-bit
hash's bits to 64 counters, two of them packed in one long (so a row adds 32
longs), and a fingerprint bit is set where more than half of the weight voted
for 1.

``within_radius`` cuts fingerprints into ``radius + 2`` blocks.  Two
fingerprints that differ in at most ``radius`` bits agree on at least two
whole blocks, so one table per pair of blocks, keyed by those blocks' bits,
finds every pair; a pair is kept only in the first table that finds it.

Defined cases: null and empty texts have no term and the fingerprint of all
zeros; equal texts have equal fingerprints; rows that repeat an id are ordered
by their text's hash; null ids come first; texts of any length are fingerprinted whole; a single document is its own next
document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadre.llm.common import narrow, whole

WORDS = 5
#: Rows of one range of ids, and the largest number of ranges' square root.
RANGE_ROWS = 2_000
MOST = 64
LONG_MIN = -(1 << 63)


def terms(text: Column) -> Column:
    """Array of structs of five words, one per term occurrence."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.greatest(F.size(words) - (WORDS - 1), F.lit(1))
    return F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(WORDS)])


def _votes() -> list[Column]:
    pair = F.lit((1 << 32) | 1)
    return [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair)).alias(f"v{i}") for i in range(32)]


def _signs() -> Column:
    """The 64 bits of the summed votes, against half of the total weight n."""
    bits = []
    for i in range(32):
        v = F.col(f"v{i}")
        bits.append(F.when(v.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)))
        high = 1 << (i + 32) if i < 31 else LONG_MIN
        bits.append(F.when(F.shiftrightunsigned(v, 32) * 2 > F.col("n"), F.lit(high)).otherwise(F.lit(0)))
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return out


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (long) of each row; ``keys`` tell the rows apart."""
    w = [f"w{i}" for i in range(WORDS)]
    # an empty text has one term of nulls, which must count as no term
    rows = df.select(*keys, F.inline_outer(terms(F.col(text))).alias(*w))
    rows = rows.select(*keys, F.xxhash64(*w).alias("h"), F.col("w0").isNotNull().alias("some"))
    votes = rows.select(*keys, F.when(F.col("some"), F.col("h")).otherwise(F.lit(0)).alias("h"))
    return votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_votes()).select(*keys, _signs().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _constant(values: list[int]) -> Column:
    """A constant array, kept short in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def id_ranges(df: DataFrame, key: str = "k") -> DataFrame:
    """``df`` with ``part``, a number that cuts the ascending keys into ranges
    of about as many rows, and a second copy (``ghost``) of each range's first
    row at the end of the range before it (of the first one's: at the very end).

    At most ``MOST ** 2`` edges are read by the driver.
    """
    n = df.count()
    side = min(MOST, max(1, math.ceil(math.sqrt(n / RANGE_ROWS))))
    q = side * side
    edges = df.agg(F.percentile_approx(key, [i / q for i in range(1, q)] or [0.5], 100 * q).alias("e")).first()["e"] or [0]
    edges = (edges * q)[: q - 1] if len(edges) < q - 1 else edges[: q - 1]
    fine = [LONG_MIN, *edges]  # q lower edges, ascending
    low = [fine[i * side] for i in range(side)]
    at_most = lambda e: e <= F.col(key)
    coarse = F.size(F.filter(_constant(low), at_most))
    inner = F.slice(_constant(fine), (F.col("_c") - 1) * side + 1, F.lit(side))
    ranged = df.withColumn("_c", coarse).withColumn("part", (F.col("_c") - 1) * side + F.size(F.filter(inner, at_most)) - 1)
    firsts = dict(ranged.groupBy("part").agg(F.min(key).alias("k")).collect())
    used = sorted(firsts)
    before = dict(zip(used, [used[-1], *used[:-1]])) if used else {}
    first_of = _constant([firsts.get(p, 0) for p in range(q)])
    before_of = _constant([before.get(p, 0) for p in range(q)])
    own = F.struct(F.col("part").cast("long").alias("part"), F.lit(False).alias("ghost"))
    copy = F.struct(F.element_at(before_of, F.col("part") + 1).alias("part"), F.lit(True).alias("ghost"))
    places = F.when(F.element_at(first_of, F.col("part") + 1) == F.col(key), F.array(own, copy)).otherwise(F.array(own))
    return ranged.withColumn("_p", F.explode(places)).drop("_c", "part").select("*", "_p.part", "_p.ghost").drop("_p")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document and its edited text: the last half of its code points
    replaced by the beginning of the next document's, ascending id.

    Columns id, part, rn, ghost, text, edited, n_chars; ghosts end a range and
    only stand for the next document of its last row.
    """
    base = narrow(docs, id=id_col, text=text_col).withColumn("text", whole("text"))
    base = base.withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(LONG_MIN)))
    placed = id_ranges(base).withColumn("_t", F.xxhash64("text"))
    order = Window.partitionBy("part").orderBy("ghost", "k", "_t")
    rows = placed.select("id", "part", "ghost", "text", F.length("text").cast("long").alias("n_chars"),
                         F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("_next"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keep = F.col("n_chars").cast("int") - half
    text = F.concat(F.substring("text", F.lit(1), keep), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    return rows.select("id", "part", "rn", "ghost", "n_chars", "text", text.alias("edited"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fp, edited_fp, next_fp of every row."""
    rows = edited(docs, id_col, text_col)
    keys = ["part", "rn", "ghost", "id", "n_chars", "sha"]
    both = rows.withColumn("sha", F.unhex(F.sha2("edited", 256))).select(
        *keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
                                 F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    fps = fingerprints(both.select(*keys, "x.which", F.col("x.t").alias("text")), [*keys, "which"])
    each = fps.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"),
                                  F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    order = Window.partitionBy("part").orderBy("rn")
    out = each.withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("ghost"))
    return out.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def block_masks(radius: int) -> list[int]:
    """One mask of two whole blocks per table; 64 bits in ``radius + 2`` blocks."""
    n = radius + 2
    cut = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
    masks = [x | y for x, y in itertools.combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(queries: DataFrame, every: DataFrame, radius: int = 3) -> DataFrame:
    """(q, fp, distance) for each distinct fingerprint ``q`` of ``queries`` and
    ``fp`` of ``every`` that differ in at most ``radius`` bits, each pair once."""
    masks = _constant(block_masks(radius))
    tables = lambda df, name: df.select(F.col("fp").alias(name)).distinct().select(
        name, F.posexplode(masks).alias("t", "m")).select(name, "t", F.col(name).bitwiseAND(F.col("m")).alias("block"))
    pairs = tables(queries, "q").join(tables(every, "fp"), ["t", "block"])
    x = F.col("q").bitwiseXOR(F.col("fp"))
    earlier = F.exists(F.slice(masks, F.lit(1), F.col("t")), lambda m: x.bitwiseAND(m) == 0)
    return pairs.where((F.bit_count(x) <= radius) & ~earlier).select("q", "fp", F.bit_count(x).alias("distance"))


def count_near(prints: DataFrame, radius: int, chosen: Column) -> DataFrame:
    """``prints`` (id, fp, ...) with ``n_near``: for the ``chosen`` rows the
    number of other rows within ``radius``, else null."""
    weight = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"))
    pairs = within_radius(prints.where(chosen).select("fp"), weight.select("fp"), radius)
    near = pairs.join(weight, "fp").groupBy("q").agg((F.sum("rows") - 1).alias("n_near"))
    near = near.select(F.col("q").alias("_q"), F.lit(True).alias("_asked"), "n_near")
    return prints.join(near, (F.col("fp") == F.col("_q")) & F.col("_asked") & chosen, "left").drop("_q", "_asked")
