"""Centroid clustering (Lloyd's rounds) in whole numbers, filtered by a rotation.

Every component is floored to an integer grid, so distances, sums and the new
centroids are exact integers and do not depend on the order of rows or tasks.

The vectors' principal axes are found from their moments, which tasks add up
and the driver decomposes (one matrix of dims x dims).  Each vector is stored
once with its first ``lead`` rotated coordinates and the norm of the others.
For a vector and a centroid, the squared distance of the leading coordinates
plus the squared difference of the two residual norms is never more than their
squared distance.  A round takes the centroid with the least such bound,
computes its distance in integers, and then verifies, in integers, just the
centroids whose bound does not exceed it; a margin covers the rounding of the
floating-point bound, so the filter never changes a result.

A round is one pass over the stored vectors: each task sends one row of sums
per centroid, Spark adds them, and the driver keeps k centroids.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component are left out; a null id starts as the empty id; equal
vectors are separate rows; ties between centroids go to the smaller number,
ties between starting ids to the smaller vector; with fewer than ``k`` vectors
there are as many centroids as vectors; an empty table gives an empty result;
components of 2^19 or more in size (2^27 on the grid) raise an error, since
distances would leave 64 bits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadre.llm.common import narrow, written

#: Largest size of a grid component: 64 squared differences fit 64 bits.
LARGEST = 1 << 27
#: Relative margin of the bounds, far above the rounding of 64 products.
MARGIN = 1e-9
#: (vector, centroid) pairs verified at a time.
PAIRS = 1 << 14


@dataclass
class Rotation:
    """Mean and orthonormal axes (columns), the leading ones first."""
    mean: np.ndarray
    axes: np.ndarray
    lead: int

    def coordinates(self, v: np.ndarray) -> np.ndarray:
        """Leading rotated coordinates and the norm of the others."""
        turned = (v - self.mean) @ self.axes
        return np.concatenate([turned[:, :self.lead], np.sqrt((turned[:, self.lead:] ** 2).sum(1))[:, None]], axis=1)


def nearest(v: np.ndarray, coords: np.ndarray, centroids: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, smaller numbers on ties,
    and how many distances were computed.

    ``v`` and ``centroids`` are integers; ``coords`` and ``turned`` their
    rotated coordinates.
    """
    size = (coords ** 2).sum(1)[:, None] + (turned ** 2).sum(1)[None, :]
    bound = size - 2 * coords @ turned.T - MARGIN * (size + 1)
    rows = np.arange(len(v))
    guess = bound.argmin(1)
    # what has not been computed is larger than all distances
    found = np.full(bound.shape, np.iinfo(np.int64).max)
    best = _squared(v, centroids, rows, guess)
    found[rows, guess] = best
    bound[rows, guess] = np.inf
    i, j = np.nonzero(bound <= best[:, None])
    found[i, j] = _squared(v, centroids, i, j)
    cluster = found.argmin(1)  # the first of equal ones
    return cluster, found[rows, cluster], len(rows) + len(i)


def _squared(v: np.ndarray, centroids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), PAIRS):
        d = v[i[lo:lo + PAIRS]] - centroids[j[lo:lo + PAIRS]]
        out[lo:lo + PAIRS] = (d * d).sum(1)
    return out


# -- Spark -------------------------------------------------------------------

def on_grid(vectors: DataFrame, dims: int, scale: int, seed: str, id_col: str, vec_col: str) -> DataFrame:
    """(id, h, v): kept vectors on the integer grid; ``h`` is the hash that
    orders the starting centroids."""
    base = narrow(vectors, id=id_col, x=vec_col)
    x = F.transform("x", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    base = base.where((F.size("x") == dims) & F.coalesce(finite, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    fits = F.forall(v, lambda c: F.abs(c) < F.lit(LARGEST))
    v = F.when(fits, v.cast("array<int>")).otherwise(F.raise_error(F.lit("a vector component is too large")).cast("array<int>"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return base.select("id", F.sha2(key, 256).alias("h"), v.alias("v"))


def starting_centroids(grid: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the least hashes, in that order.

    Hashes are even, so about ``10 k`` rows pass a threshold on the first 60
    bits; it is widened until ``k`` rows or all do.
    """
    n = grid.count()
    space, share = 1 << 60, min(1.0, 10 * k / max(n, 1))
    first = F.conv(F.substring("h", 1, 15), 16, 10).cast("long")
    while True:
        rows = grid.where(first < int(space * share)).orderBy("h", "id", "v").limit(k).select("v").collect()
        if len(rows) >= min(k, n) or share >= 1.0:
            return np.array([r["v"] for r in rows], np.int64)
        share = min(1.0, 16 * share)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def principal_axes(grid: DataFrame, dims: int, lead: int) -> Rotation:
    """Axes of the moments of all vectors: a task sends dims + 1 rows of sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for b in batches:
            v = np.concatenate([_matrix(b.column(0), dims, float), np.ones((b.num_rows, 1))], axis=1)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(list(total))], names=["i", "row"])

    sums = [F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(dims + 1)]
    got = {r["i"]: r for r in grid.select("v").mapInArrow(run, "i int, row array<double>").groupBy("i").agg(*sums).collect()}
    total = np.array([[got[i][f"s{j}"] for j in range(dims + 1)] for i in range(dims + 1)]) if got else np.zeros((dims + 1, dims + 1))
    n = max(total[dims, dims], 1.0)
    mean = total[dims, :dims] / n
    _, axes = np.linalg.eigh(total[:dims, :dims] / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), lead)


def rotated(grid: DataFrame, rotation: Rotation) -> DataFrame:
    """(id, v, coords) with the leading coordinates and the residual norm."""
    dims = len(rotation.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coords = rotation.coordinates(_matrix(b.column("v"), dims, float))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(list(coords), pa.list_(pa.float64()))], names=["id", "v", "coords"])

    return grid.select("id", "v").mapInArrow(run, f"id {grid.schema['id'].dataType.simpleString()}, v array<int>, coords array<double>")


def round_sums(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> dict[int, tuple[int, list[int]]]:
    """Per centroid the number and the component sums of its vectors."""
    dims = len(rotation.mean)
    turned = rotation.coordinates(centroids.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for b in batches:
            v = _matrix(b.column("v"), dims, np.int64)
            cluster, _, _ = nearest(v, _matrix(b.column("coords"), rotation.lead + 1, float), centroids, turned)
            n += np.bincount(cluster, minlength=len(centroids))
            np.add.at(sums, cluster, v)
        used = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    per_task = stored.select("v", "coords").mapInArrow(run, "cluster int, n long, sums array<long>")
    rows = per_task.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dims)]).collect()
    return {r["cluster"]: (r["n"], [r[f"s{j}"] for j in range(dims)]) for r in rows}


def assign(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> DataFrame:
    """(id, cluster, distance) of every stored vector."""
    dims = len(rotation.mean)
    turned = rotation.coordinates(centroids.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance, _ = nearest(_matrix(b.column("v"), dims, np.int64),
                                           _matrix(b.column("coords"), rotation.lead + 1, float), centroids, turned)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return stored.mapInArrow(run, f"id {stored.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2",
            lead: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, and the final centroids."""
    grid = written(on_grid(vectors, dims, scale, seed, id_col, vec_col), "grid")
    centroids = starting_centroids(grid, k).reshape(-1, dims)
    rotation = principal_axes(grid, dims, lead)
    stored = written(rotated(grid, rotation), "rotated")
    if not len(centroids):
        return stored.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")) \
            .withColumnRenamed("id", id_col), centroids
    for _ in range(rounds):
        for c, (n, sums) in round_sums(stored, centroids, rotation).items():
            centroids[c] = [s // n for s in sums]  # Python's // rounds down
    out = written(assign(stored, centroids, rotation), "assigned")
    return out.withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with ``cluster_inertia``, ``inertia`` and the digest of their
    final centroid (one small row per centroid is broadcast)."""
    spark = assigned.sparkSession
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    total = sum(r["s"] for r in per)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = [(r["cluster"], r["s"], total, digest[r["cluster"]]) for r in per]
    small = F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    names = [c for c in assigned.columns if c != "cluster"]
    return assigned.join(small, "cluster").select(names[0], "cluster", *names[1:], "cluster_inertia", "inertia", "centroid_sha256")
