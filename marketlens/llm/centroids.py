"""K-means over integers, its distances pruned by a table of pivot distances (LAESA).

Vectors become integers once, and with each its squared distances to fixed pivots are stored: the first centroids serve as
pivots, so bounds are tightest where centroids start. A round knows the distance of every centroid to every pivot. By
the triangle inequality |d(vector, pivot) - d(pivot, centroid)|, at its largest over the pivots, is a lower bound of
d(vector, centroid). A vector visits the centroids by rising bound, takes exact integer distances, and stops where the bound exceeds
the best so far. Bounds are floating point and are lowered by more than their error, distances and sums are integers, so the
result is that of comparing all.

A round is one scan: tasks return a count and sums per centroid, Spark adds them, and only centroids (``k`` rows of 64 numbers)
reach the driver. Nothing is shuffled by vector or cluster, so a cluster of any size is no hot key.

Defined results: vectors that are null, not of ``SIZE`` components, or hold a null, NaN or infinite component are left out;
components are held within +-``LARGEST``, so that a squared distance fits a long; ties of distance go to the smaller centroid;
a null vec_id hashes as ''; of equal ids the smaller vector starts first; rows that repeat count each; with fewer vectors than ``k``
there are as many centroids; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import staged

K, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, "1"
LARGEST = 1 << 27
#: Vectors that a task compares at once.
CHUNK = 4096


def quantised(vectors: DataFrame, column: str = "embedding", size: int = SIZE) -> DataFrame:
    """vec_id, v: floor(SCALE * x) of each component as integers, of the vectors that are whole."""
    x = F.transform(column, lambda c: c.cast("double"))
    rows = vectors.filter(F.size(column) == size).select("vec_id", x.alias("x"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform("x", lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c, F.lit(-1e9)), F.lit(1e9)) * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return rows.filter(whole).select("vec_id", held.alias("v"))


def start_hash() -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest hashes: a bounded top list, taken per task first."""
    rows = vectors.select(start_hash().alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), SIZE)


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """Lists of equal length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b, one row of b at a time."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        apart = a - row
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds p: the squared distances of each vector to the pivots."""

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                far = squared(matrix(part.column("v")), pivots)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(pivots)), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "p"])

    return vectors.mapInArrow(measure, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<int>, p array<long>")


@dataclass
class Bounds:
    """Centroids with their distances to the pivots."""

    centroids: np.ndarray
    to_pivots: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, pivots: np.ndarray) -> Bounds:
        return Bounds(centroids, np.sqrt(squared(centroids, pivots).astype(np.float64)))

    def lower(self, p: np.ndarray) -> np.ndarray:
        """Per vector and centroid a number not above their distance, from squared distances to the pivots."""
        mine = np.sqrt(p.astype(np.float64))
        out = np.zeros((len(p), len(self.centroids)))
        for j in range(p.shape[1]):
            here, there = mine[:, j, None], self.to_pivots[None, :, j]
            np.maximum(out, np.abs(here - there) - 1e-12 * (here + there) - 1e-9, out=out)
        return out

    def nearest(self, v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid, exact squared distance, and how many exact distances it took."""
        lower = self.lower(p)
        visit = np.argsort(lower, axis=1, kind="stable")
        best, number, taken = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), len(self.centroids)), np.zeros(len(v), np.int64)
        active = np.arange(len(v))
        for turn in range(len(self.centroids)):
            candidate = visit[active, turn]
            near = lower[active, candidate] <= np.sqrt(best[active].astype(np.float64))
            active, candidate = active[near], candidate[near]
            if not len(active):
                break
            apart = v[active] - self.centroids[candidate]
            far = np.einsum("ij,ij->i", apart, apart)
            won = (far < best[active]) | ((far == best[active]) & (candidate < number[active]))
            best[active[won]], number[active[won]] = far[won], candidate[won]
            taken[active] += 1
        return number, best, taken


def round_sums(rows: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """One row per centroid that has vectors in this task: cluster, n, sums of the components."""
    sums, count = np.zeros_like(bounds.centroids), np.zeros(len(bounds.centroids), np.int64)
    for batch in rows:
        for at in range(0, len(batch), CHUNK):
            part = batch.slice(at, CHUNK)
            v = matrix(part.column("v"))
            number, _, _ = bounds.nearest(v, matrix(part.column("p")))
            for j in np.unique(number):
                sums[j] += v[number == j].sum(axis=0)
            count += np.bincount(number, minlength=len(count))
    used = np.flatnonzero(count)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums[used].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], ["cluster", "n", "sums"])


def moved(table: DataFrame, bounds: Bounds) -> np.ndarray:
    """Centroids after one round: componentwise floor of the exact mean, a centroid without vectors as it was."""
    parts = table.select("v", "p").mapInArrow(lambda rows: round_sums(rows, bounds), "cluster long, n long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(bounds.centroids.shape[1])]
    after = bounds.centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # one row per centroid
        after[row["cluster"]] = [int(s) // row["n"] for s in row[2:]]
    return after


def assigned(table: DataFrame, bounds: Bounds) -> DataFrame:
    """vec_id, cluster, distance, n_exact per vector."""

    def assign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                number, far, taken = bounds.nearest(matrix(part.column("v")), matrix(part.column("p")))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(far), pa.array(taken)],
                                                 ["vec_id", "cluster", "distance", "n_exact"])

    return table.mapInArrow(assign, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, n_exact long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Per vector: vec_id, cluster, distance (squared), n_exact; and the final centroids, one row each."""
    kept = staged(quantised(vectors), "vectors")
    centroids = pivots = first_centroids(kept, k)
    table = staged(with_pivots(kept, pivots), "pivots")
    for _ in range(rounds if len(pivots) else 0):
        centroids = moved(table, Bounds.of(centroids, pivots))
    return assigned(table, Bounds.of(centroids, pivots)), centroids


def report(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact."""
    found, centroids = cluster(vectors, k, rounds)
    found = staged(found, "clusters")
    spark = vectors.sparkSession
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    facts = spark.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), name) for i, name in enumerate(names)], schema)  # k rows
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")
