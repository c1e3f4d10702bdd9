"""Centroid clustering of integer vectors by sort-means.

Each round sorts, for each centroid, the others by their distance from it. A vector scans that order from the centroid that
it was last assigned to, and stops at the first one strictly more than twice as far from that centroid as the vector is:
from there on, by the triangle inequality, every centroid is further from the vector than its last one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .vectors import check_range, floored, matrix, squared, whole_vectors


class SortedCentroids:
    """For each centroid the order of all by distance (itself first) and the squared distances in that order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        apart = np.stack([squared(np.broadcast_to(c, centroids.shape), centroids) for c in centroids])
        apart[np.arange(k), np.arange(k)] = -1  # before centroids that equal it
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.maximum(np.take_along_axis(apart, self.order, 1), 0)

    def nearest(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each row, ties to the smaller number, and how many distances were computed."""
        own = squared(x, self.centroids[last])
        best, index, compared = own.copy(), last.astype(np.int64).copy(), len(x)
        rows = np.arange(len(x))
        for step in range(1, len(self.centroids)):
            rows = rows[(self.apart[last[rows], step] + 3) // 4 <= own[rows]]  # apart <= 4 * own, without overflow
            if not len(rows):
                break
            other = self.order[last[rows], step]
            far = squared(x[rows], self.centroids[other])
            compared += len(rows)
            better = (far < best[rows]) | ((far == best[rows]) & (other < index[rows]))
            best[rows[better]], index[rows[better]] = far[better], other[better]
        return index, best, compared


SCHEMA = "id long, v array<long>, cluster int, distance long"


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (id, v, cluster, distance) with each vector's nearest centroid, scanned from its last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = SortedCentroids(centroids)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), b.num_rows)
                check_range(x, x.shape[1])
                index, best, _ = known.nearest(x, b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(index, pa.int32()), pa.array(best, pa.int64())], ["id", "v", "cluster", "distance"])

    return rows.select("id", "v", "cluster", "distance").mapInArrow(run, SCHEMA)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid with vectors becomes their componentwise floor(sum / count); sums of len(centroids) groups come back."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for b in batches:
            if b.num_rows:
                x, cluster = matrix(b.column(1), b.num_rows), b.column(0).to_numpy()
                order = np.argsort(cluster, kind="stable")
                used, at = np.unique(cluster[order], return_index=True)
                n += np.bincount(cluster, minlength=k)
                total[used] += np.add.reduceat(x[order], at, axis=0)
        used, pos = np.nonzero(np.broadcast_to(n[:, None], total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(pos, pa.int32()), pa.array(n[used]), pa.array(total[used, pos])], ["cluster", "pos", "n", "total"])

    parts = rows.select("cluster", "v").mapInArrow(run, "cluster int, pos int, n long, total long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    return out


def clusters(table: DataFrame, k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector of dims components.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Centroids start as the
    k rows of smallest sha256 of "seed:id" (then smallest vector; null ids come last), fewer if there are fewer. Repeated
    rows count as often as they occur, and rows of one id are clustered each by itself. Each round stages the integers
    with their assignment, which the next scan starts from, and brings k * dims sums to the driver. An empty table gives
    no rows. Components so large that a squared distance exceeds 64 bits raise an OverflowError.
    """
    v = floored(scale, vector_col)
    rows = table.where(whole_vectors(vector_col) & (F.size(vector_col) == dims)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = staged(rows.select("id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "integers")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select("v", mark.alias("mark")).orderBy(F.col("mark").isNull(), "mark", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    check_range(centroids, dims)
    for step in range(rounds + 1 if len(first) else 0):
        after = staged(assigned(rows, centroids), "assigned")
        discard(rows)
        rows = after
        if step < rounds:
            centroids = moved(rows, centroids)
    sums = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = lambda values, kind: F.array(*(F.lit(x).cast(kind) for x in values))[F.col("cluster")] if values else F.lit(None).cast(kind)
    each = [sums.get(c, 0) for c in range(len(first))]
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", of_cluster(each, "long").alias("cluster_inertia"), F.lit(sum(each)).cast("long").alias("inertia"), of_cluster(marks, "string").alias("centroid_sha256"))
