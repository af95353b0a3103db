"""Clusters by centroids over integer vectors, with Elkan's bounds kept from round to round.

A vector's row carries its cluster, an upper bound of the distance to that centroid and a lower bound of
the distance to each centroid. When centroids move, bounds move by as much; a centroid is left out where
the upper bound is below its lower bound or below half the distance of the two centroids. Bounds are
rounded outwards and comparisons are strict, so that what is left out is farther, never as far: ties reach
the exact integer distances that decide.

A round is one pass: it reads the rows, moves bounds, assigns, writes the rows, and adds a row of exact
sums for each centroid and task. These are added up by centroid and component, and only the centroids,
``clusters`` rows, come to the driver and go out with the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, release, shared_dir, stored

#: Vectors that a task works on at once.
SLICE = 4096
#: Components must be below this in absolute value, so that a squared distance of 64 of them fits 63 bits.
LARGEST = 1 << 27

ROWS = "vec_id long, own array<bigint>, cluster int, upper double, lower array<float>, distance long, sums array<decimal(38,0)>"


def integers(vectors: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, own``: vectors with exactly so many finite components, as floor(scale * x)."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))  # NaN is above all
    floors = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return vectors.where((F.size(x) == dimensions) & finite).select(F.col(id_col).cast("long").alias("vec_id"), floors.alias("own"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every sum on the way is an integer that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.empty((len(x), 0), np.int64)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Single precision, not above the double."""
    out = x.astype(np.float32)
    return np.where(out > x, np.nextafter(out, np.float32(-np.inf)), out)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the square roots of integers, from below and above."""
    d = np.sqrt(squares.astype(np.float64))  # the conversion and the root each err by half a unit at most
    return _below(_below(d)), _above(_above(d))


class Round:
    """One assignment to centroids that came from others."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        between = roots(squared(centroids, centroids))[0]
        self.half = between / 2  # exact: a power of two
        apart = self.half + np.where(np.eye(len(centroids)), np.inf, 0)
        self.nearest = apart.min(1) if len(centroids) > 1 else np.full(len(centroids), np.inf)
        self.moved = None
        if before is not None:
            self.moved = roots(((centroids - before) ** 2).sum(1))[1]

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bounds after this round, and how many distances were worked out."""
        rows = np.arange(len(x))
        if self.moved is None:
            d = squared(x, self.centroids)
            cluster = d.argmin(1)  # the first of the least
            below, above = roots(d)
            return cluster, above[rows, cluster], below, np.full(len(x), d.shape[1])
        lower = _below(lower - self.moved[None])
        upper = _above(upper + self.moved[cluster])
        cluster, counted = cluster.copy(), np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(upper >= self.nearest[cluster])
        if len(open_):
            x_, own = x[open_], cluster[open_]
            exact = ((x_ - self.centroids[own]) ** 2).sum(1)
            below, above = roots(exact)
            upper[open_], lower[open_, own] = above, below
            counted[open_] = 1
            may = (above[:, None] >= lower[open_]) & (above[:, None] >= self.half[own])
            may[np.arange(len(open_)), own] = False
            at, c = np.nonzero(may)
            d = ((x_[at] - self.centroids[c]) ** 2).sum(1)
            below, above = roots(d)
            lower[open_[at], c] = below
            counted[open_] += may.sum(1)
            # the least distance, and of several the smaller number: the own one takes part
            at, c, d, above = np.concatenate([at, np.arange(len(open_))]), np.concatenate([c, own]), np.concatenate([d, exact]), np.concatenate([above, upper[open_]])
            order = np.lexsort((c, d, at))
            first = order[np.searchsorted(at[order], np.arange(len(open_)))]
            cluster[open_], upper[open_] = c[first], above[first]
        return cluster, upper, lower, counted


def _pass(step: Round, final: bool):
    """Rows to rows with the next bounds, and at a task's end a row of sums for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = step.centroids.shape
        n, total, inertia = np.zeros(k, np.int64), np.zeros((k, dims), object), np.zeros(k, object)
        names = ["vec_id", "own", "cluster", "upper", "lower", "distance", "sums"]
        longs, floats, exact = pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.decimal128(38, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                x, rows = _matrix(b.column(1)), b.num_rows
                if np.abs(x).max(initial=0) >= LARGEST:
                    raise ValueError(f"a component is {LARGEST} or more after scaling: squared distances would not fit 63 bits")
                if b.num_columns == 2:
                    cluster, upper, lower, _ = step.assign(x, np.empty(0), np.empty(0), np.empty(0))
                else:
                    cluster, upper, lower, _ = step.assign(x, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().copy(), _matrix(b.column(4)).astype(np.float64))
                distance = ((x - step.centroids[cluster]) ** 2).sum(1) if final else None
                hit = np.unique(cluster)
                n += np.bincount(cluster, minlength=k)
                for c in hit.tolist():
                    own = cluster == c
                    total[c] += x[own].sum(0)
                    if final:
                        inertia[c] += sum(distance[own].tolist())
                own = b.column(1) if not final else pa.nulls(rows, longs)
                kept = pa.FixedSizeListArray.from_arrays(pa.array(_narrow(lower).ravel()), k).cast(floats) if not final else pa.nulls(rows, floats)
                yield pa.record_batch([b.column(0), own, pa.array(cluster.astype(np.int32)), pa.array(upper) if not final else pa.nulls(rows, pa.float64()), kept, pa.array(distance) if final else pa.nulls(rows, pa.int64()), pa.nulls(rows, exact)], names)
        hit = np.flatnonzero(n)
        said = pa.array([[*map(int, total[c]), int(n[c]), int(inertia[c])] for c in hit], exact)
        yield pa.record_batch([pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), longs), pa.array(hit.astype(np.int32)), pa.nulls(len(hit), pa.float64()), pa.nulls(len(hit), floats), pa.nulls(len(hit), pa.int64()), said], names)

    return run


def _summed(rows: DataFrame) -> dict[int, list[int]]:
    """Of each centroid that has vectors: the sum of each component, the vectors, the inertia."""
    cells = rows.where("sums is not null").select("cluster", F.posexplode("sums").alias("at", "v"))
    out: dict[int, list[int]] = {}
    for r in cells.groupBy("cluster", "at").agg(F.sum("v").alias("v")).orderBy("cluster", "at").collect():  # a row a centroid and component
        out.setdefault(r.cluster, []).append(int(r.v))
    return out


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors of the ids with the least hashes. Equal ids: the lesser vector first; null ids come last."""
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select("own", hashed.alias("hash")).orderBy(F.asc_nulls_last("hash"), "own").limit(clusters).collect()
    return np.array([r.own for r in first], np.int64)


def clustered(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors are those with exactly ``dimensions`` components, none null, NaN or infinite; others give no row.
    Null ids and repeated rows are vectors of their own; with fewer vectors than ``clusters`` there are as many
    centroids; an empty table gives no rows; equally near centroids: the smaller number; other columns,
    whatever their names, are not read. Components of ``LARGEST`` or more after scaling, and an inertia over 63 bits, are an error.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = integers(vectors, dimensions, scale, id_col, vector_col)
    centroids, before = first_centroids(rows, clusters, seed), None
    made = None
    for at in range(rounds + 1 if len(centroids) else 0):
        final = at == rounds
        own = rows if made is None else made.where("sums is null").select("vec_id", "own", "cluster", "upper", "lower")
        now = stored(map_arrow(own, _pass(Round(centroids, before), final), ROWS), "rows")
        if made is not None:
            release(made)
        made = now
        found = _summed(made)
        if not final:
            before, centroids = centroids, centroids.copy()
            for c, (*cells, n, _) in found.items():
                centroids[c] = [v // n for v in cells]
    if made is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole = sum(x[-1] for x in found.values())
    if whole >= 1 << 63:
        raise ValueError("the sum of squared distances does not fit 63 bits")
    ends = spark.createDataFrame([(c, x[-1], whole, digest[c]) for c, x in found.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.where("sums is null").select("vec_id", "cluster", "distance").join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
