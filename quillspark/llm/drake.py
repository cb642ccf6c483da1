"""Clustering around centroids with Drake's adaptive bounds.

Components become whole numbers and centroids are exact floors of exact means, so every machine,
partitioning and retry gives the same clusters. A vector carries an upper bound of the distance to its own
centroid, lower bounds of those to its few next nearest ones, in order, and one that holds for all the
rest. When centroids move, bounds move with them; a vector is compared with the first of its list up to the
bound that the upper one stays under, and with all centroids only where no bound certifies that.
Bounds count with a margin above the rounding of their sums, and a certificate is strict, so ties are always decided by the
exact comparison, for the smaller number.

Each round is one pass over the vectors: a task writes its vectors with their new bounds and, beside them, a row of
exact sums for each cluster it has seen; only those are brought together. The lists are cut to as many bounds as any
vector used in the round before (never below an eighth of the centroids).

Takes no part: a vector with another number of components, with null or non-finite ones, or with one that is not
below ``LARGEST`` after scaling (so that squared distances fit in 64 bits). A null vec_id is hashed as an empty one.
Rows that repeat are vectors each. With fewer vectors than centroids, each is one. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, scratch, temporary_tables

CLUSTERS = 8
ROUNDS = 10
DIMENSION = 64
SCALE = 1024
SEED = 3
#: Components that take part are below this in size.
LARGEST = 1 << 27
#: What rounding may add to a bound, in proportion; thousands of times more than it does.
MARGIN = 1e-9


@dataclass
class Bounds:
    """What is known of each of n vectors; ``near`` lists the numbers of the next nearest centroids, ``lower`` bounds their distances in rising order."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray


def squared(x: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of row i of ``x`` to the centroids ``which[i]``."""
    out = np.empty(which.shape, np.int64)
    for j in range(which.shape[1]):
        d = x - centroids[which[:, j]]
        np.einsum("ij,ij->i", d, d, out=out[:, j])
    return out


def rescan(x: np.ndarray, centroids: np.ndarray, listed: int) -> Bounds:
    """Bounds from the distances to all centroids; ``listed`` centroids get bounds of their own."""
    every = np.broadcast_to(np.arange(len(centroids), dtype=np.int32), (len(x), len(centroids)))
    d = squared(x, centroids, every)
    order = np.argsort(d, axis=1, kind="stable").astype(np.int32)  # equal ones by number
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = far[:, listed + 1] if listed + 1 < len(centroids) else np.full(len(x), np.inf)
    return Bounds(order[:, 0], far[:, 0], order[:, 1 : listed + 1], far[:, 1 : listed + 1], rest)


def moved(b: Bounds, drift: np.ndarray) -> Bounds:
    """Bounds that hold after centroid i has moved by ``drift[i]``; lower ones stay in rising order, each bounding all after it."""
    lower = b.lower * (1 - MARGIN) - drift[b.near] * (1 + MARGIN)
    rest = b.rest * (1 - MARGIN) - drift.max(initial=0) * (1 + MARGIN)
    every = np.minimum.accumulate(np.concatenate([lower, rest[:, None]], 1)[:, ::-1], axis=1)[:, ::-1]
    return Bounds(b.cluster, b.upper * (1 + MARGIN) + drift[b.cluster] * (1 + MARGIN), b.near, every[:, :-1], every[:, -1])


def step(x: np.ndarray, b: Bounds, centroids: np.ndarray, drift: np.ndarray, listed: int) -> tuple[Bounds, int, int]:
    """Bounds and nearest centroids after a move; how many listed bounds were needed at most, and how many distances were taken."""
    b = moved(b, drift)
    b = Bounds(b.cluster, b.upper, b.near[:, :listed], b.lower[:, :listed], b.lower[:, listed] if listed < b.lower.shape[1] else b.rest)
    bound = np.concatenate([b.lower, b.rest[:, None]], 1)
    open_ = np.flatnonzero(b.upper >= bound[:, 0])
    b.upper[open_] = np.sqrt(squared(x[open_], centroids, b.cluster[open_, None])[:, 0].astype(np.float64)) * (1 + MARGIN)
    taken = len(open_)
    # How many of the list may be nearer: up to the first bound that lies above.
    certain = b.upper[open_, None] < bound[open_]
    depth = np.where(certain.any(1), certain.argmax(1), listed + 1)
    used = int(min(depth.max(initial=0), listed))
    for z in np.unique(depth[depth > 0]).tolist():
        rows = open_[depth == z]
        if z > listed:
            new = rescan(x[rows], centroids, listed)
            b.cluster[rows], b.upper[rows], b.near[rows], b.lower[rows], b.rest[rows] = new.cluster, new.upper, new.near, new.lower, new.rest
            taken += len(rows) * len(centroids)
            continue
        which = np.concatenate([b.cluster[rows, None], b.near[rows, :z]], 1)
        d = squared(x[rows], centroids, which)
        order = np.lexsort((which, d), axis=1)
        which, far = np.take_along_axis(which, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        b.cluster[rows], b.upper[rows], b.near[rows, :z] = which[:, 0], far[:, 0], which[:, 1:]
        # A listed distance bounds only its own centroid; the order of bounds is kept by the next move.
        b.lower[rows, :z] = far[:, 1:]
        taken += which.size
    return b, used, taken


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and q, floor(scale * component) as integers, of the vectors that take part."""
    raw = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dimension)
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -float(LARGEST) / scale) & (x < float(LARGEST) / scale))
    return raw.filter(F.coalesce(fits, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), width)


_STATE = "kind int, vec_id bigint, q array<int>, cluster int, upper double, near array<int>, lower array<double>, rest double, distance bigint, n bigint, sums array<bigint>, used int, taken bigint"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_TYPES = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]] for c in _STATE.split(", ")]
_VECTORS, _SUMS = 0, 1


def _rows(length: int, kind: int, /, **columns: pa.Array) -> pa.RecordBatch:
    columns["kind"] = pa.array(np.full(length, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(length, t)) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _pass(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, listed: int) -> DataFrame:
    """Vectors with new bounds, and a row of sums for each cluster of each task. Without ``drift`` there are no bounds yet."""
    k, dimension = centroids.shape
    rows = rows.select("vec_id", "q", *(() if drift is None else ("cluster", "upper", "near", "lower", "rest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, used, taken = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("q"), dimension, np.int64)
            if drift is None:
                state, depth, work = rescan(x, centroids, listed), 0, len(x) * k
            else:
                width = len(b.column("near")[0])
                held = Bounds(*(b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper")), _matrix(b.column("near"), width, np.int32), _matrix(b.column("lower"), width, np.float64), b.column("rest").to_numpy(zero_copy_only=False))
                state, depth, work = step(x, held, centroids, drift, listed)
            used, taken = max(used, depth), taken + work
            order = np.argsort(state.cluster, kind="stable")
            there, first = np.unique(state.cluster[order], return_index=True)
            sums[there] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(state.cluster, minlength=k)
            exact = squared(x, centroids, state.cluster[:, None])[:, 0]
            yield _rows(len(x), _VECTORS, vec_id=b.column("vec_id"), q=b.column("q"), cluster=pa.array(state.cluster, pa.int32()), upper=pa.array(state.upper), near=_lists(state.near, pa.int32()), lower=_lists(state.lower, pa.float64()), rest=pa.array(state.rest), distance=pa.array(exact))
        there = np.flatnonzero(counts)
        if len(there):
            n = len(there)
            yield _rows(n, _SUMS, cluster=pa.array(there.astype(np.int32)), n=pa.array(counts[there]), sums=_lists(sums[there], pa.int64()), used=pa.array(np.full(n, used, np.int32)), taken=pa.array(np.where(np.arange(n) == 0, taken, 0)))

    return rows.mapInArrow(run, _STATE)


def _totals(state: DataFrame) -> list[tuple]:
    """cluster, n, sums, used, taken of each cluster: one row a cluster."""
    each = state.filter(F.col("kind") == _SUMS).select("cluster", "n", "used", "taken", F.posexplode("sums").alias("at", "s"))
    by_component = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("used").alias("used"), F.sum("taken").alias("taken"))
    whole = by_component.groupBy("cluster").agg(F.max("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda p: p["s"]), F.max("used"), F.max("taken"))
    return whole.collect()


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components), n_distances (taken in all) of every vector that takes part."""
    spark = rows.sparkSession
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        given = quantised(rows, dimension=dimension, scale=scale)
        start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        first = given.select(start.alias("h"), "q").orderBy("h", "q").limit(k).collect()
        if not first:
            return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>, n_distances bigint")
        centroids = np.array([r.q for r in first], np.int64)
        k = len(centroids)
        listed, drift, work = min(max(2, math.ceil(k / 4)), k - 1), None, 0
        state = given
        for done in range(rounds + 1):
            new = scratch(_pass(state, centroids, drift, listed), f"drake-{done}", partition_by=("kind",))
            if state is not given:
                discard(state)
            state, totals = new, _totals(new)
            work += sum(t[4] for t in totals)
            if done == rounds:
                break
            if drift is not None:
                listed = min(listed, max(1, math.ceil(k / 8), *(t[3] for t in totals)))
            old = centroids.copy()
            for c, n, sums, *_ in totals:
                centroids[c] = [s // n for s in sums]
            drift = np.sqrt(((centroids - old) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
            state = state.filter(F.col("kind") == _VECTORS)
            state.scratch_path = new.scratch_path
        keep.append(state)
    vectors = state.filter(F.col("kind") == _VECTORS)
    inertia = vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("c")).collect()  # a row for each centroid
    whole = sum(int(r.c) for r in inertia)
    fits = lambda x: x if x < 1 << 63 else None
    stats = spark.createDataFrame([(r.cluster, fits(int(r.c)), fits(whole), centroids[r.cluster].tolist(), work) for r in inertia], "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, n_distances bigint")
    return vectors.select("vec_id", "cluster", "distance").join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "n_distances")
