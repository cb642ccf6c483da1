"""Approximate nearest neighbours: 2-stable projections in a kd-tree with a chi-square stopping test.

Unit vectors are projected by a seeded Gaussian matrix to PROJECTED dimensions. For a pair at
distance d the squared projected distance is d^2 times a chi-square variable with that many
degrees of freedom. Neighbours in the projection come one after another, leaves of the tree being opened as the order
reaches them, and are verified in full until the next is so far that a vector nearer than the k-th best so far would have been seen with probability CONFIDENCE.

The upper levels of the kd-tree are fitted on a sample of SAMPLE rows and split all rows into
cells; each cell, in one task, has a tree of its own down to leaves. A query first takes
its k-th distance within the sample, and then goes only to cells whose region passes the test at that
distance: so rows are moved once, whatever the number of queries, and queries are streamed past
the rows of a cell. Cells that many equal rows make too large are cut by a hash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import lean, scratch, temporary_tables

PROJECTED = 16
#: Probability with which each true neighbour lies within the radius that was searched.
CONFIDENCE = 0.95
LEAF = 128
SEED = 20240607
#: Rows on which the cells are fitted, at most; a cell takes this many of them at least.
SAMPLE, SAMPLE_LEAF = 16384, 16
#: Rows of a cell: a 64th of the table within these bounds.
CELL_ROWS = (2048, 32768)
#: Queries that are compared with a leaf at once.
TOGETHER = 128


def chi_square_quantile(p: float, df: int) -> float:
    """Quantile of the chi-square distribution for even ``df``."""
    if df % 2:
        raise ValueError("df must be even")

    def above(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return total

    lo, hi = 0.0, 10.0 * df + 1000
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if above(mid) > 1 - p else (lo, mid)
    return hi


class KdTree:
    """Median splits on the widest dimension; ``low`` and ``high`` bound what each leaf can hold, ``rows`` are its rows.

    With ``regions`` a leaf's bounds are the cuts above it, which hold for any point that falls there.
    """

    def __init__(self, points: np.ndarray, leaf: int, regions: bool = False):
        self.rows: list[np.ndarray] = []
        self.cuts: list[tuple[int, float, int, int]] = []
        low, high = [], []
        end = np.full(points.shape[1], np.inf)

        def grow(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            """Number of a node: of a cut, or -1 less that of a leaf."""
            p = points[rows]
            axis = int(np.argmax(np.ptp(p, axis=0))) if len(rows) else 0
            at = float(np.median(p[:, axis])) if len(rows) > leaf else 0.0
            right = p[:, axis] >= at if len(rows) > leaf else np.zeros(0, bool)
            if len(rows) <= leaf or right.all() or not right.any():
                self.rows.append(rows)
                low.append(lo if regions or not len(rows) else p.min(0))
                high.append(hi if regions or not len(rows) else p.max(0))
                return -len(self.rows)
            node = len(self.cuts)
            self.cuts.append((axis, at, 0, 0))
            below, above = hi.copy(), lo.copy()
            below[axis] = above[axis] = at
            self.cuts[node] = axis, at, grow(rows[~right], lo, below), grow(rows[right], above, hi)
            return node

        self.root = grow(np.arange(len(points)), -end, end)
        self.low, self.high = np.stack(low), np.stack(high)

    def place(self, points: np.ndarray) -> np.ndarray:
        """Number of the leaf where each point falls."""
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, at, left, right = self.cuts[node]
            above = points[rows, axis] >= at
            todo += [(left, rows[~above]), (right, rows[above])]
        return out

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to the bounds of each leaf."""
        out = np.empty((len(points), len(self.rows)))
        for leaf in range(len(self.rows)):
            gap = np.maximum(self.low[leaf] - points, 0) + np.maximum(points - self.high[leaf], 0)
            out[:, leaf] = (gap * gap).sum(1)
        return out


def axes(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, PROJECTED))


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def project(vectors: np.ndarray) -> np.ndarray:
    return vectors / _norms(vectors)[:, None] @ axes(vectors.shape[1])


class Cell:
    """The rows of a cell in a tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        # Of equal vectors only the least ids can be answers, and one may be the query itself.
        order = np.lexsort((ids, *vectors.T))
        v = vectors[order]
        begins = np.concatenate([[True], (v[1:] != v[:-1]).any(1)])
        nth = np.arange(len(v)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        order = order[nth <= k]
        self.ids, self.vectors, self.k = ids[order], vectors[order], k
        self.norms, self.low = _norms(self.vectors), project(self.vectors)
        self.squares = (self.low * self.low).sum(1)
        self.tree, self.reach = KdTree(self.low, LEAF), chi_square_quantile(CONFIDENCE, PROJECTED)

    def search(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids and cosines of up to k rows for each query, best first, and how many rows were verified. ``bound``: squared distance that need not be exceeded."""
        norms, low = _norms(queries), project(queries)
        gaps, squares = self.tree.gaps(low), (low * low).sum(1)
        out = [self._one(ids[x], queries[x], norms[x], low[x], squares[x], gaps[x], bound[x]) for x in range(len(ids))]
        return [o[0] for o in out], [o[1] for o in out], np.array([o[2] for o in out], np.int64)

    def _one(self, own: int, query: np.ndarray, norm: float, low: np.ndarray, square: float, gaps: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows in order of their projected distance, leaves being opened by their gap as that order reaches them; the test is asked before every few rows."""
        leaves = np.argsort(gaps, kind="stable")
        found, score, verified = np.empty(0, np.int64), np.empty(0), 0
        rows, away = np.empty(0, np.int64), np.empty(0)  # opened and not yet verified, nearest first
        at, wave, few = 0, 1, 4 * self.k
        while True:
            known = gaps[leaves[at]] if at < len(leaves) else np.inf  # all rows nearer than this are open
            ready = int(np.searchsorted(away, known, side="right"))
            enough = len(found) >= self.k or verified >= few
            if not ready:
                if at == len(leaves) or (enough and known > bound * self.reach + 1e-9):
                    break
                opened = np.concatenate([self.tree.rows[leaf] for leaf in leaves[at : at + wave]])
                opened = opened[self.ids[opened] != own]
                apart = square + self.squares[opened] - 2 * self.low[opened] @ low
                rows, away = np.concatenate([rows, opened]), np.concatenate([away, apart])
                order = np.argsort(away, kind="stable")
                rows, away = rows[order], away[order]
                at, wave = at + wave, wave * 2
                continue
            if enough and away[0] > bound * self.reach + 1e-9:
                break
            r, rows, away = rows[: min(ready, few)], rows[min(ready, few) :], away[min(ready, few) :]
            # Products are added in the same order for every pair, so equal rows give equal numbers.
            cosine = np.einsum("ij,j->i", self.vectors[r], query) / (self.norms[r] * norm)
            verified += len(r)
            found, score = np.concatenate([found, self.ids[r]]), np.concatenate([score, cosine])
            top = np.lexsort((found, -score))[: self.k]
            found, score = found[top], score[top]
            if len(top) == self.k:
                bound = min(bound, max(0.0, 2 - 2 * score[-1]))
        return found, score, verified


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    v = b.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def nearest(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of ``table`` with the largest cosine to each of ``queries`` (both vec_id bigint, embedding).

    Returns query_id, rank (from 1), vec_id, score and verified (rows compared in full for the query), ties to the smaller vec_id. Null, zero and
    non-finite vectors and null ids take no part; vectors of another length are no candidates; a
    query's own row is none; fewer candidates give fewer rows. Of rows that share a
    vec_id each is a candidate, and the least vector is the query. Other columns are not
    read; an empty table gives an empty result.
    """
    pick = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows, asked = pick(table), pick(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    widths = sorted(r["w"] for r in asked.select(F.size("v").alias("w")).distinct().collect())  # nearly always one
    if not widths:
        return asked.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified bigint")

    def every(asking: DataFrame, everywhere: bool) -> DataFrame:
        found = [_nearest(rows.filter(F.size("v") == w), asking.filter(F.size("v") == w), k, everywhere) for w in widths]
        return functools.reduce(DataFrame.unionByName, found)

    keep: list[DataFrame] = []
    with temporary_tables(keep):
        met = scratch(every(asked, False), "neighbours")
        # A query that came to fewer than k rows goes to every cell.
        full = met.filter("vec_id is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= k)
        short = scratch(asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short-queries")
        if not short.isEmpty():
            met = met.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
            met = scratch(met.unionByName(every(short, True)), "neighbours-all")
        keep.append(met)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    seen = F.sum("verified").over(Window.partitionBy("query_id"))
    ranked = met.select("query_id", "vec_id", "score", seen.alias("verified")).filter("vec_id is not null").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def _nearest(rows: DataFrame, asked: DataFrame, k: int, everywhere: bool = False) -> DataFrame:
    """``nearest`` for vectors of one length, with the best of every cell; with ``everywhere`` cells are not ruled out by the sample."""
    n = rows.count()
    size = min(max(n // 64, CELL_ROWS[0]), CELL_ROWS[1])
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).toArrow()
    ids, seeds = sample.column("vec_id").to_numpy(), _vectors(sample)
    cells = KdTree(project(seeds), max(SAMPLE_LEAF, math.ceil(len(seeds) * size / max(n, 1))), regions=True)
    seed_norms, reach = _norms(seeds), chi_square_quantile(CONFIDENCE, PROJECTED)
    shared = rows.sparkSession.sparkContext.broadcast((ids, seeds / seed_norms[:, None], cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value[2]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.place(project(_vectors(b))) if b.num_rows else np.empty(0, np.int32))], ["vec_id", "v", "cell"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seeds, cells = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(i, TOGETHER)
                v = _vectors(b)
                score = v / _norms(v)[:, None] @ seeds.T
                score[ids[None] == b.column("vec_id").to_numpy()[:, None]] = -2
                few = everywhere or score.shape[1] < k
                kth = np.full(len(v), -1.0) if few else np.partition(score, -k, 1)[:, -k]
                bound = np.full(len(v), np.inf) if everywhere else np.where(kth < -1, 4.0, 2 - 2 * kth) + 1e-9
                q, cell = np.nonzero(cells.gaps(project(v)) <= (bound * reach)[:, None])
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(q)), b.column("v").take(pa.array(q)), pa.array(cell.astype(np.int32)), pa.array(bound[q])], ["vec_id", "v", "cell", "bound"])

    placed = scratch(rows.mapInArrow(lean(place), "vec_id bigint, v array<double>, cell int"), "placed-rows")
    counted = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * size)).cast("int").alias("parts"))
    counted = F.broadcast(scratch(counted, "cells"))  # a row for each cell; these are no more than SAMPLE / SAMPLE_LEAF
    stored = placed.join(counted, "cell").select("cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("bound"))
    sent = asked.mapInArrow(lean(ask), "vec_id bigint, v array<double>, cell int, bound double").join(counted, "cell")
    sent = sent.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "v", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = None, [], None
        for whole in batches:
            cells, parts, asks = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "asks"))
            change = np.flatnonzero((cells[1:] != cells[:-1]) | (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1 if whole.num_rows else []
            for lo, hi in zip([0, *change], [*change, whole.num_rows], strict=True):
                if lo == hi:
                    continue
                b = whole.slice(lo, hi - lo)
                if now != (key := (cells[lo], parts[lo])):
                    now, held, cell = key, [], None
                if not asks[lo]:
                    held.append((b.column("vec_id").to_numpy(), _vectors(b)))
                    continue
                if not held:
                    continue
                cell = cell or Cell(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), k)
                for i in range(0, b.num_rows, TOGETHER):
                    some = b.slice(i, TOGETHER)
                    own = some.column("vec_id").to_numpy()
                    found, score, verified = cell.search(own, _vectors(some), some.column("bound").to_numpy())
                    times = [len(x) for x in found]
                    answers = [pa.array(np.repeat(own, times)), pa.array(np.concatenate(found)), pa.array(np.concatenate(score)), pa.array(np.zeros(sum(times), np.int64))]
                    told = [pa.array(own), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.float64()), pa.array(verified)]
                    yield pa.RecordBatch.from_arrays(answers, ["query_id", "vec_id", "score", "verified"])
                    yield pa.RecordBatch.from_arrays(told, ["query_id", "vec_id", "score", "verified"])

    dealt = stored.unionByName(sent).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
    return dealt.mapInArrow(lean(run), "query_id bigint, vec_id bigint, score double, verified bigint")
