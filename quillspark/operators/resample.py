"""Bootstrap intervals from value histograms, dealt down trees of binomial splits.

Resampling n rows with replacement is a multinomial draw over the histogram, so no row leaves the executors.
A cell's values are cut into leaves of LEAF distinct ones. A draw begins with n at the root of a binary tree over the
leaves; at each node a binomial number, seeded by cell, run of iterations and node, goes left and the rest right. A leaf finds its
own share by walking down its path, so leaves agree without talking to each other, and a unit of work (cell, leaf, run)
carries the totals of its path alone. Within its leaf a draw takes single rows where these are few and binomials where they are many.
Each leaf tells its part of the statistic; parts are added up by iteration.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.hist import histogram
from quillspark.operators.prefix import matched, prefix_sums, settled


@dataclass(frozen=True)
class Sums:
    """A statistic made of sums: of each of ``terms`` of the values drawn, and their number n."""

    terms: tuple[Callable[[np.ndarray], np.ndarray], ...]
    finish: Callable[[list[Column], Column], Column]


MEAN = Sums((lambda v: v,), lambda s, n: s[0] / n)
VARIANCE = Sums((lambda v: v, lambda v: v * v), lambda s, n: (s[1] - s[0] * s[0] / n) / n)
#: Names of statistics; a median is no sum and is told by ranks.
STATISTICS: dict[str, Sums | None] = {"mean": MEAN, "proportion": MEAN, "variance": VARIANCE, "median": None}
#: Distinct values of a leaf, iterations of a unit of work, and numbers drawn at once.
LEAF, RUN, DRAWN = 4096, 1000, 1 << 21
#: Rows a leaf's draw has for each distinct value when binomials become cheaper.
MANY = 8


def _rng(seed: int, key: object, *more: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode()), *more])


def down_the_tree(n: int, iterations: int, leaf: int, path: Sequence[tuple[int, int]], rng: Callable[..., np.random.Generator]) -> tuple[np.ndarray, np.ndarray]:
    """How many of n rows each iteration gives to a leaf, and to leaves before it. ``path``: rows of each node from the root down and of its left child."""
    mine, below = np.full(iterations, n, np.int64), np.zeros(iterations, np.int64)
    for level, (rows, left) in enumerate(path):
        node = leaf >> (len(path) - level)
        dealt = rng(level, node).binomial(mine, left / rows) if rows else np.zeros(iterations, np.int64)
        if leaf >> (len(path) - level - 1) & 1:
            mine, below = mine - dealt, below + dealt
        else:
            mine = dealt
    return mine, below


def _counts(rng: np.random.Generator, counts: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """How often each value is drawn, a row for each iteration."""
    if mine.sum() > MANY * len(counts) * len(mine):
        return rng.multinomial(mine, counts / counts.sum())
    at = np.searchsorted(np.cumsum(counts), rng.integers(0, counts.sum(), mine.sum()), side="right")
    rows = np.repeat(np.arange(len(mine)) * len(counts), mine)
    return np.bincount(rows + at, minlength=len(mine) * len(counts)).reshape(len(mine), -1)


def _sums(rng: np.random.Generator, terms: np.ndarray, counts: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Sums of the terms (a row each) over what is drawn."""
    if mine.sum() > MANY * len(counts) * len(mine):
        return rng.multinomial(mine, counts / counts.sum()) @ terms.T
    total = counts.sum()
    drawn = rng.integers(0, total, mine.sum(), dtype=np.int32 if total < 1 << 31 else np.int64)
    if total <= DRAWN:  # a place for each row
        terms = np.repeat(terms, counts, axis=1)
    else:
        drawn = np.searchsorted(np.cumsum(counts), drawn, side="right")
    if (mine == mine[0]).all():
        return np.stack([t.take(drawn).reshape(len(mine), -1).sum(1) for t in terms], 1)
    rows = np.repeat(np.arange(len(mine)), mine)
    return np.stack([np.bincount(rows, t.take(drawn), len(mine)) for t in terms], 1)


def _median_part(values: np.ndarray, counts: np.ndarray, below: np.ndarray, n: int) -> np.ndarray:
    """What a leaf adds to the median in each row of ``counts``, with ``below`` drawn from lower leaves and ``n`` in all."""
    upto = below[:, None] + counts.cumsum(1)
    out = np.zeros(len(counts))
    for rank in ((n - 1) // 2, n // 2):
        at = (upto <= rank).sum(1)
        out += np.where((rank >= below) & (at < len(values)), values[np.minimum(at, len(values) - 1)], 0.0) / 2
    return out[:, None]


def _leaves(h: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, leaf, values, counts, n (rows of the cell), below (rows of leaves before) and path: a row for each leaf of each cell."""
    ones = h.withColumn("one", F.lit(1))
    ones.known_rows = h.known_rows
    ranked = prefix_sums(ones, ["one", "n"], keys, ["v"])
    cut = ranked.withColumn("leaf", F.floor((F.col("cum_one") - 1) / LEAF).cast("int"))
    leaves = settled(cut.groupBy(*keys, "leaf").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("x"), F.sum("n").alias("rows"), F.max("cum_n").alias("upto")))
    cells = leaves.groupBy(*keys).agg(F.sum("rows").alias("n"), F.ceil(F.log2(F.max("leaf") + F.lit(1.0))).cast("int").alias("depth"))
    whole = matched(leaves, cells, keys)
    ancestor = F.expr("leaf div cast(pow(2, depth - level) as bigint)")
    # Rows of every node: level 0 is the root, the leaves are at the cell's depth.
    nodes = whole.select(*keys, "depth", "rows", "leaf", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    nodes = nodes.groupBy(*keys, "level", ancestor.alias("node")).agg(F.sum("rows").alias("total"))
    steps = whole.filter("depth > 0").select(*keys, "leaf", F.explode(F.expr("sequence(0, depth - 1)")).alias("level"), "depth")
    steps = matched(steps.withColumn("node", ancestor), nodes, [*keys, "level", "node"])
    left = nodes.filter("node % 2 = 0").select(*keys, (F.col("level") - 1).alias("level"), F.expr("node div 2").alias("node"), F.col("total").alias("left_total"))
    steps = matched(steps, left, [*keys, "level", "node"], "left")
    paths = steps.groupBy(*keys, "leaf").agg(F.sort_array(F.collect_list(F.struct("level", "total", F.coalesce("left_total", F.lit(0)).alias("left_total")))).alias("path"))
    done = matched(whole, paths, [*keys, "leaf"], "left")
    return done.select(*keys, "leaf", F.col("x.v").alias("values"), F.col("x.n").alias("counts"), "n", (F.col("upto") - F.col("rows")).alias("below"), F.col("path.total").alias("totals"), F.col("path.left_total").alias("lefts"))


def replicates(h: DataFrame, keys: Sequence[str], statistic: str | Sums, iterations: int, seed: int) -> DataFrame:
    """keys, i, s: the statistic in each iteration, and in the cell itself as iteration -1."""
    keys, h = list(keys), settled(h)
    made = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    terms = made.terms if made else ()
    width, runs = max(len(terms), 1), math.ceil(iterations / RUN)
    units = _leaves(h, keys).withColumn("run", F.explode(F.sequence(F.lit(-1), F.lit(runs - 1))))
    units = units.repartition(*keys, "leaf", "run")

    def unit(row: dict) -> tuple[int, np.ndarray]:
        key, run, leaf, n = tuple(row[k] for k in keys), int(row["run"]), int(row["leaf"]), int(row["n"])
        values, counts = np.asarray(row["values"], float), np.asarray(row["counts"], np.int64)
        of_values = np.array([t(values) for t in terms])
        if run < 0:
            return -1, (counts @ of_values.T)[None] if terms else _median_part(values, counts[None], np.array([row["below"]]), n)
        size = min(RUN, iterations - run * RUN)
        path = [] if row["totals"] is None else list(zip(row["totals"], row["lefts"], strict=True))
        mine, below = down_the_tree(n, size, leaf, path, lambda *node: _rng(seed, key, run, *node))
        own, found = _rng(seed, key, run, len(path), leaf, 1), []
        step = max(1, DRAWN // max(len(values), int(mine.max(initial=1)))) if mine.sum() <= MANY * len(values) * size or not terms else max(1, DRAWN // len(values))
        for i in range(0, size, step):
            part = mine[i : i + step]
            found.append(_sums(own, of_values, counts, part) if terms else _median_part(values, _counts(own, counts, part), below[i : i + step], n))
        return run * RUN, np.concatenate(found)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                first, found = unit(row)
                out = pd.DataFrame({"i": np.arange(first, first + len(found)), **{f"s{k}": found[:, k] for k in range(width)}, "n": int(row["n"])})
                for k in keys:
                    out[k] = pd.Series([row[k]] * len(out), dtype=object)
                yield out[[*keys, "i", "n", *(f"s{k}" for k in range(width))]]

    schema = ", ".join([*(f"`{k}` {h.schema[k].dataType.simpleString()}" for k in keys), "i bigint, n bigint", *(f"s{k} double" for k in range(width))])
    added = units.mapInPandas(work, schema).groupBy(*keys, "i").agg(F.max("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(width)))
    return added.select(*keys, "i", (made.finish([F.col(f"s{k}") for k in range(width)], F.col("n")) if made else F.col("s0")).alias("s"))


def _interval(level: float) -> list[Column]:
    drawn = F.when(F.col("i") >= 0, F.col("s"))
    return [F.max(F.when(F.col("i") < 0, F.col("s"))).alias("estimate"), F.percentile(drawn, F.lit((1 - level) / 2)).alias("ci_lo"), F.percentile(drawn, F.lit((1 + level) / 2)).alias("ci_hi")]


def bootstrap_ci(df: DataFrame, value: str, keys: Sequence[str], statistic: str | Sums = "mean", iterations: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """keys, n, estimate, ci_lo, ci_hi: percentile bootstrap of each cell.

    ``statistic`` is a name of STATISTICS or one of your own made of ``Sums``; values of a cell are never
    brought together. Runs with equal seeds agree. Cells without values give no row.
    """
    keys = list(keys)
    h = settled(histogram(df.withColumn(value, F.col(value).cast("double")), value, keys))
    cells = replicates(h, keys, statistic, iterations, seed).groupBy(*keys).agg(*_interval(level))
    return matched(cells, h.groupBy(*keys).agg(F.sum("n").alias("n")), keys).filter("n > 0").select(*keys, "n", "estimate", "ci_lo", "ci_hi")


def bootstrap_diff_ci(df: DataFrame, value: str, group: str, a: str, b: str, statistic: str | Sums = "mean", iterations: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """n1, n2, estimate, ci_lo, ci_hi of the difference of a statistic between two groups, drawn independently; no row if one is empty."""
    h = settled(histogram(df.filter(F.col(group).isin(a, b)).withColumn(value, F.col(value).cast("double")), value, [group]))
    side = lambda g: F.max(F.when(F.col(group) == g, F.col("s")))
    apart = replicates(h, [group], statistic, iterations, seed).groupBy("i").agg((side(a) - side(b)).alias("s")).agg(*_interval(level))
    rows = lambda g: F.sum(F.when(F.col(group) == g, F.col("n")))
    sizes = h.agg(rows(a).alias("n1"), rows(b).alias("n2")).filter("n1 is not null and n2 is not null")
    return sizes.crossJoin(apart).select("n1", "n2", "estimate", "ci_lo", "ci_hi")
