"""Counts over all pairs of an ordered series without making pairs.

``ascents`` counts the pairs whose later value is the larger one. In a task that is a sort by the bits of the
ranks. A series beyond CHUNK rows is cut twice, into blocks of places and into ranges of values: pairs of one
block are counted with the block, pairs of one range with the range, and pairs apart in both from the table of how
many rows each block has in each range. The slope that lies in the middle of all pairs is found by narrowing a bracket: the pairs
with a slope below t are those that descend once t times the place is taken off each value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.prefix import matched, prefix_sums, settled

#: Rows of a series that one task takes.
CHUNK = 1 << 18
#: Passes over the series beyond CHUNK that narrow a slope; each halves the bracket.
PASSES = 60


def ascents_in(x: np.ndarray) -> int:
    """Pairs i < j with x[i] < x[j], by the bits of the ranks: at each bit, zeros before ones among values alike above it."""
    if len(x) < 2:
        return 0
    rank = np.unique(x, return_inverse=True)[1].reshape(-1).astype(np.int64)
    total, at = 0, np.arange(len(x))
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        high = rank[at] >> (bit + 1)
        one = (rank[at] >> bit) & 1
        zeros = np.cumsum(1 - one)
        begin = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        base = np.repeat(np.concatenate([[0], zeros])[begin], np.diff(np.append(begin, len(x))))
        total += int((zeros - base)[one == 1].sum())
        at = at[np.argsort(rank[at] >> bit, kind="stable")]
    return total


def _slopes_below(i: np.ndarray, x: np.ndarray, t: float) -> int:
    return ascents_in(-(x - t * i))


def _slope_at(i: np.ndarray, x: np.ndarray, rank: int) -> float:
    """The slope with ``rank`` others below or before it, of all pairs."""
    step = np.diff(x) / np.diff(i)
    lo, hi = float(step.min()), float(step.max())  # every slope is a mean of slopes of neighbours
    if lo == hi:
        return lo
    least = 1e-14 * (hi - lo)
    hi = np.nextafter(hi, np.inf)
    while hi - lo > least:
        mid = lo + (hi - lo) / 2
        if not lo < mid < hi:
            break
        if _slopes_below(i, x, mid) <= rank:
            lo = mid
        else:
            hi = mid
    return _slope_between(i, x, lo, hi)


def _slope_between(i: np.ndarray, x: np.ndarray, lo: float, hi: float) -> float:
    """A slope of the bracket: where the order by x - t * i changes between both ends, neighbours have changed places."""
    after = np.lexsort((i, x - hi * i))
    place = np.empty(len(i), np.int64)
    place[np.lexsort((-i, x - lo * i))] = np.arange(len(i))
    turned = np.flatnonzero(place[after[1:]] < place[after[:-1]])
    a, b = after[turned], after[turned + 1]
    found = (x[b] - x[a]) / (i[b] - i[a]) if len(turned) else np.array([])
    found = found[(found >= lo) & (found <= hi)]
    return float(np.median(found)) if len(found) else lo + (hi - lo) / 2


def median_slope(i: np.ndarray, x: np.ndarray) -> float | None:
    """The median of (x[j] - x[i]) / (j - i) over all pairs."""
    n = len(i)
    if n < 2:
        return None
    if n <= 512:
        a, b = np.triu_indices(n, 1)
        return float(np.median((x[b] - x[a]) / (i[b] - i[a])))
    pairs = n * (n - 1) // 2
    low = _slope_at(i, x, (pairs - 1) // 2)
    return low if pairs % 2 else (low + _slope_at(i, x, pairs // 2)) / 2


def _schema(df: DataFrame, by: Sequence[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by), more])


def _keys_of(pdf: pd.DataFrame, by: Sequence[str]) -> dict:
    return {k: [pdf[k].iloc[0]] for k in by}


def ascents(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, p: pairs of ``rows`` (by, i, x; i counts from 0 within by) whose later x is the larger one, for series of any length."""
    rows = settled(rows.select(*by, F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x")))
    placed = rows.withColumn("block", F.floor(F.col("i") / CHUNK))
    values = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    upto = prefix_sums(values, ["n"], by, ["x"])
    # A value with as many rows as a chunk has a range of its own, in which nothing ascends.
    ranged = upto.select(*by, "x", (2 * F.floor((F.col("cum_n") - F.col("n")) / CHUNK) + (F.col("n") >= CHUNK).cast("int")).alias("range"))
    cells = settled(matched(placed, ranged, [*by, "x"]))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame(_keys_of(pdf, by) | {"p": [ascents_in(pdf["x"].to_numpy())]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        inside = sum(ascents_in(part.to_numpy()) for _, part in pdf.groupby("block")["x"])
        return pd.DataFrame(_keys_of(pdf, by) | {"p": [ascents_in(pdf["x"].to_numpy()) - inside]})

    schema = _schema(rows, by, "p bigint")
    counted = cells.groupBy(*by, "block").applyInPandas(within, schema)
    single = cells.groupBy(*by).agg((F.max("block") == 0).alias("__one"))
    long = matched(cells, single, by).filter("not __one")
    counted = counted.unionByName(long.filter("range % 2 = 0").groupBy(*by, "range").applyInPandas(across, schema))
    # How many rows lie in blocks before and in ranges below: sums along one side of the table, then along the other.
    table = long.groupBy(*by, "block", "range").agg(F.count(F.lit(1)).alias("c"))
    blocks = table.groupBy(*by).agg(F.max("block").alias("__last"))
    full = matched(table.select(*by, "range").distinct(), blocks, by).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last")))).drop("__last")
    grid = matched(full, table, [*by, "range", "block"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    before = Window.partitionBy(*by, "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*by, "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("up", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("s", F.coalesce(F.sum("up").over(below), F.lit(0)))
    counted = counted.unionByName(grid.groupBy(*by).agg(F.sum(F.col("c") * F.col("s")).alias("p")))
    return counted.groupBy(*by).agg(F.sum("p").cast("bigint").alias("p"))


def pair_statistics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, p (ascending pairs) and slope (the median one) of ``rows`` (by, i, x; i counts from 0 within by).

    Series up to CHUNK rows are done whole, each in a task; longer ones by ``ascents``, once for p and PASSES times for the slope,
    which is then within 2^-PASSES of the range of slopes between neighbours.
    """
    by = list(by)
    rows = settled(rows.select(*by, F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x")))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    short = matched(rows, sizes.filter(F.col("__n") <= CHUNK), by).drop("__n")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, x = pdf["i"].to_numpy(np.float64), pdf["x"].to_numpy()
        return pd.DataFrame(_keys_of(pdf, by) | {"p": [ascents_in(x)], "slope": [median_slope(i, x)]})

    out = short.groupBy(*by).applyInPandas(whole, _schema(rows, by, "p bigint, slope double"))
    large = settled(sizes.filter(F.col("__n") > CHUNK))
    if not large.known_rows:
        return out
    long = settled(matched(rows, large, by))
    return out.unionByName(matched(ascents(long, by), _median_slopes(long, large, by), by))


def _median_slopes(long: DataFrame, large: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, slope: brackets of all long series halved together; an even number of pairs takes the mean of the middle two."""
    nxt = matched(long.select(*by, (F.col("i") - 1).alias("i"), F.col("x").alias("__y")), long.drop("__n"), [*by, "i"])
    ends = nxt.groupBy(*by).agg(F.min(F.col("__y") - F.col("x")).alias("lo"), F.max(F.col("__y") - F.col("x")).alias("hi"))
    pairs = F.col("__n") * (F.col("__n") - 1)
    bracket = matched(large.withColumn("__pairs", (pairs / 2).cast("bigint")), ends, by)
    ranks = F.array(F.floor((F.col("__pairs") - 1) / 2), F.floor(F.col("__pairs") / 2))
    bracket = settled(bracket.select(*by, F.explode(F.array_distinct(ranks)).alias("rank"), "lo", "hi"))
    keys = [*by, "rank"]
    for _ in range(PASSES):
        middle = bracket.withColumn("mid", F.col("lo") + (F.col("hi") - F.col("lo")) / 2)
        turned = matched(long.select(*by, "i", "x"), middle.select(*keys, "mid"), by).select(*keys, "i", (F.col("mid") * F.col("i") - F.col("x")).alias("x"))
        below = matched(middle, ascents(turned, keys), keys)
        up = F.col("p") <= F.col("rank")
        bracket = settled(below.select(*keys, F.when(up, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(up, F.col("hi")).otherwise(F.col("mid")).alias("hi")))
        if bracket.filter("hi - lo > 1e-14 * greatest(abs(lo), abs(hi))").isEmpty():
            break
    return bracket.groupBy(*by).agg(F.avg((F.col("lo") + F.col("hi")) / 2).alias("slope"))
