"""Value histograms: what rank-based statistics run on instead of rows.

A histogram has a row for each distinct (keys, value) and is built with map-side
combining, so heavy values cost nothing. It is computed once and kept (``settled``); running sums over
it are windows while it is small, and sums over ranges of values (``prefix``) when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.prefix import matched, prefix_sums, settled


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), **counts: Column) -> DataFrame:
    """keys, v, n and a count of the rows for each condition in ``counts``; null and NaN values are left out."""
    v = F.col(value)
    kept = df.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    return kept.groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def running(h: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``h`` with cum_<column>: sums of each column over values up to this one, within ``by``."""
    return prefix_sums(h, columns, by, ["v"])


def midranks(h: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``h`` with ``rank``: the mean rank of the rows that share a value."""
    return running(h, ["n"], by).withColumn("rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, share: rows for each value, most frequent first, ties by value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "value")


def quantiles(h: DataFrame, shares: Sequence[float], by: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """by and a column for each of ``shares``: quantiles with linear interpolation, exact for any number of distinct values.

    Ranks are found in running sums, so no group's values are held together.
    """
    h = settled(h)
    ranked = matched(running(h, ["n"], by), h.groupBy(*by).agg(F.sum("n").alias("__all")), by)
    first, v = F.col("cum_n") - F.col("n"), F.col("v").cast("double")
    parts, wanted = [], F.lit(False)
    for share, name in zip(shares, names or [f"q{i}" for i in range(len(shares))], strict=True):
        at = share * (F.col("__all") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        weight = F.when((lo >= first) & (lo < F.col("cum_n")), 1 - (at - lo)).otherwise(0.0) + F.when((hi >= first) & (hi < F.col("cum_n")) & (hi > lo), at - lo).otherwise(0.0)
        wanted = wanted | ((hi >= first) & (lo < F.col("cum_n")))
        parts.append(F.sum(F.when(weight > 0, weight * v)).alias(name))
    return ranked.filter(wanted).groupBy(*by).agg(*parts)


def _summary(h: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """keys, n, mean, ss (squared deviations), min, max, quartiles q25, q50, q75 and ``more`` sums, all from one histogram.

    Rows of null or NaN values are in ``more`` alone.
    """
    there = h.filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    there.known_rows = h.known_rows
    v, n = F.col("v").cast("double"), F.col("n")
    sums = there.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(v * n) / F.sum("n")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    apart = matched(there.select(*keys, "v", F.col("n").alias("__n")), sums.select(*keys, "mean"), keys)
    squares = apart.groupBy(*keys).agg(F.sum(F.col("__n") * F.pow(v - F.col("mean"), F.lit(2.0))).alias("ss"))
    whole = h.groupBy(*keys).agg(*more, F.count(F.lit(1)).alias("__values"))
    for part in (sums, squares, quantiles(there, (0.25, 0.5, 0.75), keys, ("q25", "q50", "q75"))):
        whole = matched(whole, part, keys, "left")
    return whole


def _with_nulls(df: DataFrame, value: str, keys: Sequence[str], *counts: Column) -> DataFrame:
    return settled(df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), *counts))


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample standard deviation, minimum, quartiles and maximum, by ``keys``; null and NaN values are left out. The table is read once."""
    s = _summary(_with_nulls(df, value, keys), keys)
    std = F.sqrt(F.col("ss") / F.nullif(F.col("n") - 1, F.lit(0)))
    return s.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "mean", std.alias("std"), "min", "q25", "q50", "q75", "max")


def descriptives(df: DataFrame, value: str, label: str, keys: Sequence[str]) -> DataFrame:
    """n (all rows), mean, median, population standard deviation, interquartile range and label shares in percent, by ``keys``. The table is read once."""
    labels = ("positive", "neutral", "negative")
    h = _with_nulls(df, value, keys, *(F.count_if(F.col(label) == x).alias(f"__{x}") for x in labels))
    s = _summary(h, keys, F.sum("n").alias("rows"), *(F.sum(f"__{x}").alias(f"__{x}") for x in labels))
    part = lambda x: (100 * F.col(f"__{x}") / F.col("rows")).alias(f"pct_{x}")
    return s.select(*keys, F.col("rows").alias("n"), "mean", F.col("q50").alias("median"), F.sqrt(F.col("ss") / F.col("n")).alias("std"), (F.col("q75") - F.col("q25")).alias("iqr"), *map(part, labels))
