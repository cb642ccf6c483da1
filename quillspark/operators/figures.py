"""Tables behind figures; drawing is left to whoever reads them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.hist import histogram, quantiles
from quillspark.operators.prefix import matched, settled


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, q1, median, q3 and whiskers: the farthest values within 1.5 interquartile ranges of the box."""
    h = settled(histogram(df, value, [group]))
    v = F.col("v").cast("double")
    q = quantiles(h, (0.25, 0.5, 0.75), [group], ("q1", "median", "q3"))
    iqr = 1.5 * (F.col("q3") - F.col("q1"))
    near = h.join(q.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).filter((v >= F.col("q1") - iqr) & (v <= F.col("q3") + iqr))
    return near.groupBy(group, "q1", "median", "q3").agg(F.min(v).alias("whisker_lo"), F.max(v).alias("whisker_hi"))


#: Bins of a bandwidth, and bandwidths beyond which a kernel counts nothing.
BINS, REACH = 1024, 8


def kde_grid(df: DataFrame, value: str, group: str, lo: float, hi: float, points: int = 201) -> DataFrame:
    """group, x, density: Gaussian kernel with Scott's bandwidth on an even grid.

    Each value is shared out linearly between the two ends of its bin, a BINS-th of the bandwidth wide, so the work depends on the bins
    that values spread over and not on how many values there are. That changes a density by less than 2e-7 of a kernel's height
    (BINS^-2 / 8 times the largest curvature); kernels are cut off at REACH bandwidths, where 1e-14 of the height is left.
    """
    h = settled(histogram(df, value, [group]))
    v, n = F.col("v").cast("double"), F.col("n").cast("double")
    s = h.groupBy(group).agg(F.sum(n).alias("all_n"), F.sum(n * v).alias("s1"), F.sum(n * v * v).alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("all_n")) / F.nullif(F.col("all_n") - 1, F.lit(0.0))
    s = s.select(group, "all_n", (F.sqrt(F.greatest(var, F.lit(0.0))) * F.pow("all_n", F.lit(-0.2))).alias("h")).filter("h > 0")
    at = v * BINS / F.col("h")
    share = at - F.floor(at)
    ends = F.array(F.struct(F.floor(at).alias("bin"), (n * (1 - share)).alias("w")), F.struct((F.floor(at) + 1).alias("bin"), (n * share).alias("w")))
    binned = matched(h, s, [group]).select(group, "h", "all_n", F.explode(ends).alias("e")).groupBy(group, "h", "all_n", "e.bin").agg(F.sum("e.w").alias("w"))
    width = (hi - lo) / (points - 1)
    spot = F.col("bin") * F.col("h") / BINS
    first = F.greatest(F.ceil((spot - REACH * F.col("h") - lo) / width), F.lit(0))
    last = F.least(F.floor((spot + REACH * F.col("h") - lo) / width), F.lit(points - 1))
    near = binned.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last))))
    u = (lo + F.col("i") * width - spot) / F.col("h")
    density = F.sum(F.col("w") * F.exp(-0.5 * u * u)) / (F.first("all_n") * F.first("h") * 2.5066282746310002)
    found = near.groupBy(group, "i").agg(density.alias("density"))
    grid = s.select(group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("i"))
    return matched(grid, found, [group, "i"], "left").select(group, (lo + F.col("i") * width).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def trend_band(cells: DataFrame, group: str, year: str) -> DataFrame:
    """Yearly means with their intervals in the order a line is drawn."""
    return cells.select(group, year, "mean", "ci_lo", "ci_hi").orderBy(group, year)


def save_figure(figure, folder: str, stem: str) -> list[str]:
    """A figure of any library with ``savefig`` as PDF and PNG."""
    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, f"{stem}.{kind}") for kind in ("pdf", "png")]
    for p in paths:
        figure.savefig(p, bbox_inches="tight")
    return paths
