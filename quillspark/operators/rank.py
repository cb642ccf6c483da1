"""Two-sample and rank statistics on value histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.special import ks_two_sided_p, t_two_sided_p
from quillspark.operators.hist import histogram, midranks, running
from quillspark.operators.prefix import matched, settled


def cliffs_from_u(u: Column, n1: Column, n2: Column) -> Column:
    """Cliff's delta, which is also the rank-biserial correlation."""
    return 2 * u / (n1.cast("double") * n2) - 1


rank_biserial = cliffs_from_u


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """U of group ``a`` against ``b`` in every cell of ``by``.

    by, n1, n2, u, tie_term (sum of t^3 - t), z (tie-corrected, continuity 1/2) and delta. A cell
    without rows of one group gives null z and delta.
    """
    both = df.filter(F.col(group).isin(a, b))
    h = midranks(histogram(both, value, by, a=F.col(group) == a), by)
    n = F.col("n").cast("double")
    sums = h.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum(F.col("n") - F.col("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(n * n * n - n).alias("tie_term")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    all_n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (all_n + 1 - F.col("tie_term") / F.nullif(all_n * (all_n - 1), F.lit(0.0))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return sums.select(*by, "n1", "n2", u.alias("u"), "tie_term", z.alias("z"), F.when(n1 * n2 > 0, 2 * u / (n1 * n2) - 1).alias("delta"))


def ks_2samp(df: DataFrame, value: str, group: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n1, n2, d, the largest distance of the two distribution functions, and its p."""
    both = df.filter(F.col(group).isin(a, b))
    h = settled(histogram(both, value, by, a=F.col(group) == a, b=F.col(group) == b))
    sizes = h.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    gap = F.abs(F.col("cum_a") / F.nullif(F.col("n1"), F.lit(0)) - F.col("cum_b") / F.nullif(F.col("n2"), F.lit(0)))
    found = matched(running(h, ["a", "b"], by), sizes, by).groupBy(*by).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("d"))
    return found.withColumn("p", ks_two_sided_p(F.col("d"), F.col("n1"), F.col("n2")))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, rho and p: the Pearson correlation of mid-ranks, from the joint histogram of the two columns, and its t probability."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    joint = settled(rows.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    ranked = joint
    for c in ("x", "y"):
        ranks = midranks(joint.groupBy(*by, F.col(c).alias("v")).agg(F.sum("n").alias("n")), by)
        ranked = matched(ranked, ranks.select(*by, F.col("v").alias(c), F.col("rank").alias(f"r{c}")), [*by, c])
    joint = ranked
    n, rx, ry = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    s = joint.groupBy(*by).agg(F.sum(n).alias("s"), F.sum(n * rx).alias("sx"), F.sum(n * ry).alias("sy"), F.sum(n * rx * rx).alias("sxx"), F.sum(n * ry * ry).alias("syy"), F.sum(n * rx * ry).alias("sxy"))
    cov = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("s")
    rho = cov("sx", "sy", "sxy") / F.nullif(F.sqrt(cov("sx", "sx", "sxx") * cov("sy", "sy", "syy")), F.lit(0.0))
    found = s.select(*by, F.col("s").cast("long").alias("n"), rho.alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") ** 2, F.lit(1e-300)))
    return found.withColumn("p", F.when(F.col("n") > 2, t_two_sided_p(t, F.col("n") - 2)))


def spearman_ci(rho: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Fisher interval; null where n is 3 or less."""
    half = F.when(n > 3, z / F.sqrt(n - 3))
    return F.tanh(F.atanh(rho) - half), F.tanh(F.atanh(rho) + half)


def holm(df: DataFrame, p: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """``df`` with p_adj (Holm-Bonferroni over the rows of each ``by``) and significant (strictly below ``alpha``).

    For small tables of test results; ties in p are adjusted alike.
    """
    ordered = Window.partitionBy(*by).orderBy(p)
    left = F.count(p).over(Window.partitionBy(*by)) - F.row_number().over(ordered) + 1
    adjusted = df.withColumn("__m", F.least(F.lit(1.0), F.col(p) * left)).withColumn("p_adj", F.max("__m").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__m")
    return adjusted.withColumn("significant", F.col("p_adj") < alpha)


def ecdf_points(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, v, f: the steps of each group's distribution function."""
    h = settled(histogram(df, value, [group]))
    run = matched(running(h, ["n"], [group]), h.groupBy(group).agg(F.sum("n").alias("__all")), [group])
    return run.select(group, "v", (F.col("cum_n") / F.col("__all")).alias("f"))


def pairwise_dominance(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """n_pairs, wins, losses and delta of all pairs of ``a`` and ``b`` rows, without making pairs.

    Each value's wins are the ``b`` rows below it, which a running sum gives.
    """
    h = running(histogram(df.filter(F.col(group).isin(a, b)), value, [], a=F.col(group) == a, b=F.col(group) == b), ["b"])
    sums = h.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("cum_b") - F.col("b"))).alias("wins"), F.sum(F.col("a") * F.col("b")).alias("ties"))
    pairs = F.col("n1") * F.col("n2")
    losses = pairs - F.col("wins") - F.col("ties")
    return sums.select(pairs.alias("n_pairs"), "wins", losses.alias("losses"), ((F.col("wins") - losses) / F.nullif(pairs, F.lit(0))).alias("delta"))
