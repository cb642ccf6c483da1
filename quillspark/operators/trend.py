"""Trends: monotone trend tests on short series and least squares on rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.special import normal_two_sided, t_quantile, t_two_sided, t_two_sided_p
from quillspark.operators.hist import quantiles
from quillspark.operators.pairs import pair_statistics
from quillspark.operators.prefix import matched, prefix_sums, settled


def yearly_means(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def mann_kendall(series: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, s, var_s (tie-aware), tau, z (continuity 1), slope (Sen, per step) and intercept.

    ``series`` has a row per period; steps count periods that are there, not time between them. No pairs are made:
    s comes from a count of ascents and of ties, the slope from counts of slopes below a bound (``pairs``).
    """
    by = list(by)
    there = settled(series.filter(F.col(value).isNotNull()).select(*by, F.col(order).alias("__order"), F.col(value).cast("double").alias("x"), F.lit(1).alias("one")))
    rows = settled(prefix_sums(there, ["one"], by, ["__order"]).select(*by, (F.col("cum_one") - 1).alias("i"), "x"))
    t = F.col("t").cast("double")
    tied = rows.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("t"))
    ties = tied.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(t * (t - 1) * (2 * t + 5)).alias("tied"), F.sum(t * (t - 1) / 2).cast("bigint").alias("same"))
    middle = quantiles(tied.withColumnsRenamed({"x": "v", "t": "n"}), (0.5,), by, ("mid",))
    whole = matched(matched(ties, middle, by), pair_statistics(rows, by), by, "left")
    n = F.col("n").cast("double")
    s = (2 * F.col("p") + F.col("same") - F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    var_s = (n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18
    z = (F.col("s") - F.signum("s")) / F.nullif(F.sqrt("var_s"), F.lit(0.0))
    done = whole.filter("n > 0").withColumn("s", F.when(F.col("n") > 1, s)).withColumn("var_s", var_s)
    return done.select(*by, "n", "s", "var_s", (F.col("s") / F.nullif(n * (n - 1) / 2, F.lit(0.0))).alias("tau"), z.alias("z"), "slope", (F.col("mid") - (n - 1) / 2 * F.col("slope")).alias("intercept"))


def trend_word(z: float | None, alpha: float = 0.05) -> str:
    if z is None or normal_two_sided(z) >= alpha:
        return "no trend"
    return "increasing" if z > 0 else "decreasing"


def ols_simple(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, slope, intercept, r2, se and p (of the slope), sxx, syy, sse, x_mean."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__x", F.col(x).cast("double")).withColumn("__y", F.col(y).cast("double"))
    pair = (F.col("__y"), F.col("__x"))
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(*pair).alias("slope"), F.regr_intercept(*pair).alias("intercept"), F.regr_r2(*pair).alias("r2"), F.regr_sxx(*pair).alias("sxx"), F.regr_syy(*pair).alias("syy"), F.regr_sxy(*pair).alias("sxy"), F.avg("__x").alias("x_mean")
    )
    sse = F.col("syy") - F.col("slope") * F.col("sxy")
    se = F.when(F.col("n") > 2, F.sqrt(F.greatest(sse, F.lit(0.0)) / (F.col("n") - 2) / F.nullif(F.col("sxx"), F.lit(0.0))))
    found = s.select(*by, "n", "slope", "intercept", "r2", se.alias("se"), "sxx", "syy", F.greatest(sse, F.lit(0.0)).alias("sse"), "x_mean")
    return found.withColumn("p", t_two_sided_p(F.col("slope") / F.nullif("se", F.lit(0.0)), F.col("n") - 2))


def ols_interaction(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """term, coef, se, t, p for y ~ x * group with any number of groups, the first in order as the base; plus n, dof and r2.

    Groups saturate the model: the base's fit and the differences of the others', with a
    pooled residual variance. Everything comes from one aggregation by group. One group alone gives no rows.
    """
    fits = ols_simple(df.filter(F.col(group).isNotNull()), y, x, [group]).withColumn("y_mean", F.col("intercept") + F.col("slope") * F.col("x_mean"))
    at = F.struct("n", "slope", "intercept", "sxx", "x_mean")
    weighted = lambda c: F.sum(F.col("n") * c)
    totals = fits.agg(
        F.min(group).alias("g0"), F.min_by(at, group).alias("base"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("all_n"), F.sum("sse").alias("all_sse"),
        (F.sum("syy") + weighted(F.col("y_mean") ** 2) - weighted(F.col("y_mean")) ** 2 / F.sum("n")).alias("all_syy"),
    )
    s2 = F.col("all_sse") / (F.col("all_n") - 2 * F.col("groups"))
    v_slope = lambda sxx: s2 / sxx
    v_int = lambda n, mean, sxx: s2 * (1 / n + mean**2 / sxx)
    own, b = (v_int(F.col("n"), F.col("x_mean"), F.col("sxx")), v_slope(F.col("sxx"))), F.col("base")
    base = (v_int(b["n"], b["x_mean"], b["sxx"]), v_slope(b["sxx"]))
    term = lambda i, name, coef, var: F.struct(F.lit(i).alias("i"), name.alias("term"), coef.alias("coef"), F.sqrt(var).alias("se"))
    other = F.concat(F.lit(f"C({group})[T."), F.col(group).cast("string"), F.lit("]"))
    first = F.array(term(0, F.lit("Intercept"), F.col("intercept"), own[0]), term(2, F.lit(x), F.col("slope"), own[1]))
    more = F.array(term(1, other, F.col("intercept") - b["intercept"], own[0] + base[0]), term(3, F.concat(F.lit(f"{x}:"), other), F.col("slope") - b["slope"], own[1] + base[1]))
    rows = fits.join(F.broadcast(totals), F.lit(True)).filter("groups > 1")
    out = rows.select(group, F.explode(F.when(F.col(group) == F.col("g0"), first).otherwise(more)).alias("t"), F.col("all_n").alias("n"), (F.col("all_n") - 2 * F.col("groups")).alias("dof"), (1 - F.col("all_sse") / F.col("all_syy")).alias("r2"))
    done = out.orderBy("t.i", group).select("t.term", "t.coef", "t.se", (F.col("t.coef") / F.nullif("t.se", F.lit(0.0))).alias("t"), "n", "dof", "r2")
    return done.withColumn("p", t_two_sided_p(F.col("t"), F.col("dof")))


def with_p_values(rows: Sequence[Any], dof: str | None = None, level: float = 0.95) -> list[dict[str, Any]]:
    """Collected regression rows with p, ci_lo and ci_hi from the t distribution; ``dof`` names the column (default n - 2)."""
    out = []
    for r in rows:
        d = r.asDict()
        coef, k = d.get("coef", d.get("slope")), d[dof] if dof else d["n"] - 2
        half = t_quantile(level, k) * d["se"] if d["se"] is not None and k > 0 else math.nan
        t = coef / d["se"] if d["se"] else math.nan
        out.append(d | {"p": t_two_sided(t, k), "ci_lo": coef - half, "ci_hi": coef + half})
    return out


def interaction_terms(terms: DataFrame, pattern: str) -> DataFrame:
    """Rows whose term matches a regular expression."""
    return terms.filter(F.col("term").rlike(pattern))
