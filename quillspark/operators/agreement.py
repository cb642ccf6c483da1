"""Agreement of two labelings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.special import Z975
from quillspark.operators.prefix import matched

LABELS = ("negative", "neutral", "positive")


def confusion(df: DataFrame, true: str, pred: str, labels: Sequence[str] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """by, true, pred, n, row_share: every pair of ``labels``, absent ones as 0; the share is null in an empty row."""
    counted = df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred")) for t in labels for p in labels))).alias("c")
    cells = df.select(*by).distinct().select(*by, pairs) if by else df.sparkSession.range(1).select(pairs)
    cells = cells.select(*(F.col(k).alias(f"__{k}") for k in by), F.col("c.true").alias("__true"), F.col("c.pred").alias("__pred"))
    on = (F.col("__true") == F.col("true")) & (F.col("__pred") == F.col("pred"))
    for k in by:
        on = on & F.col(f"__{k}").eqNullSafe(counted[k])
    grid = cells.join(counted, on, "left").select(*(F.col(f"__{k}").alias(k) for k in by), F.col("__true").alias("true"), F.col("__pred").alias("pred"), F.coalesce("n", F.lit(0)).alias("n"))
    row = F.sum("n").over(Window.partitionBy(*by, "true"))
    return grid.withColumn("row_share", F.col("n") / F.nullif(row, F.lit(0)))


def confusion_with_total(df: DataFrame, true: str, pred: str, by: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """scope, by, true, pred, n, row_share: ``confusion`` of every ``by`` (scope "each") and of all rows (scope "all", by null), from one pass over the rows."""
    counted = df.groupBy(F.col(by), F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    sets = counted.groupingSets([[F.col(by), F.col("true"), F.col("pred")], [F.col("true"), F.col("pred")]], F.col(by), F.col("true"), F.col("pred"))
    both = sets.agg(F.grouping(by).alias("__all"), F.sum("n").alias("n")).select(F.when(F.col("__all") == 1, "all").otherwise("each").alias("scope"), by, "true", "pred", "n")
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("true"), F.lit(p).alias("pred")) for t in labels for p in labels))).alias("c")
    cells = both.select("scope", by).distinct().select("scope", by, pairs).select("scope", by, "c.true", "c.pred")
    grid = matched(cells, both, ["scope", by, "true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.withColumn("row_share", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("scope", by, "true")), F.lit(0)))


def class_metrics(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, label, support, precision, recall, f1 (0 where undefined) from a confusion grid."""
    marks = grid.select(*by, F.explode(F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("d")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").cast("int").alias("p"), F.lit(0).cast("long").alias("d")))).alias("m"))
    s = marks.groupBy(*by, "m.label").agg(F.sum("m.t").alias("support"), F.sum("m.p").alias("predicted"), F.sum("m.d").alias("hits"))
    part = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    s = s.withColumn("precision", part(F.col("hits"), F.col("predicted"))).withColumn("recall", part(F.col("hits"), F.col("support")))
    return s.select(*by, "label", "support", "precision", "recall", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)).alias("f1"))


def agreement_metrics(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, accuracy, macro_f1 over the labels of the grid."""
    n = grid.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"))
    f1 = class_metrics(grid, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1")).withColumnsRenamed({k: f"__{k}" for k in by})
    on = reduce(lambda a, k: a & n[k].eqNullSafe(F.col(f"__{k}")), by, F.lit(True))
    return n.join(F.broadcast(f1) if not by else f1, on).drop(*(f"__{k}" for k in by))


def kappa_quadratic(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, kappa: quadratically weighted, over the sorted labels that occur on either side."""
    seen = grid.filter("n > 0")
    labels = seen.select(*by, F.col("true").alias("label")).union(seen.select(*by, "pred")).distinct()
    place = labels.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("label")))

    def on(prefix: str, column: str) -> Column:
        return reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"{prefix}{k}")), by, F.col(column) == F.col(f"{prefix}label"))

    side = lambda prefix, name: place.select(*(F.col(k).alias(f"{prefix}{k}") for k in by), F.col("label").alias(f"{prefix}label"), F.col("i").alias(name))
    o = seen.join(side("__r", "i"), on("__r", "true")).join(side("__c", "j"), on("__c", "pred")).select(*by, "i", "j", "n")
    # Expected weight: sum over i, j of (i-j)^2 R_i C_j / N = R2 + C2 - 2 R1 C1 / N, from moments.
    d = (F.col("i") - F.col("j")).cast("double")
    n = F.col("n").cast("double")
    s = o.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * d * d).alias("o"), F.sum(n * F.col("i")).alias("r1"), F.sum(n * F.col("i") * F.col("i")).alias("r2"), F.sum(n * F.col("j")).alias("c1"), F.sum(n * F.col("j") * F.col("j")).alias("c2"))
    expected = F.col("r2") + F.col("c2") - 2 * F.col("r1") * F.col("c1") / F.col("n")
    return s.select(*by, (1 - F.col("o") / F.nullif(expected, F.lit(0.0))).alias("kappa"))


def majority_baseline(df: DataFrame, true: str, by: Sequence[str] = ()) -> DataFrame:
    """by, label, share of the most frequent true label, ties to the first in order."""
    counted = df.filter(F.col(true).isNotNull()).groupBy(*by, F.col(true).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("b"), F.sum("n").alias("all_n"))
    return best.select(*by, F.col("b.label").alias("label"), (-F.col("b.k") / F.col("all_n")).alias("share"))


def majority_of(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``majority_baseline`` from a confusion grid."""
    counted = grid.groupBy(*by, F.col("true").alias("label")).agg(F.sum("n").alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("b"), F.sum("n").alias("all_n"))
    return best.select(*by, F.col("b.label").alias("label"), (-F.col("b.k") / F.nullif("all_n", F.lit(0))).alias("share"))


def chi2_2x2(df: DataFrame, group: str, a: str, b: str, hit: Column) -> DataFrame:
    """a_hit, a_miss, b_hit, b_miss, chi2: 2x2 test of a condition in two groups, Yates-corrected."""
    rows = df.filter(F.col(group).isin(a, b) & hit.isNotNull())
    count = lambda g, c: F.count_if((F.col(group) == g) & c)
    s = rows.agg(count(a, hit).alias("a_hit"), count(a, ~hit).alias("a_miss"), count(b, hit).alias("b_hit"), count(b, ~hit).alias("b_miss"))
    w, x, y, z = (F.col(c).cast("double") for c in s.columns)
    n = w + x + y + z
    gap = F.greatest(F.lit(0.0), F.abs(w * z - x * y) - n / 2)
    return s.withColumn("chi2", n * gap * gap / F.nullif((w + x) * (y + z) * (w + y) * (x + z), F.lit(0.0)))


#: Buckets by tokens: upper ends, inclusive, and names.
LENGTHS = ((5, "≤5"), (20, "6–20"), (50, "21–50"), (None, ">50"))


def length_bucket(tokens: Column) -> Column:
    """Null without tokens."""
    out = F.when(tokens <= 0, None)
    for top, name in LENGTHS:
        out = out.when(tokens <= top, name) if top is not None else out.when(tokens.isNotNull(), name)
    return out


def agreement_by_length(df: DataFrame, true: str, pred: str, tokens: str) -> DataFrame:
    """bucket, n, accuracy with its Wilson interval ci_lo, ci_hi (95 %); empty buckets are left out."""
    rows = df.withColumn("bucket", length_bucket(F.col(tokens))).filter(F.col("bucket").isNotNull())
    found = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))
    lo, hi = wilson(F.col("accuracy"), F.col("n"))
    return found.withColumns({"ci_lo": lo, "ci_hi": hi})


def wilson(share: Column, n: Column, z: float = Z975) -> tuple[Column, Column]:
    """Score interval of a proportion."""
    middle = share + z * z / (2 * n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def mismatch_type(rating: Column, score: Column, high_stars: float = 4, low_stars: float = 2, high: float = 0.5, low: float = -0.5) -> Column:
    """high_star_negative or low_star_positive, both ends inclusive; else null."""
    return F.when((rating >= high_stars) & (score <= low), "high_star_negative").when((rating <= low_stars) & (score >= high), "low_star_positive")


def mismatch_counts(df: DataFrame, kind: Column, by: Sequence[str]) -> DataFrame:
    count = lambda k: F.count_if(kind == k).alias(k)
    return df.groupBy(*by).agg(count("high_star_negative"), count("low_star_positive"))


def label_distribution(df: DataFrame, keys: Sequence[str], sources: Sequence[str], labels: Sequence[str] = ("positive", "neutral", "negative")) -> DataFrame:
    """keys, label_source, a count for each label, total; one pass over the rows."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.col(s).alias("label")) for s in sources))).alias("s"))
    count = lambda x: F.count_if(F.col("s.label") == x).alias(x)
    return long.groupBy(*keys, F.col("s.source").alias("label_source")).agg(*(count(x) for x in labels), F.count("s.label").alias("total"))
