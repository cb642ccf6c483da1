"""Quality rules (native): base rules, then robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics. For every (lang, source) the
minimum-covariance-determinant estimate is sought by concentration steps: from a
start, take the half of the rows with the smallest Mahalanobis distances, estimate mean and
covariance from it, and repeat until nothing changes. Two deterministic starts are
tried (median with MAD, mean with covariance) and the smaller determinant wins. The covariance of
the half is brought to that of all normal rows by its consistency factor; then mean and covariance are
taken once more from all rows within the REWEIGHT quantile, with their factor. Estimates are shrunk
towards those of the language, and these towards all, by n / (n + SHRINK): a group of any size
has one, and none changes by a step. A document is
rejected when its squared distance exceeds a chi-square quantile.

All sums are over fixed-point integers, so estimates do not depend on the order of rows, and
the half is cut at a bin of a distance histogram (all rows of the bin are in), so no group is
ever sorted or gathered: each step is two aggregations with map-side combining and a
join with one row per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, fresh, scratch, small, temporary_tables, words

#: Statistics of the vector, with the least standard deviation assumed of each: clean text varies by that much.
FEATURES = {"log_word_length": 0.05, "root_symbols": 0.05, "repeats": 0.05, "dup_lines": 0.1}
#: Fixed point of the vectors.
SCALE = 1024
#: Rows of a group that a subset must hold.
SUBSET = 0.5
#: A group's concentration steps end when its determinant shrinks no more, after these at the latest.
MOST_STEPS = 20
#: Quantile within which rows count for the final estimate.
REWEIGHT = 0.975
#: Rows that the estimate of the language, and that of all, counts for in the mean of both.
SHRINK = 50
#: Probability that a clean document passes, were the vectors normal.
PASS_PROBABILITY = 1 - 1e-6
#: Bins of a distance histogram in a doubling of the squared distance.
BINS = 32


def chi_square_4(p: float) -> float:
    """Quantile of the chi-square distribution with four degrees of freedom."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.exp(-mid / 2) * (1 + mid / 2) > 1 - p else (lo, mid)
    return hi


def _within_4(x: Column) -> Column:
    """Probability that a chi-square variable with four degrees of freedom is at most ``x``."""
    return 1 - F.exp(-x / 2) * (1 + x / 2)


def consistency(share: Column) -> Column:
    """Factor from the covariance of the ``share`` of normal rows with the smallest distances to that of all."""
    share = F.least(share, F.lit(0.999999))
    newton = lambda q, _: F.greatest(q - (_within_4(q) - share) / (q * F.exp(-q / 2) / 4), q / 4)
    q = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(3.0), newton)
    return F.aggregate(F.array(q), F.lit(0.0), lambda _, x: share / (1 - F.exp(-x / 2) * (1 + x / 2 + x * x / 8)))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) to doc_id, lang, source and the base statistics.

    row_hash (of text, lang and source), n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words; a null
    text has none of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    cut = docs.select("doc_id", "lang", "source", F.xxhash64("text", "lang", "source").alias("row_hash"), text.alias("text"), words(F.col("text")).alias("w"), lines.alias("lines"))
    span = F.greatest(F.size("w") - 2, F.lit(0))
    # (hash of a window, where it starts), sorted: equal windows are neighbours.
    # A window is named by two hashes, 96 bits, so that texts of any length keep apart.
    window = lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), F.hash(F.get("w", i + 2), F.get("w", i), F.get("w", i + 1)).alias("g"), i.alias("i")
    )
    hashes = F.transform(F.when(span > 0, F.sequence(F.lit(0), span - 1)).otherwise(F.array().cast("array<int>")), window)
    cut = cut.withColumn("win", F.sort_array(hashes))
    same = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
    twin = lambda x, k: F.coalesce(same(x, F.get("win", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("win", k + 1)), F.lit(False))
    cut = cut.withColumn("at", F.sort_array(F.transform(F.filter("win", twin), lambda x: x["i"])))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n")),
        lambda s: s["n"],
    )
    return cut.select(
        "doc_id",
        "lang",
        "source",
        "row_hash",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed and the fixed-point vector x0, x1, ..."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = {
        "log_word_length": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1))),
        "root_symbols": F.sqrt(F.col("n_symbols") / n),
        "repeats": F.col("n_repeat_words") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fixed = {f"x{i}": F.round(values[k] * SCALE).cast("long") for i, k in enumerate(FEATURES)}
    return stats.withColumn("base_failed", failed).withColumns(fixed)


P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_GROUP = ("lang", "grp")


def _same_group(a: DataFrame, b: DataFrame, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """Join on the group, null being a group; ``b`` is small unless groups are many, and then shuffled."""
    b = b.withColumnsRenamed({c: f"__{c}" for c in (*_GROUP, *also)})
    on = F.lit(True)
    for c in _GROUP:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    for c in also:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return a.join(b, on, how).drop(*(f"__{c}" for c in (*_GROUP, *also)))


def _sums(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, mean and covariance of each group from exact integer sums, with the least variances added."""
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(F.col(f"x{i}").cast("decimal(18,0)")).alias(f"s{i}") for i in range(P)]
    sums += [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(18,0)")).alias(f"s{i}{j}") for i, j in _PAIRS]
    summed = rows.groupBy(*keys).agg(*sums)
    n = F.col("n").cast("double")
    mean = {f"m{i}": F.col(f"s{i}").cast("double") / n / SCALE for i in range(P)}
    least = list(FEATURES.values())
    cov = {f"c{i}{j}": F.col(f"s{i}{j}").cast("double") / n / SCALE**2 - (F.col(f"s{i}").cast("double") / n / SCALE) * (F.col(f"s{j}").cast("double") / n / SCALE) + (least[i] ** 2 if i == j else 0.0) for i, j in _PAIRS}
    return summed.select(*keys, "n", *(v.alias(k) for k, v in (mean | cov).items()))


def _moments(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return _factor(_sums(rows, keys), keys)


def _factor(estimates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Estimates with the Cholesky factor l00, l10, ... of their covariance and its log determinant."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return estimates.select(*keys, "n", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in _PAIRS), logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x to the estimate in the same row, by forward substitution."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}").cast("double") / SCALE - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _histogram_quantile(counts: DataFrame, keys: tuple[str, ...], value: str, share: float) -> DataFrame:
    """keys and ``value``: the least value up to which ``share`` of the counted rows lie."""
    line = Window.partitionBy(*keys)
    run = counts.withColumn("__upto", F.sum("rows").over(line.orderBy(value))).withColumn("__all", F.sum("rows").over(line))
    return run.filter(F.col("__upto") >= F.col("__all") * share).groupBy(*keys).agg(F.min(value).alias(value))


def _median_start(rows: DataFrame) -> DataFrame:
    """Start from medians and median absolute deviations, coordinate by coordinate."""
    long = rows.select(*_GROUP, F.posexplode(F.array(*(F.col(f"x{i}") for i in range(P)))).alias("i", "x"))
    counted = scratch(long.groupBy(*_GROUP, "i", "x").agg(F.count(F.lit(1)).alias("rows")), "mcd-values")
    medians = _histogram_quantile(counted, (*_GROUP, "i"), "x", 0.5).withColumnRenamed("x", "med")
    spread = _same_group(counted, scratch(medians, "mcd-medians"), also=("i",)).withColumn("x", F.abs(F.col("x") - F.col("med")))
    spread = spread.groupBy(*_GROUP, "i", "med", "x").agg(F.sum("rows").alias("rows"))
    mads = _histogram_quantile(spread, (*_GROUP, "i", "med"), "x", 0.5)
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))).cast("double") / SCALE
    least = list(FEATURES.values())
    mean = [at("med", i).alias(f"m{i}") for i in range(P)]
    cov = [(F.pow(at("x", i) * 1.4826, F.lit(2.0)) + least[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return _factor(mads.groupBy(*_GROUP).agg(F.lit(0).cast("long").alias("n"), *mean, *cov), _GROUP).withColumn("start", F.lit(0))


def _weighted(estimates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, mean p*, covariance q* of the groups of ``estimates`` (n, m*, c*) taken together."""
    n = F.sum("n").cast("double")
    mean = {i: F.sum(F.col("n") * F.col(f"m{i}")) / n for i in range(P)}
    cov = {(i, j): F.sum(F.col("n") * (F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}"))) / n - mean[i] * mean[j] for i, j in _PAIRS}
    return estimates.groupBy(*keys).agg(n.alias("pool"), *(v.alias(f"p{i}") for i, v in mean.items()), *(v.alias(f"q{i}{j}") for (i, j), v in cov.items()))


def _shrunk(estimates: DataFrame) -> DataFrame:
    """``estimates`` (n, m*, c*) drawn towards p*, q* of the same row."""
    w = F.col("n") / (F.col("n") + SHRINK)
    mixed = {f"m{i}": w * F.col(f"m{i}") + (1 - w) * F.col(f"p{i}") for i in range(P)}
    mixed |= {f"c{i}{j}": w * F.col(f"c{i}{j}") + (1 - w) * F.col(f"q{i}{j}") for i, j in _PAIRS}
    rest = [c for c in estimates.columns if c not in mixed and c[0] not in "pq"]
    return estimates.select(*rest, *(v.alias(k) for k, v in mixed.items()))


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """lang, grp, n, mean m*, covariance c*: the reweighted MCD estimate of every group of ``rows``."""
    rows = rows.select(*_GROUP, *(f"x{i}" for i in range(P)))
    mean_start = _moments(rows, _GROUP).withColumn("start", F.lit(1))
    now = scratch(_median_start(rows).unionByName(mean_start), "mcd-starts")
    keys, settled = (*_GROUP, "start"), []
    bin_of = F.floor(F.log2(F.greatest(_distance(), F.lit(2.0**-20))) * BINS).cast("int")
    for step in range(MOST_STEPS):
        placed = _same_group(rows, now).select(*keys, *(f"x{i}" for i in range(P)), bin_of.alias("bin"))
        counted = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("rows"))
        cuts = scratch(_histogram_quantile(counted, keys, "bin", SUBSET).withColumnRenamed("bin", "cut"), f"mcd-cuts-{step}")
        subset = _same_group(placed, cuts, also=("start",)).filter(F.col("bin") <= F.col("cut"))
        was = now.select(*keys, F.col("logdet").alias("was"))
        found = scratch(_same_group(_moments(subset, keys), was, also=("start",)).withColumn("better", F.lit(step == 0) | (F.col("logdet") < F.col("was") - 1e-6)).drop("was"), f"mcd-step-{step}")
        settled.append(_same_group(now, found.filter("not better").select(*keys), "left_semi", also=("start",)))
        now = found.filter("better").drop("better")
        if now.isEmpty():
            break
    for done in settled:
        now = now.unionByName(done)
    best = Window.partitionBy(*_GROUP).orderBy("logdet", "start")
    raw = now.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r", "start", "logdet").withColumnRenamed("n", "half")
    sized = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("all_rows"))
    raw = scratch(_same_group(raw, sized).withColumn("factor", consistency(F.col("half") / F.col("all_rows"))).drop("half", "all_rows"), "mcd-raw")
    near = _same_group(rows, raw).filter(_distance() / F.col("factor") <= chi_square_4(REWEIGHT)).select(*_GROUP, *(f"x{i}" for i in range(P)))
    whole = _sums(near, _GROUP)
    factor = consistency(F.lit(REWEIGHT))
    return scratch(whole.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor for i, j in _PAIRS}), "mcd-reweighted")


def final_estimates(rows: DataFrame) -> DataFrame:
    """lang, grp, m*, l*: ``mcd_estimates`` shrunk towards the language and all, as mean and factor."""
    own = mcd_estimates(rows)
    every = _weighted(own, ())
    languages = _weighted(own, ("lang",)).select("lang", F.col("pool").alias("n"), *(F.col(f"p{i}").alias(f"m{i}") for i in range(P)), *(F.col(f"q{i}{j}").alias(f"c{i}{j}") for i, j in _PAIRS))
    languages = _shrunk(languages.crossJoin(every.drop("pool"))).select(F.col("lang").alias("__lang"), *(F.col(f"m{i}").alias(f"p{i}") for i in range(P)), *(F.col(f"c{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS))
    mixed = _shrunk(own.join(languages, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang"))
    return _factor(mixed, _GROUP).drop("n", "logdet")


def judge(docs: DataFrame) -> DataFrame:
    """Base statistics and verdict for each row of ``docs`` (doc_id, text, lang, source; other columns are not read).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance (squared; null if all rows of its group fail the base rules) and kept: false if base_failed or the
    distance exceeds the chi-square quantile of PASS_PROBABILITY. Estimates are made from
    rows that pass the base rules. A null language or source is a group of its own; a
    null or empty text fails; an empty table gives an empty result; repeated rows count each.
    """
    return judged(docs).drop("row_hash")


def judged(docs: DataFrame) -> DataFrame:
    """``judge`` with row_hash."""
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        rows = scratch(vectors(statistics(docs)).withColumn("grp", F.col("source")), "quality-vectors")
        estimates = scratch(final_estimates(rows.filter(~F.col("base_failed"))), "mcd-estimates")
        keep += [rows, estimates]
    scored = _same_group(rows, estimates, "left").withColumn("distance", _distance())
    far = F.coalesce(F.col("distance") > chi_square_4(PASS_PROBABILITY), F.lit(False))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & ~far).alias("kept"), "row_hash")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; all columns stay.

    A row goes by its own doc_id (null too), text, lang and source: rows equal in these get the
    same verdict, others that share a doc_id their own. A null or empty text goes; an empty table stays empty.
    """
    its, sign = fresh("id"), fresh("hash")
    rejected = judged(docs).filter("not kept").select(F.col("doc_id").alias(its), F.col("row_hash").alias(sign)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(its)) & (F.xxhash64("text", "lang", "source") == F.col(sign))
    return docs.join(small(scratch(rejected, "rejected"), 48), same, "left_anti")
