"""Statistics against brute force on small frames with heavy ties, and their properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import agreement, figures, hist, prefix, rank, resample, trend

R = random.Random(5)
ROWS = [(R.choice("ab"), R.choice([1, 2]), R.randint(0, 6) / 2) for _ in range(160)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "g string, y int, v double").cache()


def split(rows=ROWS, year=None):
    return [[v for g, y, v in rows if g == k and (year is None or y == year)] for k in "ab"]


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


@pytest.fixture(params=["windows", "ranges"])
def sums(request, monkeypatch):
    """Running sums by windows, and by ranges as for many rows."""
    if request.param == "ranges":
        monkeypatch.setattr(prefix, "WINDOW_ROWS", 0)


def test_mann_whitney_by_cell(frame, sums):
    for r in rank.mann_whitney(frame, "v", "g", "a", "b", by=["y"]).collect():
        a, b = split(year=r.y)
        assert (r.n1, r.n2, r.u) == (len(a), len(b), pytest.approx(brute_u(a, b)))
        assert r.delta == pytest.approx(2 * r.u / (len(a) * len(b)) - 1)


def test_u_is_antisymmetric(frame):
    ab = rank.mann_whitney(frame, "v", "g", "a", "b").first()
    ba = rank.mann_whitney(frame, "v", "g", "b", "a").first()
    assert ab.u + ba.u == ab.n1 * ab.n2
    assert ab.delta == pytest.approx(-ba.delta)
    assert ab.z == pytest.approx(ba.z)


def test_ks_distance(frame, sums):
    a, b = map(np.array, split())
    d = max(abs((a <= x).mean() - (b <= x).mean()) for x in set(a) | set(b))
    assert rank.ks_2samp(frame, "v", "g", "a", "b").first().d == pytest.approx(d)


def test_dominance_without_pairs(frame, sums):
    a, b = split()
    r = rank.pairwise_dominance(frame, "v", "g", "a", "b").first()
    assert (r.n_pairs, r.wins, r.losses) == (len(a) * len(b), sum(x > y for x in a for y in b), sum(x < y for x in a for y in b))


def test_spearman_is_pearson_of_midranks(frame, sums):
    import pandas as pd

    pdf = pd.DataFrame(ROWS, columns=["g", "y", "v"])
    assert rank.spearman(frame, "y", "v").first().rho == pytest.approx(pdf["y"].rank().corr(pdf["v"].rank()))


def test_missing_group_and_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan"))], "g string, v double")
    r = rank.mann_whitney(df, "v", "g", "a", "b").first()
    assert (r.n1, r.n2, r.z, r.delta) == (1, 0, None, None)
    assert rank.ks_2samp(df, "v", "g", "a", "b").first().d is None
    empty = df.limit(0)
    assert resample.bootstrap_ci(empty, "v", ["g"]).count() == 0
    assert resample.bootstrap_diff_ci(df, "v", "g", "a", "b").count() == 0
    assert hist.value_counts(empty, "g").count() == 0


def test_bootstrap_mean_agrees_with_theory(spark):
    values = [R.gauss(0, 1) for _ in range(400)]
    df = spark.createDataFrame([("x", v) for v in values], "g string, v double")
    r = resample.bootstrap_ci(df, "v", ["g"], "mean", iterations=4000).first()
    half = 1.96 * np.std(values) / 20
    assert r.estimate == pytest.approx(np.mean(values))
    assert (r.ci_lo, r.ci_hi) == (pytest.approx(r.estimate - half, abs=0.15 * half), pytest.approx(r.estimate + half, abs=0.15 * half))


def test_bootstrap_is_repeatable_and_median_averages(spark, frame):
    once, again = (resample.bootstrap_ci(frame, "v", ["g"], "median", iterations=500).orderBy("g").collect() for _ in range(2))
    assert once == again
    for counts, want in (([1, 0, 1], 3.0), ([1, 1, 1], 2.0), ([0, 4, 0], 2.0)):
        assert resample._median_part(np.array([1.0, 2.0, 5.0]), np.array([counts]), np.zeros(1, int), sum(counts)).tolist() == [[want]]


@pytest.mark.parametrize("statistic", ["mean", "median", "variance"])
def test_bootstrap_over_ranges_is_the_same_distribution(spark, monkeypatch, statistic):
    df = spark.createDataFrame([("a", float(i * i % 997)) for i in range(400)] + [(None, 1.0), (None, 2.0)], "g string, v double")
    whole = {r.g: r for r in resample.bootstrap_ci(df, "v", ["g"], statistic, iterations=4000).collect()}
    monkeypatch.setattr(resample, "LEAF", 16)
    parts = {r.g: r for r in resample.bootstrap_ci(df, "v", ["g"], statistic, iterations=4000).collect()}
    assert whole.keys() == parts.keys() == {"a", None}
    assert parts["a"].estimate == pytest.approx(whole["a"].estimate) and parts["a"].n == 400
    wide = whole["a"].ci_hi - whole["a"].ci_lo
    assert abs(parts["a"].ci_lo - whole["a"].ci_lo) < 0.15 * wide and abs(parts["a"].ci_hi - whole["a"].ci_hi) < 0.15 * wide


def test_quantiles_equal_percentile(spark):
    df = spark.createDataFrame([(g, v) for g in ("a", "b", None) for v in [1.0, 1.0, 4.0, 9.5, -3.0, 2.0, 2.0][: 7 if g else 1]], "g string, v double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in hist.quantiles(hist.histogram(df, "v", ["g"]), (0.25, 0.5, 0.9), ["g"]).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q")).collect()
    assert got == {r.g: tuple(r.q) for r in want}


def test_bootstrap_of_a_statistic_of_sums(frame):
    log_mean = resample.Sums((lambda v: np.log1p(v),), lambda s, n: F.exp(s[0] / n) - 1)
    for r in resample.bootstrap_ci(frame, "v", ["g"], log_mean, iterations=300).collect():
        mine = [v for g, _, v in ROWS if g == r.g]
        assert r.estimate == pytest.approx(np.expm1(np.log1p(mine).mean())) and r.ci_lo < r.estimate < r.ci_hi


def test_leaves_deal_out_all_rows():
    totals = [5, 0, 7, 3, 20, 1]  # leaves of a tree of depth 3; two of its eight are empty
    node = lambda level, k: sum(totals[k << (3 - level) : (k + 1) << (3 - level)])
    rng = lambda *x: np.random.default_rng([9, *x])
    got = [resample.down_the_tree(36, 500, leaf, [(node(lv, leaf >> (3 - lv)), node(lv + 1, leaf >> (3 - lv) << 1)) for lv in range(3)], rng) for leaf in range(6)]
    dealt = np.array([m for m, _ in got])
    assert (dealt.sum(0) == 36).all() and (np.array([b for _, b in got]) == np.cumsum(dealt, 0) - dealt).all()
    assert np.abs(dealt.mean(1) - totals).max() < 0.6


@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_bootstrap_of_a_million_distinct_values(spark, statistic):
    df = spark.range(1_000_000).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"))
    r = resample.bootstrap_ci(df, "v", ["g"], statistic, iterations=20).first()
    half = 1_000_000 / 12**0.5 / 1000
    assert r.n == 1_000_000 and r.estimate == 499_999.5 and abs(r.ci_lo - r.estimate) < 8 * half and r.ci_lo < r.ci_hi



def test_ols_and_interaction(spark):
    rows = [(g, x, 2 * x + (3 if g == "q" else 0) * x + R.gauss(0, 1)) for g in "pq" for x in range(20)]
    df = spark.createDataFrame(rows, "g string, x int, y double")
    design = np.array([[1, g == "q", x, x * (g == "q")] for g, x, _ in rows], float)
    y = np.array([r[2] for r in rows])
    beta, sse = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / (len(rows) - 4))
    got = trend.ols_interaction(df, "y", "x", "g").collect()
    assert [r.term for r in got] == ["Intercept", "C(g)[T.q]", "x", "x:C(g)[T.q]"]
    assert [r.coef for r in got] == pytest.approx(list(beta))
    assert [r.se for r in got] == pytest.approx(list(se))
    assert got[0].r2 == pytest.approx(1 - sse[0] / ((y - y.mean()) ** 2).sum())
    p = trend.with_p_values(got, "dof")
    assert p[3]["p"] < 1e-10 and p[3]["ci_lo"] < 3 < p[3]["ci_hi"]


def test_confusion_has_every_cell_and_undefined_shares(spark):
    df = spark.createDataFrame([("positive", "negative")], "t string, p string")
    grid = agreement.confusion(df, "t", "p")
    assert grid.count() == 9
    assert grid.filter((F.col("true") == "neutral") & F.col("row_share").isNotNull()).count() == 0
    assert agreement.class_metrics(grid).filter("f1 <> 0").count() == 0


def test_kappa_ignores_labels_that_do_not_occur(spark):
    df = spark.createDataFrame([("negative", "negative"), ("positive", "negative"), ("positive", "positive")], "t string, p string")
    assert agreement.kappa_quadratic(agreement.confusion(df, "t", "p")).first().kappa == pytest.approx(1 - 1 / (5 / 3))


def test_length_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 5, 6, 20, 21, 50, 51, None)], "n int")
    assert [r.b for r in df.select(agreement.length_bucket(F.col("n")).alias("b")).collect()] == [None, "≤5", "6–20", "6–20", "21–50", "21–50", ">50", None]


def test_binned_densities_equal_kernel_sums(spark):
    r = np.random.default_rng(4)
    for values in (r.standard_normal(3000), np.repeat([1.0, 2.5, 7.0], [5, 1, 9]), r.standard_normal(500) * 1e6 + 1e9):
        df = spark.createDataFrame([("a", float(v)) for v in values] + [("flat", 1.0)] * 3, "g string, v double")
        lo, hi = float(values.min()), float(values.max())
        h = values.std(ddof=1) * len(values) ** -0.2
        got = {x.x: x.density for x in figures.kde_grid(df, "v", "g", lo, hi, 31).collect()}
        for x, d in got.items():
            want = np.exp(-0.5 * ((x - values) / h) ** 2).mean() / (h * (2 * np.pi) ** 0.5)
            assert d == pytest.approx(want, abs=2e-7 / h)
        assert len(got) == 31


def test_kde_integrates_to_one(frame):
    rows = figures.kde_grid(frame, "v", "g", -5.0, 9.0, 141).collect()
    for g in "ab":
        assert sum(r.density for r in rows if r.g == g) * 0.1 == pytest.approx(1, abs=0.01)


def test_box_of_known_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "g string, v double")
    r = figures.box_stats(df, "v", "g").first()
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi) == (2, 3, 4, 1, 4)
