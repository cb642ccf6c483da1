"""Operators against published results that can be recomputed from published inputs."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.special import normal_two_sided
from quillspark.operators import agreement, rank, trend, words


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_cliffs_delta_from_u(spark):
    r = one(spark.range(1).select(rank.cliffs_from_u(F.lit(4535211928.5), F.lit(94261), F.lit(95326)).alias("d")))
    assert r.d == pytest.approx(0.00944850519429119, rel=1e-12)


def test_spearman_interval(spark):
    lo, hi = rank.spearman_ci(F.lit(0.5104343894620104), F.lit(189587))
    r = one(spark.range(1).select(lo.alias("lo"), hi.alias("hi")))
    assert (r.lo, r.hi) == (pytest.approx(0.50709815863726, rel=1e-10), pytest.approx(0.513755324436746, rel=1e-10))


def test_chi_square_with_yates_correction(spark):
    rows = [("A", True, 76020), ("A", False, 18241), ("B", True, 77332), ("B", False, 17994)]
    df = spark.createDataFrame(rows, "g string, hit boolean, n int").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert one(agreement.chi2_2x2(df, "g", "A", "B", F.col("hit"))).chi2 == pytest.approx(6.8953915816, rel=1e-9)


CELLS_A = [[8639, 125, 7277], [3781, 773, 2436], [0, 4622, 66608]]
CELLS_B = [[7530, 0, 6383], [3644, 793, 2232], [480, 5255, 69009]]


@pytest.mark.parametrize(("cells", "kappa", "accuracy", "f1"), [(CELLS_A, 0.6039730566223671, 0.8064841238688323, 0.5445015454465175), (CELLS_B, 0.5884008919381828, 0.8112372280385205, 0.5398585427671057)])
def test_agreement_metrics(spark, cells, kappa, accuracy, f1):
    rows = [(t, p, cells[i][j]) for i, t in enumerate(agreement.LABELS) for j, p in enumerate(agreement.LABELS)]
    grid = spark.createDataFrame(rows, "true string, pred string, n bigint")
    m = one(agreement.agreement_metrics(grid))
    assert (m.accuracy, m.macro_f1) == (pytest.approx(accuracy, rel=1e-12), pytest.approx(f1, rel=1e-12))
    assert one(agreement.kappa_quadratic(grid)).kappa == pytest.approx(kappa, rel=1e-12)


def test_holm_on_a_small_family(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = [r.p_adj for r in rank.holm(df, "p").orderBy("i").collect()]
    assert got == pytest.approx([0.03, 0.06, 0.06, 0.02])


def test_fighting_words_toy(spark):
    rows = [("great", 100, 2), ("product", 50, 50), ("terrible", 2, 100), ("ok", 10, 10)]
    scored = {r.term: r for r in words.fighting_words(spark.createDataFrame(rows, "term string, y_i bigint, y_j bigint")).collect()}
    assert scored["great"].delta == pytest.approx(0.9603231687052014, rel=1e-12)
    assert scored["great"].sigma2 == pytest.approx(0.014565879664889567, rel=1e-12)
    assert scored["great"].z == pytest.approx(7.956994317103308, rel=1e-12)
    assert scored["terrible"].z == pytest.approx(-scored["great"].z, rel=1e-12)
    assert scored["product"].delta == scored["ok"].delta == 0


def test_mann_kendall_and_sen(spark):
    series = [0.62, 0.55, 0.58, 0.55, 0.51, 0.53, 0.50, 0.49, 0.52]
    df = spark.createDataFrame([(2015 + i, x) for i, x in enumerate(series)], "year int, x double")
    r = one(trend.mann_kendall(df, "year", "x"))
    n = len(series)
    s = sum((b > a) - (b < a) for i, a in enumerate(series) for b in series[i + 1 :])
    slopes = sorted((b - a) / (j - i) for i, a in enumerate(series) for j, b in enumerate(series) if j > i)
    var = (n * (n - 1) * (2 * n + 5) - 2 * 1 * 9) / 18  # one pair of ties
    assert (r.n, r.s, r.tau) == (n, s, pytest.approx(s / 36))
    assert r.var_s == pytest.approx(var)
    assert r.slope == pytest.approx((slopes[17] + slopes[18]) / 2)
    assert trend.trend_word(r.z) == ("decreasing" if normal_two_sided(r.z) < 0.05 else "no trend")


def test_mann_kendall_of_published_means_is_no_trend():
    assert trend.trend_word(-15 / 9.591663046625438) == "no trend"
    assert normal_two_sided(-15 / 9.591663046625438) == pytest.approx(0.11785089502136503, rel=1e-10)
    assert normal_two_sided(-9 / 9.591663046625438) == pytest.approx(0.34808262363292397, rel=1e-10)
