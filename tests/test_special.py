"""Tail probabilities against published values and identities."""

import math

import pytest

from quillspark.functions import special


def test_ks_p_value_of_a_published_statistic():
    assert special.ks_two_sided(0.015860129207381668, 94261, 95326) == pytest.approx(8.72297692e-11, rel=1e-8)


def test_chi_square_p_value_of_a_published_statistic():
    assert special.chi_square_1(6.8953915816) == pytest.approx(0.0086418231, rel=1e-8)


def test_t_tail_of_a_published_regression():
    coef, r2, n = -0.005760277589945, None, 94261
    del coef, r2
    t = 9.1424  # about what the published p of 6e-20 stands for
    assert 1e-21 < special.t_two_sided(t, n - 2) < 1e-18


def test_t_quantile_inverts_the_tail():
    for df in (1, 2, 7, 30, 1e5):
        for level in (0.5, 0.9, 0.95, 0.999):
            assert special.t_two_sided(special.t_quantile(level, df), df) == pytest.approx(1 - level, rel=1e-9)


def test_t_with_one_degree_is_cauchy():
    for t in (0.1, 1.0, 5.0):
        assert special.t_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-10)


def test_edges():
    assert special.ks_two_sided(0.0, 5, 5) == 1.0
    assert special.ks_two_sided(1.0, 5, 5) == 0.0
    assert math.isnan(special.t_two_sided(1.0, 0))
    assert special.normal_two_sided(special.Z975) == pytest.approx(0.05)


def test_tails_as_columns_equal_those_on_the_driver(spark):
    from pyspark.sql import functions as F

    t = [(x, v) for x in (0.0, 0.3, 1.0, 2.5, -7.0, 40.0, -12.7062047362) for v in (1, 2, 3, 10, 57, 399, 400, 5_000, 10**7)]
    got = spark.createDataFrame(t, "t double, v long").select("t", "v", special.t_two_sided_p(F.col("t"), F.col("v")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(special.t_two_sided(r.t, r.v), rel=2e-8 if r.p > 1e-35 else 1e-5, abs=1e-300), r
    # Tabulated: 97.5 % points of the t distribution.
    table = {1: 12.7062, 2: 4.3027, 5: 2.5706, 10: 2.2281, 30: 2.0423, 120: 1.9799, 1000: 1.9623}
    rows = spark.createDataFrame(list(table.items()), "v long, t double").select(special.t_two_sided_p(F.col("t"), F.col("v")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.05, abs=1e-5) for r in rows)
    z = spark.createDataFrame([(1.959964, 0.05), (2.575829, 0.01), (3.290527, 0.001), (0.674490, 0.5)], "z double, p double")
    assert all(r.got == pytest.approx(r.p, rel=1e-5) for r in z.select("p", special.two_sided_p(F.col("z")).alias("got")).collect())
    d = [(0.015860129207381668, 94261, 95326), (0.5, 10, 12), (1.0, 5, 5), (0.0, 5, 5), (0.03, 3000, 5000), (0.2, 1, 1), (0.9, 40, 40)]
    for r in spark.createDataFrame(d, "d double, a long, b long").select("*", special.ks_two_sided_p(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(special.ks_two_sided(r.d, r.a, r.b), rel=1e-8), r
    none = spark.createDataFrame([(None, 5, 0.1)], "t double, v long, d double").select(special.t_two_sided_p(F.col("t"), F.col("v")), special.t_two_sided_p(F.col("d"), F.lit(0)), special.ks_two_sided_p(F.col("d"), F.lit(0), F.lit(3))).first()
    assert none == (None, None, None)


def test_smirnov_sum_and_limit_meet(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x / 100.0, 20_000, 20_000) for x in (1.2, 2.0, 3.0)], "d double, a long, b long")
    tail = lambda: [r.p for r in rows.select("d", special.ks_two_sided_p(F.col("d"), F.col("a"), F.col("b")).alias("p")).orderBy("d").collect()]
    exact = tail()
    monkeypatch.setattr(special, "KS_TERMS", 1000)
    assert tail() == pytest.approx(exact, rel=4e-3)
