"""Counts over pairs and median slopes against making the pairs, in one task and cut into blocks and ranges."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import pairs, prefix, trend


def brute(x):
    a, b = np.triu_indices(len(x), 1)
    return int((x[b] > x[a]).sum()), int((x[b] < x[a]).sum()), float(np.median((x[b] - x[a]) / (b - a)))


SERIES = {
    "noise": np.random.default_rng(0).standard_normal(700),
    "ties": np.random.default_rng(1).integers(0, 4, 701).astype(float),
    "flat": np.r_[np.zeros(500), 1.0, np.zeros(300)],
    "rise": np.arange(600) * 0.25 + np.random.default_rng(2).integers(0, 3, 600),
    "short": np.array([3.0, 1.0, 2.0]),
    "one": np.array([5.0]),
}


@pytest.mark.parametrize("name", [n for n in SERIES if n != "one"])
def test_counts_and_slopes_in_a_task(name):
    x = SERIES[name]
    up, _, slope = brute(x)
    assert pairs.ascents_in(x) == up
    assert pairs.median_slope(np.arange(len(x), dtype=float), x) == pytest.approx(slope, rel=1e-11, abs=1e-12)


def frame(spark):
    rows = [(name, int(i) + 100, float(v)) for name, x in SERIES.items() for i, v in enumerate(x)] + [("null", 1, None)]
    return spark.createDataFrame(rows, "g string, t int, v double").repartition(5)


@pytest.mark.parametrize("cut", [False, True])
def test_mann_kendall_equals_pairs(spark, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(pairs, "CHUNK", 128)
        monkeypatch.setattr(prefix, "WINDOW_ROWS", 0)
        monkeypatch.setattr(pairs, "PASSES", 3)  # slopes are tested below
    got = {r.g: r for r in trend.mann_kendall(frame(spark), "t", "v", ["g"]).collect()}
    assert got.keys() == SERIES.keys() and got["one"].s is None and got["one"].slope is None
    for name, x in SERIES.items():
        if name != "one":
            up, down, slope = brute(x)
            assert (got[name].n, got[name].s) == (len(x), up - down), name
            if not cut or len(x) <= 128:
                assert got[name].slope == pytest.approx(slope, rel=1e-11, abs=1e-12)
                assert got[name].intercept == pytest.approx(np.median(x) - slope * (len(x) - 1) / 2, abs=1e-9)


def test_slopes_of_long_series_narrow_to_the_middle(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 64)
    monkeypatch.setattr(pairs, "PASSES", 4)
    x = SERIES["noise"][:150]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, x double")
    got = pairs.pair_statistics(df, []).first()
    step = np.diff(x)
    assert got.p == brute(x)[0] and abs(got.slope - brute(x)[2]) <= (step.max() - step.min()) / 2**4


def test_a_million_periods_make_no_pairs(spark):
    n = 1_000_000
    df = spark.range(n).select("id", (F.col("id") % 1000).cast("double").alias("x"))
    rows = df.select(F.col("id").alias("i"), "x")
    began = time.time()
    p = pairs.ascents(rows, []).first().p
    # Two places of different thousands ascend by value alone; two of one thousand always do.
    assert p == 1000 * (1000 * 999 // 2) + (1000 * 999 // 2) * (1000 * 999 // 2)
    assert time.time() - began < 120
    plan = pairs.ascents(rows, [])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
