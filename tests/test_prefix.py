"""Running sums by windows and by ranges against pandas, with null keys, repeats, keys that span ranges and empty tables."""

import pandas as pd
import pytest

from quillspark.operators import hist, prefix


@pytest.mark.parametrize("rows", [0, 1 << 20])
@pytest.mark.parametrize("spread", [1, 3, 400])
def test_sums_equal_pandas(spark, monkeypatch, rows, spread):
    monkeypatch.setattr(prefix, "WINDOW_ROWS", rows)
    monkeypatch.setattr(prefix, "checkpoint_folder", prefix.checkpoint_folder)
    data = [(None if i % 7 == 0 else f"k{i % spread}", None if i % 5 == 0 else i % 2, (i * 7919) % 1000, i % 11) for i in range(1000)]
    df = spark.createDataFrame(data, "a string, b int, v int, n int").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.a, r.b, r.v): r.cum_n for r in prefix.prefix_sums(df, ["n"], ["a", "b"], ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pdf = pd.DataFrame(data, columns=["a", "b", "v", "n"]).sort_values("v")
    pdf["cum"] = pdf.groupby(["a", "b"], dropna=False).n.cumsum()
    want = {(None if pd.isna(r.a) else r.a, None if pd.isna(r.b) else int(r.b), r.v): r.cum for r in pdf.itertuples()}
    assert got == want
    assert prefix.prefix_sums(df.limit(0), ["n"], ["a"], ["v"]).collect() == []


def test_one_key_over_many_ranges_and_several_columns(spark, monkeypatch):
    monkeypatch.setattr(prefix, "WINDOW_ROWS", 0)
    df = spark.range(5000).selectExpr("id as v", "1 as n", "id as m")
    got = prefix.prefix_sums(df.repartition(5), ["n", "m"], [], ["v"]).collect()
    assert len(got) == 5000 and all((r.cum_n, r.cum_m) == (r.v + 1, r.v * (r.v + 1) // 2) for r in got)


def test_a_description_reads_its_table_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id as double) as v", "'positive' as l").mapInArrow(seen, "k bigint, v double, l string")
    got = hist.descriptives(df, "v", "l", ["k"]).collect()
    assert len(got) == 3 and all(r.pct_positive == 100 for r in got) and reads.value == 1000
    pdf = pd.DataFrame({"v": range(1000)}, dtype=float)
    pdf["k"] = pdf.index % 3
    for r in hist.describe(df, "v", ["k"]).collect():
        d = pdf.v[pdf.k == r.k].describe()
        assert (r.n, r.mean, r.std, r.min, r.q25, r.q50, r.q75, r.max) == pytest.approx(tuple(d))


def test_descriptions_with_nulls_and_without_rows(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", float("nan"), "neutral"), ("a", 2.0, "positive"), (None, None, None)], "g string, v double, l string")
    got = {r.g: r for r in hist.descriptives(df, "v", "l", ["g"]).collect()}
    assert (got["a"].n, got["a"].mean, got["a"].median, got["a"].std) == (3, 2.0, 2.0, 0.0) and got["a"].pct_neutral == pytest.approx(100 / 3)
    assert (got[None].n, got[None].mean) == (1, None)
    assert hist.describe(df.limit(0), "v").first().n == 0 and hist.describe(df.limit(0), "v", ["g"]).collect() == []
