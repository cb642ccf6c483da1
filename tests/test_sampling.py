"""Samples, sources, sinks and streaming."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.config import Config, load_config
from quillspark.operators import sampling
from quillspark.sources import readers, sinks


def test_sample_does_not_depend_on_layout(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    one = {r.id for r in sampling.bottom_k(df, ["g"], 10, "id").collect()}
    two = {r.id for r in sampling.bottom_k(df.repartition(7).orderBy(F.desc("id")), ["g"], 10, "id").collect()}
    assert one == two and Counter(i % 3 for i in one) == {0: 10, 1: 10, 2: 10}


def test_small_cells_and_equal_cells(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "id int, g string")
    assert sampling.bottom_k(df, ["g"], 5, "id").filter("g = 'a'").count() == 3
    assert Counter(r.g for r in sampling.equal_cells(df, ["g"], "id").collect()) == {"a": 3, "b": 3}


def test_summary_lists_absent_cells(spark):
    df = spark.createDataFrame([("a", 2015)] * 3, "c string, y int")
    rows = {(r.c, r.y): (r.population_count, r.sampled_count, r.shortfall) for r in sampling.sampling_summary(df, "c", "y", ["a", "b"], (2015, 2016), 2).collect()}
    assert rows == {("a", 2015): (3, 2, 0), ("a", 2016): (0, 0, 2), ("b", 2015): (0, 0, 2), ("b", 2016): (0, 0, 2)}


def test_first_duplicate_stays(spark):
    df = spark.createDataFrame([(2, "x", None), (1, "x", None), (3, "y", "z")], "id int, a string, b string")
    assert {r.id for r in sampling.drop_duplicates_first(df, ["a", "b"], ["id"]).collect()} == {1, 3}


def test_stage_log(spark):
    rows = sampling.stage_log(spark.range(10), [("even", F.col("id") % 2 == 0), ("big", F.col("id") > 4)]).collect()
    assert [tuple(r) for r in rows] == [("start", 10, 0), ("even", 5, 5), ("big", 2, 3)]


MIDNIGHT = 1420070400000


def reviews(tmp_path):
    lines = [
        {"rating": 5, "title": " T ", "text": " fine ", "timestamp": MIDNIGHT, "helpful_vote": 2, "verified_purchase": True},
        {"rating": 1, "text": "bad", "timestamp": MIDNIGHT - 1},
        {"rating": 1, "text": "  ", "timestamp": MIDNIGHT},
        {"rating": 1, "text": "no time"},
        {"rating": 3, "text": "late", "timestamp": 1704067199999},
        {"rating": 3, "text": "too late", "timestamp": 1704067200000},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n", encoding="utf-8")
    return str(path)


def test_parse_reviews(spark, tmp_path):
    raw = readers.read_jsonl(spark, reviews(tmp_path))
    rows = sorted(readers.parse_reviews(raw, "A", 2015, 2023).collect(), key=lambda r: r.timestamp)
    assert [(r.year, r.title, r.text, r.helpful_vote, r.verified_purchase) for r in rows] == [(2015, "T", "fine", 2, True), (2023, "", "late", 0, False)]
    assert readers.parse_reviews(raw, "A").count() == 4
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, reviews(tmp_path), strict=True).collect()


def test_sources_fall_back(spark, tmp_path):
    assert readers.open_reviews(spark, [str(tmp_path / "none"), reviews(tmp_path)]).count() == 7
    with pytest.raises(RuntimeError, match="2 sources"):
        readers.open_first([lambda: spark.read.parquet("/nowhere"), lambda: spark.read.json("/nowhere")])


def test_stage_cache_follows_the_configuration(spark, tmp_path):
    path, one, two = str(tmp_path / "stage"), Config().fingerprint(), Config(output="elsewhere").fingerprint()
    assert not sinks.stage_is_current(spark, path, one)
    sinks.write_stage(spark.range(3), path, one)
    assert sinks.stage_is_current(spark, path, one) and not sinks.stage_is_current(spark, path, two)
    assert spark.read.parquet(path).count() == 3


def test_config_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("sampling: {per_cell: 7}\nlabels: {positive_stars: [5]}\nsources: {A: /x, B: [/y, /z]}\n")
    cfg = load_config(str(path))
    assert (cfg.sampling.per_cell, cfg.sampling.seed, cfg.labels.positive_stars, cfg.sources) == (7, 42, (5,), {"A": ("/x",), "B": ("/y", "/z")})
    path.write_text("sampling: {per_call: 7}\n")
    with pytest.raises(ValueError, match="per_call"):
        load_config(str(path))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b & c", 12345, 0.5), ("x", 1, None)], "name string, n bigint, v double")
    tex = sinks.to_latex(df, "A & B", "tab:x", {"v": ".2f"}, {"name": "Name & more"})
    assert r"a\_b \& c & 12,345 & 0.50 \\" in tex and r"x & 1 & -- \\" in tex and r"Name \& more" in tex
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), df.schema).count() == 2
    sinks.write_json({"rows": df.collect(), "bad": float("nan")}, str(tmp_path / "o/r.json"))
    assert json.loads((tmp_path / "o/r.json").read_text()) == {"rows": [{"name": "a_b & c", "n": 12345, "v": 0.5}, {"name": "x", "n": 1, "v": None}], "bad": None}
