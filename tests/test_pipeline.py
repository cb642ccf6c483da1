"""The whole analysis on a small corpus, and the driver contract."""

import json
import random

import pytest

from quillspark.config import Bootstrap, Config, Sampling, Words
from quillspark.plans.oracle import oracle_sql
from quillspark.plans.pipeline import Pipeline, register_functions
from quillspark.plans.queries import QUERIES


def corpus(path, seed, good):
    r, lines = random.Random(seed), []
    for i in range(160):
        happy = r.random() < good
        said = " ".join(r.choice(("good", "great", "hair", "love") if happy else ("bad", "bike", "awful", "poor")) for _ in range(r.randint(2, 30)))
        lines.append({"rating": r.choice((4.0, 5.0)) if happy else r.choice((1.0, 2.0, 3.0)), "title": "T" if i % 4 else None, "text": said, "timestamp": (2015 + i % 9 - 1970) * 31557600000 + i})
    lines += lines[:5]
    path.write_text("\n".join(map(json.dumps, lines)), encoding="utf-8")
    return str(path)


def test_pipeline_runs_and_caches(spark, tmp_path):
    cfg = Config(
        sources={"A": (str(tmp_path / "missing"), corpus(tmp_path / "a.jsonl", 1, 0.7)), "B": (corpus(tmp_path / "b.jsonl", 2, 0.4),)},
        output=str(tmp_path / "out"), sampling=Sampling(per_cell=15), words=Words(min_df=2, top_n=5), bootstrap=Bootstrap(iterations=200),
    )
    results = Pipeline(spark, cfg).run()
    assert results["distributions"]["mannwhitney"].delta > 0
    assert set(results["words"]) == {"A", "B", "crosscat"}
    assert json.loads((tmp_path / "out/stats/agreement.json").read_text())["spearman"]["rho"] > 0.5
    assert (tmp_path / "out/tables/rq1.tex").exists()
    stage = tmp_path / "out/data/sample_scored/_SUCCESS"
    made = stage.stat().st_mtime_ns
    Pipeline(spark, cfg).run(only=[])
    assert stage.stat().st_mtime_ns == made
    Pipeline(spark, cfg).run(only=[], force=True)
    assert stage.stat().st_mtime_ns > made


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("select decode_entities('&lt;a&gt;') as t, compound(2) as c, star_label(4.5) as s, sentiment_label(-0.05) as l, sample_key(42, '7') as k, review_tokens('It''s été ok, x2') as w").first()
    assert (r.t, r.s, r.l, r.w) == ("<a>", "positive", "negative", ["it's", "ok"]) and r.c == pytest.approx(2 / 19**0.5)
    grams = spark.sql("select * from review_ngrams(array('a', 'b', 'c'), 2)").collect()
    assert [(g.place, g.gram) for g in grams] == [(0, "a"), (0, "a b"), (1, "b"), (1, "b c"), (2, "c")]


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(oracle_sql()) == {"bootstrap_ci", "bootstrap_ci_median", "bootstrap_diff_ci", "trend_band"}
    assert set(oracle_sql()) <= set(QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
