"""Stages on tables with any column names, context over neighbouring matches, rows that repeat many times."""

import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import jaccard, mixing, pieces, pii, quality, queries, secrets

from .brute import prose

NAMES = ("__id", "__ID", "__hash", "__doc_id", "__th", "__mix_id", "__mix_copy", "__mix_copies", "__r", "__said", "__email", "__t", "__cut", "secrets", "Kept", "ROWS", "taken", "a b", "a.b", "n")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, prose(i, 70) + " password: hunter2hunter2", "en", f"s{i % 2}") for i in range(40)] + [(50, prose(3, 70) + " password: hunter2hunter2", "en", "s0"), (50, prose(3, 70) + " password: hunter2hunter2", "en", "s0"), (60, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(NAMES) if c.lower() not in {x.lower() for x in NAMES[:i]}}).cache()


@pytest.mark.parametrize(
    "stage",
    [quality.keep_good, lambda d: jaccard.drop_near_copies(d, corpus_pipeline.NEAR_COPY), secrets.redact, mixing.apply_mix, lambda d: pieces.encode_documents(d, queries.tokenizer_file()), pii.scan],
    ids=["quality", "copies", "secrets", "mix", "pieces", "pii"],
)
def test_columns_of_any_name_pass_through(clashing, stage):
    out = stage(clashing)
    rows = out.collect()
    assert len(rows) > 20 and len(set(map(str.lower, out.columns))) == len(out.columns)
    for i, c in enumerate(clashing.columns[4:]):
        if c in out.columns and c not in ("secrets", "n"):
            assert {r[c] for r in rows} == {clashing.first()[c]}, (i, c)
    if "pii" not in out.columns and "ids" not in out.columns:
        assert out.columns == clashing.columns


def around(text, start, end):
    return text[max(0, start - pii.CONTEXT_CHARS) : start] + " " + text[end : end + pii.CONTEXT_CHARS]


def test_context_reaches_over_other_matches(spark):
    said = [
        "SSN: 123-45-6789, 234-56-7890",
        "credit card 4111 1111 1111 1111, 5500 0000 0000 0004",
        "4111 1111 1111 1111, 5500 0000 0000 0004 credit card",
        "1234 56, 99 88, 4111 1111 1111 1111 order",  # matches that fail stand between
        "a@b.cd " * 9 + "sample",
        "ip 1.2.3.4 5.6.7.8 999.1.1.1 9.9.9.9 10.0.0.1 é" * 3,
    ]
    rows = pii.scan(spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [s.kind for s in rows[0].pii] == ["ssn", "ssn"] and [round(100 * s.score) for s in rows[1].pii] == [100, 100]
    for r in rows:
        for s in r.pii:
            near = around(r.text, s.start, s.end)
            says = lambda words: bool(re.search(rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])", near, re.I))
            want = pii.PRIOR[s.kind] + pii.BONUS * says(pii.CONTEXT[s.kind]) - pii.PENALTY * says(pii.AGAINST[s.kind])
            assert round(100 * s.score) == want, (r.text, s)


def test_context_of_many_matches_takes_seconds(spark):
    said = "card " + ", ".join(["4111 1111 1111 1111"] * 50_000)
    began = time.time()
    row = pii.scan(spark.createDataFrame([(1, said)], "doc_id int, text string")).select(F.size("pii").alias("n"), F.round(F.expr("pii[1].score") * 100).alias("second"), F.round(F.expr("pii[9].score") * 100).alias("tenth")).first()
    assert row == (50_000, 100, 80) and time.time() - began < 60


def test_rows_that_repeat_make_one_set(spark, monkeypatch):
    base = prose(1, 80)
    rows = spark.range(20_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(base).alias("text"))
    nulls = spark.range(500).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(base).alias("text"))
    other = spark.createDataFrame([(3, base + " more"), (9, prose(2, 80)), (7, base + " more still")], "doc_id bigint, text string")
    made, whole = [], jaccard._with_sets

    def counted(*a):
        made.append(whole(*a))
        return made[-1]

    monkeypatch.setattr(jaccard, "_with_sets", counted)
    kept = {}

    def one_task(members, rule, run=jaccard._in_one_task):
        kept["sets"] = members.count()
        return run(members, rule)

    monkeypatch.setattr(jaccard, "_in_one_task", one_task)
    got = jaccard.near_groups(rows.unionByName(nulls).unionByName(other)).groupBy("doc_id", "component_id", "n_links").count().collect()
    assert {(r.doc_id, r.component_id, r.n_links): r["count"] for r in got} == {(7, 3, 2): 20_001, (None, 3, 2): 500, (3, 3, 2): 1, (9, 9, 0): 1}
    assert kept["sets"] <= 2 * 3  # a class comes once for its id and once for rows without one


def test_shuffle_files_of_a_scratch_table_go_with_its_write(spark):
    """They stayed until the driver collected its garbage, so a long chain of tables held all of them at once."""
    import time

    from pyspark.sql import functions as F

    from quillspark.llm.common import SHUFFLE_CLEANUP, discard, scratch

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = lambda: set(re.findall(r"\d+", str(tracker.shuffleStatuses().keySet().toString())))
    before = held()
    made = scratch(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.1)
    assert not held() - before and made.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    discard(made)
