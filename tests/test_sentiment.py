"""The sentiment rules, one by one with hand-made sums, and their shares."""

import math

import pytest

from quillspark.functions import sentiment

LEXICON = {"good": 2.0, "bad": -2.0, "like": 1.0, "\U0001f600": 1.5, ":(": -2.0}


@pytest.fixture(scope="module")
def score(spark):
    lexicon = sentiment.lexicon_table(spark, LEXICON)

    def run(*texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        return {texts[r.id]: r for r in sentiment.score_documents(docs, "id", "text", lexicon).collect()}

    return run


CASES = {
    "a good day": 2.0,
    "not good": 2 * -0.74,
    "isn't that good": 2 * -0.74,
    "not a very good day": (2 + 0.293) * -0.74,
    "good, not bad.": 2 + 2 * 0.74,
    "very good": 2.293,
    "very, well, good": 2 + 0.293 * 0.95,
    "very this that good": 2 + 0.293 * 0.9,
    "very this that odd good": 2.0,
    "slightly bad": -2 + 0.293,
    "GOOD day": 2.733,
    "GOOD DAY": 2.0,
    "VERY good day": 2 + 0.293 + 0.733,
    "never so good": (2 + 0.293) * 1.25,
    "never this good": 2 * 1.25,
    "without a doubt good": 2.0,
    "least good": 2 * -0.74,
    "at least good": 2.0,
    "good but bad": 1.0 - 3.0,
    "bad but good": -1.0 + 3.0,
    "good!": 2.292,
    "good!!!!!!": 2 + 4 * 0.292,
    "bad!": -2.292,
    "good?": 2.0,
    "good??": 2.36,
    "good????": 2.96,
    "fine\U0001f600day": 1.5,
    "so :( now": -2.0 - 0.293,
    "a dress to die for": 3.0,
    "like good": 3.0,  # a rated word neither raises nor turns
    "nothing": 0.0,
}


def test_rules(score):
    got = score(*CASES)
    for text, total in CASES.items():
        assert got[text].compound == pytest.approx(total / math.sqrt(total * total + 15)), text


def test_shares_nulls_and_empty_texts(score):
    got = score("good bad day", None, "", "   ", "GOOD! bad day, said nobody")
    assert all((r.neg, r.neu, r.pos, r.compound) == (0, 0, 0, 0) for t, r in got.items() if not (t or "").strip())
    r = got["good bad day"]
    assert (r.neg, r.neu, r.pos) == pytest.approx((3 / 7, 1 / 7, 3 / 7))
    assert all(r.neg + r.neu + r.pos == pytest.approx(1) for t, r in got.items() if (t or "").strip())


def test_long_texts_and_no_python(spark):
    lexicon = sentiment.lexicon_table(spark, LEXICON)
    docs = spark.createDataFrame([(1, "not good day off " * 25_000)], "id int, text string")
    scored = sentiment.score_documents(docs, "id", "text", lexicon)
    assert scored.first().compound == pytest.approx(-1, abs=1e-6)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
