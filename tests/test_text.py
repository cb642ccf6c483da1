"""Text functions on the cases that tell dialects apart."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import sentiment, text
from quillspark.operators import words


def apply(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i")
    return [r.x for r in rows.collect()]


@pytest.mark.parametrize(
    ("said", "expected"),
    [
        ("Don't buy café's 5stars it_is naïve “quoted”words o'neil's rock'n'roll ABC", "don't buy s quoted words o'neil s rock'n roll abc"),
        ("é'x a-b éclair x² IBM's 'tis y' ﬁne", "x a b e clair ibm's tis y"),
        ("the dogs' tails; don't, didn't!", "the dogs tails don't didn't"),
        ("", ""),
    ],
)
def test_tokens(spark, said, expected):
    assert apply(spark, [said], text.tokens) == [expected.split()]


def test_bigrams_bridge_stop_words(spark):
    grams = lambda c: text.ngrams(text.drop_stop_words(text.tokens(c), ("to",)))
    assert apply(spark, ["easy to use daily", "to", "one"], grams) == [["easy", "use", "daily", "easy use", "use daily"], [], ["one"]]


def test_negations_are_no_stop_words():
    assert not {"no", "nor", "not"} & set(text.STOP_WORDS)


def test_token_count_sees_all_white_space(spark):
    assert apply(spark, ["a b\u0085c d\u001ce  f", "", " x "], text.token_len) == [6, 0, 1]


def test_clean_text_decodes_before_it_drops_tags(spark):
    said = ["&lt;b&gt;x&lt;/b&gt;", "a<br />b [[ASIN:B00 name]] c", "it’s â ‘ok’ &eacute; &amp; more", None, "  "]
    assert apply(spark, said, text.clean_text) == ["x", "a b c", "it's ' 'ok' é & more", None, ""]
    plain = lambda c: text.clean_text(c, mojibake_compat=False)
    assert apply(spark, ["pâte"], plain) == ["pâte"]


def test_entities_without_a_semicolon(spark):
    said = ["a &amp b &amp", "&amp; &eacute; &#233; &#xe9; &ampx; &nosuch; &amp;quot; &am", None]
    ended = lambda c: text.clean_text(c, ended_only=True)
    assert apply(spark, said, ended) == ["a &amp b &amp", "& é é é &ampx; &nosuch; &quot; &am", None]
    assert apply(spark, said[:1], text.clean_text) == ["a & b &"]


def test_clean_text_query_leaves_cut_entities_as_its_sql_does(spark, tmp_path):
    import duckdb

    from quillspark.plans import oracle, queries

    page = "<p>x&amp;y &quot;z&quot;</p> cut&amp"
    spark.createDataFrame([(1, page)], "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in queries.QUERIES["clean_text"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("orders", "lineitem", "documents", "labels", "events", "conversations"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    assert got == con.execute(oracle.oracle_sql()["clean_text"]).fetchall()


def test_ascii_ratio(spark):
    assert apply(spark, ["", "abc", "é", "aé"], text.ascii_ratio) == [0.0, 1.0, 0.0, 0.5]


def test_labels(spark):
    df = spark.createDataFrame([(0.05, 4.5), (-0.05, 0.0), (0.0499, 2.9), (None, None)], "s double, r double")
    got = df.select(sentiment.sentiment_label(F.col("s")).alias("s"), sentiment.star_label(F.col("r")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("positive", "positive"), ("negative", "neutral"), ("neutral", "negative"), (None, None)]


def test_lexicon_join_equals_counting(spark):
    docs = spark.createDataFrame([(1, "good good bad"), (2, "nothing"), (3, "")], "id int, text string")
    got = {r.id: (r.hits, r.valence) for r in sentiment.lexicon_sums(docs, sentiment.lexicon_table(spark, {"good": 2.0, "bad": -1.0})).collect()}
    assert got == {1: (3, 3.0), 2: (0, 0.0), 3: (0, 0.0)}


def test_tfidf_counts_documents_without_terms(spark):
    import math

    docs = spark.createDataFrame([(1, "a", "apple pear"), (2, "a", "the"), (3, "b", "apple")], "id int, g string, text string")
    terms = words.document_terms(docs, "id", "text", "g", n_max=1)
    got = {(r.group, r.term): r.mean_tfidf for r in words.tfidf_top(docs, terms, "id", "g", ["a", "b"], 5, min_df=1).collect()}
    apple, pear = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    assert got[("a", "pear")] == pytest.approx(pear / math.hypot(apple, pear) / 2)
    assert got[("b", "apple")] == pytest.approx(1.0)


def test_log_odds_of_one_term_is_undefined(spark):
    assert words.fighting_words(spark.createDataFrame([("x", 3, 2)], "term string, y_i bigint, y_j bigint")).first().z is None


def test_tfidf_query_keeps_all_terms(spark, tmp_path):
    import math

    from quillspark.plans import queries

    letters = [F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.floor(F.col("id") / 26**k) % 26 + 1).cast("int"), F.lit(1)) for k in range(4)]
    text = spark.range(60_000).select(F.concat(F.lit("qx"), *letters).alias("w")).agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("text"))
    turns = spark.range(10).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"))
    turns.crossJoin(text).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["tfidf_top"](spark, str(tmp_path)).collect()
    assert len(got) == 50 and {r.mean_tfidf for r in got} == {round(1 / math.sqrt(119_999), 6)}
