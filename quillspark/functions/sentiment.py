"""Lexicon sentiment: a relational core, and the usual rules over words and their places, all inside the JVM.

The lexicon is a parameter (word, valence); a list of our own serves where none is given. Scores depend on the lexicon, so they are not comparable with those of
other packages unless theirs is supplied.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import WS, tokens

# Words of seven strengths, rated for this library; no other list went into it.
RATED = {
    3.0: "amazing awesome best excellent exceptional fantastic flawless incredible love loved outstanding perfect perfectly stunning superb wonderful",
    2.0: "beautiful comfortable delighted durable effective enjoy enjoyed favorite favourite gentle glad good great happy helpful impressed lovely pleased quality recommend reliable satisfied sturdy thrilled",
    1.0: "clean convenient cute decent easy fine fresh nice okay ok quick smooth soft useful works worth",
    -1.0: "basic bulky cheap dull expensive greasy heavy loose noisy odd overpriced slow small stiff thin tight",
    -2.0: "annoying bad boring broke broken cheaply complaint crack cracked damaged disappointed disappointing fail failed fake flimsy irritated leak leaked leaking messy misleading poor problem problems return returned sad smelly stopped uncomfortable unhappy useless wrong",
    -3.0: "awful disgusting dreadful garbage hate hated horrible junk nasty painful refund ruined scam terrible trash waste wasted worst worthless",
}
DEMO_LEXICON = {word: valence for valence, words in RATED.items() for word in words.split()}
#: Added to the squared sum before the root, which maps sums to (-1, 1).
ALPHA = 15
NEGATIONS = tuple("no not never none nor neither nobody nothing nowhere cannot without hardly rarely seldom despite".split())
BOOSTERS = {w: 0.293 for w in "absolutely completely especially extremely incredibly particularly really so totally truly very".split()} | {w: -0.293 for w in "almost barely hardly kinda marginally partly scarcely slightly somewhat".split()}
NEGATED, NEVER_SO, CAPITALS, BEFORE_BUT, AFTER_BUT = -0.74, 1.25, 0.733, 0.5, 1.5
#: What an exclamation mark adds, up to four; what a question mark adds from the second on, and what more than three add together.
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
#: How much of a booster counts one, two and three words before.
FADE = (1.0, 0.95, 0.9)
#: Words that rules name and no list rates.
RULED = ("but", "least", "at", "very", "this", "so", "doubt", "never", "without")
#: Phrases that are rated as one word.
IDIOMS = {"to die for": 3.0, "kiss of death": -1.5, "yeah right": -2.0, "cut the mustard": 2.0, "back handed": -2.0, "falls apart": -2.5}
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def lexicon_table(spark: SparkSession, lexicon: Mapping[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((lexicon or DEMO_LEXICON).items()), "word string, valence double")


def lexicon_sums(docs: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, hits, valence (sum) and compound for every row with an id: tokens joined with the lexicon.

    Rows are first reduced to distinct words with counts, so a row of many tokens shuffles little.
    """
    words = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    hits = words.join(F.broadcast(lexicon) if _is_small(lexicon) else lexicon, "word")
    sums = hits.groupBy(id_col).agg(F.sum("n").alias("hits"), F.sum(F.col("n") * F.col("valence")).alias("valence"))
    out = docs.select(id_col).join(sums, id_col, "left")
    v = F.coalesce("valence", F.lit(0.0))
    return out.select(id_col, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), v.alias("valence"), compound(v).alias("compound"))


def _is_small(lexicon: DataFrame, rows: int = 200_000) -> bool:
    return lexicon.limit(rows + 1).count() <= rows


def compound(valence: Column) -> Column:
    return valence / F.sqrt(valence * valence + ALPHA)


def sentiment_label(score: Column, positive_from: float = 0.05, negative_to: float = -0.05) -> Column:
    """Both ends inclusive."""
    return F.when(score >= positive_from, "positive").when(score <= negative_to, "negative").when(score.isNotNull(), "neutral")


def star_label(rating: Column, positive: tuple[int, ...] = (4, 5), negative: tuple[int, ...] = (1, 2)) -> Column:
    """Of whole stars, fractions cut off; others are neutral, null stays null."""
    stars = rating.cast("int")
    return F.when(stars.isin(*positive), "positive").when(stars.isin(*negative), "negative").when(stars.isNotNull(), "neutral")


def _as_words(text: Column, idioms: Mapping[str, float]) -> Column:
    """Words between white space without punctuation around them; shorter than three characters they keep it, as faces made of signs are. Emoji are words, idioms too."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"({_EMOJI})", " $1 ")
    for phrase in idioms:
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}]){phrase}(?![\p{{L}}\p{{N}}])", phrase.replace(" ", "_"))
    bare = lambda w: F.regexp_replace(w, f"^{_PUNCTUATION}+|{_PUNCTUATION}+$", "")
    return F.transform(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""), lambda w: F.when(F.length(bare(w)) > 2, bare(w)).otherwise(w))


def _is_upper(w: Column) -> Column:
    return F.rlike(w, F.lit(r"\p{Lu}")) & ~F.rlike(w, F.lit(r"\p{Ll}"))


def rated_words(spark: SparkSession, lexicon: DataFrame, idioms: Mapping[str, float] = IDIOMS) -> DataFrame:
    """word, valence, boost, negates: every word that a rule looks at; valence is null where the lexicon has none, negates where no rule names the word."""
    known = lexicon.unionByName(spark.createDataFrame([(p.replace(" ", "_"), v) for p, v in idioms.items()], "word string, valence double"))
    ruled = [(w, BOOSTERS.get(w), w in NEGATIONS) for w in sorted({*RULED, *BOOSTERS, *NEGATIONS})]
    rules = spark.createDataFrame(ruled, "word string, boost double, negates boolean")
    return known.groupBy("word").agg(F.first("valence").alias("valence")).join(rules, "word", "full")


def score_documents(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, idioms: Mapping[str, float] = IDIOMS) -> DataFrame:
    """id, neg, neu, pos, compound of every row with an id that is its own, by the lexicon (word, valence) and the rules.

    A rated word is stronger in capitals among others that are not, is raised or lowered by boosters up to three words before, turned by
    negations there ("never so", "without doubt" and "at least" are none) and counts half before the first "but" and half as much again after it.
    Exclamation and question marks strengthen the sum. Only words that a rule looks at leave the table of texts, each with its place; what stands
    before a word is read off the rows before it, so no text is gathered and no Python runs. A null or empty text scores 0 throughout.
    """
    words = rated_words(docs.sparkSession, lexicon, idioms)
    marks, asked = F.regexp_count(F.col("__t"), F.lit("!")), F.regexp_count(F.col("__t"), F.lit(r"\?"))
    emphasis = F.least(marks, F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + F.when(asked > 3, MANY_QUESTIONS).when(asked > 1, asked * QUESTION).otherwise(0.0)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).select("__id", _as_words(F.col("__t"), idioms).alias("w"), emphasis.alias("emphasis"))
    uppers = F.size(F.filter("w", _is_upper))
    texts = texts.withColumns({"n": F.size("w"), "mixed": (uppers > 0) & (uppers < F.size("w"))})
    said = texts.select("__id", "mixed", F.posexplode("w").alias("at", "raw")).withColumn("word", F.lower("raw"))
    said = said.join(F.broadcast(words) if _is_small(words) else words, "word", "left").filter("valence is not null or negates is not null or word like '%n\\'t'")
    said = said.select("__id", "at", "mixed", "word", "valence", F.coalesce("boost", F.lit(0.0)).alias("boost"), (F.coalesce("negates", F.lit(False)) | F.col("word").like("%n't")).alias("negates"), _is_upper(F.col("raw")).alias("upper"))
    line = Window.partitionBy("__id").orderBy("at")
    seen = F.struct("at", "word", "valence", "boost", "negates", "upper")
    lagged = said.withColumns({f"l{k}": F.lag(seen, k).over(line) for k in (1, 2, 3)}).withColumn("but", F.min(F.when(F.col("word") == "but", F.col("at"))).over(Window.partitionBy("__id")))
    # The word k places before is among the last three that rules look at, or none of them looks at it.
    before = {k: F.coalesce(*(F.when(F.col(f"l{j}.at") == F.col("at") - k, F.col(f"l{j}")) for j in range(1, k + 1))) for k in (1, 2, 3)}
    rated = lagged.withColumns({f"b{k}": b for k, b in before.items()}).filter("valence is not null and valence <> 0")
    rated = rated.withColumn("v", F.col("valence") + F.when(F.col("upper") & F.col("mixed"), F.signum("valence") * CAPITALS).otherwise(0.0))
    word = lambda k: F.coalesce(F.col(f"b{k}.word"), F.lit(""))
    for k in (1, 2, 3):
        free = F.col(f"b{k}").isNotNull() & F.col(f"b{k}.valence").isNull()
        loud = F.when((F.col(f"b{k}.boost") != 0) & F.col(f"b{k}.upper") & F.col("mixed"), CAPITALS).otherwise(0.0)
        rated = rated.withColumn("v", F.col("v") + F.when(free, F.signum("v") * (F.col(f"b{k}.boost") + loud) * FADE[k - 1]).otherwise(0.0))
        nearer = [word(j) for j in range(1, k)]
        among = lambda names, nearer=tuple(nearer): reduce(lambda a, w: a | w.isin(*names), nearer, F.lit(False))
        turn = F.when((word(k) == "never") & among(("so", "this")), NEVER_SO).when((word(k) == "without") & among(("doubt",)), 1.0).when(F.col(f"b{k}.negates"), NEGATED).otherwise(1.0)
        rated = rated.withColumn("v", F.col("v") * F.when(free, turn).otherwise(1.0))
    rated = rated.withColumn("v", F.col("v") * F.when((word(1) == "least") & F.col("b1.valence").isNull() & ~word(2).isin("at", "very"), NEGATED).otherwise(1.0))
    v = F.col("v") * F.when(F.col("at") < F.col("but"), BEFORE_BUT).when(F.col("at") > F.col("but"), AFTER_BUT).otherwise(1.0)
    sums = rated.withColumn("v", v).groupBy("__id").agg(F.sum("v").alias("total"), F.sum(F.when(F.col("v") > 0, F.col("v") + 1)).alias("up"), F.sum(F.when(F.col("v") < 0, F.col("v") - 1)).alias("down"), F.count_if(F.col("v") != 0).alias("hits"))
    out = texts.select("__id", "n", "emphasis").join(sums, "__id", "left").fillna(0.0, ["total", "up", "down"]).fillna(0, ["hits"])
    total = F.col("total") + F.signum("total") * F.col("emphasis")
    up = F.col("up") + F.when(F.col("up") > -F.col("down"), F.col("emphasis")).otherwise(0.0)
    down = -F.col("down") + F.when(F.col("up") < -F.col("down"), F.col("emphasis")).otherwise(0.0)
    rest = (F.col("n") - F.col("hits")).cast("double")
    share = lambda x: F.coalesce(x / F.nullif(up + down + rest, F.lit(0.0)), F.lit(0.0))
    return out.select(F.col("__id").alias(id_col), share(down).alias("neg"), share(rest).alias("neu"), share(up).alias("pos"), compound(total).alias("compound"))
