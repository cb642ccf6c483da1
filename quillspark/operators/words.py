"""Vocabularies: term counts, words that set two groups apart, TF-IDF. All in long form (doc, term, tf)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import STOP_WORDS, drop_stop_words, ngrams, tokens


def document_terms(docs: DataFrame, id_col: str, text_col: str, group: str | None = None, n_max: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """id, (group,) term, tf. A text is tokenised once; its repeats are added up in place, before anything is shuffled."""
    keep = [id_col, *([group] if group else [])]
    cut = docs.select(*keep, drop_stop_words(tokens(F.coalesce(F.col(text_col), F.lit(""))), stop).alias("__words"))
    return cut.select(*keep, F.explode(ngrams(F.col("__words"), n_max)).alias("term")).groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(terms: DataFrame, min_df: int = 10, max_terms: int | None = 100_000) -> DataFrame:
    """term, df, tf of terms in at least ``min_df`` documents; of these the ``max_terms`` most frequent, ties by term."""
    kept = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).filter(F.col("df") >= min_df)
    return kept if max_terms is None else kept.orderBy(F.desc("tf"), "term").limit(max_terms)


def group_counts(terms: DataFrame, group: str, a: str, b: str, min_df: int = 1, max_terms: int | None = None) -> DataFrame:
    """term, y_i, y_j: totals in the two groups side by side, absent as 0, over one vocabulary of both."""
    both = terms.filter(F.col(group).isin(a, b))
    total = lambda g: F.coalesce(F.sum(F.when(F.col(group) == g, F.col("tf"))), F.lit(0))
    s = both.groupBy("term").agg(F.count(F.lit(1)).alias("__df"), F.sum("tf").alias("__tf"), total(a).alias("y_i"), total(b).alias("y_j")).filter(F.col("__df") >= min_df)
    if max_terms is not None:
        s = s.orderBy(F.desc("__tf"), "term").limit(max_terms)
    return s.select("term", "y_i", "y_j")


def fighting_words(counts: DataFrame, prior: DataFrame | None = None, min_prior: int = 1) -> DataFrame:
    """term, y_i, y_j, alpha, delta, sigma2, z: log-odds of two groups with an informative Dirichlet prior.

    ``counts``: term, y_i, y_j. ``prior``: term, alpha; without one it is y_i + y_j. Terms of
    either side count, absent ones as 0; those with alpha below ``min_prior`` are left out before totals are taken.
    """
    if prior is None:
        rows = counts.withColumn("alpha", F.col("y_i") + F.col("y_j"))
    else:
        p = prior.select(F.col("term").alias("__t"), "alpha")
        rows = counts.join(p, F.col("term") == F.col("__t"), "full_outer").select(F.coalesce("term", "__t").alias("term"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("y_i", "y_j", "alpha")))
    rows = rows.filter(F.col("alpha") >= min_prior)
    totals = rows.agg(F.sum("y_i").alias("n_i"), F.sum("y_j").alias("n_j"), F.sum("alpha").alias("a_0"))
    rows = rows.join(F.broadcast(totals), F.lit(True))
    odds = lambda y, n: F.log((F.col(y) + F.col("alpha")) / F.nullif((F.col(n) + F.col("a_0") - F.col(y) - F.col("alpha")).cast("double"), F.lit(0.0)))
    delta = odds("y_i", "n_i") - odds("y_j", "n_j")
    sigma2 = 1 / (F.col("y_i") + F.col("alpha")) + 1 / (F.col("y_j") + F.col("alpha"))
    return rows.select("term", "y_i", "y_j", "alpha", delta.alias("delta"), sigma2.alias("sigma2"), (delta / F.sqrt(sigma2)).alias("z"))


def top_bottom_k(scored: DataFrame, k: int, a: str, b: str, score: str = "z") -> DataFrame:
    """The ``k`` most distinctive terms of either group, most distinctive of ``a`` first; ties by term."""
    top = scored.orderBy(F.desc(score), "term").limit(k).withColumn("distinctive_of", F.lit(a))
    bottom = scored.orderBy(F.asc(score), "term").limit(k).withColumn("distinctive_of", F.lit(b))
    return top.unionByName(bottom)


def tfidf_top(docs: DataFrame, terms: DataFrame, id_col: str, group: str, groups: Sequence[str], n: int, min_df: int = 10, max_terms: int | None = 100_000) -> DataFrame:
    """group, term, mean_tfidf of the ``n`` terms with the largest mean weight in each group.

    Smooth idf over the documents of all ``groups``, rows of unit length; the mean is over all
    documents of the group, those without any kept term included.
    """
    texts = docs.filter(F.col(group).isin(*groups))
    kept = terms.filter(F.col(group).isin(*groups))
    vocab = vocabulary(kept, min_df, max_terms).select("term", "df")
    sizes = texts.groupBy(group).agg(F.count(F.lit(1)).alias("n_group"))
    sizes = sizes.withColumn("n_all", F.sum("n_group").over(Window.partitionBy())).withColumnRenamed(group, "__g")
    w = kept.join(vocab, "term").join(F.broadcast(sizes), F.col(group) == F.col("__g"))
    w = w.withColumn("w", F.col("tf") * (F.log((1 + F.col("n_all")) / (1 + F.col("df"))) + 1))
    norms = w.groupBy(F.col(id_col).alias("__id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__norm"))
    w = w.join(norms, F.col(id_col) == F.col("__id")).withColumn("w", F.col("w") / F.col("__norm"))
    means = w.groupBy(group, "term").agg((F.sum("w") / F.first("n_group")).alias("mean_tfidf"))
    order = Window.partitionBy(group).orderBy(F.desc("mean_tfidf"), "term")
    return means.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).select(F.col(group).alias("group"), "term", "mean_tfidf")


def word_bars(top: DataFrame) -> DataFrame:
    """place, term, z, distinctive_of: bars from the least to the greatest z."""
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("z", "term"))).select("place", "term", "z", "distinctive_of")
