"""The review analysis from sources to result tables: ``python -m quillspark.plans.pipeline CONFIG [--force]``.

Three stages make tables (sample, clean, score) and are skipped while their output is there and was
made with the same configuration; four analyses read the scored table. All run in one
session, so tables pass as Parquet and nothing is gathered but small results.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillspark.config import Config, load_config
from quillspark.functions import langid, sentiment, text
from quillspark.functions.special import chi_square_1, normal_two_sided
from quillspark.operators import agreement, figures, hist, rank, resample, sampling, trend, words
from quillspark.session import get_session, setup_logging
from quillspark.sources import readers, sinks

# Columns of the published stage table.
CLEAN_COLUMNS = ("category", "year", "rating", "title", "text", "review_text", "char_len", "token_len", "helpful_vote", "verified_purchase", "timestamp")


class Pipeline:
    """One configured run. ``detector`` identifies languages (default: none, all texts are kept) and ``lexicon`` scores words."""

    def __init__(self, spark: SparkSession, cfg: Config, detector: Any = None, lexicon: Mapping[str, float] | None = None):
        if len(cfg.sources) != 2:
            raise ValueError("an analysis compares two categories")
        self.spark, self.cfg, self.detector, self.lexicon = spark, cfg, detector, lexicon
        self.a, self.b = cfg.sources
        self.log = setup_logging()
        self.held: list[DataFrame] = []
        #: What is to be done when the stage at hand has been written.
        self.afterwards: list[Callable[[], None]] = []

    def hold(self, df: DataFrame) -> DataFrame:
        """``df`` kept until the stage or analysis that uses it more than once is done."""
        self.held.append(df.persist())
        return self.held[-1]

    def release(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    # --- tables

    def sample(self) -> DataFrame:
        """Stratified sample of each category and year."""
        c = self.cfg.sampling
        parts = [readers.parse_reviews(readers.open_reviews(self.spark, paths), name, c.year_start, c.year_end) for name, paths in self.cfg.sources.items()]
        rows = reduce(DataFrame.unionByName, parts)
        rows = readers.year_range(rows, c.year_start, c.year_end).withColumn("__id", F.sha2(F.concat_ws("|", "timestamp", "rating", "title", "text"), 256))
        self.write(sampling.sampling_summary(rows, "category", "year", list(self.cfg.sources), (c.year_start, c.year_end), c.per_cell, c.equal_cells), "sampling_summary", "Sampled reviews by category and year")
        chosen = sampling.bottom_k(rows, ["category", "year"], c.per_cell, "__id", c.seed)
        return (sampling.equal_cells(chosen, ["category", "year"], "__id", c.seed) if c.equal_cells else chosen).drop("__id")

    def clean(self, sampled: DataFrame) -> DataFrame:
        """Markup gone, duplicates within a category and year gone, other languages gone."""
        title, body = text.clean_text(F.col("title")), text.clean_text(F.col("text"))
        seen = {name: Observation(name) for name in ("sampled", "not empty", "not duplicate", "language")}
        count = F.count(F.lit(1)).alias("n")
        rows = sampled.observe(seen["sampled"], count).withColumn("title", title).withColumn("text", body)
        rows = rows.withColumn("review_text", text.concat_title(F.col("title"), F.col("text"))).filter(F.col("review_text") != "").observe(seen["not empty"], count)
        unique = sampling.drop_duplicates_first(rows, ["category", "year", "review_text"], ["timestamp", "rating", "title", "text"]).observe(seen["not duplicate"], count)
        kept = unique if self.detector is None else langid.keep_language(unique, "review_text", self.detector, ascii_least=self.cfg.ascii_least)
        kept = kept.withColumn("char_len", text.char_len(F.col("review_text"))).withColumn("token_len", text.token_len(F.col("review_text"))).select(*CLEAN_COLUMNS)

        def log() -> None:
            steps = [(name, o.get["n"]) for name, o in seen.items()]
            told = [(name, n, (steps[i - 1][1] if i else n) - n) for i, (name, n) in enumerate(steps)]
            self.write(self.spark.createDataFrame(told, "step string, rows_remaining bigint, rows_dropped bigint").coalesce(1), "preprocessing_log", "Rows kept by each step")

        self.afterwards.append(log)  # the counts come with the write of the table
        return kept.observe(seen["language"], count)

    def score(self, cleaned: DataFrame) -> DataFrame:
        """Sentiment scores and the labels of score and stars."""
        c = self.cfg.labels
        named = cleaned.withColumn("__id", F.monotonically_increasing_id())
        lexicon = sentiment.lexicon_table(self.spark, self.lexicon)
        scores = sentiment.score_documents(named, "__id", "review_text", lexicon)
        rows = named.join(scores, "__id").select(*cleaned.columns, *(F.col(k).alias(f"vader_{k}") for k in ("neg", "neu", "pos", "compound")))
        rows = rows.withColumn("vader_label", sentiment.sentiment_label(F.col("vader_compound"), c.positive_from, c.negative_to))
        return rows.withColumn("star_label", sentiment.star_label(F.col("rating"), c.positive_stars, c.negative_stars))

    # --- analyses of the scored table

    def distributions(self, df: DataFrame) -> dict[str, Any]:
        """How the two categories' scores differ."""
        b = self.cfg.bootstrap
        v, g = "vader_compound", "category"
        d = hist.descriptives(df, v, "vader_label", [g])
        self.write(d, "rq1_descriptives", "Scores by category")
        m, k = rank.mann_whitney(df, v, g, self.a, self.b).first(), rank.ks_2samp(df, v, g, self.a, self.b).first()
        cis = {s: resample.bootstrap_ci(df, v, [g], s, b.iterations, b.level, b.seed).collect() for s in ("mean", "median")}
        diffs = {s: resample.bootstrap_diff_ci(df, v, g, self.a, self.b, s, b.iterations, b.level, b.seed).first() for s in ("mean", "median")}
        tests = [("mannwhitney", m.u, normal_two_sided(m.z) if m.z is not None else None, m.delta, "rank_biserial"), ("ks", k.d, k.p, m.delta, "cliffs_delta")]
        self.write(self.spark.createDataFrame(tests, "test string, stat double, p double, effect_size double, effect_name string"), "rq1", "Tests between categories")
        for name, table in (("kde", figures.kde_grid(df, v, g, -1.0, 1.0)), ("ecdf", rank.ecdf_points(df, v, g)), ("box", figures.box_stats(df, v, g))):
            self.write(table, f"figure_{name}")
        return {"descriptives": d.collect(), "mannwhitney": m, "ks": k, "intervals": cis, "differences": diffs}

    def trends(self, df: DataFrame) -> dict[str, Any]:
        """How scores move over the years."""
        b, v, keys = self.cfg.bootstrap, "vader_compound", ["category", "year"]
        cells = self.hold(resample.bootstrap_ci(df, v, keys, "mean", b.iterations, b.level, b.seed).withColumnRenamed("estimate", "mean"))
        self.write(cells, "rq2_yearly_means", "Yearly means")
        self.write(figures.trend_band(cells, *keys), "figure_trend")
        mk = trend.mann_kendall(cells, "year", "mean", ["category"]).collect()
        ols = trend.with_p_values(trend.ols_simple(df, v, "year", ["category"]).collect())
        terms = trend.with_p_values(trend.ols_interaction(df, v, "year", "category").collect(), "dof")
        yearly = [(r.year, r.u, normal_two_sided(r.z)) for r in rank.mann_whitney(df, v, "category", self.a, self.b, by=["year"]).collect() if r.z is not None]
        pairwise = rank.holm(self.spark.createDataFrame(yearly, "year int, u double, p double"), "p").orderBy("year")
        self.write(pairwise, "rq2_pairwise", "Yearly tests between categories, adjusted")
        word = {r.category: trend.trend_word(r.z) for r in mk}
        rows = [(r.category, word[r.category], normal_two_sided(r.z) if r.z is not None else None, r.tau, r.slope, o["slope"], o["p"], o["ci_lo"], o["ci_hi"]) for r in mk for o in ols if o["category"] == r.category]
        self.write(self.spark.createDataFrame(rows, "category string, mk_trend string, mk_p double, mk_tau double, sens_slope_per_year double, ols_coef_year double, ols_p double, ols_ci_lo double, ols_ci_hi double"), "rq2", "Trends")
        if terms:
            self.write(self.spark.createDataFrame([(t["term"], t["coef"], t["p"], t["ci_lo"], t["ci_hi"]) for t in terms], "term string, coef double, p double, ci_lo double, ci_hi double"), "rq2_interaction_ols", "Interaction of year and category")
        return {"mann_kendall": mk, "ols": ols, "interaction": terms, "pairwise": pairwise.collect()}

    def agreement(self, df: DataFrame) -> dict[str, Any]:
        """How scores agree with stars, overall and by category."""
        b, w = self.cfg.bootstrap, self.cfg.mismatch
        rated = df.filter(F.col("star_label").isNotNull()).withColumn("hit", (F.col("star_label") == F.col("vader_label")).cast("double"))
        rho = rank.spearman(rated, "rating", "vader_compound").first()
        grid, cell = self.hold(agreement.confusion_with_total(rated, "star_label", "vader_label", "category")), ["scope", "category"]
        tables = {"metrics": agreement.agreement_metrics(grid, cell), "classes": agreement.class_metrics(grid, cell), "kappa": agreement.kappa_quadratic(grid, cell), "majority": agreement.majority_of(grid, cell)}
        found = {k: t.collect() for k, t in tables.items()}
        metrics = {name: {k: [r for r in rows if r.scope == scope] for k, rows in found.items()} for name, scope in (("overall", "all"), ("by_category", "each"))}
        self.write(grid.filter("scope = 'all'").drop("scope", "category"), "figure_confusion_overall")
        self.write(grid.filter("scope = 'each'").drop("scope"), "figure_confusion_by_category")
        chi = agreement.chi2_2x2(rated, "category", self.a, self.b, F.col("hit") == 1).first()
        lengths = resample.bootstrap_ci(rated.withColumn("bucket", agreement.length_bucket(F.col("token_len"))).filter("bucket is not null"), "hit", ["bucket"], "proportion", b.iterations, b.level, b.seed)
        self.write(lengths.withColumnRenamed("estimate", "accuracy"), "rq3_agreement_by_length", "Agreement by length")
        kind = agreement.mismatch_type(F.col("rating"), F.col("vader_compound"), w.high_stars, w.low_stars, w.high_score, w.low_score)
        wrong = rated.withColumn("mismatch_type", kind).filter(F.col("mismatch_type").isNotNull()).withColumn("__id", F.sha2(F.concat_ws("|", "timestamp", "rating", "review_text"), 256))
        chosen = sampling.bottom_k(wrong, ["category", "mismatch_type"], w.per_direction, "__id", self.cfg.sampling.seed)
        self.write(chosen.select("category", "year", "rating", "vader_compound", "token_len", "review_text", "mismatch_type"), "mismatches")
        return {"spearman": {"rho": rho.rho, "n": rho.n, "p": rho.p}, **metrics, "chi2": chi, "chi2_p": chi_square_1(chi.chi2) if chi.chi2 is not None else None, "mismatches": agreement.mismatch_counts(rated, kind, ["category"]).collect()}

    def words(self, df: DataFrame) -> dict[str, Any]:
        """Which words set positive from negative reviews apart in a category, and the categories from each other."""
        w, out = self.cfg.words, {}
        docs = df.withColumn("id", F.monotonically_increasing_id())
        for name, rows, group, a, b in [(c, docs.filter(F.col("category") == c), "star_label", "positive", "negative") for c in (self.a, self.b)] + [("crosscat", docs, "category", self.a, self.b)]:
            rows = self.hold(rows.filter(F.col(group).isin(a, b)).select("id", group, "review_text"))
            terms = self.hold(words.document_terms(rows, "id", "review_text", group, w.max_ngram))
            top = words.top_bottom_k(words.fighting_words(words.group_counts(terms, group, a, b, w.min_df, w.max_terms)), w.top_n, a, b)
            self.write(top, f"rq4_words_{name}", f"Distinctive words: {a} and {b} ({name})")
            self.write(words.word_bars(top), f"figure_words_{name}")
            self.write(words.tfidf_top(rows, terms, "id", group, [a, b], w.top_n, w.min_df, w.max_terms), f"tfidf_{name}")
            out[name] = {a: [r.term for r in top.filter(F.col("distinctive_of") == a).limit(10).collect()], b: [r.term for r in top.filter(F.col("distinctive_of") == b).limit(10).collect()]}
            self.release()
        return out

    # --- running

    def write(self, table: DataFrame, name: str, caption: str | None = None) -> None:
        sinks.write_csv(table, f"{self.cfg.output}/tables/{name}")
        if caption:
            with open(f"{self.cfg.output}/tables/{name}.tex", "w", encoding="utf-8") as f:
                f.write(sinks.to_latex(table, caption, f"tab:{name}"))

    def stage(self, name: str, make, force: bool) -> DataFrame:
        path, mark = f"{self.cfg.output}/data/{name}", self.cfg.fingerprint()
        if not force and sinks.stage_is_current(self.spark, path, mark):
            self.log.info("%s is there", name)
            return self.spark.read.parquet(path)
        self.log.info("making %s", name)
        table = sinks.write_stage(make(), path, mark)
        while self.afterwards:
            self.afterwards.pop()()
        self.release()
        return table

    def run(self, only: Sequence[str] = ("distributions", "trends", "agreement", "words"), force: bool = False) -> dict[str, Any]:
        """Make the tables that are missing, run the analyses and write results; returns them too."""
        import os

        os.makedirs(f"{self.cfg.output}/tables", exist_ok=True)
        sampled = self.stage("sample_raw", self.sample, force)
        cleaned = self.stage("sample_clean", lambda: self.clean(sampled), force)
        scored = self.stage("sample_scored", lambda: self.score(cleaned), force)
        self.write(agreement.label_distribution(scored, ["category"], ["star_label", "vader_label"]), "sentiment_summary", "Labels by source")
        results = {}
        for name in only:
            self.log.info("analysing %s", name)
            results[name] = getattr(self, name)(scored)
            sinks.write_json(results[name], f"{self.cfg.output}/stats/{name}.json")
            self.release()
        return results


# Functions of a session whose bodies are SQL, so that the optimizer sees through them.
SQL_FUNCTIONS = {
    "star_label(rating double) returns string": "case when cast(rating as int) in (4, 5) then 'positive' when cast(rating as int) in (1, 2) then 'negative' when rating is not null then 'neutral' end",
    "sentiment_label(score double) returns string": "case when score >= 0.05 then 'positive' when score <= -0.05 then 'negative' when score is not null then 'neutral' end",
    "compound(valence double) returns double": f"valence / sqrt(valence * valence + {sentiment.ALPHA})",
    "rank_biserial(u double, n1 double, n2 double) returns double": "2 * u / (n1 * n2) - 1",
    "sample_key(seed int, id string) returns string": "md5(concat_ws('|', cast(seed as string), id))",
    "review_tokens(t string) returns array<string>": r"""regexp_extract_all(regexp_replace(regexp_replace(lower(t), '[^\\x00-\\x7F\\p{L}\\p{N}]', ' '), '[^\\x00-\\x7F]', '_'), "\\b[a-z]+(?:'[a-z]+)?\\b", 0)""",
}


@udtf(returnType="place int, gram string")
class ReviewNgrams:
    """review_ngrams(words, n_max): every run of one to n_max words with the place of its first, a row each."""

    def eval(self, words: list, n_max: int):
        for i in range(len(words or [])):
            for n in range(1, min(n_max, len(words) - i) + 1):
                yield i, " ".join(words[i : i + n])


def register_functions(spark: SparkSession) -> None:
    """SQL functions of a session: decode_entities(text), those of SQL_FUNCTIONS, and the table function review_ngrams(words, n_max)."""
    spark.udf.register("decode_entities", text.decode_entities)
    spark.udtf.register("review_ngrams", ReviewNgrams)
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("config")
    p.add_argument("--force", action="store_true", help="make stage tables again")
    p.add_argument("--only", nargs="*", default=["distributions", "trends", "agreement", "words"])
    given = p.parse_args(args)
    Pipeline(get_session(), load_config(given.config)).run(given.only, given.force)


if __name__ == "__main__":
    main()
