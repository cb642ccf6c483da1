"""Views that make the star-schema test tables look like scored reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, yr, rating, score: a score in [-1, 1] with four decimals."""
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        F.year("o_orderdate").cast("int").alias("yr"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("rating"),
        ((F.floor(F.col("o_totalprice") / 25) - 10000) / 10000).alias("score"),
    )


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, yr, score with 50 distinct values."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.year("l_shipdate").cast("int").alias("yr"), F.col("l_quantity").alias("score"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, yr, rating, text, lang, quality."""
    d, q = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__id"), "quality")
    return d.join(q, F.col("doc_id") == F.col("__id"), "left").select(
        F.col("doc_id").alias("id"),
        F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "A").otherwise("B").alias("category"),
        (2015 + F.col("doc_id") % 9).cast("int").alias("yr"),
        (1 + F.col("n_chars") % 5).cast("int").alias("rating"),
        "text",
        "lang",
        "quality",
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, day, score."""
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), F.col("ts").cast("date").alias("day"), F.col("value").alias("score"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, text: what users and assistants say."""
    c = _table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("grp"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review records, with blank texts and missing times among them."""
    d = _table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        (1 + F.col("n_chars") % 5).cast("double").alias("rating"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("  A title ")).alias("title"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("  \n ")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 7 != 0, 1388534400000 + F.col("doc_id") % 4000 * 86400000).alias("timestamp"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 10).alias("helpful_vote"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(True)).alias("verified_purchase"),
        "lang",
    )
